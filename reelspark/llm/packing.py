"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Documents become token ids with an end id; longer ones are cut at the sequence length. Full pieces are sequences of
their own. The others are dealt into shards of a bounded number of pieces, and each shard is packed by bin
completion: depth-first, the largest remaining piece is placed together with each of the undominated fillings of what
is left of its sequence in turn, fullest first; branches whose waste exceeds what the incumbent allows are pruned; the first
incumbent is best-fit decreasing. Sequences that a shard leaves poorly filled are packed again in a second round.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, run_hashes

CAPACITY = 2048
SHARD_PIECES = 4096
#: Nodes of one shard's search, or NODES_A_BIN for each sequence of its first incumbent if that is more; a packing takes a
#: node a sequence. The incumbent is kept when they are used up, or when NODE_STEPS times as many partial fillings were
#: looked at: near a search's end most fillings are dominated ones.
SEARCH_NODES, NODES_A_BIN, NODE_STEPS = 20_000, 4, 100
#: Levels of a search that keep their enumeration, half a megabyte each; higher ones begin it anew when the search comes back.
LIVE_LEVELS = 32
#: Words whose ids a worker remembers, and ids in all; some 30 MB.
CACHE_WORDS, CACHE_IDS = 1 << 19, 1 << 21

#: Bytes of a text that are encoded at once, up to the next white space.
PART_BYTES = 1 << 20
_WHITE = re.compile(rb"[ \t\n\r]")

_tokenizers: dict[str, "WordTokenizer"] = {}

_SPACE, _LETTER, _NUMBER, _SYMBOL, _OTHER, _TAIL = range(6)


def _byte_kinds() -> np.ndarray:
    """What a byte of lower-case UTF-8 begins: the kinds of what the pre-tokeniser tells apart, for characters below U+0250."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[0x80:0xC0] = _TAIL
    kinds[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
    kinds[0x21:0x7F] = _SYMBOL
    kinds[ord("0") : ord("9") + 1] = _NUMBER
    kinds[ord("a") : ord("z") + 1] = kinds[ord("A") : ord("Z") + 1] = _LETTER
    kinds[0xC3:0xCA] = _LETTER  # but for those of _two_byte_kinds
    return kinds


def _two_byte_kinds() -> dict[int, np.ndarray]:
    """The kind by second byte of the characters that begin with C2, C3 or C9, among which are others than letters."""
    names = {"L": _LETTER, "N": _NUMBER, "Z": _OTHER, "C": _OTHER}
    out = {}
    for lead in (0xC2, 0xC3, 0xC9):
        chars = [chr((lead & 0x1F) << 6 | low) for low in range(64)]
        kinds = [_OTHER if ord(c) >= 0x250 else names.get(unicodedata.category(c)[0], _SYMBOL) for c in chars]
        out[lead] = np.array([_OTHER] * 128 + kinds + [_OTHER] * 64, np.uint8)
    return out


_KINDS, _SECOND = _byte_kinds(), _two_byte_kinds()
#: What follows an apostrophe in a contraction, which is a word of its own.
_CONTRACTED = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def _byte_letters() -> dict[int, str]:
    """A byte-level vocabulary's letters: printable bytes stand for themselves, the others for what follows U+00FF."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case UTF-8, and where bytes are that no word of this kind can have.

    A word is a run of letters or of symbols, one number, or a contraction that no symbol stands before.
    """
    kind = _KINDS[buffer]
    leads = np.flatnonzero(buffer >= 0xC2)
    if len(leads):
        after = np.minimum(leads + 1, len(buffer) - 1)
        for lead, kinds in _SECOND.items():
            own = buffer[leads] == lead
            kind[leads[own]] = kinds[buffer[after[own]]]
        tails = np.flatnonzero(kind == _TAIL)
        kind[tails] = kind[tails - 1]  # characters have two bytes; texts with longer ones aren't looked at
    first = np.ones(len(buffer), bool)
    first[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == _NUMBER) & ((buffer[1:] & 0xC0) != 0x80))
    first &= kind != _SPACE
    marks = np.flatnonzero((buffer == ord("'")) & first)
    marks = marks[marks + 2 < len(buffer)]
    if len(marks):
        for tail in _CONTRACTED:
            at = marks[buffer[marks + 1] == tail[0]]
            if len(tail) == 2:
                at = at[buffer[at + 2] == tail[1]]
            first[at + 1] = False
            if len(tail) == 2:
                first[at + 2] = False
            end = at + 1 + len(tail)
            end = end[end < len(buffer)]
            first[end] |= kind[end] == _LETTER
    edges = np.flatnonzero(first | (kind == _SPACE))
    begins = first[edges]
    ends = np.r_[edges[1:], len(buffer)]
    return edges[begins], ends[begins], np.flatnonzero(kind == _OTHER)


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of at least PART_BYTES that end before white space."""
    at = 0
    while at < len(text):
        found = _WHITE.search(text, at + PART_BYTES)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class WordTokenizer:
    """Token ids of whole texts.

    The vocabulary drops white space, so the ids of a text are those of its words one after another. The words of many
    texts are found at once and looked up by 64-bit hashes; only words that a worker doesn't remember go to the model.
    Texts with characters from U+0250 on, control characters or a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.forget()

    def forget(self) -> None:
        """An empty memory: hashes and their numbers by slot, and the ids of the numbered words one after another."""
        self.slots, self.numbers = np.zeros(2 * CACHE_WORDS, np.uint64), np.zeros(2 * CACHE_WORDS, np.int32)
        self.starts, self.n, self.ids = np.zeros(CACHE_WORDS + 2, np.int64), 0, np.zeros(1 << 16, np.uint32)

    def _model(self, word: bytes) -> list[int]:
        return [t.id for t in self.whole.model.tokenize(word.decode("latin-1").translate(self.letters))]

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of remembered words, -1 of others."""
        out, todo = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        slot = (hashes >> np.uint64(40)).astype(np.int64) % len(self.slots)
        while len(todo):
            held = self.slots[slot]
            same = held == hashes[todo]
            out[todo[same]] = self.numbers[slot[same]]
            on = ~same & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) % len(self.slots)
        return out

    def _remember(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """New words, each once."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        first = int(self.starts[self.n])
        need = first + int(lengths.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need - len(self.ids), len(self.ids)), np.uint32)])
        self.ids[first:need] = np.fromiter((i for w in ids for i in w), np.uint32, need - first)
        number = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        if len(self.starts) < self.n + len(ids) + 1:
            self.starts = np.concatenate([self.starts, np.zeros(len(ids) + len(self.starts), np.int64)])
        self.starts[self.n + 1 : self.n + 1 + len(ids)] = first + np.cumsum(lengths)
        self.n += len(ids)
        if 4 * self.n > 3 * len(self.slots):  # one text of very many words
            some = self.slots != 0
            old, numbers = self.slots[some], self.numbers[some]
            self.slots, self.numbers = np.zeros(4 * self.n, np.uint64), np.zeros(4 * self.n, np.int32)
            self._put(old, numbers)
        self._put(hashes, number)

    def _put(self, hashes: np.ndarray, number: np.ndarray) -> None:
        todo, slot = np.arange(len(hashes)), (hashes >> np.uint64(40)).astype(np.int64) % len(self.slots)
        while len(todo):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = hashes[todo[free]]
            mine = self.slots[slot] == hashes[todo]
            self.numbers[slot[mine]] = number[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) % len(self.slots)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, without an end id. A long text is encoded in parts, cut at white space."""
        out, some = [], []
        for t in texts:
            if len(t) <= PART_BYTES:
                some.append(t)
                continue
            out += self._encode(some) if some else []
            some = []
            out.append(np.concatenate([self._encode([p])[0] for p in _parts(t)]))
        return out + (self._encode(some) if some else [])

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.n > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self.forget()
        lower = [t.lower() if t.isascii() else t.decode("utf-8").lower().encode("utf-8") for t in texts]
        buffer = np.frombuffer(b" ".join(lower) + b" ", np.uint8)
        text_end = np.cumsum(np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower)))
        start, end, other = word_bounds(buffer)
        by_model = {int(i) for i in np.unique(np.searchsorted(text_end, other, side="right"))}
        by_model |= {i for i, t in enumerate(texts) if b"<|" in t and any(s in t for s in self.special)}
        if by_model:
            mine = ~np.isin(np.searchsorted(text_end, start, side="right"), sorted(by_model))
            start, end = start[mine], end[mine]
        hashes = np.maximum(run_hashes(buffer, start, end), np.uint64(1))
        raw = buffer.tobytes()
        for k in np.flatnonzero(end - start > 64):  # a hash of another kind, which no text can be made to repeat
            hashes[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]], digest_size=8).digest(), "little") or 1
        number = self._look_up(hashes)
        new, at = np.unique(hashes[number < 0], return_index=True)
        if len(new):
            at = np.flatnonzero(number < 0)[at]
            self._remember(new, [self._model(raw[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            number[number < 0] = self._look_up(hashes[number < 0])
        lengths = (self.starts[1:] - self.starts[:-1])[number]
        ends = np.cumsum(lengths)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[number] - ends + lengths, lengths)]
        first = np.r_[0, ends][np.searchsorted(start, np.r_[0, text_end])]
        return [np.asarray(self.whole.encode(t.decode("utf-8"), add_special_tokens=False).ids, np.uint32) if i in by_model else ids[first[i] : first[i + 1]] for i, t in enumerate(texts)]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Rows (uid, doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut at ``capacity``."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    end = np.asarray([end_id], "<u4").tobytes()
    width = 4 * capacity
    state = {"task": None, "n": 0}

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        task = TaskContext.get()
        if state["task"] != task.taskAttemptId():
            state.update(task=task.taskAttemptId(), n=0)
        rows: list[tuple] = []
        for id_, found in zip(part.column(0).to_pylist(), tokenizer(path).encode(texts), strict=True):
            ids = found.astype("<u4").tobytes() + end
            for k, at in enumerate(range(0, len(ids), width)):
                some = ids[at : at + width]
                rows.append(((task.partitionId() << 36) + state["n"], id_, k, at // 4, len(some) // 4, zlib.crc32(some)))
                state["n"] += 1
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(source, work, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


# --- bin completion of one shard ------------------------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; returns the lengths of each bin."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has r left
    for n in sorted(lengths, reverse=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(n)
        else:
            room, b = capacity, len(bins)
            bins.append([n])
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _sums(counts: np.ndarray, sizes: list[int], room: int) -> list[int]:
    """For each place of ``sizes``: a bit for each sum, up to ``room``, that the pieces of the sizes from there on can have."""
    out, bits, mask = [1], 1, (1 << (room + 1)) - 1
    for s in reversed(sizes):
        left, step = min(int(counts[s]), room // s), 1
        while left:  # any number up to the count, by doubling
            n = min(step, left)
            bits |= (bits << (n * s)) & mask
            left, step = left - n, 2 * step
        out.append(bits)
    return out[::-1]


class _Effort:
    """What a search may still do."""

    def __init__(self, nodes: int):
        self.nodes, self.steps = nodes, nodes * NODE_STEPS

    @property
    def left(self) -> bool:
        return self.nodes > 0 and self.steps > 0


def fillings(counts: np.ndarray, sizes: list[int], room: int, effort: _Effort | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` by remaining pieces, one after another, fullest first, larger pieces first.

    A filling is dominated if one of its pieces, or two together, could give way to a single remaining piece that is
    larger, or as large as the two, and fits: whatever packing has it, one as good has the other. Dominance of more
    pieces isn't tested, which costs nodes, not packings. It ends early when ``effort`` is used up.
    """
    effort = effort or _Effort(1 << 60)
    usable = [s for s in sizes if s <= room and counts[s] > 0]
    reach = _sums(counts, usable, room)
    available = sum(1 << s for s in usable)

    def dominated(fill: tuple[int, ...], left: int) -> bool:
        rest = available
        for s in set(fill):
            if counts[s] <= fill.count(s):
                rest &= ~(1 << s)
        span = (1 << (left + 1)) - 1
        if rest & ((span >> 1) << 1):  # a piece fits beside it
            return True
        if left and any((rest >> (s + 1)) & (span >> 1) for s in set(fill)):
            return True
        return any((rest >> (a + b)) & span for i, a in enumerate(fill) for b in fill[i + 1 :])

    for total in range(room, -1, -1):
        if not reach[0] >> total & 1:
            continue
        # depth first: (place in sizes, sum to go, pieces so far)
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, total, ())]
        while stack:
            k, togo, fill = stack.pop()
            effort.steps -= 1
            if effort.steps <= 0:
                return
            if not togo:
                if not dominated(fill, room - total):
                    yield fill
                continue
            s = usable[k]
            most = min(int(counts[s]), togo // s)
            for n in range(0, most + 1):  # the largest number is popped first
                if reach[k + 1] >> (togo - n * s) & 1:
                    stack.append((k + 1, togo - n * s, fill + (s,) * n))


#: Dual feasible functions of the kinds that bounds use: so many that round to parts of a bin, and cuts below which pieces count nothing.
PARTS, CUTS = 15, 32


def bound_weights(counts: np.ndarray, capacity: int) -> np.ndarray:
    """(functions, capacity + 1): weights of lengths such that no pieces that fit one bin weigh more than 1 together.

    So pieces that weigh w by any of them need w bins. The first is a piece's share of a bin. Others round lengths to k-th parts
    (of more than a third of a bin two fit at most, whatever the volume), or count what is longer than a bin less a cut as
    whole bins and what is shorter than the cut as nothing.
    """
    x = np.arange(capacity + 1)
    rows = [x / capacity]
    for k in range(1, PARTS + 1):
        y = (k + 1) * x
        rows.append(np.where(y % capacity == 0, x / capacity, y // capacity / k))
    half = np.flatnonzero(counts[: capacity // 2 + 1])
    for cut in np.unique(half[np.linspace(0, len(half) - 1, min(CUTS, len(half))).astype(int)]) if len(half) else ():
        rows.append(np.where(x > capacity - cut, 1.0, np.where(x < cut, 0.0, x / capacity)))
    return np.array(rows)


def bins_for(weighed: np.ndarray) -> int:
    """The bins that pieces of these total weights need at least."""
    return int(np.ceil(weighed.max() - 1e-6))


def complete_bins(lengths: list[int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[list[int]]:
    """Packs lengths (1 to capacity) into few bins; best-fit decreasing unless the search finds fewer.

    The search is complete: if it ends before its effort is used up, no packing has fewer bins.
    """
    incumbent = best_fit(lengths, capacity)
    if not lengths:
        return incumbent
    total, counts = sum(lengths), np.bincount(lengths, minlength=capacity + 1)
    weights = bound_weights(counts, capacity)
    left = weights @ counts  # of the pieces that aren't placed
    least = bins_for(left)
    if len(incumbent) <= least:
        return incumbent
    sizes = [int(s) for s in np.flatnonzero(counts)[::-1]]
    effort = _Effort(max(nodes, NODES_A_BIN * len(incumbent)))
    allowed = (len(incumbent) - 1) * capacity - total
    # depth-first without recursion: each level has the fillings still to try, and how many were tried
    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[list] = []
    waste = 0

    def options() -> Iterator[tuple[int, ...]]:
        head = next(s for s in sizes if counts[s])
        own = counts.copy()  # what remains here, whatever is tried below
        own[head] -= 1
        return ((head, *f) for f in fillings(own, sizes, capacity - head, effort))

    def undo() -> None:
        nonlocal waste, left
        fill, lost = path.pop()
        waste -= lost
        left = left + weights[:, fill].sum(axis=1)
        for s in fill:
            counts[s] += 1

    def descend() -> None:
        stack.append([options(), 0])
        if len(stack) > LIVE_LEVELS:
            stack[-LIVE_LEVELS - 1][0] = None

    descend()
    while stack and effort.left and len(incumbent) > least:
        level = stack[-1]
        if level[0] is None:  # nothing below is placed any more, so the enumeration is the same again
            level[0] = islice(options(), level[1], None)
        fill = next(level[0], None)
        level[1] += 1
        lost = 0 if fill is None else capacity - sum(fill)
        if fill is None or waste + lost > allowed:  # fillings come fullest first: the others waste as much or more
            stack.pop()
            if path:
                undo()
            continue
        effort.nodes -= 1
        for s in fill:
            counts[s] -= 1
        path.append((fill, lost))
        waste += lost
        left = left - weights[:, fill].sum(axis=1)
        if len(path) + bins_for(left) >= len(incumbent):
            undo()
            continue
        if counts.any():
            descend()
            continue
        incumbent = [list(f) for f, _ in path]
        allowed = (len(incumbent) - 1) * capacity - total
        undo()
    return incumbent


def _pack_group(pdf: pd.DataFrame, capacity: int, round_: int) -> pd.DataFrame:
    """Packs the pieces of one shard; deterministic: pieces of a length are dealt in the order of uid."""
    _tokenizers.clear()  # a worker that packs tokenises no more, and the search can use the memory
    pdf = pdf.sort_values(["length", "uid"], kind="stable").reset_index(drop=True)
    bins = complete_bins(pdf["length"].tolist(), capacity)
    by_length = {n: list(rows) for n, rows in pdf.groupby("length").indices.items()}
    shard = int(pdf["shard"].iloc[0])
    rows, seq, off, fill = [], [], [], []
    for k, b in enumerate(bins):
        at, full = 0, sum(b)
        for n in b:
            rows.append(by_length[n].pop())
            seq.append((round_ << 56) + (shard << 20) + k)
            off.append(at)
            fill.append(full)
            at += n
    out = pdf.iloc[rows].copy()
    out["sequence_id"], out["offset"], out["fill"] = seq, off, fill
    return out.drop(columns="shard")


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece of every document.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null id stays null.
    No rows in, none out. A sequence's pieces lie side by side from offset 0; only texts over ``capacity`` are cut.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    all_pieces = cut(pieces(docs, path, doc_id, text, capacity))
    full = all_pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    rest = all_pieces.where(F.col("length") < capacity)
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"

    def shards(n: int) -> int:
        return max(1, -(-n // shard_pieces))

    count = shards(rest.count())
    first = rest.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(count))).groupBy("shard").applyInPandas(lambda p: _pack_group(p, capacity, 1), schema)
    if count == 1:
        return full.select(columns).unionByName(first.select(columns))
    # what the shards leave poorly filled meets again: at most a few sequences of each
    first = cut(first)
    loose = F.col("fill") < capacity - capacity // 64
    again = first.where(loose).drop("sequence_id", "offset", "fill")
    count = shards(again.count())
    second = again.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(count))).groupBy("shard").applyInPandas(lambda p: _pack_group(p, capacity, 2), schema)
    return full.select(columns).unionByName(first.where(~loose).select(columns)).unionByName(second.select(columns))
