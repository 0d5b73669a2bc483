"""Fill-in-the-middle transformation: content-defined chunks with remembered summaries locate a document's cuts.

A text's units are its runs of letters A-Z, a-z and its other single characters. A rolling hash of the last WINDOW bytes
ends a chunk where the top bits of its product are all set, so that equal passages make equal chunks wherever they stand. A chunk's summary
(units, characters, whether a letter is at its begin and end) is remembered by its content; a run of letters over a
chunk's edge counts once. Running sums of the summaries give the number of units and the chunk that a cut lies in, and only that chunk
is looked into.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: A chunk ends where the hash of the last WINDOW bytes has its top MASK_BITS bits set: some 512 bytes on average, MOST_BYTES at most.
WINDOW, MASK_BITS, MOST_BYTES = 16, 9, 8192
#: Bytes of remembered chunks in a task, twice.
MEMO_BYTES = 8 << 20
#: Bytes of a text whose hashes are made at once.
RUN_BYTES = 1 << 20

_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*")
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, WINDOW - 1 - i, 1 << 64) for i in range(WINDOW)], np.uint64)


def chunk_ends(text: bytes) -> np.ndarray:
    """Ends of the text's chunks, ascending, the last one its length; an end depends on the WINDOW bytes before it, or on MOST_BYTES.

    An end may lie within a character; the bytes that go on a character count to the chunk that it begins in.
    """
    found, n = [], len(text)
    for at in range(0, n, RUN_BYTES):
        low = max(0, at - WINDOW + 1)
        octets = np.frombuffer(text, np.uint8, min(n, at + RUN_BYTES) - low, low).astype(np.uint64)
        if len(octets) < WINDOW:
            continue
        h = np.zeros(len(octets) - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            h += octets[i : len(h) + i] * _POWERS[i]
        h ^= h >> np.uint64(29)
        ends = np.flatnonzero((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - MASK_BITS)) == np.uint64((1 << MASK_BITS) - 1)) + low + WINDOW
        found.append(ends[ends > at] if at else ends)
    ends = np.concatenate([*found, np.array([n], np.int64)]) if n else np.zeros(0, np.int64)
    ends = np.unique(ends)
    wide = np.flatnonzero(np.diff(ends, prepend=0) > MOST_BYTES)
    if len(wide):
        more = [np.arange(a + MOST_BYTES, b, MOST_BYTES) for a, b in zip(np.r_[0, ends][wide].tolist(), ends[wide].tolist(), strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """(units, characters, whether it begins and ends with a letter); bytes that go on a character from before count nothing."""
    octets = np.frombuffer(chunk, np.uint8)
    letter = _LETTER[octets]
    begins = (octets & 0xC0) != 0x80
    runs = int(np.count_nonzero(letter[1:] & ~letter[:-1])) + int(letter[0])
    chars = int(np.count_nonzero(begins))
    return runs + chars - int(np.count_nonzero(letter)), chars, bool(letter[0]), bool(letter[-1])


class Memo:
    """Summaries by a chunk's content, in two generations of bounded size; a chunk in use stays."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit, self.bytes = limit, 0
        self.young: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.old: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.hits = self.misses = 0

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        got = self.young.get(chunk)
        if got is not None:
            self.hits += 1
            return got
        got = self.old.get(chunk)
        if got is None:
            self.misses += 1
            got = summary(chunk)
        else:
            self.hits += 1
        if self.bytes > self.limit:
            self.old, self.young, self.bytes = self.young, {}, 0
        self.young[chunk] = got
        self.bytes += len(chunk) + 200
        return got


class Cuts:
    """A text's units and where they begin, by the summaries of its chunks."""

    def __init__(self, text: bytes, memo: Memo):
        self.text, self.ends = text, chunk_ends(text)
        starts = np.r_[0, self.ends[:-1]] if len(self.ends) else self.ends
        of = np.array([memo.of(text[a:b]) for a, b in zip(starts.tolist(), self.ends.tolist(), strict=True)], np.int64).reshape(-1, 4)
        joined = np.zeros(len(of), np.int64)
        joined[1:] = of[1:, 2] & of[:-1, 3]  # a run of letters over an edge is one unit
        self.starts = starts
        self.units = np.r_[0, np.cumsum(of[:, 0] - joined)]
        self.chars = np.r_[0, np.cumsum(of[:, 1])]
        self.n = int(self.units[-1])

    def after(self, units: int) -> tuple[int, int]:
        """(bytes, characters) of the text up to the end of its first ``units`` units."""
        if units >= self.n:
            return len(self.text), int(self.chars[-1])
        # unit number ``units`` begins in the last chunk before which there are ``units`` or fewer: what goes on from the chunk before isn't new
        k = int(np.searchsorted(self.units, units, side="right")) - 1
        a, b, left = int(self.starts[k]), int(self.ends[k]), units - int(self.units[k])
        at = a
        while at < b and (self.text[at] & 0xC0) == 0x80:
            at += 1
        if k and _LETTER[self.text[a - 1]]:
            while at < b and _LETTER[self.text[at]]:
                at += 1
        chunk = self.text[a:b]
        for found in _UNIT.finditer(chunk, at - a):
            if not left:
                at = a + found.start()
                break
            left -= 1
        inside = np.frombuffer(chunk, np.uint8)[: at - a]
        return at, int(self.chars[k]) + int(np.count_nonzero((inside & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document: from the SHA-256 of seed:id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def transform(text: bytes, doc_id: int | None, memo: Memo, seed: int = 1) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix_chars, middle_chars, output) of a text."""
    cuts = Cuts(text, memo)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_FROM or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return cuts.n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = (cuts.after(u) for u in sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        form, out = "spm", b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle))
    else:
        form, out = "psm", b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle))
    return cuts.n, form, a_chars, b_chars - a_chars, out


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of a form was made of. A marker of an output can't begin in the text before it, as the text has none."""
    if form == "plain":
        return output
    second = (SUFFIX if form == "psm" else PREFIX).encode()
    at = output.index(second, len(PREFIX))
    to = output.index(MIDDLE.encode(), at + len(second))
    first, other, middle = output[len(PREFIX) : at], output[at + len(second) : to], output[to + len(MIDDLE) :]
    return first + middle + other if form == "psm" else other + middle + first


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one per row of ``docs``.

    The prefix ends after so many units as one of two draws says, the middle after the other; psm puts the suffix before the middle,
    spm the suffix first. A null text is empty; empty texts and those that hold a marker are plain, with null counts. A null id draws as
    the empty word does; repeated rows give equal rows; an empty table none. Other columns are left out.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for part, texts in text_chunks(batches):
            rows = [transform(t, i, memo, seed) for t, i in zip(texts, part.column(0).to_pylist(), strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return map_batches(source, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` of fill_in_middle with the column restored, made of output and form alone."""
    names = [c for c in rows.columns if c != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, outputs in text_chunks(batches, "output"):
            texts = [restore(o, f) for o, f in zip(outputs, part.column(part.schema.get_field_index("form")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "restored"])

    return map_batches(rows.select(*names, "output"), run, ", ".join(f"{c} {t}" for c, t in [*[x for x in rows.dtypes if x[0] != "output"], ("output", "string")]) + ", restored string")
