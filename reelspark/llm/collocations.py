"""Phrase collocations: mergeable Misra-Gries summaries find what may be frequent, a second pass counts it exactly.

1. Each task hashes its phrases of 1 to ``longest`` words and counts the hashes; a flush sends, for each hash partition,
   the sorted hashes and counts as one packed summary, and before it the mass of the occurrences in it.
2. A partition merges its summaries into one of more than mass / ``least`` counters, subtracting the first count that
   doesn't fit from all. A phrase loses less than ``least`` in this way, so every phrase that occurs ``least`` times or
   more survives; what is left of the others are few.
3. A second pass counts the phrases whose hashes survive, exactly and as strings. Bits of the survivors' hashes go to the
   tasks, which send sorted phrases and counts in packed blocks by a phrase's first two words.
4. Cuts, scores and the rule on longer phrases are joins of the table of frequent phrases with itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bit_filter, cut, filter_bits, map_batches, mix64, passes, run_hashes, text_chunks

LONGEST, LEAST, KEEP, COVER_PERCENT, SCALE = 4, 30, 2000, 80, 2_000_000
#: Occurrences that a task counts before it sends its summaries.
FLUSH = 4_000_000
#: Occurrences of phrases in a hash partition, about; its summary has SLACK counters for each ``least`` of them.
PART_MASS, SLACK = 32_000_000, 2
#: Phrases that a task of the second pass counts before it sends them, and survivors that one of its partitions gets, about.
HELD_PHRASES, PART_PHRASES = 400_000, 100_000
#: Bytes of a long text that are handled at once.
PART_BYTES = 1 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: run_hashes takes no byte 0; 255 is in no UTF-8.
_HASHED = np.where(_LOWER == 0, 255, _LOWER).astype(np.uint8)
_EDGE = re.compile(rb"[ \t.,;:!?\n-\r]")


def _parts(text: bytes, ahead: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, length of their own) of a text's parts; after its own a part has ``ahead`` more words, in which its phrases may end."""
    at, more = 0, re.compile(rb"[ \t]*(?:[^ \t]+[ \t]*){0,%d}" % ahead)
    while at < len(text):
        edge = _EDGE.search(text, at + PART_BYTES) if len(text) - at > PART_BYTES else None
        end = edge.start() if edge else len(text)
        yield text[at : more.match(text, end).end()], end - at
        at = end


class Phrases:
    """The phrases of texts: for each size the places of their first words and 64-bit hashes of language and words."""

    def __init__(self, texts: list[bytes], languages: np.ndarray, longest: int):
        cut_up = [(i, part, own) for i, t in enumerate(texts) for part, own in (_parts(t, longest - 1) if len(t) > PART_BYTES else [(t, len(t))])]
        self.bytes = b"\n".join([part for _, part, _ in cut_up]) + b"\n"
        buffer = np.frombuffer(self.bytes, np.uint8)
        kind = _KIND[buffer]
        edges = np.flatnonzero(np.diff((kind == 0).view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edges[0::2], edges[1::2]
        part_start = np.r_[0, np.cumsum([len(part) + 1 for _, part, _ in cut_up])].astype(np.int64)
        at = np.searchsorted(part_start, self.start, side="right") - 1
        self.text = np.array([i for i, _, _ in cut_up], np.int64)[at]
        self.own = self.start - part_start[at] < np.array([own for _, _, own in cut_up], np.int64)[at]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.word = run_hashes(_HASHED[buffer], self.start, self.end)
        self.language = languages
        self.lower = None

    def of_sizes(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, hashes) of the phrases of 1, 2, ... words that lie in one piece."""
        first, h = np.flatnonzero(self.own), np.empty(0, np.uint64)
        h = mix64(self.word[first] + self.language[self.text[first]])
        yield first, h
        for size in range(2, longest + 1):
            ok = first + size - 1 < len(self.piece)
            ok[ok] = self.piece[first[ok] + size - 1] == self.piece[first[ok]]
            first, h = first[ok], h[ok]
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + self.word[first + size - 1])
            yield first, h

    def leads(self, first: np.ndarray, size: int) -> np.ndarray:
        """A hash of the language and the first two words of each phrase."""
        h = mix64(self.word[first] + self.language[self.text[first]])
        return h if size == 1 else mix64(h * np.uint64(0x9E3779B97F4A7C15) + self.word[first + 1])

    def phrases(self, first: np.ndarray, size: int) -> list[bytes]:
        """The phrases of ``size`` words that begin at these words."""
        return [self.phrase(i, size) for i in first.tolist()]

    def phrase(self, first: int, size: int) -> bytes:
        if self.lower is None:
            self.lower = _LOWER[np.frombuffer(self.bytes, np.uint8)].tobytes()
            self.begins, self.ends = self.start.tolist(), self.end.tolist()
        lower = self.lower
        return b" ".join([lower[a:b] for a, b in zip(self.begins[first : first + size], self.ends[first : first + size], strict=True)])


def _language_hashes(names: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh64_intdigest(x) for x in set(names)}
    return np.array([known[x] for x in names], np.uint64)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A summary of ascending 32-bit keys: gaps and counts, compressed if there are many."""
    raw = b"".join(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in (np.diff(keys, prepend=np.uint32(0)), counts))
    return b"\1" + len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True) if len(keys) > 64 else b"\0" + raw


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[5:], int.from_bytes(blob[1:5], "little"), "zstd", asbytes=True) if blob[:1] == b"\1" else blob[1:]
    gaps, counts = (np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").reshape(-1) for x in np.frombuffer(raw, np.uint8).reshape(2, -1))
    return np.cumsum(gaps, dtype=np.uint32), counts


class Summary:
    """A Misra-Gries summary of hashes: at most ``capacity`` counters after each merge, each too low by at most ``lost``."""

    def __init__(self, capacity: int, pending: int = 4_000_000):
        self.capacity, self.most, self.lost = capacity, max(pending, 2 * capacity), 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            over = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            kept = counts > over
            keys, counts = keys[kept], counts[kept] - over
            self.lost += over
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts


def survivors(source: DataFrame, longest: int = LONGEST, least: int = LEAST, parts: int | None = None, flush: int = FLUSH, slack: int = SLACK) -> DataFrame:
    """Rows (id): hashes of all phrases of ``source`` (lang, text) that occur ``least`` times or more in a language, and of few others.

    An id is the number of a hash partition, times 2^32, plus 32 bits. ``parts`` hash partitions, or as many as bytes of text ask for.
    """
    if parts is None:
        parts = partitions(source)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(0, np.uint64), 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal n
            ids, n = held[:n], 0
            ids.sort()
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ids, times = ids[first], np.diff(np.r_[first, len(ids)])
            bounds = np.searchsorted(ids, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            there = np.flatnonzero(np.diff(bounds))
            sums = np.r_[0, np.cumsum(times)]
            mass = sums[bounds[there + 1]] - sums[bounds[there]]
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(mass), pa.nulls(len(there), pa.binary())], names=["part", "mass", "summary"])
            blobs, names, total = [], [], 0
            for p, a, b in zip(there.tolist(), bounds[there].tolist(), bounds[there + 1].tolist(), strict=True):
                blobs.append(pack(ids[a:b].astype(np.uint32), times[a:b]))
                names.append(p)
                total += len(blobs[-1])
                if total > 4 << 20 or p == there[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.nulls(len(names), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "mass", "summary"])
                    blobs, names, total = [], [], 0

        for part, texts in text_chunks(batches):
            found = Phrases(texts, _language_hashes(part.column(0).to_pylist()), longest)
            for _, h in found.of_sizes(longest):
                if n + len(h) > len(held):
                    held = np.r_[held[:n], np.empty(max(len(h), min(flush, n) + (1 << 20)), np.uint64)]
                held[n : n + len(h)] = _ids(h, parts)
                n += len(h)
            if n > flush:
                yield from sent()
        if n:
            yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mass, summary = None, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if summary is not None and summary.parts:
                keys, counts = summary.merge()
                keys = keys[counts + summary.lost >= least].astype(np.int64) + (own << 32)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["id"])

        for batch in batches:
            for p, m, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != own:
                    yield from done()
                    own, mass, summary = p, 0, None
                if blob is None:  # all masses of a partition come before its summaries
                    mass += m
                else:
                    summary = summary or Summary(slack * (mass // least + 1))
                    summary.add(*unpack(blob))
        yield from done()

    dealt = map_batches(source.select("lang", "text"), count, "part int, mass long, summary binary").repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("part", F.col("summary").isNotNull()).mapInArrow(merge, "id long")


def _ids(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def partitions(source: DataFrame) -> int:
    """Hash partitions of about PART_MASS occurrences, a word taken as six bytes; as many as shuffle partitions at least."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * 4 // (6 * PART_MASS)))


def frequent(source: DataFrame, longest: int = LONGEST, least: int = LEAST, held: int = HELD_PHRASES) -> DataFrame:
    """Rows (lang, phrase, size, f): how often each phrase of ``source`` (lang, text) occurs in its language, where ``least`` times or more.

    And a row with size 0 and the empty phrase for each language that has words: f is their number. A task holds about ``held``
    phrases before it sends them.
    """
    alive = cut(survivors(source, longest, least))
    n_alive = alive.count()
    width = filter_bits(n_alive, 64)
    bits = source.sparkSession.sparkContext.broadcast(bit_filter(alive, "id", width))
    hashed = partitions(source)
    parts = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_alive // PART_PHRASES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, total = Tally(), Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            for (part, lang), phrases, n in [*tally.blocks(parts), *(((0, lang), [b""], [n]) for lang, n in total.items())]:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lang]), pa.array([pack_phrases(phrases, n)], pa.binary())], names=["part", "lang", "block"])
            tally.clear(), total.clear()

        for part, texts in text_chunks(batches):
            languages = part.column(0).to_pylist()
            found = Phrases(texts, _language_hashes(languages), longest)
            for size, (first, h) in enumerate(found.of_sizes(longest), 1):
                if size == 1:
                    for i, n in zip(*(x.tolist() for x in np.unique(found.text[first], return_counts=True)), strict=True):
                        total[languages[i]] += n
                on = passes(_ids(h, hashed), bits.value, width)
                own, place, n = np.unique(h[on], return_index=True, return_counts=True)
                tally.add(own, n, first[on][place], size, found, languages)
            if len(tally.index) > held:
                yield from sent()
        yield from sent()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f = None, Counter()

        def done() -> Iterator[pa.RecordBatch]:
            kept = [(phrase, n) for phrase, n in f.items() if n >= least or not phrase]
            for at in range(0, len(kept), 10_000):
                phrases, n = zip(*kept[at : at + 10_000], strict=True)
                size = [p.count(b" ") + 1 if p else 0 for p in phrases]
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(n)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "size", "f"])

        for batch in batches:
            for part, lang, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, lang) != key:
                    yield from done()
                    key, f = (part, lang), Counter()
                for phrase, n in zip(*unpack_phrases(block), strict=True):
                    f[phrase] += n
        yield from done()

    blocks = map_batches(source.select("lang", "text"), count, "part int, lang string, block binary").repartitionById(parts, F.col("part"))
    return blocks.sortWithinPartitions("part", "lang").mapInArrow(add, "lang string, phrase string, size int, f long")


class Tally:
    """Phrases by their hash, with their counts; numbers lie in arrays, as a task holds hundreds of thousands."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.phrases: list[bytes] = []
        self.languages: list[str] = []
        self.lead: list[np.ndarray] = []
        self.times = np.zeros(1 << 16, np.int64)

    def add(self, hashes: np.ndarray, times: np.ndarray, first: np.ndarray, size: int, found: Phrases, languages: list[str]) -> None:
        """Counts distinct phrases of ``size`` words, whose first words are ``first`` in ``found``."""
        at = np.fromiter(map(self.index.get, hashes.tolist(), repeat(-1)), np.int64, len(hashes))
        old, new = at >= 0, np.flatnonzero(at < 0)
        self.times[at[old]] += times[old]
        if not len(new):
            return
        n = len(self.phrases)
        if n + len(new) > len(self.times):
            self.times = np.r_[self.times, np.zeros(n + len(new), np.int64)]
        self.times[n : n + len(new)] = times[new]
        self.index.update(zip(hashes[new].tolist(), range(n, n + len(new)), strict=True))
        self.phrases += found.phrases(first[new], size)
        self.languages += [languages[i] for i in found.text[first[new]].tolist()]
        self.lead.append(found.leads(first[new], size))

    def blocks(self, parts: int) -> Iterator[tuple[tuple[int, str], list[bytes], list[int]]]:
        """((part, language), sorted phrases, counts); phrases of the same two first words have one part, as sorted they are packed well."""
        if not self.phrases:
            return
        names, language = np.unique(np.array(self.languages, object), return_inverse=True)
        part = (np.concatenate(self.lead) >> np.uint64(20)) % np.uint64(parts)
        key = part.astype(np.int64) * len(names) + language
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            rows = sorted(order[a:b].tolist(), key=self.phrases.__getitem__)
            yield (int(key[rows[0]]) // len(names), names[key[rows[0]] % len(names)]), [self.phrases[i] for i in rows], self.times[rows].tolist()


def pack_phrases(phrases: list[bytes], counts: list[int]) -> bytes:
    """A block of phrases, which have no line break, and of their counts."""
    raw = np.array(counts, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + b"\n".join(phrases)
    return len(phrases).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_phrases(block: bytes) -> tuple[list[bytes], list[int]]:
    n = int.from_bytes(block[:4], "little")
    raw = pa.decompress(block[12:], int.from_bytes(block[4:12], "little"), "zstd", asbytes=True)
    counts = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").reshape(-1)
    return raw[8 * n :].split(b"\n"), counts.tolist()


def _exact(x: Column) -> Column:
    """A count as a number whose products don't pass their type."""
    return x.cast("decimal(20,0)")


def cut_scores(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (lang, phrase, size, a, l, r, score) of the phrases of two words or more in ``counts``: their lowest cut, the first of equal ones."""
    words = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"), k)
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    parts = counts.where("size > 0")
    both = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.call_function("div", _exact(F.col("a")) * F.lit(scale), _exact(F.col("l")) + _exact(F.col("r")))
    best = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def covered(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Rows (lang, phrase, over): how often the most frequent longer phrase around each phrase occurs."""
    w, size = F.split("phrase", " "), F.col("size")
    inner = [F.when(size >= at + n - 1, F.array_join(F.slice(w, at, n), " ")) for n in range(2, longest) for at in range(1, longest - n + 2)]
    runs = [F.when(size > n, x) for n, x in zip([n for n in range(2, longest) for _ in range(1, longest - n + 2)], inner, strict=True)]
    if not runs:
        return counts.where("false").select("lang", "phrase", F.col("f").alias("over"))
    return counts.where("size > 2").select("lang", F.explode(F.array(*runs)).alias("phrase"), "f").where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("f").alias("over"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, keep: int = KEEP, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``keep`` best phrases of 2 to ``longest`` words of each language.

    a, l, r count a phrase and the two parts of its lowest cut, n all words of the language. Ranks go by score, then a,
    both falling, then by the phrase's UTF-8 bytes. Phrases that occur less than ``least`` times are out, and those inside
    a longer one that occurs ``cover_percent`` % as often or more. A null language is ``und``, a null text empty; repeated rows
    count each time; a language without such phrases, or an empty table, gives no rows. Phrases are told apart by
    their strings, but for those within one task, which a 64-bit hash tells apart.
    """
    if longest < 1 or least < 1:
        raise ValueError("longest and least must be 1 or more")
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = cut(frequent(source, longest, least))
    scored = cut_scores(counts).join(covered(counts, longest), ["lang", "phrase"], "left")
    free = scored.where(F.col("over").isNull() | (_exact(F.col("over")) * F.lit(100) < _exact(F.col("a")) * F.lit(cover_percent)))
    # a language may hold most phrases: the best of each part of it first
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    best = free.withColumn("salt", salt).withColumn("at", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= keep)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
