"""Document fingerprints: SimHash votes of weighted terms, and permuted block tables for near fingerprints.

Terms are words and runs of three words; a term votes +weight or -weight on each of BITS bits by its hash. Long words
weigh more than short ones, which are common, runs more than words, and a term that occurs t times 1 + ln t. Near fingerprints within a Hamming radius r
are found exactly: of r + 2 or more blocks of bits at least two are equal, so one table per choice of blocks that
must be equal (the permuted table's leading bits) brings every such pair into one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, map_texts, mix64

BITS = 128
#: Prints of one part of a bucket of near fingerprints; a task holds two parts at once.
CELL_ROWS = 32_768
#: Bits within which the query counts fingerprints as near.
NEAR_BITS = 14
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def _votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights over the terms that have each bit set, for one text."""
    both = np.stack([mix64(hashes ^ s) for s in _SEEDS], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1)
    return weights.astype(np.float32) @ bits.astype(np.float32)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(n, 16) bytes; a text without words has zeros throughout."""
    words = Words(texts)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    size = (words.end - words.start).astype(np.float32)
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        n = b - a
        if not n:
            continue
        h, w = words.hash[a:b], np.clip(size[a:b] - 2, 0.2, 4.0)
        if n > 2:
            h = np.concatenate([h, h[:-2] * np.uint64(5) + h[1:-1] * np.uint64(25) + h[2:] * np.uint64(125)])
            w = np.concatenate([w, np.full(n - 2, 6.0, np.float32)])
        h, first, times = np.unique(h, return_index=True, return_counts=True)
        w = w[first] * (1 + np.log(times)).astype(np.float32)
        votes = np.zeros(BITS, np.float32)
        for at in range(0, len(h), 20_000):  # bounds memory on very long texts
            votes += _votes(h[at : at + 20_000], w[at : at + 20_000])
        out[i] = np.packbits(votes > np.float32(w.sum() / 2))
    return out


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - _ONES[a ^ b].sum(axis=1) / BITS


def hex_of(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


def successors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (bucket, copy, id, text), partitioned by ranges of ids and sorted, each bucket closed by a copy of its successor.

    The order is by id, null last, then by a hash of the text. There are ``parts`` buckets at most, as many as shuffle
    partitions if None, whatever the number of rows: their bounds are all that the driver holds, as range partitioning
    does. Bounds are ids of the table, so the first row of the next bucket is known by its id alone. The texts move once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    low, found = rows.agg(F.min("id"), F.percentile_approx("id", shares, 20 * parts) if shares else F.lit(None)).first()
    bounds = np.unique(np.asarray([b for b in found or [] if b > low], np.int64))
    last = len(bounds)

    @F.pandas_udf("own int, also int")
    def place(ids: pd.Series) -> pd.DataFrame:
        null = ids.isna().to_numpy()
        value = ids.fillna(0).astype("int64").to_numpy()
        own = np.searchsorted(bounds, value, side="right")
        also = np.where(np.isin(value, bounds), own - 1, -1)
        also = np.where((value == low) if low is not None else null, last, also)
        own = np.where(null, last, own)
        return pd.DataFrame({"own": own.astype("int32"), "also": np.where(null & (low is not None), -1, also).astype("int32")})

    placed = rows.withColumn("at", place("id"))
    copies = F.filter(F.array(F.struct(F.col("at.own").alias("bucket"), F.lit(False).alias("copy")), F.struct(F.col("at.also").alias("bucket"), F.lit(True).alias("copy"))), lambda x: x["bucket"] >= 0)
    dealt = placed.select("id", "text", F.inline(copies)).repartitionById(last + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "copy", F.col("id").isNull(), "id", F.xxhash64("text"))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row per row of ``docs``. A null text is empty; an empty text's edit is empty; the one row of a table is its
    own successor; rows of one id follow each other in the order of a hash of their texts, null ids come last.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, str]] = []

        def done(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            """All rows but the last, which is the successor of the one before it."""
            own, following = rows[:-1], [t for _, t in rows[1:]]
            edited = []
            for (_, t), after in zip(own, following, strict=True):
                k = len(t) // 4
                edited.append(t[: len(t) - k] + after[:k])
            raw = [t.encode("utf-8") for _, t in rows]
            a, b = fingerprints(raw), fingerprints(e := [t.encode("utf-8") for t in edited])
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in own], pa.int64()), pa.array([len(t) for _, t in own], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in e]),
                 pa.array(hex_of(a[:-1])), pa.array(hex_of(b)), pa.array(likeness(a[:-1], b)), pa.array(likeness(a[:-1], a[1:]))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        bucket, chars, closed = None, 0, False
        for batch in batches:
            for at, copy, id_, t in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "copy", "id", "text")), strict=True):
                if at != bucket:
                    waiting, bucket, chars, closed = [], at, 0, False
                if closed:
                    continue
                waiting.append((id_, t))
                chars += len(t)
                closed = copy
                if len(waiting) > 1 and (copy or chars > 500_000):
                    yield done(waiting)
                    waiting, chars = waiting[-1:], len(t)

    rows = successors(docs, doc_id, text, parts)
    return rows.select("bucket", "copy", "id", "text").mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def own_prints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (fingerprint), one per row of ``docs``, where the texts are read: nothing but fingerprints moves from here."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hex_of(fingerprints(texts)))], names=["fingerprint"])

    return map_texts(docs.select(F.col(text).alias("text")), work, "fingerprint string")


def _near_in_cell(prints: np.ndarray, times: np.ndarray, side: np.ndarray, block: int, radius: int, crossed: bool) -> np.ndarray:
    """For each print of a cell the rows near it whose first equal byte is ``block``; only pairs of two sides if ``crossed``.

    Pairs that agree in a second byte are met by sorting on it, or all pairs are, whichever are fewer. Memory grows as
    the cell does, never as its pairs.
    """
    n, out = len(prints), np.zeros(len(prints), np.int64)
    seconds = list(range(block + 1, radius + 2))
    met = sum(int((c * (c - 1) // 2).sum()) for c in (np.bincount(prints[:, j], minlength=256) for j in seconds))
    for j in seconds if met < n * (n - 1) // 2 else [-1]:
        order = np.argsort(prints[:, j], kind="stable") if j >= 0 else np.arange(n)
        p, t, s = prints[order], times[order], side[order]
        halves, byte, mine = p.view(np.uint64), p[:, j] if j >= 0 else np.zeros(n, np.uint8), np.zeros(n, np.int64)
        for lag in range(1, int(np.bincount(byte).max())):
            near = (np.bitwise_count(halves[lag:] ^ halves[:-lag]).sum(axis=1, dtype=np.int16) <= radius) & (byte[lag:] == byte[:-lag])
            u = np.flatnonzero(near)
            if not len(u):
                continue
            equal = p[u] == p[u + lag]
            ok = equal.argmax(axis=1) == block
            if j >= 0:
                ok &= ~equal[:, block + 1 : j].any(axis=1)
            if crossed:
                ok &= s[u] != s[u + lag]
            u = u[ok]
            mine[u] += t[u + lag]
            mine[u + lag] += t[u]
        out[order] += mine
    return out


def near_counts(prints: DataFrame, column: str = "fingerprint", radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows (fingerprint, n_near): for each distinct hex fingerprint, how many other rows lie within ``radius`` bits, 14 at most.

    Equal fingerprints count, each row once. Prints within the radius agree in two of the 16 bytes or more, the first
    of them among the first radius + 1: one permuted table for each of these, and inside a bucket one for each second
    byte. A pair is counted where its first two equal bytes lead, so once, and no pair is written out. Large buckets
    are dealt into parts of about ``cell_rows`` prints, of which each two meet in a task's cell. Null fingerprints are
    left out. Fingerprints of texts without words are all zeros and so equal.
    """
    if not 0 <= radius <= BITS // 8 - 2:
        raise ValueError("radius must be from 0 to 14")
    distinct = cut(prints.where(F.col(column).isNotNull()).groupBy(F.unhex(F.col(column)).alias("fp")).agg(F.count("*").alias("n")))
    keys = F.array(*[F.conv(F.substring(F.hex("fp"), 1 + 2 * k, 2), 16, 10).cast("int") + 256 * k for k in range(radius + 1)])
    tables = distinct.select("fp", "n", F.explode(keys).alias("key"))
    sizes = tables.groupBy("key").agg(F.ceil(F.count("*") / F.lit(cell_rows)).cast("int").alias("parts"))  # at most 256 a table
    placed = tables.join(F.broadcast(sizes), "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = placed.select("fp", "n", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = dealt.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp", "n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch | None:
            key, a, b, part, times, p = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(p) < 2:
                return None
            found = _near_in_cell(p, times, part, int(key[0]) >> 8, radius, bool(a[0] != b[0]))
            some = np.flatnonzero(found)
            return pa.RecordBatch.from_arrays([pa.array([p[i].tobytes() for i in some], pa.binary()), pa.array(found[some], pa.int64())], names=["fp", "n_near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, a, b, part, n = (np.asarray(batch.column(i)) for i in (0, 1, 2, 3, 5))
            p = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            for x, y in zip(np.r_[0, edges], np.r_[edges, len(key)], strict=True):
                if held and (held[0][0][0], held[0][1][0], held[0][2][0]) != (key[x], a[x], b[x]):
                    if (done := flush()) is not None:
                        yield done
                    held = []
                held.append(tuple(c[x:y] for c in (key, a, b, part, n, p)))
        if held and (done := flush()) is not None:
            yield done

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(work, "fp binary, n_near long")
    near = found.groupBy("fp").agg(F.sum("n_near").alias("n_near"))
    return distinct.join(near, "fp", "left").select(F.lower(F.hex("fp")).alias("fingerprint"), (F.col("n") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near"))
