"""SimHash near-duplicates: 64-bit fingerprints of word shingles, pigeonhole blocks, components of close fingerprints.

1. A text's shingles are hashed where it is read; a bit of its fingerprint is set if it is in over half the hashes.
2. Equal fingerprints are one node. A fingerprint is split into ``blocks`` runs of bits: of two within ``radius`` bits at
   least blocks - radius runs agree, so one table for each choice of so many runs brings every close pair into one bucket.
3. Buckets are shuffled by the hash of their runs. A bucket of more than CELL prints is dealt into parts, of which each
   two meet in a task of their own. Tasks verify Hamming distances and return a spanning forest, never the pairs.
4. Components of the forests' edges are the classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .graph import components

SHINGLE, SEED, BITS = 4, 42, 64
RADIUS = 4
#: Two of six blocks agree within four bits: 15 tables of buckets by 20 to 22 bits. With five blocks, of which one agrees, a
#: bucket would have 13 bits, and comparisons would be a hundred times as many.
BLOCKS = 6
#: Prints of one part of a bucket; a task holds two parts at once.
CELL = 8192
#: Bytes of a long text whose shingles are made at once.
PART_BYTES = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z as a-z, in lists of about PART_BYTES."""
    at = 0
    while at < len(text):
        end = at + PART_BYTES
        if end < len(text):
            blank = _BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end].lower().split()
        at = end


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by blanks."""
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    first, last = (end - length)[: len(words) - size + 1].tolist(), end[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT_OF for k in range(8)])


def print_of(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of a text, unsigned: shingles count as often as they occur; fewer words are one shingle, none give zero."""
    ones, n, carried = np.zeros(BITS, np.int64), 0, []
    for more in _words(text):
        words = carried + more
        if len(words) >= size:
            h = _hashes(words, size)
            ones, n = ones + _ones(h), n + len(h)
            words = words[len(words) - size + 1 :]
        carried = words
    if not n and carried:
        ones, n = _ones(_hashes(carried, len(carried))), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, print), one per row of ``docs``; the print's 64 bits as a signed number. A null text is empty."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        own = np.array([print_of(t, size) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(own)], names=["doc_id", "print"])

    return map_texts(source, work, "doc_id long, print long")


def block_keys(name: str, radius: int, blocks: int) -> list[Column]:
    """For each choice of blocks - radius of the blocks, a hash of the choice and of the bits in it."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be from 0 to blocks - 1, blocks at most 64")
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    runs = [F.shiftrightunsigned(F.col(name), a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [F.xxhash64(F.lit(k), *(runs[i] for i in chosen)) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def forest(own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of the edges of a spanning forest of the distinct prints ``own`` that lie within ``radius`` bits."""
    m, wide = len(own), 256
    met = np.zeros(m, bool)
    for at in range(0, m, wide):
        near = _near(own[at : at + wide], own[at:], radius)
        k = np.arange(len(near))
        near[k, k] = False
        met[at : at + wide] |= near.any(axis=1)
        met[at:] |= near.any(axis=0)
    left, us, vs = np.flatnonzero(met), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit, parent = np.zeros(len(left), bool), np.zeros(len(left), np.int64)
            for at in range(0, len(front), wide):
                some, open_ = front[at : at + wide], np.flatnonzero(~hit)
                near = _near(own[left[open_]], own[some], radius)
                found = near.any(axis=1)
                hit[open_[found]] = True
                parent[open_[found]] = some[near[found].argmax(axis=1)]
            us.append(left[hit])
            vs.append(parent[hit])
            front, left = left[hit], left[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def close_edges(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Edges (u, v) that connect the distinct ``nodes`` (print) just as all pairs within ``radius`` bits do."""
    tables = nodes.select("print", F.explode(F.array(*block_keys("print", radius, blocks))).alias("key"))
    sizes = tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    placed = tables.join(sizes, "key").select("key", "print", parts.alias("parts"), F.pmod(F.xxhash64(F.lit(7), "print"), parts).cast("int").alias("part"))
    dealt = placed.select("key", "print", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = dealt.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "print")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4

        def edges_of(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            own, start = rows[3].view(np.uint64), np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in rows[:3]], axis=0)])
            size = np.diff(np.r_[start, len(own)])
            two = start[size == 2]
            two = two[np.bitwise_count(own[two] ^ own[two + 1]) <= radius]
            us, vs = [own[two]], [own[two + 1]]
            for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                u, v = forest(own[at : at + n], radius)
                us.append(own[at + u])
                vs.append(own[at + v])
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns, strict=True)]
            last = np.flatnonzero(np.any([c != c[-1] for c in rows[:3]], axis=0))
            done = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
            if done:
                yield from edges_of([c[:done] for c in rows])
            held = [c[done:] for c in rows]
        if len(held[0]):
            yield from edges_of(held)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(work, "u long, v long")


def _classes(found: DataFrame, radius: int, blocks: int, cell: int) -> DataFrame:
    """Rows (print, component_id, keeper) of the distinct prints of ``found`` (doc_id, print); keeper has the component's smallest id."""
    nodes = cut(found.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    roots = components(close_edges(nodes, radius, blocks, cell)).withColumnRenamed("node", "print")
    rooted = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("no"), "first_id", "print")).alias("best"))
    return rooted.join(best, "root").select("print", F.col("best.first_id").alias("component_id"), F.col("best.print").alias("keeper"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs``.

    Two rows are linked if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest id that
    links lead to, a row's own included, null only if all of them are null. Null and empty texts and texts of blanks have
    the fingerprint zero, which is linked as any other; repeated rows have equal fingerprints. An empty table gives no rows.
    """
    found = cut(prints(docs, doc_id, text, size))
    classes = _classes(found, radius, blocks, cell).drop("keeper")
    return found.join(classes, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one row of each component of near_duplicates, the one of the smallest id; all columns stay, whatever their names.

    Of rows that agree in id and fingerprint one stays; a component whose ids are all null keeps one of its rows.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash
    by_id, by_text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    classes = _classes(cut(prints(rows, by_id, by_text, size)), radius, blocks, CELL)
    kept = classes.where(F.col("print") == F.col("keeper")).select("print", F.col("component_id").alias("keep_id"))

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        own = np.array([print_of(t, size) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], names=[*part.schema.names, "print"])

    found = map_texts(rows, work, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", print long", by_text)
    met = found.join(kept, "print").where(F.col(by_id).cast("long").eqNullSafe(F.col("keep_id"))).dropDuplicates(["print"])
    return met.select(*rows.columns).toDF(*names)
