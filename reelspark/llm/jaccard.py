"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Texts become sets of five-word shingles. Texts of equal sets are one node with a multiplicity.
2. Band hashes of nodes are shuffled; nodes of one bucket are tied to its first. Components of these ties are clumps.
3. Within a clump all nodes are compared on their full sets, in pairs of blocks of bounded size, so that a large clump
   is many tasks. A task returns counts and a spanning forest of its links, never the pairs.
4. Components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bit_filter, cut, map_texts, mix64, passes, signed
from .graph import components

SHINGLE, THRESHOLD = 5, 0.8
#: Chance to miss a pair at the threshold: (1 - 0.8^8)^40 = 0.06 %.
BANDS, ROWS = 40, 8
BLOCK = 256
_MULTIPLIERS = np.random.default_rng(20240601).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADDENDS = np.random.default_rng(20240602).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's words; fewer words than ``size`` are one shingle, none are none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(n, size)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i]
    return np.unique(mix64(total))


def node_of(own: np.ndarray) -> int:
    """A 64-bit name for a set of shingles."""
    with np.errstate(over="ignore"):
        total = own.sum(dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix64(np.array([total]) + np.uint64(len(own))).view(np.int64)[0])


def band_hashes(own: np.ndarray) -> np.ndarray:
    low = (own >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        best = np.minimum(best, (_MULTIPLIERS[:, None] * low[None, at : at + 2048] + _ADDENDS[:, None]).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return signed(out)


def _members(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, node, bands); node and bands are null for texts without words."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        words = Words(texts)
        sets = [shingles(words.of(i)) for i in range(len(texts))]
        nodes = [node_of(s) if len(s) else None for s in sets]
        bands = [band_hashes(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    return map_texts(source, work, "doc_id long, node long, bands array<long>")


def _bucket_ties(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) from every node of a bucket to its first; buckets meet in partial minima, and a large one may be split."""
    dealt = nodes.select(F.explode("bands").alias("band"), "node")
    first = dealt.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("last")).where(F.col("v") != F.col("last")).drop("last")
    return dealt.join(first, "band").where(F.col("node") != F.col("v")).select(F.col("node").alias("u"), "v")


def _links(nodes: list[int], times: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a group: the rows it is linked to, and the first node of its component in the group.

    Compared are the pairs of a node in ``left`` and one in ``right``.
    """
    n = len(nodes)
    size = np.array([len(s) for s in sets])
    _, ids, times_seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = times_seen > 1
    rank = np.cumsum(shared) - 1
    keep = shared[ids]
    row, col = row[keep], rank[ids[keep]]
    inter = np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    wide = max(64, 2_000_000 // n)
    total = int(shared.sum())
    edges = np.searchsorted(col, np.arange(0, total + wide, wide))
    for k, at in enumerate(range(0, total, wide)):
        a, b = edges[k], edges[k + 1]
        m = np.zeros((n, min(wide, total - at)), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        inter += m @ m.T
    union = size[:, None] + size[None, :] - inter
    linked = inter >= threshold * union - 1e-6
    linked &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    np.fill_diagonal(linked, False)
    add = linked @ times
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        if (new == label).all():
            break
        label = new
    return add, label


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, class_id, n_links, node, keeper), one per row of ``docs``.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least ``threshold``; ``n_links`` counts a
    row's links, ``class_id`` is the smallest id of its component. Null and empty texts, and texts without words, are
    linked to nothing (node null) and are classes of their own. Repeated rows are linked to each other. ``keeper`` is
    the node of the class's smallest id.
    """
    members = cut(_members(docs, doc_id, text))
    nodes = cut(members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times"), F.first("bands").alias("bands")))
    clumps = components(_bucket_ties(nodes)).withColumnRenamed("root", "clump")
    sizes = clumps.groupBy("clump").agg(F.count("*").alias("size"))
    wanted = cut(nodes.drop("bands").join(clumps, "node").join(sizes, "clump"))

    # the sets of one text of each node; a filter of fixed size leaves out almost all other texts
    name = F.col("node").bitwiseXOR(F.coalesce("first_id", F.lit(0)))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(name.alias("term"))))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = _sets(source, wanted, bits)

    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    spread = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("clump", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "times", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            found = [np.frombuffer(r[3], np.uint64) for r in rows]
            side = np.array([r[0] for r in rows])
            add, label = _links([r[1] for r in rows], np.array([r[2] for r in rows]), found, side == key[1], side == key[2], threshold)
            names = np.array([r[1] for r in rows])
            some = np.flatnonzero(add)
            return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[label[some]]), pa.array(add[some].astype(np.int64))], names=["u", "v", "n"])

        for batch in batches:
            for clump, i, j, side, node, times, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (clump, i, j) != key:
                    if (done := flush()) is not None:
                        yield done
                    key, rows = (clump, i, j), []
                rows.append((side, node, times, raw))
        if (done := flush()) is not None:
            yield done

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(spread.repartition(n, "clump", "i", "j").sortWithinPartitions("clump", "i", "j").mapInArrow(compare, "u long, v long, n long"))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.select("u", "v"))

    per_node = nodes.drop("bands").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = per_node.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("no"), "first_id", "node")).alias("best"))
    per_node = per_node.join(best, "root").select("node", F.col("best.first_id").alias("class_id"), F.col("best.node").alias("keeper"), (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = members.drop("bands").join(per_node, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "node", "keeper")


def _sets(source: DataFrame, wanted: DataFrame, bits) -> DataFrame:
    """Rows (clump, size, node, times, shingles) of each wanted node, from one of its texts."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch | None:
        words, rows = Words(texts), []
        for i, id_ in enumerate(part.column(0).to_pylist()):
            own = shingles(words.of(i))
            if len(own) and passes(np.array([(node := node_of(own)) ^ (id_ or 0)]).view(np.uint64), bits.value)[0]:
                rows.append((id_, node, own.tobytes()))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "node", "shingles"])

    made = map_texts(source, work, "doc_id long, node long, shingles binary")
    met = made.join(wanted.select("node", "first_id", "times", "clump", "size"), "node").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    return met.dropDuplicates(["node"]).select("clump", "size", "node", "times", "shingles")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of near_classes, the one of the smallest id; all columns stay.

    Texts without words are classes of their own and stay, repeated or not. Of rows that agree in id and shingles one
    stays. Other columns are carried whatever their names.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash
    by_id, by_text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    classes = near_classes(rows, by_id, by_text, threshold)
    kept = cut(classes.where(F.col("node") == F.col("keeper")).groupBy(F.col("node").alias("keep_node")).agg(F.min("class_id").alias("keep_id")))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(kept.select(F.col("keep_node").bitwiseXOR(F.coalesce("keep_id", F.lit(0))).alias("term"))))
    at_id = names.index(doc_id)

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        words = Words(texts)
        own = [words.of(i) for i in range(len(texts))]
        nodes = [node_of(shingles(w)) if len(w) else None for w in own]
        ids = part.column(at_id).to_pylist()
        may = [n is None or bool(passes(np.array([n ^ int(i or 0)]).view(np.uint64), bits.value)[0]) for n, i in zip(nodes, ids, strict=True)]
        whole = pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.int64())], names=[*part.schema.names, "node"])
        return whole.filter(pa.array(may))

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", node long"
    found = map_texts(rows, work, schema, by_text)
    empty = found.where(F.col("node").isNull())
    # joined by the node alone, so that the texts, which then lie by node, move once
    found = found.where(F.col("node").isNotNull()).join(kept.withColumnRenamed("keep_node", "node"), "node").where(F.col(by_id).eqNullSafe(F.col("keep_id"))).dropDuplicates(["node"])
    return empty.select(*rows.columns).unionByName(found.select(*rows.columns)).toDF(*names)
