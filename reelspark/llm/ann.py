"""Approximate nearest neighbours: a hash-prefix forest whose prefixes deal the rows.

Each tree hashes a vector to a string of LETTERS letters. A letter is a cross-polytope hash: of all signed axes of a
seeded random rotation, the one that the vector points along most. Rows are dealt to tasks by tree and prefix, never to
shards that every query visits; a prefix that too many rows share grows by a letter, as often as it takes. A query enters
each tree at its own prefix and at the PROBES likeliest variations of it. There it descends to the longest common
prefix; then all trees ascend at once, by the same step: first a letter of the common prefix is given up, then, on the
other strings, the step is the strings' cost, the squared shortfalls of their letters against the query's own. The
ascent stops where the trees hold enough candidates together, as many as grow with a power of the rows. A query whose
prefixes hold too few enters anew with more variations, in the end with all, which is the root of the trees.

Candidates are compared by 8-bit codes, the best of these by their exact inner product. Inner products become angles by
one more coordinate, which makes all rows as long as the longest. Equal vectors are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .common import cut

TREES, LETTERS, SEED = 6, 6, 5
#: A letter stands for one of 2 x 64 directions at most.
WIDTH = 64
#: Candidates of a query, CANDIDATES x rows ^ POWER; on random vectors of 64 numbers this finds nine of ten neighbours.
CANDIDATES, POWER = 4.0, 0.65
#: Rows that a query's prefixes hold, in candidates.
PROBED = 8.0
#: Rows of a prefix from which on it grows by a letter; of the longest ones, of a part of it.
CELL_ROWS = 16_384
#: Steps of the ascent over costs, and steps a unit of cost.
STEPS, FINE = 32, 8
#: Candidates by code that are compared exactly, and what their codes' products may be off.
SHORTLIST, MARGIN = 64, 0.015


def candidates_wanted(rows: int, k: int = 20) -> int:
    """Strings that the trees hold together where an ascent stops: so many that k + 1 rows are among them, or all."""
    wanted = max(TREES * (k + 1), math.ceil(CANDIDATES * rows**POWER))
    return wanted if wanted < rows else TREES * rows


class Hashes:
    """The rotations of all trees and letters for vectors of one length."""

    def __init__(self, size: int, trees: int = TREES, letters: int = LETTERS, seed: int = SEED):
        self.trees, self.letters, self.width = trees, letters, min(size, WIDTH)
        rng = np.random.default_rng([seed, size])
        self.axes = np.stack([np.linalg.qr(rng.standard_normal((size, self.width)))[0] for _ in range(trees * letters)]).astype(np.float32)

    @property
    def radix(self) -> int:
        return 2 * self.width

    def values(self, x: np.ndarray, tree: int, letters: slice = slice(None)) -> np.ndarray:
        """How much each vector points along each letter's direction: (vectors, letters, radix)."""
        axes = self.axes[tree * self.letters : (tree + 1) * self.letters][letters]
        y = np.stack([x @ a for a in axes], axis=1)
        return np.concatenate([y, -y], axis=2)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees x letters) of letters."""
        out = [np.concatenate([y := x @ a, -y], axis=1).argmax(axis=1) for a in self.axes]
        return np.stack(out, axis=1).astype(np.uint8)

    def costs(self, x: np.ndarray, tree: int, letters: slice = slice(None)) -> np.ndarray:
        """Squared shortfall of each letter against the vector's own, in the latter's value: 0 for its own."""
        v = self.values(x, tree, letters)
        most = v.max(axis=2, keepdims=True)
        return ((most - v) / np.maximum(most, 1e-12)) ** 2


_made: dict[int, Hashes] = {}


def hashes(size: int) -> Hashes:
    if size not in _made:
        _made[size] = Hashes(size)
    return _made[size]


def best_prefixes(costs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` cheapest strings over the given letters' costs (letters, radix) of one vector, cheapest first."""
    prefixes, total = np.zeros((1, 0), np.uint8), np.zeros(1, np.float32)
    for letter in costs:  # a cheapest string begins with one of the cheapest shorter ones
        order = np.argsort(letter, kind="stable")[:most]
        sums = (total[:, None] + letter[order][None, :]).ravel()
        best = np.argsort(sums, kind="stable")[:most]
        prefixes = np.concatenate([prefixes[best // len(order)], order[best % len(order)][:, None].astype(np.uint8)], axis=1)
        total = sums[best]
    return prefixes, total


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as 8-bit integers and a scale for each."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def packed(strings: np.ndarray) -> np.ndarray:
    """Strings as integers of their order, the first letter highest."""
    wide = np.zeros((len(strings), 8), np.uint8)
    wide[:, : strings.shape[1]] = strings
    return wide.view(">u8").ravel().astype(np.uint64)


def common_prefix(order: np.ndarray, own: int, letters: int) -> tuple[int, int]:
    """The range of the sorted array ``order`` (packed) that shares the first ``letters`` with ``own``."""
    unit = 1 << (8 * (8 - letters))
    low = own // unit * unit
    return int(np.searchsorted(order, np.uint64(low), "left")), int(np.searchsorted(order, np.uint64(low + unit - 1), "right"))


def steps(h: Hashes, tree: int, strings: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(queries, strings) the step of the ascent at which each of a prefix's sorted strings is met.

    ``own`` is the length of the prefix where it is the query's own, and 0 where it is a variation. Strings that share
    more letters than that are met first, the longest common prefix at step 0; then costs count.
    """
    costs = h.costs(q, tree)
    total = np.zeros((len(q), len(strings)), np.float32)
    for n in range(h.letters):
        total += costs[:, n, :][:, strings[:, n]]
    out = (h.letters + np.minimum(total * FINE, STEPS - 1)).astype(np.int16)
    mine = np.flatnonzero(own > 0)
    if len(mine):
        order, names = packed(strings), packed(costs[mine].argmin(axis=2).astype(np.uint8)).tolist()
        for i, name in zip(mine.tolist(), names, strict=True):
            for n in range(int(own[i]) + 1, h.letters + 1):
                low, high = common_prefix(order, name, n)
                if low == high:
                    break
                out[i, low:high] = h.letters - n
    return out


def cheapest(at: np.ndarray) -> np.ndarray:
    """(queries, some) places of a prefix's first strings by step, one in 32 but two at least; compared in any case."""
    few = max(2, at.shape[1] // 32)
    return np.argpartition(at, few - 1, axis=1)[:, :few] if few < at.shape[1] else np.tile(np.arange(at.shape[1]), (len(at), 1))


def _usable(column: str) -> Column:
    v = F.col(column)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size) if len(column) else np.zeros((0, size))


def _bytes(column: pa.Array, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _hashed(nodes: DataFrame, size: int, longest: float) -> DataFrame:
    """(node, strings, code, scale) of nodes (node, v)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1), size) / longest
                x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1).astype(np.float32)
                code, scale = coded(x)
                strings = hashes(size + 1).strings(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in strings]), pa.array([c.tobytes() for c in code]), pa.array(scale)], names=["node", "strings", "code", "scale"])

    return nodes.select("node", "v").mapInArrow(work, "node long, strings binary, code binary, scale float")


def _messages(asked: DataFrame, size: int, prefix: int, probes: int) -> DataFrame:
    """(tree, key, own, node, code, scale, stop, bound): each query (node, v, stop, bound) to its prefixes in each tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes(size + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                q = _directions(part.column(1), size)
                code, scale = coded(q)
                rows: list[tuple] = []
                for tree in range(h.trees):
                    costs = h.costs(q, tree, slice(0, prefix))
                    for i in range(len(q)):
                        for k, s in enumerate(best_prefixes(costs[i], probes)[0]):
                            rows.append((tree, s.tobytes(), prefix if k == 0 else 0, i))
                tree, key, own, i = zip(*rows, strict=True)
                i = np.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree, pa.int32()), pa.array(key, pa.binary()), pa.array(own, pa.int32()), part.column(0).take(pa.array(i)), pa.array([code[j].tobytes() for j in i]), pa.array(scale[i]), part.column(2).take(pa.array(i)), part.column(3).take(pa.array(i))],
                    names=["tree", "key", "own", "node", "code", "scale", "stop", "bound"],
                )

    return asked.select("node", "v", "stop", "bound").mapInArrow(work, "tree int, key binary, own int, node long, code binary, scale float, stop int, bound float")


def _directions(column: pa.Array, size: int) -> np.ndarray:
    x = _matrix(column, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)


def _grown(messages: DataFrame, heavy: DataFrame, size: int, probes: int) -> DataFrame:
    """The messages, those to a heavy prefix to its likeliest longer ones instead."""
    met = messages.join(heavy.select("tree", "key", F.lit(True).alias("grows")), ["tree", "key"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes(size + 1)
        for batch in batches:
            q = _bytes(batch.column(4), np.int8).astype(np.float32)
            rows = []
            for i, (tree, key, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True)):
                costs = h.costs(q[i : i + 1], tree, slice(len(key), len(key) + 1))[0]
                for k, s in enumerate(best_prefixes(costs, probes)[0]):
                    rows.append((key + s.tobytes(), len(key) + 1 if own and k == 0 else 0, i))
            if rows:
                key, own, i = zip(*rows, strict=True)
                rest = [batch.column(c).take(pa.array(i)) for c in (0, 3, 4, 5, 6, 7)]
                yield pa.RecordBatch.from_arrays([rest[0], pa.array(key, pa.binary()), pa.array(own, pa.int32()), *rest[1:]], names=names)

    names = ["tree", "key", "own", "node", "code", "scale", "stop", "bound"]
    longer = met.where("grows").select(*names).mapInArrow(work, "tree int, key binary, own int, node long, code binary, scale float, stop int, bound float")
    return met.where("grows is null").select(*names).unionByName(longer)


class Forest:
    """The dealt rows: which prefix each row of each tree lies under, and how many parts a prefix has."""

    def __init__(self, hashed: DataFrame, size: int, rows: int, cell_rows: int = CELL_ROWS):
        self.size, self.hashes = size, Hashes(size + 1, 1, 1)
        # prefixes of about cell_rows / 4 rows where rows lie evenly
        self.prefix = max(1, min(LETTERS, int(math.log(max(rows / (cell_rows / 4), 1), self.hashes.radix))))
        own = F.substring("strings", F.col("tree") * LETTERS + 1, F.lit(LETTERS))
        entries = hashed.select("*", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        self.entries = entries.select("tree", F.substring(own, F.lit(1), F.lit(self.prefix)).alias("key"), "node", own.alias("string"), "code", "scale")
        self.heavy: list[DataFrame] = []
        for n in range(self.prefix, LETTERS + 1):
            sizes = cut(self.entries.groupBy("tree", "key").count().where(F.col("count") > cell_rows).where(F.length("key") == n))
            if sizes.isEmpty():
                break
            if n < LETTERS:
                self.heavy.append(sizes)
                met = self.entries.join(sizes.select("tree", "key", F.lit(True).alias("grows")), ["tree", "key"], "left")
                self.entries = met.select("tree", F.when(F.col("grows"), F.substring("string", 1, n + 1)).otherwise(F.col("key")).alias("key"), "node", "string", "code", "scale")
        else:
            self.heavy.append(sizes.withColumn("parts", F.ceil(F.col("count") / cell_rows).cast("int")))

    def probes(self, rows: int, wanted: int) -> int:
        """Prefixes that a query enters in each tree, so that they hold PROBED times what is wanted where rows lie evenly."""
        whole = self.hashes.radix**self.prefix
        return whole if wanted >= rows else min(whole, math.ceil(PROBED * wanted * whole / (TREES * rows)))

    def visits(self, asked: DataFrame, probes: int) -> DataFrame:
        """Rows (gid, tree, tag, ...) in which each prefix's strings (tag 0), sorted, come before its queries (tag 1)."""
        messages = _messages(asked, self.size, self.prefix, probes)
        entries = self.entries
        parts = None
        for sizes in self.heavy:
            if "parts" in sizes.columns:
                parts = sizes.select("tree", "key", "parts")
            else:
                messages = _grown(messages, sizes, self.size, probes)
        if parts is None:
            entries, messages = entries.withColumn("part", F.lit(0)), messages.withColumn("part", F.lit(0))
        else:  # strings that can't grow: parts by a hash of the row, and queries go to each
            n = F.coalesce("parts", F.lit(1))
            entries = entries.join(parts, ["tree", "key"], "left").withColumn("part", F.pmod(F.xxhash64("node"), n).cast("int"))
            messages = messages.join(parts, ["tree", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
        gid = F.xxhash64("tree", "key", "part")
        left = entries.select(gid.alias("gid"), "tree", F.lit(0).alias("tag"), "node", "string", "code", "scale", F.lit(0).alias("own"), F.lit(0).alias("stop"), F.lit(0.0).cast("float").alias("bound"))
        right = messages.select(gid.alias("gid"), "tree", F.lit(1).alias("tag"), "node", F.col("key").alias("string"), "code", "scale", "own", "stop", "bound")
        n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return left.unionByName(right).repartition(n, "gid").sortWithinPartitions("gid", "tag", "string", "node")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(tree, strings, codes, nodes, queries' batch) of sorted visits: a prefix's rows with some of its queries."""
    gid, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        edges = np.r_[0, np.flatnonzero((np.diff(ids) != 0) | (np.diff(tags) != 0)) + 1, len(ids)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if ids[a] != gid:
                gid, rows = ids[a], []
            if tags[a] == 0:
                part = batch.slice(a, b - a)
                rows.append((_bytes(part.column(4)), _bytes(part.column(5), np.int8), np.asarray(part.column(6)), np.asarray(part.column(3))))
            elif rows:
                if len(rows) > 1:
                    rows = [tuple(np.concatenate(c) for c in zip(*rows, strict=True))]
                most = max(1, 2_000_000 // len(rows[0][0]))
                for at in range(a, b, most):
                    yield int(batch.column(1)[a].as_py()), *rows[0], batch.slice(at, min(most, b - at))


def _products(codes: np.ndarray, scale: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of queries i and rows j by their codes."""
    out = np.zeros(len(i), np.float32)
    for at in range(0, len(i), 65_536):
        a, b = i[at : at + 65_536], j[at : at + 65_536]
        out[at : at + 65_536] = np.einsum("ij,ij->i", q[a], codes[b].astype(np.float32)) * scale[b]
    return out


def _held(visits: DataFrame, size: int) -> DataFrame:
    """(node, held, tops) for each query and prefix: its strings by step, and its two best products among the cheapest ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes(size + 1)
        levels = h.letters + STEPS
        for tree, strings, codes, scale, _, asked in _cells(batches):
            q = _bytes(asked.column(5), np.int8).astype(np.float32) * np.asarray(asked.column(6))[:, None]
            at = steps(h, tree, strings, q, np.asarray(asked.column(7)))
            counts = np.bincount((at + levels * np.arange(len(q))[:, None]).ravel(), minlength=levels * len(q)).reshape(len(q), levels)
            cheap = cheapest(at)
            found = _products(codes, scale, q, np.repeat(np.arange(len(q)), cheap.shape[1]), cheap.ravel()).reshape(cheap.shape)
            tops = -np.sort(-found, axis=1)[:, :2]
            yield pa.RecordBatch.from_arrays([asked.column(3), pa.array(list(counts), pa.list_(pa.int64())), pa.array(list(tops), pa.list_(pa.float32()))], names=["node", "held", "tops"])

    return visits.mapInArrow(work, "node long, held array<long>, tops array<float>")


def _found(visits: DataFrame, size: int, shortlist: int = SHORTLIST) -> DataFrame:
    """(q, node, near) for each query and prefix: the best by code of its cheapest strings and those up to the query's stop."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashes(size + 1)
        for tree, strings, codes, scale, nodes, asked in _cells(batches):
            q = _bytes(asked.column(5), np.int8).astype(np.float32) * np.asarray(asked.column(6))[:, None]
            at = steps(h, tree, strings, q, np.asarray(asked.column(7)))
            met = at <= np.asarray(asked.column(8))[:, None]
            np.put_along_axis(met, cheapest(at), True, axis=1)
            i, j = np.nonzero(met)
            near = _products(codes, scale, q, i, j)
            good = near >= np.asarray(asked.column(9))[i] - MARGIN
            i, j, near = i[good], j[good], near[good]
            order = np.lexsort((-near, i))
            i, j, near = i[order], j[order], near[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            keep = place < shortlist  # what is further down in one prefix is further down among all
            if keep.any():
                yield pa.RecordBatch.from_arrays([asked.column(3).take(pa.array(i[keep])), pa.array(nodes[j[keep]]), pa.array(near[keep])], names=["q", "node", "near"])

    return visits.mapInArrow(work, "q long, node long, near float")


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query row's ``k`` nearest found among all other rows.

    Nearness is the inner product in double precision; ties go to the smaller id, null ids last. Vectors that are null,
    empty, zero or hold null or non-finite components take no part. Vectors of another length than the most common one
    are compared with none. Rows of one id are rows of their own; a table of one row gives nothing, and one of at most
    ``k`` others gives all of them. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(_usable("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes[0][0]
    # -0.0 is 0.0, so that equal vectors have equal hashes
    rows = cut(rows.where(F.size("v") == size).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("uid", F.monotonically_increasing_id()))

    # equal vectors are one node, named by its first row; a node's first k + 1 rows are all that a query can want of it
    named = rows.select("id", "uid", "q", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"))
    first = F.row_number().over(W.partitionBy("h1", "h2").orderBy(F.col("id").isNull(), "id", "uid"))
    some = cut(named.drop("q").withColumn("r", first).where(F.col("r") <= k + 1))
    heads = some.where("r = 1").select("h1", "h2", F.col("uid").alias("node"))
    members = some.join(heads, ["h1", "h2"]).select("node", "id", "uid")
    queries = cut(named.where("q").join(heads, ["h1", "h2"]).select("node", F.col("id").alias("query_id"), F.col("uid").alias("query_row")))
    nodes = cut(rows.join(heads.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "v"))

    high = F.array_max(F.transform("v", F.abs))
    count, longest = nodes.agg(F.count("*"), F.max(high * V.norm(F.transform("v", lambda x: x / high)))).first()
    hashed = cut(_hashed(nodes, size, longest))
    forest = Forest(hashed, size, count, cell_rows)
    asked = nodes.join(queries.select("node").distinct(), "node", "left_semi")
    wanted = candidates_wanted(count, k)

    # where each query's ascent stops; queries whose prefixes hold too few enter more of them
    probes, whole = forest.probes(count, wanted), forest.hashes.radix**forest.prefix
    pending, found = asked, None
    while True:
        visits = forest.visits(pending.withColumns({"stop": F.lit(0), "bound": F.lit(0.0).cast("float")}), probes)
        held = _held(visits, size).groupBy("node").agg(F.array(*[F.sum(F.col("held")[i]) for i in range(LETTERS + STEPS)]).alias("held"), F.flatten(F.collect_list("tops")).alias("tops"))
        step = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.when(acc["sum"] >= wanted, acc["stop"]).otherwise(acc["stop"] + 1).alias("stop"))
        ascent = F.aggregate("held", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("stop")), step)
        bound = F.try_element_at(F.sort_array(F.array_distinct("tops"), asc=False), F.lit(k + 2))
        stops = cut(held.select("node", ascent["sum"].alias("sum"), ascent["stop"].alias("stop"), F.coalesce(bound, F.lit(-4.0)).cast("float").alias("bound")))
        ready = stops if probes >= whole else stops.where(F.col("sum") >= wanted)
        met = _found(forest.visits(pending.join(ready, "node").select("node", "v", "stop", "bound"), probes), size)
        found = met if found is None else found.unionByName(met)
        if probes >= whole:
            break
        pending = cut(pending.join(ready, "node", "left_anti"))
        if pending.isEmpty():
            break
        probes = min(whole, 4 * probes)

    listed = found.groupBy("q", "node").agg(F.max("near").alias("near")).withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("near"), "node"))).where(F.col("r") <= SHORTLIST)
    exact = listed.select("q", "node").join(nodes, "node").join(asked.select(F.col("node").alias("q"), F.col("v").alias("asked")), "q").select("q", "node", V.dot(F.col("asked"), F.col("v")).alias("score"))
    each = W.partitionBy("q").orderBy(F.desc("score"), F.col("id").isNull(), "id", "uid")
    best = exact.join(members, "node").withColumn("r", F.row_number().over(each)).where(F.col("r") <= k + 1)
    answers = queries.join(best.select(F.col("q").alias("node"), "id", "uid", "score"), "node").where(F.col("query_row") != F.col("uid"))
    order = W.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").isNull(), "id", "uid")
    ranked = answers.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
