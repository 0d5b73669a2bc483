"""Connected components by alternating large-star and small-star steps; edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node u to the smaller v."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


#: A round's edges are read by a task for each so many of them.
TASK_EDGES = 200_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v): root is the smallest node that it is connected with.

    Self edges give no rows unless the node has others. Every round's edges are kept in the checkpoint folder; the last
    ones are stars: each node has one edge, to a root that has none of its own.
    """
    now, before = cut(_down(edges)), None
    for _ in range(rounds):
        # a round that changes nothing is the last: then all edges are stars already
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = now.coalesce(max(1, -(-state[0] // TASK_EDGES)))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("m") != F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(_down(small.unionByName(lowest.withColumnRenamed("m", "v"))))
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
