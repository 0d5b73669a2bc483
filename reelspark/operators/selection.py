"""Constrained selection of frames.

The first stage asks each cluster's best frame in turn, the second fills free slots by score; both need the times of all
frames taken so far, so they are one ordered pass per video over narrow rows (no features, no pixels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from . import scoring

COLUMNS = "video_id long, frame_index long, ts double, cluster_id int, score double, stage int"


def cluster_best(df: DataFrame) -> DataFrame:
    """Each cluster's highest frame by score, then index."""
    rank = F.row_number().over(W.partitionBy("video_id", "cluster_id").orderBy(F.desc("score"), "frame_index"))
    return df.withColumn("r", rank).where("r = 1").drop("r")


def first_stage_candidates(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Cluster bests that aren't ruled out by low entropy or a low score."""
    return cluster_best(df).where(~(F.col("is_low_entropy") & (F.col("entropy") < 2.5)) & (F.col("score") >= settings.low_score))


class _Chosen:
    """What one video's pass keeps: the frames taken so far, at most its slots."""

    def __init__(self, slots: int, settings: Settings):
        self.slots, self.settings = slots, settings
        self.times: list[float] = []
        self.indexes: set[int] = set()
        self.per: dict[int, int] = {}

    def take(self, phase: int, index: int, ts: float, cluster: int) -> bool:
        gap = self.settings.first_gap if phase == 1 else self.settings.second_gap
        if phase == 2 and (len(self.times) >= self.slots or index in self.indexes or self.per.get(cluster, 0) >= self.settings.max_per_cluster):
            return False
        if any(abs(ts - t) < gap for t in self.times):
            return False
        self.times.append(ts)
        self.indexes.add(index)
        self.per[cluster] = self.per.get(cluster, 0) + 1
        return True


def select(df: DataFrame, settings: Settings = DEFAULT, target: int | None = None) -> DataFrame:
    """(video_id, frame_index, ts, cluster_id, score, stage), possibly no rows for a video.

    Stage 1: cluster bests in the order of clusters, at least ``first_gap`` from all taken. Stage 2: up to ``target`` in
    all (``max_per_cluster`` times the number of clusters if None), by score, at least ``second_gap`` apart, at most
    ``max_per_cluster``. Spark sorts a video's frames for both stages; one pass takes from them and holds what it took.
    """
    narrow = df.select("video_id", "frame_index", "ts", F.col("cluster_id").cast("int").alias("cluster_id"), "score", "is_low_entropy", "entropy")
    best = F.row_number().over(W.partitionBy("video_id", "cluster_id").orderBy(F.desc("score"), "frame_index"))
    ranked = narrow.withColumn("r", best)
    slots = F.lit(target).cast("long") if target is not None else settings.max_per_cluster * F.count_if(F.col("r") == 1).over(W.partitionBy("video_id"))
    able = ranked.withColumn("slots", slots).where(F.col("score") >= settings.low_score)
    columns = ["video_id", "frame_index", "ts", "cluster_id", "score", "slots"]
    stage = lambda n, key: F.struct(F.lit(n).alias("phase"), key.alias("key"))
    asks_first = (F.col("r") == 1) & ~(F.col("is_low_entropy") & (F.col("entropy") < 2.5))
    stages = F.array_compact(F.array(F.when(asks_first, stage(1, F.col("cluster_id").cast("double"))), stage(2, -F.col("score").cast("double"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = None, None
        for batch in batches:
            taken: list[tuple] = []
            for phase, _, v, index, ts, cluster, score, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or v != video:
                    video, state = v, _Chosen(n, settings)
                if state.take(phase, index, ts, cluster):
                    taken.append((v, index, ts, cluster, score, phase))
            if taken:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*taken, strict=True), kinds, strict=True)], names=["video_id", "frame_index", "ts", "cluster_id", "score", "stage"])

    dealt = able.select(F.inline(stages), *columns).repartition("video_id").sortWithinPartitions("video_id", "phase", "key", "frame_index")
    return dealt.mapInArrow(run, COLUMNS)


def select_up_to_three(scored: DataFrame, settings: Settings = DEFAULT, target: int | None = None) -> DataFrame:
    """select with at most three frames a cluster, of the frames without a rejection_reason, or of all if a video has none."""
    able = scoring.prefilter(scored, F.lit(1))
    return select(able, replace(settings, max_per_cluster=3), target)


def not_selected(df: DataFrame, selected: DataFrame) -> DataFrame:
    return df.join(selected.select("video_id", "frame_index"), ["video_id", "frame_index"], "left_anti")


def distance_to_selected(df: DataFrame, selected: DataFrame, distance) -> DataFrame:
    """(video_id, frame_index, novelty): each frame's least distance to a selected frame of its own video.

    ``selected`` has features too; a video's selected frames are few, and meet its frames by an equi-join on the video.
    """
    s = selected.select("video_id", F.col("features").alias("other"))
    met = df.join(s, "video_id")
    return met.groupBy("video_id", "frame_index").agg(F.min(distance(F.col("features"), F.col("other"))).alias("novelty"))
