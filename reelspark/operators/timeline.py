"""Ordered operators: steps, scenes, coverage, novelty and the folds that carry state along a video.

Inputs have video_id, frame_index and ts; a window never spans videos, so a corpus is as parallel as it has videos.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import DEFAULT
from ..functions import scalars as S
from ..functions import vectors as V


def in_order() -> WindowSpec:
    """A video's frames in time."""
    return W.partitionBy("video_id").orderBy("ts", "frame_index")


def in_video() -> WindowSpec:
    return W.partitionBy("video_id")


def with_position(df: DataFrame) -> DataFrame:
    """``pos``: the frame's place in its video, from 0."""
    return df.withColumn("pos", F.row_number().over(in_order()).cast("bigint") - 1)


def stride(df: DataFrame, every: int) -> DataFrame:
    """Every n-th frame of each video, the first included."""
    return with_position(df).where(F.col("pos") % every == 0)


def batches(df: DataFrame, size: int) -> DataFrame:
    """``batch``: consecutive groups of at most ``size`` frames."""
    return with_position(df).withColumn("batch", F.floor(F.col("pos") / size))


def by_index(df: DataFrame, wanted: DataFrame, column: str = "frame_index") -> DataFrame:
    """Frames whose index is among the wanted ones, each once; missing ones are skipped."""
    return df.join(wanted.select(F.col(column).alias("frame_index")).distinct(), "frame_index", "left_semi")


def at_time(df: DataFrame, asked: DataFrame, fps: float) -> DataFrame:
    """The frame at floor(ts * fps) for each request (video_id, asked_ts); the result keeps the time asked for."""
    want = asked.withColumn("pos", F.floor(F.col("asked_ts") * fps).cast("bigint"))
    return with_position(df).drop("ts").join(want, ["video_id", "pos"]).withColumnRenamed("asked_ts", "ts")


def quality_gate(df: DataFrame, brightness: str, sharpness: str, settings=DEFAULT) -> DataFrame:
    """Without the intro, dark and blurred frames."""
    return df.where((F.col("ts") >= settings.skip_intro) & (F.col(brightness) >= settings.dark) & (F.col(sharpness) >= settings.blur))


# --- folds ----------------------------------------------------------------------------------------------------------
#
# A fold's state goes from frame to frame, so it is one pass over a video's frames in order. Spark sorts them; the pass
# reads batches and holds its state only, however many frames a video has.


class Fold:
    """What one video's pass keeps. ``step`` takes a frame and returns what is certain by now, ``end`` the rest."""

    def step(self, frame: tuple) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def fold(df: DataFrame, columns: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """One ``make()`` per video over (ts, frame_index, *columns) in order; rows of video_id and what the fold returns."""
    names = schema_names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for v, *frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or v != video:
                    out += [(video, *r) for r in state.end()] if state else []
                    video, state = v, make()
                out += [(v, *r) for r in state.step(tuple(frame))]
            if out:
                yield rows(out)
        if state is not None and (out := [(video, *r) for r in state.end()]):
            yield rows(out)

    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], names=names)

    dealt = df.select("video_id", "ts", "frame_index", *columns).repartition("video_id").sortWithinPartitions("video_id", "ts", "frame_index")
    return dealt.mapInArrow(run, schema)


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


class _LastKept(Fold):
    def __init__(self, keep: Callable[[float, float], bool]):
        self.keep, self.last = keep, None

    def step(self, frame: tuple) -> list[tuple]:
        if self.last is not None and not self.keep(self.last, frame[2]):
            return []
        self.last = frame[2]
        return [frame]


def fold_kept(df: DataFrame, value: str, keep: Callable[[float, float], bool]) -> DataFrame:
    """Keeps a video's first frame and then each one for which ``keep(last kept value, its value)`` holds; no null values."""
    found = df.select("video_id", "ts", "frame_index", F.col(value).cast("double").alias("value"))
    return fold(found, ["value"], lambda: _LastKept(keep), "video_id long, ts double, frame_index long, value double")


def redundancy_keep(df: DataFrame, value: str, difference: float) -> DataFrame:
    """Frames whose value differs from the last kept one by at least ``difference``."""
    return fold_kept(df, value, lambda last, now: abs(now - last) >= difference)


def walk_thresholds(count: Callable[[float], int], start: float, step: float, low: float, high: float, least: int, most: int, rounds: int = 10) -> tuple[float, int]:
    """(threshold, count): too small a count moves the threshold by -step, too large a one by step, within [low, high].

    The last round's result counts even if it is out of range.
    """
    now = start
    for _ in range(rounds):
        used, n = now, count(now)
        if least <= n <= most:
            break
        now = max(low, min(high, now + (-step if n < least else step)))
    return used, n


def reachable(start: float, step: float, low: float, high: float, rounds: int = 10) -> list[float]:
    """Every threshold that the walk may come to."""
    seen, edge = {start}, {start}
    for _ in range(rounds - 1):
        edge = {max(low, min(high, t + d)) for t in edge for d in (-step, step)} - seen
        seen |= edge
    return sorted(seen)


class _Counts(Fold):
    """The frames that each threshold keeps, all in one pass."""

    def __init__(self, thresholds: list[float], walk: Callable[[Callable[[float], int]], tuple[float, int]]):
        self.thresholds, self.walk = thresholds, walk
        self.at = np.array(thresholds)
        self.last, self.n = np.full(len(thresholds), np.nan), np.zeros(len(thresholds), np.int64)

    def step(self, frame: tuple) -> list[tuple]:
        kept = ~(np.abs(frame[2] - self.last) < self.at)
        self.last[kept] = frame[2]
        self.n += kept
        return []

    def end(self) -> list[tuple]:
        by = dict(zip(self.thresholds, self.n.tolist(), strict=True))
        difference, n = self.walk(by.__getitem__)
        return [(round(difference, 6), n)]


def adaptive_threshold(df: DataFrame, value: str, start: float, step: float, low: float, high: float, least: int, most: int, rounds: int = 10) -> DataFrame:
    """(video_id, difference, kept): per video a difference for redundancy_keep that keeps between ``least`` and ``most`` frames."""
    thresholds = reachable(start, step, low, high, rounds)
    found = df.select("video_id", "ts", "frame_index", F.col(value).cast("double").alias("value"))
    walk = lambda count: walk_thresholds(count, start, step, low, high, least, most, rounds)
    return fold(found, ["value"], lambda: _Counts(thresholds, walk), "video_id long, difference double, kept long")


class _Spaced(Fold):
    """The last taken frame waits, as a closer one may replace it."""

    def __init__(self, gap: float):
        self.gap, self.last = gap, None

    def step(self, frame: tuple) -> list[tuple]:
        if self.last is None or frame[0] - self.last[0] >= self.gap:
            done, self.last = self.last, frame
            return [done] if done else []
        if frame[2] < self.last[2]:
            self.last = frame
        return []

    def end(self) -> list[tuple]:
        return [self.last]


def temporal_spacing(df: DataFrame, distance: str, gap: float) -> DataFrame:
    """Frames at least ``gap`` apart; a frame too close replaces the last one if its distance is strictly smaller."""
    found = df.select("video_id", "ts", "frame_index", F.col(distance).cast("double").alias("distance"))
    return fold(found, ["distance"], lambda: _Spaced(gap), "video_id long, ts double, frame_index long, distance double") if gap > 0 else found


class _SpacedCuts(Fold):
    def __init__(self, gap: float):
        self.gap, self.last = gap, None

    def step(self, frame: tuple) -> list[tuple]:
        ts, index, cut = frame
        if self.last is None:
            self.last = ts
        if not cut or ts - self.last < self.gap:
            return []
        self.last = ts
        return [(ts, index)]


def spaced_cuts(df: DataFrame, is_cut: str, gap: float) -> DataFrame:
    """Cuts (rows where ``is_cut``) at least ``gap`` after the last taken one; the video's first frame counts as taken."""
    found = df.select("video_id", "ts", "frame_index", F.coalesce(is_cut, F.lit(False)).alias("cut"))
    return fold(found, ["cut"], lambda: _SpacedCuts(gap), "video_id long, ts double, frame_index long")


# --- scenes ---------------------------------------------------------------------------------------------------------


def steps(df: DataFrame, features: str = "features") -> DataFrame:
    """``pos`` and ``distance``: cosine distance to the previous frame, null for the first."""
    previous = F.lag(features).over(in_order())
    return with_position(df).withColumn("distance", F.when(previous.isNotNull(), V.cosine_distance(F.col(features), previous)))


def scene_cuts(df: DataFrame, features: str = "features", floor: float = DEFAULT.scene_floor) -> DataFrame:
    """``is_cut``: the step is larger than mean + 2 deviations of its video's steps (if more than five) and than ``floor``."""
    found = steps(df, features)
    spread = F.when(F.count("distance").over(in_video()) > 5, F.avg("distance").over(in_video()) + 2 * F.stddev_pop("distance").over(in_video()))
    found = found.withColumn("threshold", F.greatest(F.lit(floor), spread))
    return found.withColumn("is_cut", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)))


def scenes(df: DataFrame, features: str = "features") -> DataFrame:
    """(video_id, scene_id, start_frame, end_frame, start_time, end_time, duration); a scene ends where the next begins."""
    cut = scene_cuts(df, features).withColumn("scene_id", F.sum(F.col("is_cut").cast("bigint")).over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    last = cut.withColumns({"last_pos": F.max("pos").over(in_video()), "last_ts": F.max("ts").over(in_video())})
    first = last.groupBy("video_id", "scene_id").agg(F.min("pos").alias("start_frame"), F.min("ts").alias("start_time"), F.first("last_pos").alias("last_pos"), F.first("last_ts").alias("last_ts"))
    by_scene = W.partitionBy("video_id").orderBy("scene_id")
    return first.select(
        "video_id", "scene_id", "start_frame", F.coalesce(F.lead("start_frame").over(by_scene), F.col("last_pos")).alias("end_frame"), F.round("start_time", 4).alias("start_time"),
        F.round(F.coalesce(F.lead("start_time").over(by_scene), F.col("last_ts")), 4).alias("end_time"), F.round(F.coalesce(F.lead("start_time").over(by_scene), F.col("last_ts")) - F.col("start_time"), 4).alias("duration"),
    )


# --- time -----------------------------------------------------------------------------------------------------------

#: Seconds of a bin in which frames and intervals meet.
BIN_SECONDS = 5.0


def in_intervals(df: DataFrame, intervals: DataFrame, width: float = BIN_SECONDS, how: str = "left") -> DataFrame:
    """``df`` (video_id, ts, ...) with the columns of the ``intervals`` (video_id, start, end, ...) of its video that hold ts.

    An interval holds ts from start to before end; those that end last in their video hold their end too, as does none that
    is empty elsewhere. Intervals may overlap: a frame then has a row for each. ``how``: left keeps frames in none, with
    nulls; inner drops them. An interval goes to each bin of ``width`` seconds that it touches, a frame to its own, and
    they meet by video and bin, so neither a long video nor a long interval is one task's. Null or unordered bounds and null ts meet nothing.
    """
    if how not in ("left", "inner") or width <= 0:
        raise ValueError("how must be left or inner, width positive")
    bin_of = lambda c: F.floor(c / F.lit(width))
    bounded = intervals.where((F.col("start") <= F.col("end")) & F.col("video_id").isNotNull()).withColumn("_last", F.col("end") == F.max("end").over(in_video()))
    names = {c: f"_r_{c}" for c in bounded.columns}
    spread = bounded.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("_r_bin", F.explode(F.sequence(bin_of(F.col("_r_start")), bin_of(F.col("_r_end")))))
    ts = F.col("ts")
    held = (F.col("_r_start") <= ts) & ((ts < F.col("_r_end")) | (F.col("_r__last") & (ts == F.col("_r_end"))))
    met = df.withColumn("_bin", bin_of(ts)).join(spread, (F.col("video_id") == F.col("_r_video_id")) & (F.col("_bin") == F.col("_r_bin")) & held, how)
    return met.select(*df.columns, *[F.col(n).alias(c) for c, n in names.items() if c not in ("video_id", "_last")])



def neighbours(ts: Column, within: float) -> Column:
    """Other frames of the video strictly less than ``within`` seconds away: a range window, not a self-join."""
    us = F.round(ts * 1e6).cast("bigint")
    span = int(round(within * 1e6)) - 1
    return F.count("*").over(W.partitionBy("video_id").orderBy(us).rangeBetween(-span, span)) - 1


def temporal_novelty(df: DataFrame, within: float = 1.0, full: int = 10) -> DataFrame:
    return df.withColumn("neighbours", neighbours(F.col("ts"), within)).withColumn("visual_novelty", F.greatest(F.lit(0.0), 1 - F.col("neighbours") / full))


def segment_coverage(df: DataFrame, duration: Column | None = None) -> DataFrame:
    """``segment`` (thirds of the video) and ``temporal_coverage``, higher where a third holds fewer frames than its share."""
    length = F.max("ts").over(in_video()) if duration is None else duration
    found = df.withColumn("segment", S.segment_index(F.col("ts"), length)).withColumn("share", F.count("*").over(W.partitionBy("video_id", "segment")) / (F.count("*").over(in_video()) / 3.0))
    value = F.when(F.col("share") < 1, 1 + (1 - F.col("share")) * 0.5).otherwise(1 / F.col("share"))
    return found.withColumn("temporal_coverage", F.least(F.lit(1.0), 0.6 * value)).drop("share")


def motion(df: DataFrame, value: str) -> DataFrame:
    """``motion``: the mean change to the neighbours that exist."""
    before, after = F.abs(F.col(value) - F.lag(value).over(in_order())), F.abs(F.lead(value).over(in_order()) - F.col(value))
    total = F.coalesce(before, F.lit(0.0)) + F.coalesce(after, F.lit(0.0))
    return df.withColumn("motion", F.when(before.isNotNull() & after.isNotNull(), total / 2).otherwise(total))


def minmax(value: Column) -> Column:
    """Min-max scaled within the video; 0.5 where all are the same."""
    low, high = F.min(value).over(in_video()), F.max(value).over(in_video())
    return F.when(high - low > 1e-6, (value - low) / (high - low)).otherwise(F.lit(0.5))
