"""Stateful streaming operators: the last kept frame of a video, the latest state of a job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S


def keep_changed(frames: DataFrame, difference: float) -> DataFrame:
    """A stream of (video_id, frame_index, at, value) without frames close to the last kept one of their video.

    The state of a video is one number. Frames are taken in the order of time within a batch; a frame that arrives after
    later ones of its video is compared with what is kept by then.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["at", "frame_index"])
        kept = []
        for row in rows.itertuples():
            if last is None or abs(row.value - last) >= difference:
                last = row.value
                kept.append((key[0], row.frame_index, row.value))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["video_id", "frame_index", "value"])

    return frames.groupBy("video_id").applyInPandasWithState(step, "video_id long, frame_index long, value double", "last double", "update", GroupStateTimeout.NoTimeout)


def spaced(frames: DataFrame, gap: float) -> DataFrame:
    """A stream of (video_id, frame_index, at in microseconds, distance) to frames at least ``gap`` seconds apart.

    Rows (video_id, place, version, frame_index): a frame that comes too close replaces the last one if its distance is
    smaller, and then takes its place with the next version; the highest version of a place counts.
    """
    us = int(round(gap * 1e6))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, distance, place, version = state.get if state.exists else (None, None, -1, 0)
        out = []
        for row in pd.concat(list(parts)).sort_values(["at", "frame_index"]).itertuples():
            if at is None or row.at - at >= us:
                place, version = place + 1, 0
            elif row.distance < distance:
                version += 1
            else:
                continue
            at, distance = int(row.at), float(row.distance)
            out.append((key[0], place, version, row.frame_index))
        if at is not None:
            state.update((at, distance, place, version))
        yield pd.DataFrame(out, columns=["video_id", "place", "version", "frame_index"])

    return frames.groupBy("video_id").applyInPandasWithState(step, "video_id long, place long, version long, frame_index long", "at long, distance double, place long, version long", "update", GroupStateTimeout.NoTimeout)


def latest(transitions: DataFrame) -> DataFrame:
    """One row per job of what its transitions in a batch add to its state; partial results merge by max, min and sum."""
    ok = F.col("status") != "failed"
    return transitions.groupBy("job_id").agg(
        F.max(F.struct("at", "seq", "status")).alias("last"), F.max(F.when(ok, F.struct("at", "seq", S.progress(F.col("status")).alias("progress")))).alias("ok"), F.count("*").alias("steps"),
        F.max(F.when(~ok, F.struct("at", "seq", "message"))).alias("failure"), F.min(F.when(F.col("status") == "extracting_frames", F.col("at"))).alias("started_at"), F.max(F.when(F.col("status") == "completed", F.col("at"))).alias("completed_at"),
    )
