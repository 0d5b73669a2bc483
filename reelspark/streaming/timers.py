"""Folds over streams of frames whose results are put out once, when they are final: state in order of event time, timers.

Frames of a video wait in its state until the watermark has passed them; then they are taken in the order of time, so the
result is the batch result whatever order they arrived in. A frame that is later than the watermark is left out, as
Spark does with late rows; frames with a null time, index or distance are left out too. A video's state is its waiting frames, bounded by the watermark's
delay, and one last frame; it outlives a restart with the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import kernels as K

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """A fold of (at in microseconds, frame_index, ...) by event time; subclasses say what a frame and the watermark do."""

    #: Columns of a waiting frame after at and frame_index, and those of the last frame's state.
    columns: list[str]
    waiting: str
    kept: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"at long, frame_index long, {self.waiting}")
        self.last = handle.getValueState("last", self.kept)

    def take(self, last: tuple | None, frame: tuple) -> tuple[tuple | None, list[tuple]]:
        """The last frame's state after ``frame``, and what is put out by then."""
        raise NotImplementedError

    def passed(self, last: tuple | None, watermark: int) -> tuple[tuple | None, list[tuple]]:
        """The same once the watermark (microseconds) has passed all that was taken."""
        return last, []

    def due(self, last: tuple) -> int | None:
        """When the last frame's state is to be looked at again though no frame comes, in microseconds."""
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed, latest = timerValues.getCurrentWatermarkInMs() * 1000, None
        for pdf in rows:
            whole = pdf["at"].to_numpy() > passed
            for c in ("frame_index", *self.columns):
                whole &= pdf[c].notna().to_numpy()
            if whole.any():
                # a null among a batch's numbers has made pandas read them as floats
                at, index = (pdf[c].to_numpy()[whole].astype(np.int64) for c in ("at", "frame_index"))
                self.pending.appendList(list(zip(at.tolist(), index.tolist(), *(pdf[c].to_numpy()[whole].tolist() for c in self.columns), strict=True)))
                latest = max(int(at.max()), latest or 0)
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        frames = sorted(map(tuple, self.pending.get()), key=lambda f: f[:2])
        due = [f for f in frames if f[0] <= passed]
        if due:
            self.pending.clear()
            if len(due) < len(frames):
                self.pending.put(frames[len(due) :])
        # the state is asked for and told once a timer, not once a frame: each is a message to the JVM
        before = self.last.get()
        before = now = None if before is None else tuple(before)
        out = []
        for f in due:
            now, rows = self.take(now, f)
            out += rows
        now, rows = self.passed(now, passed)
        out += rows
        if now is None and before is not None:
            self.last.clear()
        elif now is not None and now != before:
            self.last.update(now)
            if (at := self.due(now)) is not None:
                self.handle.registerTimer(-(-at // 1000))
        if out:
            yield self.rows(key, out)

    def rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def _named(self, key: tuple, out: list[tuple], value: str) -> pd.DataFrame:
        at, index, values = zip(*out, strict=True)
        return pd.DataFrame({"video": [key[0]] * len(out), "at": at, "frame_index": index, value: values})

    def close(self) -> None:
        pass


class Spaced(InOrder):
    """A place's best frame, once no frame can come that is nearer to it than the gap."""

    columns, waiting, kept = ["distance"], "distance double", "at long, frame_index long, distance double"

    def __init__(self, gap: int):
        self.gap = gap

    def take(self, last: tuple | None, frame: tuple) -> tuple[tuple | None, list[tuple]]:
        if last is None or frame[0] - last[0] >= self.gap:
            return frame, [] if last is None else [last]
        return frame if frame[2] < last[2] else last, []

    def passed(self, last: tuple | None, watermark: int) -> tuple[tuple | None, list[tuple]]:
        return (None, [last]) if last is not None and last[0] + self.gap <= watermark else (last, [])

    def due(self, last: tuple) -> int | None:
        return last[0] + self.gap

    def rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return self._named(key, out, "distance")


class Unlike(InOrder):
    """Frames less alike than a threshold to the last kept one; the state is what that frame is compared by."""

    columns, waiting, kept = ["look"], "look binary", "look binary"

    def __init__(self, threshold: float, method: str):
        self.threshold, self.method = threshold, method

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.like = K.Likeness(self.method)
        self.seen: dict[bytes, tuple] = {}

    def take(self, last: tuple | None, frame: tuple) -> tuple[tuple | None, list[tuple]]:
        now, kept = bytes(frame[2]), last
        last = None if last is None else bytes(last[0])
        self.seen = {k: self.seen[k] if k in self.seen else self.like.read(k) for k in (now, last) if k is not None}
        d = 0.0 if last is None else 1 - self.like(self.seen[last], self.seen[now])
        if last is not None and not d > 1 - self.threshold:
            return kept, []
        return (now,), [(frame[0], frame[1], d)]

    def rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return self._named(key, out, "diff_score")


def _with_state(frames: DataFrame, delay: str, processor: InOrder, schema: str) -> DataFrame:
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # keys as text: a null among numbers makes pandas read all keys of a batch as floats
    timed = frames.withWatermark("time", delay).withColumn("at", F.unix_micros("time")).withColumn("video", F.coalesce(F.col("video_id").cast("string"), F.lit("")))
    found = timed.where(F.col("at").isNotNull()).drop("video_id").groupBy("video").transformWithStateInPandas(processor, f"video string, {schema}", "Append", "EventTime")
    rest = [c for c in found.columns if c not in ("video", "at")]
    return found.select(F.col("video").try_cast("bigint").alias("video_id"), F.timestamp_micros("at").alias("at"), *rest)


def spaced(frames: DataFrame, gap: float, delay: str = "10 seconds", at: str = "at") -> DataFrame:
    """A stream of (video_id, frame_index, ``at`` timestamp, distance) to its frames at least ``gap`` seconds apart, as temporal_spacing.

    Rows (video_id, at, frame_index, distance): a frame that comes too close replaces the last one if its distance is
    smaller. Each place is put out once: when a frame of the next place was taken, or when the watermark has passed its end.
    """
    source = frames.select("video_id", "frame_index", F.col(at).cast("timestamp").alias("time"), F.col("distance").cast("double").alias("distance"))
    return _with_state(source, delay, Spaced(int(round(gap * 1e6))), "at long, frame_index long, distance double")


def keep_unlike(frames: DataFrame, threshold: float = 0.75, method: str = "histogram", delay: str = "10 seconds", at: str = "at", image: str = "image", blur: float = 0.0, dark: float = 0.0, skip: float = 0.0) -> DataFrame:
    """A stream of (video_id, frame_index, ts, ``at`` timestamp, image) without frames like the last kept one, as kernels.redundancy_filter.

    Rows (video_id, at, frame_index, diff_score), in the order of ``at``. Pixels go where they are read: what moves and waits is
    a frame's histogram for that method, its bytes for the others.
    """
    like = K.Likeness(method)

    def looks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            arrays = [K.to_array(i) for i in pdf[image]]
            keep = np.array([K._seen(x, t, blur, dark, skip) for x, t in zip(arrays, pdf["ts"], strict=True)], bool)
            # frames that aren't looked at still tell how far the time is
            yield pdf[["video_id", "frame_index", "time"]].assign(look=[like.write(x) if k else None for x, k in zip(arrays, keep, strict=True)])

    source = frames.select("video_id", "frame_index", "ts", F.col(at).cast("timestamp").alias("time"), image)
    seen = source.mapInPandas(looks, "video_id long, frame_index long, time timestamp, look binary")
    return _with_state(seen, delay, Unlike(threshold, method), "at long, frame_index long, diff_score double")
