"""Streams whose results are final when they come, against their batch twins: disorder, late frames, restarts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import kernels as K
from reelspark.operators import timeline
from reelspark.streaming import timers

START = 1_700_000_000
SPACED = "video_id long, frame_index long, at timestamp, distance double"
IMAGES = "video_id long, frame_index long, ts double, at timestamp, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def _write(spark, rows, schema, folder, seconds=True):
    rows = [(r[0], r[1], *r[2:]) for r in rows]
    names = [part.strip().split()[0] for part in schema.split(", ") if part.strip()[0] not in "<:"]
    df = spark.createDataFrame(rows, schema.replace("at timestamp", "at double"))
    df.withColumn("at", F.timestamp_micros(F.round((F.col("at") + START) * 1e6).cast("long"))).coalesce(1).write.mode("append").parquet(folder)
    return names


def _run(spark, folder, schema, make, out, one_file=True):
    """All files of a folder, one a batch, in the order of their writing; what the sink gets."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 if one_file else 1000).parquet(f"{folder}/*")
    q = make(stream).writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return [tuple(r) for r in spark.read.parquet(f"{out}/rows").select(F.col("video_id"), (F.unix_micros("at") / 1e6 - START).alias("at"), "frame_index", F.col(spark.read.parquet(f"{out}/rows").columns[-1])).collect()]


def _batch_spacing(spark, rows, gap):
    df = spark.createDataFrame([(v, i, t, d) for v, i, t, d in rows], "video_id long, frame_index long, ts double, distance double")
    return sorted((r.video_id, r.frame_index) for r in timeline.temporal_spacing(df, "distance", gap).collect())


def test_spacing_of_disordered_frames_is_the_batch_result(spark, tmp_path):
    rng = random.Random(3)
    rows = [(v, i, round(i * 0.37 + rng.random() * 0.3, 3), rng.choice([0.1, 0.2, 0.2, 0.5])) for v in (1, 2, None) for i in range(40)]
    shuffled = sorted(rows, key=lambda r: r[2] + rng.random() * 4)  # up to four seconds of disorder
    for k in range(0, 120, 30):
        _write(spark, shuffled[k : k + 30], SPACED, f"{tmp_path}/in/{k:03d}")
    _write(spark, [(99, 0, 1000.0, 0.0)], SPACED, f"{tmp_path}/in/999")  # the watermark passes all
    _write(spark, [(1, None, 5.0, 0.0), (2, 7, 6.0, None), (None, None, 7.0, None)], SPACED, f"{tmp_path}/in/000")  # nulls among the first
    got = _run(spark, f"{tmp_path}/in", SPACED, lambda s: timers.spaced(s, 1.2, "5 seconds"), f"{tmp_path}/out")
    assert len(got) == len(set(got))
    assert sorted(((v, i) for v, _, i, _ in got if v != 99), key=str) == sorted([(v, i) for u in (1, 2) for v, i in _batch_spacing(spark, [r for r in rows if r[0] == u], 1.2)] + [(None, i) for _, i in _batch_spacing(spark, [(7, *r[1:]) for r in rows if r[0] is None], 1.2)], key=str)


def test_a_place_comes_once_when_it_is_final(spark, tmp_path):
    """Nothing comes before the watermark has passed a place's end, and then without a further frame of its video."""
    make = lambda s: timers.spaced(s, 2.0, "0 seconds")
    _write(spark, [(1, 0, 10.0, 0.5), (1, 1, 11.0, 0.3)], SPACED, f"{tmp_path}/in/0")
    assert _run(spark, f"{tmp_path}/in", SPACED, make, f"{tmp_path}/out") == []
    _write(spark, [(2, 0, 12.5, 0.5)], SPACED, f"{tmp_path}/in/1")  # 11.0 + 2 isn't passed
    assert _run(spark, f"{tmp_path}/in", SPACED, make, f"{tmp_path}/out") == []
    _write(spark, [(2, 1, 13.0, 0.1), (1, 2, 12.4, 0.0)], SPACED, f"{tmp_path}/in/2")  # and a late frame: left out
    assert _run(spark, f"{tmp_path}/in", SPACED, make, f"{tmp_path}/out") == [(1, 11.0, 1, 0.3)]
    _write(spark, [(1, 3, 60.0, 0.9), (9, 0, 100.0, 0.0)], SPACED, f"{tmp_path}/in/3")
    assert sorted(_run(spark, f"{tmp_path}/in", SPACED, make, f"{tmp_path}/out")) == [(1, 11.0, 1, 0.3), (1, 60.0, 3, 0.9), (2, 13.0, 1, 0.1)]


def _picture(v, seed):
    return np.clip(np.random.default_rng(seed).normal(v, 40, (12, 16, 3)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("method", ["histogram", "pixel", "combined"])
def test_unlike_frames_of_a_stream_are_those_of_the_batch(spark, tmp_path, method):
    rng = random.Random(5)
    rows = []
    for v in (1, 2):
        for i in range(24):
            x = _picture(40 + 45 * (i // 4 % 4), 10 * v + i // 3)
            rows.append((v, i, i / 2, i / 2 + v / 100, ("", 12, 16, 3, 16, bytearray(x.tobytes()))))
    rows.append((1, 24, 12.0, 12.01, ("", 12, 16, 3, 16, bytearray(12 * 16 * 3))))  # dark
    threshold = {"histogram": 0.75, "pixel": 0.8, "combined": 0.8}[method]
    batch = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in rows], "video_id long, frame_index long, ts double, " + IMAGES.split(", ", 4)[4])
    want = sorted((r.video_id, r.frame_index, round(r.diff_score, 9)) for r in K.redundancy_filter(batch, threshold, method, dark=25.0, skip=1.0).collect())
    assert 4 < len(want) < 40
    shuffled = sorted(rows, key=lambda r: r[3] + rng.random() * 3)
    for k in range(0, len(rows), 17):
        _write(spark, shuffled[k : k + 17], IMAGES, f"{tmp_path}/in/{k:03d}")
    _write(spark, [(9, 0, 0.0, 500.0, ("", 1, 1, 3, 16, bytearray(3)))], IMAGES, f"{tmp_path}/in/999")
    got = _run(spark, f"{tmp_path}/in", IMAGES, lambda s: timers.keep_unlike(s, threshold, method, "4 seconds", dark=25.0, skip=1.0), f"{tmp_path}/out")
    assert sorted((v, i, round(d, 9)) for v, _, i, d in got if v != 9) == want


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    """Stopped after each file and started from its checkpoint, a stream compares with the frame it kept before."""
    values = [10, 12, 60, 61, 130, 128, 10]
    got = []
    for i, v in enumerate([*values, None]):
        at, data = (float(i), bytearray([v] * 12)) if v is not None else (100.0, bytearray(12))
        _write(spark, [(1 if v is not None else 9, i, at, at, ("", 2, 2, 3, 16, data))], IMAGES, f"{tmp_path}/in/{i}")
        got = _run(spark, f"{tmp_path}/in", IMAGES, lambda s: timers.keep_unlike(s, 0.9, "pixel", "0 seconds"), f"{tmp_path}/out")
    assert [i for v, _, i, _ in sorted(got) if v == 1] == [0, 2, 4, 6]


def test_state_is_asked_for_and_told_once_a_timer():
    """A video's frames fold over one reading of its last frame, and the next timer is set once."""
    calls = []

    class Value:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Pending(Value):
        value = [(i * 700_000, i, 0.5) for i in range(200)]

    class Handle:
        def registerTimer(self, at):
            calls.append(("timer", at))

    class Now:
        def getCurrentWatermarkInMs(self):
            return 139_999

    p = timers.Spaced(2_000_000)
    p.handle, p.pending, p.last = Handle(), Pending(), Value()
    (out,) = p.handleExpiredTimer(("1",), Now(), None)
    assert out["frame_index"].tolist() == list(range(0, 198, 3)) and p.last.value == (198 * 700_000, 198, 0.5)
    assert len(calls) <= 6 and calls[-1] == ("timer", 140_600)
