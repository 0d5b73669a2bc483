"""Interval lookups against a plain loop, label softmax against the plain formula."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import scoring, timeline


@pytest.mark.parametrize("width", [0.7, 5.0, 1000.0])
def test_intervals_of_any_length_overlapping_or_not(spark, width):
    rng = random.Random(2)
    frames = [(v, i, rng.choice([round(rng.uniform(-5, 60), 2), float(rng.randint(0, 60))])) for v in (1, 2, 3, None) for i in range(60)] + [(1, 99, None)]
    intervals = []
    for v in (1, 2, None):
        for i in range(12):
            a = float(rng.randint(-4, 55))
            intervals.append((v, i, a, a + rng.choice([0.0, 0.5, 3.0, 17.0, 60.0])))
    intervals += [(1, 50, 5.0, 4.0), (1, 51, None, 9.0), (2, 52, 1.0, None)]
    f = spark.createDataFrame(frames, "video_id long, frame_index long, ts double").withColumn("start", F.lit("own")).drop("start")
    s = spark.createDataFrame(intervals, "video_id long, name long, start double, end double")
    want = []
    for v, i, t in frames:
        own = [(n, a, b) for w, n, a, b in intervals if w == v and v is not None and a is not None and b is not None and a <= b]
        top = max((b for *_, b in own), default=None)
        held = [n for n, a, b in own if t is not None and (a <= t < b or (b == top and a <= t <= b))]
        want += [(v, i, n) for n in held] or [(v, i, None)]
    got = [tuple(r) for r in timeline.in_intervals(f, s, width).select("video_id", "frame_index", "name").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    inner = timeline.in_intervals(f, s, width, "inner")
    assert inner.columns == ["video_id", "frame_index", "ts", "name", "start", "end"] and inner.count() == sum(n is not None for *_, n in want)
    with pytest.raises(ValueError):
        timeline.in_intervals(f, s, 0.0)


def test_intervals_meet_frames_by_equal_bins(spark):
    f = spark.range(100).select((F.col("id") % 2).alias("video_id"), F.col("id").cast("double").alias("ts"))
    s = spark.createDataFrame([(v, a, b) for v in (0, 1) for a, b in ((0.0, 40.0), (40.0, 99.0))], "video_id long, start double, end double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = timeline.in_intervals(f, s)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [video_id" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert timeline.in_intervals(f, s).where("end = 99.0").count() == 60 and timeline.in_intervals(f, s.limit(0)).where("end is null").count() == 100


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_softmax_over_labels_in_blocks(spark, block):
    rng = np.random.default_rng(4)
    x, vectors = rng.normal(size=(40, 5)), rng.normal(size=(11, 5))
    x[3], vectors[7], vectors[9] = 0, 0, vectors[2]  # a zero frame, a zero label, two equal labels
    x[5] = vectors[2] * 3
    df = spark.createDataFrame([(1, i, [float(a) for a in row]) for i, row in enumerate(x)] + [(1, 40, None)], "video_id long, frame_index long, features array<double>").repartition(3)
    labels = spark.createDataFrame([(f"l{i:02d}", [float(a) for a in v]) for i, v in enumerate(vectors)] + [("none", None)], "label string, vector array<double>")
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    s = 100 * unit(x) @ unit(vectors).T
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    got = {r.frame_index: (r.label, r.score) for r in scoring.softmax_top(df, labels, block=block).collect()}
    assert sorted(got) == list(range(40)) and got[5][0] == "l02" and got[3] == ("l00", pytest.approx(1 / 11))
    for i, (label, score) in got.items():
        assert np.isclose(s[i, int(label[1:])], s[i].max()) and np.isclose(score, p[i].max())


def test_softmax_makes_no_pairs(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0])], "video_id long, frame_index long, features array<double>")
    labels = spark.createDataFrame([(2, [0.0, 1.0]), (1, [1.0, 0.0])], "label int, vector array<double>")
    found = scoring.softmax_top(df, labels)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Exchange" not in plan
    assert [(r.label, round(r.score, 6)) for r in found.collect()] == [(1, 1.0)] and dict(found.dtypes)["label"] == "int"
    assert scoring.softmax_top(df, labels.limit(0)).count() == 0 and scoring.softmax_top(df.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        scoring.softmax_top(df, spark.range(scoring.MOST_LABELS + 1).select("id", F.col("id").alias("label"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")))
