"""K-means by runs and silhouettes of many labellings, against plain Lloyd's and a plain silhouette."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.config import DEFAULT, Settings
from reelspark.operators import clustering, kmeans


def _blobs(n, d, groups, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (groups, d))[rng.integers(groups, size=n)] + rng.normal(0, spread, (n, d))


@pytest.mark.parametrize(("n", "d", "k", "spread"), [(60, 3, 2, 0.3), (400, 8, 9, 0.2), (400, 8, 9, 2.0), (900, 20, 30, 0.4), (5, 2, 5, 0.1), (50, 4, 1, 1.0)])
def test_bounds_change_no_label(n, d, k, spread):
    x = _blobs(n, d, max(2, k), n + k, spread)
    for start in range(4):
        labels, centres, inertia = kmeans.plain_run(x, k, start, 300, 42)
        run = kmeans.BoundedRun(x, k, start, 300, 42)
        assert (run.labels == labels).all() and np.allclose(run.centres, centres) and np.isclose(run.inertia, inertia)


@given(st.integers(1, 40), st.integers(1, 8), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_bounds_change_no_label_with_ties(n, k, seed):
    x = np.random.default_rng(seed).integers(0, 3, (n, 2)).astype(float)
    labels, _, inertia = kmeans.plain_run(x, min(k, n), 0, 100, seed)
    run = kmeans.BoundedRun(x, min(k, n), 0, 100, seed)
    assert np.isclose(run.inertia, inertia) and (run.labels == labels).all()


def test_bounds_skip_most_distances():
    x = _blobs(6000, 16, 20, 3)
    rounds = 0
    c = kmeans.start_centres(x, 20, 42, 1)
    while True:
        rounds += 1
        new = kmeans.means(x, kmeans.squared(x, c).argmin(axis=1), c)
        if np.allclose(new, c):
            break
        c = new
    run = kmeans.BoundedRun(x, 20, 1, 300, 42)
    assert rounds > 5 and run.distances < 0.5 * (rounds + 1) * len(x) * 20


def _video(spark, xs):
    rows = [(v, 100 + i, i / 2, [float(a) for a in row]) for v, x in xs.items() for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "video_id long, frame_index long, ts double, features array<double>").repartition(3)


@pytest.mark.parametrize("group_frames", [1, 100, 1 << 15])
def test_runs_are_the_best_of_all_starts_however_they_are_dealt(spark, group_frames):
    xs = {1: _blobs(40, 5, 4, 1), 2: _blobs(25, 5, 3, 2)}
    frames = _video(spark, xs).select("video_id", (F.col("frame_index") - 100).alias("pos"), "features")
    best = kmeans.runs(frames, F.lit(2), F.lit(6), 4, 300, 7, group_frames).collect()
    assert sorted((r.video_id, r.k) for r in best) == [(v, k) for v in (1, 2) for k in range(2, 7)]
    for r in best:
        x = xs[r.video_id] - xs[r.video_id].mean(axis=0)
        labels, _, inertia = clustering.lloyd(x, r.k, 4, 300, 7)
        assert r.labels == labels.tolist() and np.isclose(r.wcss, inertia) and r.frames == len(x)


def test_a_long_videos_runs_are_groups_of_their_own(spark):
    frames = _video(spark, {1: _blobs(64, 2, 3, 1), 2: _blobs(10, 2, 3, 1)}).select("video_id", (F.col("frame_index") - 100).alias("pos"), "features")
    dealt = kmeans.deal(frames, F.lit(2), F.lit(4), 5, 64)
    assert {(r.video_id, r.groups, r.n) for r in dealt.groupBy("video_id").agg(F.countDistinct("g").alias("groups"), F.count("*").alias("n")).collect()} == {(1, 15, 15 * 64), (2, 3, 3 * 10)}


@pytest.mark.parametrize("block", [7, 16, 512])
def test_silhouettes_of_all_labellings_at_once(spark, block):
    rng = np.random.default_rng(5)
    xs = {1: _blobs(45, 4, 3, 6), 2: _blobs(20, 4, 2, 7), 3: np.zeros((3, 4))}
    labels = {v: np.stack([rng.integers(k, size=len(x)) for k in (1, 2, 3, 9)] + [np.arange(len(x))], axis=1) for v, x in xs.items()}
    rows = [(v, i, [float(a) for a in x[i]], labels[v][i].tolist()) for v, x in xs.items() for i in range(len(x))]
    df = spark.createDataFrame(rows, "video_id long, frame_index long, features array<double>, labels array<int>").repartition(4)
    got = {(r.video_id, r.place): r.silhouette for r in kmeans.silhouettes(df, block=block).collect()}
    assert len(got) == 15
    for (v, place), s in got.items():
        assert abs(s - clustering.mean_silhouette(xs[v], labels[v][:, place])) < 1e-9
    assert kmeans.silhouettes(df.limit(0)).count() == 0


def test_distances_are_made_once_for_all_labellings():
    x = _blobs(30, 3, 3, 1)
    sums = kmeans._Sums(np.arange(10), x[:10], np.tile(np.arange(10)[:, None] % 3, (1, 5)))
    sums.add(np.arange(30), x, np.tile(np.arange(30)[:, None] % 3, (1, 5)))
    assert sums.made == 300


def test_sweep_and_clusters_of_long_and_short_videos(spark):
    xs = {1: _blobs(50, 6, 5, 11, 0.05), 2: _blobs(2, 6, 2, 1), 3: _blobs(1, 6, 1, 1), 4: _blobs(3, 6, 3, 1)}
    df = _video(spark, xs).withColumn("cluster_id", F.lit(-1))
    curve = {(r.video_id, r.k): r for r in clustering.sweep(df, inits=3).collect()}
    assert curve[2, 2].wcss == 0 and curve[3, 1].frames == 1 and curve[4, 2].frames == 3
    x = xs[1] - xs[1].mean(axis=0)
    for (v, k), r in curve.items():
        if v == 1:
            labels, _, inertia = clustering.lloyd(x, k, 3, DEFAULT.kmeans_steps, DEFAULT.seed)
            assert np.isclose(r.wcss, inertia) and abs(r.silhouette - clustering.mean_silhouette(x, labels)) < 1e-9
    got = clustering.cluster_frames(df, inits=3).collect()
    assert len(got) == 56 and sorted(r.cluster_id for r in got if r.video_id == 2) == [0, 1]
    (k,) = {r.k for r in got if r.video_id == 1}
    labels = clustering.lloyd(x, k, 3, DEFAULT.kmeans_steps, DEFAULT.seed)[0]
    assert [r.cluster_id for r in sorted(got, key=lambda r: r.frame_index) if r.video_id == 1] == labels.tolist()
    assert clustering.sweep(df.limit(0), Settings()).count() == 0


def test_starts_are_those_of_plain_choices():
    """The centres are what numpy's choice by share gives, with distances between rows made before or not."""
    for seed, x in ((1, _blobs(128, 16, 9, 1)), (2, np.ones((6, 2))), (3, _blobs(40, 3, 4, 2))):
        for k in (1, 2, 5):
            for start in range(6):
                rng = np.random.default_rng([seed, k, start])
                c = [x[rng.integers(len(x))]]
                while len(c) < k:
                    d = kmeans.squared(x, np.array(c)).min(axis=1)
                    c.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
                for among in (None, kmeans.squared(x, x)):
                    assert np.allclose(kmeans.start_centres(x, k, seed, start, among), c)


def test_a_short_videos_runs_make_distances_between_rows_once(monkeypatch):
    x = _blobs(100, 6, 5, 3)
    among, plain = kmeans.squared(x, x), kmeans.squared
    for start in range(3):
        run = kmeans.BoundedRun(x, 7, start, 300, 42)
        calls = []
        monkeypatch.setattr(kmeans, "squared", lambda a, b: calls.append(len(b)) or plain(a, b))
        labels, inertia = kmeans.one_run(x, 7, start, 300, 42, among)
        monkeypatch.setattr(kmeans, "squared", plain)
        assert (labels == run.labels).all() and np.isclose(inertia, run.inertia) and set(calls) == {7}
