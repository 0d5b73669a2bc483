"""Operators on small tables against plain Python, and the registered queries against their SQL."""

from __future__ import annotations

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from reelspark.config import DEFAULT, FACTORS
from reelspark.functions import scalars as S
from reelspark.functions import vectors as V
from reelspark.operators import clustering, jobs, scoring, selection, timeline
from reelspark.plans.entry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    mine = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# --- folds


def _frames(spark, values, gap=1.0):
    return spark.createDataFrame([(1, i, i * gap, float(v)) for i, v in enumerate(values)], "video_id long, frame_index long, ts double, value double")


def test_last_kept_isnt_previous(spark):
    got = timeline.redundancy_keep(_frames(spark, [0, 4, 8, 12, 16, 20]), "value", 10).orderBy("ts").collect()
    assert [r.frame_index for r in got] == [0, 3]


def test_adaptive_threshold(spark):
    values = [random.Random(1).uniform(0, 100) for _ in range(60)]
    (got,) = timeline.adaptive_threshold(_frames(spark, values), "value", 50.0, 5.0, 5.0, 90.0, 20, 30).collect()

    def kept(d):
        last, n = None, 0
        for v in values:
            if last is None or abs(v - last) >= d:
                last, n = v, n + 1
        return n

    d, n = 50.0, -1
    for _ in range(10):
        n, used = kept(d), d
        if 20 <= n <= 30:
            break
        d = max(5.0, min(90.0, d + (-5.0 if n < 20 else 5.0)))
    assert (got.kept, got.difference) == (n, used)


def test_spacing_replaces_the_last_if_closer(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 0.4, 3.0), (1, 2, 0.6, 4.0), (1, 3, 1.5, 9.0)], "video_id long, frame_index long, ts double, d double")
    once = timeline.temporal_spacing(df, "d", 1.0)
    assert [r.frame_index for r in once.orderBy("ts").collect()] == [1, 3]
    again = timeline.temporal_spacing(once, "distance", 1.0)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    assert timeline.temporal_spacing(df, "d", 0).count() == 4


def test_scenes_share_their_bounds(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, i, float(i), f) for i, f in enumerate([a, a, b, b, a])] + [(2, 0, 0.0, a)], "video_id long, frame_index long, ts double, features array<double>")
    got = sorted((r.video_id, r.scene_id, r.start_frame, r.end_frame) for r in timeline.scenes(df).collect())
    assert got == [(1, 0, 0, 2), (1, 1, 2, 4), (1, 2, 4, 4), (2, 0, 0, 0)]


# --- selection


def _selection_plain(rows, settings=DEFAULT):
    rows = sorted(rows)
    clusters = sorted({r[2] for r in rows})
    taken = []

    def ok(r, gap):
        return all(abs(r[1] - t[1]) >= gap for t in taken)

    for c in clusters:
        best = max((r for r in rows if r[2] == c), key=lambda r: (r[3], -r[0]))
        if best[3] >= settings.low_score and ok(best, settings.first_gap):
            taken.append(best)
    slots = settings.max_per_cluster * len(clusters) - len(taken)
    per = lambda c: sum(t[2] == c for t in taken)
    pool = [r for r in rows if r not in taken and r[3] >= settings.low_score and per(r[2]) < settings.max_per_cluster]
    for r in sorted(pool, key=lambda r: (-r[3], r[0])):
        if slots > 0 and per(r[2]) < settings.max_per_cluster and ok(r, settings.second_gap):
            taken.append(r)
            slots -= 1
    return sorted(t[0] for t in taken)


def test_selection_matches_plain_python(spark):
    rng = random.Random(5)
    videos = {v: [(i, rng.randrange(40) / 4, rng.randrange(4), round(rng.uniform(0.2, 1), 2)) for i in range(rng.randrange(1, 25))] for v in range(20)}
    df = spark.createDataFrame([(v, *r, False, 4.0) for v, rows in videos.items() for r in rows], "video_id long, frame_index long, ts double, cluster_id int, score double, is_low_entropy boolean, entropy double")
    got = {}
    for r in selection.select(df).collect():
        got.setdefault(r.video_id, []).append(r.frame_index)
    assert all(sorted(got.get(v, [])) == _selection_plain(rows) for v, rows in videos.items())


def test_selection_may_be_empty(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0, 0.1, False, 4.0)], "video_id long, frame_index long, ts double, cluster_id int, score double, is_low_entropy boolean, entropy double")
    assert selection.select(df).count() == 0


# --- clustering


def test_k_range_and_elbow(spark):
    low, high = clustering.k_range(F.col("n"), F.col("d"))
    rows = spark.createDataFrame([(100, 130.0), (100, 10.0), (2, 5.0), (10, 0.0)], "n int, d double").select(low, high).collect()
    assert [tuple(r) for r in rows] == [(30, 30), (4, 30), (2, 2), (4, 9)]
    curve = spark.createDataFrame([(1, k, w) for k, w in zip(range(4, 10), (100.0, 40.0, 12.0, 10.0, 9.0, 8.0), strict=True)] + [(2, 4, 1.0), (2, 5, 0.5)], "video_id long, k int, wcss double")
    assert {r.video_id: r.elbow for r in clustering.elbow(curve).collect()} == {1: 2, 2: 0}
    curve = curve.withColumn("silhouette", F.when(F.col("k") == 7, 0.9).otherwise(0.1))
    assert {r.video_id: r.k for r in clustering.choose_k(curve, F.lit(30)).collect()}[1] == 7


def test_sweep_invariants(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, (10, 3)) for m in (0, 5, 10, 15)])
    df = spark.createDataFrame([(1, i, i * 0.1, [float(a) for a in v]) for i, v in enumerate(x)], "video_id long, frame_index long, ts double, features array<double>")
    got = sorted((r.k, r.wcss) for r in clustering.sweep(df, inits=3).collect())
    assert [k for k, _ in got] == list(range(4, 31)) and got[0][1] < 5 and all(b[1] <= a[1] * 1.3 + 1e-9 for a, b in zip(got, got[1:], strict=False))
    labels, centres, inertia = clustering.lloyd(x, 4, 3, 50, 1)
    assert set(labels) == {0, 1, 2, 3} and all(np.allclose(centres[j], x[labels == j].mean(axis=0)) for j in range(4))
    assert clustering.corpus_kmeans(df, 4).select("cluster_id").distinct().count() == 4


# --- scoring and scalars


def test_rejection_ladder_and_caps(spark):
    cases = [
        ((0.9, 100.0, 0.5, 0.5, 0.01, 1.0, True), "flat_surface_rejected"), ((0.9, 100.0, 0.5, 0.5, 0.1, 1.9, True), "low_entropy_rejected"), ((0.2, 100.0, 0.5, 0.5, 0.1, 4.0, False), "low_richness_rejected"),
        ((0.9, 24.0, 0.5, 0.5, 0.1, 4.0, False), "dark_rejected"), ((0.9, 241.0, 0.5, 0.5, 0.1, 4.0, False), "bright_rejected"), ((0.9, 100.0, 0.05, 0.2, 0.1, 4.0, False), "static_rejected"),
        ((0.9, 100.0, 0.05, 0.3, 0.1, 4.0, False), None), ((None, None, None, None, None, 4.0, False), None),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, r double, b double, m double, d double, e double, h double, l boolean")
    _, tag = scoring.rejection(*(F.col(c) for c in "rbmdehl"))
    assert [r.t for r in df.orderBy("i").select(tag.alias("t")).collect()] == [t for _, t in cases]
    score, tag = scoring.capped(F.col("s"), F.col("h"), F.col("e"), F.lit(True))
    rows = spark.createDataFrame([(0.9, 1.0, 0.01), (0.9, 2.2, 0.5), (0.9, 3.0, 0.5), (0.1, 1.0, 0.01)], "s double, h double, e double").select(score, tag).collect()
    assert [tuple(r) for r in rows] == [(0.25, "hard_entropy_penalty_very_low"), (0.35, "hard_entropy_penalty_low"), (0.9, "entropy_penalty_moderate_applied"), (0.1, None)]


def test_confidence_with_few_frames(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9, 0.5, 0.1))] + [(2, i, s / 10) for i, s in enumerate(range(10))], "video_id long, frame_index long, score double")
    got = {(r.video_id, r.frame_index): r.confidence for r in scoring.with_confidence(df, "score").collect()}
    assert [got[1, i] for i in range(3)] == ["HIGH", "MEDIUM", "LOW"]
    assert [got[2, i] for i in range(10)] == ["LOW"] * 3 + ["MEDIUM"] * 5 + ["HIGH"] * 2


def test_weights_sum_to_one(spark):
    for pace in ("fast", "slow", "normal"):
        w = scoring.weights(F.lit(pace))
        assert abs(sum(spark.range(1).select(*[w[f].alias(f) for f in FACTORS]).first()) - 1) < 1e-9


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(S.format_timestamp(F.lit(3600.9))) == "60:00" and value(S.format_duration(F.lit(65.2))) == "1:05"
    assert value(S.format_size(F.lit(2048))) == "2.0 KB" and value(S.format_size(F.lit(3 * 2**20))) == "3.0 MB"
    assert value(S.safe_int(F.lit("12"))) == 12 and value(S.safe_int(F.lit("x"), 3)) == 3 and value(S.safe_int_bytes(F.lit(bytes([5, 1, 0, 0])))) == 261 and value(S.safe_int_bytes(F.lit(bytes([5, 1])), 7)) == 7 and value(S.safe_int_bytes(F.lit(bytes(9)))) == 0 and value(S.safe_int_bytes(F.lit(bytes([255] * 8)), 3)) == 3 and value(S.safe_int_bytes(F.lit(bytes([1, 0, 0, 0, 9])), most=4)) == 1 and value(S.safe_int_bytes(F.lit(None).cast("binary"))) == 0
    assert value(S.compression_ratio(F.lit(10.0), F.lit(0))) == 1.0 and value(S.redundancy_removed(F.lit(3), F.lit(0))) == 0.0
    assert value(S.reason(F.lit(4), F.lit(10.0))) == "Balanced content summarized into 4 key moments (~0.4 keyframes/sec)."
    assert value(S.progress(F.lit("clustering"))) == 75.0 and value(S.summary_confidence(F.lit(True), F.lit(0.95))) == "HIGH"
    assert value(F.array_join(S.caption_tags(F.lit("A Big Dog runs over THE green hills today")), " ")) == "Runs Over Green Hills"
    assert DEFAULT.public(spark).count() == 1


def test_vectors(spark):
    zero, a, b = (F.array(*[F.lit(float(x)) for x in v]) for v in ((0, 0), (3, 4), (4, 3)))
    row = spark.range(1).select(V.cosine_distance(zero, a), V.cosine_distance(a, b), V.euclidean(a, b), V.bhattacharyya_similarity(a, a), V.correlation(a, b), V.l2_normalize(zero)[0]).first()
    assert np.allclose(list(row), [1.0, 1 - 24 / 25, math.sqrt(2), 1.0, -1.0, 0.0])


def test_job_store(spark):
    j = spark.createDataFrame([(1, 1, "pending", None), (2, 1, "completed", 0), (3, 2, "completed", 5)], "id long, video_id long, status string, clusters_found long").withColumn("created_at", F.lit(0))
    v = spark.createDataFrame([(1, "a.mp4", 10.0, 100), (2, "b.mp4", 20.0, 200)], "id long, filename string, duration double, total_frames long")
    k = spark.createDataFrame([(2, 9, 3700.0, 0), (2, 3, 1.0, 1)], "job_id long, frame_index long, timestamp double, cluster_id int")
    got = {r.id: r for r in jobs.job_list(j, v, k).collect()}
    assert got[1].keyframes is None and got[1].num_keyframes == 0 and got[2].num_keyframes == 2 and got[3].num_keyframes == 5
    assert [(x["index"], x.timestamp_formatted) for x in got[2].keyframes] == [(1, "00:01"), (2, "61:40")]
    t = spark.createDataFrame([(1, 1, 1, "clustering", None), (1, 2, 2, "failed", "broke")], "job_id long, at long, seq long, status string, message string")
    (state,) = jobs.latest_state(t).collect()
    assert (state.status, state.progress, state.error) == ("failed", 75.0, "broke")


def test_cluster_frames_and_summary(spark):
    from reelspark.plans import summary

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8)) * 3
    rows = [(1, i, i * 0.5, [float(a) for a in centres[i // 8] + rng.normal(size=8) * 0.05], 128.0, 0.1, 200.0, 4.0, False) for i in range(40)]
    rows += [(2, 100 + i, i * 1.0, [1.0, float(i)] + [0.0] * 6, 10.0, 0.0, 1.0, 1.0, True) for i in range(2)]
    df = spark.createDataFrame(rows, "video_id long, frame_index long, ts double, features array<double>, brightness double, edge_density double, sharpness double, entropy double, uniform boolean")
    got = clustering.cluster_frames(df, inits=4)
    labels = {r.frame_index: r.cluster_id for r in got.collect()}
    blobs = {(labels[i], i // 8) for i in range(40)}
    assert len(labels) == 42 and len(blobs) == len({c for c, _ in blobs}) and labels[100] != labels[101]  # no cluster mixes groups
    found = {r.video_id: r for r in summary.summarize(got).collect()}
    one, two = found[1], found[2]
    assert one.num_keyframes == len(one.keyframes) > 0 and one.scene_count >= 4 and [k.ts for k in one.keyframes] == sorted(k.ts for k in one.keyframes)
    assert all(sum(k.cluster_id == c for k in one.keyframes) <= DEFAULT.max_per_cluster for c in range(40))
    assert two.num_keyframes == 0 and two.keyframes is None and two.compression_ratio == 1.0 and two.stability_ratio == 1.0


def test_silhouette_agrees_with_the_grouped_one(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(30, 4)), rng.integers(0, 3, 30)
    df = spark.createDataFrame([(1, i, int(c[i]), [float(a) for a in v]) for i, v in enumerate(x)], "video_id long, frame_index long, cluster_id int, features array<double>")
    assert abs(clustering.silhouette(df).first().silhouette - clustering.mean_silhouette(x, c)) < 1e-9
