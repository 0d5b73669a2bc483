"""The bucketed job store against the plain operators, and its plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import jobs as J
from reelspark.sources import store

STATES = ["pending", "uploaded", "extracting_frames", "clustering", "completed", "failed"]


def _transitions(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([*range(12), None]), rng.randint(0, 40), 1000 * seed + i, rng.choice(STATES), rng.choice([None, "broke", "again"])) for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, at long, seq long, status string, message string").withColumn("at", F.timestamp_seconds("at"))


def _rows(df):
    return sorted(map(str, df.select("job_id", "status", "progress", "steps", "error", "started_at", "completed_at").collect()))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_state_is_that_of_all_transitions(spark, tmp_path, no_broadcast):
    s = store.JobStore(spark, f"file://{tmp_path}/s", 4)
    assert s.state().count() == 0
    seen = None
    for k in range(5):
        more = _transitions(spark, 30, k)
        s.append(more)
        seen = more if seen is None else seen.unionByName(more)
        assert _rows(s.state()) == _rows(J.latest_state(seen.where("job_id is not null")))
        if k in (1, 2):
            s.compact()
            assert _rows(s.state()) == _rows(J.latest_state(seen.where("job_id is not null")))
    assert "Exchange" not in _plan(s.state()) and "SortMergeJoin" in _plan(s.state()) and "Bucketed: true" in _plan(s.state())
    assert "Exchange" in _plan(J.latest_state(seen))
    again = store.JobStore(spark, f"file://{tmp_path}/s", 4)  # as another session opens it
    assert _rows(again.state()) == _rows(s.state()) and "Exchange" not in _plan(again.state())
    again.append(_transitions(spark, 10, 9))
    again.compact()
    again.prune()
    assert _rows(again.state()) == _rows(J.latest_state(seen.unionByName(_transitions(spark, 10, 9)).where("job_id is not null")))
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["epochs", "snapshot_3"]


def test_a_compaction_lost_half_way_changes_nothing(spark, tmp_path):
    s = store.JobStore(spark, f"file://{tmp_path}/s", 4)
    a, b, c = (_transitions(spark, 25, k).where("job_id is not null") for k in (1, 2, 3))
    s.append(a)
    s._note("tail", 1)  # the first step of a compaction that then was lost, after part of its files
    s._write(store.partial_state(a.limit(3)), "snapshot_1", "job_id", "overwrite")
    assert _rows(s.state()) == _rows(J.latest_state(a))
    s.append(b)
    assert _rows(s.state()) == _rows(J.latest_state(a.unionByName(b)))
    other = store.JobStore(spark, f"file://{tmp_path}/s", 4)
    other.compact()
    other.append(c)
    assert _rows(other.state()) == _rows(J.latest_state(a.unionByName(b).unionByName(c)))


def test_lists_of_jobs_arent_shuffled_by_job(spark, tmp_path, no_broadcast):
    jobs = spark.createDataFrame([(i, i % 3, STATES[i % 6], None if i % 4 else 2) for i in range(20)], "id long, video_id long, status string, clusters_found long")
    videos = spark.createDataFrame([(i, f"v{i}.mp4", 10.0 * i, 100) for i in range(3)], "id long, filename string, duration double, total_frames long")
    keyframes = spark.createDataFrame([(i % 17, i, i / 3, i % 4) for i in range(60)], "job_id long, frame_index long, timestamp double, cluster_id int")
    s = store.JobStore(spark, f"file://{tmp_path}/s", 4)
    for k in range(2):  # in two appends each
        s.put_jobs(jobs.where(F.col("id") % 2 == k))
        s.put_keyframes(keyframes.where(F.col("frame_index") % 2 == k))
    columns = ("id", "video_id", "filename", "num_keyframes", "keyframe_count", "keyframes")
    want = J.job_list(jobs, videos, keyframes).select(*columns)
    got = s.job_list(videos).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    exchanges = [line for line in _plan(got).splitlines() if "Exchange" in line]

    assert len(exchanges) == 2 and all("video_id" in e or "hashpartitioning(id" not in e for e in exchanges)
    assert s.jobs().count() == 20 and store.JobStore(spark, f"file://{tmp_path}/none", 4).jobs() is None
    assert "Exchange" not in _plan(s.jobs().join(J.nested_keyframes(s.keyframes()).withColumnRenamed("job_id", "id"), "id"))
