"""Uploads that arrive: verdicts as of a batch, contents once, jobs for the worker."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from reelspark.config import Settings
from reelspark.operators import jobs
from reelspark.sources import files
from reelspark.streaming import arrivals
from reelspark.streaming.queries import poll_jobs

from test_matroska import _webm

SMALL = Settings(max_duration=3.0, max_upload_mb=1)


def _put(folder, name, content, age):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    at = 1_700_000_000 - age
    os.utime(path, (at, at))


def _fill(folder):
    _put(folder, "a.webm", _webm(50), 10)
    _put(folder, "b.MKV", _webm(100), 9)
    _put(folder, "c.txt", b"text", 8)
    _put(folder, "d.mp4", b"no video", 7)
    _put(folder, "e.webm", b"\0" * (1024 * 1024 + 1), 6)
    _put(folder, "f.webm", _webm(0), 5)
    _put(folder, "g.exe", b"\0" * (1024 * 1024 + 1), 4)


REJECTED = {"a.webm": None, "b.MKV": "duration", "c.txt": "extension", "d.mp4": "cannot be opened", "e.webm": "size", "f.webm": "no frames", "g.exe": "extension"}


def test_verdicts_of_a_batch_and_of_a_stream_agree(spark, tmp_path):
    _fill(tmp_path / "in")
    batch = arrivals.verdicts(spark.read.format("binaryFile").load(str(tmp_path / "in")), SMALL)
    assert {r.filename: r.rejection for r in batch.collect()} == REJECTED
    q = arrivals.verdicts(arrivals.arriving(spark, f"file://{tmp_path}/in"), SMALL).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ("filename", "file_size", "total_frames", "codec", "duration", "rejection", "digest")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))
    # the rules on what is known alike to accepted_uploads
    known = files.ingest(spark.read.format("binaryFile").load(str(tmp_path / "in"))).withColumn("path", F.col("filename"))
    for r in jobs.accepted_uploads(known, "path", "file_size", "duration", SMALL).collect():
        if REJECTED[r.filename] in (None, "extension", "size", "duration"):
            assert r.rejection == REJECTED[r.filename]


def test_contents_beyond_the_limit_are_not_read(spark, tmp_path):
    _fill(tmp_path / "in")
    plan = arrivals.verdicts(spark.read.format("binaryFile").load(str(tmp_path / "in")), SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1048576)" in plan.replace(" ", "")


def test_a_content_is_taken_once_whatever_its_name(spark, tmp_path):
    inbox, progress = f"file://{tmp_path}/inbox", f"file://{tmp_path}/progress"

    def run():
        q = arrivals.take_uploads(spark, f"file://{tmp_path}/in", inbox, progress, SMALL, interval=None)
        q.awaitTermination()
        assert q.exception() is None
        return spark.read.schema(arrivals.JOB).json(inbox).collect()

    _fill(tmp_path / "in")
    _put(tmp_path / "in", "sub/again.webm", _webm(50), 3)
    first = run()
    assert len(first) == 1 and first[0].total_frames == 50 and first[0].codec == "VP90" and first[0].id > 0
    _put(tmp_path / "in", "later.webm", _webm(50), 2)  # the same once more, in a later batch
    _put(tmp_path / "in", "new.webm", _webm(25), 1)
    got = run()
    assert sorted((r.filename.split(".")[0] in ("a", "again"), r.total_frames) for r in got) == [(False, 25), (True, 50)]
    assert len({r.id for r in got}) == 2


def test_worker_polls_what_arrived(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "inbox").mkdir()
    taken = []
    uploads = arrivals.take_uploads(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/inbox", f"file://{tmp_path}/progress", SMALL, interval="200 milliseconds")
    worker = poll_jobs(spark, f"file://{tmp_path}/inbox", f"file://{tmp_path}/work", arrivals.JOB, lambda df, n: taken.extend(json.loads(r) for r in df.toJSON().collect()), "200 milliseconds")
    try:
        for k in (30, 60):
            _put(tmp_path / "in", f"v{k}.webm", _webm(k), 100 - k)
        for _ in range(200):
            if len(taken) == 2:
                break
            time.sleep(0.2)
    finally:
        uploads.stop()
        worker.stop()
    assert sorted(t["total_frames"] for t in taken) == [30, 60]


def test_files_are_moved_to_their_jobs_once(spark, tmp_path):
    _put(tmp_path / "in", "a.webm", _webm(5), 1)
    _put(tmp_path / "in", "b.MKV", _webm(6), 1)
    jobs = spark.createDataFrame([(7, f"file:{tmp_path}/in/a.webm"), (8, f"file://{tmp_path}/in/b.MKV")], "id long, path string")
    for _ in range(2):  # a task that runs again finds them moved
        got = {r.id: r.path for r in arrivals.moved(jobs, f"file://{tmp_path}/store").collect()}
        assert got == {7: f"file://{tmp_path}/store/jobs/7/original.webm", 8: f"file://{tmp_path}/store/jobs/8/original.mkv"}
    assert (tmp_path / "store/jobs/7/original.webm").read_bytes() == _webm(5) and not list((tmp_path / "in").iterdir())
    with pytest.raises(Exception, match="FileNotFoundError"):
        arrivals.moved(spark.createDataFrame([(9, f"file://{tmp_path}/in/none.webm")], "id long, path string"), f"file://{tmp_path}/store").collect()


def test_many_small_files_are_few_batches(spark, tmp_path):
    """Batches go by bytes, as each costs a second or so: 350 small files are one, and a bound of bytes still cuts them."""
    for i in range(350):
        _put(tmp_path / "in", f"{i}.webm", _webm(5), i)
    size = len(_webm(5))
    for name, options, least, most in (("all", {}, 1, 1), ("bytes", {"bytes_a_batch": 120 * size}, 3, 3), ("files", {"files_a_batch": 100}, 4, 4)):
        seen = []
        q = arrivals.arriving(spark, f"file://{tmp_path}/in", **options).writeStream.foreachBatch(lambda df, i: seen.append(df.count())).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None and sum(seen) == 350 and least <= len([n for n in seen if n]) <= most


def test_announced_files_have_the_verdicts_of_listed_ones(spark, tmp_path):
    _fill(tmp_path / "in")
    _put(tmp_path / "in", "deep/h.avi", b"RIFF" + b"\0" * 200_000, 3)  # more than a header's bytes: all of it is read
    batch = arrivals.verdicts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in")), SMALL)
    notes = spark.createDataFrame([(f"file:{p}",) for p in (tmp_path / "in").rglob("*.*")] + [(f"file:{tmp_path}/in/gone.webm",)], "path string")
    notes.repartition(2).write.parquet(f"{tmp_path}/notes")
    q = arrivals.verdicts_of_notes(arrivals.announced(spark, f"file://{tmp_path}/notes"), SMALL).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    columns = [c for c in arrivals.VERDICT if c != "path"]
    assert sorted(map(str, found.where("filename != 'gone.webm'").select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))
    assert [(r.rejection, r.file_size) for r in found.where("filename = 'gone.webm'").collect()] == [("cannot be opened", None)]


@pytest.mark.parametrize("name", ["stream_uploads", "stream_upload_jobs"])
def test_upload_queries_list_no_folder_of_videos(spark, monkeypatch, name):
    """A folder for each video costs the driver a millisecond and more, several times."""
    from reelspark.streaming import queries

    made = []
    monkeypatch.setattr(queries, "_run", lambda stream, *rest: made.append(stream))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    plan = made[0]._jdf.queryExecution().analyzed().toString()
    assert "FileSource[" in plan and "/videos-" not in plan
