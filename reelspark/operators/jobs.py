"""The job store: joins, latest state from an append-only log of transitions, nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def with_video(jobs: DataFrame, videos: DataFrame) -> DataFrame:
    v = videos.select(F.col("id").alias("video_id"), "filename", "duration", "total_frames")
    return jobs.join(v, "video_id")


def nested_keyframes(keyframes: DataFrame) -> DataFrame:
    """(job_id, keyframes, n): a job's keyframes in time order with their number from 1, one row per job."""
    item = F.struct("timestamp", "frame_index", "cluster_id")
    one = keyframes.groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("k"))
    made = F.transform("k", lambda x, i: F.struct((i + 1).alias("index"), x["frame_index"].alias("frame_index"), x["timestamp"].alias("timestamp"), S.format_timestamp(x["timestamp"]).alias("timestamp_formatted"), F.lit(0.8).alias("importance_score"), F.lit("MEDIUM").alias("importance_confidence")))
    return one.select("job_id", made.alias("keyframes"), F.size("k").cast("bigint").alias("n"))


def job_list(jobs: DataFrame, videos: DataFrame, keyframes: DataFrame) -> DataFrame:
    """All jobs with video and nested keyframes, empty if there are none; the number shown falls back to their count."""
    nested = nested_keyframes(keyframes).withColumnRenamed("job_id", "id")
    listed = with_video(jobs, videos).join(nested, "id", "left")
    shown = F.coalesce("clusters_found", F.lit(0))
    n = F.coalesce("n", F.lit(0))
    return listed.withColumn("num_keyframes", F.when((shown == 0) & (n > 0), n).otherwise(shown)).withColumn("keyframe_count", n)


def next_pending(jobs: DataFrame, n: int = 1) -> DataFrame:
    return jobs.where(F.col("status") == "pending").orderBy("created_at", "id").limit(n)


def latest_state(transitions: DataFrame) -> DataFrame:
    """(job_id, status, progress, steps, error, started_at, completed_at) from transitions (job_id, at, seq, status, message).

    The last transition is a job's state. A failed job keeps the progress of the state before; extraction starts it.
    """
    order = F.struct("at", "seq")
    ok = F.col("status") != "failed"
    return transitions.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"), F.coalesce(F.max_by(F.when(ok, S.progress(F.col("status"))), F.when(ok, order)), F.lit(0.0)).alias("progress"), F.count("*").alias("steps"),
        F.max_by(F.when(~ok, F.col("message")), F.when(~ok, order)).alias("error"), F.min(F.when(F.col("status") == "extracting_frames", F.col("at"))).alias("started_at"), F.max(F.when(F.col("status") == "completed", F.col("at"))).alias("completed_at"),
    )


def attach_scores(keyframes: DataFrame, scores: DataFrame, on: list[str], which: str = "last", how: str = "left") -> DataFrame:
    """Keyframes with a score; of a frame's scores the ``which`` (first or last) by ``seq`` counts.

    ``how``: left keeps keyframes without a score, inner drops them.
    """
    pick = {"first": F.min_by, "last": F.max_by}[which]
    return keyframes.join(scores.groupBy(*on).agg(pick("score", "seq").alias("score")), on, how)


def gate(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """``asked`` (id) with the code of an answer that needs a completed job: 404 without the job, 400 before its end, else 200."""
    status = jobs.select("id", "status")
    return asked.join(status, "id", "left").withColumn("code", F.when(F.col("status").isNull(), 404).when(F.col("status") != "completed", 400).otherwise(200))


def job_log(logs: DataFrame, jobs: DataFrame) -> DataFrame:
    """The log lines of the given jobs, numbered in order."""
    return logs.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi").withColumn("line", F.row_number().over(W.partitionBy("job_id").orderBy("seq")))


def summary_metrics(jobs: DataFrame, videos: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Ratios and labels of each job's summary."""
    per_job = keyframes.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n"), F.avg("temporal_coverage").alias("coverage"))
    met = with_video(jobs, videos).join(per_job, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n, d = F.col("n"), F.col("duration")
    return met.select(
        "id", "n", S.compression_ratio(d, n).alias("compression_ratio"), S.redundancy_removed(n, F.col("frames_filtered")).alias("redundancy_removed"),
        F.round(F.coalesce("coverage", F.lit(0.0)), 7).alias("temporal_coverage_score"), S.pacing_by_density(n, d).alias("video_pacing"), S.percent_compression(n, F.col("total_frames")).alias("percent_compression"),
    )


def best_file(files: DataFrame, key: str, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(key, path): for each key the file whose extension comes first in the given order."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), S.suffix(F.col(path)))
    return files.withColumn("r", rank).where(F.col("r") > 0).groupBy(key).agg(F.min_by(path, F.struct("r", path)).alias(path))


def accepted_uploads(files: DataFrame, path: str, size: str, duration: str, settings) -> DataFrame:
    """``rejection``: why a file isn't taken, null if it is."""
    rules = [(~S.suffix(F.col(path)).isin(*settings.extensions), "extension"), (F.col(size) > settings.max_upload_mb * 1024 * 1024, "size"), (F.col(duration) > settings.max_duration, "duration")]
    return files.withColumn("rejection", S.first_match(*rules))
