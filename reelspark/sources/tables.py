"""The generic tables read as timelines, features and a job store.

frames: events of a user are the frames of a video, the value is a grey-level signal.
features: embeddings are frame features, VIDEO_FRAMES of them a video, two a second, their label a given cluster.
jobs and videos: orders and customers; keyframes: lineitems; logs: conversation turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VIDEO_FRAMES, FEATURE_FPS = 128, 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_index, ts, signal): seconds since the video's first frame."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_index"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("signal"))
    return e.withColumn("ts", (F.col("us") - F.min("us").over(W.partitionBy("video_id"))) / F.lit(1e6)).drop("us").select("video_id", "frame_index", "ts", "signal")


FRAMES_SQL = "frames AS (SELECT user_id AS video_id, event_id AS frame_index, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS ts, value AS signal FROM events)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_index, ts, cluster_id, features)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / VIDEO_FRAMES).alias("video_id"), F.col("vec_id").alias("frame_index"), ((F.col("vec_id") % VIDEO_FRAMES) / FEATURE_FPS).alias("ts"),
        F.col("label").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("features"),
    )


FEATURES_SQL = f"features AS (SELECT CAST(floor(vec_id / {VIDEO_FRAMES}) AS BIGINT) AS video_id, vec_id AS frame_index, (vec_id % {VIDEO_FRAMES}) / {FEATURE_FPS} AS ts, label AS cluster_id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"), (F.lit(10.0) + F.abs("c_acctbal") / 20).alias("duration"), (F.lit(300) + F.col("c_custkey") % 900).cast("bigint").alias("total_frames"))


VIDEOS_SQL = "videos AS (SELECT c_custkey AS id, c_name AS filename, 10.0 + abs(c_acctbal) / 20 AS duration, CAST(300 + c_custkey % 900 AS BIGINT) AS total_frames FROM customer)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 40).cast("bigint").alias("frames_filtered"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 30).cast("bigint")).alias("clusters_found"))


JOBS_SQL = "jobs AS (SELECT o_orderkey AS id, o_custkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderdate AS created_at, CAST(o_orderkey % 40 AS BIGINT) AS frames_filtered, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 30 AS BIGINT) END AS clusters_found FROM orders)"


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("frame_index"), (F.col("l_quantity") * 12.5 + F.col("l_linenumber")).alias("timestamp"), F.col("l_linenumber").alias("cluster_id"), F.col("l_discount").alias("distance_to_centroid"), F.col("l_tax").alias("temporal_coverage"))


KEYFRAMES_SQL = "keyframes AS (SELECT l_orderkey AS job_id, l_partkey AS frame_index, l_quantity * 12.5 + l_linenumber AS timestamp, l_linenumber AS cluster_id, l_discount AS distance_to_centroid, l_tax AS temporal_coverage FROM lineitem)"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.col("role").alias("stage"), F.col("text").alias("message"))


LOGS_SQL = "logs AS (SELECT conv_id AS job_id, turn AS seq, role AS stage, text AS message FROM conversations)"
