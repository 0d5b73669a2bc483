"""Results that are computed once and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where all share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="reelspark-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, where a lost executor can't take them away.

    Spark removes them with the DataFrame if spark.cleaner.referenceTracking.cleanCheckpoints is set; else they stay
    until the folder is cleared.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_tidily(df: DataFrame) -> DataFrame:
    """``cut``; the shuffles behind the rows go when they are made, not when the driver's garbage happens to be collected."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return cut(df.select("*"))  # the setting counts when a DataFrame is made
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as a compressed table to the shared checkpoint folder; for wide rows instead of cut."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
