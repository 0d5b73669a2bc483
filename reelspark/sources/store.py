"""A job store of bucketed tables: an append-only tail of transitions, compacted into a snapshot of one row a job.

Tables lie in a folder as Parquet files in buckets by job. A state is the snapshot joined with what the tail adds, a
list of jobs their rows joined with their keyframes; both sides lie by job already, so neither is shuffled by it. What is
current is a table of its own, written last: a compaction that is lost half-way changes nothing.
"""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import jobs as J

TRANSITION = "job_id long, at timestamp, seq long, status string, message string"
_EPOCHS = "kind string, epoch long"
_names = count()


def partial_state(transitions: DataFrame) -> DataFrame:
    """One row per job of what its transitions add to its state; such rows merge by max, min and sum."""
    ok = F.col("status") != "failed"
    return transitions.groupBy("job_id").agg(
        F.max(F.struct("at", "seq", "status")).alias("last"), F.max(F.when(ok, F.struct("at", "seq", S.progress(F.col("status")).alias("progress")))).alias("ok"), F.count("*").alias("steps"),
        F.max(F.when(~ok, F.struct("at", "seq", "message"))).alias("failure"), F.min(F.when(F.col("status") == "extracting_frames", F.col("at"))).alias("started_at"), F.max(F.when(F.col("status") == "completed", F.col("at"))).alias("completed_at"),
    )


def state_of(partial: DataFrame) -> DataFrame:
    """jobs.latest_state of partial states that are whole."""
    return partial.select("job_id", F.col("last.status").alias("status"), F.coalesce("ok.progress", F.lit(0.0)).alias("progress"), "steps", F.col("failure.message").alias("error"), "started_at", "completed_at")


class JobStore:
    """A store in ``folder``, which the first use makes; ``buckets`` must be the same whenever it is opened.

    One writer appends and compacts at a time; readers may read meanwhile. Rows with a null job_id are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.prefix = f"store_{uuid.uuid4().hex[:12]}_{next(_names)}"
        self.known: dict[str, str] = {}

    # --- tables ---

    def _write(self, df: DataFrame, name: str, key: str, mode: str) -> None:
        """Rows to a table in buckets by ``key``; a file for each bucket that a write touches."""
        table = f"{self.prefix}_{name}"
        dealt = df.where(F.col(key).isNotNull()).repartition(self.buckets, key)
        if name not in self.known:
            if self._there(name):
                self._open(name, key)
            else:
                self.spark.createDataFrame([], df.schema).write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/{name}").mode("ignore").saveAsTable(table)
                self.known[name] = table
        dealt.write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/{name}").mode(mode).saveAsTable(table)

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path))

    def _open(self, name: str, key: str) -> None:
        """Registers a table that another session has written."""
        table = f"{self.prefix}_{name}"
        schema = self.spark.read.parquet(f"{self.folder}/{name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        self.known[name] = table

    def _table(self, name: str, key: str) -> DataFrame | None:
        if name not in self.known:
            if not self._there(name):
                return None
            self._open(name, key)
        self.spark.catalog.refreshTable(self.known[name])
        return self.spark.table(self.known[name])

    # --- transitions ---

    def _epoch(self, kind: str) -> int:
        """The newest complete snapshot, or the tail that is written to; 0 at first."""
        if not self._there("epochs"):
            return 0
        return self.spark.read.schema(_EPOCHS).parquet(f"{self.folder}/epochs").where(F.col("kind") == kind).agg(F.max("epoch")).first()[0] or 0

    def _note(self, kind: str, epoch: int) -> None:
        self.spark.createDataFrame([(kind, epoch)], _EPOCHS).coalesce(1).write.mode("append").parquet(f"{self.folder}/epochs")

    def append(self, transitions: DataFrame) -> None:
        """Adds transitions (job_id, at, seq, status, message)."""
        kinds = self.spark.createDataFrame([], TRANSITION).schema
        self._write(transitions.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]), f"tail_{self._epoch('tail')}", "job_id", "append")

    def _merged(self, until: int | None = None) -> DataFrame:
        """Partial states of the snapshot and of the tails from its epoch on, up to the tail ``until``."""
        first, last = self._epoch("snapshot"), self._epoch("tail") if until is None else until
        tails = [t for t in (self._table(f"tail_{e}", "job_id") for e in range(first, last + 1)) if t is not None]
        now = self._table(f"snapshot_{first}", "job_id") if first else None
        for tail in tails:
            more = partial_state(tail)
            now = more if now is None else _both(now, more)
        return partial_state(self.spark.createDataFrame([], TRANSITION)) if now is None else now

    def state(self) -> DataFrame:
        """jobs.latest_state of all transitions."""
        return state_of(self._merged())

    def compact(self) -> None:
        """Makes a snapshot of all transitions so far; further ones go to a new tail. Files of older epochs stay for readers, until prune."""
        old = self._epoch("tail")
        self._note("tail", old + 1)
        name = f"snapshot_{old + 1}"
        self._write(self._merged(old), name, "job_id", "overwrite")
        self._note("snapshot", old + 1)

    def prune(self) -> None:
        """Removes the tables that no reader of the current epoch needs."""
        now = self._epoch("snapshot")
        for name in [f"{kind}_{e}" for e in range(now) for kind in ("tail", "snapshot")]:
            if self.known.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # --- jobs and keyframes ---

    def put_jobs(self, jobs: DataFrame) -> None:
        """Adds rows of jobs, by id."""
        self._write(jobs, "jobs", "id", "append")

    def put_keyframes(self, keyframes: DataFrame) -> None:
        """Adds rows of keyframes, by job_id."""
        self._write(keyframes, "keyframes", "job_id", "append")

    def jobs(self) -> DataFrame | None:
        return self._table("jobs", "id")

    def keyframes(self) -> DataFrame | None:
        return self._table("keyframes", "job_id")

    def job_list(self, videos: DataFrame) -> DataFrame:
        """jobs.job_list of the stored jobs and keyframes."""
        nested = J.nested_keyframes(self.keyframes()).withColumnRenamed("job_id", "id")
        n, shown = F.coalesce("n", F.lit(0)), F.coalesce("clusters_found", F.lit(0))
        listed = J.with_video(self.jobs().join(nested, "id", "left"), videos)
        return listed.withColumn("num_keyframes", F.when((shown == 0) & (n > 0), n).otherwise(shown)).withColumn("keyframe_count", n)


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of partial states as one; a join, as both lie by job."""
    a, b = a.alias("a"), b.alias("b")
    met = a.join(b, F.col("a.job_id") == F.col("b.job_id"), "full")
    top = lambda c: F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    return met.select(
        F.coalesce("a.job_id", "b.job_id").alias("job_id"), top("last"), top("ok"), (F.coalesce("a.steps", F.lit(0)) + F.coalesce("b.steps", F.lit(0))).alias("steps"), top("failure"),
        F.least("a.started_at", "b.started_at").alias("started_at"), top("completed_at"),
    )
