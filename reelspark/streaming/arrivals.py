"""Uploads as they arrive: a stream of files with its verdicts, each content taken once, as jobs for the polling worker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Settings
from ..functions import scalars as S
from ..sources.files import ingest
from ..sources.video import located, read_by_path

JOB = "id long, path string, filename string, file_size long, fps double, total_frames long, width int, height int, codec string, duration double"
VERDICT = ("path", "filename", "file_size", "fps", "total_frames", "width", "height", "codec", "duration", "rejection", "arrived", "digest")


def _listed(settings: Settings) -> tuple[Column, Column]:
    """What is known of a file without opening it: a wrong extension, and a size beyond the limit."""
    return ~S.suffix(F.col("path")).isin(*settings.extensions), F.col("length") > settings.max_upload_mb * 1024 * 1024


def verdicts(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(path, file_size, ..., rejection) of binaryFile rows: why a file isn't taken, null if it is; of a batch or a stream.

    The rules in their order: extension, size, what ingest says of its header, duration. The limit of the size is a filter on
    ``length`` that the source takes, so contents beyond it aren't read.
    """
    extension, size = _listed(settings)
    opened = _opened(files.where(~size & ~extension), settings)
    closed = files.drop("content").where(size | extension)
    known = {"path": F.col("path"), "filename": F.regexp_extract("path", r"([^/]+)$", 1), "file_size": F.col("length"), "rejection": F.when(extension, "extension").otherwise("size"), "arrived": F.col("modificationTime")}
    kinds = dict(opened.dtypes)
    rest = closed.select(*[known.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in VERDICT])
    return opened.select(*VERDICT).unionByName(rest)


def _opened(files: DataFrame, settings: Settings) -> DataFrame:
    """The files of which a header is read."""
    told = files.select("path", "length", "content", F.col("modificationTime").alias("arrived"), F.sha2("content", 256).alias("digest"))
    found = ingest(told, keep=("arrived", "digest"))
    return found.withColumn("rejection", F.coalesce("error", F.when(F.col("duration") > settings.max_duration, "duration")))


def verdicts_of_notes(notes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``verdicts`` of files by their ``path``, of a batch or a stream; a file that is gone cannot be opened.

    Each file is looked up and read once, in the task that has its path; no folder is listed.
    """
    extension, size = _listed(settings)
    files = read_by_path(notes.select("path", (~extension).alias("wanted")), settings.max_upload_mb * 1024 * 1024)
    found = ingest(files.withColumnRenamed("modificationTime", "arrived"), keep=("arrived", "digest", "length"))
    known = F.when(extension, "extension").when(size, "size")
    return found.withColumn("rejection", F.coalesce(known, "error", F.when(F.col("duration") > settings.max_duration, "duration"))).select(*VERDICT)


#: Bytes of files that a batch takes, about; one file at least.
BATCH_BYTES = 256 << 20


def arriving(spark: SparkSession, folder: str, files_a_batch: int | None = None, bytes_a_batch: int = BATCH_BYTES) -> DataFrame:
    """The files of a folder and its folders as they come, as binaryFile rows; a batch is bounded by its bytes, or by ``files_a_batch``.

    A batch costs about a second whatever is in it, so many small files shouldn't be many batches.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    bound = ("maxBytesPerTrigger", bytes_a_batch) if files_a_batch is None else ("maxFilesPerTrigger", files_a_batch)
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option(*bound).load(folder)


def announced(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of files as they come, for verdicts_of_notes: rows (path) of the Parquet tables that whoever writes the files leaves in ``folder``.

    Unlike ``arriving`` it lists no folder of uploads. Spark lists one when the stream is made, when it starts and for each batch's files,
    about a millisecond a folder each time, and reads a task for some 30 small files.
    """
    return spark.readStream.schema("path string").parquet(folder)


def accepted(found: DataFrame, delay: str = "1 day") -> DataFrame:
    """Jobs (JOB) of the verdicts of a stream: files that are taken, a content that comes again within ``delay`` of its first time once.

    A job's id is made of its content's digest, so a restart or a second stream gives the same one.
    """
    taken = found.where(F.col("rejection").isNull()).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["digest"])
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    return taken.select(number.alias("id"), *[part.split()[0] for part in JOB.split(", ")[1:]])


def take_uploads(spark: SparkSession, folder: str, inbox: str, progress: str, settings: Settings = DEFAULT, delay: str = "1 day", interval: str | None = "1 second") -> StreamingQuery:
    """Writes a job file to ``inbox``, where poll_jobs finds it, for each upload to ``folder`` that is taken.

    Runs until it is stopped, looking every ``interval``; with None it ends when it has taken all that there is.
    """
    jobs = accepted(verdicts(arriving(spark, folder), settings), delay)
    when = {"processingTime": interval} if interval else {"availableNow": True}
    return jobs.writeStream.format("json").option("path", inbox).option("checkpointLocation", progress).outputMode("append").trigger(**when).start()


def moved(jobs: DataFrame, root: str) -> DataFrame:
    """(id, path): jobs (id, path) with their files moved to ``root``/jobs/<id>/original.<suffix>, as a worker does before its work.

    Files move where the rows are, within one file system that Arrow knows. A file that was moved before, by a task that was
    lost since, stays where it is; one that is in neither place is an error.
    """
    place = F.concat(F.lit(f"{root}/jobs/"), F.col("id").cast("string"))
    asked = jobs.select("id", "path", place.alias("folder"), F.concat(F.lit("original."), S.suffix(F.col("path"))).alias("name"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            paths = []
            for source, folder, name in zip(pdf["path"], pdf["folder"], pdf["name"], strict=True):
                system, at = located(source)
                to = located(f"{folder}/{name}")[1]
                if system.get_file_info(at).type == fs.FileType.File:
                    system.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    system.move(at, to)
                elif system.get_file_info(to).type != fs.FileType.File:
                    raise FileNotFoundError(source)
                paths.append(f"{folder}/{name}")
            yield pd.DataFrame({"id": pdf["id"], "path": paths})

    return asked.mapInPandas(work, "id long, path string")
