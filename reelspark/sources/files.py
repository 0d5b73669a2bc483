"""Files in and out: image folders, uploads, summary documents, the job store on Parquet, exports."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import scalars as S
from ..operators.jobs import gate
from ..schemas import SUMMARY, migrate
from .jpeg import jpeg
from .matroska import MAGIC, matroska_header


def image_frames(spark: SparkSession, folder: str, fps: float) -> DataFrame:
    """(video_id, frame_index, ts, image) from folder/video_id=N/frame_<index>.*: pixels are decoded where the file is read."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder)
    origin = F.col("image.origin")
    index = F.regexp_extract(origin, r"_(\d+)\.\w+$", 1).try_cast("bigint")
    video = F.regexp_extract(origin, r"video_id=(\d+)", 1).try_cast("bigint")
    return images.select(video.alias("video_id"), index.alias("frame_index"), F.when(F.lit(fps) > 0, index / F.lit(fps or 1.0)).otherwise(0.0).alias("ts"), "image").where(F.col("frame_index").isNotNull())


def ingest(files: DataFrame, probe: Callable[[bytes], tuple[float, int, int, int, int]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata of binaryFile rows: filename, fps, total_frames, width, height, codec, duration, and why a file is unusable.

    ``probe`` gives (fps, frames, width, height, fourcc) of a file's bytes; without one, headers of AVI, MP4, Matroska and WebM files are read.
    Columns to ``keep`` are carried.
    """
    reader = probe or container_header

    @F.pandas_udf("fps double, total_frames long, width int, height int, fourcc long")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((None,) * 5 if c is None else reader(bytes(c)))
            except (ValueError, struct.error):
                rows.append((None, None, None, None, None))
        return pd.DataFrame(rows, columns=["fps", "total_frames", "width", "height", "fourcc"]).astype({"fps": "float64", "total_frames": "Int64", "width": "Int32", "height": "Int32", "fourcc": "Int64"})

    m = files.withColumn("m", read("content")).select("path", F.col("length").alias("file_size"), "m.*", *keep)
    bad = S.first_match((F.col("fps").isNull(), "cannot be opened"), ((F.col("fps") <= 0) | (F.col("total_frames") <= 0), "no frames"))
    return m.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "path", "file_size", "fps", "total_frames", "width", "height", S.fourcc(F.col("fourcc")).alias("codec"), F.try_divide(F.col("total_frames"), F.col("fps")).alias("duration"), bad.alias("error"), *keep,
    )


def avi_header(content: bytes) -> tuple[float, int, int, int, int]:
    """(fps, frames, width, height, fourcc) of an AVI file's main header."""
    if content[:4] != b"RIFF" or content[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at = content.index(b"avih") + 8
    per_frame, frames, width, height = struct.unpack_from("<I", content, at)[0], *struct.unpack_from("<I", content, at + 16), *struct.unpack_from("<II", content, at + 32)
    handler = content.find(b"vids")
    code = struct.unpack_from("<I", content, handler + 4)[0] if handler >= 0 else 0
    return (1e6 / per_frame if per_frame else 0.0), frames, width, height, code


def container_header(content: bytes) -> tuple[float, int, int, int, int]:
    """(fps, frames, width, height, fourcc) by the kind of the file."""
    if content[:4] == MAGIC:
        return matroska_header(content)
    return avi_header(content) if content[:4] == b"RIFF" else mp4_header(content)


def _boxes(content: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes of an MP4 file between two places."""
    while start + 8 <= end:
        size, kind, head = struct.unpack_from(">I", content, start)[0], content[start + 4 : start + 8], 8
        if size == 1:
            size, head = struct.unpack_from(">Q", content, start + 8)[0], 16
        stop = end if size == 0 else start + size
        if size and size < head or stop > end:
            raise ValueError("broken box")
        yield kind, start + head, stop
        start = stop


def _inside(content: bytes, start: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """Where the first box at the end of a path of nested boxes lies."""
    for kind, a, b in _boxes(content, start, end):
        if kind == path[0]:
            return _inside(content, a, b, *path[1:]) if len(path) > 1 else (a, b)
    return None


def mp4_header(content: bytes) -> tuple[float, int, int, int, int]:
    """(fps, frames, width, height, fourcc) of an MP4 file's first video track."""
    movie = _inside(content, 0, len(content), b"moov") if content[4:8] == b"ftyp" else None
    for kind, a, b in _boxes(content, *movie) if movie else ():
        handler = _inside(content, a, b, b"mdia", b"hdlr") if kind == b"trak" else None
        if handler is None or content[handler[0] + 8 : handler[0] + 12] != b"vide":
            continue
        head, track = _inside(content, a, b, b"mdia", b"mdhd"), _inside(content, a, b, b"tkhd")
        sizes, kinds = (_inside(content, a, b, b"mdia", b"minf", b"stbl", k) for k in (b"stsz", b"stsd"))
        if None in (head, track, sizes, kinds):
            break
        long_form = content[head[0]] == 1
        scale, length = struct.unpack_from(">IQ" if long_form else ">II", content, head[0] + (20 if long_form else 12))
        frames = struct.unpack_from(">I", content, sizes[0] + 8)[0]
        width, height = (x >> 16 for x in struct.unpack_from(">II", content, track[1] - 8))
        code = struct.unpack_from("<I", content, kinds[0] + 12)[0]
        return (frames * scale / length if length else 0.0), frames, width, height, code
    raise ValueError("no video track")


def uploads(spark: SparkSession, folder: str, settings: Settings = DEFAULT) -> DataFrame:
    """Files of a folder with why each isn't taken; sizes come from the listing, contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    rules = [(~S.suffix(F.col("path")).isin(*settings.extensions), "extension"), (F.col("length") > settings.max_upload_mb * 1024 * 1024, "size")]
    return files.withColumn("rejection", S.first_match(*rules))


def summaries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Summary documents of any generation; what is missing is null, a broken document has _corrupt_record."""
    return spark.read.schema(SUMMARY).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)


def summary_view(documents: DataFrame) -> DataFrame:
    """What a client sees of a summary."""
    return documents.where(F.col("_corrupt_record").isNull()).select("job_id", "video_filename", F.col("num_clusters").alias("num_keyframes"), F.col("grid_path").isNotNull().alias("has_grid"), "video_pacing", "summary_confidence", "compression_ratio", "redundancy_removed", "temporal_coverage_score", "keyframes")


def write_summaries(df: DataFrame, folder: str) -> None:
    """JSON documents by job, complete or not there at all."""
    df.write.mode("overwrite").partitionBy("job_id").json(folder)


def append(df: DataFrame, folder: str, schema: str) -> None:
    """Rows to a table of the job store in its current schema; older rows are read as if they had the new columns."""
    migrate(df, schema).write.mode("append").parquet(folder)


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return migrate(spark.read.option("mergeSchema", True).parquet(folder), schema)


def png(bgr: np.ndarray) -> bytes:
    """A PNG file of an image."""
    h, w = bgr.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), bgr[..., ::-1].reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 3)) + part(b"IEND", b"")


def encoder(kind: str, quality: int = 95) -> Callable[[np.ndarray], bytes]:
    """Makes files of images: png, or jpg of a quality from 1 to 100."""
    if kind not in ("png", "jpg"):
        raise ValueError(f"unknown kind {kind}")
    return png if kind == "png" else lambda bgr: jpeg(bgr, quality)


def encoded_keyframes(keyframes: DataFrame, image: str = "image", kind: str = "png", quality: int = 95) -> DataFrame:
    """(job_id, index, name, content): numbered files in the order of time, PNG or JPEG, as rows that any binary sink takes."""
    from ..operators.kernels import to_array

    made = encoder(kind, quality)

    @F.pandas_udf("binary")
    def encode(images: pd.DataFrame) -> pd.Series:
        return pd.Series([made(to_array(i)) for _, i in images.iterrows()])

    numbered = keyframes.withColumn("index", F.row_number().over(W.partitionBy("job_id").orderBy("ts", "frame_index")))
    return numbered.select("job_id", "index", S.keyframe_name(F.col("index"), kind).alias("name"), encode(image).alias("content"))


# The rows of 3 x 5 glyphs, a bit a pixel.
GLYPHS = {
    "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 7, 1, 7), "4": (5, 5, 7, 1, 1), "5": (7, 4, 7, 1, 7),
    "6": (7, 4, 7, 5, 7), "7": (7, 1, 1, 2, 2), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7), ":": (0, 2, 0, 2, 0), "#": (5, 7, 5, 7, 5),
}


def write_text(image: np.ndarray, text: str, x: int, y: int, scale: int) -> None:
    """Draws digits, colons and # in white, their upper left corner at (x, y); what lies outside is cut off."""
    for k, c in enumerate(text):
        for row, bits in enumerate(GLYPHS[c]):
            for column in range(3):
                if bits >> (2 - column) & 1:
                    top, left = y + row * scale, x + (4 * k + column) * scale
                    image[top : top + scale, left : left + scale] = 255


def board(images: list[np.ndarray], times: list[float], columns: int = 4, width: int = 400, padding: int = 10, background: int = 30, bar: int = 30) -> np.ndarray:
    """Frames row by row in a grid of ``columns``, each with its number and, on a dark bar, its time."""
    from ..operators.kernels import resize

    h, w = images[0].shape[:2]
    tw = min(w, width)
    th = int(tw * h / w)
    rows = -(-len(images) // columns)
    out = np.full((padding + rows * (th + padding), padding + columns * (tw + padding), 3), background, np.uint8)
    for k, (image, ts) in enumerate(zip(images, times, strict=True)):
        y, x = padding + k // columns * (th + padding), padding + k % columns * (tw + padding)
        thumb = np.round(resize(image.astype(float), th, tw)).astype(np.uint8)
        thumb[max(0, th - bar) :] = 0
        write_text(thumb, f"#{k + 1}", 5, 8, 3)
        write_text(thumb, f"{int(ts // 60):02d}:{int(ts % 60):02d}", 5, max(0, th - 22), 3)
        out[y : y + th, x : x + tw] = thumb
    return out


def storyboards(keyframes: DataFrame, columns: int = 4, width: int = 400, padding: int = 10, background: int = 30, image: str = "image", kind: str = "png", quality: int = 95) -> DataFrame:
    """(job_id, content): one file per job, PNG or JPEG, with its keyframes in a grid, row by row, numbered and with their times."""
    from ..operators.kernels import to_array

    encode = encoder(kind, quality)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "frame_index"])
        made = board([to_array(i) for i in pdf[image]], pdf["ts"].tolist(), columns, width, padding, background)
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "content": [encode(made)]})

    return keyframes.select("job_id", "ts", "frame_index", image).groupBy("job_id").applyInPandas(one, "job_id long, content binary")


def export_zip(files: Iterable[tuple[str, bytes]]) -> bytes:
    """One job's files as a ZIP archive in the order of names; a job's summary is bounded by its number of keyframes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in sorted(files):
            z.writestr(name, content)
    return out.getvalue()


def export_listing(files: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Of files (job_id, name, ...) those that an archive has: all keyframes and a job's first storyboard by format."""
    rank = F.array_position(F.array(*map(F.lit, settings.image_formats)), S.suffix(F.col("name")))
    board_rank = F.when((S.stem(F.col("name")) == "storyboard") & (rank > 0), rank)
    best = F.min(board_rank).over(W.partitionBy("job_id"))
    return files.where(F.col("name").startswith("keyframe_") | (S.stem(F.col("name")) == "storyboard")).withColumns({"_rank": board_rank, "_best": best}).where(F.col("name").startswith("keyframe_") | (F.col("_rank") == F.col("_best"))).drop("_rank", "_best")


def export_job(jobs: DataFrame, files: DataFrame, job_id: int, settings: Settings = DEFAULT) -> tuple[int, str | None, bytes | None]:
    """(code, archive name, archive) of a job's summary files (job_id, name, content); 404 without the job, 400 before its end.

    ``jobs`` has id, status and filename. One job's files come to the driver, which a summary's keyframes bound.
    """
    (answer,) = gate(jobs.sparkSession.createDataFrame([(job_id,)], "id long"), jobs).select("code").collect()
    if answer.code != 200:
        return answer.code, None, None
    name = jobs.where(F.col("id") == job_id).select(F.concat(S.stem(F.col("filename")), F.lit("_keyframes.zip")).alias("n")).first().n
    listed = export_listing(files.where(F.col("job_id") == job_id), settings).select("name", "content").collect()
    return 200, name, export_zip((r.name, bytes(r.content)) for r in listed)


def extractor_info(spark: SparkSession, features: str = "combined", size: int = 182, fallback: bool = True) -> DataFrame:
    """One row: what features are made of here; networks aren't at hand, so their vectors are input columns."""
    return spark.createDataFrame([(features, size, "cpu", fallback, False, False)], "model string, feature_dim int, device string, using_fallback boolean, torch_available boolean, clip_available boolean")


def job_folder(root: str, job_id: Column, part: str) -> Column:
    """Where a job keeps frames, filtered_frames or its summary."""
    if part not in ("frames", "filtered_frames", "summary"):
        raise ValueError(f"unknown part {part}")
    return F.concat(F.lit(f"{root}/jobs/"), job_id.cast("string"), F.lit(f"/{part}"))
