"""Queries over what is stored: images made of the given tables' numbers as videos, their pixels, and a job store in buckets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut, shared_folder
from ..operators import kernels as K
from ..sources import tables as T
from ..sources import video as V
from ..sources.files import ingest
from ..sources.store import JobStore
from .queries import LATEST_SQL, POSITION_SQL, SQL, listed_jobs, query, transitions, with_sql

HEIGHT, WIDTH, FPS = 4, 5, 8.0
PIXELS = HEIGHT * WIDTH * 3


def byte_at(i: Column) -> Column:
    """Byte ``i`` of a frame's image: rows from the top, blue, green and red of each pixel."""
    return (F.col("frame_index") * 31 + i * (7 + F.col("frame_index") % 5) + F.floor("signal").cast("bigint")) % 256


BYTE_SQL = "((frame_index * 31 + i * (7 + frame_index % 5) + CAST(floor(signal) AS BIGINT)) % 256)"
PIXELS_SQL = f"bytes AS (SELECT video_id, pos, i, {BYTE_SQL} AS v FROM numbered, range({PIXELS}) r(i))"


def images(spark, sf_dir, byte: Callable[[Column], Column] = byte_at) -> DataFrame:
    """(video_id, frame_index, ts, image) with images of HEIGHT x WIDTH made of the frames' numbers; expressions of the JVM only."""
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIXELS - 1)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))
    image = F.struct(F.lit("").alias("origin"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(3).alias("nChannels"), F.lit(V.BGR_MODE).alias("mode"), data.alias("data"))
    return T.frames(spark, sf_dir).where(F.col("signal").isNotNull()).select("video_id", "frame_index", "ts", image.alias("image"))


def as_videos(spark, sf_dir) -> str:
    """Writes the images as AVI files; the folder."""
    folder = f"{shared_folder(spark)}/videos-{uuid.uuid4().hex}"
    V.write_videos(images(spark, sf_dir), folder, FPS).write.format("noop").mode("overwrite").save()
    return folder


def announced_videos(spark, sf_dir) -> str:
    """Writes the images as AVI files; the folder of the notes that tell their paths."""
    shared, name = shared_folder(spark), uuid.uuid4().hex
    notes = f"{shared}/notes-{name}"
    V.write_videos(images(spark, sf_dir), f"{shared}/videos-{name}", FPS).select("path").write.parquet(notes)
    return notes


def written_videos(spark, sf_dir) -> DataFrame:
    """Writes the images as AVI files; (video_id, path, frames) of the files."""
    return cut(V.write_videos(images(spark, sf_dir), f"{shared_folder(spark)}/videos-{uuid.uuid4().hex}", FPS))


def checksum(data: Column) -> Column:
    """The sum of a binary's bytes, each times its place from 1."""
    return F.aggregate(F.sequence(F.lit(1), F.length(data)), F.lit(0).cast("bigint"), lambda s, i: s + i * F.conv(F.hex(data.substr(i, F.lit(1))), 16, 10).cast("bigint"))


@query(
    with_sql(
        T.FRAMES_SQL, POSITION_SQL, PIXELS_SQL,
        select=f"SELECT video_id, CAST(pos AS BIGINT) AS frame_index, round(pos / {FPS}, 6) AS ts, {HEIGHT} AS height, {WIDTH} AS width, CAST(sum((i + 1) * v) AS BIGINT) AS checksum FROM bytes WHERE pos % 3 = 0 AND pos >= 6 AND pos < 60 GROUP BY ALL",
    )
)
def video_scan(spark, sf_dir):
    """Every third frame of a range of frames, read from video files by the reader alone."""
    chunks = V.video_chunks(spark, as_videos(spark, sf_dir), every=3).where((F.col("frame_index") >= 6) & (F.col("frame_index") < 60))
    return V.video_frames(chunks).select("video_id", "frame_index", F.round("ts", 6).alias("ts"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), checksum(F.col("image.data")).alias("checksum"))


@query(
    with_sql(
        T.FRAMES_SQL, POSITION_SQL,
        select=f"SELECT video_id, CAST(pos AS BIGINT) AS frame_index, round(pos / {FPS}, 6) AS ts, CAST({3 * WIDTH + 1} * {HEIGHT} AS BIGINT) AS stored FROM numbered WHERE pos IN (0, 5, 41, 1000000)",
    )
)
def video_lookup(spark, sf_dir):
    """Given frames of every video, one of them in none: other frames aren't read."""
    chunks = V.video_chunks(spark, as_videos(spark, sf_dir)).where(F.col("frame_index").isin(0, 5, 41, 1_000_000))
    return chunks.select("video_id", "frame_index", F.round("ts", 6).alias("ts"), F.length("content").cast("bigint").alias("stored"))


@query(f"SELECT user_id AS video_id, CAST({FPS} AS DOUBLE) AS fps, count(*) AS total_frames, {WIDTH} AS width, {HEIGHT} AS height, 'DIB ' AS codec, count(*) / {FPS} AS duration FROM events WHERE value IS NOT NULL GROUP BY 1")
def video_metadata(spark, sf_dir):
    """What the headers of video files say; their paths are the writer's, as a listing by the driver takes longer than their writing."""
    found = ingest(V.heads(written_videos(spark, sf_dir)))
    return found.where(F.col("error").isNull()).select(F.regexp_extract("path", r"video_id=(\d+)", 1).cast("long").alias("video_id"), "fps", "total_frames", "width", "height", "codec", "duration")


# --- kernels --------------------------------------------------------------------------------------------------------

COLOURS_SQL = f"colours AS (SELECT video_id, frame_index, pos, i // 3 AS p, max(v) FILTER (WHERE i % 3 = 0) AS b, max(v) FILTER (WHERE i % 3 = 1) AS g, max(v) FILTER (WHERE i % 3 = 2) AS r FROM (SELECT video_id, frame_index, pos, i, {BYTE_SQL} AS v FROM numbered, range({PIXELS}) t(i)) GROUP BY ALL)"
GREY_SQL = f"grey AS (SELECT video_id, frame_index, pos, p // {WIDTH} AS y, p % {WIDTH} AS x, (b * 1868 + g * 9617 + r * 4899 + 8192) // 16384 AS v FROM colours)"


@query(
    with_sql(
        T.FRAMES_SQL, POSITION_SQL, COLOURS_SQL, GREY_SQL,
        "steps(dy, dx, w) AS (VALUES (0, 0, -4), (-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1))",
        f"edge AS (SELECT g.*, w, {HEIGHT - 1} - abs({HEIGHT - 1} - abs(g.y + dy)) AS ny, {WIDTH - 1} - abs({WIDTH - 1} - abs(g.x + dx)) AS nx FROM grey g, steps)",
        "lap AS (SELECT e.video_id, e.frame_index, e.y, e.x, sum(e.w * n.v) AS l FROM edge e JOIN grey n ON n.video_id = e.video_id AND n.frame_index = e.frame_index AND n.y = e.ny AND n.x = e.nx GROUP BY ALL)",
        "sharp AS (SELECT video_id, frame_index, var_pop(l) AS s FROM lap GROUP BY ALL)",
        select="SELECT video_id, frame_index, round(avg(v), 6) AS brightness, round(any_value(s), 4) AS sharpness FROM grey JOIN sharp USING (video_id, frame_index) GROUP BY ALL",
    )
)
def pixel_metrics(spark, sf_dir):
    """Brightness and sharpness of each frame's pixels."""
    return K.frame_metrics(images(spark, sf_dir), metrics=("brightness", "sharpness")).select("video_id", "frame_index", F.round("brightness", 6).alias("brightness"), F.round("sharpness", 4).alias("sharpness"))


@query(
    with_sql(
        T.FRAMES_SQL, POSITION_SQL,
        f"bins AS (SELECT video_id, frame_index, i % 3 AS c, {BYTE_SQL} AS v, count(*) AS n FROM numbered, range({PIXELS}) t(i) GROUP BY ALL)",
        "units AS (SELECT video_id, frame_index, c, v, n / sqrt(sum(n * n) OVER (PARTITION BY video_id, frame_index, c)) AS h FROM bins)",
        select="SELECT video_id, frame_index, round(sum(h * (256 * c + v + 1)), 4) AS checksum FROM units GROUP BY ALL",
    )
)
def pixel_histogram(spark, sf_dir):
    """The histogram of each frame's blue, green and red: its 768 numbers, each times its place, summed."""

    @F.pandas_udf("double")
    def compute(frames: pd.DataFrame) -> pd.Series:
        return pd.Series(K.of_stacks(frames, lambda x: K.bgr_histogram(x) @ np.arange(1.0, 769)))

    return images(spark, sf_dir).select("video_id", "frame_index", F.round(compute("image"), 4).alias("checksum"))


@query(
    "WITH RECURSIVE " + ", ".join([
        T.FRAMES_SQL, POSITION_SQL, COLOURS_SQL, GREY_SQL,
        "pics AS (SELECT video_id, pos, frame_index, list(v ORDER BY y, x) AS v FROM grey GROUP BY ALL)",
        "f AS (SELECT video_id, pos, frame_index, v AS last, CAST(0 AS DOUBLE) AS d, true AS kept FROM pics WHERE pos = 0 UNION ALL SELECT video_id, pos, frame_index, CASE WHEN d > 0.35 THEN v ELSE last END, d, d > 0.35 FROM (SELECT n.video_id, n.pos, n.frame_index, n.v, s.last, list_avg(list_transform(list_zip(n.v, s.last), lambda x: abs(x[1] - x[2]))) / 255 AS d FROM f s JOIN pics n ON n.video_id = s.video_id AND n.pos = s.pos + 1))",
    ]) + " SELECT video_id, frame_index, round(d, 6) AS diff_score FROM f WHERE kept"
)
def pixel_redundancy(spark, sf_dir):
    """Frames whose pixels are unlike those of the last kept one of their video."""
    return K.redundancy_filter(images(spark, sf_dir), 0.65, "pixel").select("video_id", "frame_index", F.round("diff_score", 6).alias("diff_score"))


HSV_SQL = (
    "parts AS (SELECT video_id, frame_index, p, b, g, r, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM colours), "
    "hues AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN v = r THEN (g - b) / d WHEN v = g THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END * 60 AS hue FROM parts), "
    "hsv AS (SELECT video_id, frame_index, p, CAST(round_even(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2, 0) AS BIGINT) % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE CAST(round_even(d / v * 255, 0) AS BIGINT) END AS s, v FROM hues)"
)


def _entropy_sql(name: str, value: str) -> str:
    return f"{name} AS (SELECT video_id, frame_index, -sum(q * log2(q + 1e-10)) AS e FROM (SELECT video_id, frame_index, {value} AS bin, count(*) / ({HEIGHT * WIDTH} + 1e-10) AS q FROM hsv GROUP BY ALL) GROUP BY ALL)"


@query(
    with_sql(
        T.FRAMES_SQL, POSITION_SQL, COLOURS_SQL, HSV_SQL, _entropy_sql("eh", "h * 30 // 180"), _entropy_sql("es", "s * 16 // 256"),
        f"sums AS (SELECT video_id, frame_index, avg(h * 32 // 180 + 1) + avg(s * 4 // 256 + 33) + avg(v * 2 // 256 + 37) AS colours, avg(h * 64 // 180 + 1) + avg(s * 64 // 256 + 65) AS scene FROM hsv GROUP BY ALL)",
        select="SELECT video_id, frame_index, round(colours, 6) AS colours, round(scene, 6) AS scene, round((eh.e + es.e) / 2, 6) AS entropy FROM sums JOIN eh USING (video_id, frame_index) JOIN es USING (video_id, frame_index)",
    )
)
def pixel_colours(spark, sf_dir):
    """Of each frame the 38 colour features and the 128 numbers of scenes, each times its place and summed, and the colour entropy."""

    @F.pandas_udf("colours double, scene double, entropy double")
    def compute(frames: pd.DataFrame) -> pd.DataFrame:
        def made(x: np.ndarray) -> np.ndarray:
            c = K.hsv(x)
            return np.stack([K.hsv_features(c) @ np.arange(1.0, 39), K.hsv_features(c, K.SCENE_BINS)[..., :128] @ np.arange(1.0, 129), K.hsv_entropy(c)], axis=-1)

        return pd.DataFrame(K.of_stacks(frames, made), columns=["colours", "scene", "entropy"])

    found = images(spark, sf_dir).select("video_id", "frame_index", compute("image").alias("m"))
    return found.select("video_id", "frame_index", *(F.round(f"m.{c}", 6).alias(c) for c in ("colours", "scene", "entropy")))


GAUSS = 21  # pixels of the blur that a frame is compared with, mirrored at its borders


def _mirrored(n: int, at: str) -> str:
    """The row of n that stands at any place when rows are mirrored with their edges, again and again."""
    around = f"((({at}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CASE WHEN {around} < {n} THEN {around} ELSE {2 * n - 1} - {around} END"


@query(
    with_sql(
        T.FRAMES_SQL, POSITION_SQL, COLOURS_SQL.replace(BYTE_SQL, f"100 + {BYTE_SQL} % 40"), GREY_SQL,
        f"taps AS (SELECT k, exp(-(k * k) / (2 * s * s)) / sum(exp(-(k * k) / (2 * s * s))) OVER () AS w FROM (SELECT k, 0.3 * (({GAUSS} - 1) * 0.5 - 1) + 0.8 AS s FROM range({-(GAUSS // 2)}, {GAUSS // 2 + 1}) t(k)))",
        f"across AS (SELECT a.video_id, a.frame_index, a.y, a.x, any_value(a.v) AS v, sum(w * n.v) AS u FROM grey a, taps JOIN grey n ON n.video_id = a.video_id AND n.frame_index = a.frame_index AND n.y = a.y AND n.x = {_mirrored(WIDTH, 'a.x + k')} GROUP BY ALL)",
        f"down AS (SELECT a.video_id, a.frame_index, a.y, a.x, any_value(a.v) AS v, sum(w * n.u) AS u FROM across a, taps JOIN across n ON n.video_id = a.video_id AND n.frame_index = a.frame_index AND n.x = a.x AND n.y = {_mirrored(HEIGHT, 'a.y + k')} GROUP BY ALL)",
        select=f"SELECT video_id, frame_index, count(*) FILTER (WHERE abs(v - u) < 10) > 0.6 * {HEIGHT * WIDTH} AS uniform FROM down GROUP BY ALL",
    )
)
def pixel_uniform(spark, sf_dir):
    """Whether most pixels of a frame lie close to their surroundings; images with less contrast than the others', so that some do."""
    @F.pandas_udf("boolean")
    def compute(pictures: pd.DataFrame) -> pd.Series:
        return pd.Series(K.of_stacks(pictures, K.is_uniform))

    soft = images(spark, sf_dir, lambda i: 100 + byte_at(i) % 40)
    return soft.select("video_id", "frame_index", compute("image").alias("uniform"))


# --- the bucketed store ---------------------------------------------------------------------------------------------


@query(LATEST_SQL)
def stored_job_state(spark, sf_dir):
    """Jobs' states from a store to which transitions came in three parts, compacted after the second."""
    kept = JobStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", 16)
    for k in range(3):
        kept.append(transitions(spark, sf_dir).where(F.pmod("seq", F.lit(3)) == k))
        if k == 1:
            kept.compact()
    return kept.state()


@query(SQL.get("job_list_nested"))
def stored_job_list(spark, sf_dir):
    """The list of jobs from tables in buckets by job."""
    kept = JobStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", 16)
    kept.put_jobs(T.jobs(spark, sf_dir))
    kept.put_keyframes(T.keyframes(spark, sf_dir))
    return listed_jobs(kept.job_list(T.videos(spark, sf_dir)))
