"""One query per operator over the generic tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, PROGRESS
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import clustering, jobs, kmeans, scoring, timeline
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


# --- scans and projections ------------------------------------------------------------------------------------------

POSITION_SQL = "numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts, frame_index) - 1 AS pos FROM frames)"


@query(with_sql(T.FRAMES_SQL, POSITION_SQL, select="SELECT video_id, frame_index, round(ts, 6) AS ts, pos FROM numbered WHERE pos % 5 = 0"))
def frame_stride(spark, sf_dir):
    return timeline.stride(T.frames(spark, sf_dir), 5).select("video_id", "frame_index", F.round("ts", 6).alias("ts"), "pos")


@query(with_sql(T.FRAMES_SQL, POSITION_SQL, select="SELECT video_id, CAST(pos // 16 AS BIGINT) AS batch, count(*) AS n, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM numbered GROUP BY 1, 2"))
def frame_batches(spark, sf_dir):
    return timeline.batches(T.frames(spark, sf_dir), 16).groupBy("video_id", "batch").agg(F.count("*").alias("n"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


@query(with_sql(T.FRAMES_SQL, select="SELECT video_id, frame_index, signal FROM frames WHERE frame_index IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def frames_by_index(spark, sf_dir):
    wanted = T.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame_index"))
    return timeline.by_index(T.frames(spark, sf_dir), wanted).select("video_id", "frame_index", "signal")


@query(
    with_sql(
        T.FRAMES_SQL, POSITION_SQL, "asked AS (SELECT o_orderkey AS request, o_custkey AS video_id, (o_orderkey % 1000) * 7.5 AS asked_ts FROM orders)",
        select="SELECT request, video_id, CAST(asked_ts AS DOUBLE) AS ts, frame_index FROM asked JOIN numbered USING (video_id) WHERE pos = CAST(floor(asked_ts * 0.01) AS BIGINT)",
    )
)
def frame_at_ts(spark, sf_dir):
    asked = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("video_id"), ((F.col("o_orderkey") % 1000) * 7.5).alias("asked_ts"))
    return timeline.at_time(T.frames(spark, sf_dir), asked, 0.01).select("request", "video_id", "ts", "frame_index")


@query(with_sql(T.FRAMES_SQL, select="SELECT video_id, count(*) AS kept FROM frames WHERE ts >= 3.0 GROUP BY 1"))
def skip_intro(spark, sf_dir):
    return T.frames(spark, sf_dir).where(F.col("ts") >= DEFAULT.skip_intro).groupBy("video_id").agg(F.count("*").alias("kept"))


@query(with_sql(T.FRAMES_SQL, select="SELECT video_id, frame_index, signal FROM frames WHERE ts >= 3.0 AND signal >= 25 AND signal * 1.5 >= 30"))
def quality_gate(spark, sf_dir):
    f = T.frames(spark, sf_dir).withColumn("sharpness", F.col("signal") * 1.5)
    return timeline.quality_gate(f, "signal", "sharpness").select("video_id", "frame_index", "signal")


@query("SELECT o_orderkey AS id, printf('%02d:%02d', CAST(floor(o_totalprice / 60) AS BIGINT), CAST(floor(o_totalprice) AS BIGINT) % 60) AS mmss, printf('%d:%02d', CAST(floor(o_totalprice / 60) AS BIGINT), CAST(floor(o_totalprice) AS BIGINT) % 60) AS short FROM orders")
def timestamp_format(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.format_timestamp(F.col("o_totalprice")).alias("mmss"), S.format_duration(F.col("o_totalprice")).alias("short"))


@query("SELECT p_partkey AS id, CASE WHEN p_size * 70000 < 1048576 THEN printf('%.1f KB', p_size * 70000 / 1024.0) ELSE printf('%.1f MB', p_size * 70000 / 1048576.0) END AS size FROM part")
def size_format(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.format_size(F.col("p_size") * 70000).alias("size"))


@query(r"SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\.([^./\\]+)$', 1)) AS suffix, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/\\]*?)(\.[^./\\]*)?$', 1) AS stem FROM pages")
def file_names(spark, sf_dir):
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return T.table(spark, sf_dir, "pages").select("page_id", S.suffix(path).alias("suffix"), S.stem(path).alias("stem"))


@query("SELECT p_partkey AS id, printf('keyframe_%03d.jpg', p_partkey) AS name FROM part")
def keyframe_names(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.keyframe_name(F.col("p_partkey")).alias("name"))


def _bytes_sql(most: str) -> str:
    return f"list_sum(list_transform(range(1, {most} + 1), lambda i: ascii(substr(raw, i, 1)) * CAST(power(256, i - 1) AS HUGEINT)))"


@query(
    with_sql(
        "r AS (SELECT c_custkey AS id, substr(c_name, CAST(1 + c_custkey % 7 AS INT), CAST(c_custkey % 11 AS INT)) AS raw FROM customer)",
        select=f"SELECT id, CAST(CASE WHEN length(raw) BETWEEN 4 AND 8 THEN {_bytes_sql('length(raw)')} ELSE -1 END AS BIGINT) AS stored, CAST(CASE WHEN length(raw) >= 4 THEN {_bytes_sql('4')} ELSE 0 END AS BIGINT) AS shown FROM r",
    )
)
def safe_int_of_bytes(spark, sf_dir):
    raw = F.substring("c_name", (1 + F.col("c_custkey") % 7).cast("int"), (F.col("c_custkey") % 11).cast("int")).cast("binary")
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.safe_int_bytes(raw, -1).alias("stored"), S.safe_int_bytes(raw, most=4).alias("shown"))


@query("SELECT event_id, coalesce(try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) AS k, coalesce(try_cast(event_type AS BIGINT), 0) AS none FROM events")
def safe_int(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", S.safe_int(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"), S.safe_int(F.col("event_type")).alias("none"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' AS made FROM events")
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    return T.table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(parsed["k"].alias("k"), F.col("event_type").alias("type"))).alias("made"))


@query("SELECT p_partkey AS id, chr(CAST(97 + p_partkey % 26 AS INT)) || chr(CAST(97 + p_size % 26 AS INT)) || chr(CAST(48 + p_partkey % 10 AS INT)) || 'x' AS codec FROM part")
def fourcc(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    code = (97 + F.col("p_partkey") % 26) + (97 + F.col("p_size") % 26) * 256 + (48 + F.col("p_partkey") % 10) * 65536 + F.lit(ord("x") * 16777216)
    return p.select(F.col("p_partkey").alias("id"), S.fourcc(code.cast("bigint")).alias("codec"))


@query("SELECT l_orderkey, l_linenumber, CAST(10 + ((l_linenumber - 1) % 4) * 410 AS BIGINT) AS x, CAST(10 + floor((l_linenumber - 1) / 4) * (l_quantity + 10) AS BIGINT) AS y FROM lineitem")
def grid_geometry(spark, sf_dir):
    x, y = S.grid(F.col("l_linenumber"), 4, F.lit(400), F.col("l_quantity"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


_NAMES = [*PROGRESS, "unknown"]
_NAMED_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + f"][CAST(event_id % {len(_NAMES)} AS INT) + 1]"


def named_state(number: Column) -> Column:
    """One of all states and an unknown one."""
    return F.element_at(F.array(*map(F.lit, _NAMES)), (number % len(_NAMES) + 1).cast("int"))


@query(f"SELECT event_id, CAST(CASE {_NAMED_SQL} " + " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in PROGRESS.items()) + " ELSE 0.0 END AS DOUBLE) AS progress FROM events")
def progress_map(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", S.progress(named_state(F.col("event_id"))).alias("progress"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(trim(text)), '[ \t\n\r]+'), lambda x: length(x) > 3)[1:4] AS w FROM documents)
    SELECT doc_id, array_to_string(list_transform(w, lambda x: replace(upper(left(x, 1)), 'ẞ', 'SS') || lower(substr(x, 2))), '|') AS tags FROM w"""
)
def caption_tags(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.caption_tags(F.col("text")), "|").alias("tags"))


@query("SELECT item_id, replace(upper(left(text, 1)), 'ẞ', 'SS') || lower(substr(text, 2)) AS caption FROM benchmark")
def caption_case(spark, sf_dir):
    return T.table(spark, sf_dir, "benchmark").select("item_id", S.capitalize(F.col("text")).alias("caption"))


# --- job store ------------------------------------------------------------------------------------------------------


def _store(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    return T.jobs(spark, sf_dir), T.videos(spark, sf_dir), T.keyframes(spark, sf_dir)


@query(with_sql(T.JOBS_SQL, T.VIDEOS_SQL, select="SELECT j.id, j.video_id, status, filename, duration, total_frames FROM jobs j JOIN videos v ON j.video_id = v.id"))
def job_with_video(spark, sf_dir):
    j, v, _ = _store(spark, sf_dir)
    return jobs.with_video(j, v).select("id", "video_id", "status", "filename", "duration", "total_frames")


@query(
    with_sql(
        T.JOBS_SQL, T.VIDEOS_SQL, T.KEYFRAMES_SQL, "k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY timestamp, frame_index, cluster_id) AS i FROM keyframes)",
        "n AS (SELECT job_id, count(*) AS n, string_agg(i || ':' || frame_index || ':' || printf('%02d:%02d', CAST(floor(timestamp / 60) AS BIGINT), CAST(floor(timestamp) AS BIGINT) % 60) || ':0.8:MEDIUM', '|' ORDER BY i) AS listed FROM k GROUP BY 1)",
        select="SELECT j.id, filename, CASE WHEN coalesce(clusters_found, 0) = 0 AND coalesce(n, 0) > 0 THEN n ELSE coalesce(clusters_found, 0) END AS num_keyframes, coalesce(listed, '') AS keyframes FROM jobs j JOIN videos v ON j.video_id = v.id LEFT JOIN n ON n.job_id = j.id",
    )
)
def job_list_nested(spark, sf_dir):
    return listed_jobs(jobs.job_list(*_store(spark, sf_dir)))


def listed_jobs(found: DataFrame) -> DataFrame:
    """A list of jobs with its keyframes as text."""
    one = lambda x: F.concat_ws(":", x["index"].cast("string"), x["frame_index"].cast("string"), x["timestamp_formatted"], x["importance_score"].cast("string"), x["importance_confidence"])
    listed = F.array_join(F.transform(F.coalesce("keyframes", F.array()), one), "|")
    return found.select("id", "filename", "num_keyframes", listed.alias("keyframes"))


@query(with_sql(T.JOBS_SQL, select="SELECT id, video_id, created_at FROM jobs WHERE status = 'pending' ORDER BY created_at, id LIMIT 1"))
def next_pending_job(spark, sf_dir):
    return jobs.next_pending(T.jobs(spark, sf_dir)).select("id", "video_id", "created_at")


_STATES = {"view": "uploaded", "click": "extracting_frames", "signup": "clustering", "purchase": "completed", "error": "failed"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " ELSE 'pending' END"


def transitions(spark, sf_dir) -> DataFrame:
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv]), F.col("event_type")), F.lit("pending"))
    return T.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("status"), F.col("props").alias("message"))


_PROGRESS_SQL = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in PROGRESS.items()) + " ELSE 0.0 END"
LATEST_SQL = with_sql(
    f"t AS (SELECT user_id AS job_id, ts AS \"at\", event_id AS seq, {_STATE_SQL} AS status, props AS message FROM events)",
    "r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY \"at\" DESC, seq DESC) AS r, row_number() OVER (PARTITION BY job_id, status = 'failed' ORDER BY \"at\" DESC, seq DESC) AS o FROM t)",
    select=f"SELECT job_id, max(CASE WHEN r = 1 THEN status END) AS status, CAST(coalesce(max(CASE WHEN o = 1 AND status <> 'failed' THEN {_PROGRESS_SQL} END), 0.0) AS DOUBLE) AS progress, count(*) AS steps, max(CASE WHEN o = 1 AND status = 'failed' THEN message END) AS error, min(CASE WHEN status = 'extracting_frames' THEN \"at\" END) AS started_at, max(CASE WHEN status = 'completed' THEN \"at\" END) AS completed_at FROM r GROUP BY 1",
)


@query(LATEST_SQL)
def latest_job_state(spark, sf_dir):
    return jobs.latest_state(transitions(spark, sf_dir))


@query(with_sql(T.LOGS_SQL, T.JOBS_SQL, select="SELECT job_id, seq, stage, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS line FROM logs WHERE job_id IN (SELECT id FROM jobs)"))
def pipeline_log(spark, sf_dir):
    return jobs.job_log(T.logs(spark, sf_dir), T.jobs(spark, sf_dir)).select("job_id", "seq", "stage", F.col("line").cast("bigint").alias("line"))


@query(
    with_sql(
        T.KEYFRAMES_SQL, "s AS (SELECT p_partkey AS frame_index, p_retailprice AS score FROM part WHERE p_size < 25)",
        select="SELECT job_id, k.frame_index, cluster_id, score FROM keyframes k LEFT JOIN s USING (frame_index)",
    )
)
def left_score_attach(spark, sf_dir):
    scores = T.table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("frame_index"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("seq"))
    return jobs.attach_scores(T.keyframes(spark, sf_dir), scores, ["frame_index"]).select("job_id", "frame_index", "cluster_id", "score")


_LINES_SQL = "s AS (SELECT l_partkey AS frame_index, arg_{pick}(l_extendedprice, l_orderkey * 10 + l_linenumber) AS score FROM lineitem WHERE l_quantity > 45 GROUP BY 1)"


def _lines(spark, sf_dir) -> DataFrame:
    """Scores of which a frame has many."""
    li = T.table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return li.select(F.col("l_partkey").alias("frame_index"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query(with_sql(_LINES_SQL.format(pick="min"), select="SELECT p_partkey AS frame_index, score FROM part LEFT JOIN s ON p_partkey = frame_index"))
def first_score_attach(spark, sf_dir):
    parts = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame_index"))
    return jobs.attach_scores(parts, _lines(spark, sf_dir), ["frame_index"], "first")


@query(with_sql(_LINES_SQL.format(pick="max"), select="SELECT p_partkey AS frame_index, score FROM part JOIN s ON p_partkey = frame_index"))
def inner_score_attach(spark, sf_dir):
    parts = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame_index"))
    return jobs.attach_scores(parts, _lines(spark, sf_dir), ["frame_index"], "last", "inner")


@query(with_sql(T.JOBS_SQL, "a AS (SELECT DISTINCT event_id * 3 AS id FROM events)", select="SELECT a.id, CASE WHEN j.id IS NULL THEN 404 WHEN status <> 'completed' THEN 400 ELSE 200 END AS code FROM a LEFT JOIN jobs j ON a.id = j.id"))
def job_gate(spark, sf_dir):
    asked = T.table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("id")).distinct()
    return jobs.gate(asked, T.jobs(spark, sf_dir)).select("id", "code")


@query(with_sql(T.VIDEOS_SQL, "s AS (SELECT id, duration, unnest(range(0, 3)) AS part FROM videos)", select="SELECT id, part, round(part * duration / 3, 6) AS start, round((part + 1) * duration / 3, 6) AS stop FROM s"))
def timeline_segments(spark, sf_dir):
    v = T.videos(spark, sf_dir).select("id", F.posexplode(S.timeline_segments(F.col("duration"))).alias("part", "s"))
    return v.select("id", F.col("part").cast("bigint").alias("part"), F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("stop"))


@query(
    r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(trim(text)), '[ \t\n\r]+'), lambda x: length(x) > 3)[1:4] AS w FROM documents)
    SELECT doc_id, CASE WHEN text IS NULL THEN 'Visual object:0.8' ELSE coalesce(array_to_string(list_transform(w, lambda x: replace(upper(left(x, 1)), 'ẞ', 'SS') || lower(substr(x, 2)) || ':0.9'), '|'), '') END AS objects, CASE WHEN text IS NULL THEN 'Scene' ELSE 'Captured Reality' END AS environment FROM w"""
)
def deep_analysis(spark, sf_dir):
    found = S.deep_analysis(F.col("text"))
    listed = F.array_join(F.transform(found["objects"], lambda x: F.concat(x["label"], F.lit(":"), x["score"].cast("string"))), "|")
    return T.table(spark, sf_dir, "documents").select("doc_id", listed.alias("objects"), found["environment"][0]["label"].alias("environment"))


@query(with_sql(T.JOBS_SQL, select="SELECT status, count(*) AS total FROM jobs GROUP BY 1"))
def jobs_total(spark, sf_dir):
    return T.jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("total"))


@query(
    with_sql(
        T.JOBS_SQL, T.VIDEOS_SQL, T.KEYFRAMES_SQL, "k AS (SELECT job_id, count(*) AS n, avg(temporal_coverage) AS c FROM keyframes GROUP BY 1)",
        "m AS (SELECT j.id, coalesce(n, 0) AS n, duration, frames_filtered AS f, total_frames AS t, c FROM jobs j JOIN videos v ON j.video_id = v.id LEFT JOIN k ON k.job_id = j.id)",
        select="SELECT id, n, CASE WHEN n > 0 THEN duration / (n * 2.0) ELSE 1.0 END AS compression_ratio, CASE WHEN f > 0 THEN 1 - n / f ELSE 0.0 END AS redundancy_removed, round(coalesce(c, 0.0), 7) AS temporal_coverage_score, CASE WHEN n / duration > 0.4 THEN 'Fast' WHEN n / duration < 0.1 THEN 'Slow' ELSE 'Moderate' END AS video_pacing, CASE WHEN t > 0 THEN (1 - n / t) * 100 ELSE 0.0 END AS percent_compression FROM m",
    )
)
def summary_metrics(spark, sf_dir):
    return jobs.summary_metrics(*_store(spark, sf_dir))


@query(
    with_sql(
        "f AS (SELECT p_partkey // 4 AS key, 'f' || p_partkey || '.' || CASE p_size % 4 WHEN 0 THEN 'webp' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' ELSE 'gif' END AS path, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS r FROM part)",
        "o AS (SELECT key, path, row_number() OVER (PARTITION BY key ORDER BY r, path) AS i FROM f WHERE r IS NOT NULL)", select="SELECT key, path FROM o WHERE i = 1",
    )
)
def keyframe_lookup(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("webp", "png", "jpg", "gif"))), (F.col("p_size") % 4 + 1).cast("int"))
    files = T.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 4).alias("key"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"))
    return jobs.best_file(files, "key", "path", DEFAULT.image_formats)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'extension' WHEN p_size * 12000000.0 > 524288000 THEN 'size' WHEN p_retailprice > 600 THEN 'duration' END AS rejection FROM part")
def upload_filter(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "v.txt").otherwise("v.MP4").alias("path"), (F.col("p_size") * 12000000.0).alias("size"), F.col("p_retailprice").alias("duration"))
    return jobs.accepted_uploads(p, "path", "size", "duration", DEFAULT).select("id", "rejection")


# --- vectors and clusters -------------------------------------------------------------------------------------------


@query(with_sql(T.FEATURES_SQL, select="SELECT frame_index, round(sqrt(list_inner_product(features, features)), 6) AS norm, round(features[1] / sqrt(list_inner_product(features, features)), 6) AS first, round(features[64] / sqrt(list_inner_product(features, features)), 6) AS last FROM features"))
def l2_normalize(spark, sf_dir):
    n = V.l2_normalize(F.col("features"))
    return T.features(spark, sf_dir).select("frame_index", F.round(V.norm(F.col("features")), 6).alias("norm"), F.round(F.element_at(n, 1), 6).alias("first"), F.round(F.element_at(n, -1), 6).alias("last"))


STEP_SQL = "steps AS (SELECT *, row_number() OVER w - 1 AS pos, 1 - list_inner_product(features, lag(features) OVER w) / (sqrt(list_inner_product(features, features)) * sqrt(list_inner_product(lag(features) OVER w, lag(features) OVER w))) AS distance FROM features WINDOW w AS (PARTITION BY video_id ORDER BY ts, frame_index))"
CUT_SQL = "cuts AS (SELECT *, greatest(0.3, CASE WHEN count(distance) OVER (PARTITION BY video_id) > 5 THEN avg(distance) OVER (PARTITION BY video_id) + 2 * stddev_pop(distance) OVER (PARTITION BY video_id) END) AS threshold FROM steps)"


@query(with_sql(T.FEATURES_SQL, STEP_SQL, select="SELECT video_id, frame_index, pos, round(distance, 6) AS distance FROM steps"))
def cosine_step(spark, sf_dir):
    return timeline.steps(T.features(spark, sf_dir)).select("video_id", "frame_index", "pos", F.round("distance", 6).alias("distance"))


@query(with_sql(T.FEATURES_SQL, STEP_SQL, CUT_SQL, select="SELECT video_id, frame_index, round(threshold, 6) AS threshold, coalesce(distance > threshold, false) AS is_cut FROM cuts"))
def scene_cuts(spark, sf_dir):
    return timeline.scene_cuts(T.features(spark, sf_dir)).select("video_id", "frame_index", F.round("threshold", 6).alias("threshold"), "is_cut")


SCENE_SQL = "scened AS (SELECT *, sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY ts, frame_index ROWS UNBOUNDED PRECEDING) AS scene_id FROM cuts)"
SCENES = with_sql(
    T.FEATURES_SQL, STEP_SQL, CUT_SQL, SCENE_SQL, "last AS (SELECT video_id, max(pos) AS last_pos, max(ts) AS last_ts FROM scened GROUP BY 1)",
    "g AS (SELECT video_id, CAST(scene_id AS BIGINT) AS scene_id, min(pos) AS start_frame, min(ts) AS start_time FROM scened GROUP BY 1, 2)",
    "e AS (SELECT g.*, coalesce(lead(start_frame) OVER w, last_pos) AS end_frame, coalesce(lead(start_time) OVER w, last_ts) AS end_time FROM g JOIN last USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY scene_id))",
    select="SELECT video_id, scene_id, start_frame, end_frame, round(start_time, 4) AS start_time, round(end_time, 4) AS end_time, round(end_time - start_time, 4) AS duration FROM e",
)


@query(SCENES)
def scene_segments(spark, sf_dir):
    return timeline.scenes(T.features(spark, sf_dir))


CENTROID_SQL = "dims AS (SELECT video_id, cluster_id, generate_subscripts(features, 1) AS d, unnest(features) AS x FROM features), means AS (SELECT video_id, cluster_id, d, avg(x) AS m, count(*) AS n FROM dims GROUP BY 1, 2, 3), centroids AS (SELECT video_id, cluster_id, list(m ORDER BY d) AS centroid, max(n) AS size FROM means GROUP BY 1, 2)"
DISTANCE_SQL = "distances AS (SELECT f.*, list_distance(features, centroid) AS distance, size FROM features f JOIN centroids USING (video_id, cluster_id))"


@query(with_sql(T.FEATURES_SQL, CENTROID_SQL, select="SELECT video_id, cluster_id, CAST(d - 1 AS INT) AS dim, round(m, 6) AS mean FROM means"))
def centroids(spark, sf_dir):
    return scoring.centroids(T.features(spark, sf_dir)).select("video_id", "cluster_id", F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


def _distances(spark, sf_dir) -> DataFrame:
    f = T.features(spark, sf_dir)
    return scoring.with_distance(f, scoring.centroids(f))


@query(with_sql(T.FEATURES_SQL, CENTROID_SQL, DISTANCE_SQL, select="SELECT frame_index, cluster_id, round(distance, 6) AS distance FROM distances"))
def euclid_to_centroid(spark, sf_dir):
    return _distances(spark, sf_dir).select("frame_index", "cluster_id", F.round("distance", 6).alias("distance"))


@query(with_sql(T.FEATURES_SQL, CENTROID_SQL, DISTANCE_SQL, select="SELECT video_id, cluster_id, count(*) AS size, round(min(distance), 6) AS nearest, round(max(distance), 6) AS farthest FROM distances GROUP BY 1, 2"))
def cluster_stats(spark, sf_dir):
    return _distances(spark, sf_dir).groupBy("video_id", "cluster_id").agg(F.count("*").alias("size"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.max("distance"), 6).alias("farthest"))


@query(with_sql(T.FEATURES_SQL, CENTROID_SQL, DISTANCE_SQL, "r AS (SELECT *, row_number() OVER (PARTITION BY video_id, cluster_id ORDER BY round(distance, 9), frame_index) AS r FROM distances)", select="SELECT video_id, cluster_id, frame_index, ts, round(distance, 6) AS distance FROM r WHERE r = 1"))
def cluster_representatives(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("video_id", "cluster_id").orderBy(F.round("distance", 9), "frame_index"))
    return _distances(spark, sf_dir).withColumn("r", rank).where("r = 1").select("video_id", "cluster_id", "frame_index", "ts", F.round("distance", 6).alias("distance"))


@query(with_sql(T.FEATURES_SQL, CENTROID_SQL, DISTANCE_SQL, select="SELECT frame_index, round(CASE WHEN max(distance) OVER w - min(distance) OVER w > 1e-6 THEN 1 - (distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w) ELSE 1.0 END, 5) AS representativeness FROM distances WINDOW w AS (PARTITION BY video_id, cluster_id)"))
def representativeness(spark, sf_dir):
    return _distances(spark, sf_dir).select("frame_index", F.round(scoring.representativeness(F.col("distance")), 5).alias("representativeness"))


@query(with_sql(T.FEATURES_SQL, CENTROID_SQL, select="SELECT video_id, cluster_id, round(least(0.8, size / max(size) OVER (PARTITION BY video_id)), 6) AS dominance FROM centroids"))
def dominance(spark, sf_dir):
    c = scoring.centroids(T.features(spark, sf_dir)).withColumnRenamed("size", "cluster_size")
    return c.select("video_id", "cluster_id", F.round(scoring.dominance(), 6).alias("dominance"))


HIST_SQL = "hists AS (SELECT *, list_transform(features, lambda x: abs(x)) AS h, lag(list_transform(features, lambda x: abs(x))) OVER (PARTITION BY video_id ORDER BY ts, frame_index) AS g FROM features)"


def _hists(spark, sf_dir) -> DataFrame:
    h = T.features(spark, sf_dir).withColumn("h", F.transform("features", F.abs))
    return h.withColumn("g", F.lag("h").over(timeline.in_order())).where(F.col("g").isNotNull())


@query(with_sql(T.FEATURES_SQL, HIST_SQL, select="SELECT frame_index, round(greatest(0, least(1, 1 - sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(h, g), lambda p: sqrt(p[1] * p[2]))) / sqrt(list_sum(h) * list_sum(g)))))), 5) AS similarity FROM hists WHERE g IS NOT NULL"))
def bhattacharyya(spark, sf_dir):
    return _hists(spark, sf_dir).select("frame_index", F.round(V.bhattacharyya_similarity(F.col("h"), F.col("g")), 5).alias("similarity"))


@query(with_sql(T.FEATURES_SQL, HIST_SQL, "c AS (SELECT frame_index, list_transform(h, lambda x: x - list_avg(h)) AS a, list_transform(g, lambda x: x - list_avg(g)) AS b FROM hists WHERE g IS NOT NULL)", select="SELECT frame_index, round(list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)), 5) AS correlation FROM c"))
def hist_correlation(spark, sf_dir):
    return _hists(spark, sf_dir).select("frame_index", F.round(V.correlation(F.col("h"), F.col("g")), 5).alias("correlation"))


_ENTROPY_SQL = "-list_sum(list_transform({h}, lambda x: (x / (list_sum({h}) + 1e-10)) * log2(x / (list_sum({h}) + 1e-10) + 1e-10)))"
ENTROPY_SQL = f"entropies AS (SELECT *, ({_ENTROPY_SQL.format(h='h[1:30]')} + {_ENTROPY_SQL.format(h='h[31:46]')}) / 2 AS entropy FROM hists)"


def color_entropy_of(h: Column) -> Column:
    return (V.entropy(F.slice(h, 1, 30)) + V.entropy(F.slice(h, 31, 16))) / 2


@query(with_sql(T.FEATURES_SQL, HIST_SQL, ENTROPY_SQL, select="SELECT frame_index, round(entropy, 5) AS entropy FROM entropies"))
def color_entropy(spark, sf_dir):
    h = T.features(spark, sf_dir).withColumn("h", F.transform("features", F.abs))
    return h.select("frame_index", F.round(color_entropy_of(F.col("h")), 5).alias("entropy"))


@query(with_sql(T.FEATURES_SQL, CENTROID_SQL, DISTANCE_SQL, select="SELECT video_id, round(sum(distance * distance), 5) AS wcss FROM distances GROUP BY 1"))
def wcss_by_label(spark, sf_dir):
    return clustering.wcss(T.features(spark, sf_dir), "cluster_id").select("video_id", F.round("wcss", 5).alias("wcss"))


SILHOUETTE_SQL = (
    "pairs AS (SELECT a.video_id, a.frame_index, a.cluster_id AS own, b.cluster_id AS theirs, avg(list_distance(a.features, b.features)) AS d FROM features a JOIN features b ON a.video_id = b.video_id AND a.frame_index <> b.frame_index GROUP BY 1, 2, 3, 4), "
    "each_frame AS (SELECT video_id, frame_index, max(CASE WHEN own = theirs THEN d END) AS a, min(CASE WHEN own <> theirs THEN d END) AS b FROM pairs GROUP BY 1, 2)"
)


@query(with_sql(T.FEATURES_SQL, SILHOUETTE_SQL, select="SELECT video_id, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM each_frame GROUP BY 1"))
def silhouette_by_label(spark, sf_dir):
    return clustering.silhouette(T.features(spark, sf_dir)).select("video_id", F.round("silhouette", 5).alias("silhouette"))


@query(with_sql(T.FRAMES_SQL, "n AS (SELECT video_id, count(*) AS n, max(ts) / 3600 AS duration FROM frames GROUP BY 1)", "h AS (SELECT *, CASE WHEN n > 2 THEN least(30, n - 1) ELSE 2 END AS high FROM n)", select="SELECT video_id, CAST(least(CASE WHEN duration > 0 THEN greatest(4, CAST(floor(duration / 4) AS BIGINT)) ELSE 4 END, high) AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM h"))
def k_range(spark, sf_dir):
    n = T.frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"), (F.max("ts") / 3600).alias("duration"))
    low, high = clustering.k_range(F.col("n"), F.col("duration"))
    return n.select("video_id", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


CURVE_SQL = (
    "ks AS (SELECT *, unnest(range(2, 11)) AS k FROM features), kd AS (SELECT video_id, k, cluster_id % k AS c, generate_subscripts(features, 1) AS d, unnest(features) AS x FROM ks), "
    "kg AS (SELECT video_id, k, c, d, sum(x * x) - sum(x) * sum(x) / count(*) AS w FROM kd GROUP BY 1, 2, 3, 4), curve AS (SELECT video_id, k, sum(w) AS wcss FROM kg GROUP BY 1, 2)"
)


def curve(spark, sf_dir) -> DataFrame:
    """A curve (video_id, k, wcss) from the given clusters folded into k."""
    f = T.features(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(10)))).withColumn("c", F.col("cluster_id") % F.col("k"))
    return clustering.wcss(f, "c", ("video_id", "k"))


ELBOW_SQL = (
    "xy AS (SELECT video_id, k, row_number() OVER w - 1 AS i, (k - 2) / 8 AS x, (wcss - min(wcss) OVER (PARTITION BY video_id)) / (max(wcss) OVER (PARTITION BY video_id) - min(wcss) OVER (PARTITION BY video_id) + 1e-10) AS y FROM curve WINDOW w AS (PARTITION BY video_id ORDER BY k)), "
    "ends AS (SELECT video_id, max(CASE WHEN k = 2 THEN y END) AS y0, max(CASE WHEN k = 10 THEN y END) AS y1 FROM xy GROUP BY 1), "
    "away AS (SELECT video_id, i, round(abs((y - y0) - (y1 - y0) * x) / sqrt(1 + (y1 - y0) * (y1 - y0)), 9) AS a FROM xy JOIN ends USING (video_id))"
)


@query(with_sql(T.FEATURES_SQL, CURVE_SQL, ELBOW_SQL, "r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a DESC, i) AS r FROM away)", select="SELECT video_id, CAST(i AS BIGINT) AS elbow FROM r WHERE r = 1"))
def elbow_from_curve(spark, sf_dir):
    return clustering.elbow(curve(spark, sf_dir))


@query(f"SELECT event_id, CASE WHEN s = 'completed' THEN 'Completed' WHEN s = 'failed' THEN 'Failed' WHEN s IN ('pending', 'uploaded') THEN 'Queued' ELSE 'Processing' END AS label FROM (SELECT event_id, {_NAMED_SQL} AS s FROM events)")
def status_labels(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", S.status_label(named_state(F.col("event_id"))).alias("label"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '#22c55e' WHEN 1 THEN '#eab308' WHEN 2 THEN '#ef4444' ELSE '#6366f1' END AS colour FROM lineitem")
def confidence_colours(spark, sf_dir):
    level = F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW"), F.lit(None)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.confidence_colour(level).alias("colour"))


CURVES_SQL = (
    "ks AS (SELECT video_id, frame_index, features, k, cluster_id % k AS c FROM features, range(2, 11) t(k)), "
    "sp AS (SELECT a.video_id, a.frame_index AS f, b.frame_index AS g, list_distance(a.features, b.features) AS d FROM features a JOIN features b ON a.video_id = b.video_id AND a.frame_index <> b.frame_index), "
    "sm AS (SELECT p.video_id, x.k, p.f, x.c AS own, y.c AS theirs, avg(d) AS d FROM sp p JOIN ks x ON p.f = x.frame_index JOIN ks y ON p.g = y.frame_index AND y.k = x.k GROUP BY 1, 2, 3, 4, 5), "
    "se AS (SELECT video_id, k, f, max(CASE WHEN own = theirs THEN d END) AS a, min(CASE WHEN own <> theirs THEN d END) AS b FROM sm GROUP BY 1, 2, 3), "
    "sil AS (SELECT video_id, k, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM se GROUP BY 1, 2)"
)


@query(
    with_sql(
        T.FEATURES_SQL, CURVE_SQL.split(", kd AS")[0].replace("ks AS", "k0 AS") + ", kd AS" + CURVE_SQL.split(", kd AS")[1].replace("FROM ks", "FROM k0"), ELBOW_SQL, "er AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a DESC, i) AS r FROM away)", CURVES_SQL,
        "best AS (SELECT video_id, arg_max(k, (silhouette, -k)) AS k FROM sil GROUP BY 1)", "n AS (SELECT video_id, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM features GROUP BY 1)",
        "pl AS (SELECT video_id, root, greatest(CAST(i AS BIGINT), k - 2) AS place FROM best JOIN er USING (video_id) JOIN n USING (video_id) WHERE r = 1)",
        select="SELECT video_id, CAST(least(2 + CASE WHEN root > 2 AND root <= 8 THEN greatest(place, root - 2) ELSE place END, 10) AS BIGINT) AS k FROM pl",
    )
)
def choose_k(spark, sf_dir):
    """Elbow and exact silhouettes of the given clusters folded into k."""
    f = T.features(spark, sf_dir)
    folded = f.withColumn("labels", F.transform(F.sequence(F.lit(2), F.lit(10)), lambda k: F.col("cluster_id") % k))
    shape = kmeans.silhouettes(folded).select("video_id", (F.col("place") + 2).alias("k"), "silhouette")
    both = curve(spark, sf_dir).join(shape, ["video_id", "k"]).join(f.groupBy("video_id").agg(F.count("*").alias("frames")), "video_id")
    return clustering.choose_k(both, F.col("frames"))


@query()
def kmeans_sweep(spark, sf_dir):
    return clustering.sweep(T.features(spark, sf_dir).withColumn("ts", F.col("ts") / 4)).select("video_id", "k", F.round("wcss", 6).alias("wcss"), F.round("silhouette", 6).alias("silhouette"), "frames")


@query()
def cluster_and_select(spark, sf_dir):
    """The older way from features to keyframes: clusters, their representatives, two seconds apart."""
    return clustering.cluster_and_select(T.features(spark, sf_dir), gap=2.0).select("video_id", "frame_index", F.round("distance", 6).alias("distance"))
