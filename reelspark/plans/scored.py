"""Queries of time, factors, scores, folds and selection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import BASE_WEIGHTS, FACTORS
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import scoring, selection, timeline
from ..sources import tables as T
from . import summary
from .queries import CENTROID_SQL, CUT_SQL, DISTANCE_SQL, ENTROPY_SQL, HIST_SQL, POSITION_SQL, SCENE_SQL, SCENES, STEP_SQL, color_entropy_of, query, with_sql

HOURS = 10.0

# --- time -----------------------------------------------------------------------------------------------------------

NOVELTY_SQL = "near AS (SELECT *, count(*) OVER (PARTITION BY video_id ORDER BY CAST(round(ts * 1e6) AS BIGINT) RANGE BETWEEN 35999999999 PRECEDING AND 35999999999 FOLLOWING) - 1 AS neighbours FROM frames)"


@query(with_sql(T.FRAMES_SQL, NOVELTY_SQL, select="SELECT video_id, frame_index, neighbours, round(greatest(0.0, 1 - neighbours / 10), 6) AS visual_novelty FROM near"))
def temporal_novelty(spark, sf_dir):
    return timeline.temporal_novelty(T.frames(spark, sf_dir), HOURS * 3600).select("video_id", "frame_index", "neighbours", F.round("visual_novelty", 6).alias("visual_novelty"))


def coverage_sql(source: str) -> str:
    return (
        f"seg AS (SELECT *, CASE WHEN max(ts) OVER (PARTITION BY video_id) > 0 THEN least(2, CAST(floor(ts / (max(ts) OVER (PARTITION BY video_id) / 3)) AS INT)) ELSE 0 END AS segment FROM {source}), "
        "cov AS (SELECT *, count(*) OVER (PARTITION BY video_id, segment) / (count(*) OVER (PARTITION BY video_id) / 3.0) AS share FROM seg), "
        "covered AS (SELECT *, least(1.0, 0.6 * CASE WHEN share < 1 THEN 1 + (1 - share) * 0.5 ELSE 1 / share END) AS temporal_coverage FROM cov)"
    )


@query(with_sql(T.FRAMES_SQL, coverage_sql("frames"), select="SELECT video_id, frame_index, segment, round(temporal_coverage, 6) AS temporal_coverage FROM covered"))
def segment_coverage(spark, sf_dir):
    return timeline.segment_coverage(T.frames(spark, sf_dir)).select("video_id", "frame_index", "segment", F.round("temporal_coverage", 6).alias("temporal_coverage"))


MOTION_SQL = (
    "scaled AS (SELECT video_id, frame_index, ts, signal / CASE video_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 10 END AS signal FROM frames), "
    "around AS (SELECT *, abs(signal - lag(signal) OVER w) AS before, abs(lead(signal) OVER w - signal) AS after FROM scaled WINDOW w AS (PARTITION BY video_id ORDER BY ts, frame_index)), "
    "moved AS (SELECT *, (coalesce(before, 0) + coalesce(after, 0)) / CASE WHEN before IS NOT NULL AND after IS NOT NULL THEN 2 ELSE 1 END AS motion FROM around)"
)


def _moved(spark, sf_dir) -> DataFrame:
    k = F.col("video_id") % 3
    f = T.frames(spark, sf_dir).withColumn("signal", F.col("signal") / F.when(k == 0, 1).when(k == 1, 4).otherwise(10))
    return timeline.motion(f, "signal")


@query(with_sql(T.FRAMES_SQL, MOTION_SQL, select="SELECT video_id, frame_index, round(motion, 6) AS motion FROM moved"))
def motion_neighbors(spark, sf_dir):
    return _moved(spark, sf_dir).select("video_id", "frame_index", F.round("motion", 6).alias("motion"))


@query(with_sql(T.FRAMES_SQL, MOTION_SQL, select="SELECT video_id, frame_index, round(CASE WHEN max(motion) OVER w - min(motion) OVER w > 1e-6 THEN (motion - min(motion) OVER w) / (max(motion) OVER w - min(motion) OVER w) ELSE 0.5 END, 6) AS scaled FROM moved WINDOW w AS (PARTITION BY video_id)"))
def minmax_factor(spark, sf_dir):
    return _moved(spark, sf_dir).select("video_id", "frame_index", F.round(timeline.minmax(F.col("motion")), 6).alias("scaled"))


PACING_SQL = MOTION_SQL + ", paced AS (SELECT video_id, avg(motion) AS m, stddev_pop(motion) AS d FROM moved GROUP BY 1), pace AS (SELECT *, CASE WHEN m > 20 OR d > 15 THEN 'fast' WHEN m < 5 AND d < 5 THEN 'slow' ELSE 'normal' END AS pacing FROM paced)"


def _pace(spark, sf_dir) -> DataFrame:
    p = _moved(spark, sf_dir).groupBy("video_id").agg(F.avg("motion").alias("m"), F.stddev_pop("motion").alias("d"))
    return p.withColumn("pacing", scoring.pacing_by_motion(F.col("m"), F.col("d")))


@query(with_sql(T.FRAMES_SQL, PACING_SQL, select="SELECT video_id, round(m, 5) AS mean, round(d, 5) AS deviation, pacing FROM pace"))
def pacing_motion(spark, sf_dir):
    return _pace(spark, sf_dir).select("video_id", F.round("m", 5).alias("mean"), F.round("d", 5).alias("deviation"), "pacing")


def _weight_sql(f: str) -> str:
    fast, slow = {"motion_context": 0.15, "dominance": 0.10}, {"visual_richness": 0.25, "motion_context": 0.05}
    return f"CAST(CASE pacing WHEN 'fast' THEN {fast.get(f, BASE_WEIGHTS[f])} WHEN 'slow' THEN {slow.get(f, BASE_WEIGHTS[f])} ELSE {BASE_WEIGHTS[f]} END AS DOUBLE)"


@query(with_sql(T.FRAMES_SQL, PACING_SQL, select="SELECT video_id, " + ", ".join(f"{_weight_sql(f)} AS {f}" for f in FACTORS) + " FROM pace"))
def adaptive_weights(spark, sf_dir):
    w = scoring.weights(F.col("pacing"))
    return _pace(spark, sf_dir).select("video_id", *[w[f].alias(f) for f in FACTORS])


@query(with_sql(T.FRAMES_SQL, select="SELECT video_id, frame_index, round(100 * ts / CASE WHEN max(ts) OVER w > 0 THEN max(ts) OVER w END, 6) AS percent FROM frames WINDOW w AS (PARTITION BY video_id)"))
def timeline_position(spark, sf_dir):
    return T.frames(spark, sf_dir).select("video_id", "frame_index", F.round(F.try_divide(100 * F.col("ts"), F.max("ts").over(timeline.in_video())), 6).alias("percent"))


# --- factors and scores ---------------------------------------------------------------------------------------------

FACTOR_SQL = (
    f"{T.FEATURES_SQL}, {CENTROID_SQL}, {DISTANCE_SQL}, {HIST_SQL}, {ENTROPY_SQL}, "
    "met AS (SELECT d.video_id, d.frame_index, d.ts, d.cluster_id, d.features, distance, size, entropy - 1.45 AS entropy FROM distances d JOIN entropies e ON d.frame_index = e.frame_index), "
    "around AS (SELECT *, list_distance(features, lag(features) OVER w) AS before, list_distance(features, lead(features) OVER w) AS after FROM met WINDOW w AS (PARTITION BY video_id ORDER BY ts, frame_index)), "
    "moved AS (SELECT *, (coalesce(before, 0) + coalesce(after, 0)) / CASE WHEN before IS NOT NULL AND after IS NOT NULL THEN 2 ELSE 1 END AS motion, count(*) OVER (PARTITION BY video_id ORDER BY CAST(round(ts * 1e6) AS BIGINT) RANGE BETWEEN 999999 PRECEDING AND 999999 FOLLOWING) - 1 AS neighbours, abs(features[2]) AS edges, 128 + 800 * features[1] AS brightness, 1000 * abs(features[3]) AS laplacian, (entropy < 2.5 OR features[4] > 0.25) AS low_entropy FROM around), "
    + coverage_sql("moved")
    + ", factors AS (SELECT video_id, frame_index, ts, cluster_id, entropy, low_entropy, edges, brightness, motion, "
    "round(CASE WHEN max(distance) OVER c - min(distance) OVER c > 1e-6 THEN 1 - (distance - min(distance) OVER c) / (max(distance) OVER c - min(distance) OVER c) ELSE 1.0 END, 9) AS representativeness, "
    "round(least(0.8, size / max(size) OVER v), 9) AS dominance, "
    "round((0.4 * least(edges, 0.2) / 0.2 + 0.3 * least(laplacian, 300.0) / 300 + 0.3 * least(entropy, 4.0) / 4) * CASE WHEN low_entropy THEN 0.3 WHEN entropy < 3 THEN 0.6 ELSE 1.0 END, 9) AS visual_richness, "
    "round(temporal_coverage, 9) AS temporal_coverage, round(greatest(0.0, 1 - neighbours / 10), 9) AS visual_novelty, "
    "round(CASE WHEN max(motion) OVER v - min(motion) OVER v > 1e-6 THEN (motion - min(motion) OVER v) / (max(motion) OVER v - min(motion) OVER v) ELSE 0.5 END, 9) AS motion_context "
    "FROM covered WINDOW c AS (PARTITION BY video_id, cluster_id), v AS (PARTITION BY video_id))"
)


def factors(spark, sf_dir) -> DataFrame:
    """All factors of the frames of T.features; what needs pixels is read from single dimensions."""
    return summary.factors(described(T.features(spark, sf_dir)))


def described(f: DataFrame) -> DataFrame:
    """Features with what a pixel pass would give, read from single dimensions; the entropy is shifted to where the thresholds are."""
    return f.withColumns({
        "entropy": color_entropy_of(F.transform("features", F.abs)) - 1.45, "edge_density": F.abs(F.element_at("features", 2)), "brightness": 128 + 800 * F.element_at("features", 1),
        "sharpness": 1000 * F.abs(F.element_at("features", 3)), "uniform": F.element_at("features", 4) > 0.25,
    })


@query(with_sql(FACTOR_SQL, select="SELECT frame_index, " + ", ".join(f"round({f}, 5) AS {f}" for f in FACTORS) + " FROM factors"))
def importance_factors(spark, sf_dir):
    return factors(spark, sf_dir).select("frame_index", *[F.round(f, 5).alias(f) for f in FACTORS])


REJECT_SQL = (
    "ladder AS (SELECT *, CASE WHEN low_entropy AND edges < 0.05 THEN 'Flat surface (low entropy + low edges)' WHEN low_entropy AND entropy < 2.0 THEN 'Uniform surface (very low entropy)' WHEN visual_richness < 0.25 THEN 'Low visual richness' "
    "WHEN brightness < 25 THEN 'Too dark' WHEN brightness > 240 THEN 'Too bright/washed out' WHEN motion_context < 0.1 AND dominance < 0.3 THEN 'Static and unimportant' END AS rejection_reason FROM factors)"
)


def rejected(spark, sf_dir) -> DataFrame:
    return summary.rejected(factors(spark, sf_dir))


@query(with_sql(FACTOR_SQL, REJECT_SQL, select="SELECT frame_index, rejection_reason FROM ladder"))
def prefilter_ladder(spark, sf_dir):
    return rejected(spark, sf_dir).select("frame_index", "rejection_reason")


@query(with_sql(FACTOR_SQL, REJECT_SQL, "p AS (SELECT *, count(*) FILTER (WHERE rejection_reason IS NULL) OVER (PARTITION BY video_id) AS passed FROM ladder)", select="SELECT video_id, frame_index FROM p WHERE rejection_reason IS NULL OR passed < 100"))
def prefilter_fallback(spark, sf_dir):
    return scoring.prefilter(rejected(spark, sf_dir), F.lit(100)).select("video_id", "frame_index")


CAPPED_SQL = "capped AS (SELECT *, CASE WHEN low_entropy AND entropy < 2.0 AND edges < 0.05 THEN least(raw, 0.25) WHEN low_entropy AND entropy < 2.5 THEN least(raw, 0.35) ELSE raw END AS score FROM scores)"
SCORE_SQL = "scores AS (SELECT *, round(motion_context * 0.001 + " + " + ".join(f"{BASE_WEIGHTS[f]} * {f}" for f in FACTORS) + ", 8) AS raw FROM ladder), " + CAPPED_SQL


def scores(spark, sf_dir) -> DataFrame:
    return summary.scored(rejected(spark, sf_dir))


@query(with_sql(FACTOR_SQL, REJECT_SQL, SCORE_SQL, select="SELECT frame_index, round(raw, 6) AS score FROM capped"))
def importance_score(spark, sf_dir):
    return scores(spark, sf_dir).select("frame_index", F.round("raw", 6).alias("score"))


CAP_SQL = "shown AS (SELECT frame_index, raw, entropy - 0.25 AS entropy, edges, low_entropy FROM scores)"


@query(with_sql(FACTOR_SQL, REJECT_SQL, SCORE_SQL, CAP_SQL, select="SELECT frame_index, round(CASE WHEN low_entropy AND entropy < 2.0 AND edges < 0.05 THEN least(raw, 0.25) WHEN low_entropy AND entropy < 2.5 THEN least(raw, 0.35) ELSE raw END, 6) AS score, CASE WHEN low_entropy AND entropy < 2.0 AND edges < 0.05 THEN CASE WHEN raw > 0.25 THEN 'hard_entropy_penalty_very_low' END WHEN low_entropy AND entropy < 2.5 THEN CASE WHEN raw > 0.35 THEN 'hard_entropy_penalty_low' END WHEN low_entropy THEN 'entropy_penalty_moderate_applied' END AS tag FROM shown"))
def entropy_caps(spark, sf_dir):
    score, tag = scoring.capped(F.col("raw"), F.col("entropy") - 0.25, F.col("edges"), F.col("low_entropy"))
    return scores(spark, sf_dir).select("frame_index", F.round(score, 6).alias("score"), tag.alias("tag"))


@query(
    with_sql(
        FACTOR_SQL, REJECT_SQL, SCORE_SQL, "o AS (SELECT video_id, list(score ORDER BY score) AS s, count(*) AS n FROM capped GROUP BY 1)",
        "b AS (SELECT video_id, n, s[CAST(floor(n * 0.2) AS INT) + 1] AS low, s[CAST(floor(n * 0.8) AS INT) + 1] AS high FROM o)",
        "l AS (SELECT frame_index, entropy, low_entropy, CASE WHEN n < 5 THEN CASE WHEN score > 0.7 THEN 'HIGH' WHEN score < 0.4 THEN 'LOW' ELSE 'MEDIUM' END WHEN score >= high THEN 'HIGH' WHEN score <= low THEN 'LOW' ELSE 'MEDIUM' END AS level FROM capped JOIN b USING (video_id))",
        select="SELECT frame_index, level, CASE WHEN low_entropy AND entropy < 2.5 THEN 'LOW' WHEN low_entropy THEN 'MEDIUM' ELSE level END AS confidence FROM l",
    )
)
def confidence_percentile(spark, sf_dir):
    c = scoring.with_confidence(scores(spark, sf_dir), "score")
    return c.select("frame_index", F.col("confidence").alias("level"), scoring.lowered(F.col("confidence"), F.col("entropy"), F.col("low_entropy")).alias("confidence"))


def _stability_sql(top: int) -> str:
    shifted = []
    for i, shift in enumerate(scoring.SHIFTS):
        w = {f: max(0.01, BASE_WEIGHTS[f] + d) for f, d in zip(FACTORS, shift, strict=True)}
        total = sum(w.values())
        shifted.append("round(" + " + ".join(f"{f} * CAST({w[f] / total!r} AS DOUBLE)" for f in FACTORS) + f", 9) AS s{i}")
    ranks = ", ".join(f"row_number() OVER (PARTITION BY video_id ORDER BY s{i} DESC, frame_index) <= {top} AS t{i}" for i in range(len(shifted)))
    shares = " + ".join(f"count(*) FILTER (WHERE base AND t{i}) / max(n)" for i in range(len(shifted)))
    return with_sql(
        FACTOR_SQL, REJECT_SQL, SCORE_SQL, f"sh AS (SELECT video_id, frame_index, score, {', '.join(shifted)} FROM capped)",
        f"rk AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= {top} AS base, least({top}, count(*) OVER (PARTITION BY video_id)) AS n, {ranks} FROM sh)",
        f"st AS (SELECT video_id, ({shares}) / {len(shifted)} AS r FROM rk GROUP BY 1)", select="SELECT video_id, round(r, 6) AS stability_ratio, r >= 0.8 - 1e-9 AS stable FROM st",
    )


@query(_stability_sql(20))
def stability_fixed(spark, sf_dir):
    st = scoring.stability(scores(spark, sf_dir), "score", 20)
    return st.select("video_id", F.round("stability_ratio", 6).alias("stability_ratio"), (F.col("stability_ratio") >= 0.8 - 1e-9).alias("stable"))


_LONG_SQL = " UNION ALL ".join(f"SELECT frame_index, {i} AS i, '{f}' AS name, {f} AS v FROM factors" for i, f in enumerate(FACTORS))


@query(with_sql(FACTOR_SQL, f"long AS ({_LONG_SQL})", "r AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY v DESC, i) AS r FROM long)", select="SELECT frame_index, string_agg(name, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY 1"))
def top3_factors(spark, sf_dir):
    return factors(spark, sf_dir).select("frame_index", F.array_join(F.transform(scoring.ranked_factors(3), lambda x: x["name"]), ",").alias("top"))


@query(
    with_sql(
        FACTOR_SQL, f"long AS ({_LONG_SQL})", "r AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY v DESC, i) AS r FROM long)",
        select="SELECT frame_index, CASE WHEN v > 0.7 THEN CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CONTEXT_PHRASES.items()) + " END ELSE 'Significant highlight.' END AS context FROM r WHERE r = 1",
    )
)
def context_phrases(spark, sf_dir):
    best = F.element_at(scoring.ranked_factors(1), 1)
    return factors(spark, sf_dir).select("frame_index", S.context_phrase(best["name"], best["value"]).alias("context"))


LABEL_SQL = "ldims AS (SELECT label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), lmeans AS (SELECT label, d, avg(x) AS m FROM ldims GROUP BY 1, 2), labels10 AS (SELECT label, list(m ORDER BY d) AS vector FROM lmeans GROUP BY 1)"


@query(
    with_sql(
        T.FEATURES_SQL, LABEL_SQL, "s AS (SELECT frame_index, label, 10 * list_inner_product(features, vector) / (sqrt(list_inner_product(features, features)) * sqrt(list_inner_product(vector, vector))) AS s FROM features, labels10)",
        "p AS (SELECT frame_index, label, exp(s) / sum(exp(s)) OVER (PARTITION BY frame_index) AS score, row_number() OVER (PARTITION BY frame_index ORDER BY s DESC, label) AS r FROM s)", select="SELECT frame_index, label, round(score, 5) AS score FROM p WHERE r = 1",
    )
)
def softmax_topk(spark, sf_dir):
    f = T.features(spark, sf_dir)
    by_dim = f.select(F.col("cluster_id").alias("label"), F.posexplode("features").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    labels = by_dim.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("m")).select("label", F.transform("m", lambda x: x["m"]).alias("vector"))
    return scoring.softmax_top(f, labels, scale=10.0).select("frame_index", "label", F.round("score", 5).alias("score"))


# --- folds ----------------------------------------------------------------------------------------------------------


def fold_sql(name: str, source: str, columns: str, first: str, step: str) -> str:
    """A recursive CTE over numbered(video_id, pos, ...) that carries state from row to row."""
    return f"{name} AS (SELECT video_id, pos, frame_index, ts, {first} FROM {source} WHERE pos = 0 UNION ALL SELECT n.video_id, n.pos, n.frame_index, n.ts, {step} FROM {name} s JOIN {source} n ON n.video_id = s.video_id AND n.pos = s.pos + 1)"


@query(
    "WITH RECURSIVE " + ", ".join([T.FRAMES_SQL, POSITION_SQL, fold_sql("f", "numbered", "", "signal AS last, true AS kept", "CASE WHEN abs(n.signal - s.last) >= 50 THEN n.signal ELSE s.last END, abs(n.signal - s.last) >= 50")])
    + " SELECT video_id, frame_index, last AS value FROM f WHERE kept"
)
def redundancy_keep(spark, sf_dir):
    return timeline.redundancy_keep(T.frames(spark, sf_dir), "signal", 50.0).select("video_id", "frame_index", "value")


@query(
    "WITH RECURSIVE " + ", ".join([
        T.FRAMES_SQL, POSITION_SQL, "ds AS (SELECT CAST(5 * d AS DOUBLE) AS d FROM range(1, 31) t(d))",
        "f AS (SELECT video_id, pos, d, signal AS last, 1 AS n FROM numbered, ds WHERE pos = 0 UNION ALL SELECT s.video_id, x.pos, s.d, CASE WHEN abs(x.signal - s.last) >= s.d THEN x.signal ELSE s.last END, s.n + CASE WHEN abs(x.signal - s.last) >= s.d THEN 1 ELSE 0 END FROM f s JOIN numbered x ON x.video_id = s.video_id AND x.pos = s.pos + 1)",
        "c AS (SELECT video_id, d, max(n) AS n FROM f GROUP BY 1, 2)",
        "r AS (SELECT c.video_id, 1 AS i, c.d, c.n FROM c WHERE d = 50 UNION ALL SELECT r.video_id, r.i + 1, c.d, c.n FROM r JOIN c ON c.video_id = r.video_id AND c.d = greatest(5.0, least(150.0, r.d + CASE WHEN r.n < 20 THEN -5.0 ELSE 5.0 END)) WHERE r.i < 10 AND NOT r.n BETWEEN 20 AND 30)",
    ]) + " SELECT video_id, arg_max(d, i) AS difference, CAST(arg_max(n, i) AS BIGINT) AS kept FROM r GROUP BY 1"
)
def adaptive_threshold(spark, sf_dir):
    return timeline.adaptive_threshold(T.frames(spark, sf_dir), "signal", 50.0, 5.0, 5.0, 150.0, 20, 30)


@query(
    "WITH RECURSIVE " + ", ".join([
        T.FRAMES_SQL, POSITION_SQL,
        "f AS (SELECT video_id, pos, [frame_index] AS ids, [ts] AS times, [signal] AS d FROM numbered WHERE pos = 0 UNION ALL SELECT n.video_id, n.pos, "
        "CASE WHEN n.ts - s.times[-1] >= 86400 THEN list_append(s.ids, n.frame_index) WHEN n.signal < s.d[-1] THEN list_append(s.ids[:-2], n.frame_index) ELSE s.ids END, "
        "CASE WHEN n.ts - s.times[-1] >= 86400 THEN list_append(s.times, n.ts) WHEN n.signal < s.d[-1] THEN list_append(s.times[:-2], n.ts) ELSE s.times END, "
        "CASE WHEN n.ts - s.times[-1] >= 86400 THEN list_append(s.d, n.signal) WHEN n.signal < s.d[-1] THEN list_append(s.d[:-2], n.signal) ELSE s.d END "
        "FROM f s JOIN numbered n ON n.video_id = s.video_id AND n.pos = s.pos + 1)",
        "e AS (SELECT video_id, ids, row_number() OVER (PARTITION BY video_id ORDER BY pos DESC) AS r FROM f)",
    ]) + " SELECT video_id, unnest(ids) AS frame_index FROM e WHERE r = 1"
)
def temporal_spacing(spark, sf_dir):
    return timeline.temporal_spacing(T.frames(spark, sf_dir), "signal", 86400.0).select("video_id", "frame_index")


@query(
    "WITH RECURSIVE " + ", ".join([
        T.FEATURES_SQL, STEP_SQL, CUT_SQL, "marked AS (SELECT *, coalesce(distance > 1.0, false) AS cut FROM cuts)",
        fold_sql("f", "marked", "", "ts AS last, false AS taken", "CASE WHEN n.cut AND n.ts - s.last >= 2.0 THEN n.ts ELSE s.last END, n.cut AND n.ts - s.last >= 2.0"),
    ]) + " SELECT video_id, frame_index, ts FROM f WHERE taken"
)
def scene_min_duration(spark, sf_dir):
    marked = timeline.steps(T.features(spark, sf_dir)).withColumn("cut", F.coalesce(F.col("distance") > 1.0, F.lit(False)))
    return timeline.spaced_cuts(marked, "cut", 2.0).select("video_id", "frame_index", "ts")


# --- selection ------------------------------------------------------------------------------------------------------


def candidates(spark, sf_dir) -> DataFrame:
    return scores(spark, sf_dir).where("rejection_reason IS NULL").select("video_id", "frame_index", "ts", "cluster_id", "score", F.col("low_entropy").alias("is_low_entropy"), "entropy")


_BEST_SQL = "best AS (SELECT *, row_number() OVER (PARTITION BY video_id, cluster_id ORDER BY score DESC, frame_index) AS r FROM capped WHERE rejection_reason IS NULL)"


@query(with_sql(FACTOR_SQL, REJECT_SQL, SCORE_SQL, _BEST_SQL, select="SELECT video_id, cluster_id, frame_index, round(score, 6) AS score FROM best WHERE r = 1 AND NOT (low_entropy AND entropy < 2.5) AND score >= 0.4"))
def select_stage1(spark, sf_dir):
    return selection.first_stage_candidates(candidates(spark, sf_dir)).select("video_id", "cluster_id", "frame_index", F.round("score", 6).alias("score"))


def select_sql(source: str, most: int) -> str:
    """Both stages of the selection over ``source``: folds over cluster bests, then over the rest by score."""
    return (
        f"able AS ({source}), bests AS (SELECT *, row_number() OVER (PARTITION BY video_id, cluster_id ORDER BY score DESC, frame_index) AS r FROM able), "
        "q1 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cluster_id) AS i FROM bests WHERE r = 1 AND NOT (low_entropy AND entropy < 2.5) AND score >= 0.4), "
        "vs AS (SELECT video_id, count(DISTINCT cluster_id) AS k FROM able GROUP BY 1), "
        "s1 AS (SELECT video_id, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS times, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS cs FROM vs UNION ALL SELECT s.video_id, q.i, "
        "CASE WHEN len(list_filter(s.times, lambda t: abs(t - q.ts) < 0.5)) = 0 THEN list_append(s.times, q.ts) ELSE s.times END, CASE WHEN len(list_filter(s.times, lambda t: abs(t - q.ts) < 0.5)) = 0 THEN list_append(s.ids, q.frame_index) ELSE s.ids END, "
        "CASE WHEN len(list_filter(s.times, lambda t: abs(t - q.ts) < 0.5)) = 0 THEN list_append(s.cs, CAST(q.cluster_id AS BIGINT)) ELSE s.cs END FROM s1 s JOIN q1 q ON q.video_id = s.video_id AND q.i = s.i + 1), "
        "e1 AS (SELECT video_id, arg_max(times, i) AS times, arg_max(ids, i) AS ids, arg_max(cs, i) AS cs FROM s1 GROUP BY 1), "
        f"q2 AS (SELECT a.*, row_number() OVER (PARTITION BY a.video_id ORDER BY score DESC, a.frame_index) AS i FROM able a JOIN e1 USING (video_id) WHERE score >= 0.4 AND NOT list_contains(ids, a.frame_index) AND len(list_filter(cs, lambda c: c = a.cluster_id)) < {most}), "
        "s2 AS (SELECT video_id, CAST(0 AS BIGINT) AS i, times, ids, cs FROM e1 UNION ALL SELECT s.video_id, q.i, CASE WHEN ok THEN list_append(s.times, q.ts) ELSE s.times END, CASE WHEN ok THEN list_append(s.ids, q.frame_index) ELSE s.ids END, CASE WHEN ok THEN list_append(s.cs, CAST(q.cluster_id AS BIGINT)) ELSE s.cs END "
        f"FROM s2 s JOIN vs v ON v.video_id = s.video_id JOIN q2 q ON q.video_id = s.video_id AND q.i = s.i + 1, LATERAL (SELECT len(s.ids) < {most} * v.k AND len(list_filter(s.cs, lambda c: c = q.cluster_id)) < {most} AND len(list_filter(s.times, lambda t: abs(t - q.ts) < 1.0)) = 0 AS ok) o), "
        "e2 AS (SELECT video_id, arg_max(ids, i) AS ids FROM s2 GROUP BY 1), taken AS (SELECT video_id, unnest(ids) AS frame_index FROM e2)"
    )


def full_select_sql(source: str, most: int) -> str:
    body = ", ".join([FACTOR_SQL, REJECT_SQL, SCORE_SQL, select_sql(source, most)])
    return "WITH RECURSIVE " + body + " SELECT t.video_id, t.frame_index, a.ts, CAST(a.cluster_id AS INT) AS cluster_id, round(a.score, 6) AS score, CASE WHEN list_contains(e.ids, t.frame_index) THEN 1 ELSE 2 END AS stage FROM taken t JOIN able a ON a.frame_index = t.frame_index JOIN e1 e ON e.video_id = t.video_id"


@query(full_select_sql("SELECT * FROM capped WHERE rejection_reason IS NULL", 2))
def select_full(spark, sf_dir):
    return selection.select(candidates(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(full_select_sql("SELECT * FROM (SELECT *, count(*) FILTER (WHERE rejection_reason IS NULL) OVER (PARTITION BY video_id) AS passed FROM capped) WHERE rejection_reason IS NULL OR passed < 1", 3))
def select_up_to_three(spark, sf_dir):
    found = scores(spark, sf_dir).withColumn("is_low_entropy", F.col("low_entropy"))
    return selection.select_up_to_three(found).withColumn("score", F.round("score", 6))


def _summary_sql() -> str:
    """Everything between features and a summary: pace, weights, caps, prefilter, selection, scenes and stability."""
    shifted = []
    for i, shift in enumerate(scoring.SHIFTS):
        w = {f: max(0.01, BASE_WEIGHTS[f] + d) for f, d in zip(FACTORS, shift, strict=True)}
        shifted.append("round(" + " + ".join(f"{f} * CAST({w[f] / sum(w.values())!r} AS DOUBLE)" for f in FACTORS) + f", 9) AS s{i}")
    n = len(shifted)
    parts = [
        FACTOR_SQL, REJECT_SQL,
        "paces AS (SELECT video_id, CASE WHEN avg(motion) > 20 OR stddev_pop(motion) > 15 THEN 'fast' WHEN avg(motion) < 5 AND stddev_pop(motion) < 5 THEN 'slow' ELSE 'normal' END AS pacing FROM factors GROUP BY 1)",
        "scores AS (SELECT l.*, round(motion_context * 0.001 + " + " + ".join(f"{_weight_sql(f)} * {f}" for f in FACTORS) + ", 8) AS raw FROM ladder l JOIN paces USING (video_id))", CAPPED_SQL,
        "cl AS (SELECT video_id, count(DISTINCT cluster_id) AS clusters, count(*) FILTER (WHERE rejection_reason IS NULL) AS passed FROM capped GROUP BY 1)",
        select_sql("SELECT c.* FROM capped c JOIN cl USING (video_id) WHERE rejection_reason IS NULL OR passed < clusters", 2),
        "per AS (SELECT t.video_id, count(*) AS n, avg(temporal_coverage) AS coverage FROM taken t JOIN able a ON a.frame_index = t.frame_index GROUP BY 1)",
        STEP_SQL, CUT_SQL, SCENE_SQL, "sc AS (SELECT video_id, count(DISTINCT scene_id) AS scene_count FROM scened GROUP BY 1)", "base AS (SELECT video_id, max(ts) AS d, count(*) AS frames FROM features GROUP BY 1)",
        f"sh AS (SELECT a.video_id, frame_index, score, least(n, count(*) OVER (PARTITION BY a.video_id)) AS n, {', '.join(shifted)} FROM able a JOIN per ON per.video_id = a.video_id)",
        "rk AS (SELECT video_id, n, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= n AS base, " + ", ".join(f"row_number() OVER (PARTITION BY video_id ORDER BY s{i} DESC, frame_index) <= n AS t{i}" for i in range(n)) + " FROM sh)",
        "st AS (SELECT video_id, (" + " + ".join(f"count(*) FILTER (WHERE base AND t{i}) / max(n)" for i in range(n)) + f") / {n} AS r FROM rk GROUP BY 1)",
        "al AS (SELECT b.video_id, d, frames, scene_count, coalesce(n, 0) AS n, coalesce(coverage, 0.0) AS coverage, coalesce(r, 1.0) AS r, CASE WHEN d > 0 THEN coalesce(n, 0) / d ELSE 0.0 END AS density FROM base b JOIN sc USING (video_id) LEFT JOIN per USING (video_id) LEFT JOIN st USING (video_id))",
    ]
    return (
        "WITH RECURSIVE " + ", ".join(parts) + " SELECT video_id, n AS num_keyframes, scene_count, CASE WHEN density > 0.4 THEN 'Fast' WHEN density < 0.1 THEN 'Slow' ELSE 'Moderate' END AS video_pacing, "
        "CASE WHEN r >= 0.8 AND r > 0.9 THEN 'HIGH' WHEN r > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS summary_confidence, round(r, 6) AS stability_ratio, round(CASE WHEN n > 0 THEN d / (n * 2.0) ELSE 1.0 END, 6) AS compression_ratio, "
        "round(1 - n / frames, 6) AS redundancy_removed, round(coverage, 6) AS temporal_coverage_score, CASE WHEN density > 0.4 THEN 'High motion' WHEN density < 0.1 THEN 'Stable' ELSE 'Balanced' END || ' content summarized into ' || n || ' key moments (~' || CAST(round(density, 2) AS VARCHAR) || ' keyframes/sec).' AS summary_reason FROM al"
    )


@query(_summary_sql())
def video_summary(spark, sf_dir):
    found = summary.summarize(described(T.features(spark, sf_dir)))
    return found.select("video_id", "num_keyframes", "scene_count", "video_pacing", "summary_confidence", F.round("stability_ratio", 6).alias("stability_ratio"), F.round("compression_ratio", 6).alias("compression_ratio"), F.round("redundancy_removed", 6).alias("redundancy_removed"), F.round("temporal_coverage_score", 6).alias("temporal_coverage_score"), "summary_reason")


@query(with_sql(FACTOR_SQL, REJECT_SQL, SCORE_SQL, _BEST_SQL, "chosen AS (SELECT b.video_id, b.frame_index, f.features FROM best b JOIN features f ON b.frame_index = f.frame_index WHERE r = 1)", select="SELECT f.video_id, f.frame_index, round(min(list_distance(f.features, c.features)), 5) AS novelty FROM features f JOIN chosen c ON f.video_id = c.video_id GROUP BY 1, 2"))
def novelty_to_selected(spark, sf_dir):
    f = T.features(spark, sf_dir)
    best = selection.cluster_best(candidates(spark, sf_dir)).select("video_id", "frame_index").join(f.select("frame_index", "features"), "frame_index")
    found = selection.distance_to_selected(f, best, V.euclidean)
    return found.select("video_id", "frame_index", F.round(F.when(F.col("novelty") < 1e-9, 0.0).otherwise(F.col("novelty")), 5).alias("novelty"))


@query(with_sql(FACTOR_SQL, REJECT_SQL, SCORE_SQL, _BEST_SQL, select="SELECT video_id, frame_index FROM features WHERE frame_index NOT IN (SELECT frame_index FROM best WHERE r = 1)"))
def not_selected(spark, sf_dir):
    best = selection.cluster_best(candidates(spark, sf_dir))
    return selection.not_selected(T.features(spark, sf_dir), best).select("video_id", "frame_index")


MARKS_SQL = "marks AS (SELECT video_id, frame_index AS mark, ts AS start, coalesce(lead(ts) OVER (PARTITION BY video_id ORDER BY ts, frame_index), until) AS stop FROM (SELECT *, max(ts) OVER (PARTITION BY video_id) AS until FROM frames) WHERE frame_index % 9 = 0), bounds AS (SELECT *, stop = max(stop) OVER (PARTITION BY video_id) AS last FROM marks)"


@query(
    with_sql(
        T.FRAMES_SQL, MARKS_SQL,
        select="SELECT f.video_id, f.frame_index, mark, round(start, 6) AS start, round(stop, 6) AS stop FROM frames f LEFT JOIN bounds b ON f.video_id = b.video_id AND f.ts >= start AND (f.ts < stop OR (last AND f.ts = stop))",
    )
)
def frames_in_intervals(spark, sf_dir):
    """Frames of intervals of any length: every ninth frame begins one that ends where the next begins, the last with its video."""
    f = T.frames(spark, sf_dir)
    marked = f.withColumn("until", F.max("ts").over(W.partitionBy("video_id"))).where(F.col("frame_index") % 9 == 0)
    marks = marked.select("video_id", F.col("frame_index").alias("mark"), F.col("ts").alias("start"), F.coalesce(F.lead("ts").over(W.partitionBy("video_id").orderBy("ts", "frame_index")), "until").alias("end"))
    found = timeline.in_intervals(f, marks, 86400.0)
    return found.select("video_id", "frame_index", "mark", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"))


@query(
    with_sql(
        T.FEATURES_SQL, f"scenes AS ({SCENES})", "bounds AS (SELECT *, end_time = max(end_time) OVER (PARTITION BY video_id) AS last FROM scenes)",
        select="SELECT f.video_id, f.frame_index, scene_id FROM features f LEFT JOIN bounds b ON f.video_id = b.video_id AND f.ts >= start_time AND (f.ts < end_time OR (last AND f.ts = end_time))",
    )
)
def frames_in_scenes(spark, sf_dir):
    """The scene of each frame, by time."""
    f = T.features(spark, sf_dir)
    scenes = timeline.scenes(f).select("video_id", "scene_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"))
    return timeline.in_intervals(f.select("video_id", "frame_index", "ts"), scenes).select("video_id", "frame_index", "scene_id")
