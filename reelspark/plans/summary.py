"""From frames to a video's summary: pixels, clusters, factors, scores, selection, scenes and metrics in one plan.

Described frames have video_id, frame_index, ts, features, brightness, sharpness, edge_density, entropy and uniform, as
kernels.described gives them, and may have motion; clustered ones have cluster_id too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BASE_WEIGHTS, DEFAULT, FACTORS, Settings
from ..durable import cut, stored
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import clustering, kernels, scoring, selection, timeline


def low_entropy(settings: Settings = DEFAULT) -> Column:
    return (F.col("entropy") < settings.low_entropy) | F.col("uniform")


def factors(frames: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The six factors of each frame, rounded so that ties are ties everywhere.

    Without a column ``motion`` (kernels.motion_context), it is the distance of features to the frames before and after.
    """
    d = frames.join(scoring.centroids(frames), ["video_id", "cluster_id"]).withColumn("distance", V.euclidean(F.col("features"), F.col("centroid"))).withColumnRenamed("size", "cluster_size").drop("centroid")
    d = d.withColumn("low_entropy", low_entropy(settings))
    if "motion" not in frames.columns:
        order = timeline.in_order()
        d = d.withColumns({"before": V.euclidean(F.col("features"), F.lag("features").over(order)), "after": V.euclidean(F.col("features"), F.lead("features").over(order))})
        total = F.coalesce("before", F.lit(0.0)) + F.coalesce("after", F.lit(0.0))
        d = d.withColumn("motion", F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), total / 2).otherwise(total))
    d = timeline.segment_coverage(timeline.temporal_novelty(d, 1.0))
    made = {
        "representativeness": scoring.representativeness(F.col("distance")), "dominance": scoring.dominance(), "visual_richness": scoring.visual_richness(F.col("edge_density"), F.col("sharpness"), F.col("entropy"), F.col("low_entropy")),
        "temporal_coverage": F.col("temporal_coverage"), "visual_novelty": F.col("visual_novelty"), "motion_context": timeline.minmax(F.col("motion")),
    }
    return d.select("video_id", "frame_index", "ts", "cluster_id", "entropy", "low_entropy", F.col("edge_density").alias("edges"), "brightness", "motion", "distance", *[F.round(made[f], 9).alias(f) for f in FACTORS])


def rejected(found: DataFrame) -> DataFrame:
    reason, tag = scoring.rejection(*(F.col(c) for c in ("visual_richness", "brightness", "motion_context", "dominance", "edges", "entropy", "low_entropy")))
    return found.withColumns({"rejection_reason": reason, "reason_tag": tag})


def scored(found: DataFrame, weights: dict[str, Column] | None = None) -> DataFrame:
    by = weights or {k: F.lit(v) for k, v in BASE_WEIGHTS.items()}
    found = found.withColumn("raw", F.round(scoring.combined(by), 8))
    score, tag = scoring.capped(F.col("raw"), F.col("entropy"), F.col("edges"), F.col("low_entropy"))
    return found.withColumns({"score": score, "cap_tag": tag})


def keyframes(frames: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(scored frames that may be chosen, chosen keyframes with factors and confidence)."""
    found = rejected(factors(frames, settings))
    pace = found.groupBy("video_id").agg(F.avg("motion").alias("m"), F.stddev_pop("motion").alias("d")).select("video_id", scoring.pacing_by_motion(F.col("m"), F.col("d")).alias("pace"))
    found = scored(found.join(pace, "video_id"), scoring.weights(F.col("pace")))
    found = scoring.with_confidence(found, "score").withColumn("confidence", scoring.lowered(F.col("confidence"), F.col("entropy"), F.col("low_entropy")))
    clusters = F.size(F.collect_set("cluster_id").over(timeline.in_video()))
    # narrow rows, which selection, stability and the report all read
    able = cut(scoring.prefilter(found.withColumn("clusters", clusters), F.col("clusters")).withColumn("is_low_entropy", F.col("low_entropy")))
    chosen = selection.select(able, settings).select("video_id", "frame_index", "stage")
    return able, able.join(chosen, ["video_id", "frame_index"])


def from_images(frames: DataFrame, settings: Settings = DEFAULT, method: str = "histogram", inits: int | None = None) -> DataFrame:
    """Clustered frames (video_id, frame_index, ts, ...) from pixels (video_id, frame_index, ts, image), all but the clusters in one pass each.

    Redundant, dark, blurred and intro frames go; the rest are described, their features scaled to length 1 and clustered
    by video. Pixels end at the description, which is written once; only 14,400 grey bytes a frame go on, to its neighbours.
    """
    kept = kernels.redundancy_filter(frames, settings.similarity, method, blur=settings.blur, dark=settings.dark, skip=settings.skip_intro)
    found = stored(kernels.motion_context(kernels.described(kept))).withColumn("features", V.l2_normalize(F.col("features")))
    return clustering.cluster_frames(found, settings, inits)


def summarize_images(frames: DataFrame, settings: Settings = DEFAULT, method: str = "histogram", inits: int | None = None) -> DataFrame:
    """summarize of a table of images, such as files.image_frames gives."""
    return summarize(from_images(frames, settings, method, inits), settings)


def summarize(frames: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row per video with keyframes (array), counts, ratios, labels and scenes; videos without a keyframe have empty ones."""
    able, chosen = keyframes(frames, settings)
    item = F.struct("ts", "frame_index", "cluster_id", F.round("score", 4).alias("importance_score"), F.col("confidence").alias("importance_confidence"), F.round("distance", 4).alias("distance_to_centroid"), S.format_timestamp(F.col("ts")).alias("timestamp_formatted"), F.array_join(F.transform(scoring.ranked_factors(3), lambda x: x["name"]), ",").alias("top_factors"))
    per = chosen.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("keyframes"), F.count("*").alias("n"), F.avg("temporal_coverage").alias("coverage"))
    base = frames.groupBy("video_id").agg(F.max("ts").alias("duration"), F.count("*").alias("frames"))
    scenes = timeline.scenes(frames).groupBy("video_id").agg(F.count("*").alias("scene_count"))
    # how stable the top is, for as many frames as were chosen
    stable = scoring.stability_of(able.join(per.select("video_id", "n"), "video_id"), "score")
    met = base.join(per, "video_id", "left").join(scenes, "video_id").join(stable, "video_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    n, d = F.col("n"), F.col("duration")
    ratio = F.coalesce("stability_ratio", F.lit(1.0))
    return met.select(
        "video_id", "duration", n.alias("num_keyframes"), "scene_count", S.pacing_by_density(n, d).alias("video_pacing"), S.summary_confidence(ratio >= 0.8, ratio).alias("summary_confidence"), ratio.alias("stability_ratio"),
        S.compression_ratio(d, n).alias("compression_ratio"), S.redundancy_removed(n, F.col("frames")).alias("redundancy_removed"), F.coalesce("coverage", F.lit(0.0)).alias("temporal_coverage_score"), S.reason(n, d).alias("summary_reason"), "keyframes",
    )
