"""Factors, weights, scores and confidence of frames, as column expressions over video windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import BASE_WEIGHTS, FACTORS
from ..functions import scalars as S
from ..functions import vectors as V
from .timeline import in_video


def group_means(df: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """(by, mean, size): mean vectors, summed up on the map side; a row stays one row whatever its length."""
    return df.groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(features)))).alias("mean"), F.count("*").alias("size"))


def centroids(df: DataFrame, features: str = "features") -> DataFrame:
    """(video_id, cluster_id, centroid, size)."""
    return group_means(df, ["video_id", "cluster_id"], features).withColumnRenamed("mean", "centroid")


def with_distance(df: DataFrame, centres: DataFrame, features: str = "features") -> DataFrame:
    """``distance``: Euclidean, to the frame's own centroid."""
    return df.join(centres.select("video_id", "cluster_id", "centroid"), ["video_id", "cluster_id"]).withColumn("distance", V.euclidean(F.col(features), F.col("centroid"))).drop("centroid")


def representativeness(distance: Column) -> Column:
    low, high = F.min(distance).over(W.partitionBy("video_id", "cluster_id")), F.max(distance).over(W.partitionBy("video_id", "cluster_id"))
    return F.when(high - low > 1e-6, V.clamp01(1 - (distance - low) / (high - low))).otherwise(F.lit(1.0))


def dominance() -> Column:
    """The cluster's share of the video over the largest share, at most 0.8."""
    return F.least(F.lit(0.8), F.col("cluster_size") / F.max("cluster_size").over(in_video()))


def visual_richness(edges: Column, laplacian: Column, entropy: Column, low_entropy: Column) -> Column:
    base = 0.4 * F.least(edges, F.lit(0.2)) / 0.2 + 0.3 * F.least(laplacian, F.lit(300.0)) / 300 + 0.3 * F.least(entropy, F.lit(4.0)) / 4
    return base * F.when(low_entropy, 0.3).when(entropy < 3, 0.6).otherwise(1.0)


def pacing_by_motion(mean: Column, deviation: Column) -> Column:
    return F.when(mean.isNull(), "normal").when((mean > 20) | (deviation > 15), "fast").when((mean < 5) & (deviation < 5), "slow").otherwise("normal")


def weights(pacing: Column) -> dict[str, Column]:
    """The weight of each factor by pacing."""
    fast = {"motion_context": 0.15, "dominance": 0.10}
    slow = {"visual_richness": 0.25, "motion_context": 0.05}
    return {f: F.when(pacing == "fast", fast.get(f, BASE_WEIGHTS[f])).when(pacing == "slow", slow.get(f, BASE_WEIGHTS[f])).otherwise(BASE_WEIGHTS[f]) for f in FACTORS}


def combined(by: dict[str, Column]) -> Column:
    """The weighted sum of the factor columns and a thousandth of motion, which breaks ties; nothing is random."""
    out = F.col("motion_context") * 0.001
    for f in FACTORS:
        out = out + by[f] * F.col(f)
    return out


# Reasons and tags of the reject ladder, in its order.
def rejection(richness: Column, brightness: Column, motion: Column, dominant: Column, edges: Column, entropy: Column, low_entropy: Column) -> tuple[Column, Column]:
    """(reason, tag) of the first rule that rejects a frame, null if none does. Missing values have neutral defaults."""
    richness, brightness, motion, edges = F.coalesce(richness, F.lit(0.5)), F.coalesce(brightness, F.lit(128.0)), F.coalesce(motion, F.lit(0.5)), F.coalesce(edges, F.lit(0.1))
    rules = [
        (low_entropy & (edges < 0.05), "Flat surface (low entropy + low edges)", "flat_surface_rejected"),
        (low_entropy & (entropy < 2.0), "Uniform surface (very low entropy)", "low_entropy_rejected"),
        (richness < 0.25, "Low visual richness", "low_richness_rejected"),
        (brightness < 25, "Too dark", "dark_rejected"),
        (brightness > 240, "Too bright/washed out", "bright_rejected"),
        ((motion < 0.1) & (F.coalesce(dominant, F.lit(0.0)) < 0.3), "Static and unimportant", "static_rejected"),
    ]
    return S.first_match(*[(c, reason) for c, reason, _ in rules]), S.first_match(*[(c, tag) for c, _, tag in rules])


def prefilter(df: DataFrame, least: Column) -> DataFrame:
    """Frames without a rejection_reason; all frames of a video of which fewer than ``least`` would pass."""
    passed = F.count_if(F.col("rejection_reason").isNull()).over(in_video())
    return df.withColumn("passed", passed).where(F.col("rejection_reason").isNull() | (F.col("passed") < least)).drop("passed")


def capped(score: Column, entropy: Column, edges: Column, low_entropy: Column) -> tuple[Column, Column]:
    """(score, tag) after the caps for frames of low entropy."""
    very = low_entropy & (entropy < 2.0) & (F.coalesce(edges, F.lit(0.1)) < 0.05)
    low = low_entropy & (entropy < 2.5)
    value = F.when(very, F.least(score, F.lit(0.25))).when(low, F.least(score, F.lit(0.35))).otherwise(score)
    tag = F.when(very, F.when(score > 0.25, "hard_entropy_penalty_very_low")).when(low, F.when(score > 0.35, "hard_entropy_penalty_low")).when(low_entropy, "entropy_penalty_moderate_applied")
    return value, tag


def with_confidence(df: DataFrame, score: str) -> DataFrame:
    """``confidence``: HIGH and LOW at the order statistics of 80 and 20 % of the video's scores; fixed bounds below five frames."""
    ranked = df.withColumns({"_n": F.count("*").over(in_video()), "_r": F.row_number().over(W.partitionBy("video_id").orderBy(score))})
    at = lambda q: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * q) + 1, F.col(score))).over(in_video())
    few = F.when(F.col(score) > 0.7, "HIGH").when(F.col(score) < 0.4, "LOW").otherwise("MEDIUM")
    level = F.when(F.col("_n") < 5, few).when(F.col(score) >= F.col("_high"), "HIGH").when(F.col(score) <= F.col("_low"), "LOW").otherwise("MEDIUM")
    return ranked.withColumns({"_low": at(0.2), "_high": at(0.8)}).withColumn("confidence", level).drop("_n", "_r", "_low", "_high")


def lowered(level: Column, entropy: Column, low_entropy: Column) -> Column:
    """Confidence of frames of low entropy."""
    return F.when(low_entropy & (entropy < 2.5), "LOW").when(low_entropy, "MEDIUM").otherwise(level)


#: Five perturbations of the six weights, each within 0.05, in the order of FACTORS.
SHIFTS = ((0.05, -0.03, 0.02, -0.05, 0.01, 0.04), (-0.04, 0.05, -0.01, 0.03, -0.05, 0.02), (0.01, 0.02, -0.05, 0.05, 0.04, -0.03), (-0.05, -0.02, 0.04, 0.01, 0.03, -0.04), (0.03, 0.04, -0.03, -0.02, -0.04, 0.05))


def stability(df: DataFrame, score: str, top: int, by: dict[str, float] = BASE_WEIGHTS) -> DataFrame:
    """stability_of for a fixed number of frames at the top."""
    return stability_of(df.withColumn("n", F.lit(top)), score, by)


def stability_of(df: DataFrame, score: str, by: dict[str, float] = BASE_WEIGHTS) -> DataFrame:
    """(video_id, stability_ratio, stable): how much of the ``n`` (a column) frames at the top by score stays there under perturbed weights.

    Weights are shifted by the fixed table, at least 0.01, and scaled to 1. Videos without frames aren't in the result.
    """
    rank = lambda c: F.row_number().over(W.partitionBy("video_id").orderBy(F.desc(c), "frame_index"))
    found = df.withColumn("n", F.least("n", F.count("*").over(in_video()))).withColumn("first", rank(F.col(score)) <= F.col("n"))
    ratio = F.lit(0.0)
    for i, shift in enumerate(SHIFTS):
        w = {f: max(0.01, by[f] + d) for f, d in zip(FACTORS, shift, strict=True)}
        total = sum(w.values())
        value = F.lit(0.0)
        for f in FACTORS:
            value = value + F.col(f) * (w[f] / total)
        found = found.withColumn(f"s{i}", F.round(value, 9)).withColumn(f"t{i}", rank(F.col(f"s{i}")) <= F.col("n"))
        ratio = ratio + F.count_if(F.col("first") & F.col(f"t{i}")) / F.max("n")
    out = found.groupBy("video_id").agg((ratio / len(SHIFTS)).alias("stability_ratio"))
    return out.withColumn("stable", F.col("stability_ratio") >= 0.8)


def ranked_factors(k: int = 3) -> Column:
    """The k largest factors, largest first, ties in the order of FACTORS."""
    items = F.array(*[F.struct((-F.col(f)).alias("v"), F.lit(i).alias("i"), F.lit(f).alias("name")) for i, f in enumerate(FACTORS)])
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.struct(x["name"].alias("name"), (-x["v"]).alias("value")))


#: Labels that a frame is compared with at most.
MOST_LABELS = 10_000


#: Labels whose similarities to a batch's frames are one product.
LABEL_BLOCK = 1024


def softmax_top(df: DataFrame, labels: DataFrame, features: str = "features", scale: float = 100.0, block: int = LABEL_BLOCK) -> DataFrame:
    """The best label of each frame: softmax of scaled cosine over the labels (label, vector), at most MOST_LABELS; of equal ones the smallest.

    The labels' unit vectors are one matrix, which each task gets once; a batch of frames meets it in blocks, with the largest
    similarity and the sum of exponentials relative to it carried on, so no pair is a row. Frames whose vector is null have
    no row, a zero vector is as far from all labels; vectors of several lengths are an error.
    """
    found = labels.where(F.col("vector").isNotNull()).limit(MOST_LABELS + 1).toPandas().sort_values("label", kind="stable")
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    schema = f"video_id {df.schema['video_id'].dataType.simpleString()}, frame_index {df.schema['frame_index'].dataType.simpleString()}, label {labels.schema['label'].dataType.simpleString()}, score double"
    if not len(found):
        return df.sparkSession.createDataFrame([], schema)
    matrix = np.array(found["vector"].tolist(), float)
    shared = df.sparkSession.sparkContext.broadcast((matrix / _lengths(matrix)[:, None], found["label"].tolist()))

    kind = to_arrow_type(labels.schema["label"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names = shared.value
        for batch in batches:
            values = batch.column(2)
            x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1) if len(values) else np.zeros((0, unit.shape[1]))
            x = x / _lengths(x)[:, None]
            top, total, best = np.full(len(x), -np.inf), np.zeros(len(x)), np.zeros(len(x), np.int64)
            for at in range(0, len(unit), block):
                s = scale * (x @ unit[at : at + block].T)
                k = s.argmax(axis=1)
                here = s[np.arange(len(x)), k]
                best = np.where(here > top, at + k, best)
                new = np.maximum(top, here)
                total = total * np.exp(top - new) + np.exp(s - new[:, None]).sum(axis=1)
                top = new
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([names[k] for k in best.tolist()], kind), pa.array(1 / total)], names=["video_id", "frame_index", "label", "score"])

    return df.where(F.col(features).isNotNull()).select("video_id", "frame_index", features).mapInArrow(work, schema)


def _lengths(x: np.ndarray) -> np.ndarray:
    """The rows' lengths, 1 for a zero row."""
    n = np.sqrt((x * x).sum(axis=1))
    return np.where(n > 0, n, 1.0)


def zero_shot(df: DataFrame, labels: DataFrame | None = None, features: str = "features") -> DataFrame:
    """(video_id, frame_index, label, score): the best of the labels (label as text, vector); the fallback label without any."""
    if labels is None:
        return df.select("video_id", "frame_index", F.lit(S.NO_LABEL[0]).alias("label"), F.lit(S.NO_LABEL[1]).alias("score"))
    return softmax_top(df, labels, features)
