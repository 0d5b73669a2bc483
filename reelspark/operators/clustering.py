"""Choosing and making clusters: range of k, elbow, silhouette, sweeps per video and corpus-wide k-means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..durable import stored
from ..functions import vectors as V
from . import kmeans, scoring, timeline


def k_range(n: Column, duration: Column, settings: Settings = DEFAULT) -> tuple[Column, Column]:
    """(least, most) number of clusters for n frames of a video."""
    low = F.when(duration > 0, F.greatest(F.lit(settings.min_clusters), F.floor(duration / 4).cast("int"))).otherwise(settings.min_clusters)
    high = F.when(n > 2, F.least(F.lit(settings.max_clusters), n - 1)).otherwise(2).cast("int")
    return F.least(low, high), high


def elbow(curve: DataFrame) -> DataFrame:
    """(video_id, elbow): the place from 0 of the first largest distance to the chord of the scaled curve (k, wcss); 0 below three points."""
    v = W.partitionBy("video_id")
    by_k = v.orderBy("k")
    x = (F.col("k") - F.min("k").over(v)) / F.greatest(F.max("k").over(v) - F.min("k").over(v), F.lit(1))
    y = (F.col("wcss") - F.min("wcss").over(v)) / (F.max("wcss").over(v) - F.min("wcss").over(v) + 1e-10)
    found = curve.withColumns({"x": x, "y": y}).withColumn("i", F.row_number().over(by_k) - 1)
    whole = by_k.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    dx, dy = F.last("x").over(whole) - F.first("x").over(whole), F.last("y").over(whole) - F.first("y").over(whole)
    away = F.coalesce(F.try_divide(F.abs(dx * (F.col("y") - F.first("y").over(whole)) - dy * (F.col("x") - F.first("x").over(whole))), F.sqrt(dx * dx + dy * dy)), F.lit(0.0))
    found = found.withColumn("away", F.round(away, 9))
    best = found.groupBy("video_id").agg(F.max(F.struct("away", (-F.col("i")).alias("i"))).alias("m"), F.count("*").alias("n"))
    return best.select("video_id", F.when(F.col("n") < 3, 0).otherwise(-F.col("m.i")).cast("bigint").alias("elbow"))


def choose_k(curve: DataFrame, frames: Column) -> DataFrame:
    """(video_id, k) from a curve (k, wcss, silhouette, frames): the later of elbow and best silhouette, at least near sqrt(n)."""
    best = curve.groupBy("video_id").agg(F.max(F.struct(F.round("silhouette", 9).alias("s"), (-F.col("k")).alias("k"))).alias("m"), F.min("k").alias("low"), F.max("k").alias("high"), F.max(frames).alias("n"))
    met = best.join(elbow(curve), "video_id").withColumn("root", F.floor(F.sqrt("n")).cast("int"))
    place = F.greatest(F.col("elbow"), -F.col("m.k") - F.col("low"))
    near = (F.col("root") > F.col("low")) & (F.col("root") <= F.col("high") - F.col("low"))
    place = F.when(near, F.greatest(place, F.col("root") - F.col("low"))).otherwise(place)
    return met.select("video_id", F.least(F.col("low") + place, F.col("high")).cast("bigint").alias("k"))


def wcss(df: DataFrame, group: str, by: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """(by, wcss): squared distances to the means of each group, from its mean vector and its sum of squares."""
    squares = df.withColumn("square", V.dot(F.col("features"), F.col("features")))
    mean = vector_to_array(Summarizer.mean(array_to_vector("features")))
    parts = squares.groupBy(*by, group).agg(F.sum("square").alias("square"), mean.alias("mean"), F.count("*").alias("n"))
    return parts.groupBy(*by).agg(F.sum(F.col("square") - F.col("n") * V.dot(F.col("mean"), F.col("mean"))).alias("wcss"))


#: Frames of one side of a pair of blocks whose distances are one matrix.
BLOCK = 512


def silhouette(df: DataFrame, by: tuple[str, ...] = ("video_id",), block: int = BLOCK) -> DataFrame:
    """(by, silhouette): the exact Euclidean mean over frames of given clusters; 0 for a video of one cluster.

    Frames meet the other frames of their own video only, in pairs of blocks: a task makes one matrix of distances, of
    bounded size, and returns its sums by frame and cluster, never the pairs.
    """
    blocks = F.ceil(F.count("*").over(W.partitionBy(*by)) / block).cast("int")
    dealt = df.select(*by, "frame_index", F.col("cluster_id").alias("own"), "features", blocks.alias("blocks")).withColumn("b", F.pmod(F.xxhash64("frame_index"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("b", "other"), "j": F.greatest("b", "other")}).drop("blocks", "other")
    kinds = dict(met.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "frame_index", "own")) + f", theirs {kinds['own']}, total double, n long"

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a, b = pdf[pdf["b"] == i], pdf[pdf["b"] == j]
        return pd.concat([one_way(a, b), *([one_way(b, a)] if i != j else [])])

    def one_way(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: a[c].iloc[:0] for c in (*by, "frame_index", "own")}).assign(theirs=a["own"].iloc[:0], total=0.0, n=0)
        d = distances(np.stack(a["features"]), np.stack(b["features"]))
        d[a["frame_index"].to_numpy()[:, None] == b["frame_index"].to_numpy()[None, :]] = 0
        names, place = np.unique(b["own"].to_numpy(), return_inverse=True)
        member = np.eye(len(names))[place]
        out = a.loc[a.index.repeat(len(names)), [*by, "frame_index", "own"]].reset_index(drop=True)
        return out.assign(theirs=np.tile(names, len(a)), total=(d @ member).ravel(), n=np.tile(member.sum(axis=0).astype(int), len(a)))

    found = met.groupBy(*by, "i", "j").applyInPandas(sums, schema)
    mean = found.groupBy(*by, "frame_index", "own", "theirs").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    others = F.when(F.col("own") == F.col("theirs"), F.col("n") - 1).otherwise(F.col("n"))  # a frame isn't its own neighbour
    d = F.try_divide(F.col("total"), others)
    inner, outer = F.max(F.when(F.col("own") == F.col("theirs"), d)), F.min(F.when(F.col("own") != F.col("theirs"), d))
    each = mean.groupBy(*by, "frame_index").agg(inner.alias("a"), outer.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.groupBy(*by).agg(F.avg(s).alias("silhouette"))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances between rows; centred first, so that products lose little to large means."""
    middle = x.mean(axis=0)
    return np.sqrt(kmeans.squared(x - middle, c - middle))


def lloyd(x: np.ndarray, k: int, inits: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """k-means++ and Lloyd steps with all distances; labels, centres and inertia of the best of ``inits`` starts."""
    return min((kmeans.plain_run(x, k, start, steps, seed) for start in range(inits)), key=lambda run: run[2])


def mean_silhouette(x: np.ndarray, labels: np.ndarray, block: int = BLOCK) -> float:
    """Exact Euclidean silhouette of one video's frames, some at a time; 0 unless there are between 2 and n - 1 clusters."""
    names, own = np.unique(labels, return_inverse=True)
    if not 2 <= len(names) < len(x):
        return 0.0
    member = np.eye(len(names))[own]
    sizes, total = member.sum(axis=0), 0.0
    for at in range(0, len(x), block):
        rows = np.arange(at, min(at + block, len(x)))
        d = np.sqrt(kmeans.squared(x[rows], x))
        d[rows - at, rows] = 0
        sums, mine = d @ member, own[rows]
        a = sums[rows - at, mine] / np.maximum(sizes[mine] - 1, 1)
        means = sums / sizes
        means[rows - at, mine] = np.inf
        b = means.min(axis=1)
        total += float(np.where(sizes[mine] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-12)).sum())
    return total / len(x)


def best_runs(df: DataFrame, settings: Settings = DEFAULT, inits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, best): the frames of videos of three frames or more with their place, and kmeans.runs of them; both are kept."""
    v = W.partitionBy("video_id")
    placed = df.select("video_id", "frame_index", "features", (F.row_number().over(v.orderBy("frame_index")) - 1).alias("pos"), F.count("*").over(v).cast("int").alias("n"), F.max("ts").over(v).alias("duration"))
    low, high = k_range(F.col("n"), F.col("duration"), settings)
    frames = stored(placed.where("n >= 3").select("video_id", "frame_index", "features", "pos", low.alias("low"), high.alias("high")))
    starts = settings.kmeans_inits if inits is None else inits
    return frames, stored(kmeans.runs(frames, F.col("low"), F.col("high"), starts, settings.kmeans_steps, settings.seed))


def _curve(df: DataFrame, frames: DataFrame, best: DataFrame) -> DataFrame:
    labelled = frames.select("video_id", "frame_index", "features", "pos").join(kmeans.labels_of_frames(best), ["video_id", "pos"])
    shape = kmeans.silhouettes(labelled)
    first = best.groupBy("video_id").agg(F.min("k").alias("low"))
    place = best.join(first, "video_id").select("video_id", "k", "wcss", "frames", (F.col("k") - F.col("low")).alias("place"), F.aggregate(F.array_distinct("labels"), F.lit(0), lambda a, _: a + 1).alias("clusters"))
    met = place.join(shape, ["video_id", "place"])
    # as many clusters as frames have no silhouette
    curve = met.select("video_id", "k", "wcss", F.when((F.col("clusters") >= 2) & (F.col("clusters") < F.col("frames")), F.col("silhouette")).otherwise(0.0).alias("silhouette"), "frames")
    few = df.groupBy("video_id").agg(F.count("*").alias("frames")).where("frames < 3")
    return curve.unionByName(few.select("video_id", F.col("frames").cast("int").alias("k"), F.lit(0.0).alias("wcss"), F.lit(0.0).alias("silhouette"), "frames"))


def sweep(df: DataFrame, settings: Settings = DEFAULT, inits: int | None = None) -> DataFrame:
    """(video_id, k, wcss, silhouette, frames): k-means of each video for each k of its range, the best of ``inits`` starts.

    A long video's runs are spread over tasks, and its distances are made once for the silhouettes of all k. Videos of
    fewer than three frames have one row, k = n and wcss 0.
    """
    return _curve(df, *best_runs(df, settings, inits))


def cluster_frames(df: DataFrame, settings: Settings = DEFAULT, inits: int | None = None) -> DataFrame:
    """``df`` with cluster_id and k: the labels of the sweep's choice for each video.

    Each frame of a video of fewer than three is a cluster of its own.
    """
    frames, best = best_runs(df, settings, inits)
    chosen = choose_k(_curve(df, frames, best), F.col("frames")).withColumn("k", F.col("k").cast("int"))
    labels = best.join(chosen, ["video_id", "k"]).select("video_id", "k", F.posexplode("labels").alias("pos", "cluster_id"))
    labelled = frames.select("video_id", "frame_index", "pos").join(labels, ["video_id", "pos"]).select("video_id", "frame_index", "cluster_id", "k")
    v = W.partitionBy("video_id")
    few = df.select("video_id", "frame_index", (F.row_number().over(v.orderBy("frame_index")) - 1).alias("cluster_id"), F.count("*").over(v).cast("int").alias("k")).where("k < 3")
    return (df.drop("cluster_id") if "cluster_id" in df.columns else df).join(labelled.unionByName(few), ["video_id", "frame_index"])


def representatives(df: DataFrame) -> DataFrame:
    """(video_id, cluster_id, frame_index, ts, distance): each cluster's frame nearest to its centroid, of equals the first."""
    near = scoring.with_distance(df, scoring.centroids(df))
    best = near.groupBy("video_id", "cluster_id").agg(F.min(F.struct(F.round("distance", 9).alias("d"), "frame_index", "ts", "distance")).alias("m"))
    return best.select("video_id", "cluster_id", "m.frame_index", "m.ts", "m.distance")


def cluster_and_select(df: DataFrame, settings: Settings = DEFAULT, gap: float = 0.0, inits: int | None = None) -> DataFrame:
    """(video_id, ts, frame_index, distance): clusters, their representatives, and of these the ones at least ``gap`` apart."""
    found = representatives(cluster_frames(df, settings, inits))
    return timeline.temporal_spacing(found, "distance", gap)


def corpus_kmeans(df: DataFrame, k: int, settings: Settings = DEFAULT) -> DataFrame:
    """``cluster_id`` by k-means over all rows, for corpora rather than videos."""
    from pyspark.ml.clustering import KMeans

    rows = df.withColumn("vector", array_to_vector("features"))
    model = KMeans(k=k, seed=settings.seed, maxIter=settings.kmeans_steps, featuresCol="vector", predictionCol="cluster_id").fit(rows)
    return model.transform(rows.drop("cluster_id") if "cluster_id" in rows.columns else rows).drop("vector")
