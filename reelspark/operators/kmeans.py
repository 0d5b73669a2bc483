"""K-means of single videos, run by run, and exact silhouettes of many labellings in one pass over distances.

The unit of work is one run: a video, a number of clusters and a start. A long video's runs are tasks of their own; short
videos' runs share tasks. A run is Lloyd's with bounds by the triangle inequality, which skip most distances and change no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frames times runs of one group, about: a video of so many frames has each run in a group of its own.
GROUP_FRAMES = 1 << 15
#: Frames of a short video: all distances between its rows are made once for all runs of a group.
SHORT = 512
#: Frames whose distances to all others of their video one task sums up.
BLOCK = 512
#: Frames that they are compared with at once.
AT_ONCE = 2048


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between rows, by products."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), 0)


def start_centres(x: np.ndarray, k: int, seed: int, start: int, among: np.ndarray | None = None) -> np.ndarray:
    """The k-means++ centres of a start; each has random numbers of its own, so runs may be made anywhere.

    ``among`` has the squared distances between all rows, if they were made before: every centre is a row.
    """
    rng = np.random.default_rng([seed, k, start])
    away = (lambda i: among[i]) if among is not None else lambda i: squared(x, x[i : i + 1])[:, 0]
    rows = [int(rng.integers(len(x)))]
    d = away(rows[0])
    for _ in range(1, k):
        total = d.sum()
        if total > 0:  # as rng.choice with these shares, without its checks
            shares = (d / total).cumsum()
            rows.append(int((shares / shares[-1]).searchsorted(rng.random(), side="right")))
        else:
            rows.append(int(rng.integers(len(x))))
        d = np.minimum(d, away(rows[-1]))
    return x[rows].astype(float)


def means(x: np.ndarray, labels: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each cluster's mean; an empty one stays where it was."""
    order = np.argsort(labels, kind="stable")
    sizes = np.bincount(labels, minlength=len(before))
    out, there = before.copy(), np.flatnonzero(sizes)
    out[there] = np.add.reduceat(x[order], np.r_[0, np.cumsum(sizes[there])[:-1]], axis=0) / sizes[there][:, None]
    return out


def inertia_of(x: np.ndarray, labels: np.ndarray, c: np.ndarray) -> float:
    return float(((x - c[labels]) ** 2).sum())


def settled(new: np.ndarray, c: np.ndarray) -> bool:
    """np.allclose of finite centres, which costs several times as much for few of them."""
    return bool((np.abs(new - c) <= 1e-8 + 1e-5 * np.abs(c)).all())


def plain_run(x: np.ndarray, k: int, start: int, steps: int, seed: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Lloyd's from one start with all distances: labels, centres, inertia."""
    c = start_centres(x, k, seed, start, among)
    for _ in range(steps):
        new = means(x, squared(x, c).argmin(axis=1), c)
        if settled(new, c):
            break
        c = new
    labels = squared(x, c).argmin(axis=1)
    return labels, c, inertia_of(x, labels, c)


class BoundedRun:
    """Lloyd's from one start that keeps, for each row, an upper bound of the distance to its centre and a lower one to any other.

    A row whose upper bound lies below its lower bound, or below half the way from its centre to the nearest other one, keeps
    its label unseen. ``distances`` counts those that were made, between rows and centres and among centres.
    """

    def __init__(self, x: np.ndarray, k: int, start: int, steps: int, seed: int):
        self.x, self.k, self.distances = x, k, 0
        c = start_centres(x, k, seed, start)
        self.labels = np.zeros(len(x), np.int64)
        self.upper, self.lower = np.full(len(x), np.inf), np.zeros(len(x))
        #: Bounds closer than this are taken as equal, and all distances made: products lose digits.
        self.slack = 1e-7 * (1 + float(np.sqrt((x * x).sum(axis=1).max(initial=0))))
        for _ in range(steps):
            self._assign(c)
            new = means(x, self.labels, c)
            if settled(new, c):
                break
            self._move(c, new)
            c = new
        self._assign(c)
        self.centres, self.inertia = c, inertia_of(x, self.labels, c)

    def _assign(self, c: np.ndarray) -> None:
        between = np.sqrt(squared(c, c))
        self.distances += self.k * (self.k - 1) // 2
        np.fill_diagonal(between, np.inf)
        sure = np.maximum(between.min(axis=1)[self.labels] / 2, self.lower)
        open_ = np.flatnonzero(self.upper + self.slack >= sure)
        if np.isfinite(self.upper[open_]).all():  # not the first time: the own distance may do
            own = np.sqrt(((self.x[open_] - c[self.labels[open_]]) ** 2).sum(axis=1))
            self.distances += len(open_)
            self.upper[open_] = own
            open_ = open_[own + self.slack >= sure[open_]]
        if not len(open_):
            return
        d = squared(self.x[open_], c)
        self.distances += d.size
        self.labels[open_] = best = d.argmin(axis=1)
        rows = np.arange(len(open_))
        self.upper[open_] = np.sqrt(d[rows, best])
        d[rows, best] = np.inf
        self.lower[open_] = np.sqrt(d.min(axis=1))

    def _move(self, old: np.ndarray, new: np.ndarray) -> None:
        way = np.sqrt(((new - old) ** 2).sum(axis=1))
        self.upper += way[self.labels]
        far = int(way.argmax())
        others = np.where(self.labels == far, np.delete(way, far).max(initial=0), way[far])
        self.lower = np.maximum(self.lower - others, 0)


def one_run(x: np.ndarray, k: int, start: int, steps: int, seed: int, among: np.ndarray | None) -> tuple[np.ndarray, float]:
    """Labels and inertia of a run; a short video's distances (``among`` is given) cost less than bounds of them."""
    if among is not None:
        labels, _, inertia = plain_run(x, k, start, steps, seed, among)
        return labels, inertia
    run = BoundedRun(x, k, start, steps, seed)
    return run.labels, run.inertia


def deal(frames: DataFrame, low: Column, high: Column, starts: int, group_frames: int = GROUP_FRAMES) -> DataFrame:
    """``frames`` once for each group g of their video's runs; a group has about ``group_frames`` frames times runs, one run at least."""
    n = F.count("*").over(W.partitionBy("video_id"))
    sized = frames.select("video_id", "pos", "features", low.cast("int").alias("low"), high.cast("int").alias("high"), n.alias("n"))
    total = (F.col("high") - F.col("low") + 1) * starts
    groups = F.least(total, F.ceil(total * F.col("n") / F.lit(group_frames))).cast("int")
    return sized.withColumn("groups", groups).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))


def runs(frames: DataFrame, low: Column, high: Column, starts: int, steps: int, seed: int, group_frames: int = GROUP_FRAMES) -> DataFrame:
    """(video_id, k, wcss, labels, frames): for each k from ``low`` to ``high`` of a video its best run of ``starts``.

    ``frames`` has video_id, pos (from 0 in each video) and features; labels are in the order of pos. Of equal runs the
    first start counts. A video is sent once for each group of runs, of which there are as many as its length asks for.
    """
    dealt = deal(frames, low, high, starts, group_frames)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first = pdf.iloc[0]
        x = np.stack(pdf["features"])
        x = x - x.mean(axis=0)
        among = squared(x, x) if len(x) <= SHORT else None
        lowest, g, groups, all_ = int(first["low"]), int(first["g"]), int(first["groups"]), (int(first["high"]) - int(first["low"]) + 1) * starts
        best: dict[int, tuple] = {}
        for r in range(all_ * g // groups, all_ * (g + 1) // groups):
            k, start = lowest + r // starts, r % starts
            labels, inertia = one_run(x, min(k, len(x)), start, steps, seed, among)
            if k not in best or inertia < best[k][0]:
                best[k] = inertia, start, labels
        out = pd.DataFrame({"k": list(best), "wcss": [b[0] for b in best.values()], "start": [b[1] for b in best.values()], "labels": [b[2].astype(np.int32) for b in best.values()]})
        return out.assign(video_id=first["video_id"], frames=len(x))

    found = dealt.groupBy("video_id", "g").applyInPandas(work, "video_id long, k int, wcss double, start int, labels array<int>, frames long")
    order = F.struct("wcss", "start")
    return found.groupBy("video_id", "k").agg(F.min("wcss").alias("wcss"), F.min_by("labels", order).alias("labels"), F.first("frames").alias("frames"))


def labels_of_frames(best: DataFrame) -> DataFrame:
    """(video_id, pos, labels): of ``runs``, each frame's labels by ascending k."""
    each = best.select("video_id", "k", F.posexplode("labels").alias("pos", "label"))
    met = each.groupBy("video_id", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("l"))
    return met.select("video_id", "pos", F.transform("l", lambda x: x["label"]).alias("labels"))


class _Sums:
    """Distances of some frames to all frames of their video, summed by labelling and cluster."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, labels: np.ndarray):
        self.ids, self.x, self.labels, self.made = ids, x, labels, 0
        self.place: dict[tuple[int, int], int] = {}
        self.sums, self.sizes = np.zeros((len(x), 0)), np.zeros(0)

    def add(self, ids: np.ndarray, x: np.ndarray, labels: np.ndarray) -> None:
        middle = self.x.mean(axis=0)  # centred, so that products lose little to large means
        d = np.sqrt(squared(self.x - middle, x - middle))
        d[self.ids[:, None] == ids[None, :]] = 0
        self.made += d.size
        for t in range(labels.shape[1]):
            for c in np.unique(labels[:, t]).tolist():
                self.place.setdefault((t, c), len(self.place))
        more = len(self.place) - len(self.sizes)
        self.sums, self.sizes = np.pad(self.sums, ((0, 0), (0, more))), np.pad(self.sizes, (0, more))
        member = np.zeros((len(x), len(self.place)))
        for t in range(labels.shape[1]):
            member[np.arange(len(x)), [self.place[t, c] for c in labels[:, t].tolist()]] = 1
        self.sums += d @ member
        self.sizes += member.sum(axis=0)

    def silhouettes(self) -> np.ndarray:
        """The sum over the frames of their silhouettes in each labelling; 0 for a cluster of one frame or a labelling of one cluster."""
        out, rows = np.zeros(self.labels.shape[1]), np.arange(len(self.x))
        for t in range(self.labels.shape[1]):
            columns = np.array([p for (u, _), p in self.place.items() if u == t])
            if len(columns) < 2:
                continue
            own = np.array([self.place[t, c] for c in self.labels[:, t].tolist()])
            a = self.sums[rows, own] / np.maximum(self.sizes[own] - 1, 1)
            mean = self.sums[:, columns] / self.sizes[columns]
            mean[columns[None, :] == own[:, None]] = np.inf
            b = mean.min(axis=1)
            top = np.maximum(a, b)
            out[t] = np.where((self.sizes[own] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top)).sum()
        return out


def silhouettes(frames: DataFrame, labels: str = "labels", block: int = BLOCK) -> DataFrame:
    """(video_id, place, silhouette): the exact mean Euclidean silhouette of each labelling of ``frames`` (video_id, frame_index, features, labels).

    ``labels`` is an array with a frame's cluster in each labelling, of one length in a video; ``place`` counts them from 0. A
    frame is sent once for each block of its video; a task makes the distances of one block to all frames, some at a time, once for
    all labellings, and puts out one sum for each. Empty tables give no rows; null frames of an array aren't allowed.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*").over(W.partitionBy("video_id")) / block)).cast("int")
    dealt = frames.select("video_id", "frame_index", "features", F.col(labels).alias("labels"), blocks.alias("blocks"))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("frame_index"), "blocks").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.select("video_id", "i", (F.col("b") != F.col("i")).alias("other"), "frame_index", "features", "labels")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sums, pending = None, [], None, []

        def arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, x, own = zip(*rows, strict=True)
            return np.array(ids), np.array(x, float), np.array(own, np.int64)

        def meet() -> None:
            nonlocal pending
            if pending:
                sums.add(*arrays(pending))
                pending = []

        def own_done() -> None:
            nonlocal sums, held
            if held:
                sums = _Sums(*arrays(held))
                for at in range(0, len(held), AT_ONCE):
                    sums.add(*arrays(held[at : at + AT_ONCE]))
                held = []

        def done() -> Iterator[pa.RecordBatch]:
            own_done()
            if sums is not None:
                meet()
                s = sums.silhouettes()
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(s), pa.int64()), pa.array(range(len(s)), pa.int32()), pa.array(s), pa.array([len(sums.x)] * len(s), pa.int64())], names=["video_id", "place", "total", "n"])

        for batch in batches:
            for video, i, other, *frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (video, i) != key:
                    if key is not None:
                        yield from done()
                    key, held, sums, pending = (video, i), [], None, []
                if not other:
                    held.append(frame)
                    continue
                own_done()
                if sums is not None:  # a block may have no frames of its own
                    pending.append(frame)
                    if len(pending) >= AT_ONCE:
                        meet()
        if key is not None:
            yield from done()

    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = met.repartition(n, "video_id", "i").sortWithinPartitions("video_id", "i", "other", "frame_index")
    found = ordered.mapInArrow(work, "video_id long, place int, total double, n long")
    return found.groupBy("video_id", "place").agg((F.sum("total") / F.sum("n")).alias("silhouette"))
