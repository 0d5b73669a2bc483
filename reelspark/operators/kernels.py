"""Pixel kernels of single frames in numpy, and the column functions that apply them in Arrow batches.

Frames are BGR bytes as Spark's image source gives them. Each kernel is a small function of one or two arrays; metrics of
a frame come from one pass (``frame_metrics``), so a filter on one of them doesn't evaluate the others again. Kernels of brightness,
sharpness, colours and uniformity take a frame or a stack of frames of one size (``stacks``), so small frames don't pay for each call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timeline import reachable, walk_thresholds


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luma in 14-bit fixed point, rounded, 0 to 255."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.float64)


def filter2d(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with borders mirrored about the edge pixel."""
    kh, kw = kernel.shape
    around = [(0, 0)] * (x.ndim - 2) + [(kh // 2, kh // 2), (kw // 2, kw // 2)]
    padded = np.pad(x, around, mode="reflect" if min(x.shape[-2:]) > max(kh, kw) // 2 else "symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (kh, kw), axis=(-2, -1))
    return np.einsum("...ijkl,kl->...ij", windows, kernel)


LAPLACIAN = np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])


def blur_score(bgr: np.ndarray) -> float:
    """Variance of the Laplacian; small for blurred frames."""
    return filter2d(grey(bgr), LAPLACIAN).var(axis=(-2, -1))


def brightness(bgr: np.ndarray) -> float:
    return grey(bgr).mean(axis=(-2, -1))


def counts(bins: np.ndarray, n: int) -> np.ndarray:
    """How often each of n bins stands in each frame; ``bins`` has a whole number for each pixel."""
    each = bins.reshape(-1, bins.shape[-2] * bins.shape[-1])
    places = each.astype(np.int64) + np.arange(len(each))[:, None] * n
    return np.bincount(places.ravel(), minlength=len(each) * n).reshape(*bins.shape[:-2], n).astype(float)


def histogram(x: np.ndarray, n: int, top: int) -> np.ndarray:
    """numpy's histogram of n equal bins from 0 to ``top`` of each frame of whole numbers below ``top``."""
    edges = np.linspace(0, top, n + 1)
    bin_of = np.minimum(np.searchsorted(edges, np.arange(top), side="right") - 1, n - 1)
    return counts(bin_of[x.astype(np.int64)], n)


def bgr_histogram(bgr: np.ndarray) -> np.ndarray:
    """256 bins of each channel, each channel of unit length, one after another."""
    parts = [counts(bgr[..., c], 256) for c in range(3)]
    return np.concatenate([h / np.maximum(np.sqrt((h * h).sum(axis=-1, keepdims=True)), 1) for h in parts], axis=-1)


def pixel_similarity(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - float(np.abs(grey(a) - grey(b)).mean()) / 255


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = x.shape[:2]
    ys = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    xs = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    if x.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    top = x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx
    return top * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 less the mean squared error of small versions over 255 squared."""
    x, y = resize(a.astype(float), 90, 160), resize(b.astype(float), 90, 160)
    return 1 - float(((x - y) ** 2).mean()) / 255**2


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue 0 to 179 (half degrees), saturation and value 0 to 255."""
    b, g, r = (bgr[..., i].astype(float) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    safe = np.where(d == 0, 1, d)
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(d == 0, 0, np.where(hue < 0, hue + 360, hue)) / 2
    return np.stack([np.round(hue) % 180, np.round(np.where(v == 0, 0, d / np.where(v == 0, 1, v)) * 255), v], axis=-1)


def colour_features(bgr: np.ndarray, bins: tuple[int, int, int] = (32, 4, 2)) -> np.ndarray:
    """Histograms of hue, saturation and value, each of sum 1, one after another."""
    return hsv_features(hsv(bgr), bins)


def hsv_features(x: np.ndarray, bins: tuple[int, int, int] = (32, 4, 2)) -> np.ndarray:
    """colour_features of what ``hsv`` gives."""
    parts = [histogram(x[..., c], n, top) for c, n, top in ((0, bins[0], 180), (1, bins[1], 256), (2, bins[2], 256))]
    return np.concatenate([h / np.maximum(h.sum(axis=-1, keepdims=True), 1) for h in parts], axis=-1)


#: Bins of a scene's histogram, of which the first 128 count.
SCENE_BINS = (64, 64, 1)


def scene_histogram(bgr: np.ndarray) -> np.ndarray:
    """64 bins of hue and 64 of saturation."""
    return colour_features(bgr, SCENE_BINS)[..., :128]


def gabor_bank(orientations: int = 8, scales: int = 5, size: int = 31) -> list[np.ndarray]:
    """Gabor kernels of sum 1, scale by scale."""
    half = size // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1].astype(float)
    bank = []
    for s in range(scales):
        sigma, wave, gamma = 3.0 + 2 * s, 10.0 / (s + 1), 0.5
        for o in range(orientations):
            t = o * np.pi / orientations
            xr, yr = x * np.cos(t) + y * np.sin(t), -x * np.sin(t) + y * np.cos(t)
            k = np.exp(-(xr**2 + (gamma * yr) ** 2) / (2 * sigma**2)) * np.cos(2 * np.pi * xr / wave)
            total = k.sum()
            bank.append(k / total if total else k)
    return bank


_BANK: list[np.ndarray] = []


def texture_features(bgr: np.ndarray) -> np.ndarray:
    """Mean and deviation of the response to each Gabor kernel, by products of spectra."""
    if not _BANK:
        _BANK.extend(gabor_bank())
    x = resize(grey(bgr), 128, 128)
    half = _BANK[0].shape[0] // 2
    padded = np.pad(x, half, mode="reflect")
    spectrum = np.fft.rfft2(padded)
    out = []
    for k in _BANK:
        r = np.fft.irfft2(spectrum * np.conj(np.fft.rfft2(k, padded.shape)), padded.shape)[:128, :128]
        out += [r.mean(), r.std()]
    return np.array(out)


SOBEL_X = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])


def canny(x: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: gradient maxima along four directions above ``low`` that touch one above ``high``."""
    gx, gy = filter2d(x, SOBEL_X), filter2d(x, SOBEL_X.T)
    size = np.abs(gx) + np.abs(gy)
    way = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    p = np.pad(size, 1)
    h, w = size.shape
    keep = np.zeros(size.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        keep |= (way == k) & (size > behind) & (size >= ahead)
    weak, found = keep & (size > low), keep & (size > high)
    while True:
        q = np.pad(found, 1)
        grown = weak & (sum(q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) > 0)
        if (grown == found).all():
            return found
        found = grown


def edge_density(bgr: np.ndarray) -> float:
    return float(canny(grey(bgr)).mean())


def outer_contour(mask: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """The border of the component at ``start`` (its first pixel in reading order), clockwise by neighbours."""
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    inside = lambda y, x: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x]
    at, way, out = start, 6, [start]
    for _ in range(4 * mask.size):
        for turn in range(8):
            k = (way + turn) % 8
            y, x = at[0] + ring[k][0], at[1] + ring[k][1]
            if inside(y, x):
                at, way = (y, x), (k + 6) % 8
                break
        else:
            return out
        if at == start:
            return out
        out.append(at)
    return out


def corners(contour: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A closed contour without the points at which it goes straight on."""
    p = np.array(contour)
    came, goes = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    turns = (came != goes).any(axis=1)
    return [tuple(x) for x in p[turns].tolist()] or contour[:1]


def shape_features(bgr: np.ndarray, terms: int = 32) -> np.ndarray:
    """Fourier descriptors of the corners of the largest outer contour: real and imaginary parts over the first one's size; zeros without one."""
    edges = canny(resize(grey(bgr), 128, 128))
    left, best, area = edges.copy(), [], -1.0
    for y, x in np.argwhere(edges):
        if left[y, x]:
            c = outer_contour(edges, (int(y), int(x)))
            todo = [(int(y), int(x))]
            while todo:  # the component is done
                a, b = todo.pop()
                if 0 <= a < 128 and 0 <= b < 128 and left[a, b]:
                    left[a, b] = False
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            p = np.array(c, float)
            size = 0.5 * abs((p[:, 0] * np.roll(p[:, 1], 1) - p[:, 1] * np.roll(p[:, 0], 1)).sum())
            if size > area:
                best, area = c, size
    best = corners([best[0], *best[:0:-1]]) if len(best) else best  # counter-clockwise, from the first pixel in reading order
    if len(best) < 4:
        return np.zeros(2 * terms)
    p = np.array(best, float)
    f = np.fft.fft(p[:, 1] + 1j * p[:, 0])
    f = f / (abs(f[0]) or 1.0)
    f = np.pad(f[:terms], (0, max(0, terms - len(f))))
    return np.concatenate([f.real, f.imag])


def combined_features(bgr: np.ndarray) -> np.ndarray:
    """Colour (38), texture (80) and shape (64)."""
    return np.concatenate([colour_features(bgr), texture_features(bgr), shape_features(bgr)])


def fallback_features(bgr: np.ndarray) -> np.ndarray:
    """256 numbers where no network is at hand: 64 bins each of hue, saturation, value and edges, each of unit length."""
    x = hsv(bgr)
    parts = [np.histogram(x[..., c], bins=64, range=(0, top))[0].astype(float) for c, top in ((0, 180), (1, 256), (2, 256))]
    parts.append(np.histogram(canny(grey(bgr)) * 255.0, bins=64, range=(0, 256))[0].astype(float))
    return np.concatenate([h / (np.sqrt((h * h).sum()) or 1.0) for h in parts])


def _entropy(h: np.ndarray) -> np.ndarray:
    p = h / (h.sum(axis=-1, keepdims=True) + 1e-10)
    return -(p * np.log2(p + 1e-10)).sum(axis=-1)


def colour_entropy(bgr: np.ndarray) -> float:
    """Mean entropy in bits of 30 bins of hue and 16 of saturation."""
    return hsv_entropy(hsv(bgr))


def hsv_entropy(x: np.ndarray) -> float:
    """colour_entropy of what ``hsv`` gives."""
    return (_entropy(histogram(x[..., 0], 30, 180)) + _entropy(histogram(x[..., 1], 16, 256))) / 2


def gaussian(x: np.ndarray, size: int = 21) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return filter2d(filter2d(x, k[None, :]), k[:, None])


def is_uniform(bgr: np.ndarray) -> bool:
    """Whether most pixels lie close to their surroundings."""
    x = grey(bgr)
    return (np.abs(x - gaussian(x)) < 10).mean(axis=(-2, -1)) > 0.6


SMALL = (90, 160)


def small_grey(bgr: np.ndarray) -> np.ndarray:
    """The grey bytes of a 90 x 160 version, from which motion is taken."""
    return grey(np.rint(resize(bgr.astype(float), *SMALL)).astype(np.uint8)).astype(np.uint8)


def motion_between(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(small_grey(a).astype(float) - small_grey(b)).mean())


def to_array(image) -> np.ndarray:
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])[..., :3]


#: Frames and pixels of a stack, at most; a larger frame is one by itself.
STACK_FRAMES, STACK_PIXELS = 1024, 1 << 20


def stacks(height: np.ndarray, width: np.ndarray, channels: np.ndarray, data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, frames): frames of one size as an array (n, height, width, 3), with their places among all."""
    sizes, of = np.unique(np.stack([height, width, channels], axis=1), axis=0, return_inverse=True)
    for k, (h, w, c) in enumerate(sizes.tolist()):
        places = np.flatnonzero(of.ravel() == k)
        step = max(1, min(STACK_FRAMES, STACK_PIXELS // max(1, h * w)))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            raw = [data[i] for i in some.tolist()]
            if any(len(r) != h * w * c for r in raw):
                raise ValueError(f"a frame without {h} x {w} x {c} bytes")
            yield some, np.frombuffer(b"".join(raw), np.uint8).reshape(-1, h, w, c)[..., :3]


def of_stacks(frames: pd.DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``make`` gives for each frame of an image column's fields, a stack at a time; of a frame one value or one row of them."""
    out = None
    for places, x in stacks(*(frames[c].to_numpy(np.int64) for c in ("height", "width", "nChannels")), frames["data"].tolist()):
        made = make(x)
        out = np.empty((len(frames), *made.shape[1:]), made.dtype) if out is None else out
        out[places] = made
    return out if out is not None else np.zeros(0)


#: Each metric's type and what makes it of a stack of frames.
METRIC_OF = {
    "brightness": ("double", brightness),
    "sharpness": ("double", blur_score),
    "edge_density": ("double", lambda x: np.array([edge_density(i) for i in x])),
    "entropy": ("double", colour_entropy),
    "uniform": ("boolean", is_uniform),
    "small": ("binary", lambda x: np.array([small_grey(i).tobytes() for i in x], object)),
}
METRICS = ", ".join(f"{name} {kind}" for name, (kind, _) in METRIC_OF.items())


def frame_metrics(frames: DataFrame, image: str = "image", metrics: tuple[str, ...] = tuple(METRIC_OF)) -> DataFrame:
    """``frames`` without pixels, with the asked METRICS; one pass over each frame. ``small`` is small_grey's 14,400 bytes."""
    rest = [c for c in frames.columns if c != image]
    kinds = {"double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column(image)
            found = {m: [None] * batch.num_rows for m in metrics}
            for places, x in stacks(*(pixels.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("height", "width", "nChannels")), pixels.field("data").to_pylist()):
                for m in metrics:
                    for i, value in zip(places.tolist(), METRIC_OF[m][1](x).tolist(), strict=True):
                        found[m][i] = value
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(found[m], kinds[METRIC_OF[m][0]]) for m in metrics)], names=[*rest, *metrics])

    schema = ", ".join(f"`{c}` {t}" for c, t in frames.dtypes if c != image) + "".join(f", {m} {METRIC_OF[m][0]}" for m in metrics)
    return frames.mapInArrow(work, schema)


def described(frames: DataFrame, image: str = "image") -> DataFrame:
    """``frames`` without pixels, with METRICS and the 182 combined features: all that a summary needs of a frame."""
    return frame_metrics(frames.withColumn("features", features_of(F.col(image))), image)


def grey_change(a: Column, b: Column) -> Column:
    """Mean difference of two frames' small greys; null if either is missing."""

    @F.pandas_udf("double")
    def compute(a: pd.Series, b: pd.Series) -> pd.Series:
        change = lambda x, y: None if x is None or y is None else float(np.abs(np.frombuffer(x, np.uint8).astype(float) - np.frombuffer(y, np.uint8)).mean())
        return pd.Series([change(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return compute(a, b)


def motion_context(metrics: DataFrame, small: str = "small") -> DataFrame:
    """``motion``: the mean grey change to the frames before and after in the video, of those there are; ``small`` goes."""
    order = W.partitionBy("video_id").orderBy("ts", "frame_index")
    found = metrics.withColumn("_lag", F.lag(small).over(order)).withColumn("_before", grey_change(F.col("_lag"), F.col(small))).drop("_lag")
    found = found.withColumn("_after", F.lead("_before").over(order)).drop(small)
    total = F.coalesce("_before", F.lit(0.0)) + F.coalesce("_after", F.lit(0.0))
    return found.withColumn("motion", F.when(F.col("_before").isNotNull() & F.col("_after").isNotNull(), total / 2).otherwise(total)).drop("_before", "_after")


def features_of(image: Column) -> Column:
    """The 182 combined features of an image column."""

    @F.pandas_udf("array<double>")
    def compute(images: pd.DataFrame) -> pd.Series:
        return pd.Series([combined_features(to_array(i)) for _, i in images.iterrows()])

    return compute(image)


def fallback_features_of(image: Column) -> Column:
    """The 256 numbers of fallback_features of an image column."""

    @F.pandas_udf("array<double>")
    def compute(images: pd.DataFrame) -> pd.Series:
        return pd.Series([fallback_features(to_array(i)) for _, i in images.iterrows()])

    return compute(image)


class Likeness:
    """How alike two frames are, by histogram, pixel or combined; what is needed of a frame is made once."""

    def __init__(self, method: str):
        if method not in ("histogram", "pixel", "combined"):
            raise ValueError(f"unknown method {method}")
        self.method = method

    def key(self, bgr: np.ndarray) -> tuple:
        hist = bgr_histogram(bgr) if self.method != "pixel" else None
        small = resize(bgr.astype(float), *SMALL) if self.method == "combined" else None
        return hist, small, bgr

    def write(self, bgr: np.ndarray) -> bytes:
        """What a frame's key is made of, as bytes: its histogram for that method, its pixels for the others."""
        if self.method == "histogram":
            return bgr_histogram(bgr).tobytes()
        return np.array(bgr.shape[:2], "<u4").tobytes() + np.ascontiguousarray(bgr).tobytes()

    def read(self, raw: bytes) -> tuple:
        """The key of a frame from what ``write`` made of it."""
        if self.method == "histogram":
            return np.frombuffer(raw), None, None
        return self.key(np.frombuffer(raw, np.uint8, -1, 8).reshape(*np.frombuffer(raw, "<u4", 2), 3))

    def __call__(self, a: tuple, b: tuple) -> float:
        if self.method == "pixel":
            return pixel_similarity(a[2], b[2])
        shared = np.sqrt(a[0] * b[0]).sum() / np.sqrt(a[0].sum() * b[0].sum())
        hist = float(np.clip(1 - np.sqrt(max(0.0, 1 - shared)), 0, 1))
        return hist if self.method == "histogram" else (hist + 1 - float(((a[1] - b[1]) ** 2).mean()) / 255**2) / 2


def _in_order(frames: DataFrame) -> DataFrame:
    return frames.repartition("video_id").sortWithinPartitions("video_id", "ts", "frame_index")


def _seen(x: np.ndarray, ts: float, blur: float, dark: float, skip: float) -> bool:
    """Whether a frame is looked at: after the intro, neither dark nor blurred."""
    return ts >= skip and (dark <= 0 or brightness(x) >= dark) and (blur <= 0 or blur_score(x) >= blur)


def redundancy_filter(frames: DataFrame, threshold: float = 0.75, method: str = "histogram", image: str = "image", blur: float = 0.0, dark: float = 0.0, skip: float = 0.0) -> DataFrame:
    """Frames less alike than ``threshold`` to the last kept frame of their video; ``diff_score`` is 1 less the likeness, 0 for the first.

    Frames before ``skip`` seconds, darker than ``dark`` or less sharp than ``blur`` aren't looked at. A video's frames
    come in order, a batch at a time; only the last kept one is held. ``method``: histogram, pixel or combined.
    """
    like = Likeness(method)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video = last = None
        for pdf in parts:
            keep, diff = [], []
            for v, ts, i in zip(pdf["video_id"], pdf["ts"], pdf[image], strict=True):
                x = to_array(i)
                if v != video:
                    video, last = v, None
                kept = False
                if _seen(x, ts, blur, dark, skip):
                    now = like.key(x)
                    d = 0.0 if last is None else 1 - like(last, now)
                    if kept := last is None or d > 1 - threshold:
                        last = now
                        diff.append(d)
                keep.append(kept)
            out = pdf[keep].copy()
            out["diff_score"] = diff
            yield out

    return _in_order(frames).mapInPandas(work, ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in frames.columns) + ", diff_score double")


def adaptive_similarity(frames: DataFrame, least: int = 10, most: int = 100, start: float = 0.95, image: str = "image", blur: float = 50.0, dark: float = 25.0) -> DataFrame:
    """(video_id, threshold, kept): per video a threshold of the combined likeness that keeps between ``least`` and ``most`` frames.

    The walk goes in steps of 0.02 within 0.5 and 0.99, ten rounds at most. All thresholds that it may come to are
    counted in one pass over the frames; thresholds with the same last kept frame share a comparison.
    """
    like = Likeness("combined")
    # too few kept raises the likeness that is allowed: the walk runs on its complement
    thresholds = [round(1 - t, 6) for t in reachable(1 - start, 0.02, 0.01, 0.5)]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, last, n = None, [None] * len(thresholds), [0] * len(thresholds)

        def done() -> pd.DataFrame:
            by = dict(zip(thresholds, n, strict=True))
            used, kept = walk_thresholds(lambda d: by[round(1 - d, 6)], 1 - start, 0.02, 0.01, 0.5, least, most)
            return pd.DataFrame({"video_id": [video], "threshold": [round(1 - used, 6)], "kept": [kept]})

        for pdf in parts:
            for v, i in zip(pdf["video_id"], pdf[image], strict=True):
                if v != video:
                    if video is not None:
                        yield done()
                    video, last, n = v, [None] * len(thresholds), [0] * len(thresholds)
                x = to_array(i)
                if not _seen(x, 0.0, blur, dark, 0.0):
                    continue
                now, known = like.key(x), {}
                for k, t in enumerate(thresholds):
                    if last[k] is not None and id(last[k]) not in known:
                        known[id(last[k])] = like(last[k], now)
                    if last[k] is None or known[id(last[k])] < t:
                        last[k] = now
                        n[k] += 1
        if video is not None:
            yield done()

    return _in_order(frames.select("video_id", "ts", "frame_index", image)).mapInPandas(work, "video_id long, threshold double, kept long")
