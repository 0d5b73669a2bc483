"""Toxicity: a subsequence string kernel support vector machine with Nystrom landmarks.

The kernel counts common subsequences of ORDER letters, each weighted by GAP for every letter skipped, over a span of
at most SPAN letters: an insult with inserted or doubled letters still shares most subsequences with the plain one.
Punctuation between letters isn't read, and letters that stand alone in a row are read as one word.

Training: labelled documents give labelled sentence windows (multiple-instance: a toxic document's highest windows
are its toxic ones), landmarks are drawn from these, windows are mapped to K(x, L) K(L, L)^(-1/2), and a linear SVM
is fitted there. Its decision is a sum over subsequences, so it is flattened into one table of weights by
subsequence; a text's score is its highest window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts
from .quality import labelled_ids, labelled_sample

ORDER, SPAN, GAP, WINDOW = 4, 6, 0.6, 8
#: At most so many labelled texts are fitted on, half of each label, in the order of a hash as long as they have at most
#: SAMPLE_CHARS characters together; whole texts, but none of more than a LONGEST_SHARE-th of these characters.
SAMPLE_ROWS, SAMPLE_CHARS, LONGEST_SHARE = 5_000, 24_000_000, 20
LANDMARKS, ROUNDS, COST, SEED = 320, 4, 1000.0, 7

_BITS = 5
_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[ord("a") : ord("z") + 1] = _SYMBOLS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_SYMBOLS[0x80:0xC0] = 27 + np.arange(64) % 5  # last bytes of letters beyond ASCII
_DROPPED = np.zeros(256, bool)
_DROPPED[33:127] = _SYMBOLS[33:127] == 0  # punctuation and digits
_DROPPED[0xC0:] = True  # first bytes of such letters
_PAD = b" " * (WINDOW + SPAN)
OFFSETS = [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts (0: gap) and where each text begins; texts are followed by gaps."""
    raw = np.frombuffer(_PAD.join(texts) + _PAD, np.uint8)
    lengths = np.fromiter((len(t) + len(_PAD) for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    keep = ~_DROPPED[raw]
    symbols = _SYMBOLS[raw[keep]]
    starts = np.concatenate([[0], np.cumsum(keep)])[starts]
    gaps = np.flatnonzero(symbols == 0)
    apart = np.diff(gaps)
    lone = np.zeros(len(gaps), bool)
    lone[1:-1] = (apart[:-1] == 2) & (apart[1:] == 2)
    lone[np.isin(gaps, starts - 1)] = False
    if lone.any():
        keep = np.ones(len(symbols), bool)
        keep[gaps[lone]] = False
        symbols = symbols[keep]
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
    return symbols.astype(np.int32), starts


def position_scores(symbols: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each position the weighted sum of ``table`` over the subsequences that begin there."""
    n = len(symbols) - SPAN
    if n <= 0:
        return np.zeros(max(len(symbols), 0), np.float32)
    shifted = [symbols << (_BITS * k) for k in range(ORDER)]
    total = np.zeros(len(symbols), np.float32)
    for i, j, k in OFFSETS:
        at = shifted[3][:n] | shifted[2][i : i + n]
        at |= shifted[1][j : j + n]
        at |= shifted[0][k : k + n]
        found = table[at]
        if k > 3:
            found *= np.float32(GAP ** (k - 3))
        total[:n] += found
    return total


def window_scores(symbols: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The score of the window that begins at each position; those that would reach the next text have 0."""
    sums = np.concatenate([[0.0], np.cumsum(position_scores(symbols, table), dtype=np.float64)])
    n = len(symbols)
    out = sums[np.minimum(np.arange(n) + WINDOW, n)] - sums[:n]
    out[(starts[1:, None] - 1 - np.arange(WINDOW)[None, :]).ravel()] = 0
    return out


def features(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows' explicit kernel features: (window, subsequence, weight); an edge of a word may end a subsequence."""
    n = len(symbols)
    first = (starts[:, None] + np.arange(WINDOW)[None, :]).ravel()
    window = np.repeat(np.arange(len(starts)), WINDOW)
    parts = []
    for offs in OFFSETS:
        s = [symbols[np.minimum(first + o, n - 1)] for o in (0, *offs)]
        ok = (s[1] > 0) & (s[2] > 0) & ((s[0] > 0) | (s[3] > 0)) & (first + offs[2] < n)
        code = (s[0] << 15) | (s[1] << 10) | (s[2] << 5) | s[3]
        parts.append((window[ok], code[ok], np.full(int(ok.sum()), GAP ** (offs[2] - 3))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def snippets(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbols that windows beginning at ``starts`` can see, one row each."""
    return symbols[np.minimum(starts[:, None] + np.arange(WINDOW + SPAN)[None, :], len(symbols) - 1)].astype(np.int32)


def with_insertion(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each row with one letter inserted near its beginning; what is pushed out at the end is lost."""
    n, width = rows.shape
    cut = rng.integers(2, 6, n)[:, None]
    place = np.arange(width)[None, :]
    moved = np.take_along_axis(rows, np.maximum(place - (place >= cut), 0), axis=1)
    moved[np.arange(n), cut[:, 0]] = rng.integers(1, 27, n)
    return moved


def snippet_features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return features(rows.ravel(), np.arange(len(rows)) * rows.shape[1])


@dataclass
class Model:
    table: np.ndarray  # weight by subsequence
    slope: float
    offset: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        symbols, starts = letters(texts)
        best = np.maximum.reduceat(window_scores(symbols, starts, self.table), starts[:-1]) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def _kernel(x: tuple[np.ndarray, ...], n: int, landmarks: tuple[np.ndarray, ...], m: int) -> np.ndarray:
    """K between n windows and m landmarks, from their explicit features."""
    order = np.argsort(landmarks[1], kind="stable")
    lw, lu, lv = (a[order] for a in landmarks)
    lo, hi = np.searchsorted(lu, x[1], "left"), np.searchsorted(lu, x[1], "right")
    out = np.zeros(n * m, np.float64)
    for a in range(0, len(lo), 20_000):
        times = (hi - lo)[a : a + 20_000]
        mine = np.repeat(np.arange(a, a + len(times)), times)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo[a : a + 20_000], times)
        out += np.bincount(x[0][mine] * m + lw[other], weights=x[2][mine] * lv[other], minlength=n * m)
    return out.reshape(n, m)


def _svm(z: np.ndarray, y: np.ndarray, cost: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; classes weigh the same."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y) * cost
    w = np.zeros(z1.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    for _ in range(steps):
        active = y * (z1 @ w) < 1
        a, c = z1[active], weight[active]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(ridge), a.T @ (c * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def train(texts: list[bytes], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """Fits on whole labelled texts. Without texts of both labels every score is the share of toxic ones, or 0.1."""
    size = 1 << (_BITS * ORDER)
    if len(texts) == 0 or toxic.min() == toxic.max():
        p = 0.1 if len(texts) == 0 else float(np.clip(toxic.mean(), 0.01, 0.99))
        return Model(np.zeros(size, np.float32), 1.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(SEED)
    aside = np.arange(len(texts)) % 4 == 3  # for the scale of the scores
    if len(np.unique(toxic[aside])) < 2 or len(np.unique(toxic[~aside])) < 2:
        aside = np.zeros(len(texts), bool)
    calibrate = ([t for t, a in zip(texts, aside, strict=True) if a], toxic[aside]) if aside.any() else (texts, toxic)
    texts, toxic = [t for t, a in zip(texts, aside, strict=True) if not a], toxic[~aside]
    symbols, starts = letters(texts)
    symbols = symbols.astype(np.uint8)
    # the first table: how much more often texts with the plain subsequence are toxic
    seen = [np.zeros(size, np.float32), np.zeros(size, np.float32)]
    for i in range(len(texts)):
        own = symbols[starts[i] : starts[i + 1]].astype(np.int32)
        plain = (own[:-3] << 15) | (own[1:-2] << 10) | (own[2:-1] << 5) | own[3:]
        seen[int(toxic[i])][np.unique(plain[(own[1:-2] > 0) & (own[2:-1] > 0) & ((own[:-3] > 0) | (own[3:] > 0))])] += 1
    odds = np.log((seen[1] + 0.5) / (toxic.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - toxic).sum() + 1))
    table = np.where(seen[1] >= max(5, 0.002 * toxic.sum()), np.maximum(odds - 1.5, 0), 0).astype(np.float32)
    hard: list[np.ndarray] = []
    for _ in range(rounds):
        top, best = best_windows(symbols, starts, table)
        # a toxic text's highest window is its example, unless it is no higher than what half of the clean texts have
        positive = top[(toxic == 1) & (best > np.median(best[toxic == 0]))]
        if len(positive) < 10:
            positive = top[toxic == 1]
        hard.append(top[toxic == 0])
        anywhere = rng.integers(0, len(symbols), 2 * len(positive) + 1000)
        anywhere = anywhere[(toxic[np.searchsorted(starts, anywhere, side="right") - 1] == 0) & (symbols[anywhere] > 0)]
        negative = np.unique(np.concatenate([*hard, anywhere]))
        toxic_ones = snippets(symbols, positive)
        examples = np.concatenate([toxic_ones, with_insertion(toxic_ones, rng), snippets(symbols, negative)])
        y = np.where(np.arange(len(examples)) < 2 * len(positive), 1.0, -1.0)
        x = snippet_features(examples)
        pick = np.concatenate([rng.permutation(len(positive))[: landmarks // 2], 2 * len(positive) + rng.permutation(len(negative))[: landmarks // 2]])
        marks = snippet_features(examples[pick])
        m = len(pick)
        k_ll = _kernel(marks, m, marks, m)
        values_l, vectors = np.linalg.eigh(k_ll)
        good = values_l > 1e-6 * values_l.max()
        root = vectors[:, good] / np.sqrt(values_l[good])
        w, _ = _svm(_kernel(x, len(examples), marks, m) @ root, y, COST / len(examples))
        beta = root @ w
        table = np.bincount(marks[1], weights=beta[marks[0]] * marks[2], minlength=size).astype(np.float32)
    _, best = best_windows(*letters(calibrate[0]), table)
    a, b = _logistic(best, calibrate[1].astype(float))
    return Model(table, a, b)


def best_windows(symbols: np.ndarray, starts: np.ndarray, table: np.ndarray, texts: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's highest window begins, and its score; some texts at a time."""
    places, scores = [], []
    for a in range(0, len(starts) - 1, texts):
        part = starts[a : a + texts + 1]
        values = window_scores(symbols[part[0] : part[-1]].astype(np.int32), part - part[0], table)
        for s, e in zip(part[:-1], part[1:], strict=True):
            k = int(values[s - part[0] : e - part[0]].argmax())
            places.append(int(s) + k)
            scores.append(values[s - part[0] + k])
    return np.array(places, np.int64), np.array(scores)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling with smoothed labels."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        w = w + np.linalg.solve(h, design.T @ (t - p))
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, where: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Trains on a bounded sample of the labelled rows that ``where`` selects; ids may be of any type that has a text.

    Rows of one id count once, with the longest text. A text of more than a LONGEST_SHARE-th of ``chars`` characters isn't in
    the sample; the others are taken in the order of a hash of their ids until ``chars`` are used up. It is an error if
    that leaves texts of one label only where there were both.
    """
    ids = labelled_ids(labelled_sample(labels, label, where, rows, balance=True, doc_id=doc_id))
    sample = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id").where(F.col("_text").isNotNull())
    sizes = sample.groupBy("_id").agg(F.max(F.struct(F.length("_text").alias("n"), "_label")).alias("m")).select("_id", "m.*")  # at most ``rows``
    used = F.sum(F.when(F.col("fits"), F.col("n"))).over(W.orderBy(F.xxhash64("_id"), "_id").rowsBetween(W.unboundedPreceding, 0))
    order = sizes.withColumn("fits", F.col("n") <= chars // LONGEST_SHARE).withColumn("used", used).select("_id", "n", "_label", (F.col("fits") & (F.col("used") <= chars)).alias("in"))
    lengths = order.toPandas().astype({"in": bool})
    if lengths["_label"].nunique() > lengths.loc[lengths["in"], "_label"].nunique():
        raise ValueError(f"texts of both labels, but not of both with at most {chars // LONGEST_SHARE} characters")
    chosen = docs.sparkSession.createDataFrame(lengths.loc[lengths["in"], ["_id", "n"]].astype({"_id": str, "n": int}).values.tolist(), "_id string, _n int")
    texts = sample.join(F.broadcast(chosen), "_id").where(F.length("_text") == F.col("_n")).groupBy("_id").agg(F.max(F.struct("_text", "_label")).alias("m")).select("_id", "m.*")
    found = texts.toPandas().sort_values("_id", kind="stable")
    return train([t.encode() for t in found["_text"]], found["_label"].to_numpy(int))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score) for every row; a null or empty text has the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 4 MB
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(texts))], names=["doc_id", "score"])

    return map_texts(source, work, f"doc_id {kind}, score double")
