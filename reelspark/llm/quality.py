"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed with numpy inside tasks. The trees are grown on a bounded sample of labelled rows, kept as
complete binary trees in flat arrays, and applied to whole batches, all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, map_texts, mix64, row_hash

#: At most so many labelled rows are fitted on, the first by a hash of the id.
SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 80, 5, 64, 0.15, 1.0, 20

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _SYMBOL, _HIGH, _CONTROL = range(10)
CLASSES = np.full(256, _SYMBOL, np.uint8)
CLASSES[:32] = _CONTROL
CLASSES[127] = _CONTROL
for _chars, _class in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t", _SPACE), (b"\n\r", _LINE), (b".!?", _STOP), (b",;:'\"()-", _COMMA)):
    CLASSES[np.frombuffer(_chars, np.uint8)] = _class
CLASSES[128:] = _HIGH

FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_std", "word_max", "lower", "upper", "digit", "space", "line", "stop", "comma", "symbol", "high", "control",
    "stop_per_word", "distinct_words", "top_word", "repeats_previous", "distinct_pairs", "distinct_fives", "byte_entropy", "distinct_lines", "line_words", "letters_per_word",
)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text; the empty text has zeros throughout."""
    words = Words(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    lengths = (words.end - words.start).astype(float)
    for i, text in enumerate(texts):
        if not text:
            continue
        a, b = words.first[i], words.first[i + 1]
        raw = np.frombuffer(text, np.uint8)
        byte_counts = np.bincount(raw, minlength=256)
        kinds = np.bincount(CLASSES, weights=byte_counts, minlength=10)
        p = byte_counts[byte_counts > 0] / len(raw)
        lines = text.split(b"\n")
        n = b - a
        row = [np.log1p(len(raw)), np.log1p(n), 0, 0, 0, *(kinds / len(raw)), kinds[_STOP] / max(n, 1), 0, 0, 0, 0, 0, -(p * np.log2(p)).sum(), len(set(lines)) / len(lines), np.log1p(n / len(lines)), 0]
        if n:
            w, size = words.hash[a:b], lengths[a:b]
            _, times = np.unique(w, return_counts=True)
            row[2:5] = size.mean(), size.std(), np.log1p(size.max())
            row[16:18] = len(times) / n, times.max() / n
            row[24] = (kinds[_LOWER] + kinds[_UPPER] + kinds[_HIGH]) / n
            if n > 1:
                row[18] = (w[1:] == w[:-1]).mean()
                row[19] = len(np.unique(mix64(w[1:] * np.uint64(3) + w[:-1]))) / (n - 1)
            if n > 5:
                fives = w[:-4] + w[1:-3] * np.uint64(3) + w[2:-2] * np.uint64(9) + w[3:-1] * np.uint64(27) + w[4:] * np.uint64(81)
                row[20] = len(np.unique(mix64(fives))) / (n - 4)
        out[i] = row
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth: per tree 2^depth - 1 splits and 2^depth leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        node = np.zeros((n, trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
        inner = self.feature.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.value[tree, node - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosts logistic loss with level-wise histogram trees. One class or no rows: a constant."""
    inner, leaves, n, d = 2**depth - 1, 2**depth, len(y), x.shape[1]
    mean = (y.sum() + 0.5) / (n + 1)
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(mean / (1 - mean))))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(d)], axis=1)
    flat = binned + np.arange(d) * bins
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * bins) + flat).ravel()
            shape = (wide, d, bins)
            sums = [np.bincount(at, weights=np.repeat(v, d), minlength=wide * d * bins).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(nl < LEAST_ROWS) | (na - nl < LEAST_ROWS)] = -1
            best = gain.reshape(wide, -1).argmax(axis=1)
            for k in range(wide):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    model.feature[t, first + k], model.threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=leaves), np.bincount(leaf, weights=h, minlength=leaves)
        model.value[t] = -rate * gs / (hs + L2)
        margin += model.value[t, leaf]
    return model


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled_sample(labels: DataFrame, label: str, train: Column, rows: int, balance: bool = False, doc_id: str = "doc_id") -> DataFrame:
    """At most ``rows`` ids with a label (rows (_id, _label)), the first by a hash of the id; half of each label if ``balance``.

    An id labelled more than once has the larger label; null ids and labels are left out.
    """
    known = labels.where(train & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    known = known.withColumn("_order", row_hash("_id", seed=11))
    if not balance:
        return known.orderBy("_order", "_id").limit(rows).drop("_order")
    parts = [known.where(F.col("_label") == k).orderBy("_order", "_id").limit(rows // 2).drop("_order") for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_ids(sample: DataFrame) -> DataFrame:
    """A bounded labelled_sample as a table of (_id as text, _label) that may be broadcast."""
    rows = [(str(r[0]), int(r[1])) for r in sample.collect()]
    return sample.sparkSession.createDataFrame(rows, "_id string, _label int")


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """Grows trees on a bounded sample of the labelled rows that ``train`` selects; ids may be of any type that has a text.

    Scores at the threshold count as good. Of repeated ids one row counts, the smallest by its statistics.
    """
    ids = labelled_ids(labelled_sample(labels, label, train, rows, doc_id=doc_id))
    sample = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        x = statistics(texts)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x))], names=["id", "label", "x"])

    made = map_texts(sample, work, "id string, label int, x array<double>")
    found = made.groupBy("id").agg(F.min(F.struct("x", "label")).alias("m")).select("id", "m.label", "m.x").toPandas().sort_values("id", kind="stable")
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    return grow(x, found["label"].to_numpy(float))


def score(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score) for every row; a null or empty text is scored as a text of zeros."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(model.probability(statistics(texts)))], names=["doc_id", "score"])

    return map_texts(source, work, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns."""
    names = docs.columns
    at = names.index(text)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        return part.filter(pa.array(model.probability(statistics(texts)) >= threshold))

    return map_texts(numbered, work, numbered.schema, f"c{at}").toDF(*names)
