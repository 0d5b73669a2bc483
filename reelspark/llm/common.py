"""Helpers that the corpus operators share: Arrow batches, word hashes, durable cuts of lineage.

Conventions of all operators in this package:

* an input is any DataFrame that has the named id and text columns; other columns, whatever their names, are
  either carried or ignored, never looked at;
* a null text counts as the empty text, a null id stays null in the result, repeated rows give repeated results;
* words are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z read as a-z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut, cut_tidily, shared_folder, stored

__all__ = ["Words", "bit_filter", "cut", "cut_tidily", "hash_word", "in_chunks", "map_batches", "map_texts", "mix64", "passes", "row_hash", "run_hashes", "shared_folder", "signed", "stored", "text_chunks", "utf8"]

#: Texts are handled in groups of about so many bytes, which bounds a worker's memory; a longer text is alone in its group
#: and takes some ten times its bytes.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
WORD_BYTES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD_BYTES[128:] = np.arange(128, 256)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes_of(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(buffer.astype(np.uint64) * up, out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start])


#: Bytes of a long text that are hashed at once.
RUN_BYTES = 1 << 22


def run_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes from ``start``, ascending, to ``end``; no byte of a run is 0."""
    if len(buffer) <= RUN_BYTES:
        return _hashes_of(buffer, start, end)
    out = np.empty(len(start), np.uint64)
    edges = np.searchsorted(start, np.arange(0, len(buffer) + RUN_BYTES, RUN_BYTES))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:  # a run's hash doesn't depend on where it stands
            low, high = int(start[a]), int(end[b - 1])
            out[a:b] = _hashes_of(buffer[low:high], start[a:b] - low, end[a:b] - low)
    return out


class Words:
    """The words of several texts: 64-bit hashes, byte offsets into ``buffer``, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        folded = WORD_BYTES[self.buffer]
        edges = np.flatnonzero(np.diff((folded > 0).view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edges[0::2], edges[1::2]
        self.hash = run_hashes(folded, self.start, self.end)
        self.first = np.searchsorted(self.start, self.text_start)

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def hash_word(word: str) -> int:
    """The hash that Words gives one word."""
    return int(Words([word.encode()]).hash[0])


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def in_chunks(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``limit`` bytes together; a larger item is alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


#: Bytes of an Arrow batch between Spark and a Python worker; Spark's default is many times that.
BATCH_BYTES = 8 << 20


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Bounded groups of a task's rows with their texts as UTF-8."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, int)
        for a, b in in_chunks(sizes):
            part = batch.slice(a, b - a)
            yield part, utf8(part.column(batch.schema.get_field_index(text)))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by BATCH_BYTES, for the session from here on: the setting counts when the result is run."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """Applies ``work`` to bounded groups of rows; it gets the rows and their texts as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text):
            done = work(part, texts)
            if done is not None and done.num_rows:
                yield done

    return map_batches(df, run, schema)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def row_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A hash of the given columns that differs by seed."""
    return F.xxhash64(F.lit(seed), *columns)


#: Bits of a hash that a filter tells apart: 2 MB, whatever it is filled with.
FILTER_BITS = 24


def filter_bits(n: int, places: int = 16) -> int:
    """Bits for a filter with about so many places for each of ``n`` values, between FILTER_BITS and 29 (64 MB); beyond, more values pass."""
    return min(29, max(FILTER_BITS, (places * n).bit_length()))


def bit_filter(values: DataFrame, column: str = "term", bits: int | None = None) -> np.ndarray:
    """One bit for each value that the hashes of ``values`` have in their low ``bits`` (FILTER_BITS); the same size for any number of values."""
    size = 1 << (bits or FILTER_BITS)
    at = F.col(column).bitwiseAND(F.lit(size - 1))
    found = values.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((size // 32768 + 2, 4096), np.uint8)
    for bucket, b in found:
        out[bucket] = np.frombuffer(bytes(b), np.uint8)
    # bucket numbers begin at 1 and a bucket's positions follow those of the bucket before; value v is position v - 1
    return out.reshape(-1)


def passes(hashes: np.ndarray, bits: np.ndarray, width: int | None = None) -> np.ndarray:
    """Whether each hash may be one of the filter's values; ``width`` as the filter's ``bits``."""
    v = (hashes & np.uint64((1 << (width or FILTER_BITS)) - 1)).view(np.int64)
    at = np.where(v > 0, v + 32767, 0)  # value v > 0 is position v - 1 of the buckets from 1 on, 0 the first of bucket 0
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
