"""JPEG files against Spark's own reader of images."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.sources import files
from reelspark.sources import jpeg as J


def _picture(h, w, seed):
    """Smooth colours, an edge and some noise."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    a = np.stack([128 + 100 * np.sin(x / 17 + seed), 128 + 90 * np.cos(y / 11), 3.0 * ((x + y) % 60)], axis=-1)
    a[h // 3 :, w // 2 :] = 240
    return np.clip(a + rng.normal(0, 3, a.shape), 0, 255).astype(np.uint8)


def test_spark_reads_what_is_written(spark, tmp_path):
    images = {"a": _picture(64, 80, 1), "b": _picture(37, 53, 2), "c": _picture(8, 8, 3), "d": np.full((16, 24, 3), (10, 200, 90), np.uint8), "e": _picture(1, 1, 4), "f": np.zeros((5, 70, 3), np.uint8)}
    images["g"] = np.random.default_rng(5).integers(0, 256, (40, 40, 3), dtype=np.uint8)
    for name, x in images.items():
        for quality in (40, 95, 100):
            (tmp_path / f"{name}{quality}.jpg").write_bytes(J.jpeg(x, quality))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == 3 * len(images)
    for r in rows:
        name, quality = r.origin.rsplit("/", 1)[1][0], int(r.origin.rsplit("/", 1)[1][1:-4])
        x = images[name]
        got = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
        assert got.shape == x.shape
        error = np.abs(got.astype(int) - x).mean()
        assert error < ({40: 60, 95: 12, 100: 1} if name == "g" else {40: 16, 95: 3, 100: 1})[quality]


def test_quality_sets_the_size():
    x = _picture(120, 160, 7)
    sizes = [len(J.jpeg(x, q)) for q in (10, 50, 90, 100)]
    assert sizes == sorted(sizes) and sizes[0] < len(files.png(x)) / 8
    for bad in (0, 101):
        with pytest.raises(ValueError):
            J.jpeg(x, bad)


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=256))
@settings(max_examples=100, deadline=None)
def test_codes_are_prefix_codes_of_sixteen_bits(counts):
    counts = np.array(counts)
    lengths = J.code_lengths(counts)
    assert set(lengths) == set(np.flatnonzero(counts).tolist()) and all(1 <= n <= 16 for n in lengths.values())
    symbols, codes, sizes = J.canonical(lengths)
    texts = sorted(f"{codes[s]:0{sizes[s]}b}" for s in symbols)
    assert all(not b.startswith(a) for a, b in zip(texts[:-1], texts[1:], strict=True)) and not any(set(t) == {"1"} and len(t) == max(map(len, texts)) for t in texts)


def test_very_unequal_counts_stay_within_sixteen_bits():
    counts = np.array([1 << k for k in range(40)])
    lengths = J.code_lengths(counts)
    assert max(lengths.values()) == 16 and sum(2.0**-n for n in lengths.values()) < 1


def test_keyframes_and_storyboards_as_jpeg(spark, tmp_path):
    rows = [(4, i, float(i), ("", 24, 32, 3, 16, bytearray(_picture(24, 32, i).tobytes()))) for i in range(3)]
    frames = spark.createDataFrame(rows, "job_id long, frame_index long, ts double, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    made = files.encoded_keyframes(frames, kind="jpg", quality=90).orderBy("index").collect()
    assert [r.name for r in made] == [f"keyframe_{k:03d}.jpg" for k in (1, 2, 3)] and all(bytes(r.content)[:3] == b"\xff\xd8\xff" for r in made)
    (tmp_path / "board.jpg").write_bytes(files.storyboards(frames, kind="jpg").first().content)
    (image,) = spark.read.format("image").load(str(tmp_path)).select("image.width", "image.height").collect()
    assert image.width == 10 + 4 * 42
    with pytest.raises(ValueError):
        files.encoded_keyframes(frames.select("*", F.lit(1).alias("x")), kind="gif")
