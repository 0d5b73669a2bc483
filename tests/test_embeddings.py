"""The embedding plug-in with a small fixed model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import embeddings as E
from reelspark.operators import kernels as K
from reelspark.sources.video import IMAGE

WEIGHTS = np.random.default_rng(3).normal(size=(16 * 16 * 3, 5))


def _frames(spark, n=21):
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 256, (20 + i % 3 * 10, 40 - i % 2 * 25, 3), dtype=np.uint8) for i in range(n)]
    rows = [(1, i, ("", x.shape[0], x.shape[1], 3, 16, bytearray(x.tobytes()))) for i, x in enumerate(arrays)]
    return arrays, spark.createDataFrame([*rows, (1, n, None)], f"video_id long, frame_index long, image {IMAGE}").coalesce(1)


def _model_maker(folder):
    """A linear model that notes when it is made and how large its batches are."""
    weights = WEIGHTS

    def make():
        import os
        import uuid

        def note(text):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{os.getpid()} {text}")

        note("made")

        def model(x):
            note(len(x))
            return x.reshape(len(x), -1) @ weights

        return model

    return make


def test_model_is_made_once_and_gets_batches(spark, tmp_path):
    arrays, frames = _frames(spark)
    got = {r.frame_index: r.embedding for r in E.embedded(frames, _model_maker(str(tmp_path)), side=16, batch=8).collect()}
    assert sorted(got) == list(range(22)) and got[21] is None
    for i, x in enumerate(arrays):
        assert np.allclose(got[i], E.prepared(x, 16).reshape(-1) @ WEIGHTS, atol=1e-4)
    notes = [p.read_text().split() for p in tmp_path.iterdir()]
    sizes = [int(n) for _, n in notes if n != "made"]
    assert sum(sizes) == 21 and max(sizes) == 8 and len(sizes) == 3  # 8, 8, 5
    assert sum(n == "made" for _, n in notes) == len({pid for pid, _ in notes}) == 1
    unit = E.embedded(frames, _model_maker(str(tmp_path)), side=16, unit=True).where("frame_index = 4").first().embedding
    assert np.isclose(np.linalg.norm(unit), 1) and np.allclose(unit, np.array(got[4]) / np.linalg.norm(got[4]))


def test_fallback_without_a_model(spark):
    arrays, frames = _frames(spark, 4)
    got = {r.frame_index: r.embedding for r in E.embedded(frames).collect()}
    assert got[4] is None and all(np.allclose(got[i], K.fallback_features(x)) for i, x in enumerate(arrays))
    assert E.embedded(frames.where(F.lit(False))).count() == 0


def test_a_failing_model_fails_the_query(spark):
    _, frames = _frames(spark, 2)
    with pytest.raises(Exception, match="no weights"):

        def broken():
            raise OSError("no weights")

        E.embedded(frames, broken, side=16).collect()
    with pytest.raises(Exception, match="the model made"):
        E.embedded(frames, lambda: lambda x: np.zeros((1, 3)), side=16).collect()


def test_preparation_crops_the_middle():
    x = np.zeros((64, 128, 3), np.uint8)
    x[:, 32:96, 0] = 255  # blue in the middle
    p = E.prepared(x, 32, (0, 0, 0), (1, 1, 1))
    assert p.shape == (32, 32, 3) and p.dtype == np.float32 and np.allclose(p[16, 16], [0, 0, 1]) and np.allclose(E.prepared(x.transpose(1, 0, 2), 32, (0, 0, 0), (1, 1, 1))[16, 16], [0, 0, 1])
    assert E.prepared(np.full((1, 1, 3), 255, np.uint8), 8).shape == (8, 8, 3)
