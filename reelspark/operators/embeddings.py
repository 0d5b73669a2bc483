"""Embeddings of frames by a model that the user brings, in batches; fallback features without one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

# Means and deviations of red, green and blue that common image models are trained with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: The shorter side is scaled to this share more than the crop.
MARGIN = 8 / 7

Model = Callable[[np.ndarray], np.ndarray]


def prepared(bgr: np.ndarray, side: int = 224, mean: tuple[float, ...] = MEAN, deviation: tuple[float, ...] = DEVIATION) -> np.ndarray:
    """A frame as (side, side, 3) of red, green and blue: the shorter side scaled, the middle cut out, each colour standardised."""
    h, w = bgr.shape[:2]
    short = int(round(side * MARGIN))
    height, width = (short, max(side, int(round(w * short / h)))) if h <= w else (max(side, int(round(h * short / w))), short)
    x = K.resize(bgr.astype(float), height, width)
    y0, x0 = (height - side) // 2, (width - side) // 2
    rgb = x[y0 : y0 + side, x0 : x0 + side, ::-1] / 255
    return ((rgb - np.array(mean)) / np.array(deviation)).astype(np.float32)


def prepared_of(image: Column, side: int, mean: tuple[float, ...] = MEAN, deviation: tuple[float, ...] = DEVIATION) -> Column:
    """prepared() of an image column, flat."""

    @F.pandas_udf("array<float>")
    def compute(images: pd.DataFrame) -> pd.Series:
        return pd.Series([prepared(K.to_array(i), side, mean, deviation).reshape(-1) for _, i in images.iterrows()])

    return compute(image)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a zero row stays."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def embedded(frames: DataFrame, make_model: Callable[[], Model] | None = None, side: int = 224, batch: int = 32, unit: bool = False, image: str = "image", name: str = "embedding") -> DataFrame:
    """``frames`` with an embedding of their ``image``.

    ``make_model`` is called once in a Python worker and gives a function from a batch (n, side, side, 3) of prepared frames to
    vectors (n, d); it is off by default, and then the 256 fallback features stand in. ``unit`` scales vectors to length 1.
    A null image has a null embedding. A model that can't be made or fails is an error of the query, not a silent fallback.
    """
    there = F.col(image)["data"].isNotNull()
    if make_model is None:

        @F.pandas_udf("array<double>")
        def fallback(images: pd.DataFrame) -> pd.Series:
            return pd.Series([_unit(x[None])[0] if unit else x for x in (K.fallback_features(K.to_array(i)) for _, i in images.iterrows())])

        vector = fallback(F.col(image))
    else:

        def make() -> Model:
            model = make_model()

            def predict(pixels: np.ndarray) -> np.ndarray:
                out = np.asarray(model(pixels), np.float64)
                if out.ndim != 2 or len(out) != len(pixels):
                    raise ValueError(f"the model made {out.shape} of {len(pixels)} frames")
                return _unit(out) if unit else out

            return predict

        run = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[side, side, 3]])
        vector = run(prepared_of(F.col(image), side))
    known = frames.where(there).withColumn(name, vector)
    unknown = frames.where(~there).withColumn(name, F.lit(None).cast("array<double>"))
    return known.unionByName(unknown)
