"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["ka", "lo", "mi", "ren", "tu", "ves"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def rows() -> list[tuple]:
    base = words(200, 1)
    near = base[:]
    near[50] = "changed"
    texts = [
        " ".join(base), " ".join(base), " ".join(near), None, "", "   \n\t ", "one", "One", "two words", " ".join(words(30, 2)), " ".join(words(30000, 3)), "x" * 20000,
        "mail ann.lee@corp.example.org or +1 (555) 555-0123, host 10.0.0.255, card 4111 1111 1111 1111.", "é" * 10 + " a@b.c " + "ü" * 5, " ".join(words(60, 4) + base[20:120] + words(40, 5)), "!!! ### $$$", "Line.\nLine.\nLine.\n" * 30,
        "Licensed under CC BY 4.0. All rights reserved.",
    ]
    out = [(i, t, "en", None if i % 7 == 3 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "an id that is null " * 3, None, None, None), (None, None, None, None, None)]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def clashing(spark: SparkSession) -> DataFrame:
    """The documents with columns named as results and inner columns of the operators are."""
    from pyspark.sql import functions as F

    names = ("score", "node", "size", "term", "content", "taken", "bucket", "c0", "c1", "uid", "shard", "labels", "piece", "_id", "_source", "cut", "terms")
    return documents(spark).withColumns({n: F.lit(f"own {n}") for n in names})


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(18)] + [(3, None, 1), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
