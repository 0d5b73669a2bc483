"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Per shard of the corpus each source's seeded stream of words is cut into blocks of equal size. The shard's seats
(blocks) go to its sources by highest quotients target / (2k + 1), which gives integer quotas; a source with more
seats than blocks takes whole passes first. The seeded order then decides which blocks are taken once more.
DataFrame operations only.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 8
SHARD_WORDS = 1_000_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: its size, weight and target.

    ``sized`` has _source and _size. Targets share the sum of all sizes by weight; a target stops at ``cap`` times
    its source's size and the excess is shared again among the others. The result of that repetition is the one
    level L with sum(least(cap * size, L * weight)) = total: sources are taken by cap * size / weight, those below
    the level are full. One row per source is ordered here, never the corpus.
    """
    per_source = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    by_name = W.orderBy(F.col("_source").isNull(), F.col("_source"))
    ranked = per_source.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_full", F.col("_source_size") * F.lit(float(cap)))
    by_ratio = W.orderBy(F.col("_full") / F.col("_weight"), F.col("_source").isNull(), F.col("_source"))
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(1))
    total = F.sum("_source_size").over(every)
    levelled = ranked.withColumn("_level", (total - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
    # the first source whose own cap isn't reached at its level sets the level of all; none does if nothing has words
    ratio = F.col("_full") / F.col("_weight")
    levelled = levelled.withColumn("_place", F.row_number().over(by_ratio))
    fits = levelled.withColumn("_cut", F.min(F.when(F.col("_level") <= ratio, F.struct("_place", F.col("_level").alias("level")))).over(every)["level"])
    return fits.select("_source", "_source_size", "_weight", F.least(F.col("_full"), F.coalesce(F.col("_cut"), F.lit(0.0)) * F.col("_weight")).alias("_target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """Returns doc_id, source, size, source_size, target, taken and passes for every row of ``docs``.

    ``taken`` counts the words that the mix takes of the document, repeats included, at most ``cap`` times its size;
    ``passes`` is taken / size. Null texts and texts without words have size 0 and taken 0; a null source is a source
    of its own, after the others; repeated rows are taken one by one. Reruns agree: the order is by a hash of
    seed, id and size. Shards hold about ``shard_words`` words, so no window grows with a source.
    """
    sized = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"))
    sized = cut(sized.withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), F.col("_id").cast("string"), F.coalesce("_source", F.lit("-")), F.col("_size").cast("string")))))
    total = sized.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]  # one number
    shards = max(1, round(total / shard_words))
    sized = sized.withColumn("_shard", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint"), F.lit(shards)))
    targets = source_targets(sized, weights, cap)

    # Cells: a source in a shard. A shard's seats are apportioned among its cells by Sainte-Lague.
    cells = _cells(sized, targets)
    in_shard = W.partitionBy("_shard")
    cells = cells.withColumn("_seats", F.round(F.sum("_claim").over(in_shard) / block).cast("bigint"))
    # A cell's seats are claim / d rounded, for one divisor d of the shard that differs from its mean by less than half a
    # seat per source. So all but a few of a cell's seats are sure, and only those few have their quotients ranked.
    claims = F.sum("_claim").over(in_shard)
    mean = claims / F.greatest(F.col("_seats"), F.lit(1))
    cells = cells.withColumn("_doubt", F.ceil(F.count("*").over(in_shard) / 2 * F.when(claims > 0, F.col("_claim") / claims).otherwise(0.0)) + 1)
    cells = cells.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_claim") / F.when(mean > 0, mean).otherwise(1.0) - 0.5) - F.col("_doubt")).cast("bigint"))
    open_seats = cells.withColumn("_seat", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + 2 * F.col("_doubt") + 2)))
    by_quotient = in_shard.orderBy(F.desc(F.col("_claim") / (2 * F.col("_seat") + 1)), F.col("_source").isNull(), F.col("_source"))
    sure_in_shard = F.sum(F.when(F.col("_seat") == F.col("_sure"), F.col("_sure")).otherwise(0)).over(in_shard)
    won = open_seats.withColumn("_rank", F.row_number().over(by_quotient)).withColumn("_free", F.col("_seats") - sure_in_shard)
    quotas = won.groupBy("_shard", "_source", "_cell_size", "_source_size", "_target").agg((F.max("_sure") + F.count_if((F.col("_rank") <= F.col("_free")) & (F.col("_claim") > 0))).alias("_quota"))

    # the quota in words: whole passes over the cell's stream, then the blocks at its beginning
    words = F.least(F.col("_quota") * block, cap * F.col("_cell_size"))
    quotas = quotas.withColumn("_passes", F.floor(words / F.greatest(F.col("_cell_size"), F.lit(1))).cast("bigint")).withColumn("_extra", (words - F.col("_passes") * F.col("_cell_size")).cast("bigint"))

    stream = W.partitionBy("_shard", "_source").orderBy("_key", "_id").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("_from", F.coalesce(F.sum("_size").over(stream), F.lit(0)))
    q = quotas.select(F.col("_shard").alias("_q_shard"), F.col("_source").alias("_q_source"), "_source_size", "_target", "_passes", "_extra")
    out = placed.join(q, (F.col("_shard") == F.col("_q_shard")) & F.col("_source").eqNullSafe(F.col("_q_source")))
    taken = F.col("_passes") * F.col("_size") + F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_extra") - F.col("_from")))
    out = out.withColumn("_taken", taken.cast("bigint"))
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.when(F.col("_size") > 0, F.col("_taken") / F.col("_size")).otherwise(0.0).alias("passes"),
    )


def _cells(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources in shards with their claim: the source's target in proportion to what the shard holds of it."""
    cells = sized.groupBy("_shard", "_source").agg(F.sum("_size").alias("_cell_size"))
    t = targets.select(F.col("_source").alias("_t_source"), "_source_size", "_target")
    joined = cells.join(t, F.col("_source").eqNullSafe(F.col("_t_source"))).drop("_t_source")
    return joined.withColumn("_claim", F.when(F.col("_source_size") > 0, F.col("_target") * F.col("_cell_size") / F.col("_source_size")).otherwise(0.0))


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has whole passes, and once more cut to the words of a last part.

    All columns stay; ``length`` follows a cut text. Rows that agree in id, source and size share what they take evenly.
    Texts without words aren't taken.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash
    by_id, by_text, by_source = (f"c{names.index(c)}" for c in (doc_id, text, source))
    taken = mix(rows, by_id, by_text, by_source, **options).groupBy("doc_id", F.col("source").alias("mix_source"), "size").agg(F.floor(F.sum("taken") / F.count("*")).cast("long").alias("taken")).where(F.col("taken") > 0)
    sized = rows.withColumn("mix_size", word_count(F.col(by_text)))
    same = F.col(by_id).eqNullSafe(F.col("doc_id")) & F.col(by_source).eqNullSafe(F.col("mix_source")) & (F.col("mix_size") == F.col("size"))
    joined = sized.join(taken, same)
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.filter(F.array(part), lambda x: x > 0))
    spread = joined.withColumn("cut", F.explode(copies))
    # the first words of a text with what lies between them; few rows are cut, so the pattern is applied to these alone
    cut_text = F.when(F.col("cut") > 0, _first_words(F.when(F.col("cut") > 0, F.col(by_text)), F.col("cut"))).otherwise(F.col(by_text))
    out = spread.withColumn(by_text, cut_text)
    if length in names:
        n = f"c{names.index(length)}"
        out = out.withColumn(n, F.when(F.col("cut") > 0, F.length(by_text)).otherwise(F.col(n)).cast(rows.schema[n].dataType))
    return out.select(*rows.columns).toDF(*names)


def _first_words(text: Column, n: Column) -> Column:
    @F.pandas_udf("string")
    def first(texts: pd.Series, counts: pd.Series) -> pd.Series:
        word = re.compile(r"[^\x20\x09-\x0D]+")

        def one(t: str | None, k: int) -> str | None:
            if t is None:
                return None
            end = 0
            for i, m in enumerate(word.finditer(t)):
                if i == k:
                    break
                end = m.end()
            return t[:end]

        return pd.Series([one(t, k) for t, k in zip(texts, counts, strict=True)])

    return first(text, n)
