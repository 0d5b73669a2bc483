"""One query per operator over its whole table, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_classes

    return near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fold
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels"), ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, fold, score

    docs = _table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels"), ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored
    from .simhash import NEAR_BITS, fingerprint, near_counts

    rows = stored(fingerprint(_table(spark, sf_dir, "documents")))
    return rows.join(near_counts(rows, radius=NEAR_BITS), "fingerprint").select(*rows.columns, "n_near")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import fill_in_middle, restored

    rows = restored(fill_in_middle(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_personal_data": op3_personal_data,
    "op4_quality": op4_quality,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_source_mixing": op8_source_mixing,
    "op9_fingerprints": op9_fingerprints,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Where SQL can say a query's whole result. The others have brute-force versions in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE m >= 0.8 * (x.n + y.n - m) - 1e-9),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a),
k AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY 1), o AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY 1)
SELECT d.doc_id, class_id, coalesce(n, 0) AS n_links FROM documents d JOIN k USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op8_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
e AS (SELECT *, md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR), coalesce(source, '-'), CAST(size AS VARCHAR))) AS k FROM d),
n AS (SELECT greatest(1, CAST(round(sum(size) / 1000000) AS BIGINT)) AS n FROM d),
z AS (SELECT e.*, CAST(CAST('0x' || substr(k, 1, 8) AS UINTEGER) AS BIGINT) % n.n AS shard FROM e, n),
p AS (SELECT source, CAST(sum(size) AS DOUBLE) AS t FROM z GROUP BY 1),
w AS (SELECT *, 3.0 * t AS cap, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS w FROM p),
v AS (SELECT *, row_number() OVER o AS i, (sum(t) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source)),
g AS (SELECT arg_min(level, i) AS level FROM v WHERE level <= cap / w),
t AS (SELECT source, t, least(cap, coalesce((SELECT level FROM g), 0.0) * w) AS target FROM v),
c AS (SELECT shard, z.source, sum(size) AS cell, any_value(t.t) AS t, any_value(target) AS target FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN t > 0 THEN target * cell / t ELSE 0.0 END AS claim FROM c),
s AS (SELECT *, CAST(round(sum(claim) OVER (PARTITION BY shard) / 8) AS BIGINT) AS seats, sum(claim) OVER (PARTITION BY shard) AS claims, count(*) OVER (PARTITION BY shard) AS m FROM q),
u AS (SELECT *, CAST(greatest(0, floor(claim / (CASE WHEN claims > 0 THEN claims ELSE 1 END / greatest(seats, 1)) - m - 2)) AS BIGINT) AS sure FROM s),
x AS (SELECT *, unnest(range(sure, sure + 2 * m + 8)) AS seat FROM u),
y AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY claim / (2 * seat + 1) DESC, source IS NULL, source) AS r, sum(CASE WHEN seat = sure THEN sure ELSE 0 END) OVER (PARTITION BY shard) AS given FROM x),
b AS (SELECT shard, source, any_value(cell) AS cell, any_value(t) AS t, any_value(target) AS target, least((max(sure) + count(*) FILTER (WHERE r <= seats - given AND claim > 0)) * 8, 3 * any_value(cell)) AS words FROM y GROUP BY 1, 2),
a AS (SELECT z.*, b.t, b.target, words // greatest(cell, 1) AS passes, words - (words // greatest(cell, 1)) * cell AS extra, coalesce(sum(size) OVER (PARTITION BY z.shard, z.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z JOIN b ON z.shard = b.shard AND z.source IS NOT DISTINCT FROM b.source),
f AS (SELECT *, CAST(passes * size + least(size, greatest(0, extra - start)) AS BIGINT) AS taken FROM a)
SELECT doc_id, size, CAST(t AS BIGINT) AS source_size, target, taken, source, CASE WHEN size > 0 THEN taken / size ELSE 0.0 END AS passes FROM f""",
    "op12_phrase_collocations": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
o AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 30),
k AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM c WHERE m > 1),
s AS (SELECT k.*, x.a AS l, y.a AS r, CAST(2000000 * k.a::HUGEINT // (x.a::HUGEINT + y.a) AS BIGINT) AS score FROM k JOIN c x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN c y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, m, a, w, unnest(range(1, m)) AS i FROM c WHERE m > 2),
v AS (SELECT lang, a, w, i, unnest(range(i + 1, m + 1)) AS j, m FROM i),
h AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS over FROM v WHERE j - i + 1 < m GROUP BY 1, 2),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h USING (lang, phrase) WHERE over IS NULL OR 100 * over::HUGEINT < 80 * a::HUGEINT)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN o USING (lang) WHERE rank <= 2000""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
x AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::UINTEGER::BIGINT AS h1, ('0x' || h[9:16])::UINTEGER::BIGINT AS h2, ('0x' || h[17:24])::UINTEGER::BIGINT AS h3, ('0x' || h[25:32])::UINTEGER::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, string_split(output, '<M>')[2] AS mid, string_split(string_split(output[4:], '<M>')[1], CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS two FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN two[1] || mid || two[2] ELSE two[2] || mid || two[1] END) AS restored_sha256 FROM r""",
}
