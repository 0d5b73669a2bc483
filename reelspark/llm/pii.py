"""Personal data: base patterns, and terms that reveal a protected entity by corpus co-occurrence.

Protected entities are the values that the base patterns find. Around each, terms are counted with their entity over
the whole corpus, and the terms' own document frequencies too. With p(e) the share of texts that hold the entity and
p(e|t) its share among texts that hold the term, a term discloses PMI(e; t) / IC(e) = log(p(e|t) / p(e)) / -log p(e) of
the entity's information. From GENERALISE on it is generalised to a class word, from REMOVE on it is removed, wherever
it stands. Counts are of distinct texts, so copies don't make evidence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bit_filter, cut, map_texts, mix64, passes, signed

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
CONTEXT_WORDS, LEAST_TEXTS, GENERALISE, REMOVE = 8, 3, 0.9, 0.98

_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # after a digit nothing new could begin
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LUHN = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind, in code points."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = [int(c) for c in m.group() if c.isdigit()]
            if 12 <= len(digits) <= 19 and sum(_LUHN[i % 2][d] for i, d in enumerate(reversed(digits))) % 10 == 0:
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_DIGIT = np.zeros(256, np.uint8)
_DIGIT[ord("0") : ord("9") + 1] = 1


def spans_of(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """base_spans of each; texts without an @ and with fewer than four digits aren't searched."""
    return [base_spans(t.decode("utf-8")) if b"@" in t or _DIGIT[np.frombuffer(t, np.uint8)].sum() >= 4 else [] for t in texts]


def _char_places(text: bytes) -> np.ndarray:
    """For each byte offset (and the end) the number of code points before it."""
    raw = np.frombuffer(text, np.uint8)
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def _word_places(words: Words, i: int, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's words in code points."""
    chars = _char_places(text)
    a, b = words.first[i], words.first[i + 1]
    return chars[words.start[a:b] - words.text_start[i]], chars[words.end[a:b] - words.text_start[i] - 1] + 1


def _digest(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)


def _entities(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """A hash of each span's value; how a number is parted doesn't count."""
    values = [re.sub(r"[\s().-]", "", text[s:e].lower()) if k > 1 else text[s:e].lower() for s, k, e in spans]
    return [_digest(f"{KINDS[k]}:{v}".encode()) for (_, k, _), v in zip(spans, values, strict=True)]


def contexts(docs: DataFrame, text: str = "text", near_words: int | None = CONTEXT_WORDS, pairs: np.ndarray | None = None) -> DataFrame:
    """Rows (term, entity, content): the words of texts with protected values, once per text; content is a hash of the text.

    Words within ``near_words`` of the value, or all of the text if None; of these only what may be in ``pairs``, a bit
    filter of term and entity. Words of protected values aren't terms. Term 0 stands for the entity itself.
    """
    source = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pairs) if pairs is not None else None

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch | None:
        found = spans_of(texts)
        some = [i for i, f in enumerate(found) if f]
        if not some:
            return None
        texts = [texts[i] for i in some]
        words, out = Words(texts), []
        for i, t in enumerate(texts):
            start, end = _word_places(words, i, t)
            own, spans, content = signed(words.of(i)), found[some[i]], _digest(t)
            free = np.ones(len(own), bool)
            for s, _, e in spans:
                free[np.searchsorted(end, s, side="right") : np.searchsorted(start, e)] = False
            whole = np.unique(own[free]) if near_words is None else None
            rows: set[tuple[int, int, int]] = set()
            for (s, _, e), entity in zip(spans, _entities(t.decode("utf-8"), spans), strict=True):
                if near_words is None:
                    terms = whole[passes(whole.view(np.uint64) ^ mix64(np.array([entity]).view(np.uint64)), shared.value)] if shared else whole
                else:
                    left, right = np.searchsorted(end, s, side="right"), np.searchsorted(start, e)
                    near = np.r_[max(0, left - near_words) : left, right : min(len(own), right + near_words)].astype(int)
                    terms = own[near[free[near]]]
                rows.update((w, entity, content) for w in terms.tolist())
                rows.add((0, entity, content))
            out += rows
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["term", "entity", "content"])

    return map_texts(source, work, "term long, entity long, content long")


def revealing_terms(docs: DataFrame, text: str = "text", least: int = LEAST_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Rows (term, disclosure, action), one per term whose disclosure of some entity reaches the threshold.

    A term must stand near the entity, within CONTEXT_WORDS words, in ``least`` distinct texts; then all texts count that
    hold both, wherever in them. Durable: the result is read again and again.
    """
    spark = docs.sparkSession
    near = cut(contexts(docs, text).groupBy("term", "entity").agg(F.countDistinct("content").alias("both")).where(F.col("both") >= least))
    named = near.where(F.col("term") != 0).select("term", "entity")
    entities = near.where(F.col("term") == 0).select("entity", F.col("both").alias("of_entity"))
    together = contexts(docs, text, None, bit_filter(_pair_names(named))).join(named, ["term", "entity"], "left_semi")
    pairs = cut(together.groupBy("term", "entity").agg(F.countDistinct("content").alias("both")))
    bits = spark.sparkContext.broadcast(bit_filter(pairs))
    source = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))

    def count(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch | None:
        words = Words(texts)
        keep = np.flatnonzero(passes(words.hash, bits.value))
        if not len(keep):
            return None
        owner = np.searchsorted(words.first, keep, side="right") - 1
        both = np.unique(np.stack([owner.astype(np.int64), signed(words.hash[keep])], axis=1), axis=0)
        content = np.array([_digest(t) for t in texts])
        return pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(content[both[:, 0]])], names=["term", "content"])

    total = source.count()  # one number
    wanted = pairs.select("term").distinct()
    holds = map_texts(source, count, "term long, content long").join(wanted, "term", "left_semi")
    # frequent terms meet in few rows before they meet in one: distinct texts by term and part, then their sums
    by_part = holds.groupBy("term", F.pmod("content", F.lit(64)).alias("part")).agg(F.countDistinct("content").alias("n"))
    of_term = by_part.groupBy("term").agg(F.sum("n").alias("of_term"))
    scored = pairs.join(entities, "entity").join(of_term, "term")
    n = F.lit(float(max(total, 2)))
    pmi = F.log(F.col("both") * n / (F.col("of_term") * F.col("of_entity")))
    information = F.greatest(F.log(n / F.col("of_entity")), F.lit(1e-9))
    best = scored.groupBy("term").agg(F.max(pmi / information).alias("disclosure")).where(F.col("disclosure") >= generalise)
    return cut(best.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")))


def _pair_names(pairs: DataFrame) -> DataFrame:
    """Rows (term): the numbers by which ``contexts`` looks up a term and an entity together."""

    @F.pandas_udf("long")
    def name(term: pd.Series, entity: pd.Series) -> pd.Series:
        both = term.to_numpy(np.int64).view(np.uint64) ^ mix64(entity.to_numpy(np.int64).view(np.uint64))
        return pd.Series(signed(both))

    return pairs.select(name("term", "entity").alias("term"))


def term_spans(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Rows (content, terms): for each text with revealing terms the md5 of the text and its array of (start, end, action)."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(terms))
    source = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch | None:
        words, rows = Words(texts), []
        may = passes(words.hash, bits.value)
        for i in np.flatnonzero(np.add.reduceat(np.r_[may, False].astype(np.int64), np.minimum(words.first[:-1], len(may))) * (words.counts > 0)):
            start, end = _word_places(words, i, texts[i])
            content = hashlib.md5(texts[i]).hexdigest()
            taken = [(s, e) for s, _, e in spans_of([texts[i]])[0]]
            own = signed(words.of(i))
            for k in np.flatnonzero(may[words.first[i] : words.first[i + 1]]).tolist():
                s, e = int(start[k]), int(end[k])
                if not any(a < e and s < b for a, b in taken):
                    rows.append((content, int(own[k]), s, e))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["content", "term", "start", "end"])

    found = map_texts(source, work, "content string, term long, start long, end long").join(terms.select("term", "action"), "term")
    return found.groupBy("content").agg(F.array_sort(F.collect_set(F.struct("start", "end", "action"))).alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term), one per row of ``docs``.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows give equal results.
    """
    terms = revealing_terms(docs, text)
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(terms))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())]))

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        found = spans_of(texts)
        counts = [[sum(k == want for _, k, _ in f) for f in found] for want in range(len(KINDS))]
        digests = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in f).encode()).hexdigest() for f in found]
        lists = pa.array([[{"start": s, "rank": k, "end": e, "kind": KINDS[k]} for s, k, e in f] for f in found], span)
        words = Words(texts)
        may = np.add.reduceat(np.r_[passes(words.hash, bits.value), False].astype(np.int64), np.minimum(words.first[:-1], len(words.hash))) * (words.counts > 0)
        # texts without a term have names of their own: many may be equal, empty ones above all
        content = [hashlib.md5(t).hexdigest() if m else f"-{i}-{id_}" for i, (t, m, id_) in enumerate(zip(texts, may, part.column(0).to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), lists, pa.array(content)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "content"])

    found = map_texts(source, work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:long,rank:int,end:long,kind:string>>, content string")
    if terms.isEmpty():
        return found.select(*found.columns[:6], _joined(F.col("base")).alias("spans"), F.lit(0).cast("long").alias("n_term"))
    found = found.join(term_spans(docs, terms, text), "content", "left")
    extra = F.coalesce(F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"), F.lit(TERM).alias("kind"))), F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", _joined(F.array_sort(F.concat("base", extra))).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def sanitise(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with base spans replaced by <KIND>, revealing terms by <TERM> or nothing; ``length`` follows the text.

    Rows and other columns stay as they are. A null text stays null. Overlapping spans are replaced as one, by the first.
    """
    names = docs.columns
    at, by = names.index(text), f"c{names.index(text)}"
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may clash
    terms = revealing_terms(rows, by)
    kinds = {c: t for c, t in rows.dtypes}
    if terms.isEmpty():
        rows = rows.withColumn("terms", F.lit(None).cast("array<struct<start:long,end:long,action:string>>"))
    else:
        rows = rows.withColumn("content", F.md5(F.col(by).cast("binary"))).join(term_spans(rows, terms, by), "content", "left").drop("content")

    def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        column, out = part.column(at), []
        for i, (t, extra) in enumerate(zip(texts, part.column(part.num_columns - 1).to_pylist(), strict=True)):
            if not column[i].is_valid:
                out.append(None)
                continue
            spans = [(s, e, f"<{KINDS[k].upper()}>") for s, k, e in spans_of([t])[0]]
            spans += [(x["start"], x["end"], "<TERM>" if x["action"] == "generalise" else "") for x in extra or []]
            if not spans:
                out.append(t.decode("utf-8"))
                continue
            own, parts, end = t.decode("utf-8"), [], 0
            for s, e, mark in sorted(spans):
                if s >= end:
                    parts += [own[end:s], mark]
                end = max(end, e)
            out.append("".join([*parts, own[end:]]))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else part.column(i) for i in range(part.num_columns - 1)], names=[f"c{i}" for i in range(part.num_columns - 1)])

    schema = ", ".join(f"c{i} {kinds[f'c{i}']}" for i in range(len(names)))
    done = map_texts(rows, work, schema, by)
    if length in names:
        n = f"c{names.index(length)}"
        done = done.withColumn(n, F.when(F.col(by).isNotNull(), F.length(by)).otherwise(F.col(n)).cast(kinds[n]))
    return done.toDF(*names)
