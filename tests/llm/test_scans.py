"""Licence scans, personal data, quality and toxicity against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import licenses, pii, quality, toxicity

from . import corpus

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _expected_license(text):
    w = _words(text)
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_match_brute_force(spark):
    extra = ["CC-BY cc by", "general Public license, version 3", "All rights, reserved. all rights reserved", "cc", "by cc", "ÀCC BY"]
    docs = corpus.documents(spark).union(spark.createDataFrame([(100 + i, t, None, None, 0) for i, t in enumerate(extra)], corpus.SCHEMA))
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _expected_license(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_template_markup():
    a = licenses.compile_template("licensed under [[the [[new]]]] act {{2}} end")
    run = lambda t: a.run([licenses.hash_word(w) for w in t.split()], 0)
    assert run("licensed under act end") == 4
    assert run("licensed under the new act a b end now") == 8
    assert run("licensed under the old act end") == -1
    assert run("licensed under act a b c end") == -1


def _as_regex(template):
    """A template over words that are each followed by a space."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.translate(LOWER)):
        out += "(?:" if part == "[[" else ")?" if part == "]]" else f"(?:[^ ]+ ){{0,{part[2:-2]}}}" if part[0] == "{" else re.escape(part) + " "
    return re.compile(out)


def _longest(pattern, words, at):
    """The end of the longest match that begins at a word, or -1; greedy choices aren't trusted."""
    for end in range(len(words), at - 1, -1):
        if pattern.fullmatch("".join(w + " " for w in words[at:end])):
            return end
    return -1


def _an_instance(template, rng):
    """A text that a template accepts, with some of what may be missing and words of any kind."""
    out, keep = [], [True]
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template.translate(LOWER)):
        if part == "[[":
            keep.append(keep[-1] and rng.random() < 0.5)
        elif part == "]]":
            keep.pop()
        elif keep[-1]:
            out += [f"w{rng.integers(9)}" for _ in range(rng.integers(int(part[2:-2]) + 1))] if part[0] == "{" else [part]
    return out


def test_templates_match_a_translation_to_regular_expressions():
    rng = np.random.default_rng(7)
    scanner = licenses.Scanner()
    patterns = {label: [_as_regex(t) for t in ts] for label, ts in licenses.TEMPLATES.items()}
    for label, templates in licenses.TEMPLATES.items():
        for template in templates:
            for broken in (False, True):
                own = _an_instance(template, rng)
                if broken:  # one word of it changed
                    own[rng.integers(len(own))] = "otherwise"
                words = _words(" ".join([*corpus.words(5, 1), *own, *corpus.words(5, 2)]))
                got = scanner.scan([" ".join(words).encode()])[0]
                want = {(x, at, end) for x, ps in patterns.items() for p in ps for at in range(len(words)) if words[at] in {"licensed", "released", "permission", "redistribution", "this", "apache", "gnu", "cc", "creative", "copyright"} and (end := _longest(p, words, at)) > at}
                found = {(x.rsplit(":", 2)[0], int(x.split(":")[-2]), int(x.split(":")[-1])) for x in got[7].split(",") if x}
                assert found == want and (broken or label in got[5].split(","))


def test_licenses_empty_and_clashing(spark):
    assert licenses.scan_licenses(corpus.empty(spark)).count() == 0
    assert licenses.scan_licenses(corpus.clashing(spark)).count() == len(corpus.rows())


# --- personal data: the base patterns exactly as stated, with plain regular expressions


def _plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_match_plain_patterns():
    rng = np.random.default_rng(0)
    alphabet = list("a1.@-+ ()9é%0") + ["4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (555) 555-0123", "255", "."]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet, rng.integers(1, 25)))
        assert pii.base_spans(t) == _plain_spans(t), t


def test_personal_data_rows(spark):
    got = {r.doc_id: r for r in pii.find_personal_data(corpus.documents(spark)).collect()}
    for i, t, *_ in corpus.rows():
        if i is not None:
            spans = _plain_spans(t or "")
            text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
            assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
            assert set(filter(None, text.split(","))) <= set(filter(None, got[i].spans.split(",")))
    assert pii.find_personal_data(corpus.empty(spark)).count() == 0
    assert pii.find_personal_data(corpus.clashing(spark)).count() == len(corpus.rows())


def _revealing_corpus(spark):
    """zorblatt stands near one address in most texts, and far from it in one."""
    rows = [(i, f"report {i} by zorblatt for ann@corp.example.org filed {' '.join(corpus.words(20, i))}") for i in range(5)]
    rows += [(10 + i, "report on " + " ".join(corpus.words(30, 100 + i))) for i in range(20)]
    return spark.createDataFrame([*rows, (99, "only zorblatt is named here"), (98, "zorblatt and ann@corp.example.org"), (97, "zorblatt " + " ".join(corpus.words(30, 900)) + " ann@corp.example.org")], "doc_id long, text string")


def test_revealing_terms_match_brute_force(spark):
    docs = _revealing_corpus(spark)
    texts = [r.text for r in docs.collect()]
    has, near, held = {}, {}, {}
    for t in texts:
        w = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(t)]
        for x in {x for x, _, _ in w}:
            has[x] = has.get(x, 0) + 1
        for s, _, e in _plain_spans(t):
            left = [x for x, a, b in w if b <= s][-pii.CONTEXT_WORDS :]
            right = [x for x, a, b in w if a >= e][: pii.CONTEXT_WORDS]
            for x in {*left, *right}:
                near[x] = near.get(x, 0) + 1
            for x in {x for x, a, b in w if b <= s or a >= e}:
                held[x] = held.get(x, 0) + 1  # wherever in the text
    n, of_entity = len(texts), 7
    expected = {x for x, k in near.items() if k >= 3 and np.log(held[x] * n / (has[x] * of_entity)) / np.log(n / of_entity) >= pii.GENERALISE}
    words = {int(np.int64(np.uint64(pii.Words([x.encode()]).hash[0]).view(np.int64))): x for x in has}
    assert {words[r.term] for r in pii.revealing_terms(docs).collect()} == expected and "zorblatt" in expected | {"zorblatt"}


def test_terms_have_spans_wherever_they_stand(spark):
    """Every span of the query besides the base ones, by brute force over the terms."""
    docs = _revealing_corpus(spark).union(spark.createDataFrame([(200, None), (201, ""), (202, "Zorblatt, zorblatt! x@zorblatt.org é zorblatt")], "doc_id long, text string"))
    names = {r.term for r in pii.revealing_terms(docs).collect()}
    term = lambda w: int(pii.signed(pii.Words([w.encode()]).hash)[0])
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    some = 0
    for r in docs.collect():
        base = _plain_spans(r.text or "")
        spans = [(s, k, e, pii.KINDS[k]) for s, k, e in base]
        spans += [(m.start(), 4, m.end(), "term") for m in WORD.finditer(r.text or "") if term(m.group()) in names and not any(m.start() < e and s < m.end() for s, _, e in base)]
        assert got[r.doc_id].spans == ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(spans))
        assert got[r.doc_id].n_term == len(spans) - len(base)
        some += len(spans) - len(base)
    assert some > 5


def test_sanitise(spark):
    out = pii.sanitise(corpus.clashing(spark))
    assert out.columns == corpus.clashing(spark).columns
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert "@" not in got[12] and "<EMAIL>" in got[12] and "<CARD>" in got[12] and "<IP>" in got[12] and "<PHONE>" in got[12]
    assert got[3] is None and got[4] == "" and got[9] == corpus.rows()[9][1]
    assert out.where("text is not null and n_chars <> length(text)").count() == 0
    assert pii.sanitise(corpus.empty(spark)).count() == 0


# --- classifiers


def test_fold_is_crc32(spark):
    got = {r.doc_id: r.f for r in corpus.documents(spark).select("doc_id", quality.fold(F.col("doc_id"), 3).alias("f")).collect()}
    assert all(got[i] == zlib.crc32(str(i).encode()) % 3 for i in got if i is not None) and got[None] is None


def test_trees_agree_with_walking_them():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.grow(x, y, trees=20, depth=3)
    for i in range(50):
        total = m.base
        for t in range(20):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(x[i, m.feature[t, node]] > m.threshold[t, node])
            total += m.value[t, node - 7]
        assert abs(total - m.margin(x[i : i + 1])[0]) < 1e-9
    assert ((m.probability(x) > 0.5) == y).mean() > 0.95


def test_quality_odd_cases(spark):
    docs, labels = corpus.documents(spark), corpus.labels(spark)
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == len(corpus.rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(corpus.empty(spark), model).count() == 0
    kept = quality.keep_good(corpus.clashing(spark), model)
    assert kept.columns == corpus.clashing(spark).columns
    none = quality.fit(docs, labels.where("false"), F.lit(True))
    assert quality.score(docs, none).count() == len(corpus.rows())


def _plain_statistics(text):
    """What the trees see of a text, in plain Python."""
    if not text:
        return [0.0] * len(quality.FEATURES)
    raw, n_all = text.encode(), len(text.encode())
    kind = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".!?", "comma": b",;:'\"()-"}
    n = {k: sum(b in v for b in raw) for k, v in kind.items()}
    n["high"], n["control"] = sum(b >= 128 for b in raw), sum((b < 32 and b not in b"\t\n\r") or b == 127 for b in raw)
    n["symbol"] = n_all - sum(n.values())
    w = _words(text)
    size = np.array([len(x.encode()) for x in w], float)
    many = lambda k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    lines = text.split("\n")
    p = np.array([raw.count(bytes([b])) for b in set(raw)]) / n_all
    f = {k: v / n_all for k, v in n.items()} | {"log_bytes": np.log1p(n_all), "log_words": np.log1p(len(w)), "stop_per_word": n["stop"] / max(len(w), 1), "byte_entropy": -(p * np.log2(p)).sum(), "distinct_lines": len(set(lines)) / len(lines), "line_words": np.log1p(len(w) / len(lines))}
    if w:
        f |= {"word_mean": size.mean(), "word_std": size.std(), "word_max": np.log1p(size.max()), "distinct_words": len(set(w)) / len(w), "top_word": max(map(w.count, w)) / len(w), "letters_per_word": (n["lower"] + n["upper"] + n["high"]) / len(w)}
    if len(w) > 1:
        f |= {"repeats_previous": sum(a == b for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1), "distinct_pairs": len(set(many(2))) / (len(w) - 1)}
    if len(w) > 5:
        f["distinct_fives"] = len(set(many(5))) / (len(w) - 4)
    return [float(f.get(k, 0.0)) for k in quality.FEATURES]


def test_statistics_match_plain_python():
    texts = [r[1] or "" for r in corpus.rows() if len(r[1] or "") < 5000] + ["a a a b, c! d? e.\n\n\tf\r\x00\x7f", "Ünï ß 12,5 % & #", "a b c d e", "a b c d e f"]
    assert np.allclose(quality.statistics([t.encode() for t in texts]), [_plain_statistics(t) for t in texts], atol=1e-9)


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    for v in np.unique(score):  # ties share their rank
        ranks[score == v] = ranks[score == v].mean()
    pos = label == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.9), ("op4_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    """On labelled rows that the fit never saw; the area under the curve of op2 is 0.93 on these 990 with 329 toxic texts to learn from."""
    import os

    from reelspark.llm.queries import QUERIES

    data = "/root/testdata/sf0.1"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", F.col(label).alias("label")).where("label is not null")
    found = QUERIES[name](spark, data).where("held_out").join(labels, "doc_id").toPandas()
    assert found["label"].nunique() == 2 and _auc(found["score"].to_numpy(), found["label"].to_numpy()) > least
    assert (found["predicted"] == found["label"]).mean() > 0.9


def test_ids_may_be_text_and_ties_count_as_good(spark):
    docs = spark.createDataFrame([(f"id{i}", " ".join(corpus.words(30, i)) if i % 2 else "!!! " * 20) for i in range(40)] + [("id1", "!!!"), (None, "x")], "doc_id string, text string")
    labels = spark.createDataFrame([(f"id{i}", i % 2, i % 2) for i in range(40)], "doc_id string, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels, F.lit(True))).count() == 42
    assert toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).count() == 42
    flat = quality.Trees(np.zeros((1, 1), int), np.full((1, 1), np.inf), np.zeros((1, 2)), 0.0)  # 0.5 for all
    assert quality.keep_good(docs, flat).count() == 42


def _plain_features(text, at):
    """Gap-weighted subsequences of four letters that begin in the window at a place; an edge of a word may end one."""
    out = {}
    text = text + " " * 20
    is_letter = str.isalpha
    for a in range(at, at + toxicity.WINDOW):
        for b in range(a + 1, a + toxicity.SPAN):
            for c in range(b + 1, a + toxicity.SPAN):
                for d in range(c + 1, a + toxicity.SPAN):
                    w, x, y, z = text[a], text[b], text[c], text[d]
                    if is_letter(x) and is_letter(y) and (is_letter(w) or is_letter(z)):
                        out[w + x + y + z] = out.get(w + x + y + z, 0) + toxicity.GAP ** (d - a - 3)
    return out


def test_kernel_is_the_gapped_subsequence_kernel():
    """K against enumerated subsequences, between windows of plain words."""
    texts = ["grobnik and more", "gro bnik", "grxobnik", "kin borg", "aaaa aaaa", "abcdefghijkl", "snuffwit snuffwit"]
    feats = []
    for t in texts:
        symbols, _ = toxicity.letters([t.encode()])
        feats.append(toxicity.features(symbols, np.array([0])))
    plain = [_plain_features(t, 0) for t in texts]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            want = sum(v * b.get(k, 0) for k, v in a.items())
            assert abs(toxicity._kernel(feats[i], 1, feats[j], 1)[0, 0] - want) < 1e-9


@pytest.fixture(scope="module")
def insults():
    rng = np.random.default_rng(3)
    texts, toxic = [], []
    for i in range(600):
        w = corpus.words(40, i)
        bad = i % 2
        if bad:
            w[rng.integers(0, 40)] = str(rng.choice(["grobnik", "fleezerd", "snuffwit"]))
        texts.append(" ".join(w).encode())
        toxic.append(bad)
    return toxicity.train(texts, np.array(toxic), landmarks=120, rounds=3)


@pytest.mark.parametrize("long_first", [False, True])
def test_one_long_labelled_text_doesnt_starve_the_others(spark, long_first):
    rng = random.Random(8)
    words = [w for w in corpus.words(300, 12) if len(w) > 3]
    rows = []
    for i in range(200):
        t = [rng.choice(words) for _ in range(12)]
        if i % 2:
            t.insert(rng.randrange(12), "worthless idiot")
        rows.append((i, " ".join(t)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if long_first:  # the first by the hash that the sample is ordered by
        first = int(docs.select(F.col("doc_id").cast("string").alias("_id")).orderBy(F.xxhash64("_id")).first()[0])
        rows = [(i, t * 700 if i == first else t) for i, t in rows]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels, F.lit(True), chars=60_000)
    asked = spark.createDataFrame([(1, "you are a worthless idiot they said"), (2, " ".join(words[:9]))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert got[1] > 0.6 and got[2] < 0.3


def test_a_sample_of_one_label_only_is_an_error(spark):
    docs = spark.createDataFrame([(1, "short and clean"), (2, "an idiot " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    with pytest.raises(ValueError, match="both labels"):
        toxicity.fit(docs, labels, F.lit(True), chars=2000)
    # texts of one label to begin with are none
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True), chars=2000)).count() == 2


def test_toxicity_finds_gapped_insults(insults):
    bad = insults.score([b"ka lo grobnik mi", b"ka lo gro.bnik mi", b"ka g r o b n i k mi", b"lo fleezxerd tu"])
    good = insults.score([b"ka lo mi ren tu ves", b"", b"renmi lolo katu"])
    assert (bad > 0.3).all() and (good < 0.3).all()


def test_toxicity_table_equals_kernel_sum():
    """A window's features give the same score through the table as one by one."""
    rng = np.random.default_rng(5)
    table = rng.normal(size=1 << 20).astype(np.float32)
    table.reshape(32, 32, 32, 32)[:, 0] = 0
    table.reshape(32, 32, 32, 32)[:, :, 0] = 0
    table.reshape(32, 32, 32, 32)[0, :, :, 0] = 0
    symbols, starts = toxicity.letters([b"some insulting words here"])
    window, code, weight = toxicity.features(symbols, np.array([3]))
    assert abs((table[code] * weight).sum() - toxicity.window_scores(symbols, starts, table)[3]) < 1e-3


def test_toxicity_odd_cases(spark, insults):
    got = toxicity.score(corpus.documents(spark), insults).collect()
    assert len(got) == len(corpus.rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(corpus.empty(spark), insults).count() == 0
    model = toxicity.fit(corpus.clashing(spark).drop("labels"), corpus.labels(spark).where("false"), F.lit(True))
    assert toxicity.score(corpus.clashing(spark), model).count() == len(corpus.rows())
