"""SimHash components, collocations and infilling against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelspark.llm import collocations as C
from reelspark.llm import common, infill, neardup

from . import corpus


def _fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- SimHash near-duplicates ----------------------------------------------------------------------------------------


def _print(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", _fold(text))
    k = min(size, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(rows, radius=4):
    """{place: smallest id} of rows (id, print)."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least.setdefault(find(i), []).append(id_)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(rows))]


@given(st.text(alphabet="aAzZ éİK\t\n\x0b\x1f\xa0b.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_print_is_the_plain_definition(text):
    assert neardup.print_of(text.encode()) == _print(text)


def test_prints_of_long_texts_dont_depend_on_parts(monkeypatch):
    text = "  ".join(corpus.words(700, 3)) + "\n" + "x" * 300 + " Tail"
    whole = neardup.print_of(text.encode())
    monkeypatch.setattr(neardup, "PART_BYTES", 40)
    assert neardup.print_of(text.encode()) == whole == _print(text)


def test_near_duplicates_are_the_components_of_all_pairs(spark):
    rows = [(r[0], r[1]) for r in corpus.rows()]
    base = corpus.words(400, 11)
    rng = random.Random(4)
    for i in range(60):  # a chain of edits: components are wider than the radius
        base[rng.randrange(400)] = f"edit{i}"
        rows.append((1000 - i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [(i, _print(t)) for i, t in rows]
    want = sorted(zip([i for i, _ in prints], [f"{p:016x}" for _, p in prints], _components(prints), strict=True), key=str)
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert len({c for _, _, c in got}) < len({p for _, p in prints})
    kept = neardup.keep_one(docs).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({c: 1 for c in {c for *_, c in want}})


@pytest.mark.parametrize(("radius", "blocks", "cell"), [(4, 6, 8192), (4, 5, 7), (3, 6, 3), (0, 1, 8192), (7, 9, 8)])
def test_edges_connect_what_close_pairs_connect(spark, radius, blocks, cell):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)} | {rng.getrandbits(64) for _ in range(50)}
    ordered = sorted(prints)
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in ordered], "print long")
    edges = [(int(np.int64(u).view(np.uint64)), int(np.int64(v).view(np.uint64))) for u, v in neardup.close_edges(nodes, radius, blocks, cell).collect()]
    assert all((u ^ v).bit_count() <= radius and u != v for u, v in edges)
    want = _components([(i, p) for i, p in enumerate(ordered)], radius)
    root = {p: p for p in ordered}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    label = {}
    got = [label.setdefault(find(p), i) for i, p in enumerate(ordered)]
    assert got == want


def test_a_dense_bucket_gives_a_forest_not_its_pairs():
    own = np.array(sorted({sum(1 << b for b in c) for k in range(4) for c in combinations(range(16), k)}), np.uint64)
    u, v = neardup.forest(own, 4)
    assert len(u) == len(own) - 1 and len(set(u.tolist())) == len(u)


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(corpus.empty(spark)).count() == 0
    assert neardup.keep_one(corpus.empty(spark)).count() == 0
    plain, odd = neardup.near_duplicates(corpus.documents(spark)), neardup.near_duplicates(corpus.clashing(spark))
    assert sorted(map(str, plain.collect())) == sorted(map(str, odd.collect()))
    zero = {r["component_id"] for r in plain.collect() if r["fingerprint"] == "0" * 16}
    assert zero == {3}  # null, empty and blank texts are one component
    kept = neardup.keep_one(corpus.clashing(spark))
    assert kept.columns == corpus.clashing(spark).columns
    only_null = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [tuple(r)[2] for r in neardup.near_duplicates(only_null).collect()] == [None, None]
    assert neardup.keep_one(only_null).count() == 1
    with pytest.raises(ValueError):
        neardup.block_keys("print", 4, 4)


# --- collocations ---------------------------------------------------------------------------------------------------


def _counted(rows, longest=4):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    return n, f


def _collocations(rows, least=30, keep=2000):
    n, f = _counted(rows)
    cands = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    found = {}
    for (lang, p), a in cands.items():
        if any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for (x, q), b in cands.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in found.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:keep], 1))


def _talk(seed, n=300):
    r = random.Random(seed)
    vocab, fixed = ["ka", "Lo", "mi", "ren", "É", "İx", "\x00z", "tu\xa0v"], ["new york city", "a b c d", "old  town"]
    return [(r.choice(["en", None, "und", "fr"]), "".join(r.choice([*vocab, *fixed]) + r.choice([" ", "\t", "  ", ". ", "\n", ",", " "]) for _ in range(r.randint(0, 60)))) for _ in range(n)] + [("en", None), (None, None), ("de", ""), ("x", "..,")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations_are_those_of_a_plain_count(spark, monkeypatch, small):
    if small:  # flushes, and summaries that overflow
        monkeypatch.setattr(C.frequent, "__defaults__", (C.LONGEST, C.LEAST, 20))
        monkeypatch.setattr(C.survivors, "__defaults__", (C.LONGEST, C.LEAST, None, 500, 1))
    rows = _talk(5, 1500)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    got = sorted(tuple(r) for r in C.collocations(docs).collect())
    assert got == _collocations(rows) and len(got) > 100, len(got)
    few = sorted(tuple(r) for r in C.collocations(docs, least=9, keep=7).collect())
    assert few == _collocations(rows, 9, 7)


def test_phrases_of_a_text_dont_depend_on_its_parts(monkeypatch):
    texts = [(t or "").encode() for _, t in _talk(7, 60)] + [b"  ..  ", b"word" * 100, b"a " * 300]
    languages = C._language_hashes(["en"] * len(texts))

    def found():
        p = C.Phrases(texts, languages, 4)
        return [sorted((p.phrase(i, size), int(p.text[i]), x) for i, x in zip(first.tolist(), h.tolist(), strict=True)) for size, (first, h) in enumerate(p.of_sizes(4), 1)]

    whole = found()
    monkeypatch.setattr(C, "PART_BYTES", 17)
    assert found() == whole and all(whole)


def test_every_frequent_phrase_survives_and_few_others(spark):
    rows = _talk(6)
    docs = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    _, f = _counted(rows)
    alive = {r["id"] for r in C.survivors(docs, parts=5, flush=400, slack=1).collect()}
    names, ids = [], []
    for lang, p in f:
        found = C.Phrases([" ".join(p).encode()], C._language_hashes([lang]), len(p))
        first, h = list(found.of_sizes(len(p)))[-1]
        names.append((lang, p))
        ids.append(int(C._ids(h[first == 0], 5)[0]))
    assert all(i in alive for name, i in zip(names, ids, strict=True) if f[name] >= 30)
    assert sum(f[name] >= 30 for name in names) <= len(alive) < len(names) / 3


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30)), max_size=200), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_summaries_lose_less_than_mass_over_counters(items, capacity):
    summary, true = C.Summary(capacity, 5), Counter()
    for at in range(0, len(items), 3):
        part = Counter()
        for k, n in items[at : at + 3]:
            part[k] += n
        true += part
        keys = np.array(sorted(part), np.uint32)
        keys, counts = C.unpack(C.pack(keys, np.array([part[k] for k in keys.tolist()], np.int64)))
        summary.add(keys, counts)
    if not items:
        return
    keys, counts = summary.merge()
    kept = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert len(kept) <= capacity and summary.lost * (capacity + 1) <= sum(true.values())
    assert all(true[k] - summary.lost <= kept.get(k, 0) <= true[k] for k in true)


def test_packed_summaries_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 64, 65, 5000):
        keys = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64)).astype(np.uint32)
        counts = rng.integers(1, 1 << 31, len(keys))
        a, b = C.unpack(C.pack(keys, counts))
        assert (a == keys).all() and (b == counts).all()
    phrases, times = [b"", b"a", b"a b", "é \x00 x".encode()], [3, 1, 1 << 40, 7]
    assert C.unpack_phrases(C.pack_phrases(phrases, times)) == (phrases, times)


def test_scores_of_counts_whose_products_pass_64_bits(spark):
    big = 7 * 10**18
    counts = spark.createDataFrame([("en", "a", 1, big + 5), ("en", "b", 1, big + 9), ("en", "a b", 2, big), ("en", "", 0, big)], "lang string, phrase string, size int, f long")
    row = C.cut_scores(counts).first()
    assert (row["a"], row["l"], row["r"], row["score"]) == (big, big + 5, big + 9, 2_000_000 * big // (2 * big + 14))
    assert C.covered(counts).count() == 0


def test_collocations_of_odd_tables(spark):
    assert C.collocations(corpus.empty(spark)).count() == 0
    assert C.collocations(corpus.documents(spark).withColumn("text", F.lit(None).cast("string"))).count() == 0
    a, b = (sorted(map(tuple, C.collocations(d, least=20).collect())) for d in (corpus.documents(spark), corpus.clashing(spark).withColumn("n", F.lit("own")).withColumn("rank", F.lit(1))))
    assert a == b and a
    with pytest.raises(ValueError):
        C.collocations(corpus.documents(spark), least=0)


def test_wider_filters_tell_more_values_apart(spark):
    values = spark.range(-2000, 2000, 7).select(F.xxhash64("id").alias("term"))
    hashes = np.array([r["term"] for r in values.collect()], np.int64).view(np.uint64)
    others = common.mix64(np.arange(1, 200_000, dtype=np.uint64))
    for width in (10, 20, 24):
        bits = common.bit_filter(values, "term", width)
        assert common.passes(hashes, bits, width).all()
        assert abs(common.passes(others, bits, width).mean() - (1 - (1 - 2.0**-width) ** len(hashes))) < 0.02
    assert common.filter_bits(10) == 24 and common.filter_bits(10**6, 64) == 26 and common.filter_bits(10**7) == 28 and common.filter_bits(10**12) == 29


# --- infilling ------------------------------------------------------------------------------------------------------


def _infilled(text, doc_id):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.text(alphabet="aAbZz <>PSMé€\U0001f600\n1", max_size=80), st.integers(-3, 10**6))
@settings(max_examples=400, deadline=None)
def test_infilling_is_the_plain_definition(text, doc_id):
    n, form, prefix, middle, out = infill.transform(text.encode(), doc_id, infill.Memo())
    assert (n, form, prefix, middle, out.decode()) == _infilled(text, doc_id)
    assert infill.restore(out, form).decode() == text


@pytest.mark.parametrize("most", [1, 2, 3, 7, 64])
def test_cuts_over_chunk_edges_of_any_kind(monkeypatch, most):
    monkeypatch.setattr(infill, "MOST_BYTES", most)
    monkeypatch.setattr(infill, "MASK_BITS", 2)
    monkeypatch.setattr(infill, "RUN_BYTES", 50)
    rng = random.Random(most)
    memo = infill.Memo(limit=500)
    for i in range(150):
        text = "".join(rng.choice(["a", "Bc", "z" * 20, "é", "€", "😀", " ", "\n", "7"]) for _ in range(rng.randint(0, 80)))
        n, form, prefix, middle, out = infill.transform(text.encode(), i, memo)
        assert (n, form, prefix, middle, out.decode()) == _infilled(text, i)
        cuts = infill.Cuts(text.encode(), memo)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert cuts.after(k) == (len(head.encode()), len(head))


def test_equal_passages_make_equal_chunks_and_are_looked_up():
    shared = " ".join(corpus.words(4000, 2)).encode()
    memo = infill.Memo()
    infill.Cuts(b"first words " + shared, memo)
    first = memo.misses
    infill.Cuts(b"another, longer beginning of some words; " + shared + b" and an end", memo)
    assert first > 20 and memo.misses - first <= 4 and memo.hits >= first - 4
    ends = infill.chunk_ends(shared)
    assert (infill.chunk_ends(b"xy" * 40 + shared)[-20:] - 80 == ends[-20:]).all()


def test_chunk_ends_dont_depend_on_runs(monkeypatch):
    text = " ".join(corpus.words(3000, 8)).encode()
    whole = infill.chunk_ends(text)
    monkeypatch.setattr(infill, "RUN_BYTES", 777)
    assert (infill.chunk_ends(text) == whole).all() and whole[-1] == len(text)
    assert np.diff(np.r_[0, infill.chunk_ends(b"a" * 100_000)]).max() <= infill.MOST_BYTES


def test_infilling_of_odd_tables(spark):
    assert infill.restored(infill.fill_in_middle(corpus.empty(spark))).count() == 0
    rows = corpus.rows() + [(50, "a <S> b", "en", "s", 0), (51, "<P", "en", "s", 0), (52, "<S<", "en", "s", 0)]
    docs = spark.createDataFrame(rows, corpus.SCHEMA)
    got = infill.restored(infill.fill_in_middle(docs.withColumn("form", F.lit("own")).withColumn("output", F.lit("own")))).collect()
    want = [(i, *_infilled(t, i), t or "") for i, t, *_ in rows]
    key = lambda r: (str(r[0]), str(r))
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")) for r in got), key=key) == sorted(want, key=key)


def test_queries_read_whole_tables(spark):
    from reelspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = QUERIES["op13_fill_in_middle"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == n and all(r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
    prints = [(i, _print(t)) for i, t in texts.items()]
    want = dict(zip(texts, _components(prints), strict=True))
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op11_simhash_near_dedup"](spark, sf).collect()} == want
