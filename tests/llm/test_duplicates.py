"""Jaccard join, passages, fingerprints and neighbours against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspark.llm import ann, graph, jaccard, passages, simhash

from . import corpus
from .test_scans import _words


def _sets(texts):
    out = []
    for t in texts:
        w = _words(t)
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def _classes(ids, sets, threshold=0.8):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(ids[i])
    return links, [min((m for m in members[find(i)] if m is not None), default=None) for i in range(len(ids))]


def family_corpus(spark):
    """A family of near copies wider than one block, and noise."""
    rng = random.Random(9)
    base = corpus.words(150, 7)
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = f"edit{rng.randrange(10000)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(100 + i, " ".join(corpus.words(80, 50 + i)), "en", "s", 0) for i in range(10)]
    return spark.createDataFrame(rows, corpus.SCHEMA)


def test_near_classes_match_brute_force(spark):
    for docs in (corpus.documents(spark), family_corpus(spark)):
        rows = docs.collect()
        links, classes = _classes([r.doc_id for r in rows], _sets([r.text for r in rows]))
        expected = sorted((str(r.doc_id), str(c), n) for r, c, n in zip(rows, classes, links, strict=True))
        got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.near_classes(docs, block=16).collect())
        assert got == expected


def test_keep_one(spark):
    docs = corpus.clashing(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((str(r.doc_id) for r in kept.collect()))
    # 0, 1, 2 and the repeated row are one group, "one" and "One" another; texts without words all stay
    assert "0" in ids and "1" not in ids and "2" not in ids and ids.count("0") == 1 and ("6" in ids) != ("7" in ids)
    assert {"3", "4", "5", "15"} <= set(ids) and ids.count("None") == 2
    assert jaccard.keep_one(corpus.empty(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100 and 200 not in got


# --- passages


def _shared_runs(a, b, least=50):
    runs = {tuple(b[i : i + least]) for i in range(len(b) - least + 1)}
    return any(tuple(a[i : i + least]) in runs for i in range(len(a) - least + 1))


def test_passages_find_every_shared_run(spark):
    rng = random.Random(4)
    shared = [corpus.words(60, 900 + k) for k in range(4)]
    rows = []
    for i in range(40):
        w = corpus.words(120, 300 + i)
        if i % 4 != 3:
            at = rng.randrange(len(w))
            w[at:at] = shared[i % 4]
        rows.append((i, " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, corpus.SCHEMA)
    got = passages.repeated_passages(docs).collect()
    w = {r[0]: _words(r[1]) for r in rows}
    for r in got:
        a, b = w[r.doc_id][r.start_word : r.end_word], w[r.ref_doc_id][r.ref_start_word : r.ref_end_word]
        assert min(len(a), len(b)) >= 50 and r.identity >= 0.8 and r.n_equal <= min(len(a), len(b))
    found = {r.doc_id for r in got} | {r.ref_doc_id for r in got}
    assert found == {i for i in w if any(i != j and _shared_runs(w[i], w[j]) for j in w)} == {i for i in range(40) if i % 4 != 3}


def test_passages_are_fuzzy(spark):
    p = corpus.words(90, 77)
    q = p[:30] + ["put", "in"] + p[30:60] + p[63:]
    docs = spark.createDataFrame([(1, " ".join(corpus.words(100, 1) + p + corpus.words(50, 2))), (2, " ".join(corpus.words(20, 3) + q + corpus.words(90, 4)))], "doc_id long, text string")
    (r,) = passages.repeated_passages(docs).collect()
    a, b = sorted([(r.doc_id, r.start_word, r.end_word), (r.ref_doc_id, r.ref_start_word, r.ref_end_word)])
    assert abs(a[1] - 100) <= 2 and abs(a[2] - 190) <= 2 and abs(b[1] - 20) <= 2 and abs(b[2] - 109) <= 2 and r.n_equal >= 85


def test_fenwick_is_a_prefix_maximum():
    rng = np.random.default_rng(2)
    tree, plain = passages.PrefixMax(50), [-1e18] * 50
    for k in range(300):
        i, v = int(rng.integers(50)), float(rng.normal())
        tree.put(i, v, k)
        plain[i] = max(plain[i], v)
        n = int(rng.integers(0, 51))
        assert tree.get(n)[0] == max(plain[:n], default=-1e18)


def _exact_pairs(got, w):
    return {frozenset((r.doc_id, r.ref_doc_id)) for r in got if w[r.doc_id][r.start_word : r.end_word] == w[r.ref_doc_id][r.ref_start_word : r.ref_end_word]}


def test_passages_whose_parts_other_texts_hold(spark):
    # the halves of each shared passage also stand alone, in texts that sort first or last as their hashes fall
    rows, w = [], {}
    for k in range(12):
        p = [f"p{k}x{j}" for j in range(60)]
        for j, part in enumerate((p, p, p[:30], p[30:], p[:30], p[30:])):
            i = 10 * k + j
            w[i] = [f"a{i}x{x}" for x in range(40)] + part + [f"b{i}x{x}" for x in range(40)]
            rows.append((i, " ".join(w[i])))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert _exact_pairs(got, w) == {frozenset((10 * k, 10 * k + 1)) for k in range(12)} and len(got) == 12
    assert all(r.n_equal == 60 for r in got)


def test_seeds_are_kept_at_all_places():
    p = np.random.default_rng(5).integers(0, 2**63, 30).astype(np.uint64)
    h, at = passages.seeds(np.concatenate([p, p]))
    assert any((h == x).sum() == 2 for x in h) and {a + 30 for a in at if 0 < a < 18} <= set(at.tolist())


def test_match_is_the_same_in_any_batches():
    rng = np.random.default_rng(7)
    rows = sorted(zip(rng.integers(0, 12, 300).tolist(), rng.integers(0, 9, 300).tolist(), rng.integers(0, 50, 300).tolist(), strict=True))
    expected = []
    for key in sorted({k for k, _, _ in rows}):
        own = [(n, p) for k, n, p in rows if k == key]
        nodes = sorted({n for n, _ in own})
        at = {n: min(p for m, p in own if m == n) for n in nodes}
        for n, p in own:
            refs = {nodes[0], nodes[max(0, nodes.index(n) - 1)]} - {n}
            expected += [(n, r, p + d, at[r] + d) for r in refs for d in (passages.RUN_PLACES if key % 2 else (0,))]
    for size in (1, 2, 7, 300):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=["seed", "node", "pos"]) for i in range(0, len(rows), size)]
        assert sorted(r for b in passages._match(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == sorted(expected)


def _best_by_brute_force(segs):
    """The score of the best chain that ends in each segment, looking at all that may stand before it."""
    order = sorted(range(len(segs)), key=lambda i: segs[i][0])
    score = [0.0] * len(segs)
    for i in order:
        s, e, r = segs[i]
        best = 0.0
        for j in order:
            t, f, q = segs[j]
            je = q + f - t
            if t < s and q < r and -passages.SEED_WORDS < s - f <= passages.GAP_WORDS and -passages.SEED_WORDS < r - je <= passages.GAP_WORDS:
                best = max(best, score[j] - passages.GAP_COST * (s - f + r - je))
        score[i] = e - s + best
    return score


def test_overlapping_passages_are_covered(spark):
    """Texts share windows of common passages that overlap one another in any way; runs of 50 words are found whole."""
    rng = np.random.default_rng(31)
    bases = [[f"s{b}x{j}" for j in range(260)] for b in range(4)]
    w = {}
    for i in range(70):
        own = [f"f{i}x{j}" for j in range(120)]
        for _ in range(int(rng.integers(1, 3))):
            b, a, n = int(rng.integers(4)), int(rng.integers(0, 140)), int(rng.integers(30, 120))
            at = int(rng.integers(0, len(own)))
            own[at:at] = bases[b][a : a + n]
        w[i] = own
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in w.items()], "doc_id long, text string")).collect()
    said = {i: np.zeros(len(t), bool) for i, t in w.items()}
    for r in got:
        said[r.doc_id][r.start_word : r.end_word] = True
        said[r.ref_doc_id][r.ref_start_word : r.ref_end_word] = True
    holders = {}
    for i, t in w.items():
        for a in range(len(t) - 49):
            holders.setdefault(tuple(t[a : a + 50]), []).append((i, a))
    shared = {i: np.zeros(len(t), bool) for i, t in w.items()}
    for at in holders.values():
        if len({i for i, _ in at}) > 1:
            for i, a in at:
                shared[i][a : a + 50] = True
    all_, found = sum(x.sum() for x in shared.values()), sum((shared[i] & said[i]).sum() for i in w)
    assert all_ > 1000 and found >= 0.98 * all_
    assert all(said[i].any() for i in w if shared[i].any())


@pytest.mark.parametrize("length", [50, 52, 54, 56, 60])
def test_a_passage_is_found_though_others_hold_either_half(spark, length):
    """Two texts share a passage, and six others each of its halves: single seeds have other first holders."""
    rng, rows, pairs, i = random.Random(length), [], [], 0
    for case in range(20):
        shared = [f"p{case}x{j}" for j in range(length)]
        parts = [shared] * 2 + [shared[: length // 2]] * 6 + [shared[length // 2 :]] * 6
        for k, part in enumerate(parts):
            own = [f"c{case}f{k}x{j}" for j in range(rng.randint(80, 140))]
            at = rng.randint(10, 60)
            rows.append((i, " ".join(own[:at] + part + own[at:])))
            if k < 2:
                pairs.append((case, i, at))
            i += 1
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = 0
    for (_, a, at), (_, b, bt) in zip(pairs[::2], pairs[1::2], strict=True):
        said = [(r.doc_id, r.start_word, r.end_word) for r in got if {r.doc_id, r.ref_doc_id} == {a, b}]
        found += any(s <= (at if d == a else bt) and e >= (at if d == a else bt) + length for d, s, e in said)
    assert found >= 19


def test_a_run_is_found_though_all_neighbours_hold_less_of_it(spark):
    """Two texts share 50 words, and fourteen others 43 to 48 of them: first and preceding holders of most keys have less."""
    rng, rows, pairs, i = random.Random(50), [], [], 0
    for case in range(20):
        shared = [f"p{case}x{j}" for j in range(50)]
        parts = [shared] * 2 + [shared[: 43 + k] for k in (1, 2, 3, 4, 5, 5, 5)] + [shared[7 - k :] for k in (0, 1, 2, 3, 4, 5, 5)]
        for k, part in enumerate(parts):
            own = [f"c{case}f{k}x{j}" for j in range(rng.randint(80, 140))]
            at = rng.randint(10, 60)
            rows.append((i, " ".join(own[:at] + part + own[at:])))
            if k < 2:
                pairs.append((i, at))
            i += 1
    got = {frozenset(((r.doc_id, r.start_word, r.end_word), (r.ref_doc_id, r.ref_start_word, r.ref_end_word))) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {frozenset(((a, at, at + 50), (b, bt, bt + 50))) for (a, at), (b, bt) in zip(pairs[::2], pairs[1::2], strict=True)}


@pytest.mark.parametrize("length", [66, 78, 90])
def test_an_edited_passage_is_found_though_others_hold_its_parts(spark, length):
    """Two texts share a passage with two edits between them, and six others each of its halves: no single seed's first or preceding holder has both."""
    rng, rows, pairs, i = random.Random(length), [], [], 0
    for case in range(20):
        shared = [f"p{case}x{j}" for j in range(length)]
        edited = list(shared)
        edited[length // 3], edited[2 * length // 3] = f"e{case}", f"f{case}"
        parts = [shared, edited] + [shared[: length // 2]] * 6 + [shared[length // 2 :]] * 6
        for k, part in enumerate(parts):
            own = [f"c{case}f{k}x{j}" for j in range(rng.randint(80, 140))]
            at = rng.randint(10, 60)
            rows.append((i, " ".join(own[:at] + part + own[at:])))
            if k < 2:
                pairs.append((i, at))
            i += 1
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = 0
    for (a, at), (b, bt) in zip(pairs[::2], pairs[1::2], strict=True):
        said = [(r.doc_id, r.start_word, r.end_word) for r in got if {r.doc_id, r.ref_doc_id} == {a, b}]
        found += any(abs(s - (at if d == a else bt)) <= 2 and abs(e - (at if d == a else bt) - length) <= 2 for d, s, e in said)
    assert found == 20 and all(r.identity >= 0.8 for r in got)
    assert len({(r.doc_id, r.ref_doc_id) for r in got}) == len(got)


def test_all_holders_of_a_seed_pair_meet_in_any_batches():
    rng = np.random.default_rng(23)
    rows = sorted(zip(*(rng.integers(0, x, 200).tolist() for x in (15, 40, 5, 3, 50, 99)), strict=True))
    expected = sorted((n, m, p, q) for k, n, r, x, *own in rows for l, m, s, y, *other in rows if k == l and x != y and r != s and n > m for p, q in zip(own, other, strict=True))
    for size in (1, 2, 7, 200):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=list("abcdef")) for i in range(0, len(rows), size)]
        assert sorted(r for b in passages._match_all(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == expected
    seeds = sorted(zip(rng.integers(0, 30, 150).tolist(), rng.integers(0, 6, 150).tolist(), rng.integers(0, 50, 150).tolist(), strict=True))
    nodes = lambda k: len({n for key, n, _ in seeds if key == k})
    for size in (1, 2, 7, 150):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seeds[i : i + size], strict=True)], names=list("abc")) for i in range(0, len(seeds), size)]
        told = [r for b in passages._match_runs(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[0] == r[1]]
        for what, least in ((passages.SHARED, 2), (passages.CROWDED, 4)):
            assert sorted(r[0] for r in told if r[2] == what) == sorted(k for k in {s[0] for s in seeds} if k % 2 == 0 and nodes(k) >= least)


def test_runs_that_no_chain_has_are_the_same_in_any_batches():
    rng = np.random.default_rng(29)
    rows = []
    for _ in range(400):
        run = bool(rng.integers(2))
        chain = [[int(s), int(s + k), int(s - d)] for s, k, d in zip(rng.integers(0, 60, 3), rng.integers(20, 90, 3), rng.integers(0, 3, 3), strict=True)][: 1 if run else int(rng.integers(1, 4))]
        rows.append((int(rng.integers(4)), int(rng.integers(5)), chain, run))
    rows.sort(key=lambda r: r[:2])
    has = lambda c, s, e, r: any(a - q == s - r and a < s + passages.WINDOW and b > e - passages.WINDOW for a, b, q in c)
    expected = sorted((n, m, c[0]) for n, m, c, run in rows if run and not any(has(d, *c[0]) for k, o, d, other in rows if (k, o) == (n, m) and not other))
    assert 20 < len(expected) < sum(r[3] for r in rows) - 20
    for size in (1, 2, 7, 400):
        parts = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in x]), pa.array([r[1] for r in x]), pa.array([[v for s in r[2] for v in s] for r in x], pa.list_(pa.int64())), pa.array([r[3] for r in x])], names=list("abcd")) for i in range(0, len(rows), size) for x in [rows[i : i + size]]]
        assert sorted(r for b in passages._unknown(iter(parts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)) == expected


def test_every_shared_run_is_linked(spark):
    """Texts of overlapping windows: two that share 50 words on end have a passage around them together or with the same third one."""
    rng = np.random.default_rng(77)
    bases = [[f"s{b}x{j}" for j in range(90)] for b in range(5)]
    w = {}
    for i in range(80):
        b, a = int(rng.integers(5)), int(rng.integers(0, 30))
        w[i] = [f"f{i}x{j}" for j in range(30)] + bases[b][a : a + int(rng.integers(43, 62))] + [f"g{i}x{j}" for j in range(30)]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in w.items()], "doc_id long, text string")).collect()
    holders, linked = {}, {}
    for i, t in w.items():
        for a in range(len(t) - 49):
            holders.setdefault(tuple(t[a : a + 50]), set()).add(i)
    for r in got:
        for i, o, s, e in ((r.doc_id, r.ref_doc_id, r.start_word, r.end_word), (r.ref_doc_id, r.doc_id, r.ref_start_word, r.ref_end_word)):
            for a in range(s, e - 49):
                linked.setdefault(tuple(w[i][a : a + 50]), set()).add((i, o))
    shared = {run: have for run, have in holders.items() if len(have) > 1}
    assert len(shared) > 80
    for run, have in shared.items():
        told = linked[run]
        assert any(all(i == first or {(i, first), (first, i)} & told for i in have) for first in have)


def test_an_equal_run_in_a_bad_chain_is_kept(spark):
    run, odd = [f"r{j}" for j in range(50)], [f"o{j}" for j in range(6)]
    a = [f"a{j}" for j in range(40)] + run + [f"b{j}" for j in range(18)] + odd + [f"c{j}" for j in range(40)]
    b = [f"d{j}" for j in range(30)] + run + [f"e{j}" for j in range(18)] + odd + [f"f{j}" for j in range(40)]
    (r,) = passages.repeated_passages(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.start_word, r.end_word), (r.ref_doc_id, r.ref_start_word, r.ref_end_word)]) == [(1, 40, 90), (2, 30, 80)] and r.n_equal == 50


def test_keys_of_texts_are_those_of_each():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(v)}" for _ in range(n)) for n, v in ((0, 9), (3, 9), (6, 9), (9, 9), (12, 9), (13, 9), (60, 9), (0, 9), (400, 5000), (300, 3), (51, 500), (90, 4))]
    words = passages.Words([t.encode() for t in texts])
    for chosen in (np.arange(len(texts)), np.array([4, 6, 9]), np.array([11])):
        keys, at = passages.keys_of(words, chosen)
        runs = {}
        for i in chosen.tolist():
            h, p = passages.seeds(words.of(i))
            here = (at >= words.first[i]) & (at < words.first[i + 1])
            even = here & (keys & np.uint64(1) == 0)
            assert sorted(zip((h & ~np.uint64(1)).tolist(), p.tolist(), strict=True)) == sorted(zip(keys[even].tolist(), (at[even] - words.first[i]).tolist(), strict=True))
            own = sorted((at[here & ~even] - words.first[i]).tolist())
            assert own == [x for x in p.tolist() if x + passages.RUN_WORDS <= len(words.of(i))]
        for k, x in zip(keys.tolist(), at.tolist(), strict=True):
            if k & 1:
                assert runs.setdefault(k, words.hash[x : x + passages.RUN_WORDS].tobytes()) == words.hash[x : x + passages.RUN_WORDS].tobytes()
    everything = passages.windows_of(words, np.arange(len(texts)), np.full(1 << 20, 255, np.uint8), 8)[1]
    for i in (8, 10):
        assert [x - words.first[i] for x in everything.tolist() if words.first[i] <= x < words.first[i + 1]] == list(range(len(words.of(i)) - 49))


def test_alignment_of_many_is_that_of_each():
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(400):
        a = rng.integers(0, 4, int(rng.integers(60, 200))).astype(np.uint64)
        b = a.copy()
        b[rng.integers(0, len(b), 5)] = 9
        b = np.delete(b, rng.integers(0, len(b), int(rng.integers(0, 3))))
        chain, at, rat = [], int(rng.integers(0, 30)), int(rng.integers(0, 30))
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(1, 12))
            if max(at, rat) + n > min(len(a), len(b)):
                break
            chain.append((at, at + n, rat))
            at, rat = at + n + int(rng.integers(-3, 6)), rat + n + int(rng.integers(-3, 6))
        if chain:
            rows.append((a, b, chain))
    first = lambda parts: np.cumsum([0, *(len(p) for p in parts)])
    a, b, chains = zip(*rows, strict=True)
    got = passages.align_all(passages.Pairs(np.concatenate(a), first(a), np.concatenate(b), first(b), np.array([s for c in chains for s in c]), first(chains)))
    assert got.tolist() == [list(passages.align(*r)) for r in rows]


def test_crowds_first_holders_and_joined_windows_are_the_same_in_any_batches():
    rng = np.random.default_rng(17)
    rows = sorted(zip(rng.integers(0, 60, 200).tolist(), rng.integers(0, 4, 200).tolist(), rng.integers(0, 50, 200).tolist(), strict=True))
    of = lambda k: [(n, p) for key, n, p in rows if key == k]
    crowds = sorted(k for k in {r[0] for r in rows} if k % 2 and len(of(k)) > 2 and len({n for n, _ in of(k)}) > 1)
    firsts = sorted((n, of(k)[0][0], p, of(k)[0][1]) for k, n, p in rows if n != of(k)[0][0])
    windows = sorted((n, r, p - q, p, q) for n, r, p, q in {(n, r, p, p - d) for n, r, d, p in zip(*(rng.integers(0, x, 300).tolist() for x in (3, 3, 2, 900)), strict=True)})
    joined = set()
    for n, r, d, p, _ in windows:
        own = [x[3] for x in windows if x[:3] == (n, r, d)]
        start = max(x for x in own if x <= p and not any(x - passages.LEAST_WORDS <= y < x for y in own))
        end = min(x for x in own if x >= p and not any(x < y <= x + passages.LEAST_WORDS for y in own))
        joined.add((n, r, start, end + passages.LEAST_WORDS, start - d))
    batches = lambda rows, size: iter([pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=list("abc" if len(rows[0]) == 3 else "abcd")) for i in range(0, len(rows), size)])
    taken = lambda parts: sorted(r for b in parts for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for size in (1, 2, 7, 400):
        assert [r[0] for r in taken(passages._match_runs(batches(rows, size))) if r[0] == r[1] and r[2] == -1] == crowds
        assert taken(passages._match_first(batches(rows, size))) == firsts
        assert taken(passages._joined(batches([(n, r, p, q) for n, r, _, p, q in windows], size))) == sorted(joined)


def test_chain_scores_match_brute_force():
    rng = np.random.default_rng(21)
    for _ in range(150):
        segs = sorted({(int(s), int(s + n), int(r)) for s, n, r in zip(rng.integers(0, 150, 14), rng.integers(6, 30, 14), rng.integers(0, 150, 14), strict=True)})
        assert np.allclose(passages._best_before(segs)[0], _best_by_brute_force(segs))


def test_a_sure_passage_is_reported_once():
    at = np.arange(100, 160, 4)
    first, second, other = (3, at, at - 50), (5, at[2:], at[2:] + 7), (9, np.arange(130, 200, 4), np.arange(30, 100, 4))
    got = passages.passages_of([second, other, first])
    assert sorted({r for r, _ in got}) == [3, 9] or sorted({r for r, _ in got}) == [5, 9] or sorted({r for r, _ in got}) == [3, 5, 9]
    assert 9 in {r for r, _ in got}  # it goes on beyond the others
    assert [r for r, _ in passages.passages_of([second, first])] == [3]
    # what isn't sure hides nothing: few seeds hold little of it
    thin = (1, np.arange(100, 160, 15), np.arange(0, 60, 15))
    assert {r for r, _ in passages.passages_of([thin, (2, at[:4], at[:4])])} >= {1}


def test_chains_of_many_passages_are_whole():
    segs, at, rat = [], 0, 0
    for _ in range(14):
        for _ in range(3):
            segs.append((at, at + 20, rat))
            at, rat = at + 21, rat + 22
        at, rat = at + 300, rat + 200
    got = passages.chains(sorted(segs))
    assert sorted(len(c) for c in got) == [3] * 14 and sorted(s for c in got for s in c) == sorted(segs)


def test_a_far_chain_hides_no_near_one():
    far = [(0, 400, 0)]
    near = [(500, 520, 1000), (521, 541, 1022), (542, 562, 1044)]
    assert sorted(passages.chains(sorted(far + near))) == [far, near]


def test_passages_odd_cases(spark):
    got = passages.repeated_passages(corpus.clashing(spark)).collect()
    pairs = {(r.doc_id, r.ref_doc_id) for r in got}
    assert (1, 0) in pairs  # a copy, as a whole
    assert any({2, 0} == {a, b} for a, b in pairs) and any(14 in p for p in pairs)
    assert passages.repeated_passages(corpus.empty(spark)).count() == 0
    text = " ".join(corpus.words(60, 12))
    copies = spark.createDataFrame([(None, text), (None, text), (5, text), (6, text.upper()), (7, None), (8, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.ref_doc_id, r.n_equal) for r in passages.repeated_passages(copies).collect()) == [(0, 5, 60), (0, 5, 60), (6, 5, 60)]


# --- fingerprints


def test_fingerprints_match_the_stated_edit(spark):
    docs = corpus.documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for size in (None, 1, 7):
        got = {r.doc_id: r for r in simhash.fingerprint(docs, parts=size).collect()}
        assert len(got) == len(rows)
        for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            k = len(t) // 4
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint
    assert got[10].near_edited > got[10].near_next


def test_fingerprints_odd_cases(spark):
    assert simhash.fingerprint(corpus.documents(spark)).count() == len(corpus.rows())
    assert simhash.fingerprint(corpus.empty(spark)).count() == 0
    assert simhash.fingerprint(corpus.clashing(spark)).count() == len(corpus.rows())
    one = corpus.documents(spark).where("doc_id = 2")
    assert simhash.fingerprint(one).collect()[0].near_next == 1.0
    assert simhash.fingerprint(corpus.documents(spark).where("doc_id is null")).count() == 2


def test_near_counts_match_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (20, 16), dtype=np.uint8)
    prints = []
    for b in base:
        for _ in range(6):
            x = np.unpackbits(b)
            x[rng.choice(128, rng.integers(0, 5), replace=False)] ^= 1
            prints.append(np.packbits(x))
    prints += [prints[0], prints[0]]
    df = spark.createDataFrame([(p.tobytes().hex(),) for p in prints] + [(None,)], "fingerprint string")
    got = {r.fingerprint: r.n_near for r in simhash.near_counts(df).collect()}
    bits = np.unpackbits(np.array(prints), axis=1)
    for p, b in zip(prints, bits, strict=True):
        assert got[p.tobytes().hex()] == ((bits ^ b).sum(axis=1) <= 3).sum() - 1


def test_near_counts_at_any_radius_and_cell_size(spark):
    rng = np.random.default_rng(16)
    prints = []
    for b in rng.integers(0, 256, (12, 16), dtype=np.uint8):
        for _ in range(8):
            x = np.unpackbits(b)
            x[rng.choice(128, rng.integers(0, 12), replace=False)] ^= 1
            prints.append(np.packbits(x))
    df = spark.createDataFrame([(p.tobytes().hex(),) for p in [*prints, prints[0]]], "fingerprint string")
    bits = np.unpackbits(np.array([*prints, prints[0]]), axis=1)
    for radius, rows in ((14, 32_768), (14, 3), (8, 5), (0, 4)):
        got = {r.fingerprint: r.n_near for r in simhash.near_counts(df, radius=radius, cell_rows=rows).collect()}
        assert got == {p.tobytes().hex(): ((bits ^ b).sum(axis=1) <= radius).sum() - 1 for p, b in zip([*prints, prints[0]], bits, strict=True)}


def test_near_counts_find_edited_texts(spark):
    rows = []
    for i in range(30):
        w = corpus.words(300, 4000 + i)
        w[150] = f"edit{i}"
        rows += [" ".join(corpus.words(300, 4000 + i)), " ".join(w)]
    got = simhash.near_counts(simhash.own_prints(spark.createDataFrame([(t,) for t in rows], "text string")), radius=simhash.NEAR_BITS)
    assert got.where("n_near > 0").count() >= 0.9 * got.count()


# --- neighbours


def _recall(got, ids, x, k):
    """Share of the k nearest that were found; checks ranks, scores and order on the way."""
    by, hits, all_ = {}, 0, 0
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, found in by.items():
        own = int(np.flatnonzero(ids == q)[0])
        s = x @ x[own]
        order = [i for i in np.lexsort((ids, -s)) if i != own][:k]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(order) + 1))
        assert all(abs(score - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, score in found)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] <= b[1]) for a, b in zip(found, found[1:], strict=False))
        hits, all_ = hits + len({v for _, v, _ in found} & {int(ids[i]) for i in order}), all_ + len(order)
    return hits / all_, set(by)


def test_neighbours_recall_and_odd_cases(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    x[::3] /= np.linalg.norm(x[::3], axis=1)[:, None]  # lengths differ
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1020, [1.0] * 3), (1004, [float("inf")] + [0.0] * 15), (1005, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    recall, asked = _recall(ann.search(df, F.col("vec_id") % 20 == 0, k=10).collect(), np.arange(600), x, 10)
    assert asked == set(range(0, 600, 20)) and recall >= 0.9
    assert ann.search(df.where("false"), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 1"), F.lit(True)).count() == 0
    # at most k others: all of them
    assert ann.search(df.where("vec_id < 15"), F.col("vec_id") < 2).count() == 28


def test_neighbours_with_grown_and_parted_prefixes(spark):
    """Most rows lie close together, and some prefixes hold more than a cell even in full length."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 12))
    x[:500] = x[0] + 0.02 * rng.normal(size=(500, 12))
    x[500:560] = x[1] + 1e-9 * rng.normal(size=(60, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    recall, asked = _recall(ann.search(df, F.col("vec_id") % 20 == 0, k=10, cell_rows=40).collect(), np.arange(700), x, 10)
    assert asked == set(range(0, 700, 20)) and recall >= 0.9


def test_neighbours_of_equal_vectors_null_ids_and_clashing_columns(spark):
    one, other = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(i, one) for i in range(60)] + [(None, one), (None, other), (100, other), (100, other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(f"own {c}") for c in ("v", "q", "uid", "node", "h1", "r", "key", "tree", "score", "rank", "id")})
    got = {}
    for r in ann.search(df, (F.col("vec_id") % 20 == 0) | F.col("vec_id").isNull(), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got[0]) == [(i, i, 1.25) for i in range(1, 6)]
    assert sorted(got[20]) == [(i, i - 1, 1.25) for i in range(1, 6)]
    assert [v for _, v, _ in sorted(got[100], key=lambda t: t[:2])] == [100, 100, None, None, 0, 0, 1, 1, 2, 2]
    assert sorted(v for _, v, _ in got[None]) == [0, 0, 1, 1, 2, 2, 3, 4, 100, 100]


def test_forest_scores_a_small_share_of_many_rows():
    """The ascent by itself on 50,000 random directions: fewer than a tenth of the rows, nine of ten neighbours."""
    rng = np.random.default_rng(3)
    n = 50_000
    x = rng.normal(size=(n, 65)).astype(np.float32)
    x[:, 64] = 0
    x /= np.linalg.norm(x, axis=1)[:, None]
    h, wanted = ann.hashes(65), ann.candidates_wanted(n)
    probes = int(np.ceil(ann.PROBED * wanted * h.radix / (ann.TREES * n)))
    strings, asked = h.strings(x), rng.choice(n, 40, replace=False)
    share = hits = 0.0
    for a in asked:
        best, held = np.full(n, 999, np.int16), np.zeros(ann.LETTERS + ann.STEPS, np.int64)
        for tree in range(ann.TREES):
            own = strings[:, tree * ann.LETTERS : (tree + 1) * ann.LETTERS]
            for k, prefix in enumerate(ann.best_prefixes(h.costs(x[a : a + 1], tree, slice(0, 1))[0], probes)[0]):
                rows = np.flatnonzero(own[:, 0] == prefix[0])
                rows = rows[np.argsort(ann.packed(own[rows]))]
                at = ann.steps(h, tree, own[rows], x[a : a + 1], np.array([k == 0]).astype(int))[0]
                best[rows] = np.minimum(best[rows], at)
                best[rows[ann.cheapest(at[None])[0]]] = -1
                held += np.bincount(at, minlength=len(held))
        stop = int(np.argmax(held.cumsum() >= wanted))
        s = x @ x[a]
        s[a] = -9
        share += (best <= stop).mean()
        hits += (best[np.argsort(-s)[:20]] <= stop).mean()
    assert share / len(asked) < 0.1 and hits / len(asked) >= 0.9


def test_sorted_strings_give_ranges_of_equal_prefixes():
    h = ann.Hashes(8, trees=2, letters=4)
    x = np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    s = h.strings(x)[:, :4]
    s = s[np.argsort(ann.packed(s))]
    order = ann.packed(s)
    for i in range(0, 300, 17):
        for n in range(1, 5):
            low, high = ann.common_prefix(order, int(order[i]), n)
            assert [bool(b) for b in (s[:, :n] == s[i, :n]).all(axis=1)] == [low <= j < high for j in range(300)]


def test_best_prefixes_are_the_cheapest():
    costs = np.random.default_rng(5).random((3, 6)).astype(np.float32)
    all_ = sorted((float(costs[0, a] + costs[1, b] + costs[2, c]), (a, b, c)) for a in range(6) for b in range(6) for c in range(6))
    got = ann.best_prefixes(costs, 20)
    assert [tuple(p) for p in got[0].tolist()] == [p for _, p in all_[:20]] and np.allclose(got[1], [c for c, _ in all_[:20]])
