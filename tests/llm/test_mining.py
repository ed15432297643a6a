"""Clustering, fingerprints and phrases against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rvpanel.llm import centroid_tree as C
from rvpanel.llm import multiset_hash as M
from rvpanel.llm import phrases as P
from tests.llm.data import ODD, documents, prose

VECTORS = "vec_id long, embedding array<double>, x int, v string, cluster string"


def plain_clusters(rows, k, rounds, scale):
    """Every vector against every centroid, in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, C._integers(v, scale)))
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in starts[:k]]

    def place():
        return [min((C.square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, j), (_, v) in zip(place(), kept, strict=True):
            groups[j].append(v)
        for j, some in groups.items():
            centroids[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    found = place()
    each = defaultdict(int)
    for d, j in found:
        each[j] += d
    fit = lambda n: n if n < 1 << 63 else None
    total = sum(each.values())
    if any(d >= 1 << 63 for d, _ in found):
        total = 1 << 63
    out = []
    for (i, _), (d, j) in zip(kept, found, strict=True):
        whole = fit(each[j]) if all(fit(e) for e, m in found if m == j) or not each[j] else None
        out.append((i, j, fit(d), whole, fit(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()))
    return sorted(out, key=repr)


def clusters(spark, rows, **more):
    table = spark.createDataFrame([(i, v, 1, "v", "c") for i, v in rows], VECTORS).repartition(3)
    return sorted((tuple(r) for r in C.cluster(table, dims=4, **more).collect()), key=repr)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_clusters(spark, k):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 3, 0.3) for _ in range(4)]) for i in range(120)]
    rows += [(i, rows[0][1]) for i in (7, 200, 201, 202)] + [(300 + i, [0.0, 0.0, 0.0, i / 64]) for i in (-1, 1)]
    rows += [(400, None), (401, [1.0]), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan")] * 4), (404, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [0.5, 0.25, 0.0, -1.0])]
    assert clusters(spark, rows, k=k) == plain_clusters(rows, k, 3, 64)


def test_clusters_of_huge_numbers(spark):
    rows = [(1, [1e300, 0.0, 0.0, 0.0]), (2, [-1e300, 1e-9, 0.0, 0.0]), (3, [3e8, 1.0, 0.0, 0.0]), (4, [3e8, 1.0, 1.0, 0.0]), (5, [0.1] * 4)]
    got = clusters(spark, rows, k=2, rounds=2)
    assert got == plain_clusters(rows, 2, 2, 64)
    assert any(r[2] is None for r in got)


def test_no_vectors(spark):
    assert clusters(spark, []) == []
    assert clusters(spark, [(1, None), (2, [])]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-4, 4)] * 3), min_size=1, max_size=30), st.lists(st.tuples(*[st.integers(-6, 6)] * 3), min_size=1, max_size=20))
def test_tree_search_is_exact(points, asked):
    centroids = [list(p) for p in points]
    tree = C.Searcher(centroids)
    best, number, _ = tree.search(np.array(asked, np.int64))
    for v, d, c in zip(asked, best.tolist(), number.tolist(), strict=True):
        want = min((C.square(list(v), x), j) for j, x in enumerate(centroids))
        assert (d, c) == want == C.nearest(list(v), centroids, tree.nodes)


def test_tree_prunes():
    rng = np.random.default_rng(0)
    points = rng.integers(-1000, 1000, (256, 3))
    computed = C.Searcher(points.tolist()).search(rng.integers(-1000, 1000, (500, 3)))[2]
    assert computed < 500 * 256 / 4


def own_paragraphs(text):
    return re.findall(r"[^.,;:!?\n]*[.,;:!?\n]|[^.,;:!?\n]+", text)


def own_lanes(text):
    wide, cells, n = [0] * M.WIDE, [0] * (M.LEVELS * M.CELLS), 0
    for u in own_paragraphs(text):
        w = hashlib.sha256(u.encode()).hexdigest()[:63] + hashlib.sha256(b"1" + u.encode()).hexdigest()[:63]
        m = int(hashlib.md5(u.encode()).hexdigest()[:15], 16)
        v = next((v for v in range(M.LEVELS - 1) if m & (3 << 2 * v)), M.LEVELS - 1)
        cells[v * M.CELLS + (m >> 12) % M.CELLS] += (m >> 36) % 31 + 1
        wide = [a + int(w[9 * j : 9 * j + 9], 16) for j, a in enumerate(wide)]
        n += 1
    return "".join(f"{x % 2**36:09x}" for x in wide) + "".join(f"{x % 2**16:04x}" for x in cells) + f"-{n}"


def fingerprints(spark, texts, ids):
    return [tuple(r) for r in M.fingerprints(documents(spark, texts, ids=ids).repartition(3)).collect()]


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 4)
    rng = random.Random(5)
    texts = [". ".join(" ".join(prose(rng, rng.randint(1, 6))) for _ in range(rng.randint(1, 30))) for _ in range(25)]
    texts = [*ODD, *texts, texts[3], "a. b. c. " * 3000, "...\n\n!?", "no mark at all"]
    ids = rng.sample(range(1000), len(texts))
    got = {r[0]: r for r in fingerprints(spark, texts, ids)}
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts, strict=True))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[i][1:5] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own_lanes(t), own_lanes(edited))
        for near, other in zip(got[i][5:], (edited, after), strict=True):
            a, b = Counter(own_paragraphs(t)), Counter(own_paragraphs(other))
            apart = sum(((a - b) + (b - a)).values())
            true = 1 - apart / max(1, a.total() + b.total())
            assert 0 <= near <= 1 and (near == 1) == (a == b)
            assert abs(near - true) < 0.45
            if a.total() + b.total() < 16 and apart < 8:
                assert abs(near - true) < 0.25


def test_fingerprints_ignore_order_and_add_up(spark):
    rows = fingerprints(spark, ["a. b. c. ", " c. a. b.", "a. b.", " c."], [1, 2, 3, 4])
    prints = {r[0]: r[3] for r in rows}
    assert own_lanes("a. b. c. ") == prints[1]
    lanes = spark.createDataFrame([(1, 2)], "p int, q int")
    assert lanes.count() == 1
    split = lambda s: [int(s[9 * i : 9 * i + 9], 16) for i in range(14)] + [int(s[126 + 4 * i : 130 + 4 * i], 16) for i in range(144)] + [int(s.split("-")[1])]
    whole = own_lanes("a. b. c.")
    pair = spark.createDataFrame([(split(own_lanes("a. b.")), split(own_lanes(" c.")), split(whole))], "a array<long>, b array<long>, w array<long>")
    r = pair.select(M.combine("a", "b").alias("sum"), M.combine("w", "b", -1).alias("less"), "a", "w").first()
    assert r["sum"] == r["w"] and r["less"] == r["a"]


def test_fingerprints_of_repeats_nulls_and_few_rows(spark):
    assert fingerprints(spark, [], []) == []
    ((_, n, _, own, edited, near, after),) = fingerprints(spark, ["one. two. three. four."], [9])
    assert n == 22 and after == 1 and near < 1 and own != edited
    rows = fingerprints(spark, ["x. y.", "x. y.", None, "", "z."], [5, 5, None, None, 5])
    assert len(rows) == 5 and len({r[3] for r in rows}) == 3
    empty = own_lanes("")
    assert [r[3] == empty for r in rows].count(True) == 2


def test_fingerprints_stay_in_the_jvm(spark):
    plan = M.fingerprints(documents(spark, ["a. b.", "c."]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_phrases(rows, support, longest, cover, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if a >= support and " " in p}
        longer = Counter()
        for p, a in found.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    q = " ".join(w[i : i + k])
                    longer[q] = max(longer[q], a)
        ranked = []
        for p, a in found.items():
            if 100 * longer[p] < cover * a:
                w = p.split(" ")
                cuts = [(c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w))]
                score, _, l, r = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
                ranked.append((-score, -a, p.encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def sayings():
    rng = random.Random(11)
    words = prose(rng, 12) + ["É", "naïve", "ABC", "日本", "a b"]
    rows = []
    for i in range(150):
        pieces = [" ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(1, 9))) for _ in range(8)]
        rows.append((rng.choice(["en", "fr", "und", None]), rng.choice([". ", "\n", "\x0b", ",\t", "!?"]).join(pieces)))
    rows += [("en", "One Two\tthree  four five."), ("en", rows[0][1])] * 20 + [("de", t) for t in ODD] + [(None, None), ("", "x y x y x y")]
    return rows


@pytest.mark.parametrize(("sample", "top"), [(1, 2000), (4, 2000), (60, 7)])
def test_phrases(spark, sayings, monkeypatch, sample, top):
    monkeypatch.setattr(P, "RANKED", 40)
    docs = documents(spark, [t for _, t in sayings], langs=[g for g, _ in sayings]).repartition(3)
    got = sorted(tuple(r) for r in P.mine(docs, support=12, top=top, sample=sample).collect())
    assert got == plain_phrases(sayings, 12, 4, 80, top)
    assert len(got) > 20


def test_expansion_finds_what_the_sample_missed(spark, sayings):
    docs = documents(spark, [t for _, t in sayings], langs=[g for g, _ in sayings])
    found, passes = P.frequent_phrases(docs, support=12, sample=1 << 20)
    assert passes == 1
    whole, none = P.frequent_phrases(docs, support=12, sample=1)
    assert none == 0
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_phrases_with_a_full_filter_and_small_tables(spark, sayings, monkeypatch):
    """A filter that holds nearly everything, flushes after every text, pieces longer than a task may hold."""
    monkeypatch.setattr(P, "FLUSH_WORDS", 64)
    docs = documents(spark, [t for _, t in sayings], langs=[g for g, _ in sayings])
    few = P.build_filter(spark.createDataFrame([("en", f"w{i}") for i in range(400)], "lang string, phrase string"), most=256)
    counts = P.count_phrases(docs, 4, few).where("f >= 12 AND phrase <> ''")
    want = P.count_phrases(docs, 4).where("f >= 12 AND phrase <> ''")
    assert set(map(tuple, counts.collect())) <= set(map(tuple, want.collect()))
    got = sorted(tuple(r) for r in P.mine(docs, support=12).collect())
    assert got == plain_phrases(sayings, 12, 4, 80, 2000)


def test_many_words_in_one_piece():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, 5000) * (1 << 21)
    for k in (2, 3, 4):
        at, n = P._counted(a, np.arange(5000 - k), k)
        want = Counter(tuple(a[i : i + k].tolist()) for i in range(5000 - k))
        assert {tuple(a[i : i + k].tolist()): c for i, c in zip(at.tolist(), n.tolist(), strict=True)} == want


def test_no_phrases(spark):
    assert P.mine(documents(spark, [])).count() == 0
    assert P.mine(documents(spark, ODD)).count() == 0


def test_distinct_phrases_have_the_words_of_their_places():
    rng = np.random.default_rng(3)
    for words, k in ((4, 2), (90, 3), (90, 4), (1 << 17, 4), (1 << 21, 3)):
        a = rng.integers(0, words, 4000)
        at = np.flatnonzero(rng.random(4000 - k) < 0.7)
        ids, n = P._distinct(a, at, k)
        want = Counter(zip(*[a[at + j].tolist() for j in range(k)], strict=True))
        assert dict(zip(zip(*[i.tolist() for i in ids], strict=True), n.tolist(), strict=True)) == want


def test_counts_are_not_summed_twice_before_the_shuffle(spark):
    docs = spark.createDataFrame([("a b a b", "en")], "text string, lang string")
    plan = P.count_phrases(docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.rindex("HashAggregate")].split("Exchange", 1)[0] and plan.count("Exchange hashpartitioning(lang") == 1
    assert plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning(lang")
