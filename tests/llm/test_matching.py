"""Licence scan, repeated strings, near-duplicates, leaks and search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rvpanel.llm import latent_decontam, license_index, suffix_dedup, tensor_minhash, topk
from rvpanel.llm.components import components
from tests.llm.data import ODD, documents, prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


# --- licences -------------------------------------------------------------------------------


def test_licence_phrases(spark):
    rng = random.Random(4)
    pool = ["mit", "MIT", "license", "License.", "apache", "general", "public", "the", "é"]
    texts = [*ODD, *(" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(60)), "mit license " * 3000]
    texts.append("x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted. y")
    texts.append("Licensed under the Apache License, Version 2.0.")
    got = license_index.scan(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        words = WORD.findall((texts[r["doc_id"]] or "").translate(UPPER))
        places = []
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            k = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(k)] == k]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert "bsd" in got[-2]["labels"].split(",") and got[-2]["n_base"] == 0 and got[-2]["score"] == 1
    assert got[-1]["labels"] == "apache,apache-2.0"


def test_licence_empty_table(spark):
    assert license_index.scan(documents(spark, ["a"]).limit(0)).count() == 0


def test_licence_plan_is_native(spark):
    plan = license_index.scan(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- repeated strings -----------------------------------------------------------------------


def test_deep_shallow_order():
    rng = random.Random(5)
    for _ in range(200):
        letters = rng.choice([b"a", b"ab", b"abcdefgh"])
        base = bytes(rng.choices(letters, k=150))
        strings = [base[: rng.randint(0, 150)] + bytes(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 40))]
        for sort in (suffix_dedup.deep_shallow_order, suffix_dedup.blind_trie_order):
            order, common = sort(strings, list(range(len(strings))))
            assert [strings[i] for i in order] == sorted(strings)
            assert common == [0, *(suffix_dedup._common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False))]


def brute_repeats(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), gone))
    return out


def repeat_texts():
    rng = random.Random(6)
    shared = [" ".join(prose(rng, 60)) for _ in range(3)]
    texts = [*ODD, "la " * 400, "lé" * 300, "x" * 250]
    for i in range(50):
        parts = [" ".join(prose(rng, rng.randint(1, 50)))]
        if i % 2:
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a : a + rng.randint(150, 330)], " ".join(prose(rng, 20))]
        texts.append(" ".join(parts))
    return [*texts, texts[20], texts[21], texts[21], " ".join(prose(rng, 3000)) * 2]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 3: most k-grams are dealt to several tasks
    texts = repeat_texts()
    docs = documents(spark, texts).repartition(5)
    got = suffix_dedup.remove_repeats(docs, texts_out=True).collect()
    want = [(i, *b[:4]) for i, b in enumerate(brute_repeats(texts, 200))]
    assert by_id((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == [w[:4] for w in want]
    plain = suffix_dedup.remove_repeats(docs).collect()
    assert by_id(plain) == want
    marks = brute_repeats(texts, 200)
    for r in got:
        t = texts[r["doc_id"]] or ""
        at, kept = 0, []
        for c in t:  # a character stays if one of its bytes does
            n = len(c.encode())
            if not marks[r["doc_id"]][4][at : at + n].all():
                kept.append(c)
            at += n
        assert r["kept_text"] == "".join(kept)


def test_repeats_long_text_in_segments(monkeypatch):
    rng = random.Random(7)
    text = (" ".join(prose(rng, 9000))).encode()
    whole = suffix_dedup.anchors([text])
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 4096)
    cut = suffix_dedup.anchors([text])
    spread = lambda a: sorted((int(p) - o, int(p)) for _, p, lo, hi, _ in zip(*a, strict=True) for o in range(lo, hi + 1))
    assert spread(whole) == spread(cut)
    assert [s for s, _ in spread(cut)] == list(range(len(text) - 199))


def test_repeats_empty_and_null_ids(spark):
    assert suffix_dedup.remove_repeats(documents(spark, ["a"]).limit(0)).count() == 0
    docs = documents(spark, ["q" * 300, "r", "q" * 300], ids=[None, None, 2])
    assert by_id(r[:4] for r in suffix_dedup.remove_repeats(docs).collect()) == [(2, 300, 300, 1), (None, 1, 0, 0), (None, 300, 300, 1)]


# --- near-duplicates ------------------------------------------------------------------------


def shingle_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute_components(texts, ids):
    sets, parent = shingle_sets(texts), {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i), root(i) == i) for i, s in zip(ids, sets, strict=True)]


def near_texts():
    """One large group with edits of every strength, pairs around the threshold, copies, strangers."""
    rng = random.Random(8)
    base = prose(rng, 160)
    texts = [*ODD]
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = "".join(prose(rng, 2))
        texts.append(" ".join(words))
    for k in range(25):
        own = prose(rng, 60 + k)
        texts += [" ".join(own), " ".join([*own[:-3], *prose(rng, 1 + k % 5)])]
    return [*texts, texts[9].upper(), texts[9], "one two", "ONE two", " ".join(prose(rng, 5000))]


def test_near_duplicates(spark):
    texts = near_texts()
    ids = random.Random(9).sample(range(1000), len(texts))
    got = tensor_minhash.near_duplicates(documents(spark, texts, ids=ids).repartition(4)).collect()
    assert by_id(got) == by_id(brute_components(texts, ids))


def test_near_duplicates_repeated_and_null_ids(spark):
    docs = documents(spark, ["a b c d e f", "A b c d e f", None, "a b c d e f", "z"], ids=[5, 5, 6, None, None])
    got = by_id(tensor_minhash.near_duplicates(docs).collect())
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True), (None, 1, None, True), (None, 2, None, True)]
    assert tensor_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# --- benchmark leaks ------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(10)
    items = [" ".join(prose(rng, n)) for n in (12, 20, 30, 45, 90)]
    plain = [" ".join(prose(rng, rng.randint(20, 300))) for _ in range(150)]
    texts, leaked = list(plain), {}
    for k, item in enumerate(items):
        words = item.split()
        near = [w if j % 6 else "zzyx" for j, w in enumerate(words)]
        for w in (words, near):
            leaked[len(texts)] = k
            own = plain[k].split()
            texts.append(" ".join([*own[:25], *w, *own[25:]]))
    texts += [*ODD, texts[150]]
    leaked[len(texts) - 1] = 0
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "too short"), (92, "")], "item_id long, text string")
    got = latent_decontam.find_leaks(documents(spark, texts), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == set(leaked.items())
    assert latent_decontam.find_leaks(documents(spark, texts).limit(0), bench).count() == 0
    assert latent_decontam.find_leaks(documents(spark, ["a b"]), bench.limit(0)).count() == 0


def test_leaks_of_short_items(spark):
    """Every exact copy of an item of 8 to 16 words is found in the middle of other words; of those with a fifth of their
    words replaced nine in ten are."""
    rng = random.Random(30)
    pool = prose(rng, 3000)
    common = pool[:60]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(pool) for _ in range(n)]
    items = [text(n) for n in (8, 9, 10, 12, 14, 16) for _ in range(10)]
    texts, exact, near = [], set(), set()
    for k, item in enumerate(items):
        for copy in range(4):
            words = list(item)
            if copy == 3:
                for j in rng.sample(range(len(words) - 3), len(words) // 5):
                    words[j] = "zzyx"
            (near if copy == 3 else exact).add((len(texts), k))
            texts.append(" ".join([*text(rng.randint(60, 120)), *words, *text(rng.randint(60, 120))]))
    texts += [" ".join(text(200)) for _ in range(100)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent_decontam.find_leaks(documents(spark, texts), bench).collect()}
    assert exact <= got
    assert len(near & got) >= 0.9 * len(near)


def test_leaks_of_very_short_items(spark):
    """Items of two to seven words are found where all their words stand in a row, and nowhere else."""
    rng = random.Random(33)
    pool = prose(rng, 400)
    items = [rng.sample(pool, n) for n in range(2, 8)] + [["aa", "bb", "aa", "bb"], ["only"]]
    texts = []
    for item in items:
        for words in (item, item[::-1], [*item[:-1], "between", item[-1]]):
            texts.append(" ".join([*rng.choices(pool[:50], k=rng.choice([0, 5, 50])), "start", *words, "end", *rng.choices(pool[:50], k=40)]))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    joined = [f" {t} " for t in texts]
    want = {(i, k) for i, t in enumerate(joined) for k, w in enumerate(items) if len(w) > 1 and f" {' '.join(w)} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in latent_decontam.find_leaks(documents(spark, texts), bench).collect()}
    assert got == want and len(want) >= len(items) - 1


def test_passages_are_counted_once_a_word():
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 50, n).astype(np.uint32) for n in (0, 1, 31, 32, 33, 200, 0)]
    df = np.zeros(latent_decontam.HASHED + 1, np.int64)
    latent_decontam._count_passages(rows, df)
    passages = [set(r[i : i + 32].tolist()) for r in rows for i in range(0, len(r), 32)]
    assert df[-1] == len(passages)
    assert df[:50].tolist() == [sum(w in p for p in passages) for w in range(50)] and df[50:-1].sum() == 0


def reworded(words):
    """Every fourth word is another, so that no four in a row stay."""
    return [w if j % 4 != 3 else f"zz{j}" for j, w in enumerate(words)]


def test_leaks_in_one_document(spark):
    """All words stand in all passages of a table of a document or two."""
    rng = random.Random(31)
    item = prose(rng, 30)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for words in (item, reworded(item)):
        for around in (0, 1, 40):
            text = " ".join([*prose(rng, around), *words, *prose(rng, around)])
            for texts in ([text], [text, text], [text, " ".join(prose(rng, 30))]):
                got = latent_decontam.find_leaks(documents(spark, texts), bench).collect()
                assert {r["doc_id"] for r in got} == {i for i, t in enumerate(texts) if t == text}, (around, len(texts))


def test_leaks_in_a_third_of_short_rows(spark):
    """Words of a large group of copies are common, and tell its leak nevertheless."""
    rng = random.Random(32)
    pool = prose(rng, 2000)
    items = [rng.choices(pool, k=15) for _ in range(4)]
    for words in (items[0], reworded(items[0])):
        copy = " ".join([*rng.choices(pool, k=7), *words, *rng.choices(pool, k=7)])
        texts = [" ".join(rng.choices(pool, k=30)) for _ in range(1000)] + [copy] * 500
        bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
        got = latent_decontam.find_leaks(documents(spark, texts), bench).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 0) for i in range(1000, 1500)}


def test_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(200):
        a, b = rng.choices(range(4), k=rng.randint(1, 12)), rng.choices(range(4), k=rng.randint(0, 12))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert latent_decontam.lcs(a, b) == rows[-1][-1]


def test_singular_vectors_match_numpy(spark):
    rng = random.Random(12)
    pool = prose(rng, 60)
    docs = documents(spark, [" ".join(rng.choices(pool, k=128)) for _ in range(200)])
    staged = latent_decontam.stage(docs)
    idf = np.ones(latent_decontam.HASHED) * 2
    known = latent_decontam.Vocabulary(idf)
    _, values = latent_decontam.singular_vectors(staged, idf)
    a = np.zeros((200, latent_decontam.HASHED))
    for i, r in enumerate(staged.collect()):
        np.add.at(a[i], np.frombuffer(r["ids"], np.uint32) % latent_decontam.HASHED, 2.0)
    a[:, known.place < 0] = 0
    a /= np.maximum(np.sqrt((a * a).sum(axis=1, keepdims=True)), 1e-9)
    exact = np.linalg.svd(a, compute_uv=False)
    rank = min(int((exact > 1e-6).sum()), len(values))
    assert np.allclose(values[:rank], exact[:rank], rtol=0.05, atol=0.02)


# --- search ---------------------------------------------------------------------------------


def test_top_k(spark):
    rng = random.Random(13)
    pool = prose(rng, 80)
    texts = [*ODD, *(" ".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(80))]
    texts += [texts[20], texts[20]]
    docs = documents(spark, texts).repartition(4)
    queries = spark.createDataFrame([(0, texts[20]), (1, "nowhere-to-find"), (2, None), (3, " ".join(pool)), (4, pool[0]), (4, pool[1]), (None, pool[0])], "query_id long, text string")
    got = [tuple(r) for r in topk.search(docs, queries, k=7).collect()]
    words = [WORD.findall((t or "").translate(UPPER)) for t in texts]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    want = []
    for q, terms in ((0, set(words[20])), (3, set(WORD.findall(" ".join(pool)))), (4, {pool[0], pool[1]})):
        scored = []
        for d, ws in enumerate(words):
            tf, total = Counter(ws), 0
            for t in terms & tf.keys():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                total += math.floor(idf * (tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean))) * 65536 + 0.5)
            if total:
                scored.append((-total, d))
        want += [(q, r, d, -s / 65536) for r, (s, d) in enumerate(sorted(scored)[:7], 1)]
    assert sorted(got) == sorted(want)
    assert topk.search(docs.limit(0), queries).count() == 0 and topk.search(docs, queries.limit(0)).count() == 0


def test_pruning_skips_blocks(monkeypatch):
    """The k best of a shard stay the same whatever the size of its blocks."""
    rng = np.random.default_rng(14)
    docs, terms = 900, 60
    hold = np.unique(np.stack([rng.integers(0, docs, 9000), rng.zipf(1.3, 9000).clip(1, terms)], axis=1), axis=0)
    row = topk._shard_bytes(hold[:, 1].astype(np.uint64), hold[:, 0], rng.integers(1, 9, len(hold)), rng.integers(20, 400, docs), np.arange(docs))
    found = []
    for block in (7, 128, 5000):
        monkeypatch.setattr(topk, "BLOCK", block)
        shard = topk.Shard(row, 120.0)
        found.append([shard.best(np.arange(1, m, dtype=np.uint64), np.linspace(0.1, 4, m - 1), 10, 0.0) for m in (3, 10, 40)])
    for other in found[1:]:
        for (a, s), (b, t) in zip(found[0], other, strict=True):
            assert a.tolist() == b.tolist() and s.tolist() == t.tolist()


def test_common_terms_are_added_up_for_queries_together(monkeypatch):
    """The k best are those of all postings, however many terms count as common."""
    rng = np.random.default_rng(15)
    docs, terms = 700, 50
    hold = np.unique(np.stack([rng.integers(0, docs, 9000), rng.zipf(1.2, 9000).clip(1, terms)], axis=1), axis=0)
    tf, length = rng.integers(1, 9, len(hold)), rng.integers(20, 400, docs)
    row = topk._shard_bytes(hold[:, 1].astype(np.uint64), hold[:, 0], tf, length, np.arange(docs))
    known, idf = np.arange(1, 60, dtype=np.uint64), np.linspace(4, 0.1, 59)
    part = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[hold[:, 0]] / 120.0))
    impact = np.floor(idf[hold[:, 1] - 1] * part * 65536 + 0.5)
    queries = [np.arange(59), np.arange(3), np.arange(20, 59), np.arange(55, 59)]
    for common in (0, 5, 256):
        monkeypatch.setattr(topk, "COMMON", common)
        shard = topk.Shard(row, 120.0)
        at = shard.weigh(known, idf)
        own = [at[q][at[q] >= 0] for q in queries]
        assert len(shard.matrix) <= common and (at[50:] == -1).all()
        for q, here, scores in zip(queries, own, shard.common(own), strict=True):
            ids, got = shard.top(here, scores, 10, 0.0)
            whole = np.bincount(hold[:, 0], impact * np.isin(hold[:, 1] - 1, q), docs)
            want = [d for d in np.lexsort((np.arange(docs), -whole))[:10] if whole[d] > 0]
            assert ids.tolist() == want and got.tolist() == whole[want].tolist()
