"""The corpus pipeline, stage by stage against brute force, and the registered queries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from rvpanel.llm import langid, latent_decontam
from rvpanel.llm import words as W
from rvpanel.llm.queries import LLM_QUERIES
from tests.llm.data import ODD, documents, prose
from tests.llm.test_matching import brute_components, brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest documents with odd rows and a column of a clashing name."""
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(ODD)], docs.schema)
    docs.unionByName(odd).selectExpr("*", "1 AS class").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = rows_of(docs)
    stages = dict(corpus_pipeline.STAGES)

    model = langid.train(docs)
    kept = {}
    for i, r in given.items():
        words = langid.words_of(None if r["text"] is None else r["text"].encode())
        if langid.has_letter(words):
            bucket, _ = langid.subwords(words)
            p = model.scores(model.logits[bucket].sum(axis=0)[None, :].astype(float), np.array([len(bucket)]))[0]
            if p.max() >= model.threshold:
                kept[i] = (r["text"], r["lang"] or model.labels[int(p.argmax())])
    out = stages["language"](spark, docs, sf_dir).cache()
    assert out.columns == corpus_pipeline.COLUMNS
    assert {i: (r["text"], r["lang"]) for i, r in rows_of(out).items()} == kept
    assert len(kept) > 190

    found = brute_components([t for t, _ in kept.values()], list(kept))
    singles = {i: kept[i][0] for i, _, _, first in found if first}
    out = stages["near duplicates"](spark, out, sf_dir).cache()
    assert {i: r["text"] for i, r in rows_of(out).items()} == singles

    cut = {}
    for (i, t), (*_, gone) in zip(singles.items(), brute_repeats(singles.values(), 200), strict=True):
        at, left = 0, []
        for c in t:
            n = len(c.encode())
            if not gone[at : at + n].all():
                left.append(c)
            at += n
        cut[i] = "".join(left)
    out = stages["repeated strings"](spark, out, sf_dir).cache()
    assert {i: (r["text"], r["n_chars"]) for i, r in rows_of(out).items()} == {i: (t, len(t)) for i, t in cut.items()}

    items = [latent_decontam.word_ids([r["text"].encode()])[0].tolist() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {}
    for i, t in cut.items():
        words = latent_decontam.word_ids([t.encode()])[0].tolist()
        leak = False
        for item in items:
            answer = item[-max(3, len(item) // 4) :]
            for s in range(0, len(words), latent_decontam.HALF):
                region = words[max(0, s - len(item)) : s + latent_decontam.PASSAGE + len(item)]
                if latent_decontam.lcs(item, region) >= latent_decontam.LCS * len(item) and latent_decontam.lcs(answer, region) >= latent_decontam.ANSWER * len(answer):
                    leak = True
        if not leak:
            clean[i] = t
    out = stages["benchmark leaks"](spark, out, sf_dir).cache()
    assert {i: r["text"] for i, r in rows_of(out).items()} == clean
    assert len(clean) < len(cut)

    known = W.tokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = set()
    for i, t in clean.items():
        ids = known.encode(t, add_special_tokens=False).ids
        shown = known.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), shown))))
    assert {tuple(r) for r in stages["encoding"](spark, out, sf_dir).collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_near_duplicates_with_repeated_and_null_ids(spark):
    """Only near-duplicates go: neither another text of the same id nor copies without an id stay or go by their id."""
    rng = random.Random(34)
    a, b, c, d = (" ".join(prose(rng, 80)) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, b), (3, d), (None, d), (3, d)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).repartition(4)
    out = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (3, d)], key=str)


def test_leaks_with_repeated_and_null_ids(spark, sf_dir):
    """Leaking rows go without an id, too, and clean ones of the same id stay."""
    rng = random.Random(35)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    leak, clean, other = (" ".join([*prose(rng, 40), *extra, *prose(rng, 40)]) for extra in ([item], [], []))
    rows = [(None, leak), (None, clean), (1, leak), (1, other), (2, clean), (3, None)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows]).repartition(3)
    out = corpus_pipeline.without_leaks(spark, docs, sf_dir)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(None, clean), (1, other), (2, clean), (3, None)], key=str)


def test_stages_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


def test_registered():
    assert set(LLM_QUERIES) <= set(queries()) and "pipeline" in queries()
    assert {int(n[2:].split("_")[0]) for n in LLM_QUERIES} == set(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
