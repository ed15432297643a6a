"""Language and quality models: held-out accuracy and odd rows."""

import random

import pytest

from rvpanel.llm import langid, mil_quality
from tests.llm.data import ODD, documents

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert 0.15 < len(held) / len(got) < 0.35
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert sum(r["rejected"] for r in got) / len(got) < 0.02


def test_language_odd_rows(spark):
    rng = random.Random(2)
    en = [" ".join(rng.choices(["the", "and", "thing", "which"], k=12)) for _ in range(30)]
    de = [" ".join(rng.choices(["der", "und", "schön", "für"], k=12)) for _ in range(30)]
    docs = documents(spark, [*en, *de, *ODD, en[0]], ["en"] * 30 + ["de"] * 30 + [None] * (len(ODD) + 1))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == 61 + len(ODD)
    for i, t in enumerate(ODD, 60):
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters)
        assert 0 <= got[i]["score"] <= 1 and (letters or got[i]["rejected"])
    assert got[60 + len(ODD)]["lang_pred"] == "en"
    assert {got[i]["lang_pred"] for i in range(30)} == {"en"} and {got[i]["lang_pred"] for i in range(30, 60)} == {"de"}


def test_language_without_labels(spark):
    docs = documents(spark, ["some words", None], [None, None])
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    got = mil_quality.rate_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r for r in got if r["quality"] == y] for y in (1, 0))
    assert sum(r["predicted"] for r in good) / len(good) > 0.97
    assert sum(not r["predicted"] for r in bad) / len(bad) > 0.9


def test_quality_odd_rows(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["calm", "river", "under", "stone", "light"], k=90)) for _ in range(40)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(["buy", "now", "cash"], k=90)) for _ in range(40)]
    docs = documents(spark, [*good, *bad, *ODD, good[0]])
    labels = spark.createDataFrame([(i, int(i < 40), 0, "x") for i in range(80)] + [(None, 1, 0, "x"), (85, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = {r["doc_id"]: r for r in mil_quality.rate_quality(docs, labels).collect()}
    assert len(got) == 81 + len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["predicted"] == 1 for i in range(40)) and all(got[i]["predicted"] == 0 for i in range(40, 80))
    assert got[0]["score"] == pytest.approx(got[80 + len(ODD)]["score"]) and got[80]["score"] == got[81]["score"]


def test_quality_without_labels(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in mil_quality.rate_quality(docs, none).collect()} == {0.5}
    assert mil_quality.rate_quality(docs.limit(0), none).count() == 0


def test_language_sample_is_small_on_the_driver(spark):
    docs = spark.createDataFrame([(i, "the same few words again", "en") for i in range(40)], "doc_id long, text string, lang string")
    found = langid._segments(docs, "lang", "text", "doc_id")
    words = [w for _, _, ws in found for w in ws]
    assert len({id(w) for w in words}) == len(set(words)) < len(words)  # equal words are one object
    bags = langid._bags([ws for _, _, ws in found])
    assert {b.dtype.str for b in bags} == {"<u2"}
    for (_, _, ws), bag in zip(found, bags, strict=True):
        assert bag.tolist() == [x for w in ws for x in langid.subwords([w])[0].tolist()]
