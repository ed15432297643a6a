"""A corpus pipeline of five stages; each works on all that the stage before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame with the columns of ``documents``, the last one
its own.  Decisions take effect: rejected languages, near-duplicates and leaked documents go, repeated strings
are cut out of texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rvpanel.llm import langid, latent_decontam, suffix_dedup, tensor_minhash, transducer
from rvpanel.sources.store import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on the labelled ones, does not reject; ``lang`` is
    filled in where it was null."""
    found = langid.predict(docs, langid.train(docs), keep=COLUMNS[1:])
    kept = found.where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; null ids come last.  Rows are told apart by a
    stored number, so that rows which repeat an id, or have none, go only as near-duplicates."""
    rows = materialize(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    found = tensor_minhash.near_duplicates(rows, "row").select("row", "component_id")
    # Of equal ids the row to stay is told by its content, not by the order of tasks.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS[1:]).alias("content"), "row")
    first = found.join(rows.select("row", rank.alias("rank")), "row").groupBy("component_id").agg(F.min("rank").alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur elsewhere; documents stay, with what is left."""
    found = suffix_dedup.remove_repeats(docs, keep=["doc_id", "lang", "source"], texts_out=True)
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  A leak lies in the text alone, so the text's hash stands for the rows
    that hold it, whatever their ids; null texts hold none."""
    keyed = docs.select(COLUMNS).withColumn("key", F.sha2("text", 256))
    leaks = latent_decontam.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    return keyed.join(leaks.select("key").distinct(), "key", "left_anti").select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document that is left."""
    path = public_tokenizers.path(TOKENIZER)
    return transducer.encode_decode(docs, path, transducer.build_lexicon(docs, path))


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_near_duplicates),
    ("repeated strings", without_repeats),
    ("benchmark leaks", without_leaks),
    ("encoding", encoded),
]

#: Training, latent search and byte-level removal have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
