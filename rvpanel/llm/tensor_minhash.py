"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``HALVES`` half-keys (``ROWS`` minhashes each) are computed; a table key is a pair of
one half-key from each, so ``HALVES**2`` tables cost only ``2 * HALVES * ROWS`` minhashes.  Two
sets of similarity s share a table with probability (1 - (1 - s^ROWS)^HALVES)^2, 0.99998 at 0.85
with the defaults.  Since a pair of half-keys can only agree where each half agrees, documents that share no
first half-key with another drop out before any pair is formed.

Documents with equal sets are one class from the start.  Links between classes are confirmed on
full sets, and no link between classes that share a table is lost, without forming all pairs of a bucket:

1. A document with more than 15 % shingles that no other candidate has can reach no one: it drops out
   (exact, from one pre-aggregated count).
2. In every bucket all members are compared with one centre, the member with the smallest share of unique
   shingles.  Components of those links leave few strays, whose label is not the bucket's commonest.
3. Strays are compared with the members of other labels of their buckets, once per pair (in the first
   table they share) and only where a bound on the overlap allows the threshold.

Then every pair of one bucket is linked, in one component, or proven or measured to be below the threshold.

Edge cases: null texts and texts without words have an empty set and are linked with nothing, as are null
``doc_id`` (component null, kept).  With fewer than 5 words the whole sequence is the one shingle.
Repeated rows share their class.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rvpanel.llm import words as W
from rvpanel.llm.components import components
from rvpanel.llm.tasks import on_executors, text_slices
from rvpanel.sources.store import materialize

SHINGLE = 5
PERCENT = 85
HALVES = 12
ROWS = 3

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


_word_hash = W.Memo(32 << 20)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text (A-Z lower-cased, split at ASCII white space)."""
    lists = [t.lower().split() if t else [] for t in texts]
    W.claim("tensor_minhash", _word_hash)
    _word_hash.room()
    for w in W.missing(_word_hash, lists):
        _word_hash.put(w, xxhash.xxh64_intdigest(w), len(w))
    total = sum(map(len, lists))
    get = _word_hash.__getitem__
    flat = np.fromiter((h for ws in lists for h in map(get, ws)), np.uint64, total)
    if total >= size:
        rolled = flat[: total - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * _MIX[0] + flat[k : total - size + 1 + k]
        rolled = _mixed(rolled)
    out, at = [], 0
    for ws in lists:
        n = len(ws)
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            one = np.array([n], np.uint64) * _MIX[1]
            for h in flat[at : at + n]:
                one = one * _MIX[0] + h
            out.append(_mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def half_keys(sets: list[np.ndarray], halves: int = HALVES, rows: int = ROWS, seed: int = 11) -> np.ndarray:
    """(set, 2 x halves) keys of non-empty sets."""
    rng = np.random.default_rng(seed)
    salt = rng.integers(0, 1 << 32, 2 * halves * rows, dtype=np.uint32)
    odd = rng.integers(0, 1 << 31, 2 * halves * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.zeros((len(sets), 2 * halves), np.uint64)
    for k in range(2 * halves * rows):
        v = (flat ^ salt[k]) * odd[k]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        low = np.minimum.reduceat(v, starts).astype(np.uint64)
        keys[:, k // rows] = _mixed(keys[:, k // rows] * _MIX[0] + low + np.uint64(k + 1))
    return keys


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, class, a, b): set size, 128-bit hash of the set, half-keys of the two collections."""
    on_executors(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for start, texts in text_slices(batch):
                sets = shingle_sets(texts, size)
                on = [i for i, s in enumerate(sets) if len(s)]
                keys = _signed(half_keys([sets[i] for i in on], halves, rows)) if on else np.zeros((0, 2 * halves), np.int64)
                place = {i: j for j, i in enumerate(on)}
                none = np.zeros(0, np.int64)
                ids = batch.column(0).slice(start, len(texts))
                yield pa.record_batch(
                    {
                        "doc_id": ids.cast(pa.int64()),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "class": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        "a": pa.array([keys[place[i], :halves] if i in place else none for i in range(len(sets))], pa.list_(pa.int64())),
                        "b": pa.array([keys[place[i], halves:] if i in place else none for i in range(len(sets))], pa.list_(pa.int64())),
                    }
                )

    schema = "doc_id long, n long, class binary, a array<long>, b array<long>"
    return docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(run, schema)


def _sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(rep, class, n, s) of documents: their full sets."""

    def run(batches):
        for batch in batches:
            for start, texts in text_slices(batch):
                sets = shingle_sets(texts, size)
                yield pa.record_batch(
                    {
                        "rep": batch.column(0).slice(start, len(texts)),
                        "class": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "s": pa.array([_signed(s) for s in sets], pa.list_(pa.int64())),
                    }
                )

    return docs.mapInArrow(run, "rep long, class binary, n long, s array<long>")


def _enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return overlap * 100 >= (n + m - overlap) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(x, y)`` of representatives those whose full sets reach the threshold, as edges (a, b)."""
    left = sets.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("s").alias("sx"))
    right = sets.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("s").alias("sy"))
    joined = pairs.select("x", "y").join(left, "x").join(right, "y")
    overlap = F.size(F.array_intersect("sx", "sy"))
    return joined.where(_enough(overlap, F.col("nx"), F.col("ny"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE, halves: int = HALVES, rows: int = ROWS
) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    marked = materialize(signatures(docs, id_col, text, size, halves, rows))
    real = marked.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(real.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")))

    # Classes that share a first half-key with another, with those keys.
    firsts = classes.select("class", F.posexplode("a").alias("i", "ka"))
    shared = firsts.groupBy("i", "ka").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    halved = firsts.join(shared, ["i", "ka"]).join(classes.select("class", "rep", "b"), "class")
    tables = halved.select("class", "rep", "i", "ka", F.posexplode("b").alias("j", "kb"))
    members = tables.select("class", "rep", (F.col("i") * halves + F.col("j")).alias("table"), F.xxhash64("i", "j", "ka", "kb").alias("key"))
    members = materialize(members)
    repeated = members.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    members = materialize(members.join(repeated, "key"))

    # Full sets of the candidates, read from their texts once more.
    wanted = members.select("rep", "class").distinct()
    reps = wanted.select(F.col("rep").alias(id_col)).distinct()
    texts = docs.select(id_col, F.col(text).alias("text")).join(reps, id_col, "left_semi")
    full = _sets_of(texts.select(F.col(id_col).cast("long").alias("rep"), "text"), size)
    sets = materialize(full.join(wanted, ["rep", "class"], "left_semi").dropDuplicates(["rep", "class"]))

    # Shingles that one candidate alone holds.
    owners = sets.select("rep", F.explode("s").alias("g")).groupBy("g").agg(F.min("rep").alias("rep"), F.max("rep").alias("most"))
    unique = owners.where("rep = most").groupBy("rep").agg(F.count("*").alias("u"))
    sized = sets.select("rep", "n").join(unique, "rep", "left").select("rep", "n", F.coalesce("u", F.lit(0)).alias("u"))
    alive = materialize(sized.where((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent))
    members = members.join(alive, "rep")
    bucket = members.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "rep")).alias("c"))
    bucket = bucket.where("k > 1").select("key", F.col("c.rep").alias("centre"))
    members = materialize(members.join(bucket, "key"))

    spokes = members.where("rep <> centre").select(F.col("centre").alias("x"), F.col("rep").alias("y")).distinct()
    edges = materialize(_confirmed(spokes, sets, percent))
    found = components(edges)

    labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component", "centre")
    labelled = materialize(labelled)
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("k"))
    common = counts.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("k", "label")).alias("c"))
    common = common.where("labels > 1").select("key", F.col("c.label").alias("common"))
    mixed = labelled.join(common, "key").join(classes.select("class", "a", "b"), "class")
    mixed = materialize(mixed.select("key", "table", "rep", "n", "u", "label", "common", "a", "b"))
    s = mixed.where("label <> common").select(*[F.col(c).alias(f"s_{c}") for c in mixed.columns])
    m = mixed.select(*[F.col(c).alias(f"m_{c}") for c in mixed.columns])
    most = F.least(F.col("s_n") - F.col("s_u"), F.col("m_n") - F.col("m_u"))
    first_table = F.lit(True)
    for k in range(halves):
        first_table &= ~((F.col("s_table") >= (k + 1) * halves) & (F.col("s_a")[k] == F.col("m_a")[k]))
        first_table &= ~((F.col("s_table") % halves > k) & (F.col("s_b")[k] == F.col("m_b")[k]))
    pairs = s.join(
        m,
        (F.col("s_key") == F.col("m_key"))
        & (F.col("s_label") != F.col("m_label"))
        & ((F.col("m_label") == F.col("m_common")) | (F.col("s_rep") < F.col("m_rep")))
        & _enough(most, F.col("s_n"), F.col("m_n"), percent)
        & first_table,
    ).select(F.col("s_rep").alias("x"), F.col("m_rep").alias("y"))
    # Strays are few: their links join the components found so far, not all edges again.
    rest = materialize(_confirmed(pairs.distinct(), sets, percent))
    labels = found.select(F.col("node").alias("n_"), F.col("component").alias("c_"))
    for column in ("a", "b"):
        rest = rest.join(labels, F.col(column) == F.col("n_"), "left").withColumn(column, F.coalesce("c_", column)).drop("n_", "c_")
    more = components(rest)
    whole = found.join(more.select(F.col("node").alias("component"), F.col("component").alias("final")), "component", "left")
    whole = whole.select("node", F.coalesce("final", "component").alias("component"))
    alone = more.join(found.select("node"), "node", "left_anti").select("node", "component")
    whole = materialize(whole.unionByName(alone))

    named = classes.select("class", "rep").join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("class", F.coalesce("component", "rep").alias("component_id"))
    out = marked.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    # Rows without a class go round the join, so that they do not meet in one task.
    linked = out.where("class IS NOT NULL").join(named, "class").select(id_col, "n_shingles", "component_id")
    apart = out.where("class IS NULL").select(id_col, "n_shingles", F.col(id_col).alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
