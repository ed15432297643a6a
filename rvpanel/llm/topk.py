"""Exact BM25 top-k search: inverted shards with block-max WAND pruning, merged exactly.

Documents are indexed in shards of ``SHARD_DOCS``: sorted vocabulary (64-bit hashes of words), postings with term
frequencies, document lengths.  Document frequencies, the number of documents and their mean length are summed over
all shards, so a score does not depend on the shard.  Queries meet the shards in blocks of about ``QUERIES``.

In a shard, impacts of the up to ``COMMON`` terms that stand in most documents are added up by a matrix product, for all
documents and ``TOGETHER`` queries at once: their block maxima would bound nothing.  Of the other terms, postings are grouped
in blocks of ``BLOCK`` documents and every (term, block) has its largest impact.  The sum of a query's block maxima and the
block's largest sum of common terms bounds every score in the block, the condition by which block-max WAND skips: the best blocks are
scored first, and of the rest only those whose bound reaches the k-th score so far (from all shards the task has seen).
Each shard gives its k best; the k best of these are the result, ties by smaller ``doc_id``.

Score: sum over the query's distinct words of ``idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))``, each
term rounded to a multiple of 1/65536 (half up) so that sums are exact in any order;
``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``.  A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z lower-cased.

Edge cases: null and empty texts are documents of length 0 and match nothing; queries without words have no rows; rows of
one query id are one query of all their words; repeated documents are ranked each; documents that share no word with
the query are not listed, so a query may have fewer than k rows; a null ``doc_id`` comes last among ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rvpanel.llm import words as W
from rvpanel.llm.tasks import on_executors, sent, text_slices
from rvpanel.sources.store import materialize

K1, B = 1.2, 0.75
SHARD_DOCS = 8192
SHARD_BYTES = 32 << 20
BLOCK = 128
QUERIES = 4096
#: Terms of a shard whose impacts are added up as a matrix product, at most; each in one of so many documents at least.
COMMON, COMMON_SHARE = 256, 32
#: Queries that meet the matrix together.
TOGETHER = 64
_UNIT = 65536
_NULL_ID = np.iinfo(np.int64).max

_LETTERS = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))
_memo = W.Memo(48 << 20)


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    lists = [t.translate(_LETTERS).split() if t else [] for t in texts]
    W.claim("topk", _memo)
    _memo.room()
    for w in W.missing(_memo, lists):
        _memo.put(w, xxhash.xxh64_intdigest(w), len(w))
    get = _memo.__getitem__
    return [np.fromiter(map(get, ws), np.uint64, len(ws)) for ws in lists]


def _shard_bytes(terms: np.ndarray, docs: np.ndarray, tf: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> dict:
    order = np.lexsort((docs, terms))
    terms, docs, tf = terms[order], docs[order], tf[order]
    vocabulary, first = np.unique(terms, return_index=True)
    return {
        "docs": len(ids),
        "words": int(lengths.sum()),
        "vocabulary": vocabulary.astype("<u8").tobytes(),
        "first": np.append(first, len(terms)).astype("<u4").tobytes(),
        "doc": docs.astype("<u2").tobytes(),
        "tf": tf.astype("<u4").tobytes(),
        "length": lengths.astype("<u4").tobytes(),
        "ids": ids.astype("<i8").tobytes(),
    }


_SHARD = "docs long, words long, vocabulary binary, first binary, doc binary, tf binary, length binary, ids binary"


def build_shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard of the documents, stored."""
    if SHARD_DOCS > 1 << 16:
        raise ValueError("documents of a shard are numbered by 16 bits")
    on_executors(docs.sparkSession)

    def run(batches):
        terms, at, tf, lengths, ids, held = [], [], [], [], [], 0

        def row():
            nonlocal held
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            made = _shard_bytes(join(terms, np.uint64), join(at, np.int64), join(tf, np.int64), np.array(lengths, np.int64), np.array(ids, np.int64))
            for part in (terms, at, tf, lengths, ids):
                part.clear()
            held = 0
            return pa.RecordBatch.from_pylist([made], schema=_arrow_schema())

        for batch in batches:
            own = batch.column(0).to_pylist()
            for start, texts in text_slices(batch):
                for i, hashes in enumerate(word_hashes(texts), start):
                    distinct, counts = np.unique(hashes, return_counts=True)
                    terms.append(distinct)
                    at.append(np.full(len(distinct), len(ids), np.int64))
                    tf.append(counts)
                    lengths.append(len(hashes))
                    ids.append(_NULL_ID if own[i] is None else own[i])
                    held += 8 * len(distinct)
                    if len(ids) >= SHARD_DOCS or held >= SHARD_BYTES:
                        yield row()
        if ids:
            yield row()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(given.mapInArrow(run, _SHARD))


def _arrow_schema() -> pa.Schema:
    return pa.schema([(n, pa.int64() if k == "long" else pa.binary()) for n, k in (x.split() for x in _SHARD.split(", "))])


def document_frequencies(shards: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches):
        for batch in batches:
            for v, f in zip(batch.column(0), batch.column(1), strict=True):
                df = np.diff(np.frombuffer(f.as_buffer(), "<u4").astype(np.int64))
                yield pa.record_batch({"term": pa.array(np.frombuffer(v.as_buffer(), "<i8"), pa.int64()), "df": pa.array(df, pa.int64())})

    return shards.select("vocabulary", "first").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame, frequencies: DataFrame, n_docs: int, id_col: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, terms binary, idf binary) of the queries' distinct words that some document holds."""

    def run(batches):
        for batch in batches:
            for start, texts in text_slices(batch):
                found = [np.unique(h) for h in word_hashes(texts)]
                ids = batch.column(0).slice(start, len(texts)).take(pa.array(np.repeat(np.arange(len(texts)), [len(f) for f in found])))
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.record_batch({"query_id": ids, "term": pa.array(flat, pa.int64())})

    given = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(text).alias("text")).where("query_id IS NOT NULL")
    each = given.mapInArrow(run, "query_id long, term long").distinct().join(frequencies, "term")
    idf = F.log(1.0 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    listed = each.select("query_id", "term", idf.alias("idf")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("t"))
    return listed.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indexes of the ranges [first, last), and the range of each."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes), owner


class Shard:
    def __init__(self, row: dict, mean: float):
        self.vocabulary = np.frombuffer(row["vocabulary"], "<i8").view(np.uint64)
        first = np.frombuffer(row["first"], "<u4").astype(np.int64)
        self.doc = np.frombuffer(row["doc"], "<u2").astype(np.int32)
        tf = np.frombuffer(row["tf"], "<u4").astype(np.float64)
        length = np.frombuffer(row["length"], "<u4").astype(np.float64)
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / mean)) if len(tf) else tf
        self.block, self.blocks = BLOCK, -(-len(self.ids) // BLOCK)
        # (term, block) pairs: where their postings begin, and their largest impact.
        term = np.repeat(np.arange(len(self.vocabulary)), np.diff(first))
        block = self.doc // BLOCK
        new = np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        self.pair_first = np.append(begin, len(term))
        self.pair_block = block[begin]
        self.pair_most = np.maximum.reduceat(self.part, begin) if len(begin) else np.zeros(0)
        self.term_first = np.searchsorted(begin, first)

    def weigh(self, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Impacts of all postings of the terms (distinct, ascending), and the matrix of the commonest; the place of each
        term in the vocabulary, -1 where the shard lacks it."""
        n, sizes = len(self.vocabulary), np.diff(self.pair_first[self.term_first])
        if not n or not len(terms):
            return np.full(len(terms), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), n - 1)
        here = self.vocabulary[at] == terms
        weight = np.zeros(n)
        weight[at[here]] = idf[here]
        self.impact = _units(np.repeat(weight, sizes), self.part)
        self.pair_impact = _units(np.repeat(weight, np.diff(self.term_first)), self.pair_most)
        often = np.flatnonzero((sizes * COMMON_SHARE >= len(self.ids)) & (weight > 0))
        often = often[np.argsort(-sizes[often], kind="stable")[:COMMON]]
        self.row = np.full(n, -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), len(self.ids)))
        for i, t in enumerate(often.tolist()):
            mine = slice(self.pair_first[self.term_first[t]], self.pair_first[self.term_first[t + 1]])
            self.matrix[i, self.doc[mine]] = self.impact[mine]
        return np.where(here, at, -1)

    def common(self, queries: list[np.ndarray]) -> np.ndarray:
        """What the commonest terms add to the score of each document, for queries given by places in the vocabulary."""
        holds = np.zeros((len(queries), len(self.matrix)))
        for i, at in enumerate(queries):
            rows = self.row[at]
            holds[i, rows[rows >= 0]] = 1
        # Sums of whole numbers below 2**53: exact in any order.
        return holds @ self.matrix

    def top(self, at: np.ndarray, scores: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores in units) of the k best documents of a query; those below ``floor`` may be left out.  ``scores`` has what
        the commonest of its terms add; the others are met block by block, where the bound allows."""
        at = at[self.row[at] < 0]
        pairs, _ = _spread(self.term_first[at], self.term_first[at + 1])
        block = self.pair_block[pairs]
        bound = np.bincount(block, self.pair_impact[pairs], self.blocks) + np.maximum.reduceat(scores, np.arange(0, len(scores), self.block))
        order = np.argsort(-bound, kind="stable")
        for blocks in (order[:2], order[2:]):
            wanted = np.zeros(self.blocks, bool)
            wanted[blocks[(bound[blocks] >= floor) & (bound[blocks] > 0)]] = True
            if not wanted.any():
                continue
            met = pairs[wanted[block]]
            posts, _ = _spread(self.pair_first[met], self.pair_first[met + 1])
            # Impacts are whole numbers, so the order of additions does not matter.
            scores = scores + np.bincount(self.doc[posts], self.impact[posts], len(scores))
            if len(scores) > k:
                floor = max(floor, float(np.partition(scores, -k)[-k]))
        # Documents of blocks that were left out have at most their bound, which is below the floor.
        listed = np.flatnonzero((scores > 0) & (scores >= floor))
        rank = np.lexsort((self.ids[listed], -scores[listed]))[:k]
        return self.ids[listed[rank]], scores[listed[rank]]

    def best(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`top` of one query alone."""
        at = self.weigh(terms, idf)
        at = at[at >= 0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        return self.top(at, self.common([at])[0], k, floor)


def _units(weight: np.ndarray, part: np.ndarray) -> np.ndarray:
    """``floor(weight * part * _UNIT + 0.5)``, in the place of ``weight``."""
    weight *= part
    weight *= _UNIT
    weight += 0.5
    return np.floor(weight, out=weight)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score`` of the k best documents of every query."""
    spark = docs.sparkSession
    shards = build_shards(docs, id_col, text)
    total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()
    mean = total["w"] / total["n"] if total["w"] else 1.0
    listed = materialize(query_terms(queries, document_frequencies(shards), total["n"], query_id, query_text))
    blocks = max(1, -(-listed.count() // QUERIES))
    found = None
    for b in range(blocks):
        mine = (listed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else listed).toArrow()
        rows = [
            (q, np.array(t, np.int64).view(np.uint64), np.array(i, np.float64))
            for q, t, i in zip(mine.column(0).to_pylist(), mine.column(1).to_numpy(), mine.column(2).to_numpy(), strict=True)
        ]
        # Signed and unsigned orders differ: terms are looked up in unsigned order.
        rows = [(q, t[o], i[o]) for q, t, i in rows for o in (np.argsort(t),)]
        part = _block(shards, sent(spark, rows), mean, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("units"), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    doc = F.when(F.col("doc") != int(_NULL_ID), F.col("doc"))
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), doc.alias("doc_id"), (F.col("units") / float(_UNIT)).alias("score"))


def _block(shards: DataFrame, shipped, mean: float, k: int) -> DataFrame:
    """The k best of each query in each shard, for one block of queries."""

    def run(batches):
        rows = shipped.value
        tops = [np.zeros(0) for _ in rows]
        terms, first, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for _, t, _ in rows)]), return_index=True, return_inverse=True)
        idf = np.concatenate([np.zeros(0), *(i for _, _, i in rows)])[first]
        place = np.split(place.astype(np.int32), np.cumsum([len(t) for _, t, _ in rows])[:-1])
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({n: batch.column(j)[i].as_buffer() for j, n in enumerate(batch.schema.names)}, mean)
                at = shard.weigh(terms, idf)
                q_out, d_out, s_out = [], [], []
                for start in range(0, len(rows), TOGETHER):
                    own = [a[a >= 0] for a in (at[p] for p in place[start : start + TOGETHER])]
                    if not any(map(len, own)):
                        continue
                    for j, (here, scores) in enumerate(zip(own, shard.common(own), strict=True), start):
                        if not len(here):
                            continue
                        floor = float(tops[j][-1]) if len(tops[j]) == k else 0.0
                        ids, scores = shard.top(here, scores, k, floor)
                        if len(ids):
                            q_out.append(np.full(len(ids), rows[j][0], np.int64))
                            d_out.append(ids)
                            s_out.append(scores)
                            tops[j] = np.sort(np.concatenate([tops[j], scores]))[::-1][:k]
                join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
                yield pa.record_batch(
                    {
                        "query_id": pa.array(join(q_out, np.int64), pa.int64()),
                        "doc": pa.array(join(d_out, np.int64), pa.int64()),
                        "units": pa.array(join(s_out, np.float64), pa.float64()),
                    }
                )

    return shards.select("vocabulary", "first", "doc", "tf", "length", "ids").mapInArrow(run, "query_id long, doc long, units double")
