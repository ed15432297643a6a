"""Benchmark decontamination by latent semantic retrieval.

1. Texts become word ids (32-bit hashes of lower-cased words without ASCII marks), stored once.
2. Document frequencies of hashed words are counted over all passages of ``PASSAGE`` words.  The ``FEATURES`` most
   frequent words make TF-IDF vectors.  No word is dropped for being common, as a group of copies can make it so; ``FLOOR``
   is the least weight.
3. Distributed randomised SVD: every task adds up A'(A G) of its passages (``LONG`` words) for a seeded Gaussian G,
   tasks are added by block of rows, and the small matrices (``FEATURES`` x ``RANK``, a fixed size) give the right singular vectors
   on the driver, by the one-pass Nystrom form.
4. Cosine search: passages of ``PASSAGE`` words overlapping by half, projected on the singular vectors, against the benchmark items, a block
   of at most ``ITEMS`` at a time.  All passages meet all items as matrix products; only hits leave them.
   Items of fewer than ``SHORT`` words are also held against passages of ``HALF`` words, where neighbours dilute them less,
   with the lower ``SHORT_COSINE``.  Whatever the cosine, a place is a candidate if it holds as many pairs of
   neighbouring words of the item as stay when words are replaced or left out up to the limit of ``LCS`` (each breaks
   two pairs).  So no such copy is lost, however common its words are.
5. A hit is confirmed on words: the longest common subsequence of item and region must reach ``LCS`` of the item,
   and that of its answer (the last quarter of the item) ``ANSWER`` of the answer.  So paraphrases
   that keep most words in order are found, and texts on the same subject are left alone.

Edge cases: null and empty texts match nothing; of items of fewer than ``SHORTEST`` words all words must stand in a row, and
one word alone is no passage and matches nothing; repeated documents and items give a row each; a null id is carried as it is; no item or no document: no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.llm import words as W
from rvpanel.llm.tasks import on_executors, sent, text_slices
from rvpanel.sources.store import materialize, release

HASHED = 1 << 14
FEATURES = 2048
RANK = 128
#: Added to the IDF, so that words of all passages count a little.
FLOOR = 0.1
#: Words of a passage of the matrix that is decomposed.
LONG = 128
HALF = 16
QUARTER = HALF // 2
PASSAGE = 2 * HALF
ITEMS = 2048
SHORTEST = 8
COSINE = 0.4
#: Items of fewer words are looked for in passages of ``HALF`` words, too.
SHORT = 24
SHORT_COSINE = 0.3
LCS = 0.65
ANSWER = 0.5
_BLOCKS = 32

_MARKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
class _Hashes(W.Memo):
    """Hashes of words, computed when a word is first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh32_intdigest(word)
        self.put(word, found, len(word))
        return found


_memo = _Hashes(48 << 20)


def word_ids(texts: list[bytes | None]) -> list[np.ndarray]:
    """uint32 id of each word of each text."""
    W.claim("latent_decontam", _memo)
    _memo.room()
    get, out = _memo.__getitem__, []
    for t in texts:
        ws = t.lower().translate(_MARKS).split() if t else []
        out.append(np.fromiter(map(get, ws), np.uint32, len(ws)))
    return out


def lcs(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of the item."""
    return _lcs(len(item), list(filter(None, map(_masks(item).get, region))))


def _masks(item: list[int]) -> dict[int, int]:
    """Places of each word of the item, as bits."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _lcs(n: int, masks: list[int]) -> int:
    full = (1 << n) - 1
    v = full
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _starts(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of ``step`` words in the joined texts, and its text (texts of 0 words have none)."""
    runs = -(-sizes // step)
    owner = np.repeat(np.arange(len(sizes)), runs)
    first = np.cumsum(sizes) - sizes
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    return first[owner] + inside * step, owner


def stage(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary): word ids of each text."""
    return staged_rows(stage_counted(docs, id_col, text))


def staged_rows(counted: DataFrame) -> DataFrame:
    return counted.where("ids IS NOT NULL").select("doc_id", "ids")


def stage_counted(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, df binary): word ids of each text, and a last row a task without ids that holds in how many of its
    passages each hashed word stands, and the number of passages."""
    on_executors(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    arrow = docs.select(F.col(id_col).alias("doc_id")).limit(0).toArrow().schema.field("doc_id").type

    def run(batches):
        df = np.zeros(HASHED + 1, np.int64)
        for batch in batches:
            out = []
            for _, texts in text_slices(batch):
                rows = word_ids(texts)
                _count_passages(rows, df)
                out += [ids.tobytes() for ids in rows]
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(out, pa.binary()), "df": pa.nulls(len(out), pa.binary())})
        yield pa.record_batch({"doc_id": pa.nulls(1, arrow), "ids": pa.nulls(1, pa.binary()), "df": pa.array([df.tobytes()], pa.binary())})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, df binary")


def _count_passages(rows: list[np.ndarray], df: np.ndarray) -> None:
    """Add to ``df`` the passages each hashed word stands in, and at its end their number."""
    passages = _side_by_side(rows, PASSAGE).astype(np.uint16)
    if len(passages):
        passages.sort(axis=1)
        new = np.ones(passages.shape, bool)
        new[:, 1:] = passages[:, 1:] != passages[:, :-1]
        df[:-1] += np.bincount(passages[new], minlength=HASHED + 1)[:HASHED]
        df[-1] += len(passages)


def _side_by_side(rows: list[np.ndarray], step: int) -> np.ndarray:
    """Features of each run of ``step`` words of each text as a row; behind a text's end stands ``HASHED``."""
    sizes = np.array([len(r) for r in rows], np.int64)
    runs = -(-sizes // step)
    out = np.full(runs.sum() * step, HASHED, np.int64)
    first = np.cumsum(sizes) - sizes
    if len(out):
        at = np.arange(sizes.sum()) + np.repeat((np.cumsum(runs) - runs) * step - first, sizes)
        out[at] = np.concatenate(rows) & np.uint32(HASHED - 1)
    return out.reshape(-1, step)


def _slices(column, words: int = 20_000):
    """(first row, ids of each row) of rows of about so many words together."""
    rows, held, start = [], 0, 0
    for i, raw in enumerate(column):
        ids = np.frombuffer(raw.as_buffer(), np.uint32)
        rows.append(ids)
        held += len(ids)
        if held >= words:
            yield start, rows
            rows, held, start = [], 0, i + 1
    if rows:
        yield start, rows


def inverse_frequencies(counted: DataFrame) -> np.ndarray:
    """IDF of each feature over all passages, from the vectors that the tasks counted, added by feature."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                df = np.frombuffer(raw.as_buffer(), np.int64)
                seen = np.flatnonzero(df)
                yield pa.record_batch({"f": pa.array(seen, pa.int32()), "n": pa.array(df[seen], pa.int64())})

    sums = counted.select("df").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    counts = {r["f"]: r["n"] for r in sums.collect()}
    total = counts.pop(HASHED, 0)
    df = np.zeros(HASHED)
    df[list(counts)] = list(counts.values())
    return np.log((total + 1) / (df + 1)).clip(0.0)


class Vocabulary:
    """The ``FEATURES`` most frequent features, and their weights."""

    def __init__(self, idf: np.ndarray):
        kept = np.argsort(idf, kind="stable")[:FEATURES]
        self.kept = kept
        self.place = np.full(HASHED, -1, np.int32)
        self.place[kept] = np.arange(len(kept))
        self.weight = (idf[kept] + FLOOR).astype(np.float32)
        self.rank = min(RANK, len(kept))

    def gaussian(self) -> np.ndarray:
        return np.random.default_rng(20).standard_normal((len(self.kept), self.rank)).astype(np.float32)


def singular_vectors(staged: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (features x rank) and singular values of the passage matrix."""
    shipped = sent(staged.sparkSession, idf)

    def run(batches):
        known = Vocabulary(shipped.value)
        gauss, m = known.gaussian(), len(known.kept)
        total = np.zeros((m, known.rank), np.float32)
        for batch in batches:
            for _, rows in _slices(batch.column(0), 32_768):
                starts, _ = _starts(np.array([len(r) for r in rows]), LONG)
                if not len(starts):
                    continue
                f = known.place[np.concatenate(rows) & np.uint32(HASHED - 1)]
                owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(f))))
                on = f >= 0
                for b in range(0, len(starts), 1024):  # texts of a word or two give many passages
                    mine = on & (owner >= b) & (owner < b + 1024) if len(starts) > 1024 else on
                    n = min(1024, len(starts) - b)
                    a = np.bincount((owner[mine] - b) * m + f[mine], known.weight[f[mine]], n * m).astype(np.float32).reshape(n, m)
                    a = _unit(a)
                    total += a.T @ (a @ gauss)
        parts = np.array_split(total, _BLOCKS)
        yield pa.record_batch({"block": pa.array(range(_BLOCKS), pa.int32()), "part": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table.column("part"))
        return pa.table({"block": table.column("block")[:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    known = Vocabulary(idf)
    if not len(known.kept):
        return np.zeros((0, 0), np.float32), np.zeros(0)
    # Two levels of sums: tasks by block and a salt, then the few sums of a block.
    each = staged.select("ids").mapInArrow(run, "block int, part binary").withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(16)).cast("int"))
    once = each.groupBy("block", "salt").applyInArrow(add, "block int, part binary")
    rows = once.groupBy("block").applyInArrow(add, "block int, part binary").collect()
    b = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(rows, key=lambda r: r["block"])] or [np.zeros(len(known.kept) * known.rank)])
    b = b.reshape(len(known.kept), known.rank).astype(np.float64)
    if not b.any():
        return np.zeros(b.shape, np.float32), np.zeros(known.rank)
    q, _ = np.linalg.qr(b)
    inner = (q.T @ b) @ np.linalg.pinv(q.T @ known.gaussian())
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-values)
    return (q @ turn[:, best]).astype(np.float32), np.sqrt(values[best].clip(0))


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each word and the next one."""
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[1:]


class Items:
    """A block of benchmark items: words, latent vectors of their passages, and pairs of words."""

    def __init__(self, rows: list[tuple[object, bytes | None]], idf: np.ndarray, vectors: np.ndarray, values: np.ndarray):
        known = Vocabulary(idf)
        # Directions count alike, whatever their singular values: else common words decide.
        self.weighted = np.zeros((HASHED + 1, vectors.shape[1]), np.float32)
        if values.any():
            self.weighted[known.kept] = known.weight[:, None] * vectors / np.maximum(values, 0.02 * values[0])[None, :]
        self.ids, self.words, owner, made = [], [], [], []
        for item, ids in zip([i for i, _ in rows], word_ids([t for _, t in rows]), strict=True):
            if len(ids) < 2:
                continue
            self.ids.append(item)
            self.words.append(ids.tolist())
            # Long items are looked for by each of their passages.
            for s in range(0, max(1, len(ids) - PASSAGE + 1), PASSAGE) if len(ids) > 2 * PASSAGE else (0,):
                part = ids[s : s + PASSAGE] if len(ids) > 2 * PASSAGE else ids
                made.append(self.weighted[part & np.uint32(HASHED - 1)].sum(axis=0))
                owner.append(len(self.ids) - 1)
        self.owner = np.array(owner, np.int64)
        self.matrix = _unit(np.array(made, np.float32).reshape(len(made), vectors.shape[1]))
        self.masks = [_masks(ws) for ws in self.words]
        self.short = np.array([k for k, i in enumerate(self.owner.tolist()) if len(self.words[i]) < SHORT], np.int64)
        pairs = [np.unique(_pairs(np.array(ws, np.uint32))) for ws in self.words]
        hashes = np.concatenate([*pairs, np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.pairs, self.pair_item = hashes[order], np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.pairs >> np.uint64(44)] = True
        self.sizes = np.array([len(ws) for ws in self.words], np.int64)
        self.least = np.maximum(2, self.sizes - 1 - 2 * (self.sizes - np.ceil(LCS * self.sizes - 1e-9).astype(np.int64)))
        brief = self.sizes < SHORTEST
        self.least[brief] = self.sizes[brief] - 1

    def copied(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, text, item) where enough pairs of an item start within its length, of texts joined from ``first`` on."""
        h = _pairs(words)
        at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        low, high = np.searchsorted(self.pairs, h[at], "left"), np.searchsorted(self.pairs, h[at], "right")
        n = high - low
        item = self.pair_item[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        text = np.searchsorted(first, at, "right") - 1
        # A pair of the last word of a text and the next text's first word only adds candidates.
        order = np.argsort(item, kind="stable")
        at, text, item = at[order], text[order], item[order]
        last = np.arange(len(at)) + self.least[item] - 1
        inside = np.flatnonzero(last < len(at))
        last = last[inside]
        enough = inside[(item[last] == item[inside]) & (text[last] == text[inside]) & (at[last] - at[inside] < self.sizes[item[inside]])]
        return at[enough], text[enough], item[enough]

    def hits(self, rows: list[np.ndarray]):
        """(row, item, start, cosine) of passages near an item."""
        sizes = np.array([len(r) for r in rows])
        starts, owner = _starts(sizes, QUARTER)
        if not len(starts) or not len(self.owner):
            return
        words = np.concatenate(rows)
        first = np.cumsum(sizes) - sizes
        place = starts - first[owner]
        # ``HASHED`` is the index of a row of zeros.
        quarters = _side_by_side(rows, QUARTER)
        narrow = self.weighted[quarters[:, 0]]
        for k in range(1, QUARTER):
            narrow += self.weighted[quarters[:, k]]
        same = np.flatnonzero(owner[1:] == owner[:-1])
        narrow[same] += narrow[same + 1]
        even = np.flatnonzero(place % HALF == 0)
        wide = narrow[even]
        same = np.flatnonzero(owner[np.minimum(even + 2, len(owner) - 1)] == owner[even])
        same = same[even[same] + 2 < len(owner)]
        wide[same] += narrow[even[same] + 2]
        near = _cosines(wide, self.matrix)
        found: dict[tuple[int, int], dict[int, float]] = {}

        def add(text, start, item, cosine):
            for r, s, i, c in zip(text.tolist(), start.tolist(), item.tolist(), cosine.tolist(), strict=True):
                places = found.setdefault((r, i), {})
                places[s] = max(c, places.get(s, -1.0))

        at, part = np.nonzero(near >= COSINE)
        add(owner[even[at]], place[even[at]], self.owner[part], near[at, part])
        if len(self.short):
            close = _cosines(narrow, self.matrix[self.short])
            at, part = np.nonzero(close >= SHORT_COSINE)
            add(owner[at], place[at] // HALF * HALF, self.owner[self.short[part]], close[at, part])
        at, text, item = self.copied(words, first)
        start = (at - first[text]) // HALF * HALF
        passage = np.searchsorted(starts[even], first[text] + start)
        parts = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        best = near[passage, parts[item]]
        for k in range(1, np.diff(parts).max()):
            more = np.flatnonzero(parts[item] + k < parts[item + 1])
            best[more] = np.maximum(best[more], near[passage[more], parts[item[more]] + k])
        add(text, start, item, best)
        yield from ((r, i, sorted((-c, s) for s, c in places.items())) for (r, i), places in found.items())

    def confirm(self, words: np.ndarray, item: int, places: list[tuple[float, int]]) -> tuple[float, float, int, float] | None:
        """(LCS share, answer share, start, cosine) of the first place that is confirmed."""
        mine = self.words[item]
        n, answer = len(mine), mine[-max(3, len(mine) // 4) :]
        done: list[tuple[int, int]] = []
        for cosine, start in places:
            b, e = max(0, start - n), min(len(words), start + PASSAGE + n)
            if any(x <= b and e <= y for x, y in done):
                continue
            done.append((b, e))
            region = words[b:e].tolist()
            if n < SHORTEST:
                for at in range(len(region) - n + 1):
                    if region[at] == mine[0] and region[at : at + n] == mine:
                        return 1.0, 1.0, b + at, -cosine
                continue
            # Cut to the part that can hold the item with a few words put in.
            masks = list(filter(None, map(self.masks[item].get, region)))
            # As many words as the places of the item that occur at all are the most there can be in order.
            if reduce(or_, masks, 0).bit_count() / n < LCS:
                continue
            share = _lcs(n, masks) / n
            if share < LCS:
                continue
            told = lcs(answer, region) / len(answer)
            if told >= ANSWER:
                return share, told, b, -cosine
        return None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _cosines(x: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Cosines of rows with unit vectors."""
    return (x @ unit.T) / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def search(staged: DataFrame, items: list[tuple[object, bytes | None]], idf: np.ndarray, vectors: np.ndarray, values: np.ndarray, item_kind: str) -> DataFrame:
    """Matches of one block of items: ``doc_id, item_id, lcs, answer_lcs, cosine``."""
    shipped = sent(staged.sparkSession, (items, idf, vectors, values))
    kind = staged.schema["doc_id"].dataType.simpleString()
    arrow = staged.sparkSession.createDataFrame([], f"item {item_kind}").toArrow().schema.field("item").type

    def run(batches):
        block = Items(*shipped.value)
        for batch in batches:
            rows_out, found = [], []
            for start, rows in _slices(batch.column(1)):
                for r, i, places in block.hits(rows):
                    if ok := block.confirm(rows[r], i, places):
                        rows_out.append(start + r)
                        found.append((block.ids[i], *ok))
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).take(pa.array(rows_out, pa.int64())),
                    "item_id": pa.array([x[0] for x in found], arrow),
                    "lcs": pa.array([x[1] for x in found], pa.float64()),
                    "answer_lcs": pa.array([x[2] for x in found], pa.float64()),
                    "cosine": pa.array([x[4] for x in found], pa.float64()),
                }
            )

    return staged.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, lcs double, answer_lcs double, cosine double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item it holds: ``doc_id, item_id, lcs, answer_lcs, cosine``."""
    both = materialize(stage_counted(docs, id_col, text))
    idf = inverse_frequencies(both.where("ids IS NULL"))
    staged = staged_rows(both)
    vectors, values = singular_vectors(staged, idf)
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("binary").alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    blocks = -(-items.count() // ITEMS)
    found = None
    for b in range(max(1, blocks)):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(max(1, blocks))) == b) if blocks > 1 else items
        rows = [(r["item"], None if r["text"] is None else bytes(r["text"])) for r in mine.collect()]
        part = search(staged, rows, idf, vectors, values, kind)
        found = part if found is None else found.unionByName(part)
    out = materialize(found)
    release(both)
    return out.withColumnRenamed("doc_id", id_col)
