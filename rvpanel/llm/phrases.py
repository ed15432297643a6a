"""Phrase collocations by Toivonen's sampling method.

1. A sample (one document in ``SAMPLE``, by hash) proposes phrases: those that reach the lowered support in it.
2. One pass over all documents counts, exactly, the proposed phrases and their negative border: every phrase that
   occurs, is not proposed, and whose parts without its last and without its first word are proposed.  All single
   words are counted.
3. A border phrase that reaches the support is a failure: phrases around it may have been missed.  An
   expansion pass then counts what the larger set adds.  It takes every phrase it newly counts for proposed when
   it looks at longer ones, so it leaves no failure behind and the set is closed after it: both parts of a frequent
   phrase are frequent, hence known before that pass or counted in it, and the phrase was counted with them.

Counts are exact: a phrase is either counted at all its places or at none.  Proposals reach the tasks as a bit
filter of at most ``FILTER_BITS`` bits whatever their number; a false positive costs a count that is not
needed and changes no result.  Counts are summed in the task before they are shuffled by (lang, phrase),
so no frequent word or phrase meets in one task.

Edge cases: null and empty texts have no words; a null lang is ``und``, together with a lang of that name; copies
and repeated rows count as often as they stand there; an empty table, or one without a phrase of the support, gives
no rows; ties end by phrase in the order of UTF-8 bytes; texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rvpanel.llm.tasks import on_executors, sent
from rvpanel.sources.store import materialize, release

#: One document in so many makes up the sample.
SAMPLE = 8
#: Largest size of the filter of proposed phrases (32 MB).
FILTER_BITS = 1 << 28
#: Words a task holds between two tables of counts; their local ids fit 20 bits.
FLUSH_WORDS = 1 << 20
#: Candidates that one task ranks at a time.
RANKED = 1 << 17

_ENDS = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n" * 10 + b" ")
_COUNTS = "lang string, phrase binary, f long"
_PRIME, _ROUND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ROUND
    return h ^ (h >> np.uint64(32))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word behind them."""
    return _mixed(h * _PRIME + word)


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode()))


class Filter:
    """A set of phrase hashes as bits, two a phrase; may also hold others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @staticmethod
    def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(size - 1)
        return h & mask, (h >> np.uint64(32)) & mask

    def __contains__(self, h):
        raise TypeError("use holds, for arrays of hashes")

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, 8 * len(self.bits)):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


class _Words(dict):
    """Local ids of a language's words in the order they come; -1 ends a piece, -2 is nothing."""

    def __init__(self):
        super().__init__({b"\n": -1, b"": -2})
        self.known: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.known)
        self.known.append(word)
        return i

    def ids(self, texts: list[bytes]) -> np.ndarray:
        found = b"\n".join(texts).lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ")
        a = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return a[a != -2]


def _counted(a: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``k`` words among those that start at ``at``: a place of each, and their counts."""
    width = 20 if a.max(initial=0) < 1 << 20 else 31
    key, held = a[at], 1
    for j in range(1, k):
        if (held + 1) * width > 62:
            # Full; ranks of what was seen so far make room for the next id.
            key, held = np.unique(key, return_inverse=True)[1].astype(np.int64), 62 // width - 1
        key, held = (key << width) | a[at + j], held + 1
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return at[first], counts


def _distinct(a: np.ndarray, at: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """As :func:`_counted`, with the ids of each of their words.  Where a key holds them all, values are sorted and not places."""
    width = max(1, int(a.max(initial=0)).bit_length())
    if k * width > 63:
        at, counts = _counted(a, at, k)
        return [a[at + j] for j in range(k)], counts
    key = a[at]
    for j in range(1, k):
        key = (key << width) | a[at + j]
    key, counts = np.unique(key, return_counts=True)
    return [(key >> width * (k - 1 - j)) & ((1 << width) - 1) for j in range(k)], counts


def count_phrases(
    docs: DataFrame, longest: int, proposed=None, before=None, shortest: int = 1, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """(lang, phrase, f) of phrases of ``shortest`` to ``longest`` words whose parts without the last and without the
    first word are in the filter ``proposed`` (None: all are), summed over all documents.  With single words comes
    the empty phrase, whose ``f`` counts all words.

    With ``shortest`` above 1, phrases counted now are taken for proposed.  Phrases that a pass with the filter
    ``before`` counted are left out.
    """
    on_executors(docs.sparkSession)

    def tables(held: dict[str, tuple[_Words, list[np.ndarray]]]):
        new = Filter(np.frombuffer(proposed.value, np.uint8)) if proposed is not None else None
        old = Filter(np.frombuffer(before.value, np.uint8)) if before is not None else None
        for name, (memo, parts) in held.items():
            minus = np.array([-1], np.int64)
            a = np.concatenate([x for part in parts for x in (part, minus)])
            known = memo.known
            inside = a >= 0
            if shortest == 1 and known:
                n = np.bincount(a[inside], minlength=len(known))
                yield table(name, [b"", *known], [int(n.sum()), *n.tolist()])
            spelled = pa.array(known, pa.binary())
            each = np.array([_word_hash(name, w) for w in known], np.uint64)
            single = np.zeros(len(a), np.uint64)
            single[inside] = each[a[inside]]
            h = single

            def member(of: Filter | None, hashes: np.ndarray, where: np.ndarray) -> np.ndarray:
                out = np.zeros(len(where), bool)
                out[where] = True if of is None else of.holds(hashes[where])
                return out

            now = member(new, h, inside)
            then = member(old, h, inside) if old is not None else np.zeros(len(a), bool)
            for k in range(2, longest + 1):
                both, had = now[:-1] & now[1:], then[:-1] & then[1:]
                h = _longer(h[:-1], single[k - 1 :])
                fresh = both & ~had
                if k >= shortest and fresh.any():
                    ids, counts = _distinct(a, np.flatnonzero(fresh), k)
                    yield table(name, pc.binary_join_element_wise(*[spelled.take(pa.array(i)) for i in ids], b" "), counts)
                now, then = member(new, h, both), member(old, h, had) if old is not None else had
                if 1 < shortest <= k:
                    now |= fresh

    def table(name: str, phrases, counts) -> pa.RecordBatch:
        columns = {"lang": pa.repeat(name, len(counts)), "phrase": pa.array(phrases, pa.binary()), "f": pa.array(counts, pa.int64())}
        return pa.record_batch(columns)

    def run(batches):
        held: dict[str, tuple[_Words, list[np.ndarray]]] = {}
        taken = 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary())
            for start in range(0, batch.num_rows, 64):
                mine: dict[str, list[bytes]] = {}
                for name, t in zip(langs[start : start + 64], texts.slice(start, 64).to_pylist(), strict=True):
                    if t:
                        mine.setdefault(name, []).append(t)
                for name, some in mine.items():
                    # A text longer than a task may hold is taken in parts that end where a piece ends.
                    for part in _portions(some):
                        memo, parts = held.setdefault(name, (_Words(), []))
                        parts.append(memo.ids(part))
                        taken += len(parts[-1]) + 1
                        if taken >= FLUSH_WORDS // 2:
                            yield from tables(held)
                            held, taken = {}, 0
        yield from tables(held)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    # Tasks have summed already: few rows would be left out by summing once more before the shuffle.
    summed = rows.mapInArrow(run, _COUNTS).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return summed.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _portions(texts: list[bytes]):
    """The texts in lists of at most about ``FLUSH_WORDS`` bytes, so of fewer than half as many words; pieces stay whole
    unless one piece alone is longer, which is then a portion of its own."""
    room = FLUSH_WORDS
    some: list[bytes] = []
    size = 0
    for t in texts:
        if len(t) > room:
            piece_ends = t.translate(_ENDS)
            start = 0
            while len(t) - start > room:
                end = piece_ends.rfind(b"\n", start, start + room)
                end = end if end >= 0 else piece_ends.find(b"\n", start + room)
                if end < 0:
                    break
                yield [t[start:end]]
                start = end + 1
            t = t[start:]
        if size + len(t) > room and some:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Hashes of phrases as the counting pass computes them."""
    out = np.zeros(len(phrases), np.uint64)
    split = [p.encode().split(b" ") for p in phrases]
    widths = np.array([len(p) for p in split], np.int64)
    for k in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == k)
        h = None
        for j in range(k):
            word = np.array([_word_hash(langs[i], split[i][j]) for i in rows.tolist()], np.uint64)
            h = word if h is None else _longer(h, word)
        out[rows] = h
    return out


def build_filter(phrases: DataFrame, most: int = FILTER_BITS):
    """The filter of (lang, phrase) as a broadcast: sixteen bits a phrase, ``most`` bits at most.  Tasks put
    together blocks of 64 KB; only these reach the driver."""
    spark = phrases.sparkSession
    n = phrases.count()
    size = min(most, max(1 << 12, 1 << math.ceil(math.log2(16 * max(n, 1)))))
    block = min(size, 1 << 19)

    def place(batches):
        for batch in batches:
            h = phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            at = np.concatenate(Filter.places(h, size)).astype(np.int64)
            yield pa.record_batch({"block": pa.array(at // block, pa.int64()), "bit": pa.array(at % block, pa.int64())})

    def assemble(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, bits = (batch.column(i).to_numpy() for i in range(2))
            for b in np.unique(blocks).tolist():
                mine = found.setdefault(b, np.zeros(block // 8, np.uint8))
                at = bits[blocks == b]
                np.bitwise_or.at(mine, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        keys = pa.array(list(found), pa.int64())
        yield pa.record_batch({"block": keys, "bits": pa.array([v.tobytes() for v in found.values()], pa.binary())})

    placed = phrases.select("lang", "phrase").mapInArrow(place, "block long, bit long")
    rows = placed.repartition("block").mapInArrow(assemble, "block long, bits binary").collect()
    bits = bytearray(size // 8)
    for r in rows:
        bits[r["block"] * (block // 8) : (r["block"] + 1) * (block // 8)] = r["bits"]
    return sent(spark, bytes(bits))


def lacking(phrases: DataFrame, proposed) -> DataFrame:
    """The rows of (lang, phrase, f) that the filter does not hold."""

    def run(batches):
        known = Filter(np.frombuffer(proposed.value, np.uint8))
        for batch in batches:
            h = phrase_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield batch.filter(pa.array(~known.holds(h)))

    return phrases.select("lang", "phrase", "f").mapInArrow(run, "lang string, phrase string, f long")


def _propose(docs: DataFrame, support: int, longest: int, sample: int, lang: str, text: str) -> DataFrame:
    """Phrases with the lowered support in the sample: words and pairs first, then longer ones made of such pairs."""
    share = support / sample
    lowered = max(2, math.ceil(share - math.sqrt(share)))
    some = docs.where(F.pmod(F.xxhash64(text, lang), F.lit(sample)) == 0) if sample > 1 else docs
    short = materialize(count_phrases(some, min(longest, 2), lang=lang, text=text).where((F.col("f") >= lowered) & (F.col("phrase") != "")))
    if longest < 3:
        return short
    # Longer phrases are looked at where all their pairs are proposed.
    pairs = build_filter(short)
    long = count_phrases(some, longest, pairs, shortest=3, lang=lang, text=text)
    both = materialize(short.unionByName(long.where(F.col("f") >= lowered)))
    release(short)
    pairs.destroy()
    return both


def frequent_phrases(
    docs: DataFrame, support: int = 30, longest: int = 4, sample: int = SAMPLE, lang: str = "lang", text: str = "text"
) -> tuple[DataFrame, int]:
    """(lang, phrase, f) of all words and phrases of up to ``longest`` words with f >= ``support``, and of the empty phrase,
    whose f counts all words of the language; with the number of expansion passes it took."""
    proposals = _propose(docs, support, longest, sample, lang, text)
    proposed = build_filter(proposals)
    release(proposals)
    enough = (F.col("f") >= support) | (F.col("phrase") == "")
    found = materialize(count_phrases(docs, longest, proposed, lang=lang, text=text).where(enough))
    known = found.where("phrase <> ''")
    failures = lacking(known.where(_width("phrase") < longest), proposed)
    if failures.isEmpty():
        proposed.destroy()
        return found, 0
    larger = build_filter(known)
    more = count_phrases(docs, longest, larger, proposed, shortest=2, lang=lang, text=text)
    more = materialize(more.where(F.col("f") >= support))
    larger.destroy()
    proposed.destroy()
    return found.unionByName(more), 1


def _width(phrase: str):
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def _exact(expression: str) -> str:
    """A count as a decimal: its products fit 38 digits."""
    return f"CAST({expression} AS DECIMAL(20, 0))"


def _first(rows: DataFrame, top: int) -> DataFrame:
    """``rank`` 1 to ``top`` of each language.  A language's rows are dealt into groups of about ``RANKED`` at random
    of their phrase; the best of each go on into fewer groups until one is left, so none is ranked by one task whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = max(1, math.ceil(rows.count() / RANKED))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    fewer = max(2, RANKED // top)
    while True:
        ranked = Window.partitionBy("lang", "group").orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
        if groups == 1:
            return rows.drop("group").withColumn("rank", F.col("rank").cast("long"))
        groups = math.ceil(groups / fewer)
        rows = rows.drop("rank").withColumn("group", F.pmod(F.col("group"), F.lit(groups)))


def mine(
    docs: DataFrame,
    support: int = 30,
    longest: int = 4,
    cover: int = 80,
    top: int = 2000,
    sample: int = SAMPLE,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase scores floor(2000000 a / (l + r)) at its worst cut into a first part (l places) and the rest (r); ties go
    to the shorter first part.  Phrases inside a longer one that stands at ``cover`` per cent of their places or more are left out.
    """
    found, _ = frequent_phrases(docs, support, longest, sample, lang, text)
    phrases = found.where("phrase <> ''").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    several = phrases.where("size(words) > 1")

    parts = several.selectExpr(
        "lang", "phrase", "a", "words", "explode(sequence(1, size(words) - 1)) AS k"
    ).selectExpr(
        "lang", "phrase", "a", "k", "array_join(slice(words, 1, k), ' ') AS head", "array_join(slice(words, k + 1, size(words) - k), ' ') AS tail"
    )
    shorter = found.where(_width("phrase") < longest)
    cut = parts.join(shorter.selectExpr("lang", "phrase AS head", "f AS l"), ["lang", "head"])
    cut = cut.join(shorter.selectExpr("lang", "phrase AS tail", "f AS r"), ["lang", "tail"])
    score = f"(2000000 * {_exact('a')}) div ({_exact('l')} + {_exact('r')})"
    worst = cut.groupBy("lang", "phrase", "a").agg(F.expr(f"min(struct({score} AS score, k, l, r))").alias("worst"))

    inside = several.where("size(words) > 2").selectExpr(
        "lang", "a", "words", "explode(sequence(2, size(words) - 1)) AS k"
    ).selectExpr("lang", "a", "words", "k", "explode(sequence(1, size(words) - k + 1)) AS at").selectExpr(
        "lang", "array_join(slice(words, at, k), ' ') AS phrase", "a"
    )
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(covered, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * {_exact('longer')} < {cover} * {_exact('a')}")
    kept = materialize(kept.selectExpr("lang", "phrase", "a", "worst.l AS l", "worst.r AS r", "worst.score AS score"))
    totals = found.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return _first(kept, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
