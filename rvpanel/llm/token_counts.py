"""Token counts of documents from counts of their pre-tokens, without materialising ids.

1. Distinct pre-tokens of all documents, with their frequencies, from partial counts per task.
2. Pieces are counted once per distinct pre-token, by the tokenizer library.
3. Pieces are joined to the pre-token frequencies of each document and summed.  The most
   frequent pre-tokens (``HEAD``, a fixed bound) are joined inside the task from a broadcast
   table, like a map-side join of the hot keys; rows of the rare ones are shuffled to the table
   of pieces.  So no hot pre-token meets in one task and few rows move.

Texts are first cut before a space between two characters that are not white space: the
byte-level pre-tokenizer never joins across such a cut.  The parts are memoised, and each distinct
part is split into pre-tokens by the library's own pre-tokenizer.  A part that holds the string of
an added token counts as one pre-token, which the library then encodes as its default does.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows keep a result each;
an empty table gives no rows; texts are counted whole, however long.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.llm import words as W
from rvpanel.llm.tasks import most_frequent, on_executors, partition_id, sent, text_slices
from rvpanel.sources.store import materialize

#: Pre-tokens whose pieces are broadcast: at most this many rows, about 10 MB.
HEAD = 1 << 18
FLUSH = 200_000
_RARE = 1 << 40

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space beside a space, or other than single spaces and line feeds, takes the exact but slower cut.
_BESIDE = {w: (b" " + w, w + b" ") for w in (b"\n", b"\t", b"\r")}
_ODD = [b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f"]
_ODD_WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
#: ASCII marks of which a run behind letters is one pre-token; an apostrophe may begin an ending, and "<|" a special token.
_MARKS = b'!"#$%&()*+,-./:;=>?@[\\]^_`{}~'


def _odd(text: bytes) -> bool:
    if text[:1] == b" " or text[-1:] == b" " or b"  " in text or any(o in text for o in _ODD):
        return True
    if any(w in text and (before in text or behind in text) for w, (before, behind) in _BESIDE.items()):
        return True
    return not text.isascii() and any(o in text for o in _ODD_WIDE)


def parts(text: bytes) -> tuple[bytes, list[bytes]]:
    """First part as it is, and the others without the space they begin with."""
    if _odd(text):
        found = _CUT.split(text.decode("utf-8", "replace"))
        return found[0].encode(), [p[1:].encode() for p in found[1:]]
    found = text.split(b" ")
    return found[0], found[1:]


class _Splitter:
    def __init__(self, path: str):
        known = W.tokenizer(path)
        if known.normalizer is not None or known.pre_tokenizer is None:
            raise ValueError("a tokenizer with a byte-level pre-tokenizer and no normalizer is needed")
        self.split = known.pre_tokenizer.pre_tokenize_str
        self.added = [t.content for t in known.get_added_tokens_decoder().values()]

    def __call__(self, part: str) -> list[str]:
        """Pre-tokens of a part, by the library; a part with the string of an added token is one."""
        if not part or any(a in part for a in self.added):
            return [part] if part else []
        return [part[a:b] for _, (a, b) in self.split(part)]

    def encoded(self, lead: bytes, word: bytes) -> list[bytes]:
        """The same of ``lead`` (a space or nothing) and ``word`` in UTF-8; plain words, also several of them between
        single line feeds, do not need the library."""
        if (found := _plain(lead, word)) is not None:
            return found
        if b"\n" in word:
            found = []
            for line in word.split(b"\n"):
                if (some := _plain(b"" if found else lead, line)) is None:
                    break
                found += [b"\n", *some] if found else some
            else:
                return found
        return [p.encode() for p in self((lead + word).decode("utf-8", "replace"))]


def _plain(lead: bytes, word: bytes) -> list[bytes] | None:
    """Letters are one pre-token with the space before them, and so is a run of marks behind them; None for other words."""
    if word.isalpha():
        return [lead + word]
    head = word.rstrip(_MARKS)
    if head.isalpha() or not head.isascii() and head.decode("utf-8", "replace").isalpha():
        return [lead + head] if len(head) == len(word) else [lead + head, word[len(head) :]]
    return None


def pretoken_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pretoken, n) over all documents."""
    on_executors(docs.sparkSession)

    def count(batches):
        split = _Splitter(path)
        first: Counter = Counter()
        rest: Counter = Counter()

        def rows():
            total: Counter = Counter()
            for lead, held in ((b"", first), (b" ", rest)):
                for part, n in held.items():
                    for p in split.encoded(lead, part):
                        total[p] += n
                held.clear()
            keys = pa.array(list(total), pa.binary())
            return pa.record_batch({"pretoken": keys, "n": pa.array(list(total.values()), pa.int64())})

        for batch in batches:
            for _, texts in text_slices(batch):
                for t in texts:
                    if t:
                        lead, others = parts(t)
                        first[lead] += 1
                        rest.update(others)
                if len(first) + len(rest) > FLUSH:
                    yield rows()
        yield rows()

    each = docs.select(F.col(text).alias("text")).mapInArrow(count, "pretoken binary, n long")
    return each.groupBy("pretoken").agg(F.sum("n").alias("n"))


def with_pieces(pretokens: DataFrame, path: str) -> DataFrame:
    """(pretoken, n, pieces): one library call per distinct pre-token."""

    def run(batches):
        for batch in batches:
            pieces = [len(ids) for ids in W.library_ids(path, batch.column(0).to_pylist())]
            yield pa.record_batch({"pretoken": batch.column(0), "n": batch.column(1), "pieces": pa.array(pieces, pa.int32())})

    return pretokens.mapInArrow(run, "pretoken binary, n long, pieces int")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    table = materialize(with_pieces(pretoken_counts(docs, path, text), path))
    top = most_frequent(table, "pretoken", "n", head)
    known = {bytes(r["pretoken"]): r["pieces"] for r in top}
    least = min((r["n"] for r in top), default=0) if len(top) >= head else 0
    shipped = sent(spark, known)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        split, held = _Splitter(path), shipped.value
        memos = {b"": W.Memo(16 << 20), b" ": W.Memo(64 << 20)}
        rare: dict[bytes, dict] = {b"": {}, b" ": {}}
        row = partition_id() << 33

        def learn(lead: bytes, words: list[bytes]):
            memo = memos[lead]
            for w in words:
                total, tail = 0, []
                for p in split.encoded(lead, w):
                    if (n := held.get(p)) is None:
                        tail.append(p)
                    else:
                        total += n
                if tail:
                    rare[lead][w] = tail
                    total += _RARE
                memo.put(w, total, len(w) + 2 * sum(map(len, tail)) + 100 * len(tail))

        for batch in batches:
            for start, texts in text_slices(batch):
                for lead, memo in memos.items():
                    memo.room()
                    if not memo:
                        rare[lead].clear()
                cut = [parts(t) if t else (b"", []) for t in texts]
                learn(b"", W.missing(memos[b""], [[a] for a, _ in cut]))
                learn(b" ", W.missing(memos[b" "], [b for _, b in cut]))
                rows, base, tails = [], [], []
                first, rest = memos[b""], memos[b" "].__getitem__
                for (a, others), t in zip(cut, texts, strict=True):
                    total = first[a] + sum(map(rest, others))
                    if total >= _RARE:
                        found: Counter = Counter(rare[b""].get(a, ()))
                        mine = rare[b" "]
                        for w in others:
                            if w in mine:
                                found.update(mine[w])
                        tails += [(row, p, n) for p, n in found.items()]
                    rows.append(row)
                    base.append((len(t or b""), total & (_RARE - 1)))
                    row += 1
                n = len(tails)
                none = pa.nulls(n)
                ids = batch.column(0).slice(start, len(texts))
                yield pa.record_batch(
                    {
                        "row": pa.array(rows + [r for r, _, _ in tails], pa.int64()),
                        "doc_id": pa.concat_arrays([ids, none.cast(ids.type)]),
                        "n_bytes": pa.array([b for b, _ in base] + [None] * n, pa.int64()),
                        "base": pa.array([b for _, b in base] + [None] * n, pa.int64()),
                        "pretoken": pa.array([None] * len(rows) + [p for _, p, _ in tails], pa.binary()),
                        "freq": pa.array([None] * len(rows) + [f for _, _, f in tails], pa.int64()),
                    }
                )

    schema = f"row long, doc_id {kind}, n_bytes long, base long, pretoken binary, freq long"
    found = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema))
    tails = found.where("pretoken IS NOT NULL").select("row", "pretoken", "freq")
    pieces = (table.where(F.col("n") <= least) if least else table).select("pretoken", "pieces")
    rest = tails.join(pieces, "pretoken").groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("rest"))
    whole = found.where("pretoken IS NULL").select("row", "doc_id", "n_bytes", "base").join(rest, "row", "left")
    total = F.col("base") + F.coalesce("rest", F.lit(0))
    return whole.select(F.col("doc_id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
