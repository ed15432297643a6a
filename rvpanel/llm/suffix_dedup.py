"""Exact removal of repeated byte strings by suffix sorting with a deep-shallow sort.

Every byte that a ``LENGTH``-byte string covers which also starts elsewhere (same document
included) is removed; strings are judged on the input.  Matches never cross documents.

1. Equal texts are one class; a class of several documents is repeated as a whole.
2. Each start of a ``LENGTH``-byte string is given to the smallest hashed k-gram inside the string (an
   anchor).  The choice depends on the string alone, so equal strings have equal anchors at equal offsets.
   Only anchors whose k-gram occurs twice go on: joined counts, nothing is gathered.
3. The suffixes before and after the anchors of one k-gram are sorted: multikey quicksort over 8-byte
   characters down to ``SHALLOW`` bytes, then a blind trie orders each group whose common prefix is longer,
   which also gives the common prefix lengths of neighbours.
4. A start at offset o repeats if another anchor of the k-gram shares o bytes before it and LENGTH - o bytes from
   it on: classes of both sorted orders at these depths, counted in pairs.

A k-gram of very many anchors is dealt to several tasks by a salt; starts that find no partner
in their task are then compared across tasks by a 128-bit hash of their string, with a pre-aggregated count.

Edge cases: null and empty texts have nothing to remove and the hash of the empty string; repeated rows are one
class, removed whole from ``LENGTH`` bytes on; a null ``doc_id`` is kept as it is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.llm.tasks import on_executors
from rvpanel.sources.store import materialize, release, shared_folder

LENGTH = 200
GRAM = 40
#: Depth, in bytes, down to which suffixes are sorted by multikey quicksort.
SHALLOW = 64
#: Bytes whose anchors are found together; long texts are cut into such segments, overlapping.
SEGMENT = 1 << 18
#: Anchors of one k-gram in one task.
HOT = 20_000
#: Anchors sorted together.
CHUNK = 20_000

_BITS = np.uint64(18)
_PRIMES = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _gram_hashes(buf: bytes) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on."""
    n = len(buf) - GRAM + 1
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)).copy()
    h = eight[:n] * _PRIMES[0]
    for k in range(1, GRAM // 8):
        h += eight[8 * k : 8 * k + n] * _PRIMES[k]
        h ^= h >> np.uint64(29)
        h *= _PRIMES[(k + 1) % 5]
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, position, smallest offset, largest offset, k-gram hash) of the anchors of all starts.

    A start p belongs to the anchor at p + offset; each start belongs to one row.
    """
    reach = length - GRAM + 1
    pieces, owner, base, held, out = [], [], [], 0, []

    def flush():
        nonlocal held
        if not pieces:
            return
        buf = b"".join(pieces)
        sizes = np.array([len(p) for p in pieces])
        first = np.cumsum(sizes) - sizes
        h = _gram_hashes(buf)
        key = (h >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64)
        low, span = key, 1
        while span * 2 <= reach:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(key) - reach + 1], low[reach - span : reach - span + len(key) - reach + 1])
        starts = np.concatenate([np.arange(f, f + s - length + 1) for f, s in zip(first, sizes, strict=True)])
        piece = np.repeat(np.arange(len(pieces)), sizes - length + 1)
        at = (low[starts] & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        a, p = at[begin], piece[begin]
        own = np.array(owner)[p]
        out.append((own, a - first[p] + np.array(base)[p], a - starts[end], a - starts[begin], h[a]))
        pieces.clear()
        owner.clear()
        base.clear()
        held = 0

    step = SEGMENT - length
    for i, text in enumerate(texts):
        for s in range(0, max(0, len(text) - length + 1), step):
            piece = text[s : s + step + length - 1]
            if held + len(piece) > SEGMENT:
                flush()
            pieces.append(piece)
            owner.append(i)
            base.append(s)
            held += len(piece)
    flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# --- deep-shallow sorting -------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class _Node:
    """Blind trie node: ``depth`` of the byte it branches on, children by byte (-1: the end)."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def blind_trie_order(strings: list[bytes], rows: list[int]) -> tuple[list[int], list[int]]:
    """Rows in the order of their strings, and common prefix of each with the row before (first: 0).

    The trie keeps only branching depths.  A string descends blindly to some leaf; one
    comparison with that leaf gives its true place.  Leaves are lists of rows of equal strings.
    """
    root: _Node | list = [rows[0]]
    for row in rows[1:]:
        s, node = strings[row], root
        while isinstance(node, _Node):
            byte = s[node.depth] if node.depth < len(s) else -1
            node = node.children.get(byte) or next(iter(node.children.values()))
        t = strings[node[0]]
        n = _common(s, t)
        if n == len(s) == len(t):
            node.append(row)
            continue
        parent, byte, node = None, None, root
        while isinstance(node, _Node) and node.depth < n:
            parent, byte = node, s[node.depth]
            node = node.children[byte]
        mine = s[n] if n < len(s) else -1
        if isinstance(node, _Node) and node.depth == n:
            node.children[mine] = [row]
            continue
        split = _Node(n, {t[n] if n < len(t) else -1: node, mine: [row]})
        if parent is None:
            root = split
        else:
            parent.children[byte] = split
    order, common = [], []
    stack: list[tuple[_Node | list, int]] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, _Node):
            ranked = [node.children[b] for b in sorted(node.children)]
            stack += [(c, node.depth) for c in ranked[:0:-1]] + [(ranked[0], shared)]
        else:
            whole = len(strings[node[0]])
            order += node
            common += [shared] + [whole] * (len(node) - 1)
    return order, common


def deep_shallow_order(strings: list[bytes], rows: list[int]) -> tuple[list[int], list[int]]:
    """Rows in the order of their strings and common prefixes with the row before (first: 0)."""
    order, common = [], []
    stack = [(rows, 0, 0)]
    while stack:
        part, depth, shared = stack.pop()
        if len(part) == 1:
            order.append(part[0])
            common.append(shared)
            continue
        if len(part) == 2:
            a, b = part
            n = _common(strings[a], strings[b])
            order += [a, b] if strings[a] <= strings[b] else [b, a]
            common += [shared, n]
            continue
        if depth >= SHALLOW:
            deep, lcp = blind_trie_order(strings, part)
            lcp[0] = shared
            order += deep
            common += lcp
            continue
        chars = [strings[r][depth : depth + 8] for r in part]
        pivot = sorted((chars[0], chars[len(chars) // 2], chars[-1]))[1]
        less, same, more = [], [], []
        for r, c in zip(part, chars, strict=True):
            (same if c == pivot else less if c < pivot else more).append(r)
        if not less and not more and len(pivot) < 8:  # all strings end here, equal
            order += same
            common += [shared] + [len(strings[same[0]])] * (len(same) - 1)
            continue
        # The first row of a later part meets the largest row of the part before: its common
        # prefix is found from the strings themselves once the order stands (-1: open).
        parts = [p for p in ((less, depth), (same, depth + 8), (more, depth)) if p[0]]
        for i in range(len(parts) - 1, -1, -1):
            stack.append((parts[i][0], parts[i][1], shared if i == 0 else -1))
    for i, n in enumerate(common):
        if n < 0:
            common[i] = _common(strings[order[i - 1]], strings[order[i]])
    return order, common


def repeated_starts(group: np.ndarray, contexts: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(row, offset) matrix: whether the string at the offset before the row's anchor also starts at another row.

    ``contexts`` hold the bytes from ``high`` before the anchor to ``length - low`` after its start;
    rows of a group are neighbours.
    """
    n, width = len(contexts), length - GRAM + 1
    out = np.zeros((n, width), bool)
    after = [c[h:] for c, h in zip(contexts, high.tolist(), strict=True)]
    before = [c[:h][::-1] for c, h in zip(contexts, high.tolist(), strict=True)]
    place, lcp = [np.zeros(n, np.int64) for _ in range(2)], [np.zeros(n, np.int64) for _ in range(2)]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for side, strings in enumerate((after, before)):
            order, common = deep_shallow_order(strings, list(range(b, e)))
            place[side][b:e] = order
            lcp[side][b:e] = common
            lcp[side][b] = -1
    # Rows whose best neighbours cannot make up the length have no partner.
    reach = []
    for side in (0, 1):
        best = np.maximum(lcp[side], np.append(lcp[side][1:], -1))
        r = np.zeros(n, np.int64)
        r[place[side]] = best
        reach.append(r)
    on = np.flatnonzero(reach[0] + reach[1] >= length)
    if not len(on):
        return out
    for o in range(int(low[on].min()), int(high[on].max()) + 1):
        rows = on[(low[on] <= o) & (o <= high[on]) & (reach[0][on] >= length - o) & (reach[1][on] >= o)]
        if len(rows) < 2:
            continue
        key = np.zeros(n, np.int64)
        for side, depth in ((0, length - o), (1, o)):
            classes = np.zeros(n, np.int64)
            classes[place[side]] = np.cumsum(lcp[side] < depth)
            key = key * (n + 1) + classes
        _, inverse, count = np.unique(key[rows], return_inverse=True, return_counts=True)
        out[rows[count[inverse] > 1], o] = True
    return out


# --- jobs ----------------------------------------------------------------------------------


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """Inclusive runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _class_of(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, class (128-bit hash of the text) and the text's bytes."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_t")
            raw = batch.column(at).cast(pa.binary()).fill_null(b"")
            mark = pa.array([xxhash.xxh3_128_digest(t) for t in raw.to_pylist()], pa.binary())
            yield pa.record_batch({**{f"k{i}": batch.column(i) for i in range(len(keep))}, "class": mark, "bytes": raw})

    given = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("_t"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}class binary, bytes binary")


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            classes = batch.column(0).to_pylist()
            own, pos, low, high, h = anchors(batch.column(1).to_pylist(), length)
            yield pa.record_batch(
                {
                    "h": pa.array(h.view(np.int64), pa.int64()),
                    "class": pa.array([classes[i] for i in own], pa.binary()),
                    "pos": pa.array(pos, pa.int32()),
                    "low": pa.array(low, pa.int16()),
                    "high": pa.array(high, pa.int16()),
                }
            )

    return texts.select("class", "bytes").mapInArrow(run, "h long, class binary, pos int, low short, high short")


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """Bytes around each anchor; anchors of one text with equal bytes are partners at once and one goes on."""

    def run(batches):
        for batch in batches:
            classes, texts, found = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for c, t, marks in zip(classes, texts, found, strict=True):
                seen: dict[tuple, list] = {}
                for m in marks:
                    context = t[m["pos"] - m["high"] : m["pos"] + length - m["low"]]
                    seen.setdefault((m["h"], context, m["low"], m["high"]), []).append(m)
                for (h, context, low, high), ms in seen.items():
                    first = ms[0]
                    out.append((h, first["salt"], first["salts"], c, first["pos"], low, high, context))
                    if len(ms) > 1:  # every start of each of them repeats
                        out += [(h, m["salt"], m["salts"], c, m["pos"], low, high, None) for m in ms]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int16(), pa.int16(), pa.binary())
            names = ("h", "salt", "salts", "class", "pos", "low", "high", "context")
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.record_batch({n: pa.array(list(v), k) for n, k, v in zip(names, kinds, columns, strict=True)})

    return rows.mapInArrow(run, "h long, salt int, salts int, class binary, pos int, low short, high short, context binary")


def _starts(contexts: DataFrame, length: int) -> DataFrame:
    """(class, first, last) runs of repeated starts; with ``lone`` (hash, start) for open starts of salted k-grams."""

    def solve(rows):
        out = [(r[3], r[4] - r[6], r[4] - r[5], None) for r in rows if r[7] is None]
        rows = [r for r in rows if r[7] is not None]
        if not rows:
            return out
        group = np.cumsum([0, *(a[:2] != b[:2] for a, b in zip(rows[:-1], rows[1:], strict=True))])
        low, high = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        marks = repeated_starts(group, [r[7] for r in rows], low, high, length)
        for i in np.flatnonzero(marks.any(axis=1)).tolist():
            r = rows[i]
            out += [(r[3], r[4] - b, r[4] - a, None) for a, b in _runs(marks[i])]
        told: set[bytes] = set()
        for i, r in enumerate(rows):
            if r[2] > 1:
                for o in range(r[5], r[6] + 1):
                    mark = xxhash.xxh3_128_digest(r[7][r[6] - o : r[6] - o + length])
                    # Repeated strings once: they may be partners of open starts elsewhere.
                    if not marks[i, o] or mark not in told:
                        out.append((r[3], r[4] - o, r[4] - o, mark))
                        told.add(mark)
        return out

    def run(batches):
        held: list[tuple] = []

        def emit(rows):
            found = solve(rows)
            return pa.record_batch(
                {
                    "class": pa.array([r[0] for r in found], pa.binary()),
                    "first": pa.array([r[1] for r in found], pa.int32()),
                    "last": pa.array([r[2] for r in found], pa.int32()),
                    "lone": pa.array([r[3] for r in found], pa.binary()),
                }
            )

        for batch in batches:
            fresh = list(zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True))
            held += fresh
            if len(held) >= CHUNK:
                last = held[-1][:2]
                cut = next((i for i in range(len(held) - 1, -1, -1) if held[i][:2] != last), -1) + 1
                if cut:
                    yield emit(held[:cut])
                    held = held[cut:]
        if held:
            yield emit(held)

    return contexts.mapInArrow(run, "class binary, first int, last int, lone binary")


def _cut(texts: DataFrame, length: int, whole_characters: bool) -> DataFrame:
    """Class results: bytes, removed bytes and spans, what is kept."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            out = []
            for c, t, many, runs in zip(*columns, strict=True):
                spans: list[list[int]] = []
                if many > 1 and len(t) >= length:
                    spans = [[0, len(t)]]
                else:
                    for r in sorted((r["first"], r["last"] + length) for r in runs or []):
                        if spans and r[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r[1])
                        else:
                            spans.append(list(r))
                kept, at = [], 0
                for b, e in spans:
                    if whole_characters:  # a character stays if any of its bytes does
                        while b < e and t[b] & 0xC0 == 0x80:
                            b += 1
                        while e > b and e < len(t) and t[e] & 0xC0 == 0x80:
                            e -= 1
                    kept.append(t[at:b])
                    at = e
                kept = b"".join([*kept, t[at:]])
                out.append((c, len(t), sum(e - b for b, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ("class", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
            columns = list(zip(*out, strict=True)) or [()] * 6
            if not whole_characters:
                names, kinds, columns = names[:-1], kinds[:-1], columns[:-1]
            yield pa.record_batch({n: pa.array(list(v), k) for n, k, v in zip(names, kinds, columns, strict=True)})

    schema = "class binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return texts.mapInArrow(run, schema + (", kept binary" if whole_characters else ""))


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, text: str = "text", length: int = LENGTH, texts_out: bool = False) -> DataFrame:
    """Per document: the columns of ``keep`` (default ``doc_id``), ``n_bytes, n_removed, n_spans, kept_sha256``.

    With ``texts_out`` also ``kept_text``: what is left, where characters of which a part is kept stay whole.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings of at least {GRAM + 8} bytes are needed")
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    on_executors(spark)
    # Distinct texts, laid out by class, so that later joins by class do not move texts again.
    classes = _class_of(docs, text).groupBy("class").agg(F.first("bytes").alias("bytes"), F.count("*").cast("long").alias("many"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_folder(spark)}/{name}"
    writer = classes.write.option("path", folder).option("compression", "zstd")
    writer.bucketBy(buckets, "class").format("parquet").saveAsTable(name)
    texts = spark.table(name)

    found = materialize(_anchor_table(texts.where(F.length("bytes") >= length), length))
    # Stored, so that the join's two sides are plain shuffles and a hot k-gram's rows can be split.
    counts = materialize(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))
    salts = F.ceil(F.col("k") / HOT).cast("int")
    marked = found.join(counts, "h").withColumn("salts", salts)
    marked = marked.withColumn("salt", F.pmod(F.hash("class", "pos"), F.col("salts"))).drop("k")
    marked = materialize(marked)
    release(found)
    release(counts)
    by_text = marked.groupBy("class").agg(F.collect_list(F.struct("h", "salt", "salts", "pos", "low", "high")).alias("marks"))
    rows = texts.select("class", "bytes").join(by_text, "class").select("class", "bytes", "marks")
    dealt = _contexts(rows, length).repartition("h", "salt").sortWithinPartitions("h", "salt")
    starts = materialize(_starts(dealt, length))
    release(marked)
    lone = starts.where("lone IS NOT NULL")
    again = lone.groupBy("lone").agg(F.count("*").alias("k")).where("k > 1").select("lone")
    runs = starts.where("lone IS NULL").select("class", "first", "last").unionByName(lone.join(again, "lone").select("class", "first", "last"))
    runs = runs.groupBy("class").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    done = _cut(texts.join(runs, "class", "left").select("class", "bytes", "many", "runs"), length, texts_out)
    held = _class_of(docs, text, *keep).drop("bytes")
    out = held.join(done, "class").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts_out else []))
    return out.withColumn("kept", F.decode("kept", "UTF-8")).withColumnRenamed("kept", "kept_text") if texts_out else out
