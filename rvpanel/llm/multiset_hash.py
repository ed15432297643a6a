"""Document fingerprints that add up: homomorphic hashes of a text's paragraphs as a multiset.

DataFrame functions only.  A text is cut behind every mark of ``ENDS`` into paragraphs.  Each becomes a wide vector, a text's
fingerprint is the sum of the vectors of its paragraphs modulo powers of two:

* ``WIDE`` lanes modulo 2^36, filled from two SHA-256 of the paragraph, tell texts apart;
* ``LEVELS`` rows of ``CELLS`` cells modulo 2^16: a paragraph falls into one cell, in row v with probability
  3/4 * 4^-v (the last row takes all that go further), and adds a number from 1 to 31;
* the last lane counts paragraphs.

So texts with the same paragraphs in any order have equal fingerprints, and inserting or deleting paragraphs is an
addition or subtraction: ``combine`` does it.  The edited text's fingerprint is made that way, from the paragraphs that stay
and those of the new end, without hashing what stays twice.

Two fingerprints show how many paragraphs differ: cells that differ in a row are counted, the number of paragraphs
behind them follows from the share of equal cells, and the first row that is not full is scaled up by its probability.
The likeness is 1 - differing / (all paragraphs of both), between 0 and 1, and 1 only for equal fingerprints but for
rounding.  Beyond some 80,000 differing paragraphs the estimate is only a lower bound of their number.

Rows are put in the order of ids by a range exchange over (id, hash of the text, row), stored, and cut into groups of ``GROUP``
rows that also hold a copy of the row after their last; everything else runs in these groups, so texts move twice
and no id, however often repeated, meets in one task.

Edge cases: null and empty texts have no paragraph and a fingerprint of zeros; two such are alike (1).  Null ids come after
all others; equal ids are ordered by the hash of their texts, so that rows that repeat both are interchangeable; a
single row is its own next one; an empty table gives no rows.  Texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rvpanel.sources.store import materialize

#: A paragraph ends behind one of these.
ENDS = r".,;:!?\n"
WIDE = 14
#: With the keys, the sums stay below the 100 columns up to which Spark compiles a stage.
LEVELS, CELLS = 6, 24
GROUP = 64

_DIGITS = 9
_WIDE_MASK, _CELL_MASK = (1 << 4 * _DIGITS) - 1, (1 << 16) - 1
#: Two cells share a 64-bit sum, the second one from this bit on.
_PAIRS, _SECOND = LEVELS * CELLS // 2, 31


def paragraphs(text: str) -> str:
    """SQL: the paragraphs of a text, each with the mark that ends it."""
    return f"regexp_extract_all({text}, r'[^{ENDS}]*[{ENDS}]|[^{ENDS}]+', 0)"


def _number(text: str, at: int, digits: int) -> str:
    return f"CAST(conv(substr({text}, {at}, {digits}), 16, 10) AS BIGINT)"


def _lanes() -> list[Column]:
    """Sums over paragraphs, of which ``one`` is 1, or 0 for a text without any."""
    half = WIDE // 2
    wide = [f"{_number(f'w{j // half}', _DIGITS * (j % half) + 1, _DIGITS)} * one" for j in range(WIDE)]
    pairs = [f"IF(pair = {k}, add, 0L)" for k in range(_PAIRS)]
    # A sum leaves 64 bits only beyond 2^27 paragraphs, more than a task can hold of one text.
    return [F.expr(f"sum({x})").alias(f"s{k}") for k, x in enumerate([*wide, *pairs, "one"])]


def _placed(rows: DataFrame) -> DataFrame:
    """Cell and addend of each paragraph from its hash."""
    known = rows.selectExpr(
        "*", "bigint(u <> '') AS one", "sha2(u, 256) AS w0", "sha2(concat('1', u), 256) AS w1", f"{_number('md5(u)', 1, 15)} AS m"
    )
    level = "CASE " + " ".join(f"WHEN m & {3 << 2 * v} <> 0 THEN {v}" for v in range(LEVELS - 1)) + f" ELSE {LEVELS - 1} END"
    known = known.selectExpr("*", f"({level}) * {CELLS} + shiftright(m, 12) % {CELLS} AS cell", "(shiftright(m, 36) % 31 + 1) * one AS add")
    return known.withColumns({"pair": F.expr("cell div 2"), "add": F.expr(f"IF(cell % 2 = 0, add, shiftleft(add, {_SECOND}))")})


def _sums(lanes: str) -> Column:
    """Lanes as they are kept: wide ones, then every cell on its own, then the count."""
    s = F.col(lanes)
    wide = F.transform(F.slice(s, 1, WIDE), lambda x: x.bitwiseAND(F.lit(_WIDE_MASK)))
    pairs = F.transform(
        F.slice(s, WIDE + 1, _PAIRS),
        lambda x: F.array(x.bitwiseAND(F.lit(_CELL_MASK)), F.shiftright(x, _SECOND).bitwiseAND(F.lit(_CELL_MASK))),
    )
    return F.concat(wide, F.flatten(pairs), F.slice(s, WIDE + _PAIRS + 1, 1))


def combine(a: str, b: str, sign: int = 1) -> Column:
    """Fingerprint lanes of two multisets together, or (``sign`` -1) of the first without the second."""

    def lane(x, y):
        return x + y * F.lit(sign)

    total = F.zip_with(a, b, lane)
    return F.transform(
        total,
        lambda x, k: F.when(k < WIDE, x.bitwiseAND(F.lit(_WIDE_MASK))).when(k < WIDE + 2 * _PAIRS, x.bitwiseAND(F.lit(_CELL_MASK))).otherwise(x),
    )


def as_text(lanes: str) -> Column:
    """Lanes in hexadecimal, the count in decimal behind a dash."""
    s = F.col(lanes)
    digits = F.transform(F.slice(s, 1, WIDE), lambda x: F.lpad(F.lower(F.hex(x)), _DIGITS, "0"))
    cells = F.transform(F.slice(s, WIDE + 1, 2 * _PAIRS), lambda x: F.lpad(F.lower(F.hex(x)), 4, "0"))
    return F.concat(F.array_join(digits, ""), F.array_join(cells, ""), F.lit("-"), F.element_at(s, -1).cast("string"))


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    # Differing cells of a row to paragraphs behind them; a full row says nothing.
    table = [round(-CELLS * math.log(1 - d / CELLS), 9) for d in range(CELLS)]
    apart = f"transform(zip_with(slice({a}, {WIDE + 1}, {2 * _PAIRS}), slice({b}, {WIDE + 1}, {2 * _PAIRS}), (x, y) -> int(x <> y)), x -> x)"
    rows = f"transform(sequence(0, {LEVELS - 1}), v -> aggregate(slice({apart}, v * {CELLS} + 1, {CELLS}), 0, (n, x) -> n + x))"
    guess = f"array({', '.join(f'{x}D' for x in table)})"
    # The first row whose load lies below twice its cells; from there on rows are added up.
    full = int(CELLS * (1 - math.exp(-2)))
    first = f"coalesce(array_position(transform(d, x -> x <= {full}), true), {LEVELS}L)"
    total = f"aggregate(slice(d, int({first}), {LEVELS}), 0D, (n, x) -> n + get({guess}, least(x, {CELLS - 1}))) * pow(4D, {first} - 1)"
    na, nb = f"element_at({a}, -1)", f"element_at({b}, -1)"
    known = f"get(transform(array({rows}), d -> {total}), 0)"
    differing = f"greatest({known}, double(abs({na} - {nb})), 1D)"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE greatest(0D, 1 - {differing} / greatest({na} + {nb}, 1)) END")


def in_order(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(at, id, text, n) in the order of ids; ``at`` rises within a stored part and from part to part."""
    rows = docs.select(
        F.col(id_col).isNull().alias("none"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("hash", F.xxhash64("text"))
    keys = ["none", "id", "hash", "row"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ranged.select(F.monotonically_increasing_id().alias("at"), "id", "text", F.char_length("text").alias("n")))


def with_next(rows: DataFrame) -> DataFrame:
    """Rows in groups (part, g), numbered by ``o``; a copy of the row after a group's last has ``o`` = ``GROUP``.  The first
    row of all follows the last."""
    own = rows.selectExpr("shiftright(at, 33) AS part", f"at & {(1 << 33) - 1}L AS pos", "id", "text", "n")
    # One row a stored part.
    parts = own.groupBy("part").agg(F.max("pos").alias("last"))
    before = parts.selectExpr(
        "part",
        "coalesce(lag(part) OVER (ORDER BY part), max(part) OVER ()) AS part_before",
        f"coalesce(lag(last) OVER (ORDER BY part), max_by(last, part) OVER ()) div {GROUP} AS g_before",
    )
    heads = own.where("pos = 0").join(materialize(before), "part").selectExpr("part_before AS part", "g_before AS g", f"{GROUP}L AS o", "id", "text", "n")
    inner = f"filter(array(struct(pos div {GROUP} AS g, pos % {GROUP} AS o), struct(pos div {GROUP} - 1 AS g, {GROUP}L AS o)), x -> x.o < {GROUP} OR (pos > 0 AND pos % {GROUP} = 0))"
    return own.selectExpr("part", f"inline({inner})", "id", "text", "n").unionByName(heads)


def fingerprints(docs: DataFrame, share: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  The edited text
    has its last 1/``share`` replaced by the beginning of the next document."""
    group = ["part", "g"]
    following = f"OVER (PARTITION BY part, g ORDER BY o)"
    rows = with_next(in_order(docs, id_col, text)).repartition(*group)
    rows = rows.selectExpr("*", f"n - n div {share} AS keep", f"lead(text) {following} AS next")
    rows = rows.selectExpr("*", "left(text, keep) AS kept", f"coalesce(left(next, n div {share}), '') AS begin")
    # What stays whole ends behind the last mark of the kept part.
    rows = rows.selectExpr("*", f"length(kept) - length(regexp_extract(reverse(kept), r'^[^{ENDS}]*', 0)) AS whole")
    rows = rows.selectExpr(
        "part", "g", "o", "id", "n", "sha2(concat(kept, begin), 256) AS edited_sha256",
        "array(left(text, whole), substr(text, whole + 1), concat(substr(kept, whole + 1), begin)) AS pieces",
    )
    some = paragraphs("p")
    each = rows.selectExpr("part", "g", "o", "id", "n", "edited_sha256", "posexplode_outer(pieces) AS (piece, p)").selectExpr(
        "part", "g", "o", "id", "n", "edited_sha256", "piece", f"explode_outer(IF(p = '', array(''), {some})) AS u"
    )
    keys = ["part", "g", "o", "id", "n", "edited_sha256", "piece"]
    summed = _placed(each).groupBy(*keys).agg(*_lanes())
    lanes = summed.select(*keys, F.array(*[f"s{k}" for k in range(WIDE + _PAIRS + 1)]).alias("lanes")).withColumn("lanes", _sums("lanes"))
    lead = [f"lead(lanes, {k}) OVER (PARTITION BY part, g ORDER BY o, piece) AS {name}" for k, name in ((1, "tail"), (2, "new"), (3, "next0"), (4, "next1"))]
    met = lanes.selectExpr(*keys, "lanes", *lead).where(f"piece = 0 AND o < {GROUP}")
    met = met.withColumns({"own": combine("lanes", "tail"), "edited": combine("lanes", "new"), "after": combine("next0", "next1")})
    return met.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text("own").alias("fingerprint"),
        as_text("edited").alias("edited_fingerprint"),
        F.round(likeness("own", "edited"), 6).alias("near_edited"),
        F.round(likeness("own", "after"), 6).alias("near_next"),
    )
