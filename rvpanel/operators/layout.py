"""How panel rows are spread over the cluster.

A window partitioned by ``symbol`` alone puts a hot symbol into one task.  No
row-level window here does that.  Rows are keyed twice instead:

* ``number`` finds each row's exact position ``i`` in its symbol (and the
  symbol's length ``n``) by ranking inside calendar buckets and adding the
  bucket's start, taken from a running sum over the small bucket table.
* ``blocks`` cuts the positions into blocks of ``size`` rows and copies the
  neighbouring rows a frame reaches into (the halo).  Windows then run per
  ``(symbol, block)``, a group bounded by ``size + before + after`` rows, and
  ``own_rows`` drops the copies.
* ``renumber`` numbers what a filter leaves of such rows where they are: survivors are
  counted per block and the block table is summed up, in two levels.  So operators that
  follow each other share one layout.

Working columns start with an underscore; ``public`` removes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096

# Width of a calendar bucket in days.  Dates are unique in a symbol, so a bucket of
# daily bars holds at most this many rows; intraday bars get one bucket per day.
DAILY_BUCKET_DAYS = 4096
INTRADAY_BUCKET_DAYS = 1

# Blocks that are summed up together before their sums are carried along a symbol.
SUPER_BLOCKS = 256

_BUCKET = ["symbol", "_bucket"]
_BLOCK = ["symbol", "_block"]


def public(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def group_table(rows: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregate rows that are already clustered by ``keys``; one small row per group.

    The fingerprint makes this branch need the same columns as the rows it is later
    joined to.  Both then have the same shuffle below them and Spark runs it once
    (ReusedExchange) instead of computing the input a second time.
    """
    fingerprint = F.expr(f"max(hash({', '.join(f'`{c}`' for c in rows.columns)}))").alias("_fingerprint")
    return rows.groupBy(*keys).agg(*aggs, fingerprint).where("_fingerprint IS NOT NULL").drop("_fingerprint")


def missing_keys(df: DataFrame) -> DataFrame:
    """One row: ``n_rows``, and how many of them lack a ``symbol`` or a ``date``.  Such rows have no position, so no
    operator keeps them; ``keyed(strict=True)`` makes them an error."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("symbol").isNull()).alias("n_without_symbol"),
        F.count_if(F.col("date").isNull()).alias("n_without_date"),
    )


def keyed(df: DataFrame, strict: bool = False) -> DataFrame:
    """The rows that have a symbol and a date; with ``strict`` a row that lacks one is an error."""
    if not strict:
        return df.where("symbol IS NOT NULL AND date IS NOT NULL")
    # The keys themselves raise the error, so no filter on them can come before it.
    for key in ("symbol", "date"):
        fault = F.raise_error(F.lit(f"a row without a {key}")).cast(df.schema[key].dataType)
        df = df.withColumn(key, F.when(F.col(key).isNull(), fault).otherwise(F.col(key)))
    return df


def _clustered(df: DataFrame, keys: list[str]) -> DataFrame:
    # Joins add "key IS NOT NULL" to the side they can push it into; stating it for
    # every reader keeps the shuffles below alike, so that they are reused.
    return df.where(" AND ".join(f"{key} IS NOT NULL" for key in keys)).repartition(*keys)


def bucketed(df: DataFrame) -> DataFrame:
    """Cluster rows by (symbol, calendar bucket); a no-op on rows that already are."""
    if "_bucket" in df.columns:
        return df
    daily = isinstance(df.schema["date"].dataType, T.DateType)
    width = DAILY_BUCKET_DAYS if daily else INTRADAY_BUCKET_DAYS
    bucket = F.floor(F.unix_date(F.to_date("date")) / F.lit(width))
    return _clustered(df.withColumn("_bucket", bucket), _BUCKET)


def with_previous(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Add the value of ``column`` one row earlier in the symbol (NULL on the first row).

    Inside a bucket this is ``lag``; a bucket's first row takes the last value of the
    symbol's bucket before it.
    """
    rows = bucketed(df)
    last = group_table(rows, _BUCKET, F.max_by(column, "date").alias("_last"))
    carry = last.select(
        *_BUCKET,
        F.lag("_last").over(Window.partitionBy("symbol").orderBy("_bucket")).alias("_carry"),
    )
    w = Window.partitionBy(*_BUCKET).orderBy("date")
    local = rows.withColumn("_lag", F.lag(column).over(w)).withColumn("_rn", F.row_number().over(w))
    value = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return local.join(carry, _BUCKET).select(*rows.columns, value.alias(alias))


def is_numbered(df: DataFrame) -> bool:
    return {"i", "n"} <= set(df.columns)


def number(df: DataFrame) -> DataFrame:
    """Add ``i``, the 0-based position in the symbol, and ``n``, the symbol's row count.

    A frame that has both columns is taken to be numbered; drop them after filtering it.
    """
    if is_numbered(df):
        return df
    rows = bucketed(df)
    starts = bucket_starts(group_table(rows, _BUCKET, F.expr("count(*)").alias("_count")))
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY symbol, _bucket ORDER BY date) AS _rank")
    return ranked.join(starts, _BUCKET).selectExpr(*rows.columns, "_start + _rank - 1L AS i", "n")


def bucket_starts(counts: DataFrame) -> DataFrame:
    """Bucket table (symbol, _bucket, _count) to each bucket's start and the symbol's total."""
    others = [c for c in counts.columns if c not in (*_BUCKET, "_count")]
    before = "PARTITION BY symbol ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return counts.selectExpr(
        *_BUCKET,
        *others,
        f"coalesce(sum(_count) OVER ({before}), 0L) AS _start",
        "sum(_count) OVER (PARTITION BY symbol) AS n",
    )


def number_changes(df: DataFrame, value: str, change: Callable[[str, str], str], alias: str) -> DataFrame:
    """``change(value, previous value)`` of consecutive rows, with the rows that have none
    left out and the rest numbered: ``with_previous``, a filter and ``number`` in one pass.
    ``change`` turns two SQL names into an SQL expression.
    """
    rows = bucketed(df)
    in_bucket = "PARTITION BY symbol, _bucket ORDER BY date"
    local = rows.selectExpr(
        "*", f"lag({value}) OVER ({in_bucket}) AS _lag", f"row_number() OVER ({in_bucket}) AS _rn"
    )
    table = group_table(
        local,
        _BUCKET,
        F.expr(f"count_if(_rn > 1 AND {change(value, '_lag')} IS NOT NULL)").alias("_inner"),
        F.expr(f"min_by({value}, date)").alias("_first"),
        F.expr(f"max_by({value}, date)").alias("_last"),
    )
    carried = table.selectExpr("*", "lag(_last) OVER (PARTITION BY symbol ORDER BY _bucket) AS _carry")
    starts = bucket_starts(
        carried.selectExpr(*_BUCKET, "_carry", f"_inner + int({change('_first', '_carry')} IS NOT NULL) AS _count")
    )
    changed = local.join(starts, _BUCKET).selectExpr(
        *rows.columns,
        "_start",
        "n",
        f"CASE WHEN _rn = 1 THEN {change(value, '_carry')} ELSE {change(value, '_lag')} END AS {alias}",
    )
    rank = f"count({alias}) OVER ({in_bucket} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    numbered = changed.selectExpr(*rows.columns, "n", alias, f"_start + {rank} - 1L AS i")
    return numbered.where(f"{alias} IS NOT NULL")


def blocks(numbered: DataFrame, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Give every block of ``size`` positions its own rows, plus the ``before`` rows
    ahead of it and the ``after`` rows behind it as copies."""
    size = size or BLOCK_ROWS
    own = f"i div {size}L"
    first = f"greatest(i - {after}L, 0L) div {size}L"
    last = f"least(i + {before}L, n - 1L) div {size}L"
    kept = [c for c in numbered.columns if c not in ("_bucket", "_block", "_own")]
    target = f"explode(sequence({first}, {last}))" if before or after else own
    return _clustered(numbered.selectExpr(*kept, f"{own} AS _own", f"{target} AS _block"), _BLOCK)


def in_blocks(df: DataFrame) -> bool:
    """Whether the rows carry the block they were laid out in."""
    return "_block" in df.columns and is_numbered(df)


def block_starts(counts: DataFrame) -> DataFrame:
    """Block table (symbol, _block, _count) to each block's start and the symbol's total.

    Two levels: inside super-blocks, then over super-blocks, so that no task takes all blocks of a symbol.
    """
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    inner = counts.selectExpr(*_BLOCK, "_count", f"_block div {SUPER_BLOCKS}L AS _super").selectExpr(
        *_BLOCK, "_super", "_count", f"coalesce(sum(_count) OVER (PARTITION BY symbol, _super ORDER BY _block {earlier}), 0L) AS _inside"
    )
    supers = inner.groupBy("symbol", "_super").agg(F.sum("_count").alias("_sum"))
    supers = supers.selectExpr(
        "symbol",
        "_super",
        f"coalesce(sum(_sum) OVER (PARTITION BY symbol ORDER BY _super {earlier}), 0L) AS _outside",
        "sum(_sum) OVER (PARTITION BY symbol) AS n",
    )
    return inner.join(supers, ["symbol", "_super"]).selectExpr(*_BLOCK, "_outside + _inside AS _start", "n")


def renumber(rows: DataFrame) -> DataFrame:
    """``i`` and ``n`` anew for rows that a filter left in their blocks; the rows stay where they are."""
    starts = block_starts(block_table(rows, F.expr("count(*)").alias("_count")))
    ranked = rows.selectExpr("*", "row_number() OVER (PARTITION BY symbol, _block ORDER BY i) AS _rank")
    kept = [c for c in rows.columns if c not in ("i", "n", "_own")]
    return join_blocks(ranked, starts).selectExpr(*kept, "_start + _rank - 1L AS i", "n")


def block_window() -> WindowSpec:
    return Window.partitionBy(*_BLOCK).orderBy("i")


def is_own() -> Column:
    return F.col("_own") == F.col("_block")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(is_own())


def block_table(laid: DataFrame, *aggs: Column) -> DataFrame:
    return group_table(laid, _BLOCK, *aggs)


def join_blocks(laid: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Join a (symbol, block) table to block rows; only the table moves."""
    return laid.join(table, _BLOCK, how)


def join_symbols(laid: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Join a table with one row per symbol to block rows.

    A plain join on ``symbol`` would gather a hot symbol's rows in one task.  The table
    is copied to the symbol's blocks first, so the rows stay where they are.
    """
    per_block = block_table(laid).join(table, "symbol")
    return join_blocks(laid, per_block, how)
