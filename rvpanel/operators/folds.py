"""Expanding walk-forward folds with an embargo, as arithmetic on row positions.

For ``n`` rows, ``K`` folds and horizon ``h``: test blocks of ``size = n div (K+1)`` rows
fill the end of the series, fold f tests ``[n - (K-f)*size, +size)`` and trains on every
row that lies ``h`` rows or more before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rvpanel.operators.layout import bucket_starts, bucketed, group_table, number

CALENDAR = "*"


def _sizes(df: DataFrame, n_splits: int, horizon: int, strict: bool) -> DataFrame:
    size = f"n div {n_splits + 1}L"
    possible = f"{size} > 0 AND n - {horizon}L - {n_splits}L * ({size}) > 0"
    if strict:
        possible = f"({possible}) OR boolean(raise_error('too few rows for the folds of ' || symbol))"
    return df.where(possible).selectExpr("*", f"{size} AS _size")


def fold_bounds(
    index: DataFrame, n_splits: int = 5, horizon: int = 5, min_train_size: int = 252, strict: bool = False
) -> DataFrame:
    """One row per symbol and fold: ``n, train_end, test_start, test_end`` (ends exclusive).

    A fold with fewer than ``min_train_size`` train rows is left out but keeps its number.
    A symbol too short for ``n_splits`` folds has none, or is an error with ``strict``.
    """
    counts = index.groupBy("symbol").agg(F.count("*").alias("n"))
    return bounds_of_counts(counts, n_splits, horizon, min_train_size, strict)


def bounds_of_counts(
    counts: DataFrame, n_splits: int, horizon: int, min_train_size: int, strict: bool = False
) -> DataFrame:
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    start = F.col("n") - (F.lit(n_splits) - F.col("fold")) * F.col("_size")
    return (
        _sizes(counts, n_splits, horizon, strict)
        .select("symbol", "n", "_size", folds)
        .select(
            "symbol",
            "fold",
            "n",
            (start - horizon).alias("train_end"),
            start.alias("test_start"),
            (start + F.col("_size")).alias("test_end"),
        )
        .where(F.col("train_end") >= min_train_size)
    )


def test_rows(
    numbered: DataFrame, n_splits: int = 5, horizon: int = 5, min_train_size: int = 252, strict: bool = False
) -> DataFrame:
    """Rows of the test blocks with ``fold`` and ``train_end``.  Test blocks do not
    overlap, so no row is repeated and nothing is joined."""
    return (
        _sizes(numbered, n_splits, horizon, strict)
        .where(f"i >= n - {n_splits}L * _size")
        .selectExpr("*", f"int((i - (n - {n_splits}L * _size)) div _size) AS fold")
        .selectExpr(*numbered.columns, "fold", f"n - ({n_splits}L - fold) * _size - {horizon}L AS train_end")
        .where(f"train_end >= {min_train_size}L")
    )


def inner_train_end(train_end: Column, val_frac: float) -> Column:
    """First validation position: the last ``int(train_end * val_frac)`` train rows are
    validation."""
    return train_end - F.floor(train_end * F.lit(float(val_frac)))


def train_rows(
    numbered: DataFrame,
    n_splits: int = 5,
    horizon: int = 5,
    min_train_size: int = 252,
    val_frac: float = 0.2,
    inner_gap: int = 0,
) -> DataFrame:
    """Train rows of every fold (a row repeats once per fold it trains), with ``part``
    'train' or 'validation'.  ``inner_gap`` rows before the validation part are left out.
    """
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    rows = (
        _sizes(numbered, n_splits, horizon, False)
        .withColumn("fold", folds)
        .withColumn("train_end", F.col("n") - (F.lit(n_splits) - F.col("fold")) * F.col("_size") - horizon)
        .where((F.col("train_end") >= min_train_size) & (F.col("i") < F.col("train_end")))
        .withColumn("inner_end", inner_train_end(F.col("train_end"), val_frac))
        .drop("_size")
    )
    part = F.when(F.col("i") >= F.col("inner_end"), "validation").when(
        F.col("i") < F.col("inner_end") - inner_gap, "train"
    )
    return rows.withColumn("part", part).where(F.col("part").isNotNull())


def check_val_frac(val_frac: float) -> None:
    if not 0 < val_frac < 1:
        raise ValueError(f"val_frac must lie strictly between 0 and 1, got {val_frac}")


def number_by_calendar(df: DataFrame) -> DataFrame:
    """Add ``i`` and ``n`` counted on the panel's distinct dates instead of each symbol's
    rows, so that no symbol's train rows come after another's test rows."""
    dates = df.select("date").distinct().withColumn("symbol", F.lit(CALENDAR))
    calendar = number(dates).select("date", "i", "n")
    return df.join(calendar, "date")


def fold_dates(numbered: DataFrame, bounds: DataFrame) -> DataFrame:
    """First and last date of both sides of each fold, found by position."""
    wanted = bounds.select(
        "symbol",
        "fold",
        F.explode(
            F.array(
                F.struct(F.lit("train_first").alias("edge"), F.lit(0).cast("long").alias("i")),
                F.struct(F.lit("train_last").alias("edge"), (F.col("train_end") - 1).alias("i")),
                F.struct(F.lit("test_first").alias("edge"), F.col("test_start").alias("i")),
                F.struct(F.lit("test_last").alias("edge"), (F.col("test_end") - 1).alias("i")),
            )
        ).alias("_at"),
    ).select("symbol", "fold", "_at.edge", "_at.i")
    edges = ["train_first", "train_last", "test_first", "test_last"]
    found = numbered.select("symbol", "i", "date").join(wanted, ["symbol", "i"])
    return found.groupBy("symbol", "fold").agg(
        *[F.max(F.when(F.col("edge") == e, F.col("date"))).alias(e) for e in edges]
    )


def rows_before(index: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (symbol, date): the number of index rows dated before it.

    Points and rows are laid out together: a running count inside the calendar bucket, plus the rows of the
    symbol's earlier buckets from the bucket table.  Nothing is compared pair by pair.
    """
    asked = points.select("symbol", "date").distinct().withColumn("_is_row", F.lit(0))
    rows = bucketed(index.select("symbol", "date").withColumn("_is_row", F.lit(1)).unionByName(asked))
    starts = bucket_starts(group_table(rows, ["symbol", "_bucket"], F.expr("sum(_is_row)").alias("_count")))
    # A point comes before the rows of its own date.
    so_far = "PARTITION BY symbol, _bucket ORDER BY date, _is_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    running = rows.selectExpr("*", f"sum(_is_row) OVER ({so_far}) AS _here").where("_is_row = 0")
    return running.join(starts, ["symbol", "_bucket"]).selectExpr("symbol", "date", "_start + _here AS before")


def fold_violations(index: DataFrame, folds: DataFrame, horizon: int, strict: bool = False) -> DataFrame:
    """Faults of any fold table (symbol, fold, train_last, test_first): one row per fault.

    'overlap': the test block starts on or before the last train date.  'embargo': fewer
    than ``horizon`` index rows lie strictly between the two.
    """
    bounds = folds.select("symbol", "fold", "train_last", "test_first")
    points = bounds.select("symbol", F.col("train_last").alias("date")).union(
        bounds.select("symbol", F.col("test_first").alias("date"))
    )
    positions = rows_before(index, points)
    held = index.select("symbol", "date").join(
        bounds.select("symbol", F.col("train_last").alias("date")).distinct(), ["symbol", "date"], "left_semi"
    )
    last = positions.join(held.withColumn("_held", F.lit(1)), ["symbol", "date"], "left").select(
        "symbol",
        F.col("date").alias("train_last"),
        (F.col("before") + F.coalesce("_held", F.lit(0))).alias("_upto"),
    )
    first = positions.select("symbol", F.col("date").alias("test_first"), F.col("before").alias("_before"))
    gaps = (
        bounds.join(last, ["symbol", "train_last"])
        .join(first, ["symbol", "test_first"])
        .withColumn("gap_rows", F.greatest(F.col("_before") - F.col("_upto"), F.lit(0)))
    )
    overlap = F.when(
        F.col("test_first") <= F.col("train_last"),
        F.concat(
            # Fixed value: these first words.
            F.lit("test starts at "),
            F.col("test_first").cast("string"),
            F.lit(", which is not after the last train date "),
            F.col("train_last").cast("string"),
        ),
    )
    embargo = F.when(
        F.col("gap_rows") < horizon,
        F.concat(F.lit("gap is "), F.col("gap_rows").cast("string"), F.lit(f" of at least {horizon} rows")),
    )
    faults = gaps.select(
        "symbol",
        "fold",
        "train_last",
        "test_first",
        "gap_rows",
        F.when(overlap.isNotNull(), "overlap").otherwise("embargo").alias("fault"),
        F.coalesce(overlap, embargo).alias("message"),
    ).where(F.col("message").isNotNull())
    if strict:
        faults = faults.where(F.raise_error(F.col("message")).cast("boolean"))
    return faults


def last_fold(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of each symbol's highest fold; ``bounds`` is the (small) fold table."""
    top = bounds.groupBy("symbol").agg(F.max("fold").alias("_top"))
    keys = top.select("symbol", F.col("_top").alias("fold"))
    return df.join(keys, ["symbol", "fold"], "left_semi")


def select_dates(df: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """Rows whose (symbol, date) is among ``labels``.  With ``strict`` a label without a
    row is an error."""
    keys = ["symbol", "date"]
    wanted = labels.select(*keys).distinct()
    if not strict:
        return df.join(wanted, keys, "left_semi")
    found = df.withColumn("_found", F.lit(True))
    missing = F.concat(F.lit("no row for "), F.col("symbol"), F.lit(" "), F.col("date").cast("string"))
    checked = wanted.join(found, keys, "left").where(
        F.col("_found").isNotNull() | F.raise_error(missing).cast("boolean")
    )
    return checked.select(*df.columns)
