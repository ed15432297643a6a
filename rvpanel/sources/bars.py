"""Daily bars: reading, building from ticks, checking, caching per symbol."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rvpanel.functions import clean_double, safe_name
from rvpanel.schema import BARS, BASKET
from rvpanel.sources.store import materialize

# The default basket of symbols.  ^VIX is context, not a forecast target.
DEFAULT_BASKET = [
    "AAPL", "MSFT", "NVDA", "GOOGL", "META", "AMZN", "CRM", "ORCL",
    "JPM", "BAC", "GS", "MS", "V",
    "UNH", "JNJ", "PFE", "LLY",
    "XOM", "CVX", "CAT", "GE", "BA",
    "WMT", "HD", "MCD", "PG", "KO", "DIS",
    "XLF", "XLE", "XLK", "XLV", "XLI", "SPY",
    "^VIX",
]
CONTEXT_SYMBOLS = ["^VIX"]

# Column names in vendor files and the names used here.
VENDOR_NAMES = {
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
    "Date": "date",
    "Symbol": "symbol",
    "Ticker": "symbol",
}


def basket(
    spark: SparkSession, symbols: Iterable[str] | None = None, context: Iterable[str] = CONTEXT_SYMBOLS
) -> DataFrame:
    """Basket dimension (symbol, is_target), a row per distinct symbol.  No symbols, or an empty list, mean all."""
    chosen = list(dict.fromkeys(symbols or [])) or DEFAULT_BASKET
    context = set(context)
    return spark.createDataFrame([(s, s not in context) for s in chosen], BASKET)


def read_basket(spark: SparkSession, path: str, context: Iterable[str] = CONTEXT_SYMBOLS) -> DataFrame:
    """Basket from the ``- NAME`` items under the key ``tickers:`` of a settings file; other lists are left alone."""
    whole = spark.read.text(path, wholetext=True)
    # The key's block: lines up to the next one that starts with neither space, dash nor comment.
    block = F.regexp_extract("value", r"(?m)^tickers:[^\n]*\n((?:[ \t\-#][^\n]*(?:\n|$)|\s*\n)*)", 1)
    line = whole.select(F.explode(F.split(block, r"\r?\n")).alias("value"))
    name = F.regexp_extract("value", r"""^\s*-\s*["']?([^"'#\s]+)""", 1).alias("symbol")
    listed = line.select(name).where(F.col("symbol") != "").distinct()
    return listed.select("symbol", (~F.col("symbol").isin(list(context))).alias("is_target"))


def in_basket(df: DataFrame, symbols: DataFrame, targets_only: bool = False) -> DataFrame:
    """Rows of the basket's symbols."""
    wanted = symbols.where("is_target") if targets_only else symbols
    return df.join(wanted.select("symbol"), "symbol", "left_semi")


def read_bars(spark: SparkSession, path: str, source: str = "parquet", **options: str) -> DataFrame:
    """Landed vendor files as bars, NaN as NULL.

    Columns are found by name, in vendor spelling (``VENDOR_NAMES``) or that of ``BARS``, in any order: the header
    of CSV files, the fields of JSON lines.  Without a symbol column the file's name is the symbol, as in a
    folder of one file per symbol.  Text that is no number or date becomes NULL; a file without dates
    or prices is an error.  Dates that pandas stored in nanoseconds need
    ``spark.sql.legacy.parquet.nanosAsLong``.
    """
    reader = spark.read.options(**options)
    if source == "csv":
        landed = reader.option("header", options.get("header", "true")).csv(path)
    elif source == "json":
        landed = reader.option("primitivesAsString", "true").json(path)
    else:
        landed = reader.format(source).load(path)
    if not {"symbol", "Symbol", "Ticker"} & set(landed.columns):
        name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
        landed = landed.withColumn("symbol", name)
    return as_bars(landed)


def as_bars(df: DataFrame) -> DataFrame:
    """Columns renamed, cast and cleaned to ``BARS``; columns that are not there are NULL, but dates
    and a price there must be."""
    renamed = df.withColumnsRenamed({k: v for k, v in VENDOR_NAMES.items() if k in df.columns})
    if "date" not in renamed.columns or not {"adj_close", "close"} & set(renamed.columns):
        raise ValueError(f"no date or no closing price among the columns {df.columns}")
    if isinstance(renamed.schema["date"].dataType, T.LongType):
        renamed = renamed.withColumn("date", F.timestamp_micros(F.expr("date div 1000")))

    def conform(f: T.StructField) -> Column:
        if f.name not in renamed.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        value = F.col(f.name)
        if isinstance(renamed.schema[f.name].dataType, T.StringType):
            value = value.try_cast("double").try_cast(f.dataType) if isinstance(f.dataType, T.LongType) else value.try_cast(f.dataType)
        value = clean_double(value) if isinstance(f.dataType, T.DoubleType) else value.cast(f.dataType)
        return value.alias(f.name)

    return renamed.select(*[conform(f) for f in BARS])


def build_bars(ticks: DataFrame, interval: str = "1 day", tie: str | None = None) -> DataFrame:
    """Ticks (symbol, ts, px, ...) to one open/high/low/close/volume bar per interval.

    Ticks are combined before the shuffle, so a hot symbol costs no more than its bars.
    ``tie`` names an integer column that orders ticks of the same instant.
    """
    # One fixed-width number orders the ticks: a struct would make Spark sort all of them
    # (SortAggregate) where this keeps a hash aggregation.
    at = F.col("ts")
    if tie:
        micros = "CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DECIMAL(18, 0))"
        at = F.expr(f"{micros} * CAST(2e19 AS DECIMAL(20, 0)) + CAST({tie} AS DECIMAL(19, 0))")
    bars = ticks.groupBy("symbol", F.window("ts", interval).alias("_w")).agg(
        F.min_by("px", at).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", at).alias("close"),
        F.count("*").alias("volume"),
    )
    return bars.select("symbol", F.col("_w.start").alias("date"), "open", "high", "low", "close", "volume")


def price_panel(bars: DataFrame, price: str = "adj_close") -> DataFrame:
    """Bars to the (symbol, date, px) panel of usable prices."""
    px = clean_double(price)
    return bars.select("symbol", "date", F.when(px > 0, px).alias("px"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Replace the stored bars of the symbols that arrive; others stay untouched.

    Folders are named by the safe name, files keep the symbol as it is; symbols that would share a folder are
    an error.  Rows are spread by symbol and year, so that one symbol is not one writing task.
    """
    clash = name_collisions(bars).first()
    if clash:
        raise ValueError(f"symbols {clash['symbols']} share the directory name {clash['safe_name']!r}")
    out = bars.withColumn("safe_name", safe_name("symbol"))
    (
        out.repartition("safe_name", F.year("date"))
        .write.partitionBy("safe_name")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def read_series(spark: SparkSession, path: str, symbol: str, column: str = "adj_close") -> DataFrame:
    """One column of one cached symbol: reads that symbol's files and that column only."""
    stored = spark.read.schema(T.StructType([*BARS, T.StructField("safe_name", T.StringType())])).parquet(path)
    mine = (F.col("safe_name") == symbol.replace("^", "")) & (F.col("symbol") == symbol)
    return stored.where(mine).select("symbol", "date", column)


def read_cached(
    spark: SparkSession, path: str, symbols: DataFrame, column: str = "adj_close", targets_only: bool = False
) -> DataFrame:
    """One column of the cached bars of a basket.  Which folders are read is settled when the query runs, from the basket itself
    (dynamic partition pruning); nothing of it goes through the driver."""
    stored = spark.read.schema(T.StructType([*BARS, T.StructField("safe_name", T.StringType())])).parquet(path)
    wanted = symbols.where("is_target" if targets_only else "symbol IS NOT NULL")
    wanted = wanted.select(F.col("symbol").alias("_symbol"), safe_name("symbol").alias("safe_name")).distinct()
    # Pruning at run time needs a filter on the basket's side that Spark takes for selective.
    wanted = wanted.where("_symbol LIKE '%'")
    return stored.join(wanted, "safe_name").where("symbol = _symbol").select("symbol", "date", column)


def name_collisions(symbols: DataFrame) -> DataFrame:
    """Directory names that more than one symbol maps to (none, if all is well)."""
    return (
        symbols.select("symbol")
        .distinct()
        .groupBy(safe_name("symbol").alias("safe_name"))
        .agg(F.count("*").alias("n_symbols"), F.array_sort(F.collect_set("symbol")).alias("symbols"))
        .where(F.col("n_symbols") > 1)
    )


def ingest_status(symbols: DataFrame, bars: DataFrame, price: str = "adj_close") -> DataFrame:
    """One row per basket symbol: ``ok``, ``n_rows`` and the first fault found.

    A bad symbol is reported here and never stops the others.  Rows without a date are a fault: they have
    no place in a series.
    """
    bad = F.coalesce(F.col(price) <= 0, F.lit(False))
    per_date = bars.groupBy("symbol", "date").agg(F.count("*").alias("_rows"), F.count_if(bad).alias("_bad"))
    found = per_date.groupBy("symbol").agg(
        F.sum("_rows").alias("n_rows"),
        F.sum("_bad").alias("_bad"),
        F.count_if((F.col("_rows") > 1) & F.col("date").isNotNull()).alias("_repeated"),
        F.sum(F.when(F.col("date").isNull(), F.col("_rows")).otherwise(0)).alias("_undated"),
    )
    n = F.coalesce("n_rows", F.lit(0))
    error = (
        F.when(n == 0, F.concat(F.lit("no data for "), F.col("symbol")))
        .when(F.col("_undated") > 0, F.concat(F.col("_undated").cast("string"), F.lit(" rows without a date")))
        .when(F.col("_bad") > 0, F.concat(F.col("_bad").cast("string"), F.lit(" non-positive prices")))
        .when(F.col("_repeated") > 0, F.concat(F.col("_repeated").cast("string"), F.lit(" repeated dates")))
    )
    status = symbols.select("symbol").join(found, "symbol", "left").withColumn("error", error)
    return status.select("symbol", F.col("error").isNull().alias("ok"), n.alias("n_rows"), "error")


def ingest_summary(status: DataFrame) -> DataFrame:
    """Number of symbols ingested, of all symbols, and the sorted names of those that failed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("symbol"))))
    return status.agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n_total"), failed.alias("failed"))


def ingest_basket(
    spark: SparkSession,
    bars: DataFrame,
    path: str,
    symbols: Iterable[str] | None = None,
    price: str = "adj_close",
) -> DataFrame:
    """Store the good symbols of the basket under ``path`` and return the status rows."""
    wanted = basket(spark, symbols)
    clash = name_collisions(wanted).first()
    if clash:
        raise ValueError(f"symbols {clash['symbols']} share the directory name {clash['safe_name']!r}")
    # Stored: the checks run once, for the rows to write and for the caller.
    status = materialize(ingest_status(wanted, in_basket(bars, wanted), price))
    write_bars(bars.join(status.where("ok").select("symbol"), "symbol", "left_semi"), path)
    return status


def coverage(df: DataFrame) -> DataFrame:
    """Row count, first and last date per symbol."""
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def head(df: DataFrame, symbol: str, rows: int = 3) -> DataFrame:
    """The symbol's first rows by date."""
    return df.where(F.col("symbol") == symbol).orderBy("date").limit(rows)
