"""Queries over the driver's tables, each with the DuckDB SQL that must agree with it.

The tables hold no prices, so panels are derived from them: daily volume-weighted prices
of ``lineitem`` per return flag and line status (or per supplier nation), and bars built
from ``events``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rvpanel.config import settings_from
from rvpanel.operators import features as fe
from rvpanel.operators import folds as fo
from rvpanel.operators import garch as ga
from rvpanel.operators.ewma import ewma_forecast
from rvpanel.operators.layout import number
from rvpanel.operators.learned import learned_forecasts, train_final_model
from rvpanel.operators.packed import pack
from rvpanel.operators.scaling import apply_scaler, fit_scaler
from rvpanel.plans import backtest as bt
from rvpanel.plans import runs
from rvpanel.plans.learned import evaluate_all, evaluate_learned, learned_beside
from rvpanel.plans.runs import best_run
from rvpanel.schema import FEATURES
from rvpanel.sources import bars as ba
from rvpanel.sources.store import materialize, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# --- panels ------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str) -> Column:
    # Whole cents add up to the same sum in whatever order tasks finish.
    return F.rint(F.col(column) * 100).cast("long")


def vwap_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.concat("l_returnflag", "l_linestatus").alias("symbol")
    px = (F.sum(_cents("l_extendedprice")) / 100 / F.sum("l_quantity")).alias("px")
    return table(spark, sf_dir, "lineitem").groupBy(symbol, F.to_date("l_shipdate").alias("date")).agg(px)


def vwap_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier nation.  Line items meet their supplier first: a supplier has too few of
    them per day for summing beforehand to shrink anything."""
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("symbol")
    )
    px = (F.sum(_cents("l_extendedprice")) / 100 / F.sum("l_quantity")).alias("px")
    items = table(spark, sf_dir, "lineitem").join(suppliers, "l_suppkey")
    return items.groupBy("symbol", F.to_date("l_shipdate").alias("date")).agg(px)


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").where(F.col("value") > 0)
    return ticks.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("px"))


def event_bars(spark: SparkSession, sf_dir: str, interval: str = "1 hour") -> DataFrame:
    return ba.build_bars(event_ticks(spark, sf_dir), interval, tie="event_id")


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir).select("symbol", "date", F.col("close").alias("px"))


_PANEL = """panel AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS px
  FROM lineitem GROUP BY 1, 2)"""
_NATION_PANEL = """panel AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS px
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""
_HOURLY_PANEL = """panel AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS date, arg_max(value, ts) AS px
  FROM events WHERE value > 0 GROUP BY 1, 2)"""
_RET = """ret AS (
  SELECT symbol, date, px, ln(px / lag(px) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM panel)"""
_IDX = """idx AS (
  SELECT symbol, date, r, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM ret WHERE r IS NOT NULL)"""


def _rolling(value: str, rows: int, frame: str, part: str = "symbol", order: str = "date") -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {frame})"
    return f"(CASE WHEN count({value}) {over} = {rows} THEN stddev_samp({value}) {over} * sqrt(252.0::DOUBLE) END)"


def _feature_sql(h: int = 5) -> str:
    cols = ", ".join(f"{_rolling('r', n, f'{n - 1} PRECEDING AND CURRENT ROW')} AS rv_{n}d" for n in (5, 20, 60))
    target = _rolling("r", h, f"1 FOLLOWING AND {h} FOLLOWING")
    return f"""feat AS (SELECT * FROM (
  SELECT symbol, date, r AS log_returns, {cols}, {target} AS rv_target FROM ret)
  WHERE log_returns IS NOT NULL AND rv_5d IS NOT NULL AND rv_20d IS NOT NULL
    AND rv_60d IS NOT NULL AND rv_target IS NOT NULL),
fidx AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
         count(*) OVER (PARTITION BY symbol) AS n FROM feat)"""


def _ewma_sql(source: str = "idx", span: float = 32.0, value: str = "r") -> str:
    d = f"({span - 1}::DOUBLE / {span + 1}::DOUBLE)"
    return f"""sums AS (
  SELECT t.symbol, t.i, sum(pow({d}, t.i - s.i)) AS w1, sum(pow({d}, 2 * (t.i - s.i))) AS w2,
         sum(pow({d}, t.i - s.i) * s.{value}) AS s1, sum(pow({d}, t.i - s.i) * s.{value} * s.{value}) AS s2
  FROM {source} t JOIN {source} s ON s.symbol = t.symbol AND s.i <= t.i GROUP BY 1, 2),
ewma AS (
  SELECT symbol, i, CASE WHEN i >= 1 THEN
    sqrt(greatest((s2 / w1 - (s1 / w1) * (s1 / w1)) * (w1 * w1) / (w1 * w1 - w2), 0)) * sqrt(252.0::DOUBLE) END AS ewma
  FROM sums)"""


# Test rows of the default folds (K = 5, horizon 5, at least 252 train rows).
_TESTED = f"""cast_ AS (
  SELECT symbol, date, i, n, n // 6 AS sz,
         {_rolling("r", 5, "1 FOLLOWING AND 5 FOLLOWING")} AS actual,
         {_rolling("r", 5, "4 PRECEDING AND CURRENT ROW")} AS naive
  FROM idx),
tested AS (
  SELECT symbol, date, i, CAST((i - (n - 5 * sz)) // sz AS INTEGER) AS fold, actual, naive
  FROM cast_
  WHERE sz > 0 AND n - 5 - 5 * sz > 0 AND i >= n - 5 * sz AND actual IS NOT NULL
    AND n - (5 - (i - (n - 5 * sz)) // sz) * sz - 5 >= 252)"""


def _q(digits: int, *cols: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def _round(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _metric_sql(actual: str, pred: str) -> str:
    bad = f"count(*) FILTER (WHERE {actual} <= 0 OR {pred} <= 0)"
    q = f"pow({actual} / nullif({pred}, 0), 2)"
    return f"""sqrt(avg(({actual} - {pred}) * ({actual} - {pred}))) AS rmse, avg(abs({actual} - {pred})) AS mae,
    CASE WHEN {bad} = 0 THEN avg({q} - ln(CASE WHEN {q} > 0 THEN {q} END) - 1) END AS qlike,
    CAST({bad} AS BIGINT) AS n_bad"""


def _scored(*models: str) -> str:
    parts = [f"SELECT symbol, fold, '{m}' AS model, {_metric_sql('actual', m)} FROM preds GROUP BY 1, 2" for m in models]
    return "scored AS (" + " UNION ALL ".join(parts) + ")"


_PREDS_NAIVE = "preds AS (SELECT symbol, date, fold, actual, naive FROM tested)"
_PREDS_BOTH = """preds AS (
  SELECT t.symbol, t.date, t.fold, t.actual, t.naive, e.ewma FROM tested t JOIN ewma e USING (symbol, i))"""
# A mean over folds is missing if one fold is.
_BOARD = f"""board AS (
  SELECT symbol, model, {', '.join(f'CASE WHEN count({m}) = count(*) THEN avg({m}) END AS {m}' for m in ('rmse', 'mae', 'qlike'))},
         CAST(count(*) AS BIGINT) AS n_folds, CAST(sum(n_bad) AS BIGINT) AS n_bad
  FROM scored GROUP BY 1, 2)"""


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_NAIVE_CTES = (_PANEL, _RET, _IDX, _TESTED, _PREDS_NAIVE, _scored("naive"))
_BOTH_CTES = (_PANEL, _RET, _IDX, _TESTED, _ewma_sql(), _PREDS_BOTH, _scored("naive", "ewma"))
_BOARD_COLUMNS = f"symbol, model, {_q(6, 'rmse', 'mae', 'qlike')}, n_folds, n_bad"


# --- sources -----------------------------------------------------------------------------


@_query(
    "ohlcv_bars",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS date,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume
       FROM events WHERE value > 0 GROUP BY 1, 2""",
)
def ohlcv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir)


@_query(
    "daily_bars",
    """SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS BIGINT) AS volume
       FROM events WHERE value > 0 GROUP BY 1, 2""",
)
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark, sf_dir, "1 day").withColumn("date", F.to_date("date"))


def _lineitem_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.concat("l_returnflag", "l_linestatus").alias("symbol")
    return table(spark, sf_dir, "lineitem").select(symbol, (F.col("l_linestatus") == "F").alias("is_target")).distinct()


@_query(
    "basket_filter",
    _with(
        _PANEL,
        "basket AS (SELECT DISTINCT l_returnflag || l_linestatus AS symbol, l_linestatus = 'F' AS is_target FROM lineitem)",
        select=f"SELECT symbol, date, px FROM panel WHERE symbol IN (SELECT symbol FROM basket WHERE is_target)",
    ),
)
def basket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.in_basket(vwap_daily(spark, sf_dir), _lineitem_basket(spark, sf_dir), targets_only=True)


def _mixed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good daily symbols, and raw event rows whose dates repeat."""
    good = vwap_daily(spark, sf_dir).withColumnRenamed("px", "adj_close")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), F.col("value").alias("adj_close")
    )
    # Good series but for the dates of high prices.
    undated = good.where("symbol = 'RF'").select(
        F.lit("RF-undated").alias("symbol"), F.when(F.col("adj_close") < 1400, F.col("date")).alias("date"), "adj_close"
    )
    return good.unionByName(raw).unionByName(undated)


def _mixed_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of both kinds, and symbols that no bar exists for."""
    return (
        _lineitem_basket(spark, sf_dir)
        .select("symbol")
        .union(table(spark, sf_dir, "events").select("event_type").distinct())
        .union(table(spark, sf_dir, "orders").select("o_orderpriority").distinct())
        .union(_lineitem_basket(spark, sf_dir).where("symbol = 'RF'").select(F.lit("RF-undated")))
    )


_STATUS = (
    _PANEL,
    """bars AS (SELECT symbol, date, px AS adj_close FROM panel
      UNION ALL SELECT event_type, CAST(ts AS DATE), value FROM events
      UNION ALL SELECT 'RF-undated', CASE WHEN px < 1400 THEN date END, px FROM panel WHERE symbol = 'RF')""",
    """basket AS (SELECT DISTINCT l_returnflag || l_linestatus AS symbol FROM lineitem
      UNION ALL SELECT DISTINCT event_type FROM events UNION ALL SELECT DISTINCT o_orderpriority FROM orders
      UNION ALL SELECT DISTINCT 'RF-undated' FROM lineitem WHERE l_returnflag || l_linestatus = 'RF')""",
    """per_date AS (SELECT symbol, date, count(*) AS c, count(*) FILTER (WHERE adj_close <= 0) AS bad FROM bars GROUP BY 1, 2)""",
    """found AS (SELECT symbol, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(bad) AS BIGINT) AS bad,
      count(*) FILTER (WHERE c > 1 AND date IS NOT NULL) AS repeated,
      CAST(coalesce(sum(c) FILTER (WHERE date IS NULL), 0) AS BIGINT) AS undated FROM per_date GROUP BY 1)""",
    """status AS (SELECT basket.symbol, coalesce(n_rows, 0) AS n_rows,
      CASE WHEN n_rows IS NULL THEN 'no data for ' || basket.symbol
           WHEN undated > 0 THEN undated || ' rows without a date'
           WHEN bad > 0 THEN bad || ' non-positive prices'
           WHEN repeated > 0 THEN repeated || ' repeated dates' END AS error
      FROM basket LEFT JOIN found ON found.symbol = basket.symbol)""",
)


@_query("ingest_status", _with(*_STATUS, select="SELECT symbol, error IS NULL AS ok, n_rows, error FROM status"))
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.ingest_status(_mixed_basket(spark, sf_dir), _mixed_bars(spark, sf_dir))


@_query(
    "ingest_summary",
    _with(
        *_STATUS,
        select="""SELECT count(*) FILTER (WHERE error IS NULL) AS n_ok, count(*) AS n_total,
          string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE error IS NOT NULL) AS failed FROM status""",
    ),
)
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ba.ingest_summary(ingest_status(spark, sf_dir))
    return summary.withColumn("failed", F.array_join("failed", ","))


_NAMES = """names AS (
  SELECT DISTINCT o_orderpriority AS symbol FROM orders UNION SELECT DISTINCT '^' || o_orderpriority FROM orders
  WHERE o_orderpriority < '3')"""


def _caret_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct()
    careted = names.where(F.col("symbol") < "3").select(F.concat(F.lit("^"), "symbol").alias("symbol"))
    return names.union(careted)


@_query("safe_name", _with(_NAMES, select="SELECT symbol, replace(symbol, '^', '') AS safe_name FROM names"))
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _caret_names(spark, sf_dir).select("symbol", ba.safe_name("symbol").alias("safe_name"))


@_query(
    "name_collisions",
    _with(
        _NAMES,
        select="""SELECT replace(symbol, '^', '') AS safe_name, count(*) AS n_symbols,
          string_agg(symbol, '|' ORDER BY symbol) AS symbols FROM names GROUP BY 1 HAVING count(*) > 1""",
    ),
)
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.name_collisions(_caret_names(spark, sf_dir)).withColumn("symbols", F.array_join("symbols", "|"))


@_query(
    "cached_series",
    _with(_PANEL, select=f"SELECT symbol, date, px AS adj_close FROM panel WHERE symbol = 'AF'"),
)
def cached_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the bars of all symbols to the cache, then scans one symbol's column."""
    path = f"{shared_folder(spark)}/rvpanel-bars-{uuid.uuid4().hex}"
    bars = ba.as_bars(vwap_daily(spark, sf_dir).withColumnRenamed("px", "adj_close"))
    ba.write_bars(bars, path)
    return ba.read_series(spark, path, "AF")


@_query(
    "cached_basket",
    _with(
        _PANEL,
        "basket AS (SELECT DISTINCT l_returnflag || l_linestatus AS symbol FROM lineitem WHERE l_linestatus = 'F')",
        select="SELECT symbol, date, px AS adj_close FROM panel WHERE symbol IN (SELECT symbol FROM basket)",
    ),
)
def cached_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the bars of all symbols to the cache, then scans the target symbols of a basket at once."""
    path = f"{shared_folder(spark)}/rvpanel-bars-{uuid.uuid4().hex}"
    ba.write_bars(ba.as_bars(vwap_daily(spark, sf_dir).withColumnRenamed("px", "adj_close")), path)
    return ba.read_cached(spark, path, _lineitem_basket(spark, sf_dir), targets_only=True)


@_query("landed_bars", _with(_PANEL, select="SELECT symbol, date, CAST(NULL AS DOUBLE) AS open, px AS adj_close FROM panel"))
def landed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars landed as vendor files, some CSV and some JSON, read by their column names."""
    path = f"{shared_folder(spark)}/rvpanel-landed-{uuid.uuid4().hex}"
    landed = vwap_daily(spark, sf_dir).select(
        F.col("px").cast("string").alias("Adj Close"), F.col("date").alias("Date"), F.lit(1).alias("Volume"), F.col("symbol").alias("Ticker")
    )
    open_ones = F.col("Ticker").endswith("O")
    landed.where(open_ones).write.option("header", "true").csv(f"{path}/csv")
    landed.where(~open_ones).write.json(f"{path}/json")
    both = ba.read_bars(spark, f"{path}/csv", "csv").unionByName(ba.read_bars(spark, f"{path}/json", "json"))
    return both.select("symbol", "date", "open", "adj_close")


@_query(
    "coverage",
    _with(
        _PANEL,
        select="SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM panel GROUP BY 1",
    ),
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.coverage(vwap_daily(spark, sf_dir))


@_query(
    "series_head",
    _with(_PANEL, select=f"SELECT symbol, date, px FROM panel WHERE symbol = 'NO' ORDER BY date LIMIT 3"),
)
def series_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ba.head(vwap_daily(spark, sf_dir), "NO")


# --- features ----------------------------------------------------------------------------


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.numbered_returns(vwap_daily(spark, sf_dir))


@_query("log_returns", _with(_PANEL, _RET, select=f"SELECT symbol, date, px, {_q(6, 'r')} FROM ret"))
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fe.log_returns(vwap_daily(spark, sf_dir)), 6, "r")


@_query(
    "row_position",
    _with(_PANEL, _RET, _IDX, select="SELECT symbol, date, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n FROM idx"),
)
def row_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(spark, sf_dir).select("symbol", "date", "i", "n")


@_query(
    "shifted_returns",
    _with(
        _PANEL,
        _RET,
        _IDX,
        select=f"""SELECT symbol, date, {_q(6, 'ahead')}, {_q(6, 'back')} FROM (
          SELECT symbol, date, lead(r, 5) OVER w AS ahead, lag(r, 1) OVER w AS back FROM idx
          WINDOW w AS (PARTITION BY symbol ORDER BY date))""",
    ),
)
def shifted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fe.shift(_returns(spark, sf_dir), "r", ahead=-5, back=1)
    return _round(both, 6, "ahead", "back").select("symbol", "date", "ahead", "back")


@_query(
    "realized_vol",
    _with(
        _PANEL,
        _RET,
        _IDX,
        select=f"""SELECT symbol, date, {_q(6, 'rv')} FROM (
          SELECT symbol, date, {_rolling('r', 20, '19 PRECEDING AND CURRENT ROW')} AS rv FROM idx)""",
    ),
)
def realized_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fe.realized_vol(_returns(spark, sf_dir), 20), 6, "rv").select("symbol", "date", "rv")


@_query(
    "rv_target",
    _with(
        _PANEL,
        _RET,
        _IDX,
        select=f"""SELECT symbol, date, {_q(6, 'rv_target')} FROM (
          SELECT symbol, date, {_rolling('r', 5, '1 FOLLOWING AND 5 FOLLOWING')} AS rv_target FROM idx)""",
    ),
)
def rv_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fe.realized_vol_target(_returns(spark, sf_dir), 5)
    return _round(target, 6, "rv_target").select("symbol", "date", "rv_target")


_FEATURE_SELECT = f"SELECT symbol, date, {_q(6, *FEATURES, 'rv_target')} FROM feat"


@_query("feature_frame", _with(_PANEL, _RET, _feature_sql(), select=_FEATURE_SELECT))
def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fe.build_features(vwap_daily(spark, sf_dir)), 6, *FEATURES, "rv_target")


@_query("nation_features", _with(_NATION_PANEL, _RET, _feature_sql(), select=_FEATURE_SELECT))
def nation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fe.build_features(vwap_by_nation(spark, sf_dir)), 6, *FEATURES, "rv_target")


@_query("intraday_features", _with(_HOURLY_PANEL, _RET, _feature_sql(), select=_FEATURE_SELECT))
def intraday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fe.build_features(hourly_panel(spark, sf_dir)), 6, *FEATURES, "rv_target")


@_query(
    "ewma_vol",
    _with(
        _PANEL,
        _RET,
        _IDX,
        _ewma_sql(),
        select="SELECT symbol, date, round(ewma, 6) + 0.0 AS pred FROM idx JOIN ewma USING (symbol, i)",
    ),
)
def ewma_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ewma_forecast(_returns(spark, sf_dir)), 6, "pred").select("symbol", "date", "pred")


@_query(
    "intraday_ewma",
    _with(
        _HOURLY_PANEL,
        _RET,
        _IDX,
        _ewma_sql(span=3.0),
        select="SELECT symbol, date, round(ewma, 6) + 0.0 AS pred FROM idx JOIN ewma USING (symbol, i)",
    ),
)
def intraday_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short span on hourly bars: blocks of a few rows, many of them."""
    returns = fe.numbered_returns(hourly_panel(spark, sf_dir))
    return _round(ewma_forecast(returns, 3.0), 6, "pred").select("symbol", "date", "pred")


def _f32(c: str) -> str:
    return f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"


@_query(
    "sequence_windows",
    _with(
        _PANEL,
        _RET,
        _feature_sql(),
        select=f"""SELECT symbol, date, CAST(c AS INTEGER) AS n_steps, {_q(4, 'first_return', 'last_rv_60d', 'total', 'y')}
          FROM (SELECT symbol, date, i, count(*) OVER w AS c, first_value({_f32('log_returns')}) OVER w AS first_return,
            {_f32('rv_60d')} AS last_rv_60d, {_f32('rv_target')} AS y,
            sum({' + '.join(_f32(c) for c in FEATURES)}) OVER w AS total
          FROM fidx WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
          WHERE i >= 29""",
    ),
)
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = fe.sequence_windows(pack(vwap_daily(spark, sf_dir), 30), 30)
    flat = F.flatten("x")
    total = F.aggregate(flat, F.lit(0.0), lambda a, v: a + v.cast("double"))
    digest = seq.select(
        "symbol",
        "date",
        F.size("x").alias("n_steps"),
        F.col("x")[0][0].cast("double").alias("first_return"),
        F.element_at(F.element_at("x", -1), -1).cast("double").alias("last_rv_60d"),
        total.alias("total"),
        F.col("y").cast("double").alias("y"),
    )
    return _round(digest, 4, "first_return", "last_rv_60d", "total", "y")


# --- folds and scaling -------------------------------------------------------------------

_BOUNDS = """bounds AS (
  SELECT symbol, CAST(k AS INTEGER) AS fold, n, n - (5 - k) * sz - 5 AS train_end, n - (5 - k) * sz AS test_start,
         n - (5 - k) * sz + sz AS test_end
  FROM (SELECT symbol, n, n // 6 AS sz FROM counts), range(5) AS f(k)
  WHERE sz > 0 AND n - 5 - 5 * sz > 0 AND n - (5 - k) * sz - 5 >= 252)"""
_COUNTS = "counts AS (SELECT symbol, count(*) AS n FROM idx GROUP BY 1)"


@_query("fold_bounds", _with(_PANEL, _RET, _IDX, _COUNTS, _BOUNDS, select="SELECT * FROM bounds"))
def fold_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.fold_bounds(_returns(spark, sf_dir))


@_query(
    "fold_dates",
    _with(
        _PANEL,
        _RET,
        _IDX,
        _COUNTS,
        _BOUNDS,
        select="""SELECT b.symbol, b.fold, min(date) FILTER (WHERE i < train_end) AS train_first,
          max(date) FILTER (WHERE i < train_end) AS train_last, min(date) FILTER (WHERE i >= test_start) AS test_first,
          max(date) FILTER (WHERE i < test_end) AS test_last
          FROM bounds b JOIN idx USING (symbol) GROUP BY 1, 2""",
    ),
)
def fold_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = _returns(spark, sf_dir)
    return fo.fold_dates(returns, fo.fold_bounds(returns))


@_query(
    "calendar_folds",
    _with(
        _PANEL,
        _RET,
        _IDX,
        "counts AS (SELECT '*' AS symbol, count(DISTINCT date) AS n FROM idx)",
        _BOUNDS,
        "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM idx))",
        select="""SELECT idx.symbol, bounds.fold, count(*) AS n_test, min(idx.date) AS test_first, max(idx.date) AS test_last
          FROM idx JOIN cal USING (date) JOIN bounds ON cal.i >= test_start AND cal.i < test_end GROUP BY 1, 2""",
    ),
)
def calendar_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = _returns(spark, sf_dir).select("symbol", "date", "r")
    tested = fo.test_rows(fo.number_by_calendar(returns))
    return tested.groupBy("symbol", "fold").agg(
        F.count("*").alias("n_test"), F.min("date").alias("test_first"), F.max("date").alias("test_last")
    )


@_query(
    "fold_violations",
    _with(
        _PANEL,
        _RET,
        _IDX,
        _COUNTS,
        _BOUNDS,
        """given AS (
          SELECT b.symbol, b.fold, l.date AS train_last, f.date AS test_first
          FROM bounds b JOIN idx f ON f.symbol = b.symbol AND f.i = b.test_start
          JOIN idx l ON l.symbol = b.symbol AND l.i = b.test_start - b.fold)""",
        """gaps AS (
          SELECT g.symbol, g.fold, g.train_last, g.test_first,
            count(*) FILTER (WHERE idx.date > g.train_last AND idx.date < g.test_first) AS gap_rows
          FROM given g JOIN idx ON idx.symbol = g.symbol GROUP BY 1, 2, 3, 4)""",
        select="""SELECT *, CASE WHEN test_first <= train_last THEN 'overlap' ELSE 'embargo' END AS fault,
          CASE WHEN test_first <= train_last THEN 'test starts at ' || test_first || ', which is not after the last train date ' || train_last
            ELSE 'gap is ' || gap_rows || ' of at least 3 rows' END AS message
          FROM gaps WHERE gap_rows < 3 OR test_first <= train_last""",
    ),
)
def fold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold table with faults: fold f trains up to f rows before its first test row."""
    returns = materialize(_returns(spark, sf_dir).select("symbol", "date", "i", "n"))
    faulty = fo.fold_bounds(returns).withColumn("train_end", F.col("test_start") - F.col("fold") + 1)
    return fo.fold_violations(returns, fo.fold_dates(returns, faulty), horizon=3)


@_query(
    "label_selection",
    _with(
        _PANEL,
        """labels_ AS (SELECT DISTINCT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date
          FROM lineitem WHERE l_discount >= 0.1)""",
        select="SELECT symbol, date, px FROM panel JOIN labels_ USING (symbol, date)",
    ),
)
def label_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows of the days on which a symbol had a line item at the highest discount."""
    discounted = table(spark, sf_dir, "lineitem").where(F.col("l_discount") >= 0.1)
    labels = discounted.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("date")
    )
    return fo.select_dates(vwap_daily(spark, sf_dir), labels)


_INNER = """parts AS (
  SELECT *, CASE WHEN i >= inner_end THEN 'validation' ELSE 'train' END AS part
  FROM (SELECT f.*, b.fold, b.train_end, b.train_end - CAST(floor(b.train_end * CAST(0.2 AS DOUBLE)) AS BIGINT) AS inner_end
        FROM fidx f JOIN bounds b USING (symbol) WHERE f.i < b.train_end))"""
_FCOUNTS = "counts AS (SELECT symbol, count(*) AS n FROM fidx GROUP BY 1)"
_FSQL = (_PANEL, _RET, _feature_sql(), _FCOUNTS, _BOUNDS)


@_query(
    "inner_split",
    _with(
        *_FSQL,
        _INNER,
        select="""SELECT symbol, fold, part, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
          FROM parts GROUP BY 1, 2, 3""",
    ),
)
def inner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number(fe.build_features(vwap_daily(spark, sf_dir)))
    return fo.train_rows(numbered).groupBy("symbol", "fold", "part").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


_SCALER = "scaler AS (SELECT symbol, fold, " + ", ".join(
    f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS std_{c}" for c in FEATURES
) + " FROM parts WHERE part = 'train' GROUP BY 1, 2)"
_SCALER_COLUMNS = [f"{s}_{c}" for c in FEATURES for s in ("mean", "std")]


@_query(
    "scaler_fit",
    _with(*_FSQL, _INNER, _SCALER, select=f"SELECT symbol, fold, {_q(6, *_SCALER_COLUMNS)} FROM scaler"),
)
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaler = fit_scaler(number(fe.build_features(vwap_daily(spark, sf_dir))))
    return _round(scaler, 6, *_SCALER_COLUMNS)


@_query(
    "scaled_features",
    _with(
        *_FSQL,
        _INNER,
        _SCALER,
        select="SELECT symbol, date, fold, "
        + ", ".join(f"round(({c} - mean_{c}) / std_{c}, 6) + 0.0 AS {c}" for c in FEATURES)
        + ", round(rv_target, 6) + 0.0 AS rv_target FROM fidx JOIN bounds USING (symbol) JOIN scaler USING (symbol, fold)"
        + " WHERE i >= test_start AND i < test_end",
    ),
)
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = materialize(fe.feature_rows(vwap_daily(spark, sf_dir)))
    scaled = apply_scaler(fo.test_rows(numbered), fit_scaler(numbered))
    return _round(scaled, 6, *FEATURES, "rv_target").select("symbol", "date", "fold", *FEATURES, "rv_target")


# --- evaluation --------------------------------------------------------------------------


def _board(df: DataFrame) -> DataFrame:
    return bt.rounded(df, 6)


@_query("naive_leaderboard", _with(*_NAIVE_CTES, _BOARD, select=f"SELECT {_BOARD_COLUMNS} FROM board"))
def naive_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(bt.evaluate_baselines(_returns(spark, sf_dir), models=("naive",)))


@_query("baseline_leaderboard", _with(*_BOTH_CTES, _BOARD, select=f"SELECT {_BOARD_COLUMNS} FROM board"))
def baseline_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(bt.ranked(bt.evaluate_baselines(_returns(spark, sf_dir), models=("naive", "ewma"))))


@_query(
    "ewma_leaderboard",
    _with(*_BOTH_CTES, _BOARD, select=f"SELECT {_BOARD_COLUMNS} FROM board WHERE model = 'ewma'"),
)
def ewma_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(bt.evaluate_baselines(_returns(spark, sf_dir), models=("ewma",)))


@_query(
    "fold_metrics",
    _with(*_BOTH_CTES, select=f"SELECT symbol, fold, model, {_q(6, 'rmse', 'mae', 'qlike')}, n_bad FROM scored"),
)
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ("naive", "ewma")
    wide = bt.baseline_forecasts(_returns(spark, sf_dir), models=models)
    return _board(bt.fold_metrics(bt.long_forecasts(wide, models)))


@_query(
    "pooled_leaderboard",
    _with(
        *_NAIVE_CTES,
        _BOARD,
        _NATION_PANEL.replace("panel", "panel2", 1),
        """ret2 AS (SELECT symbol, date, ln(px / lag(px) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM panel2)""",
        _IDX.replace("idx AS", "idx2 AS").replace("FROM ret", "FROM ret2"),
        _TESTED.replace("cast_", "cast2_").replace("tested AS", "tested2 AS").replace("FROM idx", "FROM idx2"),
        "scored2 AS (SELECT symbol, fold, 'naive' AS model, " + _metric_sql("actual", "naive") + " FROM tested2 GROUP BY 1, 2)",
        _BOARD.replace("board AS", "board2 AS").replace("scored", "scored2"),
        select=f"SELECT {_BOARD_COLUMNS} FROM (SELECT * FROM board UNION ALL SELECT * FROM board2)",
    ),
)
def pooled_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboards of two panels under each other."""
    first = bt.evaluate_baselines(_returns(spark, sf_dir), models=("naive",))
    second = bt.evaluate_baselines(fe.numbered_returns(vwap_by_nation(spark, sf_dir)), models=("naive",))
    return _board(bt.combine(first, second))


@_query(
    "positivity_guard",
    f"""WITH preds AS (SELECT event_type AS symbol, CAST(extract('hour' FROM ts) AS INTEGER) AS fold,
          value AS actual, value - 0.5::DOUBLE AS pred FROM events)
        SELECT symbol, fold, 'offset' AS model, {_q(6, 'rmse', 'mae', 'qlike')}, n_bad FROM (
          SELECT symbol, fold, {_metric_sql('actual', 'pred')} FROM preds GROUP BY 1, 2)""",
)
def positivity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of which some are not positive: their group's QLIKE is NULL, not wrong."""
    pairs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.hour("ts").alias("fold"),
        F.lit("offset").alias("model"),
        F.col("value").alias("actual"),
        (F.col("value") - 0.5).alias("pred"),
    )
    return _board(bt.fold_metrics(pairs))


@_query(
    "relative_gain",
    _with(
        *_BOTH_CTES,
        _BOARD,
        """long AS (SELECT symbol, model, 'rmse' AS metric, rmse AS value FROM board
          UNION ALL SELECT symbol, model, 'mae', mae FROM board UNION ALL SELECT symbol, model, 'qlike', qlike FROM board)""",
        select=f"""SELECT symbol, model, metric, {_q(6, 'value', 'baseline')},
          round(100.0::DOUBLE * (1 - value / baseline), 4) + 0.0 AS gain_pct
          FROM long JOIN (SELECT symbol, metric, value AS baseline FROM long WHERE model = 'ewma') USING (symbol, metric)""",
    ),
)
def relative_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = bt.evaluate_baselines(_returns(spark, sf_dir), models=("naive", "ewma"))
    return _round(_round(bt.relative_gain(board), 6, "value", "baseline"), 4, "gain_pct")


@_query(
    "forecast_vs_actual",
    _with(
        *_BOTH_CTES,
        select=f"""SELECT symbol, date, fold, {_q(6, 'actual', 'naive', 'ewma')} FROM preds
          WHERE (symbol, fold) IN (SELECT symbol, max(fold) FROM preds GROUP BY 1)""",
    ),
)
def forecast_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fold's forecasts next to the realized volatility."""
    models = ("naive", "ewma")
    returns = _returns(spark, sf_dir)
    wide = bt.baseline_forecasts(returns, models=models)
    latest = fo.last_fold(wide, fo.fold_bounds(returns))
    return _round(bt.side_by_side(bt.long_forecasts(latest, models), models), 6, "actual", *models)


@_query(
    "aligned_pairs",
    _with(
        _PANEL,
        _RET,
        _IDX,
        _feature_sql(),
        _ewma_sql(),
        select="""SELECT f.symbol, f.date, round(f.rv_target, 6) + 0.0 AS actual, round(e.ewma, 6) + 0.0 AS pred
          FROM feat f JOIN idx USING (symbol, date) JOIN ewma e ON e.symbol = idx.symbol AND e.i = idx.i
          WHERE e.ewma IS NOT NULL""",
    ),
)
def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = vwap_daily(spark, sf_dir)
    predictions = ewma_forecast(fe.numbered_returns(panel)).select("symbol", "date", "pred")
    pairs = bt.align(bt.feature_actuals(fe.build_features(panel)), predictions)
    return _round(pairs, 6, "actual", "pred").select("symbol", "date", "actual", "pred")


@_query(
    "best_run",
    _with(
        *_BOTH_CTES,
        _BOARD,
        select="""SELECT symbol || '/' || model AS run_id, round(qlike, 6) + 0.0 AS value FROM board
          WHERE qlike IS NOT NULL ORDER BY qlike, run_id LIMIT 1""",
    ),
)
def best_run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's leaderboard rows taken as runs; the one with the lowest QLIKE."""
    board = bt.evaluate_baselines(_returns(spark, sf_dir), models=("naive", "ewma"))
    metrics = bt.long_metrics(board.select(F.concat_ws("/", "symbol", "model").alias("run_id"), *bt.METRICS))
    return _round(best_run(metrics), 6, "value")


# --- fitted models -----------------------------------------------------------------------


@_query(
    "garch_horizon",
    _with(
        _PANEL,
        _RET,
        _IDX,
        """given AS (SELECT symbol, CAST(0 AS INTEGER) AS fold, 0.08::DOUBLE AS a, 0.9::DOUBLE AS b,
          var_pop(r * 100) * 0.02::DOUBLE AS w, var_pop(r * 100) AS v, max(r * 100 * r * 100) AS e2 FROM idx GROUP BY 1)""",
        "v1 AS (SELECT *, w + a * e2 + b * v AS f1 FROM given)",
        "v2 AS (SELECT *, w + (a + b) * f1 AS f2 FROM v1)",
        "v3 AS (SELECT *, w + (a + b) * f2 AS f3 FROM v2)",
        "v4 AS (SELECT *, w + (a + b) * f3 AS f4 FROM v3)",
        "v5 AS (SELECT *, w + (a + b) * f4 AS f5 FROM v4)",
        select="""SELECT symbol, fold, round(sqrt((f1 + f2 + f3 + f4 + f5) / 5 / 10000) * sqrt(252.0::DOUBLE), 6) + 0.0 AS pred
          FROM v5""",
    ),
)
def garch_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon formula on given parameters."""
    percent = F.col("r") * 100
    given = (
        _returns(spark, sf_dir)
        .groupBy("symbol")
        .agg(F.var_pop(percent).alias("last_variance"), F.max(percent * percent).alias("last_resid_sq"))
        .select(
            "symbol",
            F.lit(0).alias("fold"),
            (F.col("last_variance") * 0.02).alias("omega"),
            F.lit(0.08).alias("alpha"),
            F.lit(0.9).alias("beta"),
            "last_resid_sq",
            "last_variance",
        )
    )
    return _round(ga.garch_forecast(given, 5), 6, "pred")


@_query(
    "garch_likelihood",
    _with(
        _PANEL,
        _RET,
        _IDX,
        "moments AS (SELECT symbol, avg(r * 100) AS mu, var_pop(r * 100) AS v FROM idx GROUP BY 1)",
        """res AS (SELECT symbol, i, n, v, pow(r * 100 - mu, 2) AS e2,
          lag(pow(r * 100 - mu, 2)) OVER (PARTITION BY symbol ORDER BY date) AS e2_before
          FROM idx JOIN moments USING (symbol))""",
        """start_ AS (SELECT symbol, sum(pow(0.94::DOUBLE, i) * e2) / sum(pow(0.94::DOUBLE, i)) AS bc
          FROM res WHERE i < 75 GROUP BY 1)""",
        """inputs AS (SELECT symbol, i, e2, bc, 0.02::DOUBLE * v + 0.08::DOUBLE * coalesce(e2_before, bc) AS u
          FROM res JOIN start_ USING (symbol))""",
        """path AS (SELECT t.symbol, t.i, t.e2, sum(pow(0.9::DOUBLE, t.i - s.i) * s.u) + pow(0.9::DOUBLE, t.i + 1) * t.bc AS var_t
          FROM inputs t JOIN inputs s ON s.symbol = t.symbol AND s.i <= t.i GROUP BY t.symbol, t.i, t.e2, t.bc)""",
        select="""SELECT symbol, count(*) AS n_obs,
          round(-0.5::DOUBLE * sum(ln(2 * pi()) + ln(var_t) + e2 / var_t), 4) + 0.0 AS log_likelihood,
          round(max(var_t) FILTER (WHERE i = n_last), 4) + 0.0 AS last_variance
          FROM path JOIN (SELECT symbol, max(i) AS n_last FROM path GROUP BY 1) USING (symbol) GROUP BY 1""",
    ),
)
def garch_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of given parameters over each whole series, block by block."""
    scored = ga.garch_likelihood(_returns(spark, sf_dir), alpha=0.08, beta=0.9, omega_share=0.02)
    return _round(scored, 4, "log_likelihood", "last_variance")


@_query("garch_params")
def garch_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.garch_params(_returns(spark, sf_dir))


@_query("garch_forecast")
def garch_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.garch_forecast(ga.garch_params(_returns(spark, sf_dir)))


@_query("full_leaderboard")
def full_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive, EWMA and GARCH."""
    return bt.rounded(bt.ranked(bt.evaluate_baselines(_returns(spark, sf_dir))))


@_query("learned_forecast")
def learned_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees, all folds."""
    return learned_forecasts(vwap_daily(spark, sf_dir), settings_from({}))


@_query("learned_leaderboard")
def learned_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear model on the same windows, all folds."""
    return bt.rounded(evaluate_learned(vwap_daily(spark, sf_dir), settings_from({"learner": "linear"})))



# Calendar positions of the feature rows, and the default folds over them.
_CALENDAR = (
    "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS m FROM (SELECT DISTINCT date FROM feat))",
    """placed AS (SELECT feat.*, p, m, lag(p, 29) OVER (PARTITION BY symbol ORDER BY date) AS p_first
      FROM feat JOIN cal USING (date))""",
    """folded AS (SELECT *, m - (5 - fold) * (m // 6) AS test_start, m - (5 - fold) * (m // 6) + m // 6 AS test_end,
      m - (5 - fold) * (m // 6) - 5 AS train_end FROM placed, (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold))""",
)


@_query(
    "learned_rows",
    _with(
        _PANEL,
        _RET,
        _feature_sql(),
        *_CALENDAR,
        select=f"""SELECT symbol, date, fold, {_q(6, 'actual')} FROM (SELECT symbol, date, fold, rv_target AS actual FROM folded
          WHERE train_end >= 252 AND p_first >= test_start AND p < test_end)""",
    ),
)
def learned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows get a learned forecast under the default settings, in all folds."""
    found = learned_forecasts(vwap_daily(spark, sf_dir), settings_from({"learner": "linear"}))
    return _round(found.where("pred IS NOT NULL"), 6, "actual").select("symbol", "date", "fold", "actual")


@_query(
    "learned_linear_small",
    _with(
        _PANEL,
        _RET,
        _feature_sql(),
        *_CALENDAR,
        "inner_ AS (SELECT *, train_end - CAST(floor(train_end * 0.2::DOUBLE) AS BIGINT) AS inner_end FROM folded WHERE train_end >= 252)",
        """scale AS (SELECT symbol, fold, avg(rv_20d) AS mean, CASE WHEN stddev_pop(rv_20d) = 0 THEN 1 ELSE stddev_pop(rv_20d) END AS std
          FROM inner_ WHERE p < inner_end GROUP BY 1, 2)""",
        "scaled AS (SELECT inner_.*, CAST(CAST((rv_20d - mean) / std AS FLOAT) AS DOUBLE) AS x FROM inner_ JOIN scale USING (symbol, fold))",
        """line AS (SELECT fold, regr_slope(rv_target, x) AS b, regr_intercept(rv_target, x) AS a
          FROM scaled WHERE p < inner_end GROUP BY 1)""",
        select=f"""SELECT symbol, date, fold, {_q(5, 'actual', 'pred')} FROM (
          SELECT symbol, date, fold, rv_target AS actual, a + b * x AS pred FROM scaled JOIN line USING (fold)
          WHERE p >= test_start AND p < test_end)""",
    ),
)
def learned_linear_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature, windows of one row, least squares: forecasts of all folds."""
    config = settings_from({"learner": "linear", "features": ("rv_20d",), "window": 1})
    found = learned_forecasts(vwap_daily(spark, sf_dir), config)
    return _round(found, 5, "actual", "pred").select("symbol", "date", "fold", "actual", "pred")


def vwap_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many symbols: one per supplier."""
    symbol = F.col("l_suppkey").cast("string").alias("symbol")
    px = (F.sum(_cents("l_extendedprice")) / 100 / F.sum("l_quantity")).alias("px")
    return table(spark, sf_dir, "lineitem").groupBy(symbol, F.to_date("l_shipdate").alias("date")).agg(px)


_SUPPLIER_PANEL = _NATION_PANEL.replace("s_nationkey", "l_suppkey").replace(" JOIN supplier ON s_suppkey = l_suppkey", "")


@_query("supplier_features", _with(_SUPPLIER_PANEL, _RET, _feature_sql(), select=_FEATURE_SELECT))
def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fe.build_features(vwap_by_supplier(spark, sf_dir)), 6, *FEATURES, "rv_target")



@_query(
    "final_model_scaler",
    _with(
        _PANEL,
        _RET,
        _feature_sql(),
        *_CALENDAR[:2],
        "inner_ AS (SELECT * FROM placed WHERE p < m - CAST(floor(m * 0.2::DOUBLE) AS BIGINT))",
        select="SELECT symbol, "
        + ", ".join(
            f"round(avg({c}), 6) + 0.0 AS mean_{c}, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) + 0.0 AS std_{c}"
            for c in FEATURES
        )
        + " FROM inner_ GROUP BY 1",
    ),
)
def final_model_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaler of the model that is kept, as it is stored under a run and loaded again."""
    config, root = settings_from({"learner": "linear"}), f"{shared_folder(spark)}/rvpanel-runs-{uuid.uuid4().hex}"
    runs.log_model(*train_final_model(vwap_daily(spark, sf_dir), config), root, "default", "learned")
    _, scaler = runs.load_model(spark, root, "learned", "default")
    columns = [F.col(kind)[k].alias(f"{kind}_{c}") for k, c in enumerate(config.features) for kind in ("mean", "std")]
    return _round(scaler.select("symbol", *columns), 6, *[f"{kind}_{c}" for c in config.features for kind in ("mean", "std")])


# --- learned model, constants and guards, each next to what SQL finds --------------------

_SMALL = {"learner": "linear", "features": ("rv_20d",), "window": 1}
_SMALL_PREDS = (
    _feature_sql(),
    *_CALENDAR,
    "inner_ AS (SELECT *, train_end - CAST(floor(train_end * 0.2::DOUBLE) AS BIGINT) AS inner_end FROM folded WHERE train_end >= 252)",
    """scale AS (SELECT symbol, fold, avg(rv_20d) AS mean, CASE WHEN stddev_pop(rv_20d) = 0 THEN 1 ELSE stddev_pop(rv_20d) END AS std
      FROM inner_ WHERE p < inner_end GROUP BY 1, 2)""",
    "scaled AS (SELECT inner_.*, CAST(CAST((rv_20d - mean) / std AS FLOAT) AS DOUBLE) AS x FROM inner_ JOIN scale USING (symbol, fold))",
    "line AS (SELECT fold, regr_slope(rv_target, x) AS b, regr_intercept(rv_target, x) AS a FROM scaled WHERE p < inner_end GROUP BY 1)",
    """small AS (SELECT symbol, date, fold, rv_target AS actual, a + b * x AS learned FROM scaled JOIN line USING (fold)
      WHERE p >= test_start AND p < test_end)""",
)
_SMALL_SCORED = "scored_small AS (SELECT symbol, fold, 'learned' AS model, " + _metric_sql("actual", "learned") + " FROM small GROUP BY 1, 2)"
_SMALL_BOARD = _BOARD.replace("board AS", "board_small AS").replace("FROM scored", "FROM scored_small")


@_query(
    "learned_small_leaderboard",
    _with(_PANEL, _RET, *_SMALL_PREDS, _SMALL_SCORED, _SMALL_BOARD, select=f"SELECT {_BOARD_COLUMNS.replace('6)', '5)')} FROM board_small"),
)
def learned_small_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on one feature, evaluated over all folds in one pass."""
    return bt.rounded(evaluate_learned(vwap_daily(spark, sf_dir), settings_from(_SMALL)), 5)


@_query(
    "all_models_leaderboard",
    _with(
        *_BOTH_CTES,
        _BOARD,
        *_SMALL_PREDS,
        _SMALL_SCORED,
        _SMALL_BOARD,
        select=f"SELECT {_BOARD_COLUMNS.replace('6)', '5)')} FROM (SELECT * FROM board UNION ALL SELECT * FROM board_small)",
    ),
)
def all_models_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines and the learned model under each other, each on its own test rows."""
    board = evaluate_all(vwap_daily(spark, sf_dir), settings_from(_SMALL), models=("naive", "ewma"))
    return bt.rounded(bt.ranked(board), 5)


@_query(
    "learned_vs_actual",
    _with(
        *_BOTH_CTES,
        *_SMALL_PREDS,
        select=f"""SELECT s.symbol, s.date, s.fold, {_q(5, 's.actual', 'p.naive', 'p.ewma', 's.learned').replace('AS s.', 'AS ').replace('AS p.', 'AS ')}
          FROM small s JOIN preds p USING (symbol, date) WHERE s.fold = 4 AND p.naive IS NOT NULL AND p.ewma IS NOT NULL""",
    ),
)
def learned_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fold's learned forecasts next to the baselines' and the realized volatility."""
    panel, models = vwap_daily(spark, sf_dir), ("naive", "ewma")
    wide = bt.baseline_forecasts(fe.numbered_returns(panel), models=models)
    beside = learned_beside(learned_forecasts(panel, settings_from(_SMALL)), wide, models, fold=4)
    return _round(beside, 5, "actual", *models, "learned")


@_query(
    "garch_over_test_dates",
    _with(
        _PANEL,
        _RET,
        _IDX,
        _COUNTS,
        _BOUNDS,
        """given AS (SELECT symbol, fold, var_pop(r * 100) * 0.02::DOUBLE AS w, var_pop(r * 100) AS v, max(r * 100 * r * 100) AS e2
          FROM idx JOIN bounds USING (symbol) WHERE i < train_end GROUP BY 1, 2)""",
        "v1 AS (SELECT *, w + 0.08::DOUBLE * e2 + 0.9::DOUBLE * v AS f1 FROM given)",
        "v2 AS (SELECT *, w + 0.98::DOUBLE * f1 AS f2 FROM v1)",
        "v3 AS (SELECT *, w + 0.98::DOUBLE * f2 AS f3 FROM v2)",
        "v4 AS (SELECT *, w + 0.98::DOUBLE * f3 AS f4 FROM v3)",
        "v5 AS (SELECT *, w + 0.98::DOUBLE * f4 AS f5 FROM v4)",
        select="""SELECT symbol, date, fold, round(sqrt((f1 + f2 + f3 + f4 + f5) / 5 / 10000) * sqrt(252.0::DOUBLE), 6) + 0.0 AS pred
          FROM idx JOIN bounds USING (symbol) JOIN v5 USING (symbol, fold) WHERE i >= test_start AND i < test_end""",
    ),
)
def garch_over_test_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A horizon forecast per fold, from moments of its train rows and given parameters, over the fold's test dates."""
    numbered, percent = materialize(_returns(spark, sf_dir)), F.col("r") * 100
    train = fo.train_rows(numbered, val_frac=0.2)
    given = (
        train.groupBy("symbol", "fold")
        .agg(F.var_pop(percent).alias("last_variance"), F.max(percent * percent).alias("last_resid_sq"))
        .select(
            "*", (F.col("last_variance") * 0.02).alias("omega"), F.lit(0.08).alias("alpha"), F.lit(0.9).alias("beta")
        )
    )
    return _round(bt.constant_forecasts(numbered, ga.garch_forecast(given, 5)), 6, "pred")


@_query(
    "guarded_leaderboard",
    _with(
        "preds AS (SELECT event_type AS symbol, CAST(extract('hour' FROM ts) AS INTEGER) AS fold, value AS actual, value - 0.05::DOUBLE AS pred FROM events)",
        "scored AS (SELECT symbol, fold, 'offset' AS model, " + _metric_sql("actual", "pred") + " FROM preds GROUP BY 1, 2)",
        _BOARD,
        select=f"SELECT {_BOARD_COLUMNS} FROM board",
    ),
)
def guarded_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of which some have a fold whose QLIKE is undefined: their mean is missing, not that of the other folds."""
    pairs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.hour("ts").alias("fold"),
        F.lit("offset").alias("model"),
        F.col("value").alias("actual"),
        (F.col("value") - 0.05).alias("pred"),
    )
    return _board(bt.leaderboard(bt.fold_metrics(pairs)))


@_query(
    "repeated_fit",
    _with(
        _PANEL,
        _RET,
        _feature_sql(),
        *_CALENDAR,
        select="""SELECT symbol, fold, count(*) AS n_rows, CAST(count(*) AS BIGINT) AS n_equal FROM folded
          WHERE fold = 4 AND train_end >= 252 AND p_first >= test_start AND p < test_end GROUP BY 1, 2""",
    ),
)
def repeated_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fits of boosted trees with one seed: how many of the last fold's forecasts are the same to the last bit."""
    config, panel = settings_from({"rounds": 5, "patience": 2}), vwap_daily(spark, sf_dir)
    first, second = (
        learned_forecasts(panel, config, folds=[4]).select("symbol", "date", "fold", F.col("pred").alias(name)) for name in ("a", "b")
    )
    both = first.join(second, ["symbol", "date", "fold"])
    return both.groupBy("symbol", "fold").agg(F.count("*").alias("n_rows"), F.expr("count_if(a = b)").alias("n_equal"))
