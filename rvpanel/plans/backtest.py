"""Walk-forward evaluation: forecasts, metrics per fold, leaderboards and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rvpanel.functions import annualized, bad_volatility, mae, qlike, rmse, rolling_std
from rvpanel.operators.ewma import block_rows, with_ewma
from rvpanel.operators.folds import test_rows
from rvpanel.operators.garch import garch_forecast, garch_params
from rvpanel.operators.layout import (
    BLOCK_ROWS,
    block_window,
    blocks,
    is_numbered,
    join_symbols,
    number,
    own_rows,
)
from rvpanel.schema import TARGET

METRICS = ["rmse", "mae", "qlike"]
BASELINES = ("naive", "ewma", "garch")
LEARNED = "learned"


def baseline_forecasts(
    returns: DataFrame,
    horizon: int = 5,
    n_splits: int = 5,
    min_train_size: int = 252,
    ewma_span: float = 32.0,
    annualize: bool = True,
    models: Sequence[str] = BASELINES,
) -> DataFrame:
    """Test rows of every fold with the realized target ``actual`` and one column per model.

    Target, naive and EWMA do not depend on the fold, so they are computed once on the
    whole series.  GARCH is fitted on the fold's train rows and is constant over its test
    rows; naive and EWMA use all rows up to the forecast date.

    ``returns`` is (symbol, date, r), or ``numbered_returns``, whose rows are not numbered again.
    """
    unknown = set(models) - set(BASELINES)
    if unknown:
        raise ValueError(f"unknown baseline models: {sorted(unknown)}")
    numbered = returns if is_numbered(returns) else number(returns.where(F.col("r").isNotNull()))
    size = block_rows(ewma_span) if "ewma" in models else BLOCK_ROWS
    w = block_window()

    laid = blocks(numbered.select("symbol", "date", "r", "i", "n"), before=horizon - 1, after=horizon, size=size)
    target = annualized(rolling_std("r", horizon, w, 1, horizon), annualize)
    naive = annualized(rolling_std("r", horizon, w, -(horizon - 1), 0), annualize)

    per_symbol = None
    if "garch" in models:
        params = garch_params(numbered, n_splits, horizon, min_train_size)
        fitted = garch_forecast(params, horizon, annualize)
        per_symbol = fitted.groupBy("symbol").agg(F.collect_list(F.struct("fold", "pred")).alias("_garch"))
    # Joins before windows: the rows then cross the frames with their block intact.
    if "ewma" in models:
        laid = with_ewma(laid, "r", ewma_span, size, "ewma", annualize, per_symbol)
    elif per_symbol is not None:
        laid = join_symbols(laid, per_symbol, "left")

    laid = laid.withColumns({"actual": target, "naive": naive})
    tested = test_rows(own_rows(laid), n_splits, horizon, min_train_size).where(F.col("actual").isNotNull())
    if "garch" in models:
        mine = F.filter("_garch", lambda g: g["fold"] == F.col("fold"))
        tested = tested.withColumn("garch", F.get(mine, F.lit(0))["pred"])
    return tested.select("symbol", "date", "fold", "actual", *models)


def constant_forecasts(
    returns: DataFrame, per_fold: DataFrame, n_splits: int = 5, horizon: int = 5, min_train_size: int = 252
) -> DataFrame:
    """A forecast per symbol and fold (symbol, fold, pred) over all test dates of the fold: (symbol, date, fold, pred).

    Constants go to the symbol's blocks, so rows are not gathered by symbol; folds without one have no rows.
    """
    numbered = returns if is_numbered(returns) else number(returns.where(F.col("r").isNotNull()))
    tested = test_rows(own_rows(blocks(numbered.select("symbol", "date", "i", "n"))), n_splits, horizon, min_train_size)
    constants = per_fold.groupBy("symbol").agg(F.collect_list(F.struct("fold", "pred")).alias("_constants"))
    mine = F.filter("_constants", lambda c: c["fold"] == F.col("fold"))
    joined = join_symbols(tested, constants).withColumn("_mine", F.get(mine, F.lit(0)))
    return joined.where("_mine IS NOT NULL").select("symbol", "date", "fold", "_mine.pred")


def long_forecasts(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per forecast: (symbol, date, fold, model, actual, pred)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models])
    return wide.select("symbol", "date", "fold", "actual", F.explode(pairs).alias("_p")).select(
        "symbol", "date", "fold", "_p.model", "actual", "_p.pred"
    )


def metric_columns(actual: str, pred: str, strict: bool = False) -> list[Column]:
    return [
        rmse(actual, pred).alias("rmse"),
        mae(actual, pred).alias("mae"),
        qlike(actual, pred, strict).alias("qlike"),
        bad_volatility(actual, pred).alias("n_bad"),
    ]


def align(actuals: DataFrame, predictions: DataFrame) -> DataFrame:
    """Actual and forecast on the dates both have; pairs with a missing side are left out."""
    both = actuals.join(predictions, ["symbol", "date"])
    return both.where(F.col("actual").isNotNull() & F.col("pred").isNotNull())


def fold_metrics(forecasts: DataFrame, strict: bool = False) -> DataFrame:
    """RMSE, MAE and QLIKE per symbol, fold and model, from long forecasts."""
    return forecasts.groupBy("symbol", "fold", "model").agg(*metric_columns("actual", "pred", strict))


def fold_metrics_wide(wide: DataFrame, models: Sequence[str], strict: bool = False) -> DataFrame:
    """The same from one column per model: rows are aggregated as they are and only the
    result, one row per symbol and fold, is turned into long form."""
    scored = wide.groupBy("symbol", "fold").agg(
        *[F.struct(F.lit(m).alias("model"), *metric_columns("actual", m, strict)).alias(f"_{m}") for m in models]
    )
    per_model = F.explode(F.array(*[F.col(f"_{m}") for m in models]))
    return scored.select("symbol", "fold", per_model.alias("_m")).select("symbol", "fold", "_m.*")


def long_metrics(metrics: DataFrame) -> DataFrame:
    """One row per metric: (..., metric, value)."""
    keys = [c for c in metrics.columns if c not in [*METRICS, "n_bad"]]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return metrics.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.metric", "_p.value")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Unweighted mean of the fold values per symbol and model; NULL if a fold's is."""

    return metrics.groupBy("symbol", "model").agg(
        *[F.expr(f"CASE WHEN count({m}) = count(*) THEN avg({m}) END").alias(m) for m in METRICS],
        F.expr("count(*)").alias("n_folds"),
        F.expr("sum(n_bad)").alias("n_bad"),
    )


def ranked(board: DataFrame, order: Sequence[str] = (*BASELINES, LEARNED)) -> DataFrame:
    """Leaderboard rows sorted by symbol, then models in the given order."""
    position = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return board.orderBy("symbol", F.when(position > 0, position), "model")


def evaluate_baselines(
    returns: DataFrame,
    horizon: int = 5,
    n_splits: int = 5,
    min_train_size: int = 252,
    ewma_span: float = 32.0,
    annualize: bool = True,
    models: Sequence[str] = BASELINES,
    strict: bool = False,
) -> DataFrame:
    """Leaderboard (symbol, model, rmse, mae, qlike) of the classical forecasts, for all
    symbols of ``returns`` (symbol, date, r) in one plan."""
    wide = baseline_forecasts(returns, horizon, n_splits, min_train_size, ewma_span, annualize, models)
    return leaderboard(fold_metrics_wide(wide, models, strict))


def combine(*boards: DataFrame) -> DataFrame:
    """Leaderboards under each other."""
    first, *others = boards
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def relative_gain(board: DataFrame, baseline: str = "ewma") -> DataFrame:
    """Per cent by which each model's metric is below the baseline's (positive: better)."""
    # A leaderboard has a row per model: the baseline is looked up inside that small group,
    # which leaves the board computed once.
    base = f"max(CASE WHEN model = '{baseline}' THEN value END) OVER (PARTITION BY symbol, metric) AS baseline"
    long = long_metrics(board.select("symbol", "model", *METRICS)).selectExpr("*", base)
    gain = "100D * (1D - try_divide(value, baseline)) AS gain_pct"
    return long.where("baseline IS NOT NULL").selectExpr("*", gain)


def side_by_side(forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Actual and each model's forecast in columns, on the dates all of them have."""
    wide = forecasts.groupBy("symbol", "date", "fold").agg(
        F.max("actual").alias("actual"),
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models],
    )
    return wide.dropna("any", subset=["actual", *models])


def rounded(df: DataFrame, digits: int = 4, columns: Sequence[str] = METRICS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def feature_actuals(features: DataFrame) -> DataFrame:
    return features.select("symbol", "date", F.col(TARGET).alias("actual"))
