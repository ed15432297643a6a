"""Evaluation of the learned forecaster next to the baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.config import Settings
from rvpanel.operators.features import numbered_returns
from rvpanel.operators.learned import learned_forecasts
from rvpanel.plans.backtest import (
    BASELINES,
    baseline_forecasts,
    combine,
    evaluate_baselines,
    fold_metrics,
    leaderboard,
    long_forecasts,
)


def evaluate_learned(panel: DataFrame, config: Settings, mode: str = "calendar", strict: bool = False) -> DataFrame:
    """Leaderboard row of the learned model, from its own walk-forward folds."""
    return leaderboard(fold_metrics(learned_forecasts(panel, config, mode), strict))


def evaluate_all(
    panel: DataFrame,
    config: Settings,
    models: Sequence[str] = BASELINES,
    mode: str = "calendar",
    common_rows: bool = False,
) -> DataFrame:
    """Baselines and the learned model in one leaderboard.

    By default each side is scored on its own test rows: baselines on folds of the return
    index, the learned model on folds of the shorter feature index without the rows a
    window needs first.  ``common_rows`` scores all models on the rows of the learned one.
    """
    learned = learned_forecasts(panel, config, mode)
    if not common_rows:
        board = evaluate_baselines(
            numbered_returns(panel), config.horizon, config.folds, config.least_train, models=models
        )
        return combine(board, leaderboard(fold_metrics(learned)))
    wide = baseline_forecasts(
        numbered_returns(panel), config.horizon, config.folds, config.least_train, models=models
    )
    keys = learned.select("symbol", "date", "fold", "actual")
    others = long_forecasts(wide, models).select("symbol", "date", "model", "pred")
    shared = keys.join(others, ["symbol", "date"]).where(F.col("pred").isNotNull())
    complete = shared.groupBy("symbol", "date").agg(F.count("*").alias("_n")).where(F.col("_n") == len(models))
    everyone = shared.unionByName(learned).join(complete.select("symbol", "date"), ["symbol", "date"], "left_semi")
    return leaderboard(fold_metrics(everyone))


def learned_beside(learned: DataFrame, wide: DataFrame, models: Sequence[str], fold: int) -> DataFrame:
    """One fold's learned forecasts next to the baselines' of the same dates and the realized volatility."""
    mine = learned.where(F.col("fold") == fold).select("symbol", "date", "fold", "actual", F.col("pred").alias("learned"))
    both = mine.join(wide.select("symbol", "date", *models), ["symbol", "date"])
    return both.dropna("any", subset=["actual", "learned", *models]).select("symbol", "date", "fold", "actual", *models, "learned")
