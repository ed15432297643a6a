"""Volatility analytics on panels of price series, as Spark DataFrame operators."""

from rvpanel.config import Settings, settings_from
from rvpanel.operators.ewma import ewma_forecast
from rvpanel.operators.features import (
    build_features,
    log_returns,
    naive_forecast,
    numbered_returns,
    realized_vol,
    realized_vol_target,
    sequence_windows,
    shift,
)
from rvpanel.operators.folds import fold_bounds, fold_dates, fold_violations, last_fold, test_rows, train_rows
from rvpanel.operators.garch import garch_forecast, garch_params
from rvpanel.operators.learned import learned_forecasts, predict, train_final_model
from rvpanel.operators.scaling import apply_scaler, fit_scaler
from rvpanel.plans.backtest import evaluate_baselines, fold_metrics, leaderboard, relative_gain
from rvpanel.plans.learned import evaluate_all, evaluate_learned
from rvpanel.plans.runs import best_run, training_run
from rvpanel.sources.bars import basket, build_bars, coverage, ingest_basket, price_panel, read_bars, read_series

__all__ = [
    "Settings",
    "apply_scaler",
    "basket",
    "best_run",
    "build_bars",
    "build_features",
    "coverage",
    "evaluate_all",
    "evaluate_baselines",
    "evaluate_learned",
    "ewma_forecast",
    "fit_scaler",
    "fold_bounds",
    "fold_dates",
    "fold_metrics",
    "fold_violations",
    "garch_forecast",
    "garch_params",
    "ingest_basket",
    "last_fold",
    "leaderboard",
    "learned_forecasts",
    "log_returns",
    "naive_forecast",
    "numbered_returns",
    "predict",
    "price_panel",
    "read_bars",
    "read_series",
    "realized_vol",
    "realized_vol_target",
    "relative_gain",
    "sequence_windows",
    "settings_from",
    "shift",
    "test_rows",
    "train_final_model",
    "train_rows",
    "training_run",
]
