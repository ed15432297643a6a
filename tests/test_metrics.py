import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from rvpanel.plans import backtest as bt

SCHEMA = "symbol string, fold int, model string, actual double, pred double"


def _score(spark, actual, pred, strict=False):
    rows = [("A", 0, "m", a, p) for a, p in zip(actual, pred)]
    return bt.fold_metrics(spark.createDataFrame(rows, SCHEMA), strict).first()


def test_known_values(spark):
    a, p = np.array([0.16, 0.05, 0.41, 0.27]), np.array([0.11, 0.07, 0.38, 0.3])
    got = _score(spark, a.tolist(), p.tolist())
    assert np.isclose(got.rmse, np.sqrt(((a - p) ** 2).mean()))
    assert np.isclose(got.mae, np.abs(a - p).mean())
    q = a**2 / p**2
    assert np.isclose(got.qlike, (q - np.log(q) - 1).mean())


def test_qlike_of_half_the_volatility(spark):
    assert np.isclose(_score(spark, [0.2], [0.1]).qlike, 4 - np.log(4) - 1)


def test_perfect_forecast_scores_zero(spark):
    got = _score(spark, [0.1, 0.2], [0.1, 0.2])
    assert (got.rmse, got.mae, got.qlike) == (0, 0, 0)


def test_qlike_punishes_under_forecasts_more(spark):
    under, over = _score(spark, [0.2], [0.1]), _score(spark, [0.2], [0.3])
    assert np.isclose(under.rmse, over.rmse) and np.isclose(under.mae, over.mae)
    assert under.qlike > over.qlike


@pytest.mark.parametrize("actual, pred", [([0.2, 0.1], [0.2, 0.0]), ([-0.1, 0.1], [0.2, 0.1])])
def test_non_positive_volatility_is_never_skipped(spark, actual, pred):
    got = _score(spark, actual, pred)
    assert got.qlike is None and got.n_bad == 1 and got.rmse is not None
    with pytest.raises(PySparkException, match="strictly positive"):
        _score(spark, actual, pred, strict=True)


def test_missing_pairs_are_left_out(spark):
    got = _score(spark, [0.1, None, 0.3], [0.2, 0.5, None])
    assert np.isclose(got.rmse, 0.1) and np.isclose(got.mae, 0.1) and got.n_bad == 0


def test_leaderboard_is_the_plain_mean_of_folds(spark):
    rows = [("A", f, "naive", a, p) for f, a, p in [(0, 0.1, 0.2), (0, 0.1, 0.2), (0, 0.1, 0.2), (1, 0.1, 0.4)]]
    board = bt.leaderboard(bt.fold_metrics(spark.createDataFrame(rows, SCHEMA))).first()
    assert np.isclose(board.mae, (0.1 + 0.3) / 2) and board.n_folds == 2


def test_leaderboard_keeps_an_undefined_fold_undefined(spark):
    rows = [("A", 0, "m", 0.1, 0.1), ("A", 1, "m", 0.1, 0.0)]
    board = bt.leaderboard(bt.fold_metrics(spark.createDataFrame(rows, SCHEMA))).first()
    assert board.qlike is None and board.mae is not None


def test_wide_and_long_metrics_agree(spark):
    rng = np.random.default_rng(0)
    rows = [("A", int(k % 3), float(a), float(b), float(c)) for k, (a, b, c) in enumerate(rng.uniform(0.1, 1, (60, 3)))]
    wide = spark.createDataFrame(rows, "symbol string, fold int, actual double, naive double, ewma double")
    dated = wide.selectExpr("symbol", "current_date() as date", "fold", "actual", "naive", "ewma")
    keys = ["symbol", "fold", "model"]
    a = bt.fold_metrics_wide(wide, ("naive", "ewma")).toPandas().sort_values(keys).reset_index(drop=True)
    b = bt.fold_metrics(bt.long_forecasts(dated, ("naive", "ewma"))).toPandas().sort_values(keys)
    pd.testing.assert_frame_equal(a, b.reset_index(drop=True)[a.columns])


def test_relative_gain_and_order(spark):
    rows = [("A", "ewma", 2.0, 2.0, 2.0), ("A", "naive", 4.0, 3.0, 1.0), ("A", "learned", 1.9, 1.8, 2.1)]
    board = spark.createDataFrame(rows, "symbol string, model string, rmse double, mae double, qlike double")
    gain = {(r.model, r.metric): r.gain_pct for r in bt.relative_gain(board).collect()}
    assert np.isclose(gain["naive", "rmse"], -100) and np.isclose(gain["naive", "qlike"], 50)
    assert gain["ewma", "mae"] == 0
    assert [r.model for r in bt.ranked(board).collect()] == ["naive", "ewma", "learned"]


def test_combine_puts_boards_under_each_other(spark):
    one = spark.createDataFrame([("A", "naive", 1.0)], "symbol string, model string, rmse double")
    two = spark.createDataFrame([("A", 2.0, "learned")], "symbol string, rmse double, model string")
    assert sorted((r.model, r.rmse) for r in bt.combine(one, two).collect()) == [("learned", 2.0), ("naive", 1.0)]


def test_align_and_side_by_side_keep_common_dates(spark):
    actuals = spark.createDataFrame([("A", 1, 0.1), ("A", 2, 0.2), ("A", 3, None)], "symbol string, date int, actual double")
    preds = spark.createDataFrame([("A", 2, 0.3), ("A", 3, 0.3), ("A", 4, 0.3)], "symbol string, date int, pred double")
    assert [(r.date, r.actual, r.pred) for r in bt.align(actuals, preds).collect()] == [(2, 0.2, 0.3)]
    long = spark.createDataFrame(
        [("A", 1, 0, "x", 0.1, 0.2), ("A", 1, 0, "y", 0.1, 0.3), ("A", 2, 0, "x", 0.1, 0.2)],
        "symbol string, date int, fold int, model string, actual double, pred double",
    )
    assert [(r.date, r.x, r.y) for r in bt.side_by_side(long, ["x", "y"]).collect()] == [(1, 0.2, 0.3)]
