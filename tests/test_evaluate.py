import numpy as np
import pandas as pd
import pytest

from rvpanel.operators.garch import fit_series, garch_params
from rvpanel.plans import backtest as bt
from tests.helpers import RETURNS, frame, random_returns

YEAR = np.sqrt(252)


def _expected(r, k, h, min_train, span=32.0):
    """Leaderboard of one return series by the definitions, in pandas."""
    target = (r.rolling(h).std() * YEAR).shift(-h)
    preds = {"naive": r.rolling(h).std() * YEAR, "ewma": r.ewm(span=span).std() * YEAR}
    n, size, folds = len(r), len(r) // (k + 1), []
    for f in range(k):
        start = n - (k - f) * size
        if start - h < min_train:
            continue
        actual = target.iloc[start : start + size].dropna()
        row = {}
        fit = fit_series(r.iloc[: start - h].to_numpy() * 100)
        v, path = None, []
        for _ in range(h):
            v = fit["omega"] + (
                fit["alpha"] * fit["last_resid_sq"] + fit["beta"] * fit["last_variance"]
                if v is None
                else (fit["alpha"] + fit["beta"]) * v
            )
            path.append(v)
        constant = np.sqrt(np.mean(path) / 1e4) * YEAR
        for model in ("naive", "ewma", "garch"):
            p = preds[model].loc[actual.index] if model in preds else pd.Series(constant, actual.index)
            q = actual**2 / p**2
            row[model] = [np.sqrt(((actual - p) ** 2).mean()), (actual - p).abs().mean(), (q - np.log(q) - 1).mean()]
        folds.append(row)
    return {m: np.mean([f[m] for f in folds], axis=0) for m in ("naive", "ewma", "garch")}


@pytest.fixture(scope="module")
def board(spark):
    pdf = pd.concat([random_returns(400, "A", 1), random_returns(330, "B", 2)])
    rows = bt.evaluate_baselines(frame(spark, pdf, RETURNS), 5, 3, 100)
    return pdf, bt.ranked(rows).toPandas()


def test_three_models_in_order_with_positive_metrics(board):
    _, got = board
    for _, mine in got.groupby("symbol"):
        assert mine.model.tolist() == ["naive", "ewma", "garch"]
    values = got[["rmse", "mae", "qlike"]]
    assert (values > 0).all().all() and not values.isna().any().any()


def test_matches_pandas(board):
    pdf, got = board
    for s in "AB":
        r = pdf[pdf.symbol == s].set_index("date").r
        want = _expected(r, 3, 5, 100)
        for row in got[got.symbol == s].itertuples():
            assert np.allclose([row.rmse, row.mae, row.qlike], want[row.model], rtol=1e-6)


def test_same_result_with_tiny_blocks(spark, board, tiny_groups):
    pdf, got = board
    models = ("naive", "ewma")
    again = bt.evaluate_baselines(frame(spark, pdf, RETURNS), 5, 3, 100, ewma_span=32.0, models=models).toPandas()
    both = got.merge(again, on=["symbol", "model"])
    assert len(both) == 4
    assert np.allclose(both.qlike_x, both.qlike_y, rtol=1e-9) and np.allclose(both.rmse_x, both.rmse_y, rtol=1e-9)


def test_plain_scale_applies_to_target_and_forecasts(spark, board):
    pdf, got = board
    plain = bt.evaluate_baselines(frame(spark, pdf, RETURNS), 5, 3, 100, annualize=False, models=("naive",)).toPandas()
    both = got.merge(plain, on=["symbol", "model"])
    assert np.allclose(both.qlike_x, both.qlike_y) and np.allclose(both.rmse_x, both.rmse_y * YEAR)


def test_no_fold_gives_no_row(spark):
    assert bt.evaluate_baselines(frame(spark, random_returns(50), RETURNS), models=("naive",)).count() == 0


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        bt.baseline_forecasts(frame(spark, random_returns(50), RETURNS), models=("arima",))


def test_garch_only_uses_the_plain_symbol_join(spark, board):
    pdf, got = board
    alone = bt.evaluate_baselines(frame(spark, pdf, RETURNS), 5, 3, 100, models=("garch",)).toPandas()
    both = got.merge(alone, on=["symbol", "model"])
    assert len(both) == 2 and np.allclose(both.qlike_x, both.qlike_y, rtol=1e-9)


def test_garch_sees_train_rows_only(spark):
    pdf = random_returns(400, seed=3)
    poisoned = pdf.copy()
    poisoned.loc[200:, "r"] *= 50
    from rvpanel.operators.layout import number

    a, b = (
        garch_params(number(frame(spark, p, RETURNS)), 3, 5, 50).where("fold = 0").first() for p in (pdf, poisoned)
    )
    assert a.n_obs == 95 and a == b
