import numpy as np
import pandas as pd
import pytest

from rvpanel.operators import garch as ga
from rvpanel.operators.layout import number
from tests.helpers import clustered_returns, frame, random_returns, RETURNS


def _slow_log_likelihood(theta, r, backcast):
    mu, omega, alpha, beta = theta
    e2 = v = backcast
    total = 0.0
    for x in r:
        v = omega + alpha * e2 + beta * v
        e2 = (x - mu) ** 2
        total -= 0.5 * (np.log(2 * np.pi) + np.log(v) + e2 / v)
    return total, e2, v


def test_likelihood_matches_the_recursion(monkeypatch):
    monkeypatch.setattr(ga, "BLOCK_ROWS", 64)
    r = clustered_returns(700)
    theta = np.array([[0.05, 0.04, 0.08, 0.9], [0.0, 0.1, 0.2, 0.5], [0.1, 1.0, 0.0, 0.0], [0.0, 0.01, 0.01, 0.985]])
    backcast = ga.backcast_variance(r, r.mean())
    ll, last_sq, last_v = ga.series_log_likelihood(theta, r, backcast)
    for k, row in enumerate(theta):
        want = _slow_log_likelihood(row, r, backcast)
        assert np.allclose([ll[k], last_sq[k], last_v[k]], want, rtol=1e-11)


@pytest.mark.parametrize("seed", range(3))
def test_fit_finds_simulated_parameters_and_a_maximum(seed):
    r = clustered_returns(3000, seed)
    fit = ga.fit_series(r)
    assert abs(fit["alpha"] - 0.08) < 0.04 and abs(fit["beta"] - 0.9) < 0.05
    assert fit["log_likelihood"] > fit["start_log_likelihood"]
    best = np.array([fit[k] for k in ("mu", "omega", "alpha", "beta")])
    backcast = ga.backcast_variance(r, r.mean())
    for k in range(4):
        for factor in (0.97, 1.03):
            moved = best.copy()
            moved[k] *= factor
            assert ga.series_log_likelihood(moved[None, :], r, backcast)[0][0] < fit["log_likelihood"]


@pytest.mark.parametrize("kind", ["white", "heavy"])
def test_fits_without_clusters_end(kind):
    fits = []
    for seed in range(20):
        rng = np.random.default_rng(seed)
        fits.append(ga.fit_series(rng.normal(0, 1, 800) if kind == "white" else rng.standard_t(3, 400)))
    assert all(f["alpha"] >= 0 and f["beta"] >= 0 and f["log_likelihood"] >= f["start_log_likelihood"] for f in fits)
    assert max(f["rounds"] for f in fits) < ga.MAX_ROUNDS
    # A likelihood that rises to alpha = 0, beta = 1 for ever may end without convergence, and says so.
    open_ends = [f for f in fits if not f["converged"]]
    assert len(open_ends) <= 1 and all(f["alpha"] < 1e-6 for f in open_ends)


def test_unfinished_fits_are_reported(monkeypatch):
    monkeypatch.setattr(ga, "MAX_ROUNDS", 2)
    fit = ga.fit_series(clustered_returns(500, 1))
    assert fit["converged"] is False and fit["rounds"] == 2


def test_no_forecast_without_convergence(spark):
    row = ("A", 0, 0.05, 0.1, 0.8, 4.0, 2.0, False)
    names = "symbol string, fold int, omega double, alpha double, beta double, last_resid_sq double, last_variance double, converged boolean"
    assert ga.garch_forecast(spark.createDataFrame([row], names)).first().pred is None


def test_series_without_variance_is_not_fitted():
    assert ga.fit_series(np.zeros(100)) is None
    assert ga.fit_series(np.array([1.0])) is None


def test_forecast_is_the_mean_of_the_variance_path(spark):
    given = [("A", 0, 0.05, 0.1, 0.8, 4.0, 2.0)]
    df = spark.createDataFrame(
        given, "symbol string, fold int, omega double, alpha double, beta double, last_resid_sq double, last_variance double"
    )
    path = [0.05 + 0.1 * 4 + 0.8 * 2]
    for _ in range(4):
        path.append(0.05 + 0.9 * path[-1])
    for h in (1, 5):
        want = np.sqrt(np.mean(path[:h]) / 1e4)
        assert np.isclose(ga.garch_forecast(df, h, annualize=False).first().pred, want)
        assert np.isclose(ga.garch_forecast(df, h).first().pred, want * np.sqrt(252))


def test_daily_fits_per_symbol_and_fold(spark):
    pdf = pd.concat([random_returns(300, "A", 1), random_returns(200, "B", 2), random_returns(5, "C", 3)])
    got = ga.garch_params(number(frame(spark, pdf, RETURNS)), 3, 5, 60).toPandas()
    assert sorted(zip(got.symbol, got.fold)) == [("A", 0), ("A", 1), ("A", 2), ("B", 1), ("B", 2)]
    assert (got.log_likelihood >= got.start_log_likelihood).all()
    assert ((got.alpha >= 0) & (got.beta >= 0) & (got.alpha + got.beta < 1) & (got.omega > 0)).all()


def test_rounds_over_blocks_find_the_same_fit(spark, monkeypatch):
    n = 500
    r = clustered_returns(n, 7) / 100
    pdf = pd.DataFrame({"symbol": "A", "date": pd.date_range("2024-01-01", periods=n, freq="h"), "r": r})
    numbered = number(frame(spark, pdf, "symbol string, date timestamp, r double"))
    together = ga.fit(numbered, 1, 5, 100).first()
    monkeypatch.setattr(ga, "BLOCK_ROWS", 80)  # not below BACKCAST_ROWS
    monkeypatch.setattr(ga, "_SUPER", 2)
    apart = ga.garch_params(numbered, 1, 5, 100).first()
    assert (apart.symbol, apart.fold, apart.n_obs) == (together.symbol, together.fold, together.n_obs)
    assert apart.converged and together.converged
    # Near the top the likelihood is flat: equal likelihood, nearly equal parameters.
    assert abs(apart.log_likelihood - together.log_likelihood) < 1e-5
    for k in ("mu", "omega", "alpha", "beta", "last_variance"):
        assert np.isclose(apart[k], together[k], rtol=1e-3), k
