import numpy as np
import pandas as pd
import pytest

from rvpanel.operators import ewma
from rvpanel.operators.ewma import block_rows, decay, ewma_forecast
from tests.helpers import RETURNS, frame, random_returns, series


def _expected(pdf, span, annualize=True):
    vol = pdf.set_index("date").r.ewm(span=span).std()
    return vol * np.sqrt(252) if annualize else vol


@pytest.mark.parametrize("span", [1.05, 2.0, 3.0, 32.0, 500.0])
def test_matches_pandas_across_blocks(spark, span):
    pdf = random_returns(1500, seed=5)
    got = series(ewma_forecast(frame(spark, pdf, RETURNS), span), "pred")
    want = _expected(pdf, span)
    assert np.isnan(got.iloc[0]) and got.iloc[1:].notna().all()
    assert np.allclose(got.iloc[1:], want.iloc[1:], rtol=1e-7 if span < 1.5 else 1e-9)


@pytest.mark.parametrize("span", [1.05, 3.0, 500.0, 1e5])
def test_matches_pandas_across_super_blocks(spark, monkeypatch, span):
    """Blocks of at most 8 rows, four of them a super-block: hundreds are carried."""
    monkeypatch.setattr(ewma, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ewma, "SUPER_ROWS", 32)
    pdf = pd.concat([random_returns(1500, seed=8), random_returns(33, "B", seed=9)])
    pdf.loc[pdf.index[400:470], "r"] = np.nan
    out = ewma_forecast(frame(spark, pdf, RETURNS), span)
    for s in ("AAA", "B"):
        want = _expected(pdf[pdf.symbol == s], span)
        assert np.allclose(series(out, "pred", s).iloc[1:], want.iloc[1:], rtol=1e-7, equal_nan=True)


def test_missing_values_age_the_weights(spark):
    pdf = random_returns(600, seed=6)
    pdf.loc[[0, 1, 5, 6, 7, 200, 599], "r"] = np.nan
    pdf.loc[250:450, "r"] = np.nan
    got = series(ewma_forecast(frame(spark, pdf, RETURNS), 3.0, annualize=False), "pred")
    assert np.allclose(got, _expected(pdf, 3.0, False), equal_nan=True, rtol=1e-9)


def test_symbols_do_not_mix(spark):
    pdf = pd.concat([random_returns(300, "A", 1), random_returns(41, "B", 2), random_returns(1, "C", 3)])
    out = ewma_forecast(frame(spark, pdf, RETURNS), 4.0)
    for s in "ABC":
        want = _expected(pdf[pdf.symbol == s], 4.0)
        assert np.allclose(series(out, "pred", s), want, equal_nan=True, rtol=1e-9)


def test_constant_returns_have_no_volatility(spark):
    pdf = random_returns(50).assign(r=0.0)
    got = series(ewma_forecast(frame(spark, pdf, RETURNS)), "pred")
    assert (got.iloc[1:] == 0).all()


def test_span_one_and_bad_span(spark):
    returns = frame(spark, random_returns(5), RETURNS)
    assert series(ewma_forecast(returns, 1.0), "pred").isna().all()
    with pytest.raises(ValueError):
        ewma_forecast(returns, 0.5)


def test_weights_stay_finite_in_a_block():
    for span in (1.01, 2, 32, 1e6):
        assert decay(span) ** (-2 * block_rows(span)) < 1e101
