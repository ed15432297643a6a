import numpy as np
import pandas as pd
import pytest

from rvpanel.operators import features as fe
from rvpanel.operators import layout
from rvpanel.operators.layout import number
from rvpanel.operators.packed import pack, read_blocks
from tests.helpers import PANEL, RETURNS, business_days, frame, random_prices, random_returns, series

YEAR = np.sqrt(252)


def test_log_return_of_known_ratios(spark):
    pdf = pd.DataFrame({"symbol": "A", "date": business_days(5), "px": [12.0, 3.0, 3.0, 7.5, 30.0]})
    r = series(fe.log_returns(frame(spark, pdf, PANEL)), "r")
    assert r.isna().tolist() == [True] + [False] * 4
    assert np.allclose(r.iloc[1:], [-2 * np.log(2), 0, np.log(2.5), 2 * np.log(2)])


def test_log_return_never_crosses_symbols_or_loses_rows_at_borders(spark, tiny_groups):
    pdf = pd.concat([random_prices(100, "A", 1), random_prices(37, "B", 2, "2018-03-05")])
    out = fe.log_returns(frame(spark, pdf, PANEL))
    for s in "AB":
        px = pdf[pdf.symbol == s].set_index("date").px
        want = np.log(px / px.shift(1))
        got = series(out, "r", s)
        assert got.index.tolist() == want.index.tolist()
        assert np.allclose(got, want, equal_nan=True, rtol=1e-13)


def test_missing_price_leaves_two_returns_missing(spark, tiny_groups):
    pdf = random_prices(40)
    pdf.loc[[0, 10, 22, 23], "px"] = np.nan
    got = series(fe.log_returns(frame(spark, pdf, PANEL)), "r")
    px = pdf.set_index("date").px
    assert np.allclose(got, np.log(px / px.shift(1)), equal_nan=True)


def test_numbered_returns_equal_the_separate_steps(spark, tiny_groups):
    pdf = pd.concat([random_prices(90, "A", 3), random_prices(50, "B", 4)])
    pdf.loc[pdf.index.isin([0, 17, 18, 33]), "px"] = np.nan
    out = fe.numbered_returns(frame(spark, pdf, PANEL)).toPandas().sort_values(["symbol", "date"])
    want = pdf.sort_values(["symbol", "date"]).copy()
    want["r"] = want.groupby("symbol").px.transform(lambda p: np.log(p / p.shift(1)))
    want = want.dropna(subset="r")
    assert np.allclose(out.r, want.r)
    assert out.i.tolist() == want.groupby("symbol").cumcount().tolist()
    assert out.n.tolist() == want.groupby("symbol").r.transform("size").tolist()


@pytest.mark.parametrize("window", [2, 5, 20])
def test_realized_vol_matches_pandas(spark, tiny_groups, window):
    pdf = random_returns(70)
    pdf.loc[30, "r"] = np.nan
    got = series(fe.realized_vol(frame(spark, pdf, RETURNS), window), "rv")
    want = pdf.set_index("date").r.rolling(window).std() * YEAR
    assert np.allclose(got, want, equal_nan=True, rtol=1e-10)


def test_realized_vol_frame_edges_and_plain_scale(spark):
    pdf = pd.DataFrame({"symbol": "A", "date": business_days(5), "r": [0.004, 0.0, -0.013, 0.022, 0.007]})
    got = series(fe.realized_vol(frame(spark, pdf, RETURNS), 3, annualize=False), "rv")
    assert got.isna().tolist() == [True, True, False, False, False]
    assert np.isclose(got.iloc[2], np.std([0.004, 0.0, -0.013], ddof=1))


def test_target_is_the_vol_of_the_following_rows(spark, tiny_groups):
    pdf = random_returns(60, seed=1)
    got = series(fe.realized_vol_target(frame(spark, pdf, RETURNS), 5), "rv_target")
    want = (pdf.set_index("date").r.rolling(5).std() * YEAR).shift(-5)
    assert np.allclose(got, want, equal_nan=True, rtol=1e-10)
    assert got.isna().sum() == 5 and got.iloc[-5:].isna().all()


@pytest.mark.parametrize("day", [7, 8, 15])
def test_target_never_sees_its_own_day(spark, tiny_groups, day):
    pdf = random_returns(20)
    poisoned = pdf.copy()
    poisoned.loc[day, "r"] = 999.0
    before = series(fe.realized_vol_target(frame(spark, pdf, RETURNS), 3), "rv_target")
    after = series(fe.realized_vol_target(frame(spark, poisoned, RETURNS), 3), "rv_target")
    assert (np.isnan(before.iloc[day]) and np.isnan(after.iloc[day])) or before.iloc[day] == after.iloc[day]
    if day < 16:
        assert before.iloc[day - 1] != after.iloc[day - 1]


def test_naive_is_the_rolling_vol(spark):
    returns = frame(spark, random_returns(50), RETURNS)
    naive = series(fe.naive_forecast(returns, 5), "pred")
    assert np.allclose(naive, series(fe.realized_vol(returns, 5), "rv"), equal_nan=True)


@pytest.mark.parametrize("rows", [1, -5, 12])
def test_shift(spark, tiny_groups, rows):
    pdf = random_returns(45)
    got = series(fe.shift(frame(spark, pdf, RETURNS), "r", s=rows), "s")
    assert np.allclose(got, pdf.set_index("date").r.shift(rows), equal_nan=True)


def _features(px, horizon=5):
    r = np.log(px / px.shift(1))
    out = {"log_returns": r, **{f"rv_{n}d": r.rolling(n).std() * YEAR for n in (5, 20, 60)}}
    out["rv_target"] = (r.rolling(horizon).std() * YEAR).shift(-horizon)
    return pd.DataFrame(out).dropna()


def test_feature_frame_matches_pandas_per_symbol(spark, tiny_groups):
    pdf = pd.concat([random_prices(300, "A", 42), random_prices(66, "B", 1), random_prices(65, "C", 2)])
    got = fe.build_features(frame(spark, pdf, PANEL)).toPandas()
    assert not got.isna().any().any()
    assert got.groupby("symbol").size().to_dict() == {"A": 300 - 65, "B": 1}
    want = _features(pdf[pdf.symbol == "A"].set_index("date").px)
    mine = got[got.symbol == "A"].sort_values("date").set_index("date")[want.columns]
    assert np.allclose(mine, want, rtol=1e-9)


def test_feature_frame_with_a_missing_price(spark, tiny_groups):
    pdf = random_prices(200)
    pdf.loc[80, "px"] = np.nan
    want = _features(pdf.set_index("date").px)
    got = fe.build_features(frame(spark, pdf, PANEL)).toPandas().sort_values("date").set_index("date")
    assert got.index.tolist() == want.index.tolist()
    assert np.allclose(got[want.columns], want, rtol=1e-9)


def _sequence_input(spark, n=100):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=["f1", "f2", "f3", "target"])
    pdf.insert(0, "date", business_days(n))
    pdf.insert(0, "symbol", "A")
    return pdf, frame(spark, pdf, "symbol string, date date, f1 double, f2 double, f3 double, target double")


def test_sequence_windows_shape_content_and_target(spark, tiny_groups):
    pdf, df = _sequence_input(spark)
    out = fe.sequence_windows(df, 10, ["f1", "f2", "f3"], "target")
    assert out.schema["x"].dataType.simpleString() == "array<array<float>>"
    assert out.schema["y"].dataType.simpleString() == "float"
    rows = sorted(out.collect(), key=lambda r: r.date)
    assert len(rows) == 100 - 10 + 1
    values = pdf[["f1", "f2", "f3"]].to_numpy(np.float32)
    for k in (0, 41, 90):
        assert np.array_equal(np.array(rows[k].x, np.float32), values[k : k + 10])
        assert rows[k].y == np.float32(pdf.target[k + 9])
        assert rows[k].date == pdf.date[k + 9]


def test_sequence_longer_than_the_series_gives_nothing(spark):
    _, df = _sequence_input(spark, 9)
    assert fe.sequence_windows(df, 10, ["f1", "f2", "f3"], "target").count() == 0


def test_intraday_panel_has_day_buckets(spark, tiny_groups):
    n = 300
    stamps = pd.date_range("2024-01-01", periods=n, freq="h")
    pdf = random_prices(n)
    pdf["date"] = stamps
    got = fe.build_features(frame(spark, pdf, "symbol string, date timestamp, px double"))
    want = _features(pd.Series(pdf.px.to_numpy(), index=stamps))
    mine = got.toPandas().sort_values("date")
    assert np.allclose(mine[want.columns], want, rtol=1e-9)


@pytest.fixture
def gappy(spark):
    """Missing prices: whole blocks without a feature row, and blocks with one or two."""
    pdf = pd.concat([random_prices(400, "A", 1), random_prices(150, "B", 2), random_prices(9, "C", 3)])
    pdf = pdf.reset_index(drop=True)
    pdf.loc[[50, 51, 90, 104, 118, 200, 239, 253, 399, 480], "px"] = np.nan
    return frame(spark, pdf, PANEL)


def test_feature_rows_are_numbered_where_they_are(spark, tiny_groups, gappy):
    kept = fe.feature_rows(gappy, 3, (2, 5)).toPandas().sort_values(["symbol", "i"], ignore_index=True)
    plain = number(fe.build_features(gappy, 3, (2, 5))).toPandas().sort_values(["symbol", "i"], ignore_index=True)
    columns = ["symbol", "date", "i", "n", "log_returns", "rv_5d", "rv_target"]
    pd.testing.assert_frame_equal(kept[columns], plain[columns])
    assert kept._block.max() >= 40 and (kept.groupby(["symbol", "_block"]).size() < 3).any()


@pytest.mark.parametrize("length", [1, 2, 7, 30])
@pytest.mark.parametrize("mode", ["rows", "calendar"])
def test_packed_windows_reach_over_sparse_blocks(spark, tiny_groups, gappy, length, mode):
    columns = ["log_returns", "rv_5d"]
    packed = pack(gappy, length, 3, columns, mode=mode)
    got = {(r.symbol, r.date): (np.array([list(step) for step in r.x], np.float32), r.y) for r in fe.sequence_windows(packed, length, columns).toPandas().itertuples()}
    plain = fe.build_features(gappy, 3).toPandas().sort_values(["symbol", "date"], ignore_index=True)
    order = {d: k for k, d in enumerate(sorted(plain.date.unique()))}
    plain["p"] = plain.date.map(order) if mode == "calendar" else plain.groupby("symbol").cumcount()
    want, first = {}, {}
    for symbol, part in plain.groupby("symbol"):
        values = part[columns].to_numpy(np.float32)
        for k in range(length - 1, len(part)):
            want[symbol, part.date.iloc[k]] = values[k - length + 1 : k + 1], np.float32(part.rv_target.iloc[k])
            first[symbol, part.date.iloc[k]] = part.p.iloc[k - length + 1], part.p.iloc[k]
    assert got.keys() == want.keys() and len(want) > 60
    assert all(np.array_equal(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)
    # The positions of every window's ends, as the learned models read them.
    m = len(order) if mode == "calendar" else None
    seen = {}
    for block in read_blocks(packed.toArrow().to_batches(), 2):
        for at in block.ends(length, 0, 1 << 40):
            seen[block.symbol, block.date[at - block.lead].as_py()] = block.p[at - length + 1], block.p[at]
        assert m is None or block.m == m
    assert seen == first


def test_blocks_are_summed_up_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(layout, "SUPER_BLOCKS", 4)
    rng = np.random.default_rng(1)
    rows = [(s, b, int(rng.integers(1, 9))) for s in "AB" for b in range(30) if b not in (3, 4, 5, 6, 7, 8, 20)]
    got = layout.block_starts(spark.createDataFrame(rows, "symbol string, _block long, _count long").repartition(3)).collect()
    for symbol in "AB":
        start = 0
        for _, b, count in sorted(r for r in rows if r[0] == symbol):
            assert [(r._start, r.n) for r in got if r.symbol == symbol and r._block == b] == [(start, sum(c for s, _, c in rows if s == symbol))]
            start += count


def test_rows_without_keys_are_counted_or_an_error(spark):
    rows = [("A", d, float(k + 1)) for k, d in enumerate(business_days(4))] + [("A", None, 2.0), (None, business_days(1)[0], 3.0)]
    panel = spark.createDataFrame(rows, PANEL)
    assert tuple(layout.missing_keys(panel).first()) == (6, 1, 1)
    for build in (fe.log_returns, fe.numbered_returns):
        assert build(panel).count() == (4 if build is fe.log_returns else 3)
        with pytest.raises(Exception, match="a row without"):
            build(panel, strict=True).count()
        assert build(panel.dropna(subset=["symbol", "date"]), strict=True).count() == build(panel).count()
