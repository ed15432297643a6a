import numpy as np
import pandas as pd

from rvpanel.operators import folds as fo
from rvpanel.operators.layout import number
from rvpanel.operators.scaling import apply_scaler, fit_scaler
from tests.helpers import business_days, frame

SCHEMA = "symbol string, date date, f1 double, f2 double, target double"


def _rows(n, symbol, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {"symbol": symbol, "date": business_days(n), "f1": rng.normal(1e6, 1, n), "f2": 3.0, "target": rng.normal(size=n)}
    )


def test_scaler_uses_inner_train_rows_only(spark, tiny_groups):
    pdf = pd.concat([_rows(100, "A", 0), _rows(61, "B", 1)])
    numbered = number(frame(spark, pdf, SCHEMA))
    scaler = fit_scaler(numbered, ["f1", "f2"], 3, 5, 1, 0.2).toPandas()
    assert len(scaler) == 6
    for s, n in (("A", 100), ("B", 61)):
        x = pdf[pdf.symbol == s].f1.to_numpy()
        for f in range(3):
            train_end = n - (3 - f) * (n // 4) - 5
            inner = x[: train_end - int(train_end * 0.2)]
            row = scaler[(scaler.symbol == s) & (scaler.fold == f)].iloc[0]
            assert np.isclose(row.mean_f1, inner.mean(), rtol=1e-14)
            assert np.isclose(row.std_f1, inner.std(), rtol=1e-8)
            assert row.mean_f2 == 3.0 and row.std_f2 == 1.0


def test_segments_agree_with_exploded_train_rows(spark, tiny_groups):
    pdf = _rows(90, "A", 2)
    numbered = number(frame(spark, pdf, SCHEMA))
    merged = fit_scaler(numbered, ["f1"], 5, 2, 10, 0.3, inner_gap=2).toPandas().set_index("fold")
    rows = fo.train_rows(numbered, 5, 2, 10, 0.3, inner_gap=2).where("part = 'train'").toPandas()
    plain = rows.groupby("fold").f1.agg(["mean", lambda v: v.std(ddof=0)])
    assert sorted(merged.index) == sorted(plain.index)
    assert np.allclose(merged.sort_index()[["mean_f1", "std_f1"]], plain.sort_index(), rtol=1e-8)


def test_later_rows_do_not_touch_the_scaler(spark, tiny_groups):
    pdf = _rows(100, "A", 3)
    poisoned = pdf.copy()
    poisoned.loc[40:, "f1"] = -1e9
    clean, dirty = (
        fit_scaler(number(frame(spark, p, SCHEMA)), ["f1"], 3, 5, 1, 0.2).where("fold = 0").first() for p in (pdf, poisoned)
    )
    assert clean == dirty


def test_apply_scales_features_and_leaves_the_target(spark, tiny_groups):
    pdf = pd.concat([_rows(100, "A", 4), _rows(80, "B", 5)])
    numbered = number(frame(spark, pdf, SCHEMA))
    scaler = fit_scaler(numbered, ["f1", "f2"], 3, 5, 1, 0.2)
    got = apply_scaler(fo.test_rows(numbered, 3, 5, 1), scaler, ["f1", "f2"]).toPandas()
    s = scaler.toPandas().set_index(["symbol", "fold"])
    raw = pdf.set_index(["symbol", "date"])
    assert len(got) == 3 * 25 + 3 * 20
    for row in got.itertuples():
        fit, source = s.loc[(row.symbol, row.fold)], raw.loc[(row.symbol, row.date)]
        assert np.isclose(row.f1, (source.f1 - fit.mean_f1) / fit.std_f1)
        assert row.f2 == 0 and row.target == source.target
