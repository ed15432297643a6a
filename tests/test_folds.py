import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rvpanel.operators import folds as fo
from rvpanel.operators.layout import number
from tests.helpers import RETURNS, business_days, frame, random_returns


def _index(spark, n, symbol="A"):
    return frame(spark, random_returns(n, symbol), RETURNS)


def _splits(n, k, h):
    """Train and test positions by the definition: equal test blocks at the end."""
    size = n // (k + 1)
    return [(range(0, n - (k - f) * size - h), range(n - (k - f) * size, n - (k - f - 1) * size)) for f in range(k)]


def test_fold_bounds_of_fifty_days(spark):
    rows = fo.fold_bounds(_index(spark, 50), 3, 5, 1).orderBy("fold").collect()
    assert [(r.train_end, r.test_start, r.test_end) for r in rows] == [
        (t[-1] + 1, s[0], s[-1] + 1) for t, s in _splits(50, 3, 5)
    ]
    assert all(a.train_end < b.train_end for a, b in zip(rows, rows[1:]))
    assert rows[-1].test_end == 50


def test_min_train_size_drops_small_folds_but_keeps_numbers(spark):
    rows = fo.fold_bounds(_index(spark, 20), 5, 2, 10).orderBy("fold").collect()
    assert [(r.fold, r.train_end) for r in rows] == [(3, 12), (4, 15)]


def test_too_short_symbols_have_no_folds_or_fail(spark):
    index = _index(spark, 20).union(_index(spark, 4, "B"))
    assert {r.symbol for r in fo.fold_bounds(index, 5, 2, 1).collect()} == {"A"}
    with pytest.raises(PySparkException, match="too few rows"):
        fo.fold_bounds(index, 5, 2, 1, strict=True).collect()


def test_test_rows_follow_the_bounds(spark, tiny_groups):
    numbered = number(_index(spark, 50))
    got = {(r.fold, r.i) for r in fo.test_rows(numbered, 3, 5, 1).collect()}
    assert got == {(f, i) for f, (_, test) in enumerate(_splits(50, 3, 5)) for i in test}


def test_train_rows_and_inner_split(spark, tiny_groups):
    numbered = number(_index(spark, 50))
    got = fo.train_rows(numbered, 3, 5, 1, val_frac=0.2).toPandas()
    for f, (train, _) in enumerate(_splits(50, 3, 5)):
        mine = got[got.fold == f]
        held = int(len(train) * 0.2)
        assert sorted(mine[mine.part == "train"].i) == list(train)[: len(train) - held]
        assert sorted(mine[mine.part == "validation"].i) == list(train)[len(train) - held :]


def test_inner_gap_drops_rows_before_validation(spark):
    got = fo.train_rows(number(_index(spark, 50)), 3, 5, 1, 0.2, inner_gap=3).toPandas()
    for _, mine in got.groupby("fold"):
        first = mine[mine.part == "validation"].i.min()
        assert mine[mine.part == "train"].i.max() == first - 4


def test_validation_fraction_must_leave_both_parts():
    for bad in (0.0, 1.0, -0.1):
        with pytest.raises(ValueError):
            fo.check_val_frac(bad)


def test_positions_are_exact_in_any_input_order(spark, tiny_groups):
    pdf = pd.concat([random_returns(150, "A"), random_returns(70, "B", start="2018-05-07")])
    got = number(frame(spark, pdf, RETURNS)).toPandas().sort_values(["symbol", "date"])
    assert got[got.symbol == "A"].i.tolist() == list(range(150))
    assert got[got.symbol == "B"].i.tolist() == list(range(70))
    assert set(zip(got.symbol, got.n)) == {("A", 150), ("B", 70)}


def _table(spark, rows):
    return spark.createDataFrame(rows, "symbol string, fold int, train_last date, test_first date")


def test_own_folds_have_no_violation(spark, tiny_groups):
    index = _index(spark, 50)
    dates = fo.fold_dates(number(index), fo.fold_bounds(index, 3, 5, 1))
    assert fo.fold_violations(index, dates, 5).count() == 0


def test_overlap_and_embargo_violations(spark, tiny_groups):
    days = business_days(20)
    index = _index(spark, 20)
    folds = _table(spark, [("A", 0, days[14], days[12]), ("A", 1, days[9], days[11]), ("A", 2, days[3], days[9])])
    rows = {r.fold: r for r in fo.fold_violations(index, folds, 5).collect()}
    assert set(rows) == {0, 1}
    assert rows[0].fault == "overlap" and rows[0].message.startswith("test starts at")
    assert rows[1].fault == "embargo" and rows[1].message == "gap is 1 of at least 5 rows"
    with pytest.raises(PySparkException, match="gap is"):
        fo.fold_violations(index, folds.where("fold = 1"), 5, strict=True).collect()


def test_violations_of_dates_outside_the_index(spark, tiny_groups):
    days = business_days(20)
    weekend = pd.Timestamp("2018-01-13").date()
    folds = _table(spark, [("A", 0, weekend, days[12])])
    expected = sum(weekend < d < days[12] for d in days)
    row = fo.fold_violations(_index(spark, 20), folds, 100).first()
    assert row.gap_rows == expected


def test_calendar_keeps_train_before_test_over_all_symbols(spark, tiny_groups):
    pdf = pd.concat([random_returns(120, "A"), random_returns(60, "B", start="2018-04-02")])
    numbered = fo.number_by_calendar(frame(spark, pdf, RETURNS))
    test = fo.test_rows(numbered, 3, 5, 1).groupBy("fold").agg(F.min("date").alias("first")).toPandas()
    train = fo.train_rows(numbered, 3, 5, 1).groupBy("fold").agg(F.max("date").alias("last")).toPandas()
    both = test.merge(train, on="fold")
    assert len(both) == 3
    calendar = np.array(sorted(set(pdf.date)))
    for row in both.itertuples():
        assert ((calendar > row.last) & (calendar < row.first)).sum() >= 5


def test_select_dates(spark):
    days = business_days(20)
    index = _index(spark, 10)
    labels = spark.createDataFrame([("A", days[2]), ("A", days[5])], "symbol string, date date")
    assert sorted(r.date for r in fo.select_dates(index, labels, strict=True).collect()) == [days[2], days[5]]
    missing = spark.createDataFrame([("A", days[15])], "symbol string, date date")
    assert fo.select_dates(index, missing).count() == 0
    with pytest.raises(PySparkException, match="no row for A"):
        fo.select_dates(index, missing, strict=True).collect()


def test_last_fold(spark):
    index = _index(spark, 50)
    bounds = fo.fold_bounds(index, 3, 5, 1)
    got = fo.last_fold(fo.test_rows(number(index), 3, 5, 1), bounds)
    assert {r.fold for r in got.collect()} == {2}
