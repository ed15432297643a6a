import datetime as dt
import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rvpanel.schema import BARS
from rvpanel.sources import bars as ba
from tests.helpers import business_days


def _bars(spark, symbol, n=5, price=1.0, start="2020-01-01"):
    rows = [(symbol, d, price, price, price, price, price, 100) for d in business_days(n, start)]
    return spark.createDataFrame(rows, BARS)


def test_default_basket_and_context(spark):
    rows = {r.symbol: r.is_target for r in ba.basket(spark).collect()}
    assert len(rows) == 35 and not rows["^VIX"] and rows["AAPL"]
    assert ba.basket(spark, []).count() == 35 and ba.basket(spark, None).count() == 35
    assert [r.symbol for r in ba.basket(spark, ["AAPL"]).collect()] == ["AAPL"]


def test_basket_file(spark, tmp_path):
    path = tmp_path / "tickers.yaml"
    path.write_text('# note\ntickers:\n  # group\n  - AAPL\n  - MSFT # two\n  - "^VIX"\n')
    rows = {r.symbol: r.is_target for r in ba.read_basket(spark, str(path)).collect()}
    assert rows == {"AAPL": True, "MSFT": True, "^VIX": False}


def test_safe_name_removes_carets(spark):
    df = spark.createDataFrame([("^VIX",), ("AAPL",), ("^a^b",)], "s string")
    assert [r[0] for r in df.select(ba.safe_name("s")).collect()] == ["VIX", "AAPL", "ab"]


def test_in_basket_filters_targets(spark):
    bars = _bars(spark, "AAPL").union(_bars(spark, "^VIX")).union(_bars(spark, "OTHER"))
    names = ba.basket(spark, ["AAPL", "^VIX"])
    assert {r.symbol for r in ba.in_basket(bars, names).collect()} == {"AAPL", "^VIX"}
    assert {r.symbol for r in ba.in_basket(bars, names, targets_only=True).collect()} == {"AAPL"}


def test_vendor_columns_and_nan(spark, tmp_path):
    pdf = pd.DataFrame(
        {"Open": [1.0, np.nan], "High": 2.0, "Low": 0.5, "Close": 1.5, "Adj Close": [np.inf, 1.4], "Volume": [10, 20]}
    )
    pdf.insert(0, "Ticker", "AAPL")
    pdf.insert(1, "Date", pd.to_datetime(["2020-01-01", "2020-01-02"]).astype("datetime64[us]"))
    path = str(tmp_path / "landing.parquet")
    pdf.to_parquet(path)
    got = ba.read_bars(spark, path)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in BARS]
    a, b = got.orderBy("date").collect()
    assert a.adj_close is None and b.open is None and b.adj_close == 1.4 and a.date == dt.date(2020, 1, 1)


def test_one_file_per_symbol_with_a_date_index(spark, tmp_path):
    for name in ("AAPL", "MSFT"):
        index = pd.date_range("2020-01-01", periods=3, tz="America/New_York", name="date").astype(
            "datetime64[ns, America/New_York]"
        )
        pd.DataFrame({"Adj Close": [1.0, np.nan, 3.0], "Volume": [1, 2, 3]}, index=index).to_parquet(
            tmp_path / f"{name}.parquet"
        )
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        rows = ba.read_bars(spark, str(tmp_path)).orderBy("symbol", "date").collect()
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")
    assert [(r.symbol, str(r.date), r.adj_close, r.volume) for r in rows[:3]] == [
        ("AAPL", "2020-01-01", 1.0, 1),
        ("AAPL", "2020-01-02", None, 2),
        ("AAPL", "2020-01-03", 3.0, 3),
    ]
    assert len(rows) == 6 and rows[3].symbol == "MSFT"


@pytest.mark.parametrize("source", ["csv", "json"])
def test_text_sources_use_the_declared_schema(spark, tmp_path, source):
    path = str(tmp_path / source)
    writer = _bars(spark, "AAPL").write
    (writer.option("header", "true") if source == "csv" else writer).format(source).save(path)
    got = ba.read_bars(spark, path, source)
    assert got.count() == 5 and got.schema["volume"].dataType == BARS["volume"].dataType
    assert got.agg(F.sum("adj_close")).first()[0] == 5.0


def test_vendor_text_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "0700.csv").write_text(
        "Volume,Date,Open,High,Low,Close,Adj Close\n10,2020-01-01,1,2,0.5,1.5,1.25\n,2020-01-02,nan,2,1,null,1.5\n"
    )
    a, b = ba.read_bars(spark, str(tmp_path / "csv"), "csv").orderBy("date").collect()
    assert tuple(a) == ("0700", dt.date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 1.25, 10)
    assert (b.open, b.close, b.adj_close, b.volume) == (None, None, 1.5, None)
    (tmp_path / "bars.json").write_text('{"Adj Close": 2.5, "Ticker": "^VIX", "Date": "2020-01-03", "Volume": 7}\n')
    row = ba.read_bars(spark, str(tmp_path / "bars.json"), "json").first()
    assert (row.symbol, row.date, row.adj_close, row.volume, row.open) == ("^VIX", dt.date(2020, 1, 3), 2.5, 7, None)


def test_files_without_dates_or_prices_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Volume\n2020-01-01,3\n")
    (tmp_path / "b.csv").write_text("Close,Volume\n1.0,3\n")
    for name in ("a.csv", "b.csv"):
        with pytest.raises(ValueError, match="no date or no closing price"):
            ba.read_bars(spark, str(tmp_path / name), "csv")


@pytest.mark.parametrize("symbol", ["^VIX", "0700", "1E5"])
def test_symbols_survive_the_cache(spark, tmp_path, symbol):
    path = str(tmp_path / "cache")
    ba.write_bars(_bars(spark, symbol).union(_bars(spark, "OTHER")), path)
    assert {r.symbol for r in ba.read_series(spark, path, symbol).collect()} == {symbol}
    again = ba.in_basket(ba.read_bars(spark, path), ba.basket(spark, [symbol]))
    assert {r.symbol for r in again.collect()} == {symbol} and again.count() == 5


def test_writing_refuses_shared_folders(spark, tmp_path):
    with pytest.raises(ValueError, match="share the directory"):
        ba.write_bars(_bars(spark, "VIX").union(_bars(spark, "^VIX")), str(tmp_path / "c"))


def test_basket_has_each_symbol_once_and_its_key_only(spark, tmp_path):
    assert ba.basket(spark, ["AAPL", "AAPL"]).count() == 1
    path = tmp_path / "s.yaml"
    path.write_text("exclude:\n  - BAD\ntickers:\n  # big\n  - AAPL\n\n  - AAPL\n- MSFT\nother:\n  - WORSE\n")
    assert sorted(r.symbol for r in ba.read_basket(spark, str(path)).collect()) == ["AAPL", "MSFT"]


def test_rows_without_a_date_are_reported(spark):
    bars = _bars(spark, "A").union(spark.createDataFrame([("A", None, *[1.0] * 5, 1)] * 2, BARS))
    row = ba.ingest_status(ba.basket(spark, ["A"]), bars).first()
    assert (row.ok, row.n_rows, row.error) == (False, 7, "2 rows without a date")


def test_store_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from rvpanel.sources.store import shared_folder

    conf = N(get=lambda k, d=None: d, set=lambda k, v: None)
    made = lambda master, folder=None: N(conf=conf, sparkContext=N(master=master, getCheckpointDir=lambda: folder))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(made(master))
    assert shared_folder(made("yarn", "hdfs://x/y/")) == "hdfs://x/y"


def test_released_tables_are_gone(spark):
    from rvpanel.sources.store import materialize, release

    df = materialize(spark.range(3).toDF("a"))
    assert df.count() == 3
    release(df)
    assert not os.path.exists(df.stored_at.removeprefix("file:"))


def test_bars_from_ticks(spark):
    day = dt.datetime(2024, 1, 1)
    ticks = [("A", day.replace(hour=h), i, p) for h, i, p in [(9, 1, 10.0), (9, 0, 11.0), (12, 2, 8.0), (15, 3, 9.0)]]
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, id int, px double").repartition(3)
    bar = ba.build_bars(df, tie="id").first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (11.0, 11.0, 8.0, 9.0, 4)
    for bars in (ba.build_bars(df, tie="id"), ba.build_bars(df, "1 hour")):
        assert "SortAggregate" not in bars._jdf.queryExecution().executedPlan().toString()


def test_cache_replaces_only_arriving_symbols(spark, tmp_path):
    path = str(tmp_path / "cache")
    ba.write_bars(_bars(spark, "AAPL", 300).union(_bars(spark, "^VIX", 4)), path)
    assert sorted(os.path.basename(p) for p in glob.glob(path + "/safe_name=*")) == ["safe_name=AAPL", "safe_name=VIX"]
    ba.write_bars(_bars(spark, "AAPL", 3, price=2.0), path)
    aapl = ba.read_series(spark, path, "AAPL")
    assert aapl.count() == 3 and aapl.first().adj_close == 2.0
    assert ba.read_series(spark, path, "^VIX").count() == 4


def test_series_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "cache")
    ba.write_bars(_bars(spark, "AAPL").union(_bars(spark, "MSFT")), path)
    plan = ba.read_series(spark, path, "AAPL")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<symbol:string,date:date,adj_close:double>" in plan
    assert "PartitionFilters: [isnotnull(safe_name" in plan and "= AAPL)]" in plan


def test_one_bad_symbol_does_not_stop_the_basket(spark, tmp_path):
    path = str(tmp_path / "cache")
    good, zero = _bars(spark, "AAPL"), _bars(spark, "ZERO", 3, price=0.0)
    twice = _bars(spark, "TWICE").union(_bars(spark, "TWICE"))
    status = ba.ingest_basket(
        spark, good.union(zero).union(twice).union(_bars(spark, "OTHER")), path, ["AAPL", "BAD", "ZERO", "TWICE"]
    )
    rows = {r.symbol: r for r in status.collect()}
    assert rows["AAPL"].ok and rows["AAPL"].n_rows == 5 and rows["AAPL"].error is None
    assert not rows["BAD"].ok and "no data" in rows["BAD"].error and rows["BAD"].n_rows == 0
    assert rows["ZERO"].error == "3 non-positive prices" and rows["TWICE"].error == "5 repeated dates"
    assert [os.path.basename(p) for p in glob.glob(path + "/safe_name=*")] == ["safe_name=AAPL"]
    summary = ba.ingest_summary(status).first()
    assert (summary.n_ok, summary.n_total, summary.failed) == (1, 4, ["BAD", "TWICE", "ZERO"])


def test_names_that_share_a_directory_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="VIX"):
        ba.ingest_basket(spark, _bars(spark, "VIX"), str(tmp_path), ["VIX", "^VIX"])


def test_coverage_and_head(spark):
    bars = _bars(spark, "A", 7).union(_bars(spark, "B", 2)).repartition(4)
    rows = {r.symbol: r for r in ba.coverage(bars).collect()}
    days = business_days(7, "2020-01-01")
    assert (rows["A"].n_rows, rows["A"].first_date, rows["A"].last_date) == (7, days[0], days[-1])
    assert [r.date for r in ba.head(bars, "A").collect()] == list(days[:3])


def test_price_panel_has_positive_prices_or_null(spark):
    bars = _bars(spark, "A", 2).union(_bars(spark, "A", 1, price=-1.0, start="2021-01-04"))
    assert sorted(str(r.px) for r in ba.price_panel(bars).collect()) == ["1.0", "1.0", "None"]


def test_a_cached_basket_reads_its_own_folders_only(spark, tmp_path):
    path, names = str(tmp_path / "bars"), ["AAPL", "^VIX", "MSFT", "KO"]
    bars = _bars(spark, names[0])
    for name in names[1:]:
        bars = bars.union(_bars(spark, name))
    ba.write_bars(bars, path)
    basket = spark.createDataFrame([("AAPL", True), ("^VIX", True), ("KO", False), ("VIX", True), (None, True), ("GONE", True)], "symbol string, is_target boolean")
    basket.write.parquet(str(tmp_path / "basket"))
    stored = spark.read.parquet(str(tmp_path / "basket"))
    got = ba.read_cached(spark, path, stored, targets_only=True)
    assert {r.symbol for r in got.collect()} == {"AAPL", "^VIX"}
    assert {r.symbol for r in ba.read_cached(spark, path, stored).collect()} == {"AAPL", "^VIX", "KO"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "ReadSchema: struct<symbol:string,date:date,adj_close:double>" in plan
    # Files of other symbols may be gone: nobody opens them.
    import shutil

    shutil.copytree(path, tmp_path / "fewer", ignore=shutil.ignore_patterns("safe_name=MSFT", "safe_name=KO"))
    assert ba.read_cached(spark, str(tmp_path / "fewer"), stored, targets_only=True).count() == got.count()
