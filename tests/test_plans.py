"""What the physical plans must look like to hold at scale."""

import re

import pandas as pd
import pytest

from rvpanel.operators import features as fe
from rvpanel.operators.ewma import ewma_forecast
from rvpanel.operators.folds import test_rows as rows_tested
from rvpanel.operators.packed import pack
from rvpanel.operators.scaling import apply_scaler, fit_scaler
from rvpanel.plans import backtest as bt
from rvpanel.queries import vwap_daily

SF = "/root/testdata/sf0.001"


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def _row_windows_by_symbol(plan):
    """Windows partitioned by symbol alone, other than those on the bucket or super-block table."""
    found = []
    for spec in re.findall(r"windowspecdefinition\(([^()]*(?:\([^()]*\)[^()]*)*)\)", plan):
        keys = [k.strip() for k in spec.split(",") if "#" in k and "ASC" not in k]
        order = [k.strip() for k in spec.split(",") if "ASC" in k]
        if len(keys) == 1 and not all(re.match(r"_bucket#|_super#", o) for o in order):
            found.append(spec)
    return found


@pytest.fixture(scope="module")
def panel(spark):
    return vwap_daily(spark, SF)


def test_feature_frame_scans_once_and_shuffles_rows_twice(panel):
    plan = _final_plan(fe.build_features(panel))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
    by_rows = re.findall(r"Exchange hashpartitioning\(symbol#\d+, (_bucket|_block)#\d+L?, \d+\), REPARTITION", plan)
    reused = re.findall(r"ReusedExchange[^\n]*REPARTITION", plan)
    assert len(by_rows) - len(reused) == 2 and sorted(set(by_rows)) == ["_block", "_bucket"]
    assert _row_windows_by_symbol(plan) == []


def _row_shuffles(plan):
    """Exchanges of rows by bucket or block, those that are used again counted once."""
    by_rows = re.findall(r"Exchange hashpartitioning\(symbol#\d+, (_bucket|_block)#\d+L?, \d+\), REPARTITION", plan)
    return len(by_rows) - len(re.findall(r"ReusedExchange[^\n]*REPARTITION", plan))


def test_scaling_keeps_the_layout_of_the_features(panel):
    rows = fe.feature_rows(panel)
    plan = _final_plan(apply_scaler(rows_tested(rows), fit_scaler(rows)))
    assert _row_windows_by_symbol(plan) == []
    # The scaler's branch reads fewer columns, so it may run the two row shuffles of its own.
    assert _row_shuffles(plan) <= 4


def test_packed_windows_are_cut_without_a_shuffle_or_python(panel):
    packed = pack(panel, 30)
    plan = _final_plan(fe.sequence_windows(packed, 30))
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan
    # Windows are not stored: a packed table holds little more than the frame.
    values = packed.selectExpr("sum(size(f) + size(y) + size(p))").first()[0]
    frame = fe.build_features(panel).count() * 6
    assert values <= 1.5 * frame


@pytest.mark.parametrize(
    "build",
    [
        lambda p: ewma_forecast(fe.numbered_returns(p)),
        lambda p: bt.evaluate_baselines(fe.numbered_returns(p), models=("naive", "ewma")),
        lambda p: fe.log_returns(p),
        lambda p: fe.sequence_windows(fe.build_features(p), 30),
        lambda p: fe.feature_rows(p),
    ],
)
def test_no_row_window_gathers_a_symbol_and_nothing_runs_in_python(panel, build):
    plan = _final_plan(build(panel))
    assert _row_windows_by_symbol(plan) == []
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_panel_reads_only_its_columns(spark):
    plan = vwap_daily(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string" in plan
    assert "l_discount" not in plan


def test_a_hot_symbol_is_spread_over_bounded_groups(spark, tiny_groups):
    """One symbol holds most rows; no (symbol, bucket) or (symbol, block) group grows with it."""
    from rvpanel.operators.layout import blocks, bucketed, number
    from tests.helpers import PANEL, frame, random_prices

    pdf = pd.concat([random_prices(700, "HOT"), random_prices(40, "A"), random_prices(30, "B")])
    panel = frame(spark, pdf, PANEL)
    buckets = bucketed(panel).groupBy("symbol", "_bucket").count()
    assert buckets.agg({"count": "max"}).first()[0] <= 16
    laid = blocks(number(panel), before=5, after=3)
    groups = laid.groupBy("symbol", "_block").count()
    assert groups.agg({"count": "max"}).first()[0] <= 8 + 5 + 3
    assert groups.where("symbol = 'HOT'").count() == 88
    assert laid.where("_own = _block").count() == len(pdf)


def test_stored_tables_go_to_the_named_folder(spark):
    from rvpanel.sources.store import materialize, shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = materialize(spark.range(7))
    assert stored.count() == 7 and all(shared_folder(spark) in f for f in stored.inputFiles())
