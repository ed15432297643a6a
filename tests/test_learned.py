from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rvpanel.config import settings_from
from rvpanel.operators import learned as le
from rvpanel.operators.features import build_features
from rvpanel.plans import runs
from rvpanel.plans.learned import evaluate_all
from tests.helpers import PANEL, business_days, clustered_returns, frame


def _panel(spark, lengths):
    parts = []
    for k, (symbol, n) in enumerate(lengths.items()):
        px = 100 * np.exp(np.cumsum(clustered_returns(n, k, mu=0, omega=0.02, alpha=0.15, beta=0.83) / 100))
        parts.append(pd.DataFrame({"symbol": symbol, "date": business_days(n, "2015-01-01"), "px": px}))
    return frame(spark, pd.concat(parts), PANEL)


def _config(kind="linear", **changes):
    return settings_from({"folds": 3, "least_train": 100, "window": 10, "learner": kind, "rounds": 6, "patience": 2, **changes})


@pytest.fixture(scope="module")
def panel(spark):
    from rvpanel.sources.store import materialize

    return materialize(_panel(spark, {"A": 600, "B": 450}))


def test_windows_stay_inside_the_test_block(spark, panel):
    config = _config()
    got = le.learned_forecasts(panel.where("symbol = 'A'"), config, mode="rows").toPandas()
    n = 600 - 65
    size = n // 4
    assert got.groupby("fold").size().to_dict() == {f: size - 10 + 1 for f in range(3)}
    dates = build_features(panel.where("symbol = 'A'")).toPandas().sort_values("date").date.tolist()
    for f, mine in got.groupby("fold"):
        start = n - (3 - f) * size
        assert sorted(mine.date) == dates[start + 9 : start + size]
    assert got.pred.notna().all() and (got.model == "learned").all()


def test_scaled_vectors_are_the_scaled_window(spark, panel):
    config = _config()
    windows = le.stored_windows(panel, config, "rows")
    scaler = le.fit_scaler_rows(windows, F.lit(200), config.features)
    row = le.scaled_vectors(windows.where("symbol = 'B' and p = 50"), scaler).first()
    feats = build_features(panel).where("symbol = 'B'").toPandas().sort_values("date")[list(config.features)].to_numpy()
    train = feats[:200]  # rows before the first full window count as well
    want = (feats[41:51] - train.mean(axis=0)) / train.std(axis=0)
    assert np.allclose(row.features.toArray().reshape(10, 4), want, rtol=1e-5, atol=1e-6)


def test_boosted_trees_learn_and_repeat(spark, panel):
    config = _config("gbt")
    a = le.learned_forecasts(panel, config, folds=[2]).toPandas().sort_values(["symbol", "date"])
    b = le.learned_forecasts(panel, config, folds=[2]).toPandas().sort_values(["symbol", "date"])
    assert np.array_equal(a.pred, b.pred)
    constant = ((a.actual - a.actual.mean()) ** 2).mean()
    assert ((a.actual - a.pred) ** 2).mean() < 1.2 * constant and a.pred.std() > 0


def test_linear_beats_the_mean_on_clustered_returns(spark, panel):
    got = le.learned_forecasts(panel, _config()).toPandas()
    assert np.corrcoef(got.actual, got.pred)[0, 1] > 0.2


def test_linear_forecasts_are_least_squares(spark, panel):
    """Fold 1 of one symbol rebuilt with numpy from the definitions."""
    config = _config()
    one = panel.where("symbol = 'A'")
    got = le.learned_forecasts(one, config, mode="rows", folds=[1]).toPandas().sort_values("date")
    feats = build_features(one).toPandas().sort_values("date").reset_index(drop=True)
    x, y, n = feats[list(config.features)].to_numpy(), feats[config.target].to_numpy(), len(feats)
    size = n // 4
    start = n - 2 * size
    train_end = start - 5
    inner = train_end - int(train_end * 0.2)
    scaled = (x - x[:inner].mean(axis=0)) / x[:inner].std(axis=0)

    def windows(lo, hi):
        return np.array([scaled[k - 9 : k + 1].ravel() for k in range(lo + 9, hi)])

    design = np.column_stack([np.ones(inner - 9), windows(0, inner)])
    beta = np.linalg.lstsq(design, y[9:inner], rcond=None)[0]
    test = np.column_stack([np.ones(size - 9), windows(start, start + size)])
    assert np.allclose(got.actual, y[start + 9 : start + size])
    assert np.allclose(got.pred, test @ beta, rtol=1e-3, atol=1e-4)


def test_test_rows_do_not_leak_into_the_fit(spark, panel):
    config = _config()
    late = F.lit("2016-06-01").cast("date")
    poisoned = panel.withColumn("px", F.when(F.col("date") > late, F.col("px") * (1 + F.rand(1))).otherwise(F.col("px")))
    preds = []
    for p in (panel, poisoned):
        got = le.learned_forecasts(p, config, folds=[0]).where(F.col("date") < F.date_sub(late, 15))
        preds.append(got.toPandas().sort_values(["symbol", "date"]))
    assert len(preds[0]) > 20 and np.allclose(preds[0].pred, preds[1].pred)


def test_no_validation_rows_is_an_error(spark, panel):
    with pytest.raises(ValueError):
        le.learned_forecasts(panel, _config(validation_share=0.0))
    with pytest.raises(ValueError, match="validation"):
        le.learned_forecasts(panel, _config(validation_share=0.01))


def test_training_run_is_recorded_and_reloads(spark, panel, tmp_path):
    config, root = _config(), str(tmp_path)
    logged = runs.training_run(panel, config, root, "run-1")
    assert sorted(r.metric for r in logged.collect()) == ["mae", "qlike", "rmse"]
    params = {r.key: r.value for r in runs.read_runs(spark, root, "run_params").collect()}
    assert params["horizon"] == "5" and params["learner"] == "linear"
    row = runs.read_runs(spark, root, "run_models").first()
    assert (row.run_id, row.name) == ("run-1", "learned")
    model, scaler = runs.load_model(spark, root, "learned", "run-1")
    windows = le.stored_windows(panel, config, "calendar").where("symbol = 'A'")
    assert le.predict(model, windows, scaler).where("pred is not null").count() == 600 - 65 - 9


def test_a_second_run_of_a_name_replaces_the_first(spark, tmp_path):
    for value in (1.0, 2.0):
        metrics = spark.createDataFrame([("qlike", value)], "metric string, value double")
        runs.log_metrics(metrics, str(tmp_path), "r1")
        runs.log_params(spark, str(tmp_path), "r1", {"a": value})
    runs.log_metrics(spark.createDataFrame([("qlike", 0.5)], "metric string, value double"), str(tmp_path), "r0")
    got = {(r.run_id, r.value) for r in runs.read_runs(spark, str(tmp_path), "run_metrics").collect()}
    assert got == {("r1", 2.0), ("r0", 0.5)}
    assert [r.value for r in runs.read_runs(spark, str(tmp_path), "run_params").collect()] == ["2.0"]


def test_trees_kept():
    assert le.trees_kept([5.0, 6.0, 4.0, 4.5, 4.4], 2) == 3  # the first round does not gain, a later one does
    assert le.trees_kept([5.0, 6.0, 7.0, 1.0], 2) == 1
    assert le.trees_kept([3.0, 2.0, 1.0], 1) == 3


def test_one_pass_agrees_with_a_fit_a_fold(spark, panel):
    """All folds' normal equations against LinearRegression on the same windows, fold by fold."""
    config = _config(window=4, features=("rv_5d", "rv_60d"))
    packed = le.pack(panel, 4, 5, config.features, config.target, "calendar")
    scaled = le.on_blocks(packed, le.fold_scalers(packed, config, [0, 1, 2]))
    got = le.learned_forecasts(panel, config).toPandas().set_index(["symbol", "date", "fold"]).sort_index()
    for fold in range(3):
        model = le.fit_regressor(le.fold_vectors(scaled, config, fold, "train"), None, config)
        want = model.transform(le.fold_vectors(scaled, config, fold, "test")).toPandas().assign(fold=fold)
        want = want.set_index(["symbol", "date", "fold"]).sort_index()
        mine = got.loc[want.index]
        assert len(want) > 50 and np.allclose(mine.pred, want.pred, rtol=1e-8)
        assert (got.index.get_level_values("fold") == fold).sum() == len(want)


def test_boosting_reads_blocks_that_are_joined_and_dealt_once(spark, panel, monkeypatch):
    """Every pass of the folds reads one stored table, whose parts hold about as many blocks each; each fold's windows
    are counted without making them."""
    read = []
    fit = le._boosted_forecasts
    monkeypatch.setattr(le, "_boosted_forecasts", lambda packed, config, fold: read.append(packed) or fit(packed, config, fold))
    config = _config("gbt", rounds=2)
    le.learned_forecasts(panel, config)
    assert len(read) == 3 and len({id(p) for p in read}) == 1
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    counts = le.window_counts(read[0], config)
    for fold in range(3):
        assert counts[fold] == tuple(le.fold_vectors(read[0], config, fold, part).count() for part in ("train", "validation"))
    many = spark.range(160).selectExpr("string(id % 4) AS symbol", "id div 4 AS _block")
    sizes = [r["count"] for r in le.dealt(many).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 160 and max(sizes) <= 2 * 160 / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fits_do_not_depend_on_the_order_of_sums(spark, panel, tiny_groups):
    """Parts that arrive in another order and number give the same scalers and trees to the last bit, and the trees are
    those of Spark's boosting."""
    config = _config("gbt", rounds=4, patience=9)
    packed = le.materialize(le.pack(panel, config.window, 5, config.features, config.target, "calendar"))
    found = []
    for k in (2, 7):
        scalers = le.materialize(le.fold_scalers(packed.repartition(k, F.hash("_block", F.lit(k))), config, [2]))
        laid = le.on_blocks(packed, scalers)
        train, held = (le.fold_vectors(laid, config, 2, part) for part in ("train", "validation"))
        model = le.fit_regressor(train.repartition(k, F.hash("symbol", "date", F.lit(k))), held.repartition(k), config)
        tested = model.transform(le.fold_vectors(laid, config, 2, "test")).toPandas().sort_values(["symbol", "date"])
        found.append(([r.scalers for r in scalers.orderBy("symbol").collect()], model.toDebugString.split("\n", 1)[1], tested.pred.to_numpy()))
    (scalers, trees, pred), again = found[0], found[1]
    assert scalers == again[0] and trees == again[1] and len(pred) > 100 and np.array_equal(pred, again[2])
    plain = le.GBTRegressor(labelCol=config.target, maxIter=model.getNumTrees, maxDepth=3, stepSize=0.1, seed=42, predictionCol="pred").fit(train)
    want = plain.transform(le.fold_vectors(laid, config, 2, "test")).toPandas().sort_values(["symbol", "date"]).pred
    assert np.median(np.abs(pred - want)) < 1e-5 and np.allclose(model.treeWeights, plain.treeWeights)


def test_forecasts_do_not_depend_on_how_a_table_is_read(spark):
    """With more rows than Spark takes all of for the borders of its trees."""
    from rvpanel.sources.store import materialize

    long = materialize(_panel(spark, {s: 5000 for s in "ABC"}))
    config, found, name = _config("gbt", rounds=2, folds=2), [], "spark.sql.files.minPartitionNum"
    for parts in ("1", "7"):
        spark.conf.set(name, parts)
        try:
            found.append(le.learned_forecasts(long, config, folds=[1]).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True))
        finally:
            spark.conf.unset(name)
    assert len(found[0]) > 4000 and found[0].equals(found[1])


def test_sums_on_the_grid_are_exact():
    values = np.random.default_rng(0).normal(0, 1, 5000)
    grid = le.exact_grid(5000, np.abs(values).max())
    on = np.rint(values / grid) * grid
    for x in (on, on**2):
        assert x.sum() == x[::-1].sum() == sum(sorted(x)) == float(sum(map(Fraction, x)))
    assert np.abs(on - values).max() < 1e-5 and le.exact_grid(10, 0.0) == 1.0


def test_fewer_trees_of_one_fit(spark, panel):
    config = _config("gbt", rounds=5)
    packed = le.pack(panel, config.window, 5, config.features, config.target, "calendar")
    scaled = le.on_blocks(packed, le.fold_scalers(packed, config, [1]))
    train, held = (le.fold_vectors(scaled, config, 1, part) for part in ("train", "validation"))
    whole = le.fit_regressor(train, held, settings_from({**config.__dict__, "patience": 99, "rounds": 3}))
    five = le.GBTRegressor(labelCol=config.target, maxIter=5, maxDepth=3, stepSize=0.1, seed=42, predictionCol="pred").fit(train)
    three = le.GBTRegressor(labelCol=config.target, maxIter=3, maxDepth=3, stepSize=0.1, seed=42, predictionCol="pred").fit(train)
    cut = le.first_trees(five, 3)
    assert cut.getNumTrees == 3 and whole.getNumTrees <= 3 and five.getNumTrees == 5
    a, b = (m.transform(held).toPandas().sort_values(["symbol", "date"]).pred.to_numpy() for m in (cut, three))
    assert len(a) > 30 and np.array_equal(a, b)


def test_boosting_restores_the_best_round(spark, panel):
    config = _config("gbt", rounds=8)
    windows = le.stored_windows(panel, config, "calendar")
    end = F.col("m") * 0.8
    model, scaler = le.fit_windows(windows, end.cast("long"), F.col("m"), config)
    held = le.scaled_vectors(windows.where(le._window_in(end.cast("long"), F.col("m"))), scaler)
    errors = model.stages[0].evaluateEachIteration(held, "squared")
    assert len(errors) <= 8 and errors[-1] == min(errors)


def test_chosen_features(spark, panel):
    got = le.learned_forecasts(panel, _config(features=("rv_20d",), window=1), folds=[1])
    assert got.where("pred IS NOT NULL").count() > 0


def test_best_run_breaks_ties_by_name(spark):
    rows = [("r2", "qlike", 0.5), ("r1", "qlike", 0.5), ("r0", "rmse", 0.1), ("r3", "qlike", None)]
    best = runs.best_run(spark.createDataFrame(rows, "run_id string, metric string, value double")).first()
    assert (best.run_id, best.value) == ("r1", 0.5)


def test_common_rows_scores_every_model_on_the_same_dates(spark, panel):
    board = evaluate_all(panel, _config(), models=("naive", "ewma"), common_rows=True).toPandas()
    assert sorted(board.model.unique()) == ["ewma", "learned", "naive"]
    assert (board.groupby("symbol").n_folds.nunique() == 1).all() and board[["rmse", "mae"]].notna().all().all()
