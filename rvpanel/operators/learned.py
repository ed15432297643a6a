"""Learned sequence forecaster: regression of the target on a scaled window of features.

Protocol: windows of ``seq_len`` rows that never leave their part of the series, scaling
fitted on the inner train rows, early stopping on the validation rows, one distributed
fit per fold over all symbols.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rvpanel.config import Settings
from rvpanel.operators.features import build_features
from rvpanel.operators.folds import check_val_frac, inner_train_end, number_by_calendar
from rvpanel.operators.layout import SUPER_BLOCKS, block_window, blocks, number, own_rows
from rvpanel.operators.packed import Block, on_blocks, pack, read_blocks, windows_at
from rvpanel.sources.store import materialize


def split_rows(features: DataFrame, config: Settings, mode: str = "calendar") -> DataFrame:
    """Feature rows with the window ``x`` that ends in them, their position ``p`` of ``m``
    for the folds, and the position ``p_first`` of the window's first row (NULL where the
    series is too young for a full window).

    ``mode='rows'`` counts each symbol's own rows, ``mode='calendar'`` the panel's dates.
    With several symbols only the calendar keeps every train row before every test row.
    """
    if mode not in ("rows", "calendar"):
        raise ValueError(f"mode must be 'rows' or 'calendar', got {mode!r}")
    back = config.window - 1
    if mode == "calendar":
        rows = number(number_by_calendar(features).withColumnsRenamed({"i": "p", "n": "m"}))
    else:
        rows = number(features).select("*", F.col("i").alias("p"), F.col("n").alias("m"))
    w = block_window()
    window = F.collect_list(F.array(*config.features)).over(w.rowsBetween(-back, 0))
    laid = blocks(rows, before=back).withColumns({"x": window, "p_first": F.lag("p", back).over(w)})
    return own_rows(laid).select("symbol", "_block", "date", *config.features, config.target, "x", "p", "p_first", "m")


def _window_in(lo: Column, hi: Column) -> Column:
    return (F.col("p_first") >= lo) & (F.col("p") < hi)


def fit_scaler_rows(rows: DataFrame, inner_end: Column, features: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of the features before ``inner_end``: one
    row per symbol with two short arrays, in the order of ``features``."""
    stats = [s for c in features for s in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    fitted = rows.where(F.col("p") < inner_end).groupBy("symbol").agg(*stats)
    divisors = [F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in features]
    return fitted.select(
        "symbol",
        F.array(*[F.col(f"m_{c}") for c in features]).alias("mean"),
        F.array(*divisors).alias("std"),
    )


def scaled_vectors(windows: DataFrame, scaler: DataFrame) -> DataFrame:
    """Add ``features``: the window scaled to float32 numbers, as one flat vector.

    The scaler goes to each (symbol, block) first, so a hot symbol's rows are not gathered.
    """
    spread = windows.select("symbol", "_block").distinct().join(scaler, "symbol")
    scaled = F.transform(
        "x",
        lambda step: F.transform(step, lambda v, k: ((v - F.get("mean", k)) / F.get("std", k)).cast("float")),
    )
    flat = array_to_vector(F.flatten(scaled).cast("array<double>")).alias("features")
    kept = [c for c in windows.columns if c not in ("x", "_block")]
    return windows.join(spread, ["symbol", "_block"]).select(*kept, flat)


def trees_kept(errors: Sequence[float], patience: int) -> int:
    """Number of trees with the least error, looking no further than ``patience`` rounds past it."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def fit_regressor(train: DataFrame, validation: DataFrame, config: Settings) -> Model:
    """``gbt``: boosted trees, as many as serve the validation rows best; ``linear``: least squares in one
    pass, no validation."""
    if config.learner == "linear":
        return LinearRegression(labelCol=config.target, solver="normal", predictionCol="pred").fit(train)
    if config.learner != "gbt":
        raise ValueError(f"unknown learner {config.learner!r}")
    train, validation = train.persist(), validation.persist()
    try:
        return _boosted(train, validation, config)
    finally:
        train.unpersist()
        validation.unpersist()


def exact_grid(count: int, largest: float) -> float:
    """A power of two whose multiples ``count`` values of up to ``largest`` are rounded to, so that a double holds their
    sum and the sum of their squares exactly: then they are the same in whatever order tasks finish."""
    return 2.0 ** math.ceil(math.log2(largest) + (math.log2(count) - 52) / 2) if largest > 0 else 1.0


def _boosted(train: DataFrame, validation: DataFrame, config: Settings) -> GBTRegressionModel:
    """The trees that ``GBTRegressor`` fits, one at a time, until ``patience`` of them have brought no gain.

    Each is fitted to what the trees before it leave, rounded to a grid that makes the sums of a fit exact (sums of doubles
    depend on the order in which parts arrive, and boosting carries such differences on).  The squares of what is left
    never add up to more than at first, so one grid serves all rounds.
    """
    y = F.col(config.target)
    rows, largest = train.agg(F.count("*"), F.max(F.abs(y))).first()
    grid, unit = exact_grid(4 * rows, largest), largest or 1.0
    boosting = GBTRegressor(
        labelCol=config.target, maxIter=config.rounds, maxDepth=config.depth, stepSize=config.step_size, seed=config.seed, predictionCol="pred"
    )
    one_tree = DecisionTreeRegressor(labelCol="_left", maxDepth=config.depth, seed=config.seed)
    trees, errors, model = [], [], None
    while len(errors) < config.rounds and (not errors or len(errors) - trees_kept(errors, config.patience) < config.patience):
        # Spark's boosting takes y itself first and then the slope of the squared error, twice what is left.
        left = y if model is None else 2 * (y - F.col("pred"))
        seen = train if model is None else model.transform(train)
        trees.append(one_tree.fit(seen.select("features", (F.rint(left / grid) * grid).alias("_left"))))
        model = boosted_model(boosting, trees)
        # Decimals add up exactly.
        error = F.pow((y - F.col("pred")) / unit, 2).cast("decimal(38,20)")
        errors.append(model.transform(validation).agg(F.sum(error)).first()[0])
    return first_trees(model, trees_kept(errors, config.patience))


def boosted_model(boosting: GBTRegressor, trees: Sequence[DecisionTreeRegressionModel]) -> GBTRegressionModel:
    """The model of trees that were fitted one by one, as ``boosting`` weighs them."""
    boosting._transfer_params_to_java()
    weights = [1.0] + [boosting.getStepSize()] * (len(trees) - 1)
    return _model_of(boosting._java_obj, boosting._java_obj.uid(), [t._java_obj for t in trees], weights, trees[0].numFeatures)


def first_trees(model: GBTRegressionModel, kept: int) -> GBTRegressionModel:
    """The model of the first ``kept`` trees of a fitted one; nothing is fitted again."""
    if kept == model.getNumTrees:
        return model
    whole = model._java_obj
    return _model_of(whole, whole.uid(), list(whole.trees())[:kept], list(whole.treeWeights())[:kept], whole.numFeatures())


def _model_of(params, uid: str, trees: Sequence, weights: Sequence[float], width: int) -> GBTRegressionModel:
    """Spark's model of these trees, with parameters (such as the name of the forecast's column) as in ``params``."""
    jvm = SparkContext._active_spark_context._gateway
    held = jvm.new_array(jvm.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weighed = jvm.new_array(jvm.jvm.double, len(trees))
    for k, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        held[k], weighed[k] = tree, float(weight)
    found = jvm.jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, held, weighed, width)
    return GBTRegressionModel(params.copyValues(found, params.extractParamMap()))


def fit_windows(
    windows: DataFrame, inner_end: Column, train_end: Column, config: Settings
) -> tuple[PipelineModel, DataFrame] | None:
    """Fit on windows inside the inner train rows, validate on those behind them.  Returns
    the model and its scaler, or None where there is nothing to train on."""
    scaler = materialize(fit_scaler_rows(windows, inner_end, config.features))
    train, validation = _window_in(F.lit(0), inner_end), _window_in(inner_end, train_end)
    used = windows.where(train | validation).withColumn("is_validation", validation)
    # Fitting passes over the vectors more than once.
    vectors = materialize(scaled_vectors(used, scaler).select("features", config.target, "is_validation"))
    sides = {r["is_validation"] for r in vectors.select("is_validation").distinct().collect()}
    if False not in sides:
        return None
    if True not in sides:
        raise ValueError("no validation window: val_frac leaves fewer rows than one window needs")
    train_rows, held = vectors.where(~F.col("is_validation")), vectors.where("is_validation")
    return PipelineModel([fit_regressor(train_rows, held, config)]), scaler


def stored_windows(panel: DataFrame, config: Settings, mode: str) -> DataFrame:
    """Features, then windows, each computed once and stored: all folds read them."""
    features = materialize(build_features(panel, config.horizon))
    return materialize(split_rows(features, config, mode))


def predict(model: PipelineModel, windows: DataFrame, scaler: DataFrame) -> DataFrame:
    """One forecast per window, keyed by the window's last date."""
    return model.transform(scaled_vectors(windows.where(F.col("p_first").isNotNull()), scaler))


def _fold_parts(m: int, fold: int, config: Settings) -> tuple[int, int, int, int] | None:
    """(inner end, train end, test start, test end) of a fold of ``m`` positions; None where it has too few."""
    size = m // (config.folds + 1)
    start = m - (config.folds - fold) * size
    train_end = start - config.horizon
    if size == 0 or train_end < config.least_train:
        return None
    return train_end - math.floor(train_end * config.validation_share), train_end, start, start + size


def _sums_in_order(blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``total`` of a value and of ``n`` per group, added up by ``_block``: inside super-blocks, then over super-blocks."""
    in_order = "aggregate(sort_array(collect_list(struct({at}, {x} AS x))), 0D, (a, e) -> a + e.x) AS total"
    inner = blocks.groupBy(*keys, F.expr(f"_block div {SUPER_BLOCKS}L").alias("_super")).agg(
        F.expr(in_order.format(at="_block", x=value)), F.sum("n").alias("n")
    )
    return inner.groupBy(*keys).agg(F.expr(in_order.format(at="_super", x="total")), F.sum("n").alias("n"))


def fold_scalers(packed: DataFrame, config: Settings, folds: Sequence[int]) -> DataFrame:
    """Scalers of all folds from one pass: ``symbol`` and an array of (fold, mean, std).

    Blocks are summarised for each fold (count, mean, squared deviations), and summaries are added up in their order, so
    that the last digit does not depend on the order in which tasks finish."""
    width = len(config.features)

    def run(batches):
        for block in read_blocks(batches, width, ["_block"]):
            own_p, own = block.p[block.lead :], block.f[block.lead :]
            out = []
            for fold in folds:
                if parts := _fold_parts(block.m, fold, config):
                    used = own[own_p < parts[0]]
                    if len(used):
                        mean = used.mean(axis=0)
                        squares = ((used - mean) ** 2).sum(axis=0)
                        out.append((block.symbol, fold, block.row["_block"], len(used), mean.tolist(), squares.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["symbol", "fold", "_block", "n", "mean", "squares"])

    parts = packed.mapInArrow(run, "symbol string, fold long, _block long, n long, mean array<double>, squares array<double>")
    values = "inline(transform(arrays_zip(mean, squares), (x, c) -> struct(c, x.mean AS mean, x.squares AS squares)))"
    each = parts.selectExpr("symbol", "fold", "_block", "n", values)
    keys = ["symbol", "fold", "c"]
    means = _sums_in_order(each, keys, "n * mean").selectExpr(*keys, "total / n AS whole")
    spread = each.join(means, keys)
    deviations = _sums_in_order(spread, keys, "squares + n * (mean - whole) * (mean - whole)").selectExpr(*keys, "sqrt(total / n) AS std")
    spread = means.withColumnRenamed("whole", "mean").join(deviations, keys)
    ordered = F.sort_array(F.collect_list(F.struct("c", "mean", F.expr("IF(std = 0, 1D, std) AS std"))))
    per_fold = spread.groupBy("symbol", "fold").agg(ordered.alias("s"))
    lists = F.expr("struct(fold, transform(s, x -> x.mean) AS mean, transform(s, x -> x.std) AS std)")
    return per_fold.groupBy("symbol").agg(F.collect_list(lists).alias("scalers"))


def _scaled_folds(block: Block, config: Settings, only: int | None = None):
    """(fold, parts, features scaled to float32) of each fold (or of one) the block's symbol has a scaler for."""
    for scaler in block.row["scalers"]:
        parts = _fold_parts(block.m, scaler["fold"], config)
        if parts and only in (None, scaler["fold"]):
            yield scaler["fold"], parts, ((block.f - np.array(scaler["mean"])) / np.array(scaler["std"])).astype(np.float32)


def normal_equations(packed: DataFrame, config: Settings) -> dict[int, tuple[np.ndarray, int, int]]:
    """A'A of every fold's inner train windows, with A = (window, 1, target), and how many train and validation
    windows there are, all folds in one pass.

    A task sends one matrix a fold, of a size that the settings fix; they are added up in two levels.
    """
    side = config.window * len(config.features) + 2

    def run(batches):
        total: dict[int, list] = {}
        for block in read_blocks(batches, len(config.features), ["scalers"]):
            for fold, (inner_end, train_end, _, _), scaled in _scaled_folds(block, config):
                held = total.setdefault(fold, [np.zeros((side, side)), 0, 0])
                ends = block.ends(config.window, 0, inner_end)
                held[2] += len(block.ends(config.window, inner_end, train_end))
                for some in np.array_split(ends, -(-len(ends) // 4096)) if len(ends) else ():
                    a = np.column_stack([windows_at(scaled, some, config.window), np.ones(len(some)), block.y[some - block.lead]])
                    held[0] += a.T @ a
                    held[1] += len(some)
        if total:
            rows = [(fold, gram.tobytes(), n, v) for fold, (gram, n, v) in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["fold", "gram", "n", "held"])

    def add(table: pa.Table) -> pa.Table:
        gram = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("gram"))
        counts = [sum(table.column(c).to_pylist()) for c in ("n", "held")]
        return pa.table({"fold": table.column("fold")[:1], "gram": [gram.tobytes()], "n": [counts[0]], "held": [counts[1]]})

    schema = "fold long, gram binary, n long, held long"
    each = packed.mapInArrow(run, schema).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(16)))
    once = each.groupBy("fold", "salt").applyInArrow(add, schema)
    rows = once.groupBy("fold").applyInArrow(add, schema).collect()
    return {r["fold"]: (np.frombuffer(r["gram"], np.float64).reshape(side, side), r["n"], r["held"]) for r in rows}


def solve(gram: np.ndarray) -> np.ndarray:
    """Least-squares weights, the last one the constant, from A'A; columns are brought to unit length first."""
    xx, xy = gram[:-1, :-1], gram[:-1, -1]
    length = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    return np.linalg.lstsq(xx / np.outer(length, length), xy / length, rcond=1e-13)[0] / length


def _linear_forecasts(packed: DataFrame, config: Settings) -> DataFrame | None:
    """Least squares for all folds: one pass for the scalers (done), one for the equations, one for the forecasts."""
    weights = {}
    for fold, (gram, n, held) in normal_equations(packed, config).items():
        if n and not held:
            raise ValueError("no validation window: val_frac leaves fewer rows than one window needs")
        if n:
            weights[fold] = solve(gram)
    if not weights:
        return None
    kind = packed.schema["date"].dataType.elementType
    shipped = packed.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for block in read_blocks(batches, len(config.features), ["scalers"]):
            for fold, (_, _, start, end), scaled in _scaled_folds(block, config):
                ends = block.ends(config.window, start, end)
                if len(ends) and fold in shipped.value:
                    own, w = pa.array(ends - block.lead), shipped.value[fold]
                    pred = windows_at(scaled, ends, config.window) @ w[:-1] + w[-1]
                    yield pa.record_batch(
                        {
                            "symbol": pa.repeat(block.symbol, len(ends)),
                            "date": block.date.take(own),
                            "fold": pa.array(np.full(len(ends), fold, np.int32)),
                            "actual": pa.array(block.y[ends - block.lead]),
                            "pred": pa.array(pred),
                        }
                    )

    return packed.mapInArrow(run, f"symbol string, date {kind.simpleString()}, fold int, actual double, pred double")


def fold_vectors(packed: DataFrame, config: Settings, fold: int, part: str) -> DataFrame:
    """Scaled windows of one part (``train``, ``validation`` or ``test``) of a fold as vectors, made when they are read."""
    kind = packed.schema["date"].dataType.elementType.simpleString()

    def run(batches):
        for block in read_blocks(batches, len(config.features), ["scalers"]):
            for _, (inner_end, train_end, start, end), scaled in _scaled_folds(block, config, fold):
                low, high = {"train": (0, inner_end), "validation": (inner_end, train_end), "test": (start, end)}[part]
                ends = block.ends(config.window, low, high)
                for some in np.array_split(ends, -(-len(ends) // 4096)) if len(ends) else ():
                    flat = windows_at(scaled, some, config.window)
                    x = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                    own = pa.array(some - block.lead)
                    yield pa.record_batch(
                        {"symbol": pa.repeat(block.symbol, len(some)), "date": block.date.take(own), "y": pa.array(block.y[some - block.lead]), "x": x}
                    )

    rows = packed.mapInArrow(run, f"symbol string, date {kind}, y double, x array<double>")
    return rows.select("symbol", "date", F.col("y").alias(config.target), array_to_vector("x").alias("features"))


def window_counts(packed: DataFrame, config: Settings) -> dict[int, tuple[int, int]]:
    """How many train and validation windows each fold has, from positions alone, all folds in one pass."""

    def run(batches):
        for block in read_blocks(batches, len(config.features), ["scalers"]):
            for fold in [s["fold"] for s in block.row["scalers"]]:
                if parts := _fold_parts(block.m, fold, config):
                    n, held = (len(block.ends(config.window, *side)) for side in ((0, parts[0]), parts[:2]))
                    yield pa.record_batch({"fold": pa.array([fold], pa.int64()), "n": pa.array([n], pa.int64()), "held": pa.array([held], pa.int64())})

    counted = packed.mapInArrow(run, "fold long, n long, held long").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    return {r["fold"]: (r["n"], r["held"]) for r in counted.collect()}


def dealt(packed: DataFrame, most: int | None = None) -> DataFrame:
    """The packed rows in parts (``most`` at most) of about as many blocks each, in an order that does not depend on the run."""
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts if most is None else max(1, min(parts, most))
    return packed.repartitionByRange(parts, F.xxhash64("symbol", "_block")).sortWithinPartitions("symbol", "_block")


def _boosted_forecasts(packed: DataFrame, config: Settings, fold: int) -> DataFrame:
    # Spark draws a sample of the rows for the borders of the trees, by their places.  How a stored table is read depends
    # on the cluster at that moment, so the blocks (not their windows) are dealt out once more for the fit.
    laid = dealt(packed, packed.count())
    train, held = (fold_vectors(laid, config, fold, part) for part in ("train", "validation"))
    model = fit_regressor(train, held, config)
    tested = model.transform(fold_vectors(packed, config, fold, "test"))
    return tested.select("symbol", "date", F.lit(fold).alias("fold"), F.col(config.target).alias("actual"), "pred")


def learned_forecasts(
    panel: DataFrame, config: Settings, mode: str = "calendar", folds: Sequence[int] | None = None
) -> DataFrame:
    """Forecasts (symbol, date, fold, model, actual, pred) of each fold's test windows.

    Features are packed and stored once, and the scalers of all folds come from one pass over them.  So do all folds'
    least squares; boosted trees are one fit a fold.
    """
    check_val_frac(config.validation_share)
    if mode not in ("rows", "calendar"):
        raise ValueError(f"mode must be 'rows' or 'calendar', got {mode!r}")
    chosen = list(range(config.folds) if folds is None else folds)
    packed = pack(panel, config.window, config.horizon, config.features, config.target, mode)
    scaled = on_blocks(packed, materialize(fold_scalers(packed, config, chosen)))
    if config.learner == "linear":
        results = [_linear_forecasts(scaled, config)]
    else:
        # Fitting passes over the blocks many times: they are joined and dealt out evenly once.  A block becomes windows
        # of many times its size, so the size of the table must not decide how many tasks share it.
        scaled = materialize(dealt(scaled))
        counts = window_counts(scaled, config)
        chosen = [fold for fold in chosen if counts.get(fold, (0, 0))[0]]
        if not all(counts[fold][1] for fold in chosen):
            raise ValueError("no validation window: val_frac leaves fewer rows than one window needs")
        # Folds are independent: their jobs are submitted side by side and share the cluster.
        with ThreadPool(max(1, min(len(chosen), config.side_by_side))) as pool:
            one_fold = inheritable_thread_target(panel.sparkSession)(lambda fold: _boosted_forecasts(scaled, config, fold))
            results = pool.map(one_fold, chosen)
    results = [r for r in results if r is not None]
    if not results:
        raise ValueError("no fold has enough rows to train on")
    found = reduce(DataFrame.unionByName, results)
    return found.select("symbol", "date", "fold", F.lit("learned").alias("model"), "actual", "pred")


def train_final_model(panel: DataFrame, config: Settings, mode: str = "calendar") -> tuple[PipelineModel, DataFrame]:
    """The model to keep: fitted on all rows, the last part held out for early stopping.
    Returns the model and its scaler."""
    check_val_frac(config.validation_share)
    windows = stored_windows(panel, config, mode)
    m = F.col("m")
    fitted = fit_windows(windows, inner_train_end(m, config.validation_share), m, config)
    if fitted is None:
        raise ValueError("too few rows for one training window")
    return fitted
