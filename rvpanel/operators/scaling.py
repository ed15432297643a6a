"""Standard scaling per symbol and fold, fitted on the inner train rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rvpanel.operators.folds import check_val_frac, inner_train_end
from rvpanel.operators.layout import blocks, in_blocks, join_symbols
from rvpanel.schema import FEATURES


def fit_scaler(
    numbered: DataFrame,
    feature_cols: Sequence[str] = FEATURES,
    n_splits: int = 5,
    horizon: int = 5,
    min_train_size: int = 252,
    val_frac: float = 0.2,
    inner_gap: int = 0,
) -> DataFrame:
    """Mean and population standard deviation of each feature, for every fold at once.

    Train sets only grow, so rows are not repeated per fold: each row falls into the
    segment between two inner train ends, segments are summarised (count, mean, squared
    deviations), and fold f merges the segments up to f.  At most K small rows per symbol
    take part in the merge.
    """
    check_val_frac(val_frac)
    size = F.expr(f"n div {n_splits + 1}L")

    def end(fold: int):
        train_end = F.col("n") - (n_splits - fold) * size - horizon
        return F.greatest(inner_train_end(train_end, val_frac) - inner_gap, F.lit(0))

    passed = sum((F.when(F.col("i") >= end(f), 1).otherwise(0) for f in range(n_splits)), F.lit(0))
    rows = numbered.where((size > 0) & (F.col("n") - horizon - n_splits * size > 0))
    rows = rows.withColumn("_segment", passed).where(F.col("_segment") < n_splits)
    stats = [
        stat
        for c in feature_cols
        for stat in (
            F.count(c).alias(f"_n_{c}"),
            F.avg(c).alias(f"_m_{c}"),
            (F.var_pop(c) * F.count(c)).alias(f"_q_{c}"),
        )
    ]
    segments = rows.groupBy("symbol", "_segment").agg(F.max("n").alias("n"), *stats)

    spread = segments.withColumn("fold", F.explode(F.sequence(F.col("_segment"), F.lit(n_splits - 1))))
    fold = Window.partitionBy("symbol", "fold")
    centred = spread.withColumns(
        {
            f"_mean_{c}": F.sum(F.col(f"_n_{c}") * F.col(f"_m_{c}")).over(fold) / F.sum(f"_n_{c}").over(fold)
            for c in feature_cols
        }
    )
    merged = []
    for c in feature_cols:
        shift = F.col(f"_m_{c}") - F.col(f"_mean_{c}")
        squares = F.sum(F.col(f"_q_{c}") + F.col(f"_n_{c}") * shift * shift)
        std = F.sqrt(squares / F.sum(f"_n_{c}"))
        merged += [F.max(f"_mean_{c}").alias(f"mean_{c}"), F.when(std == 0, 1.0).otherwise(std).alias(f"std_{c}")]
    train_end = F.col("n") - (F.lit(n_splits) - F.col("fold")) * size - horizon
    return (
        centred.groupBy("symbol", "fold")
        .agg(F.max("n").alias("n"), *merged)
        .where(train_end >= min_train_size)
        .drop("n")
    )


def scaler_per_symbol(scaler: DataFrame, feature_cols: Sequence[str] = FEATURES) -> DataFrame:
    """One row per symbol holding its folds' scalers as a short array."""
    columns = [f"{s}_{c}" for c in feature_cols for s in ("mean", "std")]
    return scaler.groupBy("symbol").agg(F.collect_list(F.struct("fold", *columns)).alias("_scalers"))


def apply_scaler(
    rows: DataFrame, scaler: DataFrame, feature_cols: Sequence[str] = FEATURES, cast: str = "double"
) -> DataFrame:
    """Scale the features of rows that carry a ``fold``.  The target is left alone.

    ``rows`` are numbered rows; they are not gathered by symbol for the lookup, and keep the blocks they are in.
    """
    laid = rows if in_blocks(rows) else blocks(rows)
    joined = join_symbols(laid, scaler_per_symbol(scaler, feature_cols))
    mine = F.filter("_scalers", lambda s: s["fold"] == F.col("fold"))[0]
    joined = joined.withColumn("_s", mine).where(F.col("_s").isNotNull())
    scaled = {
        c: ((F.col(c) - F.col(f"_s.mean_{c}")) / F.col(f"_s.std_{c}")).cast(cast) for c in feature_cols
    }
    return joined.withColumns(scaled).select(*[c for c in rows.columns if c not in ("_bucket", "_block")])
