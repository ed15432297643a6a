"""Run records: parameters, metrics and models as tables under one folder."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rvpanel.config import Settings
from rvpanel.operators.learned import train_final_model
from rvpanel.plans.learned import evaluate_learned
from rvpanel.schema import RUN_METRICS, RUN_MODELS, RUN_PARAMS


def _replace(rows: DataFrame, path: str) -> None:
    """Store rows of a run in place of those of an earlier run of that name."""
    writer = rows.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def log_params(spark: SparkSession, root: str, run_id: str, params: Mapping[str, Any]) -> None:
    rows = [(run_id, key, str(value)) for key, value in params.items()]
    _replace(spark.createDataFrame(rows, RUN_PARAMS), f"{root}/run_params")


def log_metrics(metrics: DataFrame, root: str, run_id: str) -> None:
    """Store (metric, value) rows under the run."""
    _replace(metrics.select(F.lit(run_id).alias("run_id"), "metric", "value"), f"{root}/run_metrics")


def log_model(model: PipelineModel, scaler: DataFrame, root: str, run_id: str, name: str) -> None:
    """Store the model and its scaler under the run and list them in ``run_models``."""
    path = f"{root}/models/{name}/{run_id}"
    model.write().overwrite().save(f"{path}/model")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    row = [(run_id, name, path)]
    _replace(scaler.sparkSession.createDataFrame(row, RUN_MODELS), f"{root}/run_models")


def load_model(spark: SparkSession, root: str, name: str, run_id: str) -> tuple[PipelineModel, DataFrame]:
    path = f"{root}/models/{name}/{run_id}"
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scaler")


def read_runs(spark: SparkSession, root: str, table: str) -> DataFrame:
    schema = {"run_params": RUN_PARAMS, "run_metrics": RUN_METRICS, "run_models": RUN_MODELS}[table]
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def best_run(run_metrics: DataFrame, metric: str = "qlike") -> DataFrame:
    """The run with the lowest value of ``metric``; ties go to the lower run_id."""
    wanted = run_metrics.where((F.col("metric") == metric) & F.col("value").isNotNull())
    return wanted.agg(
        F.min_by("run_id", F.struct("value", "run_id")).alias("run_id"), F.min("value").alias("value")
    )


def mean_metrics(board: DataFrame) -> DataFrame:
    """A leaderboard's metrics as (metric, value), averaged over its symbols."""
    means = board.agg(*[F.avg(m).alias(m) for m in ("rmse", "mae", "qlike")])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in means.columns])
    return means.select(F.explode(pairs).alias("_p")).select("_p.metric", "_p.value")


def training_run(panel: DataFrame, config: Settings, root: str, run_id: str, name: str = "learned") -> DataFrame:
    """Evaluate walk-forward, fit the final model on all rows, record everything; returns
    the leaderboard as it was recorded."""
    spark = panel.sparkSession
    log_params(spark, root, run_id, config.recorded())
    log_metrics(mean_metrics(evaluate_learned(panel, config)), root, run_id)
    model, scaler = train_final_model(panel, config)
    log_model(model, scaler, root, run_id, name)
    return read_runs(spark, root, "run_metrics").where(F.col("run_id") == run_id)
