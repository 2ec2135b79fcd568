"""Run history and experiment logs (S10–S14) as append-only tables."""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = ("run_id string, started_at timestamp, file string, n_rows long, n_cols long, target string, "
              "task string, best_model string, best_score double, scores map<string,double>, elapsed_sec double, "
              "n_features long, config string")
LOG_SCHEMA = "run_id string, kind string, key string, value string, step long, logged_at timestamp"


def _jsonable(x):
    try:
        json.dumps(x)
        return x
    except TypeError:
        return str(x)


def append_run(spark: SparkSession, path: str, *, file: str, n_rows: int, n_cols: int, target: str, task: str,
               best_model: str, best_score: float, scores: dict, elapsed_sec: float, n_features: int,
               config: dict | None = None) -> str:
    """S10 — one record per run appended (parquet); config stored as JSON with
    non-serialisable values stringified (F18)."""
    rid = uuid.uuid4().hex
    cfg = json.dumps({k: _jsonable(v) for k, v in (config or {}).items()})
    row = [(rid, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), file, int(n_rows), int(n_cols), target,
            task, best_model, float(best_score), {k: float(v) for k, v in scores.items()}, float(elapsed_sec),
            int(n_features), cfg)]
    spark.createDataFrame(row, RUN_SCHEMA).write.mode("append").parquet(path)
    return rid


def list_runs(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """S11 — newest runs first (the limit is the feature)."""
    return spark.read.parquet(path).orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def best_run(spark: SparkSession, path: str, metric: str = "best_score", ascending: bool = False) -> DataFrame:
    """S12 — drop runs without the metric, sort, take one."""
    df = spark.read.parquet(path).where(F.col(metric).isNotNull())
    return df.orderBy(F.col(metric).asc() if ascending else F.col(metric).desc(), F.desc("started_at")).limit(1)


def log_params(spark: SparkSession, path: str, run_id: str, params: dict) -> None:
    """S14 — params stringified and cut to 500 characters."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_id, "param", str(k), str(v)[:500], 0, now) for k, v in params.items()]
    spark.createDataFrame(rows, LOG_SCHEMA).write.mode("append").parquet(path)


def log_metrics(spark: SparkSession, path: str, run_id: str, metrics: dict, step: int = 0) -> None:
    """S14 — metrics with a step."""
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_id, "metric", str(k), repr(float(v)), int(step), now) for k, v in metrics.items()]
    spark.createDataFrame(rows, LOG_SCHEMA).write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    """S13 — persist a fitted Spark ML model/pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """S13 — load a persisted pipeline model."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
