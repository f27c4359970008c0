"""Bookkeeping tables as folders of Parquet: runs, tasks, checks, checkpoints, alerts, logs, sources.

Every run appends a few rows to several tables. The commit log of a table (:mod:`clearwell.sinks.tables`) compacts them,
so that a report reads a number of files that grows with the logarithm of the runs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.tables import append_table, exists, read_table, upsert_table
from ..streaming.incremental import CHECKPOINT_KEYS, CHECKPOINT_SCHEMA, checkpoint_row, read_checkpoint

# Table layouts and the configuration keys whose values are never stored.
SCHEMAS = {
    "pipeline_runs": (
        "run_id string, pipeline_name string, dag_id string, dag_run_id string, status string, triggered_by string, "
        "config_snapshot string, records_extracted bigint, records_transformed bigint, records_loaded bigint, "
        "records_failed bigint, quality_score decimal(5,2), error_message string, started_at timestamp, "
        "finished_at timestamp, duration_seconds decimal(10,2)"
    ),
    "pipeline_tasks": (
        "task_id string, run_id string, task_name string, task_type string, status string, attempt_number int, "
        "records_in bigint, records_out bigint, error_message string, started_at timestamp, finished_at timestamp, "
        "duration_seconds decimal(10,2)"
    ),
    "data_quality_metrics": (
        "run_id string, pipeline_name string, metric_name string, metric_category string, passed boolean, "
        "expected_value double, actual_value double, threshold double, details string, evaluated_at timestamp"
    ),
    "etl_checkpoints": CHECKPOINT_SCHEMA,
    "alert_history": (
        "run_id string, alert_type string, severity string, subject string, message string, recipient string, "
        "sent_at timestamp, success boolean, error_message string"
    ),
    "pipeline_logs": (
        "run_id string, task_id string, pipeline_name string, log_level string, logger_name string, message string, "
        "extra_data string, logged_at timestamp"
    ),
    "data_sources": (
        "source_id string, name string, source_type string, connection_config map<string,string>, "
        "is_active boolean, last_tested_at timestamp, last_test_status string, created_at timestamp"
    ),
    "pipeline_configs": (
        "config_id string, pipeline_name string, config_data string, version int, is_active boolean, "
        "created_at timestamp, updated_at timestamp"
    ),
}
# Compacted rows are sorted by time, so that a report over recent days skips most of the older ones.
SORTED = {
    "pipeline_runs": ["started_at"], "pipeline_tasks": ["started_at"], "data_quality_metrics": ["evaluated_at"],
    "alert_history": ["sent_at"], "pipeline_logs": ["logged_at"],
}
SECRET_KEYS = ("password", "token", "secret", "api_key")


class Bookkeeping:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[table])
        if not exists(self.spark, self.path(table)):
            return self.spark.createDataFrame([], schema)
        return read_table(self.spark, self.path(table)).select(*schema.names)

    def frame(self, table: str, rows: list[dict]) -> DataFrame:
        """A few rows of a table, in one partition."""
        schema = T.StructType.fromDDL(SCHEMAS[table])
        return self.spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema).coalesce(1)

    def append(self, table: str, rows: DataFrame | list[dict]) -> None:
        schema = T.StructType.fromDDL(SCHEMAS[table])
        if isinstance(rows, list):
            rows = self.frame(table, rows)
        else:
            rows = rows.select(
                *[
                    (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in schema.fields
                ]
            )
        append_table(self.spark, self.path(table), rows, SORTED.get(table))

    def append_checks(self, checks: DataFrame, run_id: str, pipeline_name: str, at: dt.datetime) -> None:
        """Check rows of a run. The expected value is the threshold."""
        self.append(
            "data_quality_metrics",
            checks.select(
                F.lit(run_id).alias("run_id"),
                F.lit(pipeline_name).alias("pipeline_name"),
                F.col("name").alias("metric_name"),
                F.col("category").alias("metric_category"),
                "passed",
                F.col("threshold").alias("expected_value"),
                "actual_value",
                "threshold",
                "details",
                F.lit(at).alias("evaluated_at"),
            ),
        )

    def checkpoint(self, pipeline_name: str, source_name: str = "default"):
        """The stored mark as (text, type), or None."""
        row = read_checkpoint(self.read("etl_checkpoints"), pipeline_name, source_name).first()
        return (row["checkpoint_value"], row["value_type"]) if row else None

    def save_checkpoint(
        self, pipeline_name: str, source_name: str, value: str, value_type: str, at: dt.datetime
    ) -> None:
        row = checkpoint_row(self.spark, pipeline_name, source_name, value, value_type, at)
        upsert_table(self.spark, self.path("etl_checkpoints"), row, CHECKPOINT_KEYS, ["updated_at"], buckets=1)


def mask_secrets(sources: DataFrame, column: str = "connection_config") -> DataFrame:
    """Secret values of a configuration map become ``***``."""
    masked = F.transform_values(column, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), "***").otherwise(v))
    return sources.withColumn(column, masked)


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("is_active").select("source_id", "name", "source_type", "is_active", "last_test_status")
