"""Incremental loads: high-water marks for tables, and new files of a folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col
from ..operators.merge import upsert

CHECKPOINT_SCHEMA = (
    "pipeline_name string, source_name string, checkpoint_key string, checkpoint_value string, "
    "value_type string, updated_at timestamp"
)
CHECKPOINT_KEYS = ["pipeline_name", "source_name", "checkpoint_key"]
WATERMARK = "watermark"


def filter_since(df: DataFrame, column: str | None, checkpoint) -> DataFrame:
    """Rows strictly above the mark, everything on a first run. The literal has the column's type, so the filter
    reaches the scan."""
    if column is None or checkpoint is None:
        return df
    return df.filter(col(column) > F.lit(checkpoint).cast(df.schema[column].dataType))


def as_text(value: Column) -> Column:
    return value.cast("string")


def high_water_mark(df: DataFrame, column: str) -> DataFrame:
    """One row (checkpoint_value, value_type): the largest value compared in its own type."""
    kind = df.schema[column].dataType.simpleString()
    return df.agg(as_text(F.max(col(column))).alias("checkpoint_value")).withColumn("value_type", F.lit(kind))


def larger_mark(old: str | None, new: str | None, value_type: str, spark: SparkSession) -> str | None:
    """The larger of two marks, compared in their type."""
    if old is None or new is None:
        return new if old is None else old
    row = spark.range(1).select(
        as_text(F.greatest(F.lit(old).try_cast(value_type), F.lit(new).try_cast(value_type)))
    )
    return row.first()[0]


def read_checkpoint(
    table: DataFrame, pipeline_name: str, source_name: str = "default", key: str = WATERMARK
) -> DataFrame:
    """The stored mark, one row or none."""
    mine = (
        (F.col("pipeline_name") == pipeline_name)
        & (F.col("source_name") == source_name)
        & (F.col("checkpoint_key") == key)
    )
    newest = F.max(F.struct("updated_at", "checkpoint_value", "value_type")).alias("r")
    return (
        table.filter(mine)
        .agg(newest)
        .filter("r is not null")
        .select("r.checkpoint_value", "r.value_type", "r.updated_at")
    )


def checkpoint_row(
    spark: SparkSession, pipeline_name: str, source_name: str, value: str, value_type: str, now: dt.datetime
) -> DataFrame:
    schema = T.StructType.fromDDL(CHECKPOINT_SCHEMA)
    return spark.createDataFrame([(pipeline_name, source_name, WATERMARK, value, value_type, now)], schema)


def advance_checkpoints(stored: DataFrame, marks: DataFrame) -> DataFrame:
    """The checkpoint table after new marks came in (upsert on the three key columns, newest wins)."""
    return upsert(stored, marks, CHECKPOINT_KEYS, order_by=["updated_at"])


def load_new_files(
    spark: SparkSession,
    folder: str,
    schema: str,
    rules: list,
    target: str,
    progress: str,
    file_format: str = "parquet",
    pipeline_name: str = "default",
):
    """Load the files of a folder that were not loaded before, then stop. Progress is kept in ``progress``; the
    Parquet sink commits a batch once. Only rules that need no ordering over the whole table can be used."""
    from ..operators.rules import apply_rules

    arriving = spark.readStream.format(file_format).schema(schema).load(folder)
    cleaned = apply_rules(arriving, rules, pipeline_name)
    if cleaned.notes:
        raise ValueError(f"rules do not fit an incremental file load: {cleaned.notes}")
    query = (
        cleaned.data.writeStream.format("parquet").option("checkpointLocation", progress)
        .trigger(availableNow=True).start(target)
    )
    query.awaitTermination()
    return query
