"""Rules that rename, select, filter and tag."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import col
from .dedup import _as_list


def rename_columns(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``mapping`` {old: new}; unknown names are ignored."""
    mapping = config.get("mapping") or {}
    return df.withColumnsRenamed(mapping) if mapping else df


def select_columns(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``columns``; keeps those that exist, in that order, or everything when none does."""
    kept = [c for c in _as_list(config.get("columns")) if c in df.columns]
    return df.select(*[col(c) for c in kept]) if kept else df


def filter_rows(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``expression`` (SQL condition), ``null_result`` ('drop' or 'keep').

    A condition on missing values is unknown, and such rows go. ``null_result='keep'`` keeps them, which is what
    a negated condition (``!=``, ``NOT``) means for users who expect a missing value to differ from everything.
    """
    expression = config.get("expression")
    if not expression:
        return df
    condition = F.expr(expression)
    if config.get("null_result", "drop") == "keep":
        condition = F.coalesce(condition, F.lit(True))
    return df.filter(condition)


def add_audit_columns(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``pipeline_name``, ``run_id``, ``loaded_at`` (default now, fixed when the plan is built)."""
    loaded_at = config.get("loaded_at") or dt.datetime.now(dt.timezone.utc)
    if isinstance(loaded_at, str):
        loaded_at = dt.datetime.fromisoformat(loaded_at)
    if loaded_at.tzinfo is None:
        loaded_at = loaded_at.replace(tzinfo=dt.timezone.utc)
    micros = (loaded_at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return df.withColumns(
        {
            "_etl_pipeline": F.lit(config.get("pipeline_name", "unknown")),
            "_etl_run_id": F.lit(config.get("run_id", "")),
            "_etl_loaded_at": F.timestamp_micros(F.lit(micros)),
        }
    )
