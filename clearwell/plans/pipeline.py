"""Pipelines declared as dictionaries.

``build`` turns a configuration into one lazy DataFrame. ``run_pipeline`` also stages, checks, loads and books a
run: the transformed rows are written once to the shared folder, and the checks and the load read that copy, so
the source is read once and every count comes from the writing job.
"""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.values import col
from ..operators.autoclean import CleaningReport, autoclean
from ..operators.quality import QualityReport, evaluate_quality, quality_gate
from ..operators.rules import RuleRun, apply_rules
from ..operators.runs import alert_events
from ..operators.scorecard import Scorecard, scorecard
from ..session import discard, staging_path
from ..sinks.writers import load
from ..sources.registry import extract, extract_table, ingest
from ..streaming.incremental import as_text, larger_mark
from .bookkeeping import SECRET_KEYS, Bookkeeping


def is_incremental(config: dict) -> bool:
    return bool(config.get("incremental") or (config.get("source") or {}).get("incremental"))


def source_name(config: dict) -> str:
    return (config.get("source") or {}).get("name", "default")


def source_config(config: dict) -> dict:
    return {**(config.get("source") or {}), "incremental": is_incremental(config)}


def build(
    spark: SparkSession, name: str, config: dict, checkpoint=None, run_id: str | None = None, observe: bool = False
) -> RuleRun:
    """Extract and transform, lazily."""
    return _transform(extract(spark, source_config(config), checkpoint), name, config, run_id, observe)


def _transform(df: DataFrame, name, config, run_id, observe) -> RuleRun:
    return apply_rules(df, config.get("transformations") or [], name, run_id, observe)


def _without_secrets(value):
    if isinstance(value, dict):
        return {k: "***" if str(k).lower() in SECRET_KEYS else _without_secrets(v) for k, v in value.items()}
    return [_without_secrets(v) for v in value] if isinstance(value, list) else value


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


@dataclass
class Run:
    """A run row in the making."""

    pipeline_name: str
    config: dict
    triggered_by: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    started_at: dt.datetime = field(default_factory=_now)
    tasks: list[dict] = field(default_factory=list)
    values: dict = field(default_factory=dict)
    counted_from: dt.datetime | None = None

    def finish(self, status: str, error: str | None = None) -> dict:
        end = _now()
        snapshot = json.dumps(_without_secrets(self.config), default=str)
        return {
            "run_id": self.run_id, "pipeline_name": self.pipeline_name, "status": status,
            "triggered_by": self.triggered_by, "config_snapshot": snapshot, "started_at": self.started_at,
            "finished_at": end, "duration_seconds": _decimal((end - (self.counted_from or self.started_at)).total_seconds()),
            "error_message": error, **self.values,
        }

    def task(self, name: str, started: dt.datetime, records_in=0, records_out=0, error=None) -> None:
        end = _now()
        self.tasks.append({
            "task_id": str(uuid.uuid4()), "run_id": self.run_id, "task_name": name, "task_type": name,
            "status": "failed" if error else "success", "attempt_number": 1, "records_in": records_in,
            "records_out": records_out, "error_message": error, "started_at": started, "finished_at": end,
            "duration_seconds": _decimal((end - started).total_seconds()),
        })


def _decimal(x: float):
    import decimal

    return decimal.Decimal(str(round(x, 2)))


def run_pipeline(
    spark: SparkSession,
    name: str,
    config: dict,
    store: Bookkeeping,
    triggered_by: str = "scheduler",
    interval_start: dt.datetime | None = None,
) -> dict:
    """Extract, transform, check, load, save the mark, book the run. Returns the run's summary.

    The mark is saved after a successful load only, so a crash in between repeats rows, and an upsert sink makes
    that harmless. Config: ``source``, ``transformations``, ``quality``, ``quality_threshold``,
    ``on_low_quality`` ('warn' or 'fail'), ``destination``, ``incremental``. A scheduled run gives the start of
    its data interval, from which its duration is then counted.
    """
    run = Run(name, config, triggered_by, counted_from=interval_start)
    alerts: dict = {}
    try:
        summary = _execute(spark, run, config, store, alerts)
        row = run.finish("success")
    except Exception as error:
        row = run.finish("failed", str(error))
        _book(store, run, row, alerts)
        raise
    _book(store, run, row, alerts)
    summary["duration_seconds"] = float(row["duration_seconds"])
    return summary


def _execute(spark: SparkSession, run: Run, config: dict, store: Bookkeeping, alerts: dict) -> dict:
    name = run.pipeline_name
    source = source_config(config)
    mark = store.checkpoint(name, source_name(config)) if source["incremental"] else None
    mark_column = source.get("checkpoint_column")

    started = _now()
    read = extract_table(spark, source, mark[0] if mark else None)
    raw = read.data
    watched, seen, mark_type = raw, None, None
    if mark_column in raw.columns:
        mark_type = raw.schema[mark_column].dataType.simpleString()
        seen = Observation(f"mark-{uuid.uuid4().hex[:12]}")
        watched = raw.observe(seen, as_text(F.max(col(mark_column))).alias("mark"))
    result = _transform(watched, name, config, run.run_id, observe=True)
    staged_path = staging_path(spark, name)
    try:
        return _finish(spark, run, config, store, alerts, read, result, staged_path, started, mark, mark_type, seen)
    finally:
        discard(spark, staged_path)


def _finish(spark, run, config, store, alerts, read, result, staged_path, started, mark, mark_type, seen) -> dict:
    """Write the transformed rows once, check and load that copy, move the mark."""
    name, source = run.pipeline_name, source_config(config)
    result.data.write.mode("overwrite").parquet(staged_path)
    staged = spark.read.schema(result.data.schema).parquet(staged_path)
    came, went = result.rows
    unread = read.rejects.count() if read.rejects is not None else 0
    notes = [*result.notes, *([f"{unread} lines of the source could not be read"] if unread else [])]
    run.task("extract", started, records_out=came)
    run.task("transform", started, came, went)
    run.values.update(records_extracted=came, records_transformed=went)

    report = evaluate_quality(staged, config.get("quality") or {}, name)
    # A few rows per configured check; kept so that the checks run once.
    checks = spark.createDataFrame(report.checks.collect(), report.checks.schema)
    store.append_checks(checks, run.run_id, name, _now())
    scores = QualityReport(name, checks).to_dict()
    score, threshold = scores["composite_score"], config.get("quality_threshold", 0.80)
    run.values["quality_score"] = _decimal(score * 100)
    alerts["threshold"] = threshold
    alerts["low"] = not quality_gate(score, threshold, config.get("on_low_quality", "warn"))

    started = _now()
    loaded = load(staged, {**(config.get("destination") or {}), "name": name})
    run.task("load", started, went, loaded.records_loaded, loaded.error)
    run.values.update(records_loaded=loaded.records_loaded, records_failed=loaded.records_failed + unread)
    if not loaded.success:
        raise RuntimeError(f"Load failed: {loaded.error}")
    if seen is not None and source["incremental"]:
        value = larger_mark(mark[0] if mark else None, seen.get["mark"], mark_type, spark)
        if value is not None:
            store.save_checkpoint(name, source_name(config), value, mark_type, _now())
    return {
        "run_id": run.run_id, "pipeline_name": name, "status": "success", **run.values,
        "rules_applied": result.applied, "warnings": notes, "quality": scores,
        "quality_passed": not alerts["low"],
    }


def _book(store: Bookkeeping, run: Run, row: dict, alerts: dict) -> None:
    events = alert_events(store.frame("pipeline_runs", [row]), alerts.get("threshold", 0.80))
    books = {
        "pipeline_runs": [row],
        "pipeline_tasks": run.tasks,
        "alert_history": events.withColumn("sent_at", F.lit(row["finished_at"])),
    }
    # Three small independent writes.
    with ThreadPoolExecutor(len(books)) as pool:
        writes = [pool.submit(store.append, name, rows) for name, rows in books.items() if run.tasks or name != "pipeline_tasks"]
    for write in writes:
        write.result()


def run_without_checks(spark: SparkSession, name: str, config: dict) -> dict:
    """Extract, transform and load only, the way pipelines found in a folder run: no checks, no mark."""
    result = build(spark, name, {**config, "incremental": False}, observe=True)
    if not config.get("destination"):
        raise ValueError(f"pipeline {name!r} has no destination")
    loaded = load(result.data, config["destination"])
    if not loaded.success:
        raise RuntimeError(f"Load failed: {loaded.error}")
    return {"pipeline_name": name, "records_loaded": loaded.records_loaded, "warnings": result.notes}


def discover(folder: str) -> dict[str, dict]:
    """Configurations of a folder of YAML files by file name, but for those with ``dynamic_dag: false``."""
    import yaml

    found = {}
    for path in sorted(glob.glob(os.path.join(folder, "*.yaml"))):
        with open(path) as handle:
            config = yaml.safe_load(handle)
        if isinstance(config, dict) and config.get("dynamic_dag", True):
            found[os.path.splitext(os.path.basename(path))[0]] = config
    return found


def run_folder(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Run every discovered pipeline. One that fails is reported and does not stop the others."""
    results = {}
    for name, config in discover(folder).items():
        try:
            results[name] = run_without_checks(spark, name, config)
        except Exception as error:  # noqa: BLE001 - reported per pipeline
            results[name] = {"pipeline_name": name, "error": str(error)}
    return results


def clean_upload(
    spark: SparkSession, path: str, sheet: str | None = None, **cleaning
) -> tuple[DataFrame, CleaningReport, Scorecard]:
    """Read an uploaded file, clean it, score the cleaned rows."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    cleaned, report = autoclean(ingest(spark, path, sheet=sheet), name, **cleaning)
    return cleaned, report, scorecard(cleaned, name)
