"""Pass/fail quality checks and their weighted composite score (0 to 1)."""

from __future__ import annotations

import functools
import itertools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, is_text, nan_to_null, starts_with_pattern, to_number
from .dedup import _as_list, duplicate_counts

# What each category weighs in the composite score.
CATEGORY_WEIGHTS = {
    "completeness": 0.35,
    "uniqueness": 0.25,
    "validity": 0.25,
    "consistency": 0.15,
}
DEFAULT_QUALITY_THRESHOLD = 0.80
HALT_THRESHOLD = 0.50


class LowQualityError(RuntimeError):
    """Raised by a gate that is set to fail."""


@dataclass
class QualityReport:
    """``checks``: one row per check (lazy). ``summary()``: one row of scores."""

    pipeline_name: str
    checks: DataFrame

    def summary(self) -> DataFrame:
        return summarize_checks(self.checks).withColumn("pipeline_name", F.lit(self.pipeline_name))

    def to_dict(self) -> dict:
        """Scores and checks as plain values; a few rows per configured check."""
        rows = self.checks.orderBy("position").drop("position").collect()
        checks = [{**r.asDict(), "details": json.loads(r["details"]) if r["details"] else {}} for r in rows]
        return {**self.summary().first().asDict(), "checks": checks}


def _details(**parts: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def _text_list(values) -> Column:
    return F.array(*[F.lit(str(v)) for v in values]).cast("array<string>")


def _check(position, name, category, passed, actual=None, threshold=None, details=None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(name).alias("name"),
        F.lit(category).alias("category"),
        passed.alias("passed"),
        (none if actual is None else actual).cast("double").alias("actual_value"),
        (none if threshold is None else F.lit(threshold)).cast("double").alias("threshold"),
        (none if details is None else details).cast("string").alias("details"),
    )


def evaluate_quality(df: DataFrame, config: dict, pipeline_name: str = "default") -> QualityReport:
    """Build the checks as one lazy DataFrame.

    Config: ``max_null_ratio`` (.20), ``required_columns``, ``max_duplicate_ratio`` (.05), ``unique_keys``,
    ``range_checks`` [{column, min, max}], ``regex_checks`` [{column, pattern}], ``min_records`` (1),
    ``expected_columns``. All per-column measures come from one aggregation over one scan; the duplicate ratio
    and each unique key are one grouped count.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    max_null = float(config.get("max_null_ratio", 0.20))
    max_duplicates = float(config.get("max_duplicate_ratio", 0.05))
    min_records = config.get("min_records", 1)
    required = _as_list(config.get("required_columns"))
    expected = _as_list(config.get("expected_columns"))
    ranges = [r for r in config.get("range_checks") or [] if r.get("column") in types]
    patterns = [r for r in config.get("regex_checks") or [] if r.get("column") in types and r.get("pattern")]
    keys = [[c for c in _as_list(k) if c in types] for k in config.get("unique_keys") or []]

    nulls = {c: nan_to_null(col(c), t).isNull() for c, t in types.items()}
    measures = [F.count(F.lit(1)).alias("n")]
    measures += [F.count_if(nulls[c]).alias(f"null_{i}") for i, c in enumerate(types)]
    for i, r in enumerate(ranges):
        number = to_number(col(r["column"]), types[r["column"]])
        bad = F.lit(False)
        if r.get("min") is not None:
            bad = bad | (number < F.lit(float(r["min"])))
        if r.get("max") is not None:
            bad = bad | (number > F.lit(float(r["max"])))
        measures.append(F.count_if(bad).alias(f"range_{i}"))
    for i, r in enumerate(patterns):
        dtype = types[r["column"]]
        text = col(r["column"]) if is_text(dtype) else col(r["column"]).cast("string")
        measures.append(F.count_if(~starts_with_pattern(text, r["pattern"])).alias(f"regex_{i}"))
    stats = df.agg(*measures)

    n = F.col("n")
    checks, order = [], itertools.count()
    ratio = {c: F.col(f"null_{i}") / F.nullif(n, F.lit(0)) for i, c in enumerate(types)}
    if types:
        overall = functools.reduce(lambda a, b: a + b, ratio.values()) / len(types)
        per_column = F.to_json(F.create_map(*[x for c in types for x in (F.lit(c), F.round(ratio[c], 4))]))
        measured = _check(
            next(order), "overall_null_ratio", "completeness", overall <= max_null, F.round(overall, 4), max_null,
            F.concat(F.lit('{"null_ratio_per_column":'), per_column, F.lit("}")),
        )
        checks.append(F.when(n > 0, measured))
    for c in required:
        if c in types:
            checks.append(
                _check(
                    next(order), f"required_column_not_null_{c}", "completeness",
                    F.coalesce(ratio[c] == 0, F.lit(False)), F.round(ratio[c], 4), 0.0,
                    F.lit(json.dumps({"column": c})),
                )
            )
        else:
            missing = json.dumps({"column": c, "reason": "Column missing from DataFrame"})
            checks.append(
                _check(next(order), f"required_column_exists_{c}", "completeness", F.lit(False), details=F.lit(missing))
            )
    duplicate_position = next(order)
    key_positions = [next(order) for _ in keys]
    for i, r in enumerate(ranges):
        bad = F.col(f"range_{i}")
        text = json.dumps({"column": r["column"], "min": r.get("min"), "max": r.get("max")})
        checks.append(
            _check(next(order), f"range_check_{r['column']}", "validity", bad == 0, bad, 0.0, F.lit(text))
        )
    for i, r in enumerate(patterns):
        bad = F.col(f"regex_{i}")
        text = json.dumps({"column": r["column"], "pattern": r["pattern"]})
        checks.append(
            _check(next(order), f"regex_check_{r['column']}", "validity", bad == 0, bad, 0.0, F.lit(text))
        )
    checks.append(
        _check(
            next(order), "minimum_record_count", "consistency", n >= F.lit(min_records), n, float(min_records),
            _details(record_count=n),
        )
    )
    if expected:
        absent = [c for c in expected if c not in types]
        checks.append(
            _check(
                next(order), "expected_schema_columns", "consistency", F.lit(not absent),
                details=F.lit(json.dumps({"missing_columns": absent})),
            )
        )
    result = stats.select(F.explode(F.array(*checks)).alias("c")).filter("c is not null").select("c.*")

    if types:
        share = F.col("repeats") / F.col("total")
        repeated = duplicate_counts(df).filter("total > 0").select(
            _check(
                duplicate_position, "duplicate_row_ratio", "uniqueness", share <= max_duplicates,
                F.round(share, 4), max_duplicates, _details(duplicate_count=F.col("repeats")),
            ).alias("c")
        )
        result = result.unionByName(repeated.select("c.*"))
    for position, key in zip(key_positions, keys):
        if not key:
            continue
        repeats = F.col("repeats")
        counted = duplicate_counts(df, key).select(
            _check(
                position, f"unique_key_{'_'.join(key)}", "uniqueness", repeats == 0, repeats, 0.0,
                _details(columns=_text_list(key), duplicate_count=repeats),
            ).alias("c")
        )
        result = result.unionByName(counted.select("c.*"))
    return QualityReport(pipeline_name, result)


def composite_score() -> Column:
    """Aggregate over check rows: the mean pass rate of each category, weighted over the categories present."""
    known = F.when(F.col("category").isin(*CATEGORY_WEIGHTS), F.col("category")).otherwise(F.lit("validity"))
    passed = F.col("passed").cast("double")
    total, weight = F.lit(0.0), F.lit(0.0)
    for category, w in CATEGORY_WEIGHTS.items():
        rate = F.avg(F.when(known == category, passed))
        total = total + F.coalesce(rate * w, F.lit(0.0))
        weight = weight + F.when(rate.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.coalesce(F.round(total / F.nullif(weight, F.lit(0.0)), 4), F.lit(0.0))


def summarize_checks(checks: DataFrame) -> DataFrame:
    """One row: composite_score, passed_checks, failed_checks, pass_rate, total_records."""
    n = F.count(F.lit(1))
    return checks.agg(
        composite_score().alias("composite_score"),
        F.count_if(F.col("passed")).alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        F.coalesce(F.round(F.count_if(F.col("passed")) / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("pass_rate"),
        F.max(F.when(F.col("name") == "minimum_record_count", F.col("actual_value"))).cast("long").alias("total_records"),
    )


def quality_gate(score: float, threshold: float | None = None, on_low_quality: str = "warn",
                 halt_below: float = HALT_THRESHOLD) -> bool:
    """True when the score reaches the threshold. ``on_low_quality='fail'`` raises below ``halt_below``."""
    threshold = DEFAULT_QUALITY_THRESHOLD if threshold is None else threshold
    if on_low_quality == "fail" and score < halt_below:
        raise LowQualityError(f"quality score {score:.2%} is below {halt_below:.2%}")
    return score >= threshold
