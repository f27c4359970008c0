"""The tables behind the charts. Drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, is_numeric, is_text, nan_to_null
from .dedup import duplicate_counts
from .quantiles import column_quantiles


def null_matrix(df: DataFrame, order_by: list[str] | None = None, max_columns: int | None = None, rows: int = 200) -> DataFrame:
    """0/1 per cell for a picture of at most ``rows`` rows: the first in ``order_by`` order, or a sample that is
    fixed by the rows' content."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = df.columns[:max_columns]
    flags = [nan_to_null(col(c), types[c]).isNull().cast("int").alias(c) for c in names]
    if order_by:
        keys = [col(c) for c in order_by]
    else:
        keys = [F.xxhash64(F.lit(42), *[col(c).cast("string") for c in names])]
    ordered = df.select(*flags, *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    return ordered.orderBy(*[f"__k{i}" for i in range(len(keys))]).limit(rows).select(*[col(c) for c in names])


def null_percent(df: DataFrame) -> DataFrame:
    """Columns with gaps, fewest first: (column, null_pct, band)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    measures = [
        (F.count_if(nan_to_null(col(c), types[c]).isNull()) / n * 100).alias(f"c{i}") for i, c in enumerate(df.columns)
    ]
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_pct")) for i, c in enumerate(df.columns)]
    )
    band = F.when(F.col("null_pct") > 20, "high").when(F.col("null_pct") > 5, "medium").otherwise("low")
    return (
        df.agg(*measures).select(F.inline(cells)).filter("null_pct > 0").withColumn("band", band)
        .orderBy("null_pct", "column")
    )


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Two rows: how many rows are unique and how many repeat an earlier one."""
    kinds = F.array(
        F.struct(F.lit("Unique Rows").alias("label"), (F.col("total") - F.col("repeats")).alias("rows")),
        F.struct(F.lit("Duplicate Rows").alias("label"), F.col("repeats").alias("rows")),
    )
    return duplicate_counts(df).select(F.inline(kinds))


def type_groups(df: DataFrame) -> dict[str, int]:
    """Number of columns per type group, from the schema alone."""
    groups: dict[str, int] = {}
    for f in df.schema.fields:
        t = f.dataType
        if is_numeric(t):
            group = "Numeric"
        elif is_text(t):
            group = "Text"
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            group = "DateTime"
        elif isinstance(t, T.BooleanType):
            group = "Boolean"
        else:
            group = "Other"
        groups[group] = groups.get(group, 0) + 1
    return groups


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal bins between the smallest and the largest value: (bin, bin_start, bin_end, n), empty bins left out."""
    value = nan_to_null(col(column), df.schema[column].dataType).cast("double")
    data = df.select(value.alias("v")).filter("v is not null")
    span = data.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    lo, width = span.getField("lo"), (span.getField("hi") - span.getField("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))).otherwise(0)
    counts = data.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"), "n"
    )


def histogram_lines(df: DataFrame, column: str) -> DataFrame:
    """The mean and the exact median of a column, one row."""
    value = nan_to_null(col(column), df.schema[column].dataType).cast("double")
    median = column_quantiles(df, [column], [0.5]).get(column, [None])[0]
    return df.agg(F.avg(value).alias("mean")).select(
        F.lit(column).alias("column"), "mean", F.lit(median).cast("double").alias("median")
    )


def daily_status_pivot(runs: DataFrame, statuses: tuple[str, ...] = ("success", "failed", "running", "pending")) -> DataFrame:
    """Runs per day, one column per listed status and ``other`` for all else, a missing status included."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    counts.append(F.count_if(~F.coalesce(F.col("status").isin(*statuses), F.lit(False))).alias("other"))
    return runs.groupBy(F.to_date("started_at").alias("date")).agg(*counts)


def timeline(runs: DataFrame, limit: int = 20) -> DataFrame:
    """Intervals of the newest runs; a run without an end is drawn ten seconds long."""
    end = F.coalesce("finished_at", F.col("started_at") + F.expr("interval 10 seconds"))
    label = F.concat("pipeline_name", F.lit(" ["), "status", F.lit("]"))
    return (
        runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
        .select("run_id", label.alias("label"), "status", "started_at", end.alias("finished_at"), "records_loaded")
    )


def before_after(report: DataFrame) -> DataFrame:
    """Four rows from a cleaning report row: (category, before, after)."""
    original, zero = F.col("rows_in"), F.lit(0).cast("long")

    def row(category: str, before: Column, after: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), before.alias("before"), after.alias("after"))

    return report.select(
        F.inline(
            F.array(
                row("Total Rows", original, original),
                row("Rows After Clean", original, F.col("rows_out")),
                row("Nulls Filled", zero, F.col("filled_cells")),
                row("Duplicates Removed", zero, F.col("repeated_rows")),
            )
        )
    )


def quality_band(score: Column) -> Column:
    return F.when(score >= 75, "good").when(score >= 50, "fair").otherwise("poor")
