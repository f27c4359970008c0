"""Entry points that carry configuration rather than data: readers by name, own rules, gates, books, column types."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.charts import type_groups
from ..operators.quality import evaluate_quality, quality_gate
from ..operators.rules import apply_rules, register_transformation
from ..operators.scorecard import DIMENSIONS, scorecard
from ..plans.bookkeeping import Bookkeeping, active_sources
from ..plans.pipeline import run_pipeline
from ..session import staging_path
from ..sources.registry import ingest
from .base import query, table

# -- sources and rules by name -----------------------------------------------------------------------------


@query(
    "source_by_extension",
    """select kind, s_suppkey, s_name from supplier, (values ('csv'), ('tsv'), ('txt'), ('jsonl'), ('dat')) k(kind)""",
)
def _(spark, d):
    """One table in files of several extensions, each read by its own reader; an unknown one is read as CSV."""
    rows, parts = table(spark, d, "supplier").select("s_suppkey", "s_name"), []
    for kind, sep in (("csv", ","), ("tsv", "\t"), ("txt", "|"), ("dat", ","), ("jsonl", None)):
        path = f"{staging_path(spark, 'kind')}.{kind}"
        if sep is None:
            rows.write.json(path)
        else:
            rows.write.csv(path, header=True, sep=sep)
        parts.append(ingest(spark, path).select(F.lit(kind).alias("kind"), "s_suppkey", "s_name"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "rule_registered",
    """select c_custkey, c_mktsegment, c_acctbal * 2 as doubled from customer where c_acctbal > 0""",
)
def _(spark, d):
    """A rule of the user's own amid those that come with the library."""
    register_transformation("scale", lambda df, config: df.withColumn("doubled", F.col(config["column"]) * config["by"]))
    rules = [
        {"name": "filter_rows", "config": {"expression": "c_acctbal > 0"}},
        {"name": "scale", "config": {"column": "c_acctbal", "by": 2}},
        {"name": "select_columns", "config": {"columns": ["c_custkey", "c_mktsegment", "doubled"]}},
    ]
    return apply_rules(table(spark, d, "customer"), rules).data


# -- quality -----------------------------------------------------------------------------------------------


@query(
    "quality_gate",
    """with r as (select avg(case when o_orderkey % 3 = 0 then 1.0 else 0.0 end) as gaps from orders),
        s as (select round((0.35 * (case when gaps / 2 <= 0.2 then 1.0 else 0.0 end + 0) / 2
                            + 0.25 * 1.0 + 0.15 * 1.0) / 0.75, 4) as score from r)
       select cast(score as double) as score, score >= 0.8 as passed, score >= 0.5 as goes_on from s""",
)
def _(spark, d):
    """The composite score of a report against the two thresholds: below the first is a warning, below the second ends
    the load."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, null, o_custkey) as customer")
    config = {"required_columns": ["customer"], "unique_keys": ["o_orderkey"]}
    score = evaluate_quality(rows, config).to_dict()["composite_score"]
    gates = (quality_gate(score), quality_gate(score, 0.5))
    return spark.createDataFrame([(score, *gates)], "score double, passed boolean, goes_on boolean")


@query(
    "scorecard_empty",
    f"""select k.dimension, cast(0 as double) as score, 'rows' as measure, cast(e.n as double) as value
       from (select count(*) as n from events where event_id < 0) e, (values {", ".join(f"('{x}')" for x in DIMENSIONS)}) k(dimension)""",
)
def _(spark, d):
    """A table whose rows were all filtered away: every dimension scores 0 and says why."""
    card = scorecard(table(spark, d, "events").filter("event_id < 0"), "events", date_columns=["ts"])
    return card.rows.select("dimension", "score", F.inline("findings")).drop("column")


FOUND = [
    "if(c_custkey % 4 = 0, null, c_nationkey) as nation", "'same' as fixed", "if(c_custkey % 3 = 0, '12', 'none') as code",
    "if(c_custkey % 2 = 0, 'Seg', 'seg') as spelled", "c_custkey % 5 as few",
]


@query(
    "scorecard_findings",
    """with t as (select case when c_custkey % 4 = 0 then null else c_nationkey end as nation, 'same' as fixed,
                   case when c_custkey % 3 = 0 then '12' else 'none' end as code,
                   case when c_custkey % 2 = 0 then 'Seg' else 'seg' end as spelled, c_custkey % 5 as few from customer),
        g as (select nation, fixed, code, spelled, few, count(*) as n from t group by all)
       select 'completeness' as dimension, 'nation' as "column", 'missing share' as measure,
              round(avg(case when nation is null then 1.0 else 0.0 end), 6) as value from t
       union all select 'uniqueness', null, 'repeated share', round(sum(n - 1) / cast(sum(n) as double), 6) from g
       union all select 'uniqueness', 'fixed', 'distinct values', 1.0
       union all select 'consistency', 'code', 'numeric share', round(avg(case when code = '12' then 1.0 else 0.0 end), 6) from t
       union all select 'consistency', 'spelled', 'spellings', cast(count(distinct spelled) - count(distinct lower(spelled)) as double) from t""",
)
def _(spark, d):
    """All findings of a scorecard as rows."""
    dimensions = ("completeness", "uniqueness", "consistency")
    card = scorecard(table(spark, d, "customer").selectExpr(*FOUND), "customers", dimensions=dimensions)
    found = card.rows.select("dimension", F.inline("findings"))
    return found.withColumn("value", F.round("value", 6))


# -- books -------------------------------------------------------------------------------------------------


def _checked_parts(spark, d):
    root = staging_path(spark, "parts")
    store = Bookkeeping(spark, f"{root}/books")
    config = {
        "source": {"type": "parquet", "name": "part", "path": f"{d}/part.parquet"},
        "transformations": [{"name": "filter_rows", "config": {"expression": "p_size > 10"}}],
        "quality": {"required_columns": ["p_name"], "unique_keys": ["p_partkey"], "range_checks": [{"column": "p_size", "max": 40}]},
        "quality_threshold": 0.9,
        "destination": {"type": "parquet", "path": f"{root}/out"},
    }
    return store, run_pipeline(spark, "part", config, store)


@query(
    "books_checks",
    """select * from (
         select 'overall_null_ratio' as metric_name, 'completeness' as metric_category, true as passed,
                cast(0.2 as double) as expected_value, cast(0 as double) as actual_value from part where p_size > 10
         union all select 'required_column_not_null_p_name', 'completeness', count(*) = 0, 0, count(*)
                from part where p_size > 10 and p_name is null
         union all select 'unique_key_p_partkey', 'uniqueness', count(*) = count(distinct p_partkey), 0, count(*) - count(distinct p_partkey)
                from part where p_size > 10
         union all select 'duplicate_row_ratio', 'uniqueness', true, 0.05, 0 from part where p_size > 10
         union all select 'range_check_p_size', 'validity', count(*) = 0, 0, count(*) from part where p_size > 40
         union all select 'minimum_record_count', 'consistency', count(*) >= 1, 1, count(*) from part where p_size > 10
       ) group by all""",
)
def _(spark, d):
    """The check rows that a run books; what a check expects is its threshold."""
    store, _ = _checked_parts(spark, d)
    columns = ["metric_name", "metric_category", "passed", "expected_value", "actual_value"]
    return store.read("data_quality_metrics").select(*columns)


@query(
    "pipeline_summary",
    """select 'part' as pipeline_name, 'success' as status, count(*) as records_extracted,
              count(*) filter (where p_size > 10) as records_loaded,
              cast(round((0.35 + 0.25 + 0.25 * (case when max(p_size) <= 40 then 1 else 0 end) + 0.15), 4) as double) as composite_score,
              max(p_size) <= 40 as quality_passed from part""",
)
def _(spark, d):
    """What a run returns."""
    _, summary = _checked_parts(spark, d)
    row = {**summary, **summary["quality"]}
    schema = "pipeline_name string, status string, records_extracted bigint, records_loaded bigint, composite_score double, quality_passed boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(row[c] for c in names)], schema)


@query(
    "books_sources",
    """select 's' || s_suppkey as source_id, s_name as name, 'postgresql' as source_type, true as is_active, 'ok' as last_test_status
       from supplier where s_acctbal > 0""",
)
def _(spark, d):
    """The sources in use, out of all that are on record."""
    store = Bookkeeping(spark, staging_path(spark, "sources"))
    rows = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.lit("postgresql").alias("source_type"),
        F.create_map(F.lit("password"), F.lit("x")).alias("connection_config"), (F.col("s_acctbal") > 0).alias("is_active"),
        F.lit("ok").alias("last_test_status"), F.lit(dt.datetime(2024, 1, 1)).alias("created_at"),
    )
    store.append("data_sources", rows)
    return active_sources(store.read("data_sources"))


# -- charts ------------------------------------------------------------------------------------------------


@query(
    "column_types",
    """select case when column_type like 'TIMESTAMP%' or column_type = 'DATE' then 'DateTime' when column_type = 'VARCHAR' then 'Text'
                 when column_type = 'BOOLEAN' then 'Boolean' when column_type like '%[]' then 'Other' else 'Numeric' end as label,
              count(*) as columns
       from (describe select *, o_orderkey % 2 = 0 as even, [o_orderkey] as listed from orders) group by 1""",
)
def _(spark, d):
    """Columns per kind of type."""
    df = table(spark, d, "orders").selectExpr("*", "o_orderkey % 2 = 0 as even", "array(o_orderkey) as listed")
    return spark.createDataFrame(list(type_groups(df).items()), "label string, columns bigint")
