"""Run reports and chart tables. The run history is the events table read as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, runs
from ..operators.autoclean import autoclean
from .base import query, table
from .quality import RAW_SQL, STRIPPED_SQL, raw_customers
from .rules import GAPPY_EVENTS_SQL, GAPPY_SQL, gappy, gappy_events

AS_OF = "2024-01-31 00:00:00"
RUNS = [
    "cast(event_id as varchar(20)) as run_id",
    "'pipeline_' || cast(user_id % 6 as varchar(4)) as pipeline_name",
    "case event_type when 'error' then 'failed' when 'signup' then 'running' else 'success' end as status",
    "case when user_id % 2 = 0 then 'scheduler' else 'api' end as triggered_by",
    "event_id as records_extracted",
    "event_id - event_id % 3 as records_loaded",
    "event_id % 3 as records_failed",
    "case when event_type = 'signup' then null when value > 90 then 10.0 else 100 - value end as quality_score",
    "case when event_type = 'signup' then null else value end as duration_seconds",
    "cast(ts as timestamp) as started_at",
    "case when event_type = 'signup' then null else cast(ts as timestamp) + interval '90' second end as finished_at",
    "case when event_type = 'error' then 'bad ' || props end as error_message",
]
RUNS_SQL = f"(select {', '.join(RUNS)} from events)"
METRICS = [
    "cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(4)) || '-' || cast(l_partkey as varchar(20)) "
    "|| '-' || cast(l_suppkey as varchar(20)) as run_id",
    "'pipeline_' || cast(l_suppkey % 6 as varchar(4)) as pipeline_name",
    "'check_' || cast(l_partkey % 25 as varchar(4)) as metric_name",
    "case l_linenumber % 4 when 0 then 'completeness' when 1 then 'uniqueness' when 2 then 'validity' "
    "else 'consistency' end as metric_category",
    "l_returnflag <> 'R' as passed",
    "l_quantity as actual_value",
    "l_discount as threshold",
    "l_linestatus as details",
    "l_shipdate as evaluated_at",
]
METRICS_SQL = f"(select {', '.join(METRICS)} from lineitem)"
OK, BAD, RUN = "status = 'success'", "status = 'failed'", "status = 'running'"
SINCE = "started_at >= timestamp '2024-01-31 00:00:00' - interval '{n}' {unit}"


def run_table(spark, d):
    return table(spark, d, "events").selectExpr(*RUNS)


def metric_table(spark, d):
    return table(spark, d, "lineitem").selectExpr(*METRICS)


def dec(x: str, digits: int) -> str:
    return f"cast(round(cast({x} as decimal(24, 8)), {digits}) as double)"


@query(
    "run_health",
    f"""select case when rate >= 95 then 'healthy' when rate >= 80 then 'degraded' else 'critical' end as health,
               rate as success_rate_pct, total_runs, runs_last_24h, currently_running, avg_quality_score,
               timestamp '2024-01-31 00:00:00' as checked_at
        from (select round(count(*) filter (where {OK}) * 100.0 / count(*) filter (where {OK} or {BAD}), 1) as rate,
                     count(*) as total_runs, count(*) filter (where {SINCE.format(n=24, unit='hour')}) as runs_last_24h,
                     count(*) filter (where {RUN}) as currently_running,
                     {dec('avg(quality_score)', 2)} as avg_quality_score from {RUNS_SQL})""",
)
def _(spark, d):
    return runs.platform_health(run_table(spark, d), AS_OF)


@query(
    "run_stalled",
    f"""select run_id, pipeline_name, started_at,
               {dec("epoch_us(timestamp '2024-01-31 00:00:00' - started_at) / 3.6e9", 1)} as hours_running
        from (select * replace (started_at as started_at) from {RUNS_SQL})
        where {RUN} and started_at < timestamp '2024-01-31 00:00:00' - interval '4' hour""".replace(
        "epoch_us(timestamp '2024-01-31 00:00:00' - started_at)",
        "(epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(started_at))",
    ),
)
def _(spark, d):
    return runs.stalled_runs(run_table(spark, d), 4, AS_OF)


@query(
    "run_failures",
    f"""select run_id, pipeline_name, error_message, started_at, finished_at from {RUNS_SQL}
        where {BAD} and {SINCE.format(n=72, unit='hour')}""",
)
def _(spark, d):
    return runs.recent_failures(run_table(spark, d), 72, AS_OF)


@query(
    "run_sla",
    f"""select pipeline_name, count(*) as runs, {dec('avg(duration_seconds)', 1)} as avg_duration_s,
               {dec('quantile_cont(duration_seconds, 0.95)', 1)} as p95_duration_s,
               {dec('min(duration_seconds)', 1)} as min_duration_s, {dec('max(duration_seconds)', 1)} as max_duration_s
        from {RUNS_SQL} where {OK} and duration_seconds is not null group by pipeline_name""",
)
def _(spark, d):
    return runs.sla_report(run_table(spark, d))


KPI_SQL = f"""count(*) as total_runs, count(*) filter (where {OK}) as successful_runs,
    count(*) filter (where {BAD}) as failed_runs"""
RATE_SQL = f"round(count(*) filter (where {OK}) * 100.0 / count(*) filter (where {OK} or {BAD}), 2) as success_rate_pct"
AVERAGE_SQL = f"""cast(sum(records_loaded) as bigint) as total_records_loaded,
    {dec('avg(quality_score)', 2)} as avg_quality_score, {dec('avg(duration_seconds)', 2)} as avg_duration_seconds"""


@query(
    "run_summary",
    f"select {KPI_SQL}, count(*) filter (where {RUN}) as running_runs, {RATE_SQL}, {AVERAGE_SQL} from {RUNS_SQL}",
)
def _(spark, d):
    return runs.run_summary(run_table(spark, d))


@query(
    "run_by_pipeline",
    f"""select pipeline_name, {KPI_SQL}, {RATE_SQL}, {AVERAGE_SQL}, max(started_at) as last_run
        from {RUNS_SQL} group by pipeline_name""",
)
def _(spark, d):
    return runs.by_pipeline(run_table(spark, d))


@query(
    "run_trend",
    f"""select cast(started_at as date) as date, count(*) as total_runs, count(*) filter (where {OK}) as successful,
               count(*) filter (where {BAD}) as failed, cast(sum(records_loaded) as bigint) as records_loaded,
               {dec('coalesce(avg(quality_score), 0)', 2)} as avg_quality
        from {RUNS_SQL} where {SINCE.format(n=30, unit='day')} group by 1""",
)
def _(spark, d):
    return runs.daily_trend(run_table(spark, d), 30, AS_OF)


@query(
    "run_quality_trend",
    f"""select cast(started_at as date) as date, {dec('avg(quality_score)', 2)} as avg_quality
        from {RUNS_SQL} where {SINCE.format(n=90, unit='day')} group by 1 having avg(quality_score) > 0""",
)
def _(spark, d):
    return runs.daily_trend(run_table(spark, d), 90, AS_OF, scored_only=True).select("date", "avg_quality")


@query(
    "run_latest_checks",
    f"""select pipeline_name, metric_name, metric_category, passed, actual_value, threshold, details, evaluated_at
        from {METRICS_SQL} where pipeline_name = 'pipeline_2'
        order by evaluated_at desc, run_id, metric_name limit 100""",
)
def _(spark, d):
    return runs.latest_checks(metric_table(spark, d), "pipeline_2")


@query(
    "run_pipeline_view",
    f"""select pipeline_name, {KPI_SQL}, count(*) filter (where {RUN}) as running_runs, {RATE_SQL},
               {dec(f'avg(duration_seconds) filter (where {OK})', 4)} as avg_duration_seconds,
               cast(sum(records_loaded) filter (where {OK}) as bigint) as total_records_loaded, max(started_at) as last_run_at
        from {RUNS_SQL} group by pipeline_name""",
)
def _(spark, d):
    view = runs.pipeline_summary(run_table(spark, d))
    return view.withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 4))


RECENT_SQL = f"select {', '.join(runs.RECENT_RUN_COLUMNS)} from {RUNS_SQL}"


@query("run_recent_view", f"{RECENT_SQL} order by started_at desc, run_id limit 100")
def _(spark, d):
    return runs.recent_runs(run_table(spark, d))


@query(
    "run_history_page",
    f"{RECENT_SQL} where pipeline_name = 'pipeline_3' order by started_at desc, run_id limit 50 offset 25",
)
def _(spark, d):
    return runs.run_history(run_table(spark, d), "pipeline_3", limit=50, offset=25)


@query("run_by_id", f"{RECENT_SQL} where run_id = '77'")
def _(spark, d):
    return runs.run_by_id(run_table(spark, d), "77")


@query(
    "run_latest_status",
    f"""select p.pipeline_name, coalesce(r.status, 'never_run') as status, r.started_at as last_run,
               r.run_id as last_run_id, r.records_loaded, r.quality_score
        from (select distinct 'pipeline_' || cast(n_nationkey as varchar) as pipeline_name from nation) p
        left join (select *, row_number() over (partition by pipeline_name order by started_at desc, run_id desc) as rn
                   from {RUNS_SQL}) r on p.pipeline_name = r.pipeline_name and r.rn = 1""",
)
def _(spark, d):
    names = table(spark, d, "nation").selectExpr("'pipeline_' || cast(n_nationkey as string) as pipeline_name")
    return runs.latest_status(run_table(spark, d), names)


@query(
    "run_filter",
    f"""select run_id, pipeline_name, status, started_at from {RUNS_SQL}
        where pipeline_name = 'pipeline_1' and {BAD} order by started_at desc, run_id limit 15""",
)
def _(spark, d):
    found = runs.filter_runs(run_table(spark, d), "pipeline_1", "failed", 15)
    return found.select("run_id", "pipeline_name", "status", "started_at")


@query("run_status_distribution", f"select status, count(*) as runs from {RUNS_SQL} group by status")
def _(spark, d):
    return runs.status_distribution(run_table(spark, d))


@query(
    "run_listed_kpis",
    f"""select count(*) as showing, {dec('avg(duration_seconds)', 1)} as avg_duration,
               cast(sum(records_loaded) as bigint) as total_records from {RUNS_SQL}""",
)
def _(spark, d):
    return runs.listed_kpis(run_table(spark, d))


@query(
    "run_overview",
    f"""select {KPI_SQL}, count(*) filter (where {RUN}) as running_runs, {dec('avg(quality_score)', 4)} as avg_quality,
               cast(sum(records_loaded) as bigint) as total_records,
               round(count(*) filter (where {OK}) * 100.0 / count(*), 1) as success_share_pct from {RUNS_SQL}""",
)
def _(spark, d):
    return runs.overview_kpis(run_table(spark, d)).withColumn("avg_quality", F.round("avg_quality", 4))


@query(
    "check_pass_rate",
    f"""select metric_category as category, count(*) filter (where passed) as passed, count(*) as total,
               round(count(*) filter (where passed) * 100.0 / count(*), 1) as pass_rate_pct
        from {METRICS_SQL} group by 1""",
)
def _(spark, d):
    return runs.pass_rate_by_category(metric_table(spark, d))


@query(
    "check_totals",
    f"""select count(*) as total_checks, count(*) filter (where passed) as passed,
               count(*) filter (where not passed) as failed from {METRICS_SQL}""",
)
def _(spark, d):
    return runs.check_totals(metric_table(spark, d))


@query(
    "check_top_failing",
    f"""select metric_name, count(*) as failures from {METRICS_SQL} where not passed
        group by metric_name order by failures desc, metric_name limit 10""",
)
def _(spark, d):
    return runs.top_failing_checks(metric_table(spark, d))


LOG_SQL = """select conv_id, turn, line,
    case when contains(lower(line), 'error') or contains(lower(line), 'fail') or contains(lower(line), 'exception') then 'error'
         when contains(lower(line), 'warn') then 'warning'
         when contains(lower(line), 'success') or contains(lower(line), 'complete') or contains(lower(line), '✓') then 'success'
         else 'info' end as level,
    case when strpos(line, ' ') > 0 then substr(line, 1, strpos(line, ' ') - 1) else '' end as log_time,
    case when strpos(line, ' ') > 0 then substr(line, strpos(line, ' ') + 1) else line end as message
    from (select conv_id, turn, unnest(string_split(text, chr(10))) as line from conversations)"""


@query("log_levels", LOG_SQL)
def _(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    return runs.classify_logs(lines)


@query("log_keyword", f"select * from ({LOG_SQL}) where contains(lower(line), 'er')")
def _(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    return runs.classify_logs(lines, keyword="ER")


@query(
    "log_level_counts",
    """select level, count(*) as n from (
           select case when contains(lower(line), 'error') or contains(lower(line), 'fail')
                         or contains(lower(line), 'exception') then 'error'
                       when contains(lower(line), 'warn') then 'warning'
                       when contains(lower(line), 'success') or contains(lower(line), 'complete')
                         or contains(lower(line), '✓') then 'success' else 'info' end as level
           from (select unnest(string_split(text, chr(10))) as line from documents)) group by level""",
)
def _(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return runs.classify_logs(lines).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "alerts",
    f"""select run_id, pipeline_name, 'failure' as alert_type, 'error' as severity,
               'Pipeline Failed: ' || pipeline_name as subject,
               'Pipeline execution failed with error: ' || coalesce(error_message, '') as message
        from {RUNS_SQL} where {BAD}
        union all
        select run_id, pipeline_name, 'quality', 'warning', 'Low Data Quality: ' || pipeline_name,
               'Quality score ' || format('{{:.2f}}', quality_score) || '% is below threshold 80.00%'
        from {RUNS_SQL} where quality_score < 80
        union all
        select run_id, pipeline_name, 'success', 'info', 'Pipeline Completed: ' || pipeline_name,
               'Successfully loaded ' || format('{{:,}}', records_loaded) || ' records.' from {RUNS_SQL} where {OK}""",
)
def _(spark, d):
    return runs.alert_events(run_table(spark, d)).drop("details")


# -- chart tables ------------------------------------------------------------------------------------------


@query(
    "null_matrix",
    f"""select cast(event_id is null as integer) as event_id, cast(user_id is null as integer) as user_id,
               cast(ts is null as integer) as ts, cast(reading is null as integer) as reading,
               cast(kind is null as integer) as kind
        from (select * from {GAPPY_EVENTS_SQL} order by ts, event_id limit 200)""",
)
def _(spark, d):
    return charts.null_matrix(gappy_events(spark, d), order_by=["ts", "event_id"])


@query(
    "null_pct",
    f"""select *, case when null_pct > 20 then 'high' when null_pct > 5 then 'medium' else 'low' end as band from (
            select 'qty' as column, (count(*) - count(qty)) / cast(count(*) as double) * 100 as null_pct from {GAPPY_SQL}
            union all select 'flag', (count(*) - count(flag)) / cast(count(*) as double) * 100 from {GAPPY_SQL}
            union all select 'line', (count(*) - count(line)) / cast(count(*) as double) * 100 from {GAPPY_SQL})
        where null_pct > 0""",
)
def _(spark, d):
    return charts.null_percent(gappy(spark, d))


@query(
    "duplicate_summary",
    """with g as (select count(*) as n from documents group by text, lang, source)
       select 'Unique Rows' as label, cast(count(*) as bigint) as rows from g
       union all select 'Duplicate Rows', cast(sum(n - 1) as bigint) from g""",
)
def _(spark, d):
    return charts.duplicate_summary(table(spark, d, "documents").select("text", "lang", "source"))


@query(
    "histogram",
    """select bin, count(*) as n, round(min(lo) + bin * min(w), 6) as bin_start, round(min(lo) + (bin + 1) * min(w), 6) as bin_end
       from (select cast(least(floor((value - lo) / w), 39) as integer) as bin, lo, w
             from events, (select min(value) as lo, (max(value) - min(value)) / 40 as w from events)) group by bin""",
)
def _(spark, d):
    bins = charts.histogram(table(spark, d, "events"), "value")
    return bins.select("bin", "n", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"))


@query(
    "histogram_lines",
    "select 'value' as column, round(avg(value), 6) as mean, quantile_cont(value, 0.5) as median from events",
)
def _(spark, d):
    lines = charts.histogram_lines(table(spark, d, "events"), "value")
    return lines.select("column", F.round("mean", 6).alias("mean"), "median")


@query(
    "run_pivot_daily",
    f"""select cast(started_at as date) as date, count(*) filter (where {OK}) as success,
               count(*) filter (where {BAD}) as failed, count(*) filter (where {RUN}) as running,
               count(*) filter (where status = 'pending') as pending,
               count(*) filter (where status is null or status not in ('success', 'failed', 'running', 'pending')) as other
        from {RUNS_SQL} group by 1""",
)
def _(spark, d):
    return charts.daily_status_pivot(run_table(spark, d))


@query(
    "timeline",
    f"""select run_id, pipeline_name || ' [' || status || ']' as label, status, started_at,
               coalesce(finished_at, started_at + interval '10' second) as finished_at, records_loaded
        from {RUNS_SQL} order by started_at desc, run_id limit 20""",
)
def _(spark, d):
    return charts.timeline(run_table(spark, d))


@query(
    "cleaning_before_after",
    f"""with a as (select count(*) as n from {RAW_SQL}),
             b as (select count(*) as n, 2 * count(*) - count(acct_bal) - count(segment) as gaps from {STRIPPED_SQL})
        select 'Total Rows' as category, a.n as before, a.n as after from a
        union all select 'Rows After Clean', a.n, b.n from a, b
        union all select 'Nulls Filled', 0, gaps from b
        union all select 'Duplicates Removed', 0, a.n - b.n from a, b""",
)
def _(spark, d):
    report = autoclean(raw_customers(spark, d), "customers")[1].summary()
    return charts.before_after(report)


@query(
    "quality_band",
    f"""select run_id, quality_score, case when quality_score >= 75 then 'good' when quality_score >= 50 then 'fair'
            else 'poor' end as band from {RUNS_SQL} where quality_score is not null""",
)
def _(spark, d):
    scored = run_table(spark, d).filter("quality_score is not null")
    return scored.select("run_id", "quality_score", charts.quality_band(F.col("quality_score")).alias("band"))
