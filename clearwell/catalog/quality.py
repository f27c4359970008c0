"""Quality report, scorecard, profile and automatic cleaning over whole tables."""

from __future__ import annotations

from ..operators.autoclean import autoclean
from ..operators.profile import profile_columns
from ..operators.quality import evaluate_quality, summarize_checks
from ..operators.scorecard import scorecard
from .base import query, table
from .rules import DATE_TEXT, DATE_TEXT_SQL, EMAIL_SQL, GAPPY_SQL, gappy

# -- pass/fail report --------------------------------------------------------------------------------------

PEOPLE = [
    "c_custkey % 1400 as id",
    "case when c_custkey % 20 = 0 then replace(c_name, '#', '@@') when c_custkey % 20 = 7 then null "
    "else lower(replace(c_name, '#', '.')) || '@mail.example.com' end as email",
    "case when c_custkey % 33 = 0 then null when c_custkey % 50 = 1 then -5 when c_custkey % 77 = 2 then 999 "
    "else 18 + c_custkey % 60 end as age",
    "case when c_custkey % 4 = 0 then null else c_mktsegment end as segment",
    "c_nationkey as nation",
]
PEOPLE_SQL = f"(select {', '.join(PEOPLE)} from customer)"
PEOPLE_CONFIG = {
    "max_null_ratio": 0.05,
    "max_duplicate_ratio": 0.05,
    "min_records": 10,
    "required_columns": ["email", "nation", "phone"],
    "unique_keys": ["id", ["id", "nation"], ["no_such_column"]],
    "range_checks": [{"column": "age", "min": 0, "max": 120}, {"column": "nation", "min": 0}],
    "regex_checks": [
        {"column": "email", "pattern": r"^[\w.+-]+@[\w-]+\.[\w.]+$"},
        {"column": "segment", "pattern": "[A-Z]+"},
    ],
    "expected_columns": ["id", "email", "phone"],
}
NULL_RATIO_SQL = f"""(select (avg(case when id is null then 1.0 else 0.0 end)
    + avg(case when email is null then 1.0 else 0.0 end) + avg(case when age is null then 1.0 else 0.0 end)
    + avg(case when segment is null then 1.0 else 0.0 end) + avg(case when nation is null then 1.0 else 0.0 end)) / 5
    as x from {PEOPLE_SQL})"""


def _count_check(name: str, category: str, counted: str) -> str:
    return (
        f"select '{name}' as name, '{category}' as category, x = 0 as passed, cast(x as double) as actual_value, "
        f"cast(0 as double) as threshold from (select {counted} as x from {PEOPLE_SQL})"
    )


CHECKS_SQL = "\nunion all\n".join(
    [
        f"""select 'overall_null_ratio' as name, 'completeness' as category, x <= 0.05 as passed,
            round(cast(x as double), 4) as actual_value, cast(0.05 as double) as threshold from {NULL_RATIO_SQL}""",
        f"""select 'required_column_not_null_email', 'completeness', x = 0, round(cast(x as double), 4), cast(0 as double)
            from (select avg(case when email is null then 1.0 else 0.0 end) as x from {PEOPLE_SQL})""",
        f"""select 'required_column_not_null_nation', 'completeness', x = 0, round(cast(x as double), 4), cast(0 as double)
            from (select avg(case when nation is null then 1.0 else 0.0 end) as x from {PEOPLE_SQL})""",
        "select 'required_column_exists_phone', 'completeness', false, null, null",
        f"""select 'duplicate_row_ratio', 'uniqueness', x <= 0.05, round(cast(x as double), 4), cast(0.05 as double)
            from (select sum(c - 1) * 1.0 / sum(c) as x from
                  (select count(*) as c from {PEOPLE_SQL} group by id, email, age, segment, nation))""",
        _count_check("unique_key_id", "uniqueness", "count(*) - count(distinct id)"),
        _count_check("unique_key_id_nation", "uniqueness", "count(*) - count(distinct (id, nation))"),
        _count_check("range_check_age", "validity", "count(*) filter (where age < 0 or age > 120)"),
        _count_check("range_check_nation", "validity", "count(*) filter (where nation < 0)"),
        _count_check("regex_check_email", "validity", f"count(*) filter (where not regexp_matches(email, {EMAIL_SQL}))"),
        _count_check("regex_check_segment", "validity", "count(*) filter (where not regexp_matches(segment, '^[A-Z]+'))"),
        f"""select 'minimum_record_count', 'consistency', x >= 10, cast(x as double), cast(10 as double)
            from (select count(*) as x from {PEOPLE_SQL})""",
        "select 'expected_schema_columns', 'consistency', false, null, null",
    ]
)


def people_checks(spark, d):
    people = table(spark, d, "customer").selectExpr(*PEOPLE)
    return evaluate_quality(people, PEOPLE_CONFIG, "people").checks


@query("quality_checks", CHECKS_SQL)
def _(spark, d):
    return people_checks(spark, d).select("name", "category", "passed", "actual_value", "threshold")


@query(
    "quality_composite",
    f"""with checks as ({CHECKS_SQL}),
        rates as (select category, avg(case when passed then 1.0 else 0.0 end) as rate,
                    case category when 'completeness' then 0.35 when 'uniqueness' then 0.25
                         when 'validity' then 0.25 else 0.15 end as weight from checks group by category)
        select (select round(cast(sum(rate * weight) / sum(weight) as double), 4) from rates) as composite_score,
               count(*) filter (where passed) as passed_checks, count(*) filter (where not passed) as failed_checks,
               round(cast(count(*) filter (where passed) as double) / count(*), 4) as pass_rate,
               cast(max(actual_value) filter (where name = 'minimum_record_count') as bigint) as total_records
        from checks""",
)
def _(spark, d):
    return summarize_checks(people_checks(spark, d))


@query(
    "quality_unique_key",
    """select 'unique_key_l_orderkey_l_linenumber' as name, x = 0 as passed, cast(x as double) as actual_value
       from (select count(*) - count(distinct (l_orderkey, l_linenumber)) as x from lineitem)""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    checks = evaluate_quality(lines, {"unique_keys": [["l_orderkey", "l_linenumber"]]}).checks
    return checks.filter("name like 'unique_key%'").select("name", "passed", "actual_value")


@query(
    "quality_range",
    """select 'range_check_l_quantity' as name, x = 0 as passed, cast(x as double) as actual_value
       from (select count(*) filter (where l_quantity < 5 or l_quantity > 45) as x from lineitem)
       union all
       select 'range_check_l_discount', x = 0, cast(x as double)
       from (select count(*) filter (where l_discount > 0.09) as x from lineitem)""",
)
def _(spark, d):
    config = {"range_checks": [{"column": "l_quantity", "min": 5, "max": 45}, {"column": "l_discount", "max": 0.09}]}
    checks = evaluate_quality(table(spark, d, "lineitem"), config).checks
    return checks.filter("name like 'range%'").select("name", "passed", "actual_value")


@query(
    "quality_regex",
    r"""select 'regex_check_p_brand' as name, x = 0 as passed, cast(x as double) as actual_value
        from (select count(*) filter (where not regexp_matches(p_brand, '^(Brand#1\d*$)')) as x from part)""",
)
def _(spark, d):
    config = {"regex_checks": [{"column": "p_brand", "pattern": r"Brand#1\d*$"}]}
    checks = evaluate_quality(table(spark, d, "part"), config).checks
    return checks.filter("name like 'regex%'").select("name", "passed", "actual_value")


# -- scorecard ---------------------------------------------------------------------------------------------


def _dimension(df, name, **options):
    return scorecard(df, dimensions=[name], **options).rows.select("dimension", "score", "weight")


@query(
    "score_completeness",
    f"""select 'completeness' as dimension, round((1 - (
            avg(case when qty is null then 1.0 else 0.0 end) + avg(case when flag is null then 1.0 else 0.0 end)
            + avg(case when line is null then 1.0 else 0.0 end)) / 6) * 100, 1) as score,
            cast(0.3 as double) as weight
        from {GAPPY_SQL}""",
)
def _(spark, d):
    return _dimension(gappy(spark, d), "completeness")


@query(
    "score_uniqueness",
    """select 'uniqueness' as dimension, round((1 - cast(sum(n - 1) as double) / sum(n)) * 100, 1) as score,
              cast(0.2 as double) as weight
       from (select count(*) as n from documents group by text, lang, source)""",
)
def _(spark, d):
    return _dimension(table(spark, d, "documents").select("text", "lang", "source"), "uniqueness")


VALIDITY_SQL = """select 'validity' as dimension, round(avg(s), 1) as score, cast(0.2 as double) as weight from (
    select round((1 - avg(case when value < q[1] - 3 * (q[2] - q[1]) or value > q[2] + 3 * (q[2] - q[1])
                 then 1.0 else 0.0 end)) * 100, 1) as s
    from events, (select quantile_cont(value, [0.25, 0.75]) as q from events)
    union all select 100.0 union all select 100.0
    union all select round((1 - avg(case when length(event_type) > 500 then 1.0 else 0.0 end)) * 100, 1) from events
    union all select round((1 - avg(case when length(props) > 500 then 1.0 else 0.0 end)) * 100, 1) from events
    union all select 100.0)"""


@query("score_validity", VALIDITY_SQL)
def _(spark, d):
    return _dimension(table(spark, d, "events"), "validity")


@query(
    "score_validity_text",
    """select 'validity' as dimension,
              round(avg(s), 1) as score, cast(0.2 as double) as weight from (
           select round((1 - avg(case when length(text) > 500 then 1.0 else 0.0 end)) * 100, 1) as s from documents
           union all select 100.0 union all select 100.0)""",
)
def _(spark, d):
    return _dimension(table(spark, d, "documents").select("text", "lang", "source"), "validity")


MIXED = [
    "c_custkey",
    "case when c_custkey % 3 = 0 then cast(c_nationkey as varchar(10)) else c_name end as code",
    "case when c_custkey % 5 = 0 then lower(c_mktsegment) else c_mktsegment end as segment",
    "c_name as label",
]


@query(
    "score_consistency",
    f"""select 'consistency' as dimension, round(avg(s), 1) as score, cast(0.15 as double) as weight from (
            select case when avg(case when regexp_full_match(code, '[0-9]+') then 1.0 else 0.0 end)
                   between 0.1000001 and 0.8999999 then 50.0 else 100.0 end as s from m
            union all select 100.0 union all select 100.0
            union all select 70.0 from (select count(distinct segment) as a, count(distinct lower(segment)) as b from m)
                where a < 20 and b < a)""".replace(" from m", f" from (select {', '.join(MIXED)} from customer)"),
)
def _(spark, d):
    return _dimension(table(spark, d, "customer").selectExpr(*MIXED), "consistency")


DATED = [*DATE_TEXT, "o_orderdate as placed_at", "case when o_orderkey % 10 = 0 then null else o_orderstatus end as o_status"]


@query(
    "score_timeliness",
    f"""select 'timeliness' as dimension, round(avg(s), 1) as score, cast(0.15 as double) as weight from (
            select 100.0 as s
            union all select case when r < 0.8 then r * 100 else 100 end from (
                select avg(case when try_cast(o_status as timestamp) is not null then 1.0 else 0.0 end) as r
                from (select case when o_orderkey % 10 = 0 then null else o_orderstatus end as o_status from orders))
            union all select case when r < 0.8 then r * 100 else 100 end from (
                select avg(case when try_strptime(t, '%Y-%m-%d') is not null
                             or try_strptime(t, '%Y-%m-%d %H:%M:%S') is not null then 1.0 else 0.0 end) as r
                from {DATE_TEXT_SQL}))""",
)
def _(spark, d):
    dated = table(spark, d, "orders").selectExpr(*DATED)
    return _dimension(dated.withColumnRenamed("t", "order_date"), "timeliness")


@query(
    "score_timeliness_all",
    """select 'timeliness' as dimension, round(avg(case when r < 0.8 then r * 100 else 100 end), 1) as score,
              cast(0.15 as double) as weight from (
           select cast(count(a) as double) / count(*) as r from d union all select cast(count(b) as double) / count(*) from d
           union all select cast(count(c) as double) / count(*) from d union all select cast(count(e) as double) / count(*) from d)
       """.replace(" from d", """ from (select o_orderdate as a, case when o_orderkey % 2 = 0 then o_orderdate end as b,
           case when o_orderkey % 5 = 0 then o_orderdate end as c, cast(o_orderdate as date) as e from orders)"""),
)
def _(spark, d):
    dated = table(spark, d, "orders").selectExpr(
        "o_orderdate as created", "case when o_orderkey % 2 = 0 then o_orderdate end as updated",
        "case when o_orderkey % 5 = 0 then o_orderdate end as seen_at", "cast(o_orderdate as date) as day",
    )
    return _dimension(dated, "timeliness")


@query(
    "scorecard",
    f"""with e as (select count(*) as n, count(event_id) as a, count(ts) as b, count(user_id) as c, count(event_type) as f,
                   count(value) as g, count(props) as h,
                   count(*) filter (where try_cast(event_type as double) is not null) as x1,
                   count(*) filter (where try_cast(props as double) is not null) as x2 from events),
        parts as (
            select round((a + b + c + f + g + h) / cast(6 * n as double) * 100, 1) as s, 0.3 as w from e
            union all select round((1 - sum(k - 1) / cast(sum(k) as double)) * 100, 1), 0.2
                from (select count(*) as k from events group by event_id, ts, user_id, event_type, value, props)
            union all select score, 0.2 from ({{VALIDITY_SQL}})
            union all select round(avg(case when r > 0.1 and r < 0.9 then 50.0 else 100.0 end), 1), 0.15
                from (select x1 / cast(f as double) as r from e union all select x2 / cast(h as double) from e)
            union all select round(avg(case when r < 0.8 then r * 100 else 100 end), 1), 0.15
                from (select b / cast(n as double) as r from e))
        select 'events' as name, (select count(*) from events) as records, 6 as columns, x as score,
               case when x >= 90 then 'A' when x >= 75 then 'B' when x >= 60 then 'C' when x >= 40 then 'D' else 'F' end as grade
        from (select round(cast(sum(s * w) / sum(w) as double), 1) as x from parts)""".replace("{VALIDITY_SQL}", VALIDITY_SQL),
)
def _(spark, d):
    card = scorecard(table(spark, d, "events"), "events", date_columns=["ts"])
    return card.total().select("name", "records", "columns", "score", "grade")


# -- profile and automatic cleaning ------------------------------------------------------------------------


def _profile_sql(source: str, columns: list[tuple[str, str, bool]]) -> str:
    parts = []
    for i, (c, dtype, numeric) in enumerate(columns):
        stats = (
            f"cast(min({c}) as double) as min_val, cast(max({c}) as double) as max_val, round(avg({c}), 4) as mean_val"
            if numeric
            else "cast(null as double) as min_val, cast(null as double) as max_val, cast(null as double) as mean_val"
        )
        parts.append(
            f"select {i} as position, '{c}' as name, '{dtype}' as dtype, count(*) - count({c}) as null_count, "
            f"count(distinct {c}) as unique_count, count(*) as n, {stats} from {source}"
        )
    return f"""select position, name, dtype, null_count, null_pct, unique_count, unique_pct, min_val, max_val, mean_val,
            case when null_pct >= 0.8 then 'drop (too many nulls)'
                 when unique_pct >= 0.99 and null_pct = 0 then 'possible ID column'
                 when unique_count = 1 then 'constant — consider dropping' else 'keep' end as suggested_action
        from (select *, round(null_count / cast(n as double), 4) as null_pct,
                     round(unique_count / cast(n as double), 4) as unique_pct from ({' union all '.join(parts)}))"""


PROFILED = [
    "event_id",
    "ts",
    "event_type",
    "case when event_id % 10 <> 0 then null else value end as rare",
    "'fixed' as fixed",
    "value",
]


@query(
    "profile_columns",
    _profile_sql(
        f"(select {', '.join(PROFILED)} from events)",
        [("event_id", "bigint", True), ("ts", "timestamp_ntz", False), ("event_type", "string", False),
         ("rare", "double", True), ("fixed", "string", False), ("value", "double", True)],
    ),
)
def _(spark, d):
    return profile_columns(table(spark, d, "events").selectExpr(*PROFILED), samples=False)


@query(
    "profile_samples",
    """select 'event_id' as name, string_agg(cast(event_id as varchar), '|' order by ts, event_id) as samples
       from (select event_id, ts from events order by ts, event_id limit 3)
       union all select 'event_type', string_agg(event_type, '|' order by ts, event_id)
       from (select event_type, ts, event_id from events order by ts, event_id limit 3)""",
)
def _(spark, d):
    profile = profile_columns(table(spark, d, "events").select("event_id", "event_type", "ts"), order_by=["ts", "event_id"])
    return profile.filter("name <> 'ts'").selectExpr("name", "concat_ws('|', sample_values) as samples")


RAW_CUSTOMERS = {
    "Cust Group": "c_custkey % 700",
    "Acct.Bal": "case when c_custkey % 700 < 100 then null else cast(c_custkey % 700 as double) / 4 end",
    " Segment": "case c_custkey % 7 when 0 then '  ' when 1 then 'None' when 2 then 'seg a ' else ' seg a' end",
    "phone": "case when c_custkey % 700 % 25 = 3 then 'none' else cast(100 + c_custkey % 700 as varchar(10)) end",
    "Notes": "case when c_custkey % 700 < 10 then 'note' else null end",
}
CLEAN_NAMES = ["cust_group", "acct_bal", "segment", "phone", "notes"]
RAW_SQL = f"(select {', '.join(f'{e} as {n}' for e, n in zip(RAW_CUSTOMERS.values(), CLEAN_NAMES))} from customer)"
STRIPPED_SQL = f"""(select distinct cust_group, acct_bal, case when trim(segment) in ('nan', 'None', '') then null
    else trim(segment) end as segment, phone from {RAW_SQL})"""


def raw_customers(spark, d):
    return table(spark, d, "customer").selectExpr(*[f"{e} as `{n}`" for n, e in RAW_CUSTOMERS.items()])


@query(
    "autoclean",
    f"""select cust_group, coalesce(acct_bal, (select round(quantile_cont(acct_bal, 0.5), 4) from {STRIPPED_SQL})) as acct_bal,
               coalesce(segment, 'UNKNOWN') as segment, try_cast(phone as double) as phone
        from {STRIPPED_SQL}""",
)
def _(spark, d):
    return autoclean(raw_customers(spark, d))[0]


@query(
    "autoclean_report",
    f"""select 'customers' as name, a.n as rows_in, b.n as rows_out, 5 as columns_in, 4 as columns_out,
               a.n - b.n as repeated_rows, b.gaps as filled_cells, 1 as dropped_columns
        from (select count(*) as n from {RAW_SQL}) a,
             (select count(*) as n, 2 * count(*) - count(acct_bal) - count(segment) as gaps from {STRIPPED_SQL}) b""",
)
def _(spark, d):
    return autoclean(raw_customers(spark, d), "customers")[1].summary()


@query(
    "autocast_numeric",
    f"select count(*) as n, sum(try_cast(phone as double)) as total from {STRIPPED_SQL}",
)
def _(spark, d):
    cleaned, _ = autoclean(raw_customers(spark, d), fill_numeric="mean")
    return cleaned.selectExpr("count(*) as n", "sum(phone) as total")
