"""Transformation rules over whole tables.

The given tables hold no nulls, so both sides derive gaps and dirt from the same SQL expressions.
"""

from __future__ import annotations

from ..operators.aggregate import aggregate_daily
from ..operators.casts import cast_types
from ..operators.dedup import remove_duplicates
from ..operators.fill import fill_missing
from ..operators.rules import apply_rules
from ..operators.shape import add_audit_columns, filter_rows, rename_columns, select_columns
from ..operators.text import normalize_text, validate_email
from .base import query, table

LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
GAPPY = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "case when l_orderkey % 10 = 0 then null else l_quantity end as qty",
    "case when l_partkey % 7 = 0 then null else l_returnflag end as flag",
    "nullif(l_linenumber, 3) as line",
]
GAPPY_SQL = f"(select {', '.join(GAPPY)} from lineitem)"
GAPPY_EVENTS = [
    "event_id",
    "user_id",
    "ts",
    "case when event_id % 3 <> 0 then null else value end as reading",
    "case when event_id % 4 = 1 then event_type else null end as kind",
]
GAPPY_EVENTS_SQL = f"(select {', '.join(GAPPY_EVENTS)} from events)"
CONTACT = [
    "c_custkey",
    "case when c_custkey % 20 = 0 then replace(c_name, '#', '@@') "
    "when c_custkey % 20 = 7 then null "
    "else lower(replace(c_name, '#', '.')) || '@mail-host.example.com' end as email",
]
CONTACT_SQL = f"(select {', '.join(CONTACT)} from customer)"
EMAIL_SQL = r"'^[\w.+-]+@[\w-]+\.[\w.]+$'"


def gappy(spark, d):
    return table(spark, d, "lineitem").selectExpr(*GAPPY)


def gappy_events(spark, d):
    return table(spark, d, "events").selectExpr(*GAPPY_EVENTS)


# -- duplicates --------------------------------------------------------------------------------------------


@query("dedup_full", f"select distinct {LINE_COLUMNS} from (select * from lineitem union all select * from lineitem)")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    return remove_duplicates(lines.unionByName(lines), {})


@query("dedup_text", "select distinct text, lang, source from documents")
def _(spark, d):
    return remove_duplicates(table(spark, d, "documents").select("text", "lang", "source"), {})


RANKED = """select {cols} from (
    select *, row_number() over (partition by l_orderkey order by {order}) as rn from lineitem) where rn = 1"""
FIRST_ORDER = (
    "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus"
)


@query("dedup_subset_first", RANKED.format(cols=LINE_COLUMNS, order=FIRST_ORDER))
def _(spark, d):
    config = {"subset": ["l_orderkey"], "keep": "first", "order_by": ["l_shipdate", "l_linenumber"]}
    return remove_duplicates(table(spark, d, "lineitem"), config)


@query(
    "dedup_subset_last",
    RANKED.format(cols=LINE_COLUMNS, order=FIRST_ORDER.replace(",", " desc,") + " desc"),
)
def _(spark, d):
    config = {"subset": "l_orderkey", "keep": "last", "order_by": ["l_shipdate", "l_linenumber"]}
    return remove_duplicates(table(spark, d, "lineitem"), config)


@query(
    "dedup_keep_none",
    f"""select {LINE_COLUMNS} from (
        select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n = 1""",
)
def _(spark, d):
    return remove_duplicates(
        table(spark, d, "lineitem"), {"subset": ["l_orderkey", "l_linenumber"], "keep": False}
    )


# -- missing values ----------------------------------------------------------------------------------------


@query(
    "fill_constant",
    f"""select l_orderkey, l_linenumber, l_partkey, coalesce(qty, 0) as qty, flag, coalesce(line, 0) as line
        from {GAPPY_SQL}""",
)
def _(spark, d):
    return fill_missing(gappy(spark, d), {"columns": ["qty", "line"], "fill_value": 0})


@query(
    "fill_constant_text",
    f"select l_orderkey, l_linenumber, l_partkey, qty, coalesce(flag, 'UNKNOWN') as flag, line from {GAPPY_SQL}",
)
def _(spark, d):
    return fill_missing(gappy(spark, d), {"columns": ["flag"]})


@query(
    "fill_mean",
    f"""select l_orderkey, l_linenumber, l_partkey,
            round(coalesce(qty, (select avg(qty) from {GAPPY_SQL})), 4) as qty,
            coalesce(flag, 'UNKNOWN') as flag,
            round(coalesce(line, (select avg(line) from {GAPPY_SQL})), 4) as line
        from {GAPPY_SQL}""",
)
def _(spark, d):
    out = fill_missing(gappy(spark, d), {"columns": ["qty", "flag", "line"], "strategy": "mean"})
    return out.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "round(qty, 4) as qty", "flag", "round(line, 4) as line"
    )


@query(
    "fill_median",
    f"""select l_orderkey, l_linenumber, l_partkey,
            coalesce(qty, (select quantile_cont(qty, 0.5) from {GAPPY_SQL})) as qty, flag,
            coalesce(cast(line as double), (select quantile_cont(cast(line as double), 0.5) from {GAPPY_SQL})) as line
        from {GAPPY_SQL}""",
)
def _(spark, d):
    return fill_missing(gappy(spark, d), {"columns": ["qty", "line"], "strategy": "median"})


def _mode_sql(c: str) -> str:
    return (
        f"(select {c} from {GAPPY_SQL} where {c} is not null group by {c} "
        f"order by count(*) desc, {c} limit 1)"
    )


@query(
    "fill_mode",
    f"""select l_orderkey, l_linenumber, l_partkey, coalesce(qty, {_mode_sql('qty')}) as qty,
            coalesce(flag, {_mode_sql('flag')}) as flag, coalesce(line, {_mode_sql('line')}) as line
        from {GAPPY_SQL}""",
)
def _(spark, d):
    return fill_missing(gappy(spark, d), {"columns": ["qty", "flag", "line"], "strategy": "mode"})


def _carry_sql(partition: str, back: bool) -> str:
    order = "ts desc, event_id desc" if back else "ts, event_id"
    over = f"over ({partition} order by {order} rows between unbounded preceding and current row)"
    return f"""select event_id, user_id, ts, last_value(reading ignore nulls) {over} as reading,
        last_value(kind ignore nulls) {over} as kind from {GAPPY_EVENTS_SQL}"""


CARRY = {"columns": ["reading", "kind"], "order_by": ["ts", "event_id"], "rows_per_block": 1500}


@query("fill_ffill", _carry_sql("", False))
def _(spark, d):
    return fill_missing(gappy_events(spark, d), {**CARRY, "strategy": "ffill"})


@query("fill_bfill", _carry_sql("", True))
def _(spark, d):
    return fill_missing(gappy_events(spark, d), {**CARRY, "strategy": "bfill"})


@query("fill_ffill_by_key", _carry_sql("partition by user_id", False))
def _(spark, d):
    return fill_missing(gappy_events(spark, d), {**CARRY, "strategy": "ffill", "partition_by": ["user_id"]})


@query("fill_bfill_by_key", _carry_sql("partition by user_id", True))
def _(spark, d):
    return fill_missing(gappy_events(spark, d), {**CARRY, "strategy": "bfill", "partition_by": ["user_id"]})


@query("fill_drop", f"select * from {GAPPY_SQL} where qty is not null and flag is not null")
def _(spark, d):
    return fill_missing(gappy(spark, d), {"columns": ["qty", "flag"], "strategy": "drop"})


@query(
    "fill_threshold",
    f"""select l_orderkey, l_linenumber, l_partkey, coalesce(qty, -1) as qty, flag, coalesce(line, -1) as line
        from {GAPPY_SQL}
        where (case when qty is null then 1 else 0 end + case when line is null then 1 else 0 end) / 2.0 <= 0.5""",
)
def _(spark, d):
    return fill_missing(gappy(spark, d), {"columns": ["qty", "line"], "fill_value": -1, "threshold": 0.5})


# -- text --------------------------------------------------------------------------------------------------

SPACED = ["doc_id", "chr(9) || '  ' || replace(text, ' ', '   ') || ' ' || chr(10) as text", "upper(lang) as lang",
          "case when doc_id % 9 = 0 then ' NaN ' else source end as source"]


@query(
    "normalize_text",
    f"""select doc_id, nullif(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'nan') as text,
            lower(lang) as lang, nullif(lower(trim(source)), 'nan') as source
        from (select {', '.join(SPACED)} from documents)""",
)
def _(spark, d):
    return normalize_text(table(spark, d, "documents").selectExpr(*SPACED), {})


@query(
    "validate_email_nullify",
    f"""select c_custkey, case when regexp_matches(email, {EMAIL_SQL}) then email end as email
        from {CONTACT_SQL}""",
)
def _(spark, d):
    return validate_email(table(spark, d, "customer").selectExpr(*CONTACT), {})


@query(
    "validate_email_drop",
    f"select c_custkey, email from {CONTACT_SQL} where email is null or regexp_matches(email, {EMAIL_SQL})",
)
def _(spark, d):
    return validate_email(table(spark, d, "customer").selectExpr(*CONTACT), {"action": "drop"})


# -- casts -------------------------------------------------------------------------------------------------

NUMBER_TEXT = [
    "l_orderkey",
    "l_linenumber",
    "case l_linenumber % 7 when 0 then ' ' || cast(l_partkey as varchar(20)) || ' ' when 1 then 'n/a' "
    "when 2 then cast(l_partkey as varchar(20)) || '.5' when 3 then cast(l_partkey as varchar(20)) || 'd' "
    "when 4 then cast(l_partkey as varchar(20)) || 'e1' when 5 then null "
    "else '-' || cast(l_partkey as varchar(20)) end as n",
]
NUMBER_TEXT_SQL = f"(select {', '.join(NUMBER_TEXT)} from lineitem)"
IS_NUMBER = "regexp_full_match(trim(n), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"


@query(
    "cast_int",
    f"""select l_orderkey, l_linenumber,
            case when x = floor(x) then cast(x as bigint) end as n
        from (select *, case when {IS_NUMBER} then cast(trim(n) as double) end as x from {NUMBER_TEXT_SQL})""",
)
def _(spark, d):
    return cast_types(table(spark, d, "lineitem").selectExpr(*NUMBER_TEXT), {"mappings": {"n": "int"}})


@query(
    "cast_float",
    f"""select l_orderkey, l_linenumber, case when {IS_NUMBER} then cast(trim(n) as double) end as n
        from {NUMBER_TEXT_SQL}""",
)
def _(spark, d):
    return cast_types(table(spark, d, "lineitem").selectExpr(*NUMBER_TEXT), {"mappings": {"n": "float"}})


DATE_PARTS = (
    "lpad(cast(month(o_orderdate) as varchar(2)), 2, '0')",
    "lpad(cast(day(o_orderdate) as varchar(2)), 2, '0')",
    "cast(year(o_orderdate) as varchar(4))",
)
DATE_TEXT = [
    "o_orderkey",
    "case o_orderkey % 4 when 0 then {2} || '-' || {0} || '-' || {1} when 1 then {1} || '/' || {0} || '/' || {2} "
    "when 2 then 'not-a-date' else {2} || '-' || {0} || '-' || {1} || ' 10:20:30' end as t".format(*DATE_PARTS),
]
DATE_TEXT_SQL = f"(select {', '.join(DATE_TEXT)} from orders)"


@query(
    "cast_datetime",
    f"""select o_orderkey, coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y-%m-%d %H:%M:%S'),
            try_strptime(t, '%d/%m/%Y')) as t
        from {DATE_TEXT_SQL}""",
)
def _(spark, d):
    formats = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy"]
    dated = table(spark, d, "orders").selectExpr(*DATE_TEXT)
    return cast_types(dated, {"mappings": {"t": "datetime"}, "formats": formats})


WRITTEN_DATES = [
    "o_orderkey", "date_format(o_orderdate, 'd/M/yyyy') as day_first", "date_format(o_orderdate, 'MM-dd-yyyy') as month_first",
    "case o_orderkey % 3 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'd MMM yyyy') "
    "else 'soon' end as mixed",
]


@query(
    "cast_datetime_inferred",
    """select o_orderkey, cast(cast(o_orderdate as date) as timestamp) as day_first,
            cast(cast(o_orderdate as date) as timestamp) as month_first,
            case when o_orderkey % 3 < 2 then cast(cast(o_orderdate as date) as timestamp) end as mixed
        from orders""",
)
def _(spark, d):
    """Formats found from the values: day first, month first, several in one column."""
    written = table(spark, d, "orders").selectExpr(*WRITTEN_DATES)
    return cast_types(written, {"mappings": {c: "datetime" for c in ("day_first", "month_first", "mixed")}})


BOOL_TEXT = [
    "o_orderkey",
    "case o_orderkey % 6 when 0 then 'True' when 1 then '0' when 2 then ' no ' when 3 then 'maybe' when 4 then '' "
    "else null end as b",
    "o_orderkey % 3 as m",
]
BOOL_TEXT_SQL = f"(select {', '.join(BOOL_TEXT)} from orders)"


@query(
    "cast_bool",
    f"""select o_orderkey, case when lower(trim(b)) in ('true', 't', 'yes', 'y', '1') then true
            when lower(trim(b)) in ('false', 'f', 'no', 'n', '0') then false end as b, m <> 0 as m
        from {BOOL_TEXT_SQL}""",
)
def _(spark, d):
    return cast_types(table(spark, d, "orders").selectExpr(*BOOL_TEXT), {"mappings": {"b": "bool", "m": "bool"}})


@query(
    "cast_bool_truthy",
    f"select o_orderkey, coalesce(b <> '', false) as b, m <> 0 as m from {BOOL_TEXT_SQL}",
)
def _(spark, d):
    config = {"mappings": {"b": "bool", "m": "bool"}, "truthy": True}
    return cast_types(table(spark, d, "orders").selectExpr(*BOOL_TEXT), config)


@query(
    "cast_other",
    """select l_orderkey, cast(l_linenumber as varchar) as l_linenumber, cast(l_quantity as decimal(12, 2)) as l_quantity,
            cast(l_partkey as integer) as l_partkey, cast(l_shipdate as date) as l_shipdate from lineitem""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_shipdate")
    mappings = {"l_linenumber": "str", "l_quantity": "decimal(12,2)", "l_partkey": "int32", "l_shipdate": "DATE",
                "no_such_column": "int"}
    return cast_types(lines, {"mappings": mappings})


# -- shape -------------------------------------------------------------------------------------------------


@query(
    "rename_select",
    "select l_shipdate as shipped, l_orderkey as order_id, l_quantity from lineitem",
)
def _(spark, d):
    renamed = rename_columns(
        table(spark, d, "lineitem"),
        {"mapping": {"l_orderkey": "order_id", "l_shipdate": "shipped", "missing": "x"}},
    )
    return select_columns(renamed, {"columns": ["shipped", "order_id", "not_there", "l_quantity"]})


@query(
    "filter_expr",
    """select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem
       where l_quantity > 25 and l_returnflag = 'R' and l_linenumber in (1, 2, 3) and not (l_discount > 0.05)""",
)
def _(spark, d):
    expression = (
        "l_quantity > 25 and l_returnflag == 'R' and l_linenumber in (1, 2, 3) and not (l_discount > 0.05)"
    )
    rows = filter_rows(table(spark, d, "lineitem"), {"expression": expression})
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("filter_keep_unknown", f"select * from {GAPPY_SQL} where coalesce(flag <> 'A', true)")
def _(spark, d):
    return filter_rows(gappy(spark, d), {"expression": "flag != 'A'", "null_result": "keep"})


@query(
    "audit_columns",
    """select n_nationkey, n_name, 'nations' as _etl_pipeline, 'run-1' as _etl_run_id,
              timestamp '2024-01-31 00:00:00' as _etl_loaded_at from nation""",
)
def _(spark, d):
    config = {"pipeline_name": "nations", "run_id": "run-1", "loaded_at": "2024-01-31T00:00:00"}
    return add_audit_columns(table(spark, d, "nation").select("n_nationkey", "n_name"), config)


# -- aggregation -------------------------------------------------------------------------------------------


@query(
    "aggregate_daily_sum",
    """select l_shipdate, l_returnflag, round(sum(l_quantity), 2) as l_quantity,
              round(sum(l_extendedprice), 2) as l_extendedprice
       from lineitem group by l_shipdate, l_returnflag""",
)
def _(spark, d):
    config = {
        "date_column": "l_shipdate",
        "group_by": ["l_shipdate", "l_returnflag"],
        "agg_config": {"l_quantity": "sum", "l_extendedprice": "sum"},
    }
    return aggregate_daily(table(spark, d, "lineitem"), config).selectExpr(
        "l_shipdate", "l_returnflag", "round(l_quantity, 2) as l_quantity",
        "round(l_extendedprice, 2) as l_extendedprice",
    )


@query(
    "aggregate_daily_mixed",
    f"""select flag, count(qty) as qty, count(distinct l_partkey) as l_partkey, min(l_linenumber) as l_linenumber,
               max(l_orderkey) as l_orderkey, round(avg(line), 4) as line
        from {GAPPY_SQL} where flag is not null group by flag""",
)
def _(spark, d):
    config = {
        "group_by": "flag",
        "agg_config": {"qty": "count", "l_partkey": "nunique", "l_linenumber": "min", "l_orderkey": "max",
                       "line": "mean"},
    }
    return aggregate_daily(gappy(spark, d), config).selectExpr(
        "flag", "qty", "l_partkey", "l_linenumber", "l_orderkey", "round(line, 4) as line"
    )


@query(
    "aggregate_daily_spread",
    """select l_returnflag, quantile_cont(l_quantity, 0.5) as l_quantity, round(stddev_samp(l_tax), 6) as l_tax,
              round(var_samp(l_discount), 6) as l_discount, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)) as l_partkey,
              arg_max(l_suppkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) as l_suppkey
       from lineitem group by l_returnflag""",
)
def _(spark, d):
    config = {
        "group_by": ["l_returnflag"],
        "agg_config": {"l_quantity": "median", "l_tax": "std", "l_discount": "var", "l_partkey": "first",
                       "l_suppkey": "last"},
        "order_by": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    }
    return aggregate_daily(table(spark, d, "lineitem"), config).selectExpr(
        "l_returnflag", "l_quantity", "round(l_tax, 6) as l_tax", "round(l_discount, 6) as l_discount",
        "l_partkey", "l_suppkey",
    )


@query(
    "aggregate_daily_default",
    """select date_trunc('day', ts) as ts, event_type, cast(sum(event_id) as bigint) as event_id,
              cast(sum(user_id) as bigint) as user_id, round(sum(value), 2) as value
       from events group by 1, 2""",
)
def _(spark, d):
    config = {"date_column": "ts", "group_by": ["ts", "event_type"], "truncate": "day"}
    return aggregate_daily(table(spark, d, "events"), config).selectExpr(
        "ts", "event_type", "event_id", "user_id", "round(value, 2) as value"
    )


# -- a rule chain ------------------------------------------------------------------------------------------

SALES_RULES = [
    {"name": "remove_duplicates", "config": {"subset": ["l_orderkey", "l_linenumber"],
                                             "order_by": ["l_shipdate", "l_partkey"]}},
    {"name": "fill_missing", "config": {"fill_value": 0, "columns": ["l_discount", "l_tax"]}},
    {"name": "cast_types", "config": {"mappings": {"l_extendedprice": "float", "l_quantity": "int"}}},
    {"name": "filter_rows", "config": {"expression": "l_quantity > 0"}},
    {"name": "aggregate_daily", "config": {
        "date_column": "l_shipdate", "group_by": ["l_shipdate", "l_returnflag", "l_linestatus"],
        "agg_config": {"l_extendedprice": "sum", "l_quantity": "sum", "l_orderkey": "count"}}},
    {"name": "add_audit_columns", "config": {"loaded_at": "2024-01-31T00:00:00"}},
    "no_such_rule",
]


@query(
    "rule_chain_sales",
    f"""select l_shipdate, l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) as l_extendedprice,
               cast(sum(cast(l_quantity as bigint)) as bigint) as l_quantity, count(l_orderkey) as l_orderkey,
               'sales' as _etl_pipeline, 'run-1' as _etl_run_id, timestamp '2024-01-31 00:00:00' as _etl_loaded_at
        from (select *, row_number() over (partition by l_orderkey, l_linenumber
                  order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                           l_returnflag, l_linestatus) as rn from lineitem)
        where rn = 1 and l_quantity > 0 group by 1, 2, 3""",
)
def _(spark, d):
    out = apply_rules(table(spark, d, "lineitem"), SALES_RULES, "sales", "run-1").data
    return out.selectExpr(
        "l_shipdate", "l_returnflag", "l_linestatus", "round(l_extendedprice, 2) as l_extendedprice",
        "l_quantity", "l_orderkey", "_etl_pipeline", "_etl_run_id", "_etl_loaded_at",
    )
