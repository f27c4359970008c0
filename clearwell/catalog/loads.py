"""Sources, incremental loads and upserts over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.merge import upsert
from ..plans.bookkeeping import Bookkeeping, mask_secrets
from ..plans.pipeline import run_pipeline
from ..session import staging_path
from ..sinks import load
from ..sinks.tables import read_table
from ..sources.files import read_file, read_upload
from ..sources.files import read_table as read_table_file
from ..sources.jdbc import read_query
from ..sources.jsondata import flatten, read_json, read_json_records, records_from_bodies
from ..sources.registry import extract
from ..sources.rest import read_api
from ..sources.textlines import numbered_lines, read_text_table, split_lines
from ..streaming.incremental import advance_checkpoints, filter_since, high_water_mark
from .base import query, table

# -- scans -------------------------------------------------------------------------------------------------


@query("source_columns", "select o_totalprice, o_orderkey, o_orderdate from orders")
def _(spark, d):
    return read_file(spark, {"path": f"{d}/orders.parquet", "columns": ["o_totalprice", "o_orderkey", "o_orderdate"]})


@query(
    "source_query_params",
    """select o_orderkey, o_totalprice from orders
       where o_totalprice > 200000 and o_orderstatus = 'F' and o_orderdate > timestamp '1997-06-30 00:00:00'""",
)
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    config = {
        "query": "select o_orderkey, o_totalprice from orders where o_totalprice > :floor and o_orderstatus = :status "
        "and (:checkpoint is null or o_orderdate > cast(:checkpoint as timestamp))",
        "params": {"floor": 200000, "status": "F"},
        "incremental": True,
    }
    return read_query(spark, config, "1997-06-30 00:00:00")


# -- incremental loads -------------------------------------------------------------------------------------


@query("checkpoint_filter", "select * from orders where o_orderdate > timestamp '1998-01-15 00:00:00'")
def _(spark, d):
    return filter_since(table(spark, d, "orders"), "o_orderdate", "1998-01-15 00:00:00")


@query("checkpoint_mark", "select cast(max(o_orderkey) as varchar) as checkpoint_value, 'bigint' as value_type from orders")
def _(spark, d):
    return high_water_mark(table(spark, d, "orders"), "o_orderkey")


STORED = [
    "'pipeline_' || cast(user_id % 40 as varchar(4)) as pipeline_name", "'source_' || event_type as source_name",
    "'watermark' as checkpoint_key",
]
OLD_MARK = [*STORED, "cast(min(event_id) as varchar(20)) as checkpoint_value", "'bigint' as value_type",
            "cast(min(ts) as timestamp) as updated_at"]
NEW_MARK = ["'pipeline_' || cast(user_id % 60 as varchar(4)) as pipeline_name", *STORED[1:],
            "cast(event_id as varchar(20)) as checkpoint_value", "'bigint' as value_type", "cast(ts as timestamp) as updated_at"]
KEYS = "pipeline_name, source_name, checkpoint_key"


@query(
    "checkpoint_advance",
    f"""with old as (select {', '.join(OLD_MARK)} from events group by user_id % 40, event_type),
             new as (select * from (select *, row_number() over (partition by {KEYS}
                         order by updated_at desc, checkpoint_value desc) as rn
                     from (select {', '.join(NEW_MARK)} from events)) where rn = 1)
        select {KEYS}, checkpoint_value, value_type, updated_at from new
        union all
        select {KEYS}, checkpoint_value, value_type, updated_at from old
        where not exists (select 1 from new where new.pipeline_name = old.pipeline_name
                          and new.source_name = old.source_name)""",
)
def _(spark, d):
    events = table(spark, d, "events")
    grouped = events.groupBy((F.col("user_id") % 40).alias("user_id"), "event_type").agg(
        F.min("event_id").cast("string").alias("checkpoint_value"), F.min("ts").cast("timestamp").alias("updated_at")
    )
    stored = grouped.selectExpr(*STORED, "checkpoint_value", "'bigint' as value_type", "updated_at")
    return advance_checkpoints(stored, events.selectExpr(*NEW_MARK))


# -- upsert ------------------------------------------------------------------------------------------------

INCOMING = [
    "case when l_linenumber = 7 then null else l_orderkey + 2000 end as o_orderkey",
    "l_partkey as o_custkey",
    "l_linestatus as o_orderstatus",
    "l_extendedprice as o_totalprice",
    "l_shipdate as o_orderdate",
    "l_returnflag as o_orderpriority",
]
INCOMING_SQL = f"(select {', '.join(INCOMING)} from lineitem)"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(
    "upsert_merge",
    f"""with incoming as (select * from (select *, row_number() over (partition by o_orderkey order by o_orderdate desc,
                 o_totalprice desc, o_custkey desc, o_orderstatus desc, o_orderpriority desc) as rn from {INCOMING_SQL})
             where rn = 1 or o_orderkey is null)
        select {ORDER_COLUMNS} from incoming
        union all select {ORDER_COLUMNS} from orders o
        where not exists (select 1 from incoming i where i.o_orderkey = o.o_orderkey)""",
)
def _(spark, d):
    incoming = table(spark, d, "lineitem").selectExpr(*INCOMING)
    return upsert(table(spark, d, "orders"), incoming, ["o_orderkey"], ["o_orderdate", "o_totalprice"])


# -- JSON and text -----------------------------------------------------------------------------------------


@query("json_flatten", "select event_id, cast(json_extract(props, '$.k') as bigint) as \"props.k\", event_type as \"meta.kind\", user_id as \"meta.user.id\" from events")
def _(spark, d):
    nested = table(spark, d, "events").selectExpr(
        "event_id", "from_json(props, 'k bigint') as props",
        "named_struct('kind', event_type, 'user', named_struct('id', user_id)) as meta",
    )
    return flatten(nested)


BODY = (
    "case event_id % 5 when 0 then '{{\"data\": [' || {p} || ', ' || {p} || '], \"next\": true}}' "
    "when 1 then '[' || {p} || ']' when 2 then '{{\"data\": []}}' when 3 then '{{\"other\": 1}}' "
    "else '{{\"data\": ' || {p} || '}}' end"
).format(p="props")


@query(
    "json_records",
    f"""select event_id, cast(json_extract(r, '$.k') as bigint) as k from (
            select event_id, unnest(case when json_type(b) = 'ARRAY' then from_json(b, '["json"]')
                when json_type(b, '$.data') = 'ARRAY' then from_json(json_extract(b, '$.data'), '["json"]') end) as r
            from (select event_id, {BODY} as b from events))""",
)
def _(spark, d):
    bodies = table(spark, d, "events").selectExpr("event_id", f"{BODY} as body")
    return records_from_bodies(bodies, "body", "struct<k: bigint>", "data")


@query(
    "text_lines",
    """select doc_id, cast(row_number() over (partition by doc_id order by pos) as integer) as line_number, text from (
           select doc_id, rtrim(line) as text, pos from (
               select doc_id, unnest(string_split(text, chr(10))) as line,
                      generate_subscripts(string_split(text, chr(10)), 1) as pos from documents))
       where text <> ''""",
)
def _(spark, d):
    return split_lines(table(spark, d, "documents"), "text", ["doc_id"])


@query(
    "mask_secrets",
    """select s_suppkey, s_name as host, '***' as password, '***' as "API_KEY", cast(s_nationkey as varchar) as port
       from supplier""",
)
def _(spark, d):
    sources = table(spark, d, "supplier").select(
        "s_suppkey",
        F.create_map(
            F.lit("host"), F.col("s_name"), F.lit("password"), F.col("s_name"), F.lit("API_KEY"), F.col("s_name"),
            F.lit("port"), F.col("s_nationkey").cast("string"),
        ).alias("connection_config"),
    )
    masked = mask_secrets(sources)
    names = ["host", "password", "API_KEY", "port"]
    return masked.select("s_suppkey", *[F.col("connection_config")[n].alias(n) for n in names])


# -- files written and read back ---------------------------------------------------------------------------


def _written(df, kind: str, **config) -> str:
    """Path of the frame written by a sink to a new folder; an error of the sink is raised."""
    path = staging_path(df.sparkSession, kind)
    result = load(df, {"type": kind, "path": path, **config})
    if not result.success:
        raise RuntimeError(result.error)
    return path


@query(
    "file_csv",
    """select o_orderkey, o_totalprice, o_orderdate, o_orderpriority,
              case when o_orderkey % 3 = 0 then 'a "quoted", text' end as note from orders""",
)
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority",
        "case when o_orderkey % 3 = 0 then 'a \"quoted\", text' end as note",
    )
    path = _written(rows, "csv")
    return extract(spark, {"type": "csv", "path": path, "date_columns": ["o_orderdate"]})


@query(
    "file_csv_headers",
    "select o_orderkey, o_orderpriority, case when o_orderkey % 2 = 0 then o_custkey end as o_custkey from orders",
)
def _(spark, d):
    """A folder of files whose columns differ in order and number."""
    path, orders = staging_path(spark, "csv"), table(spark, d, "orders")
    short = orders.filter("o_orderkey % 2 = 1").select("o_orderpriority", "o_orderkey")
    orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", "o_orderpriority").write.csv(path, header=True)
    short.write.mode("append").csv(path, header=True)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderpriority string"
    return extract(spark, {"type": "csv", "path": path, "schema": schema}).select("o_orderkey", "o_orderpriority", "o_custkey")


DAMAGED = "case when s_suppkey % 7 = 0 then {bad} else {good} end as value"


@query(
    "file_csv_rejects",
    """select false as rejected, cast(s_suppkey as varchar) || ',' || s_nationkey as line from supplier where s_suppkey % 7 <> 0
       union all select true, cast(s_suppkey as varchar) || ',too,many' from supplier where s_suppkey % 7 = 0""",
)
def _(spark, d):
    """Lines with too many fields come back as rejects, the others as rows."""
    path = staging_path(spark, "csv")
    lines = DAMAGED.format(bad="concat(s_suppkey, ',too,many')", good="concat(s_suppkey, ',', s_nationkey)")
    # one column whose name is the header line; a separator that no line holds keeps the writer from quoting
    table(spark, d, "supplier").selectExpr(lines).toDF("k,n").write.csv(path, header=True, sep="\u0001")
    read = read_table_file(spark, {"path": path})
    return read.data.selectExpr("false as rejected", "concat(k, ',', n) as line").unionAll(
        read.rejects.selectExpr("true as rejected", "line")
    )


@query(
    "file_json_rejects",
    """select false as rejected, cast(s_suppkey as varchar) as line from supplier where s_suppkey % 7 <> 0
       union all select true, '{"k": ' || s_suppkey from supplier where s_suppkey % 7 = 0""",
)
def _(spark, d):
    """Broken lines come back as rejects, the others as rows."""
    path = staging_path(spark, "json") + ".jsonl"
    lines = DAMAGED.format(bad="""concat('{"k": ', s_suppkey)""", good="""concat('{"k": ', s_suppkey, '}')""")
    table(spark, d, "supplier").selectExpr(lines).write.text(path)
    read = read_table_file(spark, {"path": path})
    return read.data.selectExpr("false as rejected", "cast(k as string) as line").unionAll(
        read.rejects.selectExpr("true as rejected", "line")
    )


@query("file_tsv", "select p_partkey, p_name, p_size from part")
def _(spark, d):
    path = staging_path(spark, "tab") + ".tsv"
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.csv(path, header=True, sep="\t")
    return read_file(spark, {"path": path, "schema": "p_partkey bigint, p_name string, p_size int"})


@query("file_json_array", "select s_suppkey, s_name from supplier")
def _(spark, d):
    """Documents that hold a list of objects over several lines."""
    path = staging_path(spark, "array") + ".json"
    rows = table(spark, d, "supplier").groupBy(F.expr("s_suppkey div 100").alias("g")).agg(
        F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value")
    )
    rows.selectExpr("g", "replace(value, '},{', '},\n{') as value").write.partitionBy("g").text(path)
    return read_json(spark, path, "s_suppkey bigint, s_name string")[0]


@query("file_json_pages", "select page_id, url, html from pages")
def _(spark, d):
    """One list per task, on one line, of objects whose texts hold brackets, quotes and commas: split all the same."""
    path = staging_path(spark, "pages") + ".json"
    one = F.to_json(F.struct("page_id", "url", "html"))
    lists = table(spark, d, "pages").select(F.spark_partition_id().alias("g"), F.col("page_id").alias("k"), one.alias("value"))
    # an element a line, each but the last of its file with a comma; brackets at the ends
    w = Window.partitionBy("g").orderBy("k")
    first, last = F.lag("k").over(w).isNull(), F.lead("k").over(w).isNull()
    line = F.concat(F.when(first, "[").otherwise(""), "value", F.when(last, "]").otherwise(","))
    lists = lists.select("g", "k", line.alias("value")).repartition("g").sortWithinPartitions("g", "k")
    lists.drop("k").write.partitionBy("g").option("lineSep", " ").text(path)
    return read_json(spark, path, "page_id bigint, url string, html string")[0]


@query("file_csv_breaks", "select doc_id, case when trim(text) = '' then null else text end as text from documents")
def _(spark, d):
    """Whole texts with line breaks, quotes and separators in them; the files are split nevertheless."""
    path = staging_path(spark, "breaks")
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, d, "documents").select("doc_id", "text").write.options(**options).csv(path)
    return extract(spark, {"type": "csv", "path": path, "multiline": True, "schema": "doc_id bigint, text string"})


@query("upload_encodings", "select n_nationkey, n_name || 'é' as label from nation")
def _(spark, d):
    """A folder whose files are UTF-8 and Latin-1."""
    path, nations = staging_path(spark, "upload"), table(spark, d, "nation").selectExpr("n_nationkey", "concat(n_name, 'é') as label")
    nations.filter("n_nationkey % 2 = 0").write.csv(path, header=True)
    nations.filter("n_nationkey % 2 = 1").write.mode("append").option("encoding", "iso-8859-1").csv(path, header=True)
    return read_upload(spark, path).withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("file_csv_append", "select * from nation union all select * from nation")
def _(spark, d):
    nations = table(spark, d, "nation")
    path = _written(nations, "csv")
    load(nations, {"type": "csv", "path": path, "mode": "append"})
    schema = "n_nationkey int, n_name string, n_regionkey int"
    return extract(spark, {"type": "csv", "path": path, "schema": schema})


@query("file_json_lines", "select event_id, event_type, user_id, value from events")
def _(spark, d):
    return read_json_records(spark, _written(table(spark, d, "events").select("event_id", "event_type", "user_id", "value"), "json"))


@query("file_parquet", "select * from part")
def _(spark, d):
    path = _written(table(spark, d, "part"), "parquet", compression="gzip")
    return extract(spark, {"type": "parquet", "path": path + "/*.parquet"})


@query("file_text_delimited", "select p_partkey, p_name, p_size from part")
def _(spark, d):
    path = staging_path(spark, "text")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.option("sep", "|").csv(path, header=True)
    return read_text_table(spark, path).withColumn("p_size", F.col("p_size").cast("int"))


@query(
    "file_text_lines",
    """select text, count(*) as n from (select rtrim(unnest(string_split(text, chr(10)))) as text from documents)
       where text <> '' group by text""",
)
def _(spark, d):
    path = staging_path(spark, "lines")
    table(spark, d, "documents").select("text").write.text(path)
    lines = numbered_lines(spark, path)
    return lines.groupBy("text").agg(F.count_distinct("file", "line_number").alias("n"))


@query(
    "table_upsert",
    """select s_suppkey, s_name, s_acctbal from supplier where s_acctbal <= 4000
       union all select s_suppkey, upper(s_name), s_acctbal + 1 from supplier where s_acctbal > 4000""",
)
def _(spark, d):
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = _written(suppliers, "parquet", mode="upsert", upsert_key=["s_suppkey"])
    changed = suppliers.filter("s_acctbal > 4000").selectExpr(
        "s_suppkey", "upper(s_name) as s_name", "s_acctbal + 1 as s_acctbal"
    )
    load(changed, {"type": "parquet", "path": path, "mode": "upsert", "upsert_key": "s_suppkey"})
    return read_table(spark, path)


@functools.lru_cache(maxsize=1)
def _rows_of(url: str):
    import pyarrow.parquet as pq

    return pq.read_table(url, columns=["s_suppkey", "s_name"])


@query("api_pages", "select s_suppkey, s_name from supplier")
def _(spark, d):
    """A service that does not say how many pages it has; several tasks fetch them."""

    def fetch(url, params):
        size, page = params["per_page"], params["page"]
        table = _rows_of(url)
        rows = table.slice((page - 1) * size, size).to_pylist()
        return {"results": rows, "next": page + 1 if page * size < len(table) else None}

    config = {
        "url": f"{d}/supplier.parquet", "data_key": "results", "schema": "struct<s_suppkey: bigint, s_name: string>",
        "pagination": {"size": 20, "max_pages": None},
    }
    return read_api(spark, config, fetch)


# -- whole pipelines ---------------------------------------------------------------------------------------


def _orders_pipeline(spark, d):
    """Clean the orders and upsert them, with checks, mark and run row."""
    root = staging_path(spark, "pipeline")
    store = Bookkeeping(spark, f"{root}/books")
    config = {
        "incremental": True,
        "source": {
            "type": "parquet", "name": "orders", "path": f"{d}/orders.parquet", "checkpoint_column": "o_orderkey",
        },
        "transformations": [
            {"name": "remove_duplicates", "config": {"subset": ["o_orderkey"], "order_by": ["o_orderdate"]}},
            {"name": "normalize_text", "config": {"columns": ["o_orderpriority"]}},
            {"name": "filter_rows", "config": {"expression": "o_totalprice > 1000"}},
        ],
        "quality": {"required_columns": ["o_orderkey"], "unique_keys": ["o_orderkey"]},
        "destination": {"type": "parquet", "path": f"{root}/orders", "mode": "upsert", "upsert_key": ["o_orderkey"]},
    }
    run_pipeline(spark, "orders", config, store)
    return store, f"{root}/orders"


@query(
    "pipeline_output",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, lower(o_orderpriority) as o_orderpriority
       from orders where o_totalprice > 1000""",
)
def _(spark, d):
    return read_table(spark, _orders_pipeline(spark, d)[1])


@query(
    "pipeline_books",
    """select 'orders' as pipeline_name, 'success' as status, count(*) as records_extracted,
              count(*) filter (where o_totalprice > 1000) as records_transformed,
              count(*) filter (where o_totalprice > 1000) as records_loaded, cast(100 as double) as quality_score
       from orders""",
)
def _(spark, d):
    runs = _orders_pipeline(spark, d)[0].read("pipeline_runs")
    return runs.select(
        "pipeline_name", "status", "records_extracted", "records_transformed", "records_loaded",
        F.col("quality_score").cast("double").alias("quality_score"),
    )


@query(
    "pipeline_checkpoint",
    """select 'orders' as pipeline_name, 'orders' as source_name, 'watermark' as checkpoint_key,
              cast(max(o_orderkey) as varchar) as checkpoint_value, 'bigint' as value_type from orders""",
)
def _(spark, d):
    return _orders_pipeline(spark, d)[0].read("etl_checkpoints").drop("updated_at")
