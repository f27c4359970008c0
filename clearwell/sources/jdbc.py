"""SQL sources: database tables over JDBC, and queries over registered views."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession

from ..streaming.incremental import filter_since

# Fixed value: rows fetched per round trip.
FETCH_SIZE = 50_000


def jdbc_options(config: dict) -> dict[str, str]:
    """Reader options from ``connection_string`` (a JDBC URL), ``table`` and ``schema`` ('public') or ``query``,
    and ``partition_column`` with ``lower_bound``, ``upper_bound``, ``num_partitions`` for a parallel read."""
    if "connection_string" not in config:
        raise ValueError("missing required config keys: ['connection_string']")
    options = {"url": config["connection_string"], "fetchsize": str(config.get("chunk_size", FETCH_SIZE))}
    if config.get("query"):
        options["dbtable"] = f"({config['query']}) source_query"
    elif config.get("table"):
        schema = config.get("schema", "public")
        options["dbtable"] = f"{schema}.{config['table']}" if schema else config["table"]
    else:
        raise ValueError("either 'query' or 'table' must be given")
    for key, option in (("driver", "driver"), ("user", "user"), ("password", "password")):
        if config.get(key):
            options[option] = str(config[key])
    if config.get("partition_column"):
        absent = [k for k in ("lower_bound", "upper_bound", "num_partitions") if config.get(k) is None]
        if absent:
            raise ValueError(f"partition_column needs {absent}")
        options |= {
            "partitionColumn": config["partition_column"],
            "lowerBound": str(config["lower_bound"]),
            "upperBound": str(config["upper_bound"]),
            "numPartitions": str(config["num_partitions"]),
        }
    return options


def bind(query: str, params: dict) -> str:
    """The query with ``:name`` replaced by quoted literals, for databases that read a query as text. Texts in
    quotes and ``::`` casts are left alone."""

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, (int, float)):
            return str(value)
        if isinstance(value, datetime.datetime):
            return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
        if isinstance(value, datetime.date):
            return f"DATE '{value:%Y-%m-%d}'"
        text = str(value)
        if "\\" in text or "\0" in text:  # some databases read a backslash before a quote as part of the text
            raise ValueError("a value with a backslash can't be put into a query as text")
        return "'" + text.replace("'", "''") + "'"

    def swap(match: re.Match) -> str:
        name = match.group("name")
        if name is None:
            return match.group()
        if name not in params:
            raise ValueError(f"no value for :{name}")
        return literal(params[name])

    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|::|:(?P<name>[A-Za-z_]\w*)", swap, query)


def query_params(config: dict, checkpoint=None) -> dict:
    """``params``, and ``checkpoint`` when the query names it: null on a first run, so let such a query say
    ``:checkpoint is null or ...``."""
    params = dict(config.get("params") or {})
    if ":checkpoint" in config["query"]:
        params["checkpoint"] = checkpoint if config.get("incremental") else None
    return params


def read_jdbc(spark: SparkSession, config: dict, checkpoint=None) -> DataFrame:
    """A whole table or a query. For a table the high-water mark becomes a plain filter, which Spark pushes into
    the database; a query places ``:checkpoint`` itself."""
    if config.get("query"):
        config = {**config, "query": bind(config["query"], query_params(config, checkpoint))}
    df = spark.read.format("jdbc").options(**jdbc_options(config)).load()
    if config.get("query") or not config.get("incremental"):
        return df
    return filter_since(df, config.get("checkpoint_column"), checkpoint)


def read_query(spark: SparkSession, config: dict, checkpoint=None) -> DataFrame:
    """``query`` over registered views, with named parameters."""
    return spark.sql(config["query"], args=query_params(config, checkpoint))
