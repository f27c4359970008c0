"""Sinks by name."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.rules import counted
from .tables import upsert_table

Sink = Callable[[DataFrame, dict], str]

# Fixed value: rows per insert batch.
BATCH_SIZE = 5000


@dataclass
class LoadResult:
    destination: str
    records_loaded: int
    records_failed: int
    duration_seconds: float
    load_mode: str
    error: str | None = None

    @property
    def success(self) -> bool:
        return self.error is None


def write_csv(df: DataFrame, config: dict) -> str:
    """``path``, ``mode`` ('write' or 'append'), ``encoding``. A folder of part files, each with its header."""
    mode = "append" if config.get("mode", "write") == "append" else "overwrite"
    writer = df.write.mode(mode).option("header", True).option("encoding", config.get("encoding", "utf-8"))
    writer.option("escape", '"').csv(config["path"])
    return config["path"]


def write_parquet(df: DataFrame, config: dict) -> str:
    """``path``, ``compression`` ('snappy', 'gzip', 'brotli'), ``partition_by``; ``mode='upsert'`` with
    ``upsert_key`` and ``order_by`` merges instead of replacing."""
    path, mode = config["path"], config.get("mode", "write")
    if mode == "upsert":
        upsert_table(df.sparkSession, path, df, _upsert_key(config), config.get("order_by"))
        return path
    writer = df.write.mode("append" if mode == "append" else "overwrite")
    writer = writer.option("compression", config.get("compression", "snappy"))
    if config.get("partition_by"):
        writer = writer.partitionBy(*config["partition_by"])
    writer.parquet(path)
    return path


def write_json(df: DataFrame, config: dict) -> str:
    """``path``, ``mode``. JSON Lines."""
    df.write.mode("append" if config.get("mode") == "append" else "overwrite").json(config["path"])
    return config["path"]


def _upsert_key(config: dict) -> list[str]:
    key = config.get("upsert_key") or []
    key = [key] if isinstance(key, str) else list(key)
    if not key:
        raise ValueError("upsert_key required for upsert mode")
    return key


def merge_statement(table: str, staging: str, columns: list[str], keys: list[str], url: str = "") -> str:
    """One statement that merges a staging table, in the words of the database that ``url`` names: its own form of
    insert-or-update for MySQL, MariaDB and SQLite, which need a unique index on the keys, else the standard MERGE."""
    kind = url.removeprefix("jdbc:").split(":", 1)[0].lower()
    mark = "`" if kind in ("mysql", "mariadb") else '"'
    quoted = {c: f"{mark}{c}{mark}" for c in columns}
    names = ", ".join(quoted.values())
    rest = [quoted[c] for c in columns if c not in keys]
    if kind in ("mysql", "mariadb"):
        first = quoted[keys[0]]
        updates = ", ".join(f"{q} = VALUES({q})" for q in rest) or f"{first} = VALUES({first})"
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} ON DUPLICATE KEY UPDATE {updates}"
    if kind == "sqlite":
        updates = ", ".join(f"{q} = excluded.{q}" for q in rest)
        action = f"UPDATE SET {updates}" if updates else "NOTHING"
        match = ", ".join(quoted[k] for k in keys)
        # without a condition the parser takes ON for that of a join
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} WHERE true ON CONFLICT ({match}) DO {action}"
    match = " AND ".join(f"t.{quoted[k]} = s.{quoted[k]}" for k in keys)
    update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{q} = s.{q}' for q in rest)} " if rest else ""
    values = ", ".join(f"s.{q}" for q in quoted.values())
    return f"MERGE INTO {table} t USING {staging} s ON {match} {update}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"


def write_jdbc(df: DataFrame, config: dict) -> str:
    """``connection_string``, ``table``, ``schema`` ('public'), ``mode`` ('append', 'replace', 'upsert'),
    ``upsert_key``, ``order_by``, ``chunksize``, ``num_partitions``.

    An upsert writes the rows, one per key, to a staging table in parallel and merges them with one statement
    in the database.
    """
    schema = config.get("schema", "public")
    table = f"{schema}.{config['table']}" if schema else config["table"]
    url, mode = config["connection_string"], config.get("mode", "append")
    options = {"url": url, "batchsize": str(config.get("chunksize", BATCH_SIZE))}
    options |= {k: str(config[k]) for k in ("driver", "user", "password") if config.get(k)}
    if config.get("num_partitions"):
        options["numPartitions"] = str(config["num_partitions"])
    if mode != "upsert":
        saved = "overwrite" if mode == "replace" else "append"
        df.write.format("jdbc").options(**options, dbtable=table).mode(saved).save()
        return table
    from ..operators.dedup import remove_duplicates

    keys = _upsert_key(config)
    order = config.get("order_by") or [c for c in df.columns if c not in keys]
    single = remove_duplicates(df, {"subset": keys, "keep": "last", "order_by": order}) if order else df.distinct()
    staging = f"{table}__incoming"
    single.write.format("jdbc").options(**options, dbtable=staging).mode("overwrite").save()
    jvm = df.sparkSession.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k in ("user", "password"):
        if config.get(k):
            properties.setProperty(k, str(config[k]))
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        statement = connection.createStatement()
        statement.executeUpdate(merge_statement(table, staging, df.columns, keys, url))
        statement.executeUpdate(f"DROP TABLE {staging}")
    finally:
        connection.close()
    return table


SINKS: dict[str, Sink] = {
    "postgresql": write_jdbc,
    "postgres": write_jdbc,
    "csv": write_csv,
    "parquet": write_parquet,
    "json": write_json,
}


def register_sink(name: str, sink: Sink) -> None:
    SINKS[name.lower()] = sink


def list_sinks() -> list[str]:
    return list(SINKS)


def get_sink(config: dict) -> Sink:
    kind = str(config.get("type", "")).lower()
    if kind not in SINKS:
        raise ValueError(f"Unknown loader type '{kind}'. Available: {list(SINKS)}")
    return SINKS[kind]


def load(df: DataFrame, config: dict) -> LoadResult:
    """Write a frame. The row count rides along with the write; an error is returned, not raised."""
    started = time.monotonic()
    sink = get_sink(config)
    mode = config.get("mode", "append" if sink is write_jdbc else "write")
    name = str(config.get("path") or config.get("table"))
    watched, seen = counted(df, "load")
    try:
        destination = sink(watched, config)
        return LoadResult(destination, seen.get["rows"], 0, time.monotonic() - started, mode)
    except Exception as error:  # noqa: BLE001 - reported to the caller, which decides
        try:
            rows = df.count()
        except Exception:  # noqa: BLE001 - the frame itself is what fails
            rows = 0
        return LoadResult(name, 0, rows, time.monotonic() - started, mode, str(error))
