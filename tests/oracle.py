"""Compare the named queries with their SQL, run by DuckDB on the same tables.

``python tests/oracle.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows)), [columns[i] for i in order]


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set threads to 4")
    for path in glob.glob(sf_dir + "/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT",
}


def compare(spark, con, name, sf_dir):
    """None when equal, else a short description of the first difference."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got, got_columns = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want_types = {c[0]: str(c[1]) for c in result.description}
    want, want_columns = rows_of(columns, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"\n   got  {a[:600]}\n   want {b[:600]}"
    if not got:
        return "no rows"
    for c, t in types.items():
        if t in SAME_TYPE and not want_types[c].startswith(("NUMBER", "STRING")) and SAME_TYPE[t] != want_types[c]:
            return f"type of {c}: {t} != {want_types[c]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from clearwell.session import build_session

    sf = argv[0] if argv else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in argv[1:] or entry.queries():
        started = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
