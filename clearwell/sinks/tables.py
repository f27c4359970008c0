"""Tables kept as folders of Parquet with a commit log: upserts that rewrite the buckets they touch, appends that are
compacted as they pile up.

An upsert table is cut into buckets by a hash of its key. A merge stages the incoming rows, reads the buckets that they
fall into, and writes these anew; every other bucket keeps its files. Two merges at once meet in the log
(:mod:`commitlog`): buckets apart, both go through; a bucket in common, the second starts again from what the first left.

An appended table is a list of parts. ``FANIN`` parts of a level become one of the next, so that ``n`` appends leave
about ``FANIN * log(n)`` parts and each row is rewritten ``log(n)`` times.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, is_orderable
from ..operators.merge import upsert
from .commitlog import CommitLog, Part, State

#: Buckets of a new table: as many as its first rows fill to so many bytes each.
BUCKET_BYTES, FEWEST, MOST = 128 << 20, 8, 65_536
BUCKET = "__bucket"
#: How often a merge that met another one starts again, and parts of a level that are compacted into one.
ATTEMPTS, FANIN = 20, 8


def exists(spark: SparkSession, path: str) -> bool:
    log = CommitLog(spark, path)
    return log.fs.exists(log.hadoop_path(path))


def _rows(spark: SparkSession, path: str, state: State, parts) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(state.layout["schema"]))
    paths = [f"{path.rstrip('/')}/{p.path}" for p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed state; a folder without a log is read as plain Parquet."""
    state = CommitLog(spark, path).state()
    return _rows(spark, path, state, state.parts) if state.version else spark.read.parquet(path)


def _bucket(df: DataFrame, keys: list[str], buckets: int) -> Column:
    """By the key; rows with a null in it match nothing, so they are dealt by all columns."""
    whole = functools.reduce(Column.__and__, [col(k).isNotNull() for k in keys])
    every = [col(f.name) for f in df.schema.fields if is_orderable(f.dataType)]
    hashed = F.when(whole, F.xxhash64(*[col(k) for k in keys])).otherwise(F.xxhash64(*every))
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def _write(log: CommitLog, rows: DataFrame, layout: dict) -> list[Part]:
    """Rows as parts, one or a few files per bucket; a bucket that is too large for a task is split."""
    folder = log.new_folder()
    bucket = _bucket(rows, layout["keys"], layout["buckets"])
    dealt = rows.withColumn(BUCKET, bucket).hint("rebalance", BUCKET)
    dealt.write.partitionBy(BUCKET).parquet(f"{log.path}/{folder}")
    names = [n for n in log.names(folder) if n.startswith(f"{BUCKET}=")]
    return [Part(f"{folder}/{n}", int(n.split("=")[1])) for n in names]


def _as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``df`` in the table's types; columns the table lacks stay and are refused by the merge."""
    types = {f.name: f.dataType for f in schema.fields}
    return df.select(*[col(c).cast(types[c]).alias(c) if c in types else col(c) for c in df.columns])


def upsert_table(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: list[str],
    order_by: list[str] | None = None,
    buckets: int | None = None,
) -> None:
    """Merge rows into the table at ``path``; a missing table is created, a folder of plain Parquet is taken over.

    ``buckets`` counts for a new table. A table that is merged by another key than its own is rewritten whole.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    log = CommitLog(spark, path)
    staging = f"_staging/{uuid.uuid4().hex}"
    incoming.write.parquet(f"{log.path}/{staging}")
    staged = spark.read.schema(incoming.schema).parquet(f"{log.path}/{staging}")
    try:
        for _ in range(ATTEMPTS):
            state = log.state()
            try:
                if _merge(spark, log, state, staged, keys, order_by, buckets or _fitting(log.bytes_of(staging))):
                    return
            except Exception:
                # what the next commit took away is gone with the one after it
                if log.state().version < state.version + 2:
                    raise
    finally:
        log.delete(staging)
    raise RuntimeError(f"{path}: other writers changed the same buckets {ATTEMPTS} times")


def _fitting(size: int) -> int:
    return min(MOST, max(FEWEST, -(-size // BUCKET_BYTES)))


def _merge(
    spark: SparkSession, log: CommitLog, state: State, staged: DataFrame, keys: list[str], order_by, buckets: int
) -> bool:
    """One attempt from ``state``; False if another writer was in the way."""
    plain = [] if state.version else [n for n in log.names() if not n.startswith(("_", "."))]
    if state.version:
        layout = state.layout
        schema = T.StructType.fromJson(json.loads(layout["schema"]))
    else:
        schema = spark.read.parquet(log.path).schema if plain else staged.schema
        layout = {"schema": schema.json(), "keys": keys, "buckets": buckets}
    rows = _as_schema(staged, schema)
    touched = None
    if state.version and not layout["keys"]:
        raise ValueError(f"{log.path} is a table of appended rows")
    if state.version and layout["keys"] == keys and set(keys) <= set(rows.columns):
        hit = rows.select(_bucket(rows, keys, layout["buckets"]).alias("b")).distinct()
        touched = {r["b"] for r in hit.collect()}
    old = [p for p in state.parts if touched is None or p.bucket in touched]
    target = spark.read.parquet(log.path) if plain else _rows(spark, log.path, state if state.version else State(0, layout), old)
    added = _write(log, upsert(target, rows, keys, order_by), layout)
    if log.commit(state, added, old, touched, layout) is None:
        for part in added:
            log.delete(part.path)
        return False
    for name in plain:
        log.delete(name)
    return True


def rebucket(spark: SparkSession, path: str, buckets: int) -> None:
    """Cut a table into another number of buckets, when they have grown too large or too small."""
    log = CommitLog(spark, path)
    state = log.state()
    layout = {**state.layout, "buckets": buckets}
    added = _write(log, _rows(spark, path, state, state.parts), layout)
    if log.commit(state, added, list(state.parts), None, layout) is None:
        for part in added:
            log.delete(part.path)
        raise RuntimeError(f"{path}: another writer changed the table")


def append_table(spark: SparkSession, path: str, rows: DataFrame, sort_by: list[str] | None = None) -> None:
    """Add rows; appends never meet. A level that is full is compacted, its rows sorted by ``sort_by``, so that filters
    on these columns skip most of it."""
    log = CommitLog(spark, path)
    layout = {"schema": rows.schema.json(), "keys": [], "buckets": 0}
    part = Part(log.new_folder())
    rows.write.parquet(f"{log.path}/{part.path}")
    while True:
        base = log.state()
        if (state := log.commit(base, [part], [], set(), base.layout or layout)) is not None:
            break
    compact(spark, path, state, sort_by)


def compact(spark: SparkSession, path: str, state: State, sort_by: list[str] | None = None) -> None:
    """Make one part of the parts of each level that is full, from the lowest up. If another writer compacts the same
    parts, its result stands."""
    log = CommitLog(spark, path)
    level = 0
    while full := [p for p in state.parts if p.level == level]:
        if len(full) >= FANIN:
            part = Part(log.new_folder(), level=level + 1)
            rows = _rows(spark, path, state, full)
            rows = rows.sort(*sort_by) if sort_by else rows.hint("rebalance")
            rows.write.parquet(f"{log.path}/{part.path}")
            after = log.commit(state, [part], full, set())
            if after is None:
                log.delete(part.path)
                return
            state = after
        level += 1
