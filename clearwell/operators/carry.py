"""Forward and backward fill as a segmented prefix scan.

A window ordered over a whole table, or over one partition key that owns much of it, runs in a single task. Here the
rows are dealt by ranges of (partition, order) and written once, so each has a place in the whole order: the rows of the
parts before it and those before it in its own. Places are cut into blocks of a fixed number of rows, whatever their
keys. A block fills itself; its last known values, with the partition they belong to, are one row of a table of tails,
which is filled in the same way, blocks of blocks, until one block is left. What a block's predecessor ends with then
goes into the block. Copies of a row have places of their own, so no key and no group of copies can be too large.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import col, is_orderable, nan_to_null
from ..session import materialize

ROWS_PER_BLOCK = 1_000_000
# Tails in a block of the levels above.
FAN = 1024


def carry_fill(
    df: DataFrame,
    columns: list[str],
    order_by: list[str],
    partition_by: list[str] | None = None,
    forward: bool = True,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Fill gaps of ``columns`` with the nearest earlier (later) known value in ``order_by`` order.

    Rows that tie on ``order_by`` are ordered by a hash of the whole row, so the result does not depend on how
    the rows are distributed. Runs the jobs that put the rows in order; the filled frame reads what they wrote.
    """
    if not order_by:
        raise ValueError("ffill/bfill needs order_by: rows of a DataFrame have no position")
    parts = list(partition_by or [])
    unknown = [c for c in [*columns, *order_by, *parts] if c not in df.columns]
    if unknown:
        raise ValueError(f"ffill/bfill: unknown columns {unknown}")
    types = {f.name: f.dataType for f in df.schema.fields}
    known = [nan_to_null(col(c), types[c]).alias(c) if c in columns else col(c) for c in df.columns]
    placed = _placed(df.select(*known), order_by, parts, forward)
    segment = [col(c) for c in parts]
    values = {f"__v{i}": col(c) for i, c in enumerate(columns)}
    rows = placed.withColumns(values | {f"__p{i}": c for i, c in enumerate(segment)})
    size = rows_per_block or ROWS_PER_BLOCK
    count = placed.agg(F.max("__place")).first()[0]
    filled = _filled(rows, list(values), [f"__p{i}" for i in range(len(parts))], size, 0 if count is None else count + 1)
    at = {c: f"__v{i}" for i, c in enumerate(columns)}
    return filled.select(*[F.col(at[c]).alias(c) if c in at else col(c) for c in df.columns])


def _placed(df: DataFrame, order_by: list[str], parts: list[str], forward: bool) -> DataFrame:
    """The rows, written in order, with ``__place``: how many rows come before."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    fingerprint = F.xxhash64(*[col(c) for c in df.columns if is_orderable(types[c])])
    keyed = df.withColumn("__hash", fingerprint)
    order = [col(c) for c in [*parts, *order_by, "__hash"]]
    # equal rows are dealt over several parts as well
    keyed = materialize(keyed.withColumn("__copy", F.monotonically_increasing_id()))
    order.append(F.col("__copy"))
    order = [c.asc() if forward else c.desc() for c in order]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__hash", "__copy")
    number = F.monotonically_increasing_id()
    staged = materialize(ordered.withColumn("__id", number))
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    # one number per part of the range partitioning goes through the driver
    sizes = sorted(tuple(r) for r in staged.groupBy(part.alias("part")).agg(F.max(row) + 1).collect())
    ends = list(itertools.accumulate(size for _, size in sizes))
    starts = {"__part": [p for p, _ in sizes], "__start": [0, *ends][: len(sizes)]}
    known = spark.createDataFrame(pa.table(starts, schema=pa.schema([(c, pa.int64()) for c in starts])))
    placed = staged.withColumn("__part", part).withColumn("__row", row)
    placed = placed.join(F.broadcast(known), "__part").withColumn("__place", F.col("__start") + F.col("__row"))
    return placed.drop("__id", "__part", "__row", "__start")


def _filled(rows: DataFrame, values: list[str], segment: list[str], size: int, count: int) -> DataFrame:
    """``rows`` (``__place`` from 0 up to ``count``, values, segment) with each value's gaps filled within its segment.

    The rows of a segment lie together in the order of their places.
    """
    block = F.expr(f"__place div {size}")
    w = Window.partitionBy("__block", *segment).orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__block", block).withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    blocks = -(-count // size)
    if blocks <= 1:
        return local.drop("__block")
    tails = materialize(_tails(rows.withColumn("__block", block), values, segment))
    carried = materialize(_filled(tails, values, segment, FAN, blocks))
    carried = carried.select(
        (F.col("__place") + 1).alias("__into"),
        *[F.col(p).alias(f"__of{i}") for i, p in enumerate(segment)],
        *[F.col(v).alias(f"__in{i}") for i, v in enumerate(values)],
    )
    same: Column = F.col("__block") == F.col("__into")
    for i, p in enumerate(segment):
        same = same & F.col(p).eqNullSafe(F.col(f"__of{i}"))
    joined = local.join(carried, same, "left")
    taken = {v: F.coalesce(F.col(v), F.col(f"__in{i}")) for i, v in enumerate(values)}
    return joined.withColumns(taken).select(*rows.columns)


def _tails(rows: DataFrame, values: list[str], segment: list[str]) -> DataFrame:
    """One row per block, ``__place`` its number: the segment it ends in and that segment's last known values there."""
    known = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("__place"))).alias(v) for v in values]
    per_segment = rows.groupBy("__block", *segment).agg(F.max("__place").alias("__end"), *known)
    picked = F.max_by(F.struct(*segment, *values), "__end") if segment else F.first(F.struct(*values))
    last = per_segment.groupBy("__block").agg(picked.alias("__tail"))
    return last.select(F.col("__block").alias("__place"), "__tail.*")
