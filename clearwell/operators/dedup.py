"""Duplicate removal."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, is_orderable


def _as_list(value) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def remove_duplicates(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``subset`` (columns, default all), ``keep`` ('first', 'last' or False), ``order_by``.

    Rows of a DataFrame have no position: first and last of a subset go by ``order_by``, and the remaining columns
    break ties (or decide alone, with a warning, when there is no ``order_by``). Every form groups with a map-side pre-aggregation, so a key that owns a third of the
    rows reaches the shuffle as one row per task.
    """
    subset = _as_list(config.get("subset"))
    keep = config.get("keep", "first")
    order_by = _as_list(config.get("order_by"))
    keys = subset or df.columns
    missing = [c for c in [*keys, *order_by] if c not in df.columns]
    if missing:
        raise ValueError(f"remove_duplicates: unknown columns {missing}")
    if keep not in ("first", "last", False):
        raise ValueError(f"remove_duplicates: keep must be 'first', 'last' or False, not {keep!r}")

    if set(keys) == set(df.columns):
        if keep is False:
            single = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
            return single.filter("__n = 1").drop("__n")
        return df.dropDuplicates()

    rest = [c for c in df.columns if c not in keys]
    key_cols = [col(c) for c in keys]
    if keep is False:
        groups = df.groupBy(*key_cols).agg(
            F.count(F.lit(1)).alias("__n"), F.first(F.struct(*[col(c) for c in rest])).alias("__row")
        )
        picked = groups.filter("__n = 1")
    else:
        if not order_by:
            warnings.warn(f"remove_duplicates: no order_by, so {keep} means by the other columns of the row")
        ranked = [c for c in order_by if c in rest] + [c for c in rest if c not in order_by]
        types = {f.name: f.dataType for f in df.schema.fields}
        sortable = [c for c in ranked if is_orderable(types[c])]
        order = F.struct(*[col(c) for c in sortable])
        if len(sortable) == len(ranked):
            # The ordering struct holds the whole row, so the smallest one is the answer.
            row = F.min(order) if keep == "first" else F.max(order)
        else:
            pick = F.min_by if keep == "first" else F.max_by
            row = pick(F.struct(*[col(c) for c in ranked]), order)
        picked = df.groupBy(*key_cols).agg(row.alias("__row"))
    key_set = set(keys)
    return picked.select(
        *[col(c) if c in key_set else F.col("__row").getField(c).alias(c) for c in df.columns]
    )


def _first_hash(columns: list[Column]) -> Column:
    return F.xxhash64(*columns)


def _second_hash(columns: list[Column]) -> Column:
    """64 bits of another family of hashes."""
    high, low = F.hash(F.lit(1), *columns), F.hash(F.lit(2), *columns)
    return F.shiftleft(high.cast("long"), 32).bitwiseXOR(low.cast("long"))


def _hashable(dtype: T.DataType) -> bool:
    """Hashes leave nulls out, which can be told for a column but not for what is inside one."""
    return not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def duplicate_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: ``total`` rows and ``repeats`` (rows beyond the first of their group).

    Rows are counted by a 64-bit hash, and only hashes and counts are shuffled. A group in which a second hash, of
    another family, differs holds rows that are not equal; the rows of such groups alone are compared in full. Their
    hashes, which are broadcast, are as many as collisions of 64 bits: one at a billion rows, some 30,000 at 10**12.
    Where there are none, the second scan is left out at run time. Equal rows hash alike whatever happens; for unequal
    ones to be taken as equal both hashes must collide at once.
    """
    names = keys or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = [col(c) for c in names]
    if not all(_hashable(types[c]) for c in names):
        return _totals(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")))
    hashed = columns + [c.isNull() for c in columns]
    first, second = _first_hash(hashed).alias("__h"), _second_hash(hashed).alias("__g")
    groups = df.select(first, second).groupBy("__h").agg(
        F.count(F.lit(1)).alias("__n"), (F.min("__g") != F.max("__g")).alias("__met")
    )
    apart = groups.filter("__met").select("__h")
    rows = df.select(*[c.alias(f"__c{i}") for i, c in enumerate(columns)], first)
    compared = rows.join(F.broadcast(apart), "__h", "left_semi").drop("__h")
    compared = compared.groupBy(*compared.columns).agg(F.count(F.lit(1)).alias("__n"))
    return _totals(groups.filter("not __met").select("__n").unionByName(compared.select("__n")))


def _totals(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("repeats"),
    )
