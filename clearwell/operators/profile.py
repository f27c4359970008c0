"""Column profiles: one row per column."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, is_numeric, is_orderable, nan_to_null
from .dedup import _as_list, _first_hash, _hashable, _second_hash

MAX_NULL_PCT = 0.80
SAMPLE_SIZE = 3


# What a profile says about a column, and the share of distinct values from which it may be a key.
TOO_SPARSE, MAY_BE_KEY, CONSTANT, KEEP = "drop (too many nulls)", "possible ID column", "constant — consider dropping", "keep"
KEY_SHARE = 0.99


def suggested_action(null_pct: Column, unique_count: Column, unique_pct: Column, max_null_pct: float) -> Column:
    complete = null_pct == 0
    return (
        F.when(null_pct >= max_null_pct, TOO_SPARSE)
        .when(complete & (unique_pct >= KEY_SHARE), MAY_BE_KEY)
        .when(unique_count == 1, CONSTANT)
        .otherwise(KEEP)
    )


def profile_columns(
    df: DataFrame,
    max_null_pct: float = MAX_NULL_PCT,
    exact: bool = True,
    order_by: list[str] | str | None = None,
    samples: bool = True,
) -> DataFrame:
    """One row per column: position, name, dtype, null_count, null_pct, unique_count, unique_pct, sample_values,
    min_val, max_val, mean_val, suggested_action.

    All measures come from one scan. With ``exact`` each known value becomes a slim pair of its column's number and a
    128-bit hash, counted map-side; no value is shuffled. ``exact=False`` sketches the distinct counts instead. The
    samples are the first three known values in ``order_by`` order, or any three without it.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(types)
    measured = _measured(df, types) if exact else _sketched(df, types)
    n = F.greatest(F.col("n"), F.lit(1))
    rows = []
    for i, c in enumerate(names):
        numeric = is_numeric(types[c])
        none = F.lit(None).cast("double")
        null_count = F.col("n") - F.col(f"known_{i}")
        unique = F.col(f"unique_{i}")
        null_pct, unique_pct = F.round(null_count / n, 4), F.round(unique / n, 4)
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("name"),
                F.lit(types[c].simpleString()).alias("dtype"),
                null_count.alias("null_count"),
                null_pct.alias("null_pct"),
                unique.alias("unique_count"),
                unique_pct.alias("unique_pct"),
                (F.col(f"min_{i}") if numeric else none).alias("min_val"),
                (F.col(f"max_{i}") if numeric else none).alias("max_val"),
                (F.round(F.col(f"mean_{i}"), 4) if numeric else none).alias("mean_val"),
                suggested_action(null_pct, unique, unique_pct, max_null_pct).alias("suggested_action"),
            )
        )
    profile = measured.select(F.inline(F.array(*rows)))
    if not samples:
        return profile
    return profile.join(column_samples(df, order_by), "name", "left").select(
        "position", "name", "dtype", "null_count", "null_pct", "unique_count", "unique_pct",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "min_val", "max_val", "mean_val", "suggested_action",
    )


def _sketched(df: DataFrame, types) -> DataFrame:
    """One row: ``n`` and, for the i-th column, ``known_i``, ``unique_i`` and for numbers ``min_i``, ``max_i``, ``mean_i``."""
    measures = [F.count(F.lit(1)).alias("n")]
    for i, (c, dtype) in enumerate(types.items()):
        known = nan_to_null(col(c), dtype)
        measures += [F.count(known).alias(f"known_{i}"), F.approx_count_distinct(known).alias(f"unique_{i}")]
        if is_numeric(dtype):
            number = known.cast("double")
            measures += [F.min(number).alias(f"min_{i}"), F.max(number).alias(f"max_{i}"), F.avg(number).alias(f"mean_{i}")]
    return df.agg(*measures)


def _measured(df: DataFrame, types) -> DataFrame:
    """The same with exact distinct counts, from pairs of a column's number and the hashes of a value.

    What is inside a list or an object is hashed as JSON, since hashes leave nulls out.
    """
    pairs = [F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.lit(None).cast("double").alias("x"))]
    for i, (c, dtype) in enumerate(types.items()):
        known = nan_to_null(col(c), dtype)
        value = [known if _hashable(dtype) else F.to_json(F.struct(known.alias("v")), {"ignoreNullFields": "false"})]
        number = known.cast("double") if is_numeric(dtype) else F.lit(None).cast("double")
        pair = F.struct(F.lit(i).alias("i"), _first_hash(value).alias("h"), _second_hash(value).alias("g"), number.alias("x"))
        pairs.append(F.when(known.isNotNull(), pair))
    exploded = df.select(F.explode(F.array(*pairs)).alias("p")).filter("p is not null").select("p.*")
    values = exploded.groupBy("i", "h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"))
    columns = values.groupBy("i").agg(
        F.sum("n").alias("known"),
        F.count(F.lit(1)).alias("unique"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        (F.sum(F.col("n") * F.col("x")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean"),
    )

    def of(i: int, name: str) -> Column:
        return F.max(F.when(F.col("i") == i, F.col(name)))

    picked = [F.coalesce(of(-1, "known"), F.lit(0)).alias("n")]
    for i, dtype in enumerate(types.values()):
        picked += [F.coalesce(of(i, name), F.lit(0)).alias(f"{name}_{i}") for name in ("known", "unique")]
        if is_numeric(dtype):
            picked += [of(i, a).alias(f"{b}_{i}") for a, b in (("least", "min"), ("most", "max"), ("mean", "mean"))]
    return columns.agg(*picked)


# Rows, first in order, in which three known values of a column are looked for.
LOOKED_AT = 200


def column_samples(df: DataFrame, order_by: list[str] | str | None = None) -> DataFrame:
    """(name, sample_values): three known values of each column as text.

    One scan keeps the first rows in order, which hold three values of most columns. Only columns that have fewer there
    are looked through by themselves, each with a scan of its own values and the ordering columns.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    order = _as_list(order_by)
    keys = [col(c).alias(f"o{i}") for i, c in enumerate(order)]
    known = [nan_to_null(col(c), t).alias(f"v{i}") for i, (c, t) in enumerate(types.items())]
    head = df.select(*keys, *known)
    ranks = [f"o{i}" for i in range(len(order))]
    # rows that tie at the cut may have come in or not: only what lies before it counts
    head = (head.orderBy(*ranks) if order else head).limit(LOOKED_AT)
    cut = F.struct(*[F.col(r) for r in ranks]) if order else F.lit(0)
    picks = [_first_values(F.col(f"v{i}"), ranks, t).alias(f"s{i}") for i, t in enumerate(types.values())]
    bounds = [F.count(F.lit(1)).alias("n"), *([F.max(cut).alias("cut")] if order else [])]
    row = head.agg(*bounds, *picks).first() if types else None
    found, parts = [], []
    for i, (c, dtype) in enumerate(types.items()):
        places = row[f"s{i}"]
        complete = row["n"] < LOOKED_AT or len(places) == SAMPLE_SIZE and (not order or tuple(places[-1][:-1]) != tuple(row["cut"]))
        if complete:
            texts = F.array(*[F.lit(p["v"]) for p in places]).cast("array<string>")
            found.append(F.struct(F.lit(c).alias("name"), texts.alias("sample_values")))
        else:
            parts.append(_samples_of(df, c, dtype, keys, ranks))
    if found or not parts:
        none = F.array().cast("array<struct<name:string,sample_values:array<string>>>")
        parts.append(df.sparkSession.range(1).select(F.inline(F.array(*found) if found else none)))
    return functools.reduce(DataFrame.unionByName, parts)


def _first_values(value: Column, ranks: list[str], dtype) -> Column:
    """The first known values, each with its place in the order; ties go by the value."""
    tie = [value.alias("t")] if is_orderable(dtype) else []
    place = F.when(value.isNotNull(), F.struct(*[F.col(r) for r in ranks], *tie, value.cast("string").alias("v")))
    first = F.slice(F.array_sort(F.collect_list(place)), 1, SAMPLE_SIZE)
    return F.transform(first, lambda s: F.struct(*[s[r].alias(r) for r in ranks], s["v"].alias("v")))


def _samples_of(df: DataFrame, c: str, dtype, keys: list[Column], ranks: list[str]) -> DataFrame:
    rows = df.select(nan_to_null(col(c), dtype).alias("v"), *keys).filter("v is not null")
    if ranks:
        rows = rows.orderBy(*ranks, "v") if is_orderable(dtype) else rows.orderBy(*ranks)
    rows = rows.limit(SAMPLE_SIZE)
    listed = F.transform(_first_values(F.col("v"), ranks, dtype), lambda s: s["v"])
    return rows.agg(F.lit(c).alias("name"), listed.alias("sample_values"))
