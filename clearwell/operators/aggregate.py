"""Grouped aggregation rule."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, is_fractional, is_numeric, is_temporal, nan_to_null
from .dedup import _as_list
from .quantiles import grouped_quantiles

ORDERED = ("first", "last")


def _aggregate(name: str, c: Column, dtype: T.DataType, order: Column | None) -> Column:
    if name == "sum":
        zero = F.lit(0).cast("double" if is_fractional(dtype) else "long")
        return F.coalesce(F.sum(c), zero)
    if name in ("mean", "avg"):
        return F.avg(c)
    if name in ("min", "max", "count"):
        return getattr(F, name)(c)
    if name == "std":
        return F.stddev_samp(c)
    if name == "var":
        return F.var_samp(c)
    if name == "nunique":
        return F.count_distinct(c)
    if name in ORDERED:
        if order is None:
            raise ValueError(f"aggregate_daily: {name} needs order_by")
        pick = F.min_by if name == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), order))
    raise ValueError(f"aggregate_daily: unknown aggregate {name!r}")


def aggregate_daily(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``date_column`` ('date'), ``group_by`` (default the date column), ``agg_config`` {column: name},
    and here also ``truncate`` ('day' groups timestamps by day), ``order_by`` (for first and last).

    Aggregates: sum, count, mean, min, max, median, std, var, nunique, first, last; default the sum of every
    numeric column outside the keys. Groups with a null key are left out; the sum of nothing is 0.
    """
    date_column = config.get("date_column", "date")
    keys = _as_list(config.get("group_by")) or [date_column]
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = dict(config.get("agg_config") or {}) or {
        c: "sum" for c, t in types.items() if is_numeric(t) and c not in keys
    }
    if not wanted:
        return df
    unknown = [c for c in [*keys, *wanted] if c not in types]
    if unknown:
        raise ValueError(f"aggregate_daily: unknown columns {unknown}")

    order_by = _as_list(config.get("order_by"))
    order = F.struct(*[col(c) for c in order_by]) if order_by else None
    known = functools.reduce(lambda a, b: a & b, [nan_to_null(col(k), types[k]).isNotNull() for k in keys])
    rows = df.filter(known)
    unit = config.get("truncate")
    if unit:
        rows = rows.withColumns({k: F.date_trunc(unit, col(k)) for k in keys if is_temporal(types[k])})

    medians = [c for c, a in wanted.items() if a == "median"]
    plain = [
        _aggregate(a, nan_to_null(col(c), types[c]), types[c], order).alias(c)
        for c, a in wanted.items()
        if a != "median"
    ]
    key_cols = [col(k) for k in keys]
    out = rows.groupBy(*key_cols).agg(*plain) if plain else rows.select(*key_cols).distinct()
    if medians:
        table = grouped_quantiles(rows, keys, medians, [0.5])
        table = table.select(*key_cols, *[F.col(f"q{i}")[0].alias(c) for i, c in enumerate(medians)])
        out = out.join(table, keys, "left")
    return out.select(*key_cols, *[col(c) for c in wanted])
