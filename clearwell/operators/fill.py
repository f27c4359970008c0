"""Missing values: constants, column statistics, carried values, dropped rows."""

from __future__ import annotations

import datetime as dt
import decimal
import functools
import math
import operator
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, is_numeric, is_temporal, is_text, nan_to_null
from ..session import materialize
from .carry import carry_fill
from .dedup import _as_list
from .quantiles import column_quantiles

TWICE_READ = ("mean", "median", "mode", "ffill", "bfill")


def missing(c: str, dtype: T.DataType) -> Column:
    return nan_to_null(col(c), dtype).isNull()


def _literal(value, dtype: T.DataType) -> tuple[Column, str] | None:
    """The value as a literal of the column's type and the type to use, or None when it does not fit."""
    if value is None:
        return None
    name = dtype.simpleString()
    if is_text(dtype):
        return F.lit(str(value)), "string"
    if isinstance(dtype, T.BooleanType):
        return (F.lit(value), name) if isinstance(value, bool) else None
    if is_numeric(dtype):
        try:
            number = decimal.Decimal(str(value)) if not isinstance(value, bool) else None
        except decimal.InvalidOperation:
            number = None
        if number is None or not number.is_finite():
            return None
        if isinstance(dtype, T.IntegralType) and number != number.to_integral_value():
            return F.lit(float(number)), "double"
        if isinstance(dtype, T.IntegralType) and abs(number) >= 2**31 and not isinstance(dtype, T.LongType):
            name = "bigint"
        return F.lit(str(number)).cast(name), name
    if is_temporal(dtype):
        if isinstance(value, (dt.date, dt.datetime)):
            return F.lit(value).cast(name), name
        try:
            dt.datetime.fromisoformat(str(value))
        except ValueError:
            return None
        return F.lit(str(value)).cast(name), name
    return None


def _constant(df: DataFrame, columns: list[str], value, widen: bool) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for c in columns:
        fitted = _literal(value, types[c])
        if fitted is not None:
            literal, name = fitted
            new[c] = F.coalesce(nan_to_null(col(c), types[c]).cast(name), literal)
        elif widen and value is not None:
            new[c] = F.coalesce(nan_to_null(col(c), types[c]).cast("string"), F.lit(str(value)))
        else:
            warnings.warn(f"fill_missing: {value!r} does not fit {c} ({types[c].simpleString()}); left as is")
    return df.withColumns(new) if new else df


def _exact_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The type in which a column takes a fractional fill without changing what is known: double, a wider decimal for
    decimals, and a decimal for whole numbers that a double does not hold."""
    types = {f.name: f.dataType for f in df.schema.fields}
    longs = [c for c in columns if isinstance(types[c], T.LongType)]
    large = df.agg(*[F.max(F.abs(col(c).cast("decimal(20,0)"))) for c in longs]).first() if longs else ()
    out = {c: "double" for c in columns}
    for c, most in zip(longs, large):
        if most is not None and most > 2**53:
            out[c] = "decimal(23,4)"
    for c in columns:
        if isinstance(types[c], T.DecimalType):
            digits, scale = types[c].precision, types[c].scale
            more = min(4, 38 - digits)
            out[c] = f"decimal({digits + more},{scale + more})"
    return out


def _mean(df: DataFrame, columns: list[str]) -> DataFrame:
    types, wide = {f.name: f.dataType for f in df.schema.fields}, _exact_types(df, columns)
    stats = F.struct(*[F.avg(nan_to_null(col(c), types[c]).cast(wide[c])).cast(wide[c]).alias(c) for c in columns])
    row = df.agg(stats.alias("__s")).scalar()
    return df.withColumns(
        {c: F.coalesce(nan_to_null(col(c), types[c]).cast(wide[c]), row.getField(c)) for c in columns}
    )


def _median(df: DataFrame, columns: list[str], approx: bool) -> DataFrame:
    types, wide = {f.name: f.dataType for f in df.schema.fields}, _exact_types(df, columns)
    if approx:
        stats = F.struct(
            *[
                F.percentile_approx(nan_to_null(col(c), types[c]).cast("double"), 0.5).alias(c)
                for c in columns
            ]
        )
        row = df.agg(stats.alias("__s")).scalar()
        value = {c: row.getField(c) for c in columns}
    else:
        medians = column_quantiles(df, columns, [0.5])
        value = {c: F.lit(medians.get(c, [None])[0]).cast("double") for c in columns}
    return df.withColumns(
        {c: F.coalesce(nan_to_null(col(c), types[c]).cast(wide[c]), value[c].cast(wide[c])) for c in columns}
    )


# Values tracked per column, those of them looked at, and the sketch's error per row: 3.5 over its size, a power of two.
TRACKED, LOOKED_AT = 10_000, 32


def _sketchable(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or is_text(dtype) or is_temporal(dtype) or isinstance(dtype, T.BooleanType)


def most_frequent(df: DataFrame, columns: list[str], tracked: int = TRACKED) -> dict[str, Column]:
    """The most frequent known value of each column as a literal, the smallest one on ties; null without any.

    One aggregation sketches the frequent values of all columns, in bounded memory and with a bounded error; a second one
    counts those exactly that may be the most frequent. Only columns in which a value outside the sketch could be as
    frequent as the best one inside, such as columns of distinct values, are grouped in full.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    slim = df.select(*[nan_to_null(col(c), types[c]).alias(f"c{i}") for i, c in enumerate(columns)])
    sketched = [i for i, c in enumerate(columns) if _sketchable(types[c])]
    asked = []
    for i in sketched:
        top = f"approx_top_k(c{i}, {min(LOOKED_AT, tracked)}, {tracked}) filter (where c{i} is not null)"
        texts = f"transform({top}, x -> struct(cast(x.item as string) as item, x.count as n))"
        asked += [F.expr(texts).alias(f"t{i}"), F.count(f"c{i}").alias(f"n{i}")]
    row = slim.agg(*asked).first() if asked else {}
    error = 3.5 / 2 ** math.ceil(math.log2(tracked / 0.75))
    found: dict[int, Column] = {}
    counts, others = [], {}
    for i in sketched:
        n, top = row[f"n{i}"], row[f"t{i}"] or []
        kind = types[columns[i]].simpleString()
        if not n:
            found[i] = F.lit(None).cast(kind)
        if not n or not top:
            continue
        best = max(t["n"] for t in top)
        near = [F.lit(t["item"]).cast(kind) for t in top if t["n"] >= best - error * n]
        entries = [F.struct((-F.count_if(F.col(f"c{i}") == v)).alias("n"), v.alias("v")) for v in near]
        smallest = F.array_min(F.array(*entries))
        counts += [smallest["n"].alias(f"n{i}"), smallest["v"].cast("string").alias(f"v{i}")]
        # what the list leaves out is at most as frequent as its last entry, or as the sketch's error allows
        others[i] = max(2 * error * n, min(t["n"] for t in top) if len(top) >= min(LOOKED_AT, tracked) else 0)
    exact = slim.agg(*counts).first() if counts else {}
    for i, most in others.items():
        if -exact[f"n{i}"] > most:
            found[i] = F.lit(exact[f"v{i}"]).cast(types[columns[i]].simpleString())
    rest = [i for i in range(len(columns)) if i not in found]
    for start in range(0, len(rest), 30):
        part = rest[start : start + 30]
        picked = _grouped_modes(slim.select(*[f"c{i}" for i in part])).scalar()
        found |= {i: picked.getField(f"c{i}") for i in part}
    return {c: found[i] for i, c in enumerate(columns)}


def _grouped_modes(slim: DataFrame) -> DataFrame:
    """One row with a struct of modes: grouping sets count all values of all columns, combined map-side."""
    names = slim.columns
    counted = slim.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("__n")
    )
    picks = []
    for i, name in enumerate(names):
        # grouping_id has a zero bit at the grouped column, the first column being the highest bit.
        mine = (2 ** len(names) - 1) ^ (1 << (len(names) - 1 - i))
        chosen = (F.col("__g") == mine) & F.col(name).isNotNull()
        order = F.when(chosen, F.struct(-F.col("__n"), F.col(name)))
        picks.append(F.min_by(F.col(name), order).alias(name))
    return counted.agg(F.struct(*picks).alias("__m"))


def _mode(df: DataFrame, columns: list[str], fill_value, widen: bool) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    modes = most_frequent(df, columns)
    # Only an all-null column still has gaps after this; it takes the constant.
    filled = df.withColumns({c: F.coalesce(nan_to_null(col(c), types[c]), modes[c]) for c in columns})
    fits = [c for c in columns if _literal(fill_value, types[c]) or widen]
    return _constant(filled, fits, fill_value, widen)


def fill_missing(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``columns`` (default all), ``strategy``, ``fill_value`` ('UNKNOWN'), ``threshold``, and here also
    ``order_by``/``partition_by``/``rows_per_block`` (carried values), ``approx`` (median), ``widen``.

    ``threshold`` first drops rows whose share of missing values over the columns exceeds it. Mean and median
    apply to numeric columns; other columns get the constant, as with the default strategy; filled decimals stay
    decimals. The exact median, the mode and the carried values run small-result jobs when the plan is built.
    Statistics and carried values read the input more than once: ``stage`` writes it to the shared folder first,
    which pays when expensive rules come before.
    """
    columns = [c for c in (_as_list(config.get("columns")) or df.columns) if c in df.columns]
    strategy = config.get("strategy", "constant")
    fill_value = config.get("fill_value", "UNKNOWN")
    threshold = config.get("threshold")
    widen = bool(config.get("widen", False))
    types = {f.name: f.dataType for f in df.schema.fields}
    if not columns:
        return df

    if threshold is not None:
        gaps = functools.reduce(operator.add, [missing(c, types[c]).cast("int") for c in columns])
        df = df.filter(gaps / F.lit(len(columns)) <= F.lit(float(threshold)))
    if config.get("stage") and strategy in TWICE_READ:
        df = materialize(df)
    if strategy == "drop":
        return df.na.drop(subset=["`" + c + "`" if "." in c else c for c in columns])
    if strategy in ("ffill", "bfill"):
        return carry_fill(
            df,
            columns,
            order_by=_as_list(config.get("order_by")),
            partition_by=_as_list(config.get("partition_by")),
            forward=strategy == "ffill",
            rows_per_block=config.get("rows_per_block"),
        )
    if strategy == "mode":
        return _mode(df, columns, fill_value, widen)
    if strategy in ("mean", "median"):
        numeric = [c for c in columns if is_numeric(types[c])]
        others = [c for c in columns if c not in numeric]
        out = _constant(df, others, fill_value, widen) if others else df
        if not numeric:
            return out
        if strategy == "mean":
            return _mean(out, numeric)
        return _median(out, numeric, bool(config.get("approx", False)))
    return _constant(df, columns, fill_value, widen)
