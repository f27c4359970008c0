"""Type inference for text tables: one aggregation over all columns, done in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, parse_bool, parse_timestamp, strip_ws, to_number, to_whole_number

# Texts that mean "missing" in delimited files, and the spellings of Booleans.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOL_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]
TEXT = T.StringType()


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TEXTS), c)


def convert(c: Column, dtype: T.DataType) -> Column:
    """Text to the given type, null where it does not fit."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.IntegralType):
        return to_whole_number(c, TEXT).try_cast(dtype)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return to_number(c, TEXT).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return parse_bool(c, TEXT)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return parse_timestamp(c, TEXT).cast(dtype)
    return strip_ws(c).try_cast(dtype)


def infer_types(texts: DataFrame, keep_text: tuple[str, ...] = ()) -> dict[str, T.DataType]:
    """Whole numbers, numbers, Booleans or text, the first that all known values of a column fit."""
    names = [c for c in texts.columns if c not in keep_text]
    measures = []
    for i, c in enumerate(names):
        v = col(c)
        measures += [
            F.count(v).alias(f"known_{i}"),
            F.count(to_whole_number(v, TEXT)).alias(f"whole_{i}"),
            F.count(to_number(v, TEXT)).alias(f"number_{i}"),
            F.count_if(v.isin(*BOOL_TEXTS)).alias(f"bool_{i}"),
            F.count_if(v.contains(".") | F.lower(v).contains("e")).alias(f"point_{i}"),
        ]
    found: dict[str, T.DataType] = {c: TEXT for c in texts.columns}
    if not measures:
        return found
    row = texts.agg(*measures).first()
    for i, c in enumerate(names):
        known = row[f"known_{i}"]
        if row[f"whole_{i}"] == known and known and not row[f"point_{i}"]:
            found[c] = T.LongType()
        elif row[f"number_{i}"] == known:
            found[c] = T.DoubleType()
        elif row[f"bool_{i}"] == known:
            found[c] = T.BooleanType()
    return found


def typed(texts: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    return texts.select(*[convert(col(c), types[c]).alias(c) for c in texts.columns])
