"""Type casts by rule name."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, is_numeric, is_text, parse_bool, parse_timestamp, to_number, to_whole_number
from .dateformats import Formats, infer_formats, parse_inferred, warn_of

# Array-library type names that differ from Spark's.
TYPE_NAMES = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "Int64": "bigint",
    "float32": "float",
    "datetime64[ns]": "timestamp",
    "string": "string",
    "object": "string",
    "category": "string",
    "boolean": "boolean",
}


def _cast(df: DataFrame, name: str, target: str, config: dict, inferred: dict[str, Formats]) -> Column | None:
    dtype = df.schema[name].dataType
    c = col(name)
    if target in ("int", "int64"):
        whole = to_whole_number(c, dtype)
        if config.get("fractional", "null") == "keep":
            number = to_number(c, dtype)
            broken = df.agg(F.max(F.coalesce(number != F.floor(number), F.lit(False))).alias("x"))
            if broken.first()[0]:
                warnings.warn(f"cast_types: {name} holds fractional values; left as is")
                return None
        return whole
    if target in ("float", "float64"):
        return to_number(c, dtype)
    if target in ("datetime", "date"):
        if name in inferred:
            warn_of(name, inferred[name])
            return parse_inferred(name, inferred[name])
        return parse_timestamp(c, dtype, config.get("formats") or ())
    if target == "bool":
        return parse_bool(c, dtype, bool(config.get("truthy", False)))
    if target == "str":
        return c.cast("string")
    ddl = TYPE_NAMES.get(target, target)
    if is_numeric(T.StructType.fromDDL(f"x {ddl}")[0].dataType):
        return to_number(c, dtype).try_cast(ddl)
    return c.try_cast(ddl)


def cast_types(df: DataFrame, config: dict) -> DataFrame:
    """Config: ``mappings`` {column: type}, ``errors`` ('coerce' or 'raise').

    Types: int, float, datetime/date, bool, str or any Spark DDL type. Values that do not fit become null; with
    ``errors='raise'`` they fail the job. Also ``formats`` (timestamp patterns tried in turn; without them they are
    inferred from all values of the column, which runs one job, and what is uncertain is warned of), ``truthy`` (Boolean by emptiness), ``fractional='keep'`` (leave an int column that holds fractions).
    """
    new = {}
    mappings = config.get("mappings") or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    dated = [c for c, t in mappings.items() if t in ("datetime", "date") and c in types and is_text(types[c])]
    # a stream has no whole column to look at: it is read by ISO, or by the formats given
    inferred = infer_formats(df, dated) if dated and not config.get("formats") and not df.isStreaming else {}
    for name, target in mappings.items():
        if name not in df.columns:
            continue
        value = _cast(df, name, target, config, inferred)
        if value is None:
            continue
        if config.get("errors", "coerce") == "raise":
            message = F.concat(F.lit(f"cast_types: {name} to {target}: "), col(name).cast("string"))
            value = F.when(value.isNull() & col(name).isNotNull(), F.raise_error(message)).otherwise(value)
        new[name] = value
    return df.withColumns(new) if new else df
