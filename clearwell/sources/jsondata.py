"""JSON shapes: records inside documents, nested objects, response bodies."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col
from .splits import array_elements, holds_one_value

# Keys that may hold the records of a document, in order.
RECORD_KEYS = ("data", "results", "records", "items", "rows")


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested objects become columns ``a.b``; lists stay as they are."""

    def leaves(c: Column, name: str, dtype: T.DataType) -> list[Column]:
        if not isinstance(dtype, T.StructType):
            return [c.alias(name)]
        return [x for f in dtype.fields for x in leaves(c.getField(f.name), f"{name}{separator}{f.name}", f.dataType)]

    return df.select(*[x for f in df.schema.fields for x in leaves(col(f.name), f.name, f.dataType)])


def unnest(df: DataFrame, key: str) -> DataFrame:
    """Elements of the list column ``key`` as rows."""
    if isinstance(df.schema[key].dataType.elementType, T.StructType):
        return df.select(F.inline(col(key)))
    return df.select(F.explode(col(key)).alias("0"))


def records_of_document(doc: DataFrame) -> DataFrame:
    """Rows of the first record key that holds a list, else the flattened document."""
    for key in RECORD_KEYS:
        if key in doc.columns and isinstance(doc.schema[key].dataType, T.ArrayType):
            return unnest(doc, key)
    return flatten(doc)


FIRST_LINES = 5


def _complete(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def holds_lines(path: str, first: list[str]) -> bool:
    """Whether a file is one value per line, by its first lines that are not blank: more than one, and one of them
    an object on its own. A bracket alone on the first line opens a document."""
    if path.endswith(".jsonl"):
        return True
    if len(first) < 2 or first[0].strip() in ("[", "{"):
        return False
    return any(line.startswith("{") and _complete(line) for line in first)


def read_json_lines(spark: SparkSession, path: str, schema=None) -> tuple[DataFrame, DataFrame]:
    """Rows of the lines that are objects, and the other lines as ``line``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if schema is None:
        found = spark.read.json(path).schema
        schema = T.StructType([f for f in found.fields if f.name != "_corrupt_record"])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wanted = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", wanted, {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.filter(~bad).select("r.*").drop("__bad"), parsed.filter(bad).select(F.col("value").alias("line"))


def _read_list(spark: SparkSession, path: str, schema, of_objects: bool) -> DataFrame:
    """The elements of documents that are one list, each document read by many tasks."""
    found = array_elements(spark, path, of_objects)
    wrong = F.raise_error(F.lit(f"{path} is neither one JSON value nor one object per line")).cast("string")
    values = found.select(F.when(F.col("bad"), wrong).otherwise(F.col("value")).alias("value"))
    reader = spark.read.option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader
    strings = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()
    return DataFrame(reader._jreader.json(getattr(values._jdf, "as")(strings)), spark)


def read_json(spark: SparkSession, path: str, schema=None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of a JSON file, and its lines that could not be read (None for a document).

    A document that is a list is split over tasks; one that is an object is read whole, as the one row it is.
    """
    first = [r[0] for r in spark.read.text(path).filter(F.trim("value") != "").limit(FIRST_LINES).collect()]
    if not first:
        raise ValueError(f"no JSON in {path}")
    if holds_lines(path, first):
        return read_json_lines(spark, path, schema)
    start = "".join(first).lstrip("\ufeff \t\r\n")
    if start.startswith("["):
        return _read_list(spark, path, schema, start[1:].lstrip().startswith("{")), None
    if not holds_one_value(spark, path):
        raise ValueError(f"{path} is neither one JSON value nor one object per line")
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path), None


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, a list of objects, an object with a list of records, a nested object or a single value.

    Lines that are no objects are left out with a warning.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = [r[0] for r in lines.limit(FIRST_LINES).collect()]
    if not first:
        raise ValueError(f"no JSON in {path}")
    start = first[0].lstrip()[:1]
    if start not in ("[", "{") and not holds_lines(path, first):
        value = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return spark.createDataFrame([(value,)], ["value"])
    data, rejects = read_json(spark, path)
    if rejects is None:
        return data if start == "[" else records_of_document(data)
    if n := rejects.count():
        warnings.warn(f"{n} lines of {path} could not be read")
    return data


def records_from_bodies(bodies: DataFrame, body: str, record_schema: str, data_key: str | None = None) -> DataFrame:
    """Records of response bodies held as JSON text, next to the other columns.

    With ``data_key``, an object that has it yields its list, nothing when it is no list. A list yields its
    elements, any other object itself; null and an empty object yield nothing.
    """
    text = F.trim(F.col(body))
    as_list = F.from_json(text, f"array<{record_schema}>")
    single = F.when(
        text.startswith("{") & ~F.regexp_like(text, F.lit(r"^\{\s*\}$")), F.array(F.from_json(text, record_schema))
    )
    if data_key is None:
        records = F.when(text.startswith("["), as_list).otherwise(single)
    else:
        # An object without the key, or with something else under it, has no records.
        held = F.from_json(text, f"struct<`{data_key}`: string>").getField(data_key)
        keyed = F.when(F.trim(held).startswith("["), F.from_json(held, f"array<{record_schema}>"))
        records = F.when(text.startswith("["), as_list).otherwise(keyed)
    rest = [c for c in bodies.columns if c != body]
    exploded = bodies.select(*[col(c) for c in rest], F.explode(records).alias("__r"))
    return exploded.filter("__r is not null").select(*[col(c) for c in rest], "__r.*")
