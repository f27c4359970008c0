"""File sources: delimited text, JSON, Parquet."""

from __future__ import annotations

import csv
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col, parse_timestamp
from ..operators.dedup import _as_list
from .splits import quoted_records
from .typing import infer_types, na_to_null, typed

WHOLE_LINE = "__line"


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def require(config: dict, *keys: str) -> None:
    absent = [k for k in keys if k not in config]
    if absent:
        raise ValueError(f"missing required config keys: {absent}")


@dataclass
class DelimitedTable:
    """``data``: the lines that fit. ``rejects``: those that don't, as ``line``."""

    data: DataFrame
    rejects: DataFrame | None


def _header(lines: list[str], sep: str) -> list[str]:
    names: list[str] = []
    for i, raw in enumerate(next(csv.reader(lines, delimiter=sep))):
        base = name = raw.lstrip("\ufeff") or f"Unnamed: {i}"
        n = 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with ``file``, ``block`` and ``place``, the line's position in its file for lines of the first block
    and null elsewhere. It is the row id less the smallest one of the block, from a table with a row per file."""
    numbered = lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    starts = numbered.filter("block = 0").groupBy("file").agg(F.min("id").alias("start"))
    place = F.when(F.col("block") == 0, F.col("id") - F.col("start"))
    return numbered.join(starts, "file", "left").select("value", "file", "block", place.alias("place"))


def leading_lines(lines: DataFrame, count: int) -> DataFrame:
    """(file, place, value): the first lines of each file."""
    return _placed(lines).filter(F.col("place") < count).select("file", "place", "value")


def _skip_leading_lines(lines: DataFrame, count: int) -> DataFrame:
    """Lines of each file without its first ``count``."""
    return _placed(lines).filter(F.col("place").isNull() | (F.col("place") >= count)).select("value")


def _by_header(lines: DataFrame, path, skip: int) -> list[tuple[str, object]]:
    """Header lines, each with what to read for it: the path itself if all files agree, else the list of files."""
    files = lines.inputFiles()
    if not skip:
        lines = lines.filter("trim(value) <> ''")  # blank lines before a header are no header
    if len(files) == 1:
        head = [r[0] for r in lines.limit(skip + 1).collect()]
        return [(head[skip], path)] if len(head) > skip else []
    first = leading_lines(lines, skip + 1).filter(F.col("place") == skip)
    found = first.groupBy("value").agg(F.sort_array(F.collect_list("file")).alias("files"), F.min("file").alias("least"))
    found = found.orderBy("least").collect()
    if len(found) == 1 and len(found[0]["files"]) == len(files):
        return [(found[0]["value"], path)]
    return [(r["value"], list(r["files"])) for r in found]


def _cut_anywhere(spark: SparkSession, path, encoding: str) -> bool:
    """Whether a byte 10 is a line break and nothing else is: not in encodings of two bytes or more for every
    character, and not in files whose lines end in carriage returns alone."""
    if encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32", "ucs")):
        return False
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    return not any("\r" in r[0].rstrip("\r") and not '"' in r[0] for r in lines.limit(1).collect())


def _read_texts(spark, path, names: list[str], sep: str, skip: int, multiline: bool, options: dict) -> DelimitedTable:
    """Files of one header as text columns, and the lines with more fields than it."""
    raw_schema = ", ".join(f"{c} string" for c in [*(f"c{i}" for i in range(len(names))), WHOLE_LINE])
    if multiline and _cut_anywhere(spark, path, options["encoding"]):
        records = quoted_records(spark, path, sep, options["encoding"], skip)
        raw = records.select(F.from_csv("value", raw_schema, options).alias("r")).select("r.*")
    elif skip and multiline:
        # a file read as one block: a record's place is its id less the file's first one
        reader = spark.read.options(header=False, multiLine=True, **options).schema(raw_schema).csv(path)
        ids = reader.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__id"))
        starts = ids.groupBy("__file").agg(F.min("__id").alias("__start"))
        raw = ids.join(starts, "__file").filter(F.col("__id") - F.col("__start") > skip).drop("__file", "__id", "__start")
    elif skip:
        lines = spark.read.option("encoding", options["encoding"]).text(path)
        body = _skip_leading_lines(lines, skip + 1).filter("trim(value) <> ''")
        raw = body.select(F.from_csv("value", raw_schema, options).alias("r")).select("r.*")
    else:
        raw = spark.read.options(header=True, multiLine=multiline, **options).schema(raw_schema).csv(path)
    # A line is kept whole only when its width is not the header's. It is too long when it still reaches the last
    # column; otherwise its fields are counted.
    fields = F.size(F.split(F.regexp_replace(WHOLE_LINE, '"(?:[^"]|"")*"', ""), rf"\Q{sep}\E", -1))
    reaches_end = F.col(f"c{len(names) - 1}").isNotNull()
    # One expression, so that no part of it is evaluated by the parser before the line is set.
    too_long = F.when(F.col(WHOLE_LINE).isNull(), False).otherwise(reaches_end | (fields > len(names)))
    rejects = raw.filter(too_long).select(F.col(WHOLE_LINE).alias("line"))
    texts = raw.filter(~too_long).select(*[na_to_null(F.col(f"c{i}")).alias(name) for i, name in enumerate(names)])
    return DelimitedTable(texts, rejects)


def read_delimited(spark: SparkSession, path, config: dict | None = None) -> DelimitedTable:
    """Config: ``encoding`` ('utf-8'), ``separator`` (','), ``skip_rows`` (0), ``columns``, ``date_columns``,
    ``schema`` (DDL or StructType; spares the inference pass), ``multiline`` (quoted line breaks: files are still
    split, at the cost of a scan that finds out in which state each split begins).

    Each file is read by its own header, and columns meet by name. Lines with too many fields are rejected; short
    lines are padded with nulls.
    """
    config = config or {}
    sep = config.get("separator", ",")
    encoding = config.get("encoding", "utf-8")
    skip = int(config.get("skip_rows", 0) or 0)
    options = {
        "sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": WHOLE_LINE, "columnPruning": "false",
    }
    multiline = bool(config.get("multiline", False))
    lines = spark.read.option("encoding", encoding).text(path)
    groups = _by_header(lines, path, skip)
    if not groups:
        raise ValueError(f"no header line in {path}")
    parts = [_read_texts(spark, files, _header([line], sep), sep, skip, multiline, options) for line, files in groups]
    texts, rejects = parts[0].data, parts[0].rejects
    for part in parts[1:]:
        texts = texts.unionByName(part.data, allowMissingColumns=True)
        rejects = rejects.unionByName(part.rejects)
    names = texts.columns

    columns = _as_list(config.get("columns"))
    unknown = [c for c in columns if c not in names]
    if unknown:
        raise ValueError(f"columns {unknown} not in file, which has {names}")
    if columns:
        texts = texts.select(*[col(c) for c in columns])
    dates = [c for c in _as_list(config.get("date_columns")) if c in texts.columns]
    schema = config.get("schema")
    if schema is not None:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        given = {f.name: f.dataType for f in schema.fields}
        types = {c: given.get(c, T.StringType()) for c in texts.columns}
    else:
        types = infer_types(texts, tuple(dates))
    data = typed(texts, {**types, **{c: T.StringType() for c in dates}})
    if dates:
        data = data.withColumns({c: parse_timestamp(col(c), T.StringType()) for c in dates})
    return DelimitedTable(data, rejects)


def read_file(spark: SparkSession, config: dict) -> DataFrame:
    """``read_table`` without its rejects, of which it warns."""
    read = read_table(spark, config)
    if read.rejects is not None and (n := read.rejects.count()):
        warnings.warn(f"{n} lines of {config['path']} could not be read")
    return read.data


def read_table(spark: SparkSession, config: dict) -> DelimitedTable:
    """Config: ``path`` and the reader's own keys. The extension picks the reader; anything unknown is CSV.

    ``rejects`` holds the lines that could not be read; it is None for formats without lines.
    """
    require(config, "path")
    path = config["path"]
    suffix = suffix_of(path)
    rejects = None
    if suffix == ".xls":
        raise ValueError(".xls files are not supported; save as .xlsx")
    if suffix == ".parquet":
        df = spark.read.parquet(path)
    elif suffix in (".json", ".jsonl"):
        from .jsondata import read_json

        df, rejects = read_json(spark, path, config.get("schema"))
    elif suffix == ".xlsx":
        from .office import read_excel

        df = read_excel(spark, path, config.get("sheet")).data
    else:
        return read_delimited(spark, path, {"separator": "\t" if suffix == ".tsv" else ",", **config})
    columns = _as_list(config.get("columns"))
    return DelimitedTable(df.select(*[col(c) for c in columns]) if columns else df, rejects)


def split_by_encoding(spark: SparkSession, path) -> tuple[list[str], list[str]]:
    """Paths of the files that are valid UTF-8 and of those that are not. The check runs line by line, so a large
    file is split; the two lists are as long as the file listing."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    flags = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).collect()
    return sorted(r["file"] for r in flags if r["ok"]), sorted(r["file"] for r in flags if not r["ok"])


def read_upload(spark: SparkSession, path, config: dict | None = None) -> DataFrame:
    """Delimited files of unknown encoding: UTF-8, else Latin-1, which reads any bytes."""
    config = dict(config or {})
    utf8, other = split_by_encoding(spark, path)
    all_tabs = isinstance(path, str) and suffix_of(path) == ".tsv"  # a folder of part files has its own extension
    parts = []
    for files, encoding in ((utf8, "utf-8"), (other, "iso-8859-1")):
        for sep in ("\t", ","):
            group = [f for f in files if (all_tabs or suffix_of(f) == ".tsv") == (sep == "\t")]
            if group:
                part = {"separator": sep, **config, "encoding": encoding}
                parts.append(read_delimited(spark, group, part).data)
    if other:
        warnings.warn(f"not UTF-8, read as Latin-1: {other}")
    if not parts:
        raise ValueError(f"no lines in {path}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
