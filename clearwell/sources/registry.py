"""Source types by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .files import DelimitedTable, read_file, read_table, require, suffix_of
from .jdbc import read_jdbc, read_query

Source = Callable[..., DataFrame]


def _file(spark: SparkSession, config: dict, checkpoint=None) -> DataFrame:
    return read_file(spark, config)


def _sql(spark: SparkSession, config: dict, checkpoint=None) -> DataFrame:
    if config.get("connection_string"):
        return read_jdbc(spark, config, checkpoint)
    require(config, "query")
    return read_query(spark, config, checkpoint)


def _api(spark: SparkSession, config: dict, checkpoint=None) -> DataFrame:
    from .rest import read_api

    require(config, "url", "fetch")
    return read_api(spark, config, config["fetch"], checkpoint)


SOURCES: dict[str, Source] = {
    "csv": _file,
    "tsv": _file,
    "json": _file,
    "parquet": _file,
    "excel": _file,
    "xlsx": _file,
    "postgresql": _sql,
    "mysql": _sql,
    "sqlite": _sql,
    "sql": _sql,
    "api": _api,
    "rest": _api,
}

# Which parser reads an uploaded file, by extension; anything else is read as CSV.
UPLOAD_TYPES = {
    ".csv": "csv", ".tsv": "csv", ".xlsx": "excel", ".json": "json", ".jsonl": "json", ".txt": "txt", ".docx": "docx",
}


# Formats that are recognised but have no reader here.
UNREAD_TYPES = (".pdf", ".xls", ".doc")


def register_source(name: str, source: Source) -> None:
    """Add or replace a source: a function (spark, config, checkpoint) that returns a DataFrame."""
    if not callable(source):
        raise TypeError(f"{source!r} is not callable")
    SOURCES[name.lower()] = source


def list_sources() -> dict[str, str]:
    return {name: source.__name__.lstrip("_") for name, source in SOURCES.items()}


def get_source(config: dict) -> Source:
    kind = str(config.get("type", "")).lower()
    if kind not in SOURCES:
        raise ValueError(f"Unknown source type '{kind}'. Available: {list(SOURCES)}")
    return SOURCES[kind]


def extract(spark: SparkSession, config: dict, checkpoint=None) -> DataFrame:
    return get_source(config)(spark, config, checkpoint)


def extract_table(spark: SparkSession, config: dict, checkpoint=None) -> DelimitedTable:
    """``extract`` with the lines of file sources that could not be read."""
    source = get_source(config)
    if source is _file:
        return read_table(spark, config)
    return DelimitedTable(source(spark, config, checkpoint), None)


def ingest(spark: SparkSession, path: str, file_type: str | None = None, sheet: str | None = None) -> DataFrame:
    """Read an uploaded file by its extension."""
    from .files import read_upload
    from .jsondata import read_json_records
    from .office import read_docx, read_excel
    from .textlines import read_text_table

    if not file_type and suffix_of(path) in UNREAD_TYPES:
        raise ValueError(f"{suffix_of(path)} files are not supported")
    kind = file_type or UPLOAD_TYPES.get(suffix_of(path), "csv")
    if kind == "excel":
        return read_excel(spark, path, sheet).data
    if kind == "docx":
        return read_docx(spark, path).data
    if kind == "json":
        return read_json_records(spark, path)
    if kind == "txt":
        return read_text_table(spark, path)
    return read_upload(spark, path)
