"""Paged HTTP responses as a Spark data source.

The fetcher is any function ``fetch(url, params)`` that returns a decoded body; authentication and retries are
its own business. The source yields one row per page with the body as JSON text; records are taken out of the
bodies by ``records_from_bodies`` in parallel.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import require
from .jsondata import records_from_bodies

# Paging defaults.
PAGE_SIZE = 100
BODY_SCHEMA = "page int, body string"


class Pages(InputPartition):
    """``sure``: the pages are known to have successors, so a page without one is an error."""

    def __init__(self, first: int, last: int, sure: bool = False):
        self.first, self.last, self.sure = first, last, sure


def records_in(body, data_key: str | None) -> list:
    """The records of one decoded body, as far as the paging loop needs to know them."""
    if data_key and isinstance(body, dict):
        found = body.get(data_key, [])
        return found if isinstance(found, list) else []
    if isinstance(body, list):
        return body
    return [body] if body else []


def _body(fetch: Callable, config: dict, params: dict, page: int):
    paging = config["pagination"]
    query = {
        **params,
        paging.get("size_param", "per_page"): paging.get("size", PAGE_SIZE),
        paging.get("page_param", "page"): page,
    }
    return fetch(config["url"], query)


def _goes_on(body, config: dict) -> bool:
    """Whether a page has records and names a successor."""
    following = isinstance(body, dict) and body.get(config["pagination"].get("next_key", "next"))
    return bool(records_in(body, config.get("data_key")) and following)


def _pages(fetch: Callable, config: dict, params: dict, span: Pages):
    """Pages of a span until an empty page or one without a successor."""
    paging = config.get("pagination") or {}
    if not paging:
        yield 1, fetch(config["url"], dict(params))
        return
    for page in range(span.first, span.last + 1):
        body = _body(fetch, config, params, page)
        if records_in(body, config.get("data_key")):
            yield page, body
        if not _goes_on(body, config):
            if span.sure:
                raise RuntimeError(f"page {page} is the last of {config['url']}, but there were pages after {span.last}")
            return
    if not span.sure and paging.get("max_pages") and span.last == paging["max_pages"] != paging.get("total_pages"):
        raise RuntimeError(f"there are pages after max_pages, {span.last}")


def last_page(fetch: Callable, config: dict, params: dict, limit: int) -> int:
    """The first page without a successor, found by doubling and bisection: about twice the logarithm of the pages in
    requests. A request that fails counts as behind the end; the walk over the last pages does not rely on it."""

    def goes_on(page: int) -> bool:
        try:
            return _goes_on(_body(fetch, config, params, page), config)
        except Exception:  # noqa: BLE001 - services answer in many ways to a page that is not there
            return page == 1

    low, high = 0, 1
    while high < limit and goes_on(high):
        low, high = high, min(2 * high, limit)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if goes_on(middle) else (low, middle)
    return high


def spans(fetch: Callable, config: dict, params: dict) -> list[Pages]:
    """Ranges of pages, one per task. Without a stated number of pages the end is looked for, all ranges but the last
    are known to go on, and the last one is walked to its end, wherever that is."""
    paging = config.get("pagination") or {}
    limit = paging.get("max_pages") or sys.maxsize
    stated, tasks = paging.get("total_pages"), paging.get("tasks", 8)
    if not paging or (not stated and tasks == 1):
        return [Pages(1, limit)]
    total = min(stated, limit) if stated else last_page(fetch, config, params, limit)
    tasks = min(tasks, total)
    edges = [1 + total * i // tasks for i in range(tasks)] + [total + 1]
    found = [Pages(a, b - 1, sure=not stated) for a, b in zip(edges, edges[1:])]
    if not stated:
        found[-1] = Pages(found[-1].first, limit)
    return found


def read_bodies(spark: SparkSession, config: dict, fetch: Callable, checkpoint: str | None = None) -> DataFrame:
    """(page, body) rows, fetched by several tasks (``pagination.tasks``, 8), each walking a range of pages and handing
    each page on at once. The number of pages is ``pagination.total_pages`` or found with a few requests when the job is
    planned; one task makes none of these. ``pagination.max_pages`` is a safety limit against services that never end;
    the job fails when pages are left beyond it. There is none by default.
    """
    require(config, "url")
    params = dict(config.get("params") or {})
    if checkpoint:
        params["since"] = checkpoint

    class Reader(DataSourceReader):
        def partitions(self):
            return spans(fetch, config, params)

        def read(self, partition):
            for page, body in _pages(fetch, config, params, partition):
                yield page, json.dumps(body)

    source_name = f"paged_bodies_{uuid.uuid4().hex[:8]}"

    class PagedBodies(DataSource):
        @classmethod
        def name(cls):
            return source_name

        def schema(self):
            return BODY_SCHEMA

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(PagedBodies)
    return spark.read.format(source_name).load()


def read_api(spark: SparkSession, config: dict, fetch: Callable, checkpoint: str | None = None) -> DataFrame:
    """Config: ``url``, ``params``, ``pagination`` {page_param, size_param, size, next_key, max_pages},
    ``data_key``, ``schema`` of a record. Without a schema the pages are fetched once more to find it."""
    bodies = read_bodies(spark, config, fetch, checkpoint)
    schema = config.get("schema")
    if schema is None:
        variants = bodies.select(F.schema_of_variant_agg(F.parse_json("body")).alias("s")).first()[0]
        schema = _record_type(spark, variants, config.get("data_key"))
    return records_from_bodies(bodies, "body", schema, config.get("data_key")).drop("page")


def _record_type(spark: SparkSession, body_type: str | None, data_key: str | None) -> str:
    if body_type is None:
        raise ValueError("no response bodies to take a schema from; give one")
    ddl = body_type.replace("OBJECT<", "STRUCT<")
    dtype = spark.sql(f"select from_json(null, 'b {ddl}') as x").schema["x"].dataType["b"].dataType
    if data_key and dtype.typeName() == "struct":
        dtype = dtype[data_key].dataType
    if dtype.typeName() == "array":
        dtype = dtype.elementType
    return dtype.simpleString()
