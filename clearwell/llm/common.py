"""What the operators of this subpackage share: the query registry, text columns, batches for Python workers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space of every contract here, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"
#: Rows of one Arrow batch; texts may be long, so few.
BATCH_ROWS = 256


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` states the same result in ANSI SQL."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, so other columns can't clash; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def chunks(batches: Iterator, limit: int, text: str = "text") -> Iterator:
    """Record batches cut so that each holds about ``limit`` bytes of text, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(col).fill_null(0))
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


@functools.cache
def _powers(n: int):
    import numpy as np

    odd = 0x9E3779B97F4A7C15
    out = []
    for x in (odd, pow(odd, -1, 1 << 64)):
        factors = np.full(n, x, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out


def mixed(x):
    """Spread the bits of 64-bit integers."""
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def slice_hashes(data, starts, ends):
    """64-bit hashes of slices of a byte array, all at once: differences of running sums, moved to a common place."""
    import numpy as np

    power, inverse = _powers(1 << max(16, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def words_of(strings: list[str]):
    """All words of all strings, A to Z in lower case: the bytes, word starts and ends, and words per string."""
    import numpy as np

    encoded = [s.encode() for s in strings]
    data = np.frombuffer(b" ".join(encoded).lower() + b" ", np.uint8)
    white = (data == 0x20) | (data - np.uint8(0x09) <= 0x0D - 0x09)
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    edge = edge if white[0] else np.append(0, edge)  # the last byte is white
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    return data, starts, ends, np.diff(np.searchsorted(starts, bounds), prepend=0)
