"""Plain text: delimiter detection and numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import WS_CHARS, col, rstrip_ws, strip_ws
from .files import leading_lines, read_delimited

# Separators in the order they are tried, and the characters that end a line.
SEPARATORS = (",", "\t", "|", ";")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
SNIFFED_LINES = 5


def sniff_separator(lines: list[str]) -> str | None:
    """The first separator that every line holds."""
    return next((s for s in SEPARATORS if lines and all(s in line for line in lines)), None)


def split_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Non-blank lines of each text, right-trimmed and numbered from 1 within it. No shuffle: a text is split
    and numbered inside its row."""
    lines = F.transform(F.split(col(text), LINE_BREAK), rstrip_ws)
    kept = F.filter(lines, lambda line: line != "")
    return df.select(*[col(c) for c in keep], F.posexplode(kept).alias("pos", "text")).select(
        *[col(c) for c in keep], (F.col("pos") + 1).alias("line_number"), "text"
    )


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line_number, text) over the non-blank lines of text files.

    Files stay split. A line's number is its place inside its block plus the lines of the blocks before, which
    come from a table with one row per block.
    """
    lines = spark.read.text(path).select(
        rstrip_ws(F.col("value")).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    lines = lines.filter("text <> ''").withColumn("id", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "block"]).select(
        "file", (F.col("before") + F.col("id") - F.col("first") + 1).cast("long").alias("line_number"), "text"
    )


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table when the first lines agree on a separator, else numbered lines."""
    known = spark.read.text(path).filter(strip_ws(F.col("value")) != "")
    sample = [r[0].rstrip(WS_CHARS) for r in known.limit(SNIFFED_LINES).collect()]
    separator = sniff_separator(sample)
    if separator:
        return read_delimited(spark, path, {"separator": separator}).data
    return numbered_lines(spark, path).drop("file")


def read_text_tables(spark: SparkSession, path) -> dict[str | None, DataFrame]:
    """Many text files at once: one table per separator they agree on, and under None the numbered lines of the
    files without one. Five lines of each file decide."""
    known = spark.read.text(path).filter(strip_ws(F.col("value")) != "")
    samples: dict[str, list[str]] = {}
    for row in leading_lines(known, SNIFFED_LINES).collect():
        samples.setdefault(row["file"], []).append(row["value"])
    groups: dict[str | None, list[str]] = {}
    for file, lines in sorted(samples.items()):
        groups.setdefault(sniff_separator(lines), []).append(file)
    return {
        sep: read_delimited(spark, files, {"separator": sep}).data if sep else numbered_lines(spark, files)
        for sep, files in groups.items()
    }
