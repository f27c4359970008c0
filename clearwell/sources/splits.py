"""Records of files that cannot be cut at every line: delimited text with quoted line breaks, JSON documents.

A file is read in pieces that end at a separator (a line break, or the comma after an object), which Spark splits over
tasks like lines. Whether a separator ends a record depends on all that comes before it: whether a quote is open, and
how many brackets are. So each piece is taken as a function of that state: where it leads from either quote state, and
how far it opens or closes brackets from each. Functions of pieces are composed within a file split by a running window,
those of splits within a file by another one over a row per split, which gives the state that each split begins in.
Pieces of one record are then joined within their split, and the first and last record of each split with those of its
neighbours. No task holds more than a split and the records that cross its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block"]


def pieces(spark: SparkSession, path, separator: str, encoding: str = "utf-8") -> DataFrame:
    """(file, block, id, text): ``block`` is where the split begins, ``id`` rises within it."""
    lines = spark.read.option("encoding", encoding).option("lineSep", separator).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("text"),
    )


def quote_steps(text: Column, separator: str) -> tuple[Column, Column]:
    """Whether a quoted field is open after a line of delimited text, if none or one was open before it.

    A quote opens a field only where the field begins; in a quoted field a doubled quote is a character, and what
    follows the closing quote up to the next separator belongs to the field.
    """
    fields = F.split(text, rf"\Q{separator}\E", -1)

    def step(state: Column, field: Column) -> Column:
        opens = field.startswith('"') & ~F.contains(F.replace(F.substring(field, 2, 2**31 - 1), F.lit('""'), F.lit("")), F.lit('"'))
        stays = ~F.contains(F.replace(field, F.lit('""'), F.lit("")), F.lit('"'))
        return F.struct(
            F.when(state["none"], stays).otherwise(opens).alias("none"),
            F.when(state["one"], stays).otherwise(opens).alias("one"),
        )

    start = F.struct(F.lit(False).alias("none"), F.lit(True).alias("one"))
    found = F.aggregate(fields, start, step)
    quoted = F.contains(text, F.lit('"'))
    return F.when(quoted, found["none"]).otherwise(False), F.when(quoted, found["one"]).otherwise(True)


#: Behind a closing bracket there may be another one, a comma, or nothing.
NO_SEQUEL = r"[\]}]\s*[^\s\]},]"


def _plain(text: Column) -> Column:
    """JSON without escaped characters, so that every quote opens or closes a string."""
    return F.regexp_replace(text, r"(?s)\\.", "")


def _outside(plain: Column, begins_inside: bool) -> Column:
    """What is not in strings."""
    whole = F.concat(F.lit('"'), plain) if begins_inside else plain
    return F.regexp_replace(whole, r'"[^"]*(?:"|$)', "")


def json_steps(text: Column) -> tuple[Column, Column, Column, Column]:
    """Of a piece of JSON: whether a string is open after it, and by how many brackets it goes deeper, each for a piece
    that begins outside and inside of a string."""
    plain = _plain(text)
    odd = F.length(F.regexp_replace(plain, '[^"]', "")) % 2 == 1

    def deeper(c: Column) -> Column:
        return F.length(F.regexp_replace(c, r"[^\[{]", "")) - F.length(F.regexp_replace(c, r"[^\]}]", ""))

    return odd, ~odd, deeper(_outside(plain, False)), deeper(_outside(plain, True))


def _composed(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """``df`` (rows that are functions: ``to0``, ``to1``, ``deep0``, ``deep1``) with the state before each row if its
    group begins outside (``open0``, ``level0``) and inside of quotes (``open1``, ``level1``)."""
    w = Window.partitionBy(*group).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row either sets the state, whatever it was, or swaps it or leaves it
    swaps = (F.col("to0") & ~F.col("to1")).cast("long")
    sets = F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("value"), F.col("__swaps").alias("swaps")))
    df = df.withColumn("__swaps", F.sum(swaps).over(upto))
    df = df.withColumn("__set", F.last(sets, ignorenulls=True).over(before))
    df = df.withColumn("__past", F.coalesce(F.lag("__swaps").over(w), F.lit(0)))
    turned = (F.col("__past") - F.coalesce("__set.swaps", F.lit(0))) % 2 == 1
    df = df.withColumns({f"open{s}": F.coalesce("__set.value", F.lit(bool(s))) != turned for s in (0, 1)})
    deep = {s: F.when(F.col(f"open{s}"), F.col("deep1")).otherwise(F.col("deep0")) for s in (0, 1)}
    df = df.withColumns({f"level{s}": F.coalesce(F.sum(deep[s]).over(before), F.lit(0)) for s in (0, 1)})
    return df.drop("__swaps", "__set", "__past")


def _whole(composed: DataFrame, group: list[str], order: str) -> DataFrame:
    """One row per group: the function that its rows make together, and ``last``, its last row's ``order``."""
    parts = []
    for s in (0, 1):
        open_, level = F.col(f"open{s}"), F.col(f"level{s}")
        parts.append(F.when(open_, F.col("to1")).otherwise(F.col("to0")).alias(f"to{s}"))
        parts.append((level + F.when(open_, F.col("deep1")).otherwise(F.col("deep0"))).alias(f"deep{s}"))
    end = F.max_by(F.struct(*parts, F.col(order).alias("last")), order).alias("__end")
    return composed.groupBy(*group).agg(end).select(*group, "__end.*")


def with_state(functions: DataFrame) -> DataFrame:
    """``functions`` (file, block, id, to0, to1, deep0, deep1 and more) with the state before each piece: ``open``,
    ``level``; and ``final``, whether it is the last of its file."""
    slim = functions.select("file", "block", "id", "to0", "to1", "deep0", "deep1")
    splits = _whole(_composed(slim, SPLIT, "id"), SPLIT, "id")
    known = _composed(splits, ["file"], "block")
    following = F.lead("block").over(Window.partitionBy("file").orderBy("block"))
    known = known.select(
        *SPLIT, F.col("open0").alias("__open"), F.col("level0").alias("__level"),
        F.when(following.isNull(), F.col("last")).alias("__last"),
    )
    placed = _composed(functions, SPLIT, "id").join(known, SPLIT)
    return placed.select(
        *functions.columns,
        F.when(F.col("__open"), F.col("open1")).otherwise(F.col("open0")).alias("open"),
        (F.col("__level") + F.when(F.col("__open"), F.col("level1")).otherwise(F.col("level0"))).alias("level"),
        F.coalesce(F.col("id") == F.col("__last"), F.lit(False)).alias("final"),
    )


def joined(placed: DataFrame, starts: Column, glue: str = "", flags: tuple[str, ...] = ()) -> DataFrame:
    """(file, text and flags): pieces from each one that ``starts`` a record up to the next. A flag is set where it is
    set for one of the pieces."""
    marks = [F.bool_or(f).alias(f) for f in flags]
    w = Window.partitionBy(*SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy(*SPLIT)
    counted = placed.withColumn("__start", starts.cast("int"))
    counted = counted.withColumn("record", F.sum("__start").over(w)).withColumn("__records", F.sum("__start").over(all_rows))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])
    records = counted.groupBy(*SPLIT, "record").agg(
        F.array_join(listed, glue).alias("text"), *marks, F.max("__records").alias("__records")
    )
    at_end = (F.col("record") == 0) | (F.col("record") == F.col("__records"))
    inner = records.filter(~at_end).select("file", "text", *flags)
    # what precedes a split's first record goes on from the last record before it
    running = Window.partitionBy("file").orderBy("block", "record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = records.filter(at_end).withColumn("__key", F.sum((F.col("record") > 0).cast("int")).over(running))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "record", "text"))), lambda x: x["text"])
    crossing = ends.groupBy("file", "__key").agg(F.array_join(texts, glue).alias("text"), *marks)
    return inner.unionByName(crossing.drop("__key"))


def quoted_records(spark: SparkSession, path, separator: str, encoding: str, skip: int) -> DataFrame:
    """(value): the records of delimited files whose quoted fields may hold line breaks, without header lines.

    The first ``skip`` lines of a file are left out and the line after them is its header; without ``skip`` the header
    is the first line that is not blank.
    """
    lines = pieces(spark, path, "\n", encoding).withColumn("text", F.regexp_replace("text", "\r$", ""))
    if skip:
        counts = lines.groupBy(*SPLIT).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("past", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        here = counts.filter((F.col("past") <= skip) & (F.col("past") + F.col("n") > skip))
        head = here.select("file", F.struct("block", (F.col("id") + skip - F.col("past")).alias("id")).alias("__header"))
    else:
        head = lines.filter(F.trim("text") != "").groupBy("file").agg(F.min(F.struct("block", "id")).alias("__header"))
    body = lines.join(head, "file").filter(F.struct("block", "id") > F.col("__header")).drop("__header")
    none, one = quote_steps(F.col("text"), separator)
    zero = F.lit(0)
    functions = body.select("*", none.alias("to0"), one.alias("to1"), zero.alias("deep0"), zero.alias("deep1"))
    return joined(with_state(functions), ~F.col("open"), "\n").filter("trim(text) <> ''").select(F.col("text").alias("value"))


def _json_pieces(spark: SparkSession, path, separator: str) -> DataFrame:
    """Pieces of JSON documents, each with its separator, and ``first``, ``final``; ``bad`` marks what lies behind the
    end of a file's first value."""
    some = pieces(spark, path, separator)
    steps = json_steps(F.concat("text", F.lit(separator[:-1])))
    placed = with_state(some.select("*", *[c.alias(n) for c, n in zip(steps, ("to0", "to1", "deep0", "deep1"))]))
    placed = placed.withColumn("first", (F.col("block") == 0) & (F.row_number().over(Window.partitionBy(*SPLIT).orderBy("id")) == 1))
    placed = placed.withColumn("text", F.when(F.col("final"), F.col("text")).otherwise(F.concat("text", F.lit(separator))))
    plain = _plain(F.col("text"))
    outside = F.when(F.col("open"), _outside(plain, True)).otherwise(_outside(plain, False))
    behind = ~F.col("first") & ~F.col("open") & (F.col("level") <= 0) & (F.trim("text") != "")
    # the last piece ends without the separator that its function takes it to have
    end = F.col("level") + F.when(F.col("open"), F.col("deep1")).otherwise(F.col("deep0")) + separator.count("}")
    uneven = F.col("final") & (end != 0)
    return placed.withColumn("bad", behind | uneven | F.regexp_like(outside, F.lit(NO_SEQUEL)))


def holds_one_value(spark: SparkSession, path) -> bool:
    """Whether no document goes on behind its first value."""
    return _json_pieces(spark, path, ",").filter("bad").isEmpty()


def array_elements(spark: SparkSession, path, of_objects: bool) -> DataFrame:
    """(file, value, bad): the elements of documents that are one JSON list, a few to a row, each row as a list of its
    own. ``bad`` marks rows with something behind the list's end.

    Lists of objects are cut behind objects only, which makes fewer and larger pieces.
    """
    placed = _json_pieces(spark, path, "}," if of_objects else ",")
    starts = F.col("first") | (~F.col("open") & (F.col("level") <= 1))
    found = joined(placed, starts, flags=("first", "final", "bad"))
    text = F.when(F.col("final"), F.regexp_replace("text", r"\]\s*$", "")).otherwise(F.regexp_replace("text", ",$", ""))
    text = F.when(F.col("first"), F.regexp_replace(text, r"^\x{feff}?\s*\[", "")).otherwise(text)
    value = F.concat(F.lit("["), text, F.lit("]"))
    # the last one may still hold the list's end and more: as the only element of a list it must be one value
    ends = F.regexp_like("text", F.lit(r"\]\s*$")) & (F.size(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")) == 1)
    bad = F.col("bad") | (F.col("final") & ~F.coalesce(ends, F.lit(False)))
    return found.select("file", value.alias("value"), bad.alias("bad"))
