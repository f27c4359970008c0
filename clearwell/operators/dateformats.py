"""Date formats of text columns, found by votes over all of their values.

A value's shape (its separators and the order of digits and letters) says which family of formats it belongs to. What
the shape leaves open, whether the day or the month comes first, is decided by all values of the column together: a
value that fits one of the two orders only is a vote, and votes are counts that tasks combine.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import col, strip_ws

TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?"
TIME_FORMAT = "[ H:mm[:ss]]['T'H:mm[:ss]]"


@dataclass(frozen=True)
class Family:
    """Values of one shape, and the formats they may have; of equally good ones the first is taken."""

    shape: str
    formats: tuple[str, ...]


def _orders(separator: str, year: str, digits: str) -> Family:
    mark = separator.replace(".", "[.]")
    orders = (f"M{separator}d{separator}{year}", f"d{separator}M{separator}{year}")
    if separator == ".":
        orders = orders[::-1]  # dots are written where the day comes first
    return Family(rf"^\d{{1,2}}{mark}\d{{1,2}}{mark}\d{{{digits}}}{TIME}$", orders)


FAMILIES = (
    *[_orders(s, y, n) for s in ("/", "-", ".") for y, n in (("yyyy", "4"), ("yy", "2"))],
    *[Family(rf"^\d{{4}}{m}\d{{1,2}}{m}\d{{1,2}}{TIME}$", (f"yyyy{s}M{s}d",)) for s, m in (("/", "/"), (".", "[.]"))],
    Family(rf"^\d{{1,2}}[ -][A-Za-z]{{3}}[ -]\d{{4}}{TIME}$", ("d MMM yyyy", "d-MMM-yyyy")),
    Family(rf"^\d{{1,2}} [A-Za-z]{{4,}} \d{{4}}{TIME}$", ("d MMMM yyyy",)),
    Family(rf"^[A-Za-z]{{3}} \d{{1,2}}, \d{{4}}{TIME}$", ("MMM d, yyyy",)),
    Family(rf"^[A-Za-z]{{4,}} \d{{1,2}}, \d{{4}}{TIME}$", ("MMMM d, yyyy",)),
    Family(r"^(?:19|20)\d{6}$", ("yyyyMMdd",)),
)
#: What Spark reads without a format: ISO dates and times, not plain digits.
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T].*)?$|^\d{4}(?:-\d{1,2})?$"


@dataclass
class Formats:
    """What a column's values are. ``known``: values that are not blank; ``read``: those that ``formats`` read (the ISO
    forms first); ``votes``: by format, how many values it reads; ``unsettled``: pairs of orders that all values of
    their shape fit equally well."""

    known: int
    read: int
    formats: list[str]
    votes: dict[str, int] = field(default_factory=dict)
    unsettled: list[tuple[str, str]] = field(default_factory=list)


def _read(text: Column, family: Family, pattern: str) -> Column:
    timed = pattern if pattern == "yyyyMMdd" else pattern + TIME_FORMAT
    return F.when(text.rlike(family.shape), F.try_to_timestamp(text, F.lit(timed)))


def _iso(text: Column) -> Column:
    return F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp"))


def infer_formats(df: DataFrame, columns: list[str]) -> dict[str, Formats]:
    """One aggregation over all ``columns``, text."""
    measures = []
    for i, c in enumerate(columns):
        text = strip_ws(col(c))
        measures += [F.count_if(text != "").alias(f"known_{i}"), F.count(_iso(text)).alias(f"iso_{i}")]
        for j, family in enumerate(FAMILIES):
            measures += [F.count(_read(text, family, p)).alias(f"votes_{i}_{j}_{k}") for k, p in enumerate(family.formats)]
    row = df.agg(*measures).first()
    out = {}
    for i, c in enumerate(columns):
        found = Formats(row[f"known_{i}"], row[f"iso_{i}"], [])
        for j, family in enumerate(FAMILIES):
            votes = [row[f"votes_{i}_{j}_{k}"] for k in range(len(family.formats))]
            best = max(votes)
            if not best:
                continue
            found.votes |= dict(zip(family.formats, votes))
            found.formats.append(family.formats[votes.index(best)])
            found.read += best
            if votes.count(best) > 1 and family.formats[0][0] in "Md" and "MMM" not in family.formats[0]:
                found.unsettled.append(family.formats)
        out[c] = found
    return out


def parse_inferred(c: str, found: Formats) -> Column:
    """The column as timestamps; values that none of its formats reads become null."""
    text = strip_ws(col(c))
    by_format = {p: family for family in FAMILIES for p in family.formats}
    return F.coalesce(_iso(text), *[_read(text, by_format[p], p) for p in found.formats])


def warn_of(c: str, found: Formats) -> None:
    """Say what was not certain about a column."""
    for first, second in found.unsettled:
        warnings.warn(f"cast_types: every value of {c} reads as {first} and as {second}; {first} is taken")
    if found.read < found.known:
        warnings.warn(f"cast_types: {found.known - found.read} values of {c} are no dates in {found.formats or ['ISO']}")
