"""Exact quantiles without holding a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer, which does not scale to
a hot group. Here a fixed-size sketch first brackets each wanted rank, then only the values inside the bracket
are grouped, counted and ranked; everything below a bracket collapses to one count before the shuffle. The
result is exact (linear interpolation between the two neighbouring ranks).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import col, nan_to_null
from ..session import materialize

SKETCH_ACCURACY = 10_000
GROUP_ACCURACY = 10_000
# Distinct values that one task ranks for one group at most.
MOST_RANKED = 1_000_000
# Brackets with more values than this are narrowed before they are ranked.
MOST_INSIDE = 2_000_000


def grouped_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probs: Sequence[float],
    accuracy: int = GROUP_ACCURACY,
    most_ranked: int = MOST_RANKED,
) -> DataFrame:
    """One row per key group: the keys and, for the i-th of ``values``, ``n{i}`` (known values) and ``q{i}`` (array,
    one entry per probability, null without values). Keys must not be null.

    One aggregation sketches all columns and is written, one row per group. Groups so large that a bracket may hold more
    than ``most_ranked`` values are narrowed in rounds that read these groups only; there are at most
    ``rows / (most_ranked * accuracy / 16)`` of them. At last each group ranks what is left in its brackets, at most
    ``most_ranked`` distinct values a task, whatever the group's size.
    """
    keys = list(keys)
    data = rows.select(
        *[col(k) for k in keys],
        *[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"__v{i}") for i, c in enumerate(values)],
    )
    sketches = materialize(data.groupBy(*keys).agg(*_sketches(len(values), probs, accuracy)))
    brackets = _narrowed(data, sketches, keys, len(values), probs, accuracy, most_ranked)
    ranked = _ranked(data, brackets, keys, len(values), probs)
    m = len(probs)
    out = sketches.select(*keys, *[f"__n{i}" for i in range(len(values))]).join(ranked, keys, "left")
    entries = [[F.col("__q")[i * m + j] for j in range(m)] for i in range(len(values))]
    return out.select(
        *keys,
        *[F.col(f"__n{i}").alias(f"n{i}") for i in range(len(values))],
        *[F.when(F.col(f"__n{i}") > 0, F.array(*entries[i])).alias(f"q{i}") for i in range(len(values))],
    )


def _sketches(columns: int, probs: Sequence[float], accuracy: int) -> list[Column]:
    # Three times the rank error the sketch guarantees.
    margin = 3.0 / accuracy
    ends = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    out = []
    for i in range(columns):
        v = F.col(f"__v{i}")
        out += [F.count(v).alias(f"__n{i}"), F.percentile_approx(v, ends, accuracy).alias(f"__b{i}")]
    return out


def _positions(columns: int, probs: Sequence[float]) -> list[Column]:
    return [F.lit(float(p)) * (F.col("__n")[i] - 1) for i in range(columns) for p in probs]


def _narrowed(data, sketches, keys, columns: int, probs, accuracy: int, most_ranked: int) -> DataFrame:
    """Per group ``__n`` (by column), ``__lo`` and ``__hi`` (by rank): each rank's values lie in its bracket, and no more
    than ``most_ranked`` others."""
    margin, m = 3.0 / accuracy, len(probs)
    lows, highs = [], []
    for i in range(columns):
        # up to so many values the margin is less than the distance to the next rank, and a sketch holds them all
        whole, bounds = F.col(f"__n{i}") <= accuracy, F.col(f"__b{i}")
        for j, p in enumerate(probs):
            lows.append(F.when(whole | F.lit(p <= margin), float("-inf")).otherwise(bounds[j]))
            highs.append(F.when(whole | F.lit(p >= 1 - margin), float("inf")).otherwise(bounds[m + j]))
    sizes = [F.col(f"__n{i}") for i in range(columns)]
    # beside the ends of a bracket, the margins and the sketch's errors leave less than 16 / accuracy of the values
    large = F.greatest(*sizes, F.lit(0)) > F.lit(max(accuracy, most_ranked * accuracy // 16))
    brackets = sketches.select(
        *keys, F.array(*sizes).alias("__n"), F.array(*lows).alias("__lo"), F.array(*highs).alias("__hi"), large.alias("__full")
    )
    done = [brackets.filter("not __full").drop("__full")]
    full = brackets.filter("__full")
    for _ in range(64):
        if full.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        halved = materialize(_halved(data, full.drop("__full"), keys, columns, probs, accuracy, most_ranked))
        done.append(halved.filter("not __full").drop("__full"))
        full = halved.filter("__full")
    raise RuntimeError("quantile brackets do not get narrower")


def _halved(data, brackets, keys, columns: int, probs, accuracy: int, most_ranked: int) -> DataFrame:
    """One round: values below, at and inside each bracket are counted and those inside sketched; ``__full`` marks groups
    whose brackets became narrower and are to be looked at again."""
    m, grid = len(probs), max(4, min(256, accuracy // 8))
    joined = data.join(F.broadcast(brackets), keys)
    counts = []
    for r in range(columns * m):
        v, lo, hi = F.col(f"__v{r // m}"), F.col("__lo")[r], F.col("__hi")[r]
        inner = (v > lo) & (v < hi)
        steps = [k / grid for k in range(grid + 1)]
        counts += [
            F.count_if(v <= lo).alias(f"__to{r}"),
            F.count_if(inner).alias(f"__in{r}"),
            F.percentile_approx(F.when(inner, v), steps, accuracy).alias(f"__g{r}"),
        ]
    first = [F.first(c).alias(c) for c in ("__n", "__lo", "__hi")]
    seen = joined.groupBy(*keys).agg(*first, *counts)
    lows, highs, full = [], [], []
    for r, position in enumerate(_positions(columns, probs)):
        lo, hi = F.col("__lo")[r], F.col("__hi")[r]
        to, inside, cells = F.col(f"__to{r}"), F.col(f"__in{r}"), F.col(f"__g{r}")
        # indexes, among the values inside, of the two the quantile lies between
        first_at, last_at = F.floor(position) - to, F.ceil(position) - to
        left = F.floor(F.try_divide(first_at * grid, inside)).cast("int") - 1
        right = F.ceil(F.try_divide(last_at * grid, inside)).cast("int") + 1
        narrow = inside > most_ranked
        none = F.col("__n")[r // m] == 0
        lows.append(
            F.when(none | (last_at < 0), lo).when(first_at >= inside, hi)
            .when(narrow & (left > 0), F.get(cells, left)).otherwise(lo)
        )
        highs.append(
            F.when(none | (first_at >= inside), hi).when(last_at < 0, lo)
            .when(narrow & (right < grid), F.get(cells, right)).otherwise(hi)
        )
        full.append(~none & narrow & (last_at >= 0) & (first_at < inside))
    return seen.select(
        *keys, "__n", F.array(*lows).alias("__lo"), F.array(*highs).alias("__hi"),
        functools.reduce(lambda a, b: a | b, full).alias("__full"),
    )


def _ranked(data, brackets, keys, columns: int, probs) -> DataFrame:
    """Per group ``__q``: the quantile of each rank."""
    m = len(probs)
    joined = data.join(brackets, keys)
    marks = []
    for r in range(columns * m):
        v = F.col(f"__v{r // m}")
        inside = F.when(v >= F.col("__lo")[r], v)
        marks.append(F.when(v <= F.col("__hi")[r], F.struct(F.lit(r).alias("r"), inside.alias("x"))))
    # values below a bracket are the one null value of its rank: counted, not kept apart
    counted = (
        joined.select(*keys, "__n", F.explode(F.array(*marks)).alias("__m"))
        .filter("__m is not null")
        .groupBy(*keys, F.col("__m.r").alias("__r"), F.col("__m.x").alias("__x"))
        .agg(F.first("__n").alias("__n"), F.count(F.lit(1)).alias("__c"))
    )
    w = Window.partitionBy(*keys, "__r").orderBy(F.asc_nulls_first("__x"))
    running = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    position = F.element_at(F.array(*_positions(columns, probs)), F.col("__r") + 1)
    placed = counted.select(*keys, "__r", "__x", "__c", running.alias("__cum"), position.alias("__pos"))
    found = placed.groupBy(*keys, "__r", "__pos").agg(
        F.min(F.when(F.col("__cum") > F.floor("__pos"), F.col("__x"))).alias("__a"),
        F.min(F.when(F.col("__cum") > F.ceil("__pos"), F.col("__x"))).alias("__z"),
        F.coalesce(F.max(F.when(F.col("__x").isNull(), F.col("__c"))), F.lit(0)).alias("__below"),
    )
    ok = (F.col("__below") <= F.floor("__pos")) & F.col("__z").isNotNull()
    exact = F.when(ok, _between("__a", "__z", "__pos")).otherwise(_missed())
    return found.select(*keys, "__r", exact.alias("__q")).groupBy(*keys).agg(
        F.array(*[F.max(F.when(F.col("__r") == r, F.col("__q"))) for r in range(columns * m)]).alias("__q")
    )


@dataclass
class _Rank:
    """One wanted rank of one column: everything in [lo, hi], with ``below`` values under it, may be it."""

    column: int
    size: int
    prob: float
    lo: float = float("-inf")
    hi: float = float("inf")
    below: int = 0
    inside: int = 0
    done: bool = False

    @property
    def position(self) -> float:
        return self.prob * (self.size - 1)

    def holds(self) -> bool:
        return self.below <= math.floor(self.position) and math.ceil(self.position) < self.below + self.inside

    def within(self):
        v = F.col(f"v{self.column}")
        return (v >= F.lit(self.lo)) & (v <= F.lit(self.hi))


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    accuracy: int = SKETCH_ACCURACY,
    most_inside: int = MOST_INSIDE,
) -> dict[str, list[float]]:
    """Quantiles of several numeric columns of one frame, by column; all-null columns are absent.

    Runs a few jobs that scan these columns, shuffle none of their rows and return a few numbers a column:
    sketches, then counts below and inside the brackets, again while a bracket is too full, then the ranking of
    what is inside. The way is the same at every size.
    """
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    data = df.select(
        *[nan_to_null(col(c), types[c]).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    )
    names = data.columns
    margin = 3.0 / accuracy
    ends = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    row = data.agg(
        *[F.count(v).alias(f"n_{v}") for v in names],
        *[F.percentile_approx(v, ends, accuracy).alias(f"b_{v}") for v in names],
    ).first()
    sizes = [row[f"n_{v}"] for v in names]
    m = len(probs)
    ranks = []
    for i, n in enumerate(sizes):
        for j, p in enumerate(probs):
            if n:
                rank = _Rank(i, n, p)
                bounds = row[f"b_v{i}"]
                rank.lo = bounds[j] if ends[j] > 0 else rank.lo
                rank.hi = bounds[m + j] if ends[m + j] < 1 else rank.hi
                ranks.append(rank)
    if not ranks:
        return {}
    _count(data, ranks)
    for rank in ranks:
        if not rank.holds():
            rank.lo, rank.hi = float("-inf"), float("inf")
    _count(data, [r for r in ranks if not r.holds()])
    while full := [r for r in ranks if r.inside > most_inside and r.lo < r.hi and not r.done]:
        _narrow(data, full, margin, accuracy)
    values = _pick(data, ranks)
    out: dict[str, list[float]] = {}
    for rank, value in zip(ranks, values):
        out.setdefault(columns[rank.column], []).append(value)
    return out


def _count(data: DataFrame, ranks: list[_Rank]) -> None:
    if not ranks:
        return
    row = data.agg(
        *[F.count_if(F.col(f"v{r.column}") < F.lit(r.lo)).alias(f"below_{k}") for k, r in enumerate(ranks)],
        *[F.count_if(r.within()).alias(f"inside_{k}") for k, r in enumerate(ranks)],
    ).first()
    for k, rank in enumerate(ranks):
        rank.below, rank.inside = row[f"below_{k}"], row[f"inside_{k}"]


def _narrow(data: DataFrame, ranks: list[_Rank], margin: float, accuracy: int) -> None:
    """Bracket each rank anew among the values inside its bracket."""
    ends = []
    for r in ranks:
        first, last = (f(r.position) - r.below for f in (math.floor, math.ceil))
        span = max(r.inside - 1, 1)
        ends.append([max(0.0, first / span - margin), min(1.0, last / span + margin)])
    row = data.agg(
        *[
            F.percentile_approx(F.when(r.within(), F.col(f"v{r.column}")), e, accuracy).alias(f"b_{k}")
            for k, (r, e) in enumerate(zip(ranks, ends))
        ]
    ).first()
    old = [(r.lo, r.hi, r.below, r.inside) for r in ranks]
    for k, rank in enumerate(ranks):
        rank.lo, rank.hi = row[f"b_{k}"]
    _count(data, ranks)
    for rank, (lo, hi, below, inside) in zip(ranks, old):
        if not rank.holds() or rank.inside == inside:
            # No progress (a few values fill the bracket); grouping collapses them when they are ranked.
            rank.lo, rank.hi, rank.below, rank.inside, rank.done = lo, hi, below, inside, True


def _pick(data: DataFrame, ranks: list[_Rank]) -> list[float]:
    inside = [r.within() for r in ranks]
    entries = [
        F.when(hit, F.struct(F.lit(k).alias("r"), F.col(f"v{rank.column}").alias("x")))
        for k, (rank, hit) in enumerate(zip(ranks, inside))
    ]
    counted = (
        data.filter(functools.reduce(lambda a, b: a | b, inside))
        .select(F.explode(F.array(*entries)).alias("e"))
        .filter("e is not null")
        .groupBy(F.col("e.r").alias("r"), F.col("e.x").alias("x"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    running = Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = F.element_at(F.lit([r.below for r in ranks]).cast("array<bigint>"), F.col("r") + 1)
    position = F.element_at(F.lit([float(r.position) for r in ranks]), F.col("r") + 1)
    placed = counted.select("r", "x", (offsets + F.sum("c").over(running)).alias("cum"), position.alias("pos"))
    found = placed.groupBy("r", "pos").agg(
        F.min(F.when(F.col("cum") > F.floor("pos"), F.col("x"))).alias("a"),
        F.min(F.when(F.col("cum") > F.ceil("pos"), F.col("x"))).alias("z"),
    )
    got = {r["r"]: r["q"] for r in found.select("r", _between("a", "z", "pos").alias("q")).collect()}
    return [got[k] for k in range(len(ranks))]


def _between(a: str, z: str, pos: str):
    return F.col(a) + (F.col(z) - F.col(a)) * (F.col(pos) - F.floor(pos))


def _missed():
    # The sketch guarantees its brackets; a violation must never pass as a wrong number.
    return F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
