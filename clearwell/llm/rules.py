"""Quality rules: word statistics of whole texts, and robust multivariate outliers among them.

Statistics are made inside the row by array functions. The verdict on the rows that pass the base rules compares their
transformed statistic vectors with a minimum-covariance-determinant estimate for their language and source: starting
at medians and median deviations, concentration steps keep the ``SHARE`` of rows nearest to the estimate and estimate
anew, which never raises the determinant. One step is one aggregation: moments are summed per group and distance
bucket, so buckets up to the wanted share give the next estimate, and a hot source is combined before its shuffle.
Cholesky factors and Mahalanobis distances are column expressions. Rows beyond ``cut`` are rejected.

Groups of fewer than ``MIN_ROWS`` rows are pooled by language, and if those are too few, judged by an estimate over all
rows. The cut follows the number of rows behind an estimate, so that a small table rejects little. Null language or source is a value of its own. Null and empty texts have no words and fail
the base rules. Repeated rows count and are judged as often as they come.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

SHARE, STEPS, MIN_ROWS = 0.6, 6, 200
#: The chance of a regular row to be rejected, were the transformed statistics normal.
FALSE_ALARM = 1e-4
#: A text without words has none of them. Transformed statistic -> (expression, smallest standard deviation it is taken to have).
FEATURES = {
    "f_words": ("ln(nullif(n_words, 0))", 0.1),
    "f_length": ("ln(word_chars / nullif(n_words, 0))", 0.05),
    "f_variety": ("ln(n_distinct / nullif(n_words, 0))", 0.1),
    "f_symbols": ("ln(1 + 100 * n_symbols / nullif(word_chars, 0))", 0.2),
    "f_capitals": ("ln(1 + 100 * n_capitals / nullif(word_chars, 0))", 0.3),
    "f_dup_lines": ("ln(1 + 100 * n_dup_lines / nullif(n_lines, 0))", 0.5),
    "f_repeats": ("ln(1 + 100 * n_repeat_words / nullif(n_words, 0))", 0.5),
}
WINDOW = 8


def _chi2(p: int, share: float) -> float:
    """Quantile of the chi-squared distribution, by the cube-root normal approximation."""
    z, v = NormalDist().inv_cdf(share), 2 / (9 * p)
    return p * (1 - v + z * v**0.5) ** 3


def _cut(false_alarm: float) -> str:
    """Largest distance of a regular row, given the ``__n`` rows of its estimate: by an F distribution, approximated."""
    p, z = len(FEATURES), NormalDist().inv_cdf(1 - false_alarm)
    h, a, b = f"({SHARE}D * __n)", 2 / (9 * p), f"(2D / (9 * ({SHARE}D * __n - {p})))"
    below = f"((1 - {b}) * (1 - {b}) - {b} * {z * z}D)"
    root = f"(((1 - {b}) * {1 - a}D + {z}D * sqrt((1 - {b}) * (1 - {b}) * {a}D + {b} * {(1 - a) ** 2 - a * z * z}D)) / {below})"
    few = f"{h} <= {p + 1} or {below} <= 0"
    return f"if({few}, double('Infinity'), {p} * ({h} * {h} - 1) / ({h} * ({h} - {p})) * pow({root}, 3))"


def consistency(p: int, share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows must be multiplied with."""
    x, v = _chi2(p, share) / (p + 2), 2 / (9 * (p + 2))
    return share / NormalDist().cdf((x ** (1 / 3) - 1 + v) / v**0.5)


def word_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of its whole ``text``; other columns of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = r"[\x20\x09-\x0D]"
    kept = [c for c in docs.columns if c not in ("__t", "__words", "__lines", "__windows")]
    d = docs.select(*kept, text.alias("__t"))
    d = d.withColumns(
        {
            "__words": F.filter(F.split("__t", f"{blank}+"), lambda w: w != ""),
            "__lines": F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("bigint"),
            "n_capitals": F.length(F.regexp_replace("__t", r"[^\p{Lu}]+", "")).cast("bigint"),
        }
    )
    # the hash of each run of WINDOW words, over the hashes of the words
    windows = f"""if(size(__words) < {WINDOW}, array(), element_at(transform(array(transform(__words, w -> xxhash64(w))),
        h -> transform(sequence(1, size(h) - {WINDOW - 1}), i -> xxhash64(slice(h, i, {WINDOW})))), 1))"""
    d = d.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_distinct": F.size(F.array_distinct("__words")).cast("bigint"),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "__windows": F.expr(windows),
        }
    )
    # places of windows that come twice or more, in order; each adds the words that the one before doesn't reach
    repeats = f"""element_at(transform(array(array_sort(transform(__windows, (x, i) -> struct(x, i)))), s ->
        aggregate(
          array_sort(filter(transform(sequence(0, size(s) - 1), k -> if(
            (k > 0 and s[k - 1].x = s[k].x) or (k < size(s) - 1 and s[k + 1].x = s[k].x), s[k].i, null)),
            i -> i is not null)),
          struct(-{WINDOW} as last, 0L as n),
          (a, i) -> struct(i as last, a.n + least({WINDOW}, i - a.last) as n), a -> a.n)), 1)"""
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    return d.withColumn("n_repeat_words", F.when(twice, F.expr(repeats)).otherwise(F.lit(0)).cast("bigint")).drop(
        "__t", "__words", "__lines", "__windows"
    )


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _products(pairs) -> str:
    return " + ".join(f"{x} * {y}" for x, y in pairs) or "0D"


def _whiten(rows: DataFrame) -> DataFrame:
    """``distance``: squared Mahalanobis distance, by forward substitution with the joined Cholesky factor."""
    for i, f in enumerate(FEATURES):
        rest = _products((f"l_{i}_{k}", f"z_{k}") for k in range(i))
        rows = rows.selectExpr("*", f"({f} - m_{i} - ({rest})) / l_{i}_{i} as z_{i}")
    return rows.selectExpr("*", _products((f"z_{i}", f"z_{i}") for i in range(len(FEATURES))) + " as distance")


def _factor(moments: DataFrame) -> DataFrame:
    """Sums of deviations from the old centre -> new centre and Cholesky factor of the covariance, floors added."""
    p, scale = len(FEATURES), consistency(len(FEATURES), SHARE)
    floors = [floor for _, floor in FEATURES.values()]
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    out = moments.selectExpr(
        "key",
        *(f"c_{i} + s_{i} / n as m_{i}" for i in range(p)),
        *(
            f"(q_{i}_{j} / n - s_{i} / n * s_{j} / n) * {scale}D + {floors[i] ** 2 if i == j else 0.0}D as v_{i}_{j}"
            for i, j in cells
        ),
    )
    for j in range(p):
        square = f"v_{j}_{j} - ({_products((f'l_{j}_{k}', f'l_{j}_{k}') for k in range(j))})"
        out = out.selectExpr("*", f"sqrt(greatest({square}, {floors[j] ** 2 / 100}D)) as l_{j}_{j}")
        below = [
            f"(v_{i}_{j} - ({_products((f'l_{i}_{k}', f'l_{j}_{k}') for k in range(j))})) / l_{j}_{j} as l_{i}_{j}"
            for i in range(j + 1, p)
        ]
        out = out.selectExpr("*", *below)
    return out.drop(*(f"v_{i}_{j}" for i, j in cells))


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and median deviations on the diagonal."""
    names = list(FEATURES)
    medians = rows.groupBy("key").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f"m_{i}") for i, f in enumerate(names)))
    medians = materialize(medians)  # as small as it is, so the join knows it
    off = rows.join(medians, "key").selectExpr(
        "key", *(f"m_{i}" for i in range(len(names))), *(f"abs({f} - m_{i}) as o_{i}" for i, f in enumerate(names))
    )
    spread = off.groupBy("key").agg(
        *(F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(names))),
        *(F.percentile_approx(f"o_{i}", 0.5, 1000).alias(f"d_{i}") for i in range(len(names))),
    )
    return spread.selectExpr(
        "key",
        *(f"m_{i}" for i in range(len(names))),
        *(
            f"sqrt(2.198D * d_{i} * d_{i} + {FEATURES[f][1] ** 2}D) as l_{i}_{k}" if i == k else f"0D as l_{i}_{k}"
            for i, f in enumerate(names)
            for k in range(i + 1)
        ),
    )


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: estimate from the nearest ``SHARE`` of each group's rows, to the edge of a bucket."""
    p = len(FEATURES)
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    near = _whiten(rows.join(estimate, "key")).selectExpr(
        "key",
        "floor(8 * log2(distance + 1e-6)) as bucket",
        *(f"m_{i} as c_{i}" for i in range(p)),
        *(f"{f} - m_{i} as x_{i}" for i, f in enumerate(FEATURES)),
    )
    near = materialize(near)  # distances and sums together are too much for one generated function
    by_bucket = near.groupBy("key", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.expr(f"first(c_{i}) as c_{i}") for i in range(p)),
        *(F.expr(f"sum(x_{i}) as s_{i}") for i in range(p)),
        *(F.expr(f"sum(x_{i} * x_{j}) as q_{i}_{j}") for i, j in cells),
    )
    nearest = by_bucket.selectExpr(
        "*",
        "coalesce(sum(n) over (partition by key order by bucket rows between unbounded preceding and 1 preceding), 0) as before",
        "sum(n) over (partition by key) as every",
    ).where(f"before < {SHARE} * every")
    moments = nearest.groupBy("key").agg(
        F.sum("n").alias("n"),
        *(F.expr(f"first(c_{i}) as c_{i}") for i in range(p)),
        *(F.expr(f"sum(s_{i}) as s_{i}") for i in range(p)),
        *(F.expr(f"sum(q_{i}_{j}) as q_{i}_{j}") for i, j in cells),
    )
    return _factor(moments)


def judge(docs: DataFrame, false_alarm: float = FALSE_ALARM) -> DataFrame:
    """The statistics of ``docs`` (doc_id, text, lang, source), ``base_failed``, ``distance`` and ``kept``.

    ``text_hash`` tells rows of one id apart.
    """
    source = docs.select("doc_id", "text", "lang", "source", text_hash())
    stats = word_statistics(source).withColumn("base_failed", base_failed()).drop("text")
    stats = materialize(stats)
    own, pooled = F.to_json(F.struct("lang", "source")), F.concat(F.lit("pooled "), F.to_json(F.struct("lang")))
    good = stats.where(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    in_lang = F.sum(F.when(F.col("n") < MIN_ROWS, F.col("n"))).over(W.partitionBy("lang"))
    key = F.when(F.col("n") >= MIN_ROWS, own).when(in_lang >= MIN_ROWS, pooled).otherwise(F.lit("all"))
    keys = sizes.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), key.alias("key"), "n")
    keys = materialize(keys)
    fitted = keys.where("key != 'all'")
    if keys.where("key = 'all'").limit(1).count():  # what is too small is judged by all rows
        fitted = fitted.unionByName(keys.withColumn("key", F.lit("all")))
    large = fitted.groupBy("key").agg(F.sum("n").alias("__n"))
    large = materialize(large.select("key", F.expr(_cut(false_alarm)).alias("__cut")))
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    features = {name: F.expr(e) for name, (e, _) in FEATURES.items()}
    # each step reads these alone: joining the keys anew would leave a broadcast a step on the driver
    rows = materialize(good.join(fitted, same).withColumns(features).select("key", *FEATURES))
    estimate = materialize(_start(rows))
    for _ in range(STEPS):
        estimate = materialize(_concentrate(rows, estimate))
    judged = stats.join(keys.drop("n").join(estimate, "key").join(large, "key"), same, "left").withColumns(features)
    judged = _whiten(judged)
    inside = F.coalesce(F.col("distance") <= F.col("__cut"), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside).select(*stats.columns, "distance", "kept")


def reject(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judge`` doesn't keep."""
    names = ["doc_id", "lang", "source", "text_hash"]
    out = judge(docs).where("not kept").select(*(F.col(c).alias(f"__{c}") for c in names)).distinct()
    same = F.lit(True)
    for c in names:
        same &= (text_hash() if c == "text_hash" else F.col(c)).eqNullSafe(F.col(f"__{c}"))
    return docs.join(out.hint("shuffle_hash"), same, "left_anti")


@query("op6_robust_outliers")
def op6(spark, sf_dir):
    """Base statistics and verdict of every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
