"""Quality by importance resampling: how much likelier a text is under good text than under all text.

Two generative models over hashed n-grams (words, word pairs, and the first and last two bytes of words) are counted:
one on a sample of rows labelled good, one on all rows. A text's log weight is the sum of the log ratios of its
n-grams. Rows are drawn without replacement in proportion to their weights by Gumbel top-k: each log weight gets a
Gumbel number made from a hash of id and text, and the ``k`` largest sums stay. The k-th largest is found by
narrowing histograms, so nothing is sorted or gathered.

Null and empty texts have no n-grams and the log weight 0. Repeated rows have equal sums, and rows whose sums equal
the k-th largest all stay. Without a good row, or without any row, log weights are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import chunks, mixed, query, slice_hashes, table, texts
from .labelled import labelled_sample

CHUNK_BYTES = 1 << 20
BUCKET_BITS, PRIOR = 20, 0.5
SAMPLE_ROWS = 40_000
BINS = 4096


def ngrams(strings: list[str]):
    """The text and the bucket of every n-gram of all strings."""
    import numpy as np

    encoded = [s.encode() for s in strings]
    data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.diff(white.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    text = np.searchsorted(np.cumsum([len(e) + 1 for e in encoded]), starts, side="right")
    word = slice_hashes(data, starts, ends)
    pair = mixed(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
    near = text[:-1] == text[1:]
    front = slice_hashes(data, starts, np.minimum(starts + 2, ends)) + np.uint64(1)
    back = slice_hashes(data, np.maximum(ends - 2, starts), ends) + np.uint64(2)
    hashes = mixed(np.concatenate([word, pair[near], front, back]))
    owner = np.concatenate([text, text[:-1][near], text, text])
    return owner, (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def counts(rows: DataFrame):
    """How often each bucket comes in ``rows`` (text), as one array of fixed size."""
    import numpy as np

    def run(batches: Iterator):
        import pyarrow as pa

        found = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in chunks(batches, CHUNK_BYTES):
            np.add.at(found, ngrams(batch.column(0).to_pylist())[1], 1)
        at = np.flatnonzero(found)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found[part])], ["bucket", "n"])

    summed = rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    summed = summed.toArrow()
    out = np.zeros(1 << BUCKET_BITS)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def log_ratio(good: DataFrame, every: DataFrame):
    """Log ratio of both models for each bucket; zeros if one of them has no n-gram."""
    import numpy as np

    a, b = counts(good), counts(every)
    if not a.sum() or not b.sum():
        return np.zeros_like(a)
    # unseen buckets get the share that each model's prior has, in the same units
    prior = PRIOR * (b + 1) / (b.sum() + len(b)) * len(b)
    return np.log((a + prior) / (a.sum() + prior.sum())) - np.log((b + PRIOR) / (b.sum() + PRIOR * len(b)))


def weigh(docs: DataFrame, ratio, seed: int = 11) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``log_weight`` and ``draw``, its sum with a Gumbel number."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in chunks(batches, CHUNK_BYTES):
            owner, bucket = ngrams(batch.column(1).to_pylist())
            weight = np.bincount(owner, shared.value[bucket], batch.num_rows)
            n = np.bincount(owner, minlength=batch.num_rows)
            columns = [batch.column(0), pa.array(n), pa.array(weight), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "log_weight", "hash"])

    rows = texts(docs).withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "text"))
    rows = rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, log_weight double, hash bigint")
    uniform = (F.pmod("hash", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.select("doc_id", "n_tokens", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("draw"))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of ``column``: histograms of the range that still holds it."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0  # values beyond the range
    while low < high:
        width = (high - low) / BINS
        if low + width <= low or high - width >= high:
            break
        inside = rows.where(F.col(column).between(low, high))
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("bin")
        found = inside.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("z"))
        for r in sorted(found.collect(), reverse=True):
            if above + r.n >= k:
                low, high = r.a, r.z
                break
            above += r.n
        else:
            return low
    return high if low == high else low


def resample(docs: DataFrame, good: DataFrame, share: float) -> DataFrame:
    """The rows of ``weigh`` with ``kept``: whether they are among the ``share`` of all rows that is drawn."""
    drawn = materialize(weigh(docs, log_ratio(good, docs.select(F.coalesce("text", F.lit("")).alias("text")))))
    least = kth_largest(drawn, "draw", round(share * drawn.count()))
    return drawn.withColumn("kept", F.col("draw") >= least)


@query("op1_importance_resampling")
def op1(spark, sf_dir):
    """Every document's log weight, and whether it is drawn; as many are as the labels call good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "quality", SAMPLE_ROWS)
    share = sample.agg(F.avg("label")).first()[0]
    return resample(docs, sample.where("label = 1"), 1.0 if share is None else share)
