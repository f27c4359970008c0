"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (letters and digits, A to Z in lower case) and their beginnings, hashed into buckets and
taken once each. The score is the logistic of a bias, a weight per bucket and, for each pair of buckets of the text,
the inner product of their factors, so an insult can weigh more next to a mention of a group than both do apart.
Every bucket that the sample has gets a weight and factors, also one that says nothing by itself. What keeps them in
bounds is decay, and steps that are the smaller the fewer texts a bucket stands in and the more terms a text has.

The machine is fitted on a sample of labelled rows whose size is a parameter; scoring is one pass over all rows with
the fitted numbers. Only the text enters a score. Null and empty texts have no terms and get the bias's score;
repeated rows get equal scores. Without both labels in the sample every text gets the share of toxic rows in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, mixed, query, slice_hashes, table, texts
from .labelled import labelled_sample

CHUNK_BYTES = 1 << 20
BUCKET_BITS, FACTORS = 20, 6
#: Beginnings of words, in bytes; 0 is the whole word.
PIECES = (0, 4, 5, 6)
SAMPLE_ROWS = 40_000
#: Rows that a step looks at, and texts at which a bucket's steps are half as long as they can be.
STEP_ROWS, HALF_TEXTS = 2048, 5
#: Length of a step, in units of ``rate`` over the root of the mean number of terms.
SCALE = 4.0


@dataclass
class Machine:
    """``place``: index of each bucket, -1 without one."""

    place: object
    bias: float
    weights: object
    factors: object

    def score(self, owner, index, texts_: int):
        """Scores of texts from their (text, index) pairs, each once."""
        import numpy as np

        out = self.bias + np.bincount(owner, self.weights[index], texts_)
        for f in range(self.factors.shape[1]):
            v = self.factors[index, f]
            out += (np.bincount(owner, v, texts_) ** 2 - np.bincount(owner, v * v, texts_)) / 2
        return 1 / (1 + np.exp(-out))


def terms(strings: list[str]):
    """(text, bucket) pairs of all strings, each once, sorted."""
    import numpy as np

    data = np.frombuffer(b"\n".join(s.encode() for s in strings).lower() + b"\n", np.uint8)
    inside = (data >= 0x80) | ((data >= 0x30) & (data <= 0x39)) | ((data >= 0x61) & (data <= 0x7A))
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    bounds = np.cumsum([len(s.encode()) + 1 for s in strings])
    text = np.searchsorted(bounds, starts, side="right")
    pairs = []
    for size in PIECES:
        long = ends - starts > size
        at = starts[long]
        hashes = slice_hashes(data, at, at + size if size else ends[long])
        bucket = mixed(hashes + np.uint64(size)) >> np.uint64(64 - BUCKET_BITS)
        pairs.append(text[long].astype(np.int64) << BUCKET_BITS | bucket.astype(np.int64))
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


def fit(sample: DataFrame, rounds: int = 150, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """A machine from ``sample`` (text, label), by Adam on the logistic loss of its rows, ``STEP_ROWS`` at a time."""
    import numpy as np

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    share = (toxic + 0.5) / (clean + toxic + 1)
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    machine = Machine(place, float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, FACTORS)))
    if not clean or not toxic:
        return machine
    def encode(batches: Iterator):
        import pyarrow as pa

        for batch in chunks(batches, CHUNK_BYTES):
            owner, bucket = terms(batch.column(0).to_pylist())
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], ["label", "terms"])

    rows = sample.mapInArrow(encode, "label int, terms array<int>").toArrow()
    label = rows.column("label").to_numpy().astype(np.float64)
    lists = rows.column("terms").combine_chunks()
    del rows
    bucket, ends = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64))
    found = np.bincount(bucket, minlength=len(place))
    chosen = np.flatnonzero(found)
    if not len(chosen):
        return machine
    place[chosen] = np.arange(len(chosen))
    found, n, k = found[chosen], len(label), len(chosen)
    reach = np.float32(rate * SCALE) / np.sqrt(np.float32(len(bucket) / n))
    often = np.minimum(1, np.log2(n / found)) if n > 1 else 1.0
    reach = (reach * (found / (found + HALF_TEXTS)) * often).astype(np.float32)[:, None]
    random = np.random.default_rng(seed)
    values = np.zeros((1 + FACTORS, k), np.float32).T  # a column after the other
    values[:, 1:] = random.normal(0, 1, (FACTORS, k)).T * reach
    first, second, slope = (np.zeros((1 + FACTORS, k), np.float32).T for _ in range(3))
    bias, todo = machine.bias, np.empty(0, np.int64)
    for step in range(1, rounds + 1):
        if not len(todo):
            todo = random.permutation(n)
        part, todo = np.sort(todo[:STEP_ROWS]), todo[STEP_ROWS:]
        lens = ends[part + 1] - ends[part]
        owner = np.repeat(np.arange(len(part)), lens)
        index = place[bucket[np.arange(lens.sum()) + np.repeat(ends[part] - np.cumsum(lens) + lens, lens)]]
        machine.weights, machine.factors, machine.bias = values[:, 0], values[:, 1:], bias
        miss = machine.score(owner, index, len(part)) - label[part]
        slope[:, 0] = np.bincount(index, miss[owner], k)
        for f in range(FACTORS):
            v = values[index, 1 + f]
            total = np.bincount(owner, v, len(part))
            slope[:, 1 + f] = np.bincount(index, miss[owner] * (total[owner] - v), k)
        slope /= len(part)
        slope += decay * values
        bias -= rate * 4 * miss.mean()
        first *= 0.9
        first += 0.1 * slope
        second *= 0.99
        second += 0.01 * slope * slope
        values -= reach * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    machine.weights, machine.factors, machine.bias = values[:, 0].copy(), values[:, 1:].copy(order="F"), float(bias)
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        for batch in chunks(batches, CHUNK_BYTES):
            owner, bucket = terms(batch.column(1).to_pylist())
            index = m.place[bucket]
            scores = m.score(owner[index >= 0], index[index >= 0], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(scores, 0, 1))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id bigint, score double")


@query("op3_factorization_machine")
def op3(spark, sf_dir):
    """Every document's toxicity, learned from labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", SAMPLE_ROWS, fold("doc_id", 5) != 0)
    return score(docs, fit(sample)).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
