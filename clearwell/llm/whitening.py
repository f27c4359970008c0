"""Whitening of embeddings: principal components of their covariance, each scaled to variance 1.

Three passes over the vectors leave sums of the size of one vector or of one matrix per task: counts and sums, products
of centred entries, products of whitened ones. Spark adds them up; the driver gets one matrix, as large as a vector is
long, and finds its leading components (:mod:`eigen`). They go to the tasks as a broadcast of (entries x components)
numbers, which project the vectors of the fourth pass.

Entries are counted in steps of ``1 / scale`` from ``-shift``, as whole numbers, so sums are exact and centring is one
rounding: ``(n * x - sum) / n``.

Vectors that are null or hold null or non-finite entries take no part. A null id is kept; repeated rows count and are
returned each. All vectors must have one length. Components whose variance is zero, to the precision of the matrix,
can't be scaled to 1 and are not returned: of equal vectors, or of one, nothing is. Without vectors the result is empty.
Only the two named columns are read. Entries or sums too large for whole numbers of 64 bits are an error, never rounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table
from .eigen import leading

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LARGEST = 2**62


def whole(batch, scale: int, shift: int):
    """Ids, and whole numbers by row, of the vectors of a record batch that take part; one matrix per length."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column("vector")
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for n in sorted(set(lengths[lengths >= 0].tolist())):
        rows = np.flatnonzero(lengths == n)
        values = flat[starts[rows][:, None] + np.arange(n)]
        fine = np.isfinite(values).all(axis=1)
        scaled = np.floor(scale * values[fine])
        if np.abs(scaled).max(initial=0) > 2**52:
            raise OverflowError(f"an entry is too large for steps of 1/{scale}")
        yield batch.column("vec_id").take(pa.array(rows[fine])), scaled.astype(np.int64) + shift


@dataclass
class Fit:
    """``n`` vectors, exact ``sums`` by entry, ``variances`` and unit ``components`` (as columns), the whole ``trace``."""

    n: int
    sums: list[int]
    variances: object
    components: object
    trace: float


def _added(rows: DataFrame, work, shape: tuple[int, int]):
    """The sum of matrices that ``work`` makes, one per task, of its record batches."""
    import numpy as np

    def matrices(batches):
        import pyarrow as pa

        total = work(batches)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(total))), "v": total.tolist()})

    cells = rows.mapInArrow(matrices, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros(shape)
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def centred(x, n: int, sums):
    """``n`` times the difference of each entry from its mean, exactly."""
    import numpy as np

    if max(np.abs(x).max(initial=0) * float(n), *map(abs, sums), 0) * 2 > LARGEST:
        raise OverflowError("sums of these vectors pass 64 bits")
    return x * n - np.array(sums, np.int64)


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Fit:
    """``rows``: vec_id, vector."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        found = {}
        for batch in batches:
            for _, x in whole(batch, scale, shift):
                if len(x):
                    n, sums = found.get(x.shape[1], (0, 0))
                    found[x.shape[1]] = n + len(x), sums + x.sum(axis=0, dtype=np.int64)
        for length, (n, sums) in found.items():
            both = [n, *sums.tolist()]
            yield pa.RecordBatch.from_pydict({"size": [length] * len(both), "i": list(range(len(both))), "v": both})

    counted = rows.mapInArrow(count, "size long, i long, v long").groupBy("size", "i").agg(F.sum("v").alias("v")).collect()
    sizes = {r["size"] for r in counted}
    if len(sizes) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(sizes)}")
    n, *sums = [r["v"] for r in sorted(counted, key=lambda r: r["i"])] or [0]
    if not sums:
        return Fit(n, [], [], [], 0.0)

    def products(batches):
        total = None
        for batch in batches:
            for _, x in whole(batch, scale, shift):
                c = centred(x, n, sums) / n
                total = c.T @ c if total is None else total + c.T @ c
        return total

    size = len(sums)
    covariance = _added(rows, products, (size, size)) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(covariance.trace())
    values, vectors = leading(covariance, min(components, size))
    some = values > size * 1e-14 * trace
    return Fit(n, sums, values[some], vectors[:, some], trace)


def identity_error(rows: DataFrame, model: Fit, scale: int = SCALE, shift: int = SHIFT) -> float:
    """Largest entry of the covariance of the whitened vectors less the identity, measured over all of them."""
    import numpy as np

    k, n, sums = len(model.variances), model.n, model.sums
    if not k:
        return 0.0
    turn = rows.sparkSession.sparkContext.broadcast(model.components / np.sqrt(model.variances))

    def products(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in whole(batch, scale, shift):
                z = centred(x, n, sums) / n @ turn.value
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
        return total

    total = _added(rows, products, (k + 1, k)) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def project(rows: DataFrame, model: Fit, error: float, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector and component."""
    import numpy as np

    k, n, sums = len(model.variances), model.n, model.sums
    sent = (model.components / np.sqrt(model.variances), model.variances / model.trace) if k else None
    turn = rows.sparkSession.sparkContext.broadcast(sent)

    def projected(batches):
        import pyarrow as pa

        if not k:
            return
        matrix, explained = turn.value
        for batch in batches:
            for ids, x in whole(batch, scale, shift):
                c, m = centred(x, n, sums), len(x)
                if m and (np.square(c.astype(float)).sum(axis=1) > LARGEST).any():
                    raise OverflowError("a squared deviation passes 64 bits")
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(np.repeat(np.arange(m), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, n),
                    "deviation": np.repeat((c * c).sum(axis=1), k),
                    "whitened": (c / n @ matrix).ravel(),
                    "explained": np.tile(explained, m),
                    "identity_error": np.full(m * k, error),
                })

    return rows.mapInArrow(
        projected,
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


@query("op12_sturm_whitening")
def op12_sturm_whitening(spark, sf_dir):
    """All ``embeddings`` on their 32 leading components."""
    rows = vectors(table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    return project(rows, model, identity_error(rows, model))
