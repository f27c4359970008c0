"""Exact inner-product search over ball trees.

Each task cuts its candidates into shards of bounded size and builds a ball tree over each: nodes halve along the line
between two far points, so the tree is balanced whatever the vectors are, and the leaves of equal vectors too. Queries
come in blocks of bounded size, sent to all tasks. In a shard every query descends level by level; a node is left out
when its bound, centre times query plus radius times the query's length, is under the query's current k-th score.
Leaves are taken in order of their bounds, and the k-th score goes on from shard to shard of a task. Before that, a
first job over every ``SEED``-th candidate, by hash of its id, gives all tasks a k-th score to begin with; the second
job does the others. Both jobs' answers together are exact.

Scores are sums of whole numbers; a table whose entries could pass 2**53 in a score is an error. Bounds are rounded up.

Vectors that are null or hold null or non-finite entries take no part, neither do rows without an id, which could not
be named. A query is compared with vectors of its own length; all rows of its id are its own. Each row of a repeated
query id is answered, and repeated candidates count each. Equal scores go by the smaller id. With fewer candidates than
``k`` all are returned; an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

SCALE, TOP = 256, 5
#: Bytes of vectors in one shard and in one block of queries; rows of a leaf; one in so many candidates goes first.
SHARD_BYTES, BLOCK_BYTES, LEAF, SEED = 1 << 25, 1 << 25, 48, 16
NONE = -(2**63)


class BallTree:
    """``ids`` and ``x`` (rows of whole numbers as float64), arranged by leaves; ``levels``: centres and radii."""

    def __init__(self, ids, x, leaf: int = LEAF):
        import numpy as np

        depth = max(0, int(np.ceil(np.log2(max(len(x), 1) / leaf))))
        size = -(-len(x) // 2**depth)
        # the last row again, marked, so that all leaves have one size
        spare = 2**depth * size - len(x)
        order = np.r_[np.arange(len(x)), np.full(spare, len(x) - 1)]
        real = np.r_[np.ones(len(x), bool), np.zeros(spare, bool)]
        self.levels = []
        for level in range(depth + 1):
            nodes = x[order].reshape(2**level, -1, x.shape[1])
            centre = nodes.mean(axis=1)
            away = nodes - centre[:, None]
            distance = np.einsum("nmd,nmd->nm", away, away)
            self.levels.append((centre, np.sqrt(distance.max(axis=1))))
            if level == depth:
                break
            each = np.arange(len(nodes))
            one = nodes[each, distance.argmax(axis=1)]
            gap = nodes - one[:, None]
            other = nodes[each, np.einsum("nmd,nmd->nm", gap, gap).argmax(axis=1)]
            along = np.einsum("nmd,nd->nm", nodes, other - one)
            turn = np.argsort(along, axis=1, kind="stable")
            order = np.take_along_axis(order.reshape(turn.shape), turn, axis=1).ravel()
            real = np.take_along_axis(real.reshape(turn.shape), turn, axis=1).ravel()
        self.x, self.size = x[order], size
        self.ids = np.where(real, ids[order], NONE)

    def bounds(self, level: int, queries, lengths):
        """Upper bounds of the scores in all nodes of a level, by query."""
        import numpy as np

        centre, radius = self.levels[level]
        value = queries @ centre.T
        reach = lengths[:, None] * radius
        return value + reach + 1e-9 * (np.abs(value) + reach) + 1e-6


class Best:
    """The ``k`` best candidates of each query so far: scores fall, ids rise among equal ones."""

    def __init__(self, queries: int, k: int, floor=None):
        import numpy as np

        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        #: A score that so many candidates elsewhere are known to reach.
        self.floor = np.full(queries, -np.inf) if floor is None else floor

    def least(self):
        """What a candidate must reach, by query."""
        import numpy as np

        return np.maximum(self.scores[:, -1], self.floor)

    def offer(self, rows, scores, ids):
        """Candidates (a matrix, by query of ``rows``)."""
        import numpy as np

        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        first = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, first, axis=1)
        self.ids[rows] = np.take_along_axis(ids, first, axis=1)


def search(tree: BallTree, own, queries, best: Best) -> int:
    """Offers ``best`` what of the tree is good enough; the number of leaves looked at."""
    import numpy as np

    lengths = np.sqrt(np.einsum("qd,qd->q", queries, queries))
    bounds = tree.bounds(0, queries, lengths)
    open_ = bounds >= best.least()[:, None]
    for level in range(1, len(tree.levels)):
        some = np.flatnonzero(open_.any(axis=1))
        wide = np.zeros((len(queries), 2**level), bool)
        nodes = np.full(wide.shape, -np.inf)
        if len(some):
            nodes[some] = tree.bounds(level, queries[some], lengths[some])
            wide[some] = np.repeat(open_[some], 2, axis=1) & (nodes[some] >= best.least()[some][:, None])
        bounds, open_ = nodes, wide
    leaves = bounds.shape[1]
    bounds = np.where(open_, bounds, -np.inf)
    order = np.argsort(-bounds, axis=1)
    bounds = np.take_along_axis(bounds, order, axis=1)
    x, ids = tree.x.reshape(leaves, tree.size, -1), tree.ids.reshape(leaves, tree.size)
    seen, start, width = 0, 0, 1
    while start < leaves:
        # the next leaves of each query, by bound; more at a time the longer it takes
        ahead = bounds[:, start : start + width] >= np.maximum(best.least(), np.finfo(float).min)[:, None]
        q, at = np.nonzero(ahead)
        if not len(q):
            break
        leaf = order[q, start + at]
        by_leaf = np.argsort(leaf, kind="stable")
        q, leaf = q[by_leaf], leaf[by_leaf]
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        for rows, which in zip(np.split(q, cuts), leaf[np.r_[0, cuts]]):
            names = ids[which]
            scores = queries[rows] @ x[which].T
            scores[(names == NONE) | (names == own[rows][:, None])] = -np.inf
            good = np.flatnonzero((scores >= best.least()[rows][:, None]).any(axis=1))
            if len(good):
                scores = scores[good]
                best.offer(rows[good], scores, np.where(np.isneginf(scores), np.iinfo(np.int64).max, names))
        seen += len(q)
        start, width = start + width, width * 2
    return seen


def quantised(rows: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and ``x``, whole numbers, of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    kept = rows.where(F.col(id_col).isNotNull() & fine)
    return kept.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vector, lambda c: F.floor(c * scale).cast("bigint")).alias("x")
    )


def _matrices(batch):
    """Ids and float64 matrices of a record batch, one per length of vectors."""
    import numpy as np
    import pyarrow.compute as pc

    column = batch.column("x")
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for n in sorted(set(sizes.tolist())):
        rows = np.flatnonzero(sizes == n)
        yield ids[rows], flat[starts[rows][:, None] + np.arange(n)]


def _search_all(candidates: DataFrame, asked, k: int) -> DataFrame:
    """``asked``: broadcast blocks by length of vectors: places, ids, matrix, floors. Rows (place, vec_id, score)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        blocks = asked.value
        best = {n: Best(len(own), k, floor) for n, (_, own, _, floor) in blocks.items()}
        waiting = {n: [] for n in blocks}

        def shard(n):
            ids, x = (np.concatenate(parts) for parts in zip(*waiting[n]))
            waiting[n] = []
            _, own, queries, _ = blocks[n]
            search(BallTree(ids, x), own, queries, best[n])

        for batch in batches:
            for ids, x in _matrices(batch):
                n = x.shape[1]
                if n in blocks:
                    waiting[n].append((ids, x))
                    if sum(len(i) for i, _ in waiting[n]) * max(n, 1) * 8 >= SHARD_BYTES:
                        shard(n)
        for n, parts in waiting.items():
            if parts:
                shard(n)
            places, found = blocks[n][0], best[n]
            # a score under the floor is none of the best
            q, r = np.nonzero((found.scores > -np.inf) & (found.scores >= found.floor[:, None]))
            if len(q):
                yield pa.RecordBatch.from_pydict({
                    "place": places[q], "vec_id": found.ids[q, r], "score": found.scores[q, r].astype(np.int64),
                })

    return candidates.mapInArrow(run, "place long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each place, with ``rank``."""
    w = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(rows, floors=None):
    """Collected queries as matrices, by length."""
    import numpy as np

    by_length = {}
    for r in rows:
        by_length.setdefault(len(r["x"]), []).append(r)
    out = {}
    for n, some in by_length.items():
        places = np.array([r["place"] for r in some])
        floor = np.array([(floors or {}).get(p, -np.inf) for p in places.tolist()], float)
        out[n] = places, np.array([r["vec_id"] for r in some]), np.array([r["x"] for r in some], float).reshape(len(some), n), floor
    return out


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Both sides: vec_id, x. Rows (query_id, rank, vec_id, score): the ``k`` best candidates of other ids."""
    spark = queries.sparkSession
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"))
    both = [d.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first() for d in (asked, candidates)]
    length = both[0][0] or 0
    if min(length, both[1][0] or 0) * (both[0][1] or 0) * (both[1][1] or 0) >= 2**53:
        raise OverflowError("scores of these vectors pass 2**53")
    per_block = max(1, block_bytes // (8 * max(length, 1)))
    total = asked.count()
    blocks = max(1, -(-total // per_block))
    # dealt by hash of the row, so that a block is a little more or less than its share
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    first = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(SEED)) == 0
    sc, parts = spark.sparkContext, []
    for b in range(blocks if total else 0):
        rows = asked.where(block == b).select(F.col("row").alias("place"), "vec_id", "x").collect()
        seeds = materialize(_best(_search_all(candidates.where(first), sc.broadcast(_block(rows)), k), k))
        floors = {r["place"]: r["score"] for r in seeds.where(F.col("rank") == k).select("place", "score").collect()}
        others = _search_all(candidates.where(~first), sc.broadcast(_block(rows, floors)), k)
        parts.append(materialize(_best(seeds.drop("rank").unionByName(others), k)))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = asked.select(F.col("row").alias("place"), F.col("vec_id").alias("query_id"))
    found = reduce(DataFrame.unionByName, parts)
    return found.join(names, "place").select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""


@query("op13_ball_tree", SQL)
def op13_ball_tree(spark, sf_dir):
    """The five best of all ``embeddings`` for every id divisible by 50."""
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_inner_products(rows.where(F.col("vec_id") % 50 == 0), rows)
