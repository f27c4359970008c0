"""The search against all scores."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clearwell.llm import balltree

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(ids, x, own, q, k):
    scored = sorted((-int(np.dot(q, v)), int(i)) for i, v in zip(ids, x) if i != own)
    return [(-s, i) for s, i in scored[:k]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 300), st.integers(1, 6), st.sampled_from([1, 4, 100]), st.integers(1, 9))
def test_tree_finds_the_best(seed, count, size, spread, leaf):
    """Few different entries make many ties and equal vectors."""
    pick = np.random.default_rng(seed)
    x = pick.integers(-spread, spread + 1, (count, size)).astype(float)
    ids = pick.permutation(count).astype(np.int64)
    q = pick.integers(-spread, spread + 1, (7, size)).astype(float)
    own = pick.integers(0, count, 7)
    best = balltree.Best(7, 5)
    half = count // 2
    for part in (slice(0, half), slice(half, count)):  # the k-th score goes on from shard to shard
        if len(x[part]):
            balltree.search(balltree.BallTree(ids[part], x[part], leaf), own, q, best)
    for j in range(7):
        got = [(int(s), int(i)) for s, i in zip(best.scores[j], best.ids[j]) if s > -np.inf]
        assert got == plain(ids, x, own[j], q[j], 5)


def test_bounds_hold_and_prune():
    pick = np.random.default_rng(5)
    centres = pick.normal(size=(40, 16)) * 200
    x = np.floor(centres[pick.integers(0, 40, 8000)] + pick.normal(size=(8000, 16)) * 5)
    tree = balltree.BallTree(np.arange(8000), x)
    q = x[:50]
    for level, (centre, _) in enumerate(tree.levels):
        bounds = tree.bounds(level, q, np.linalg.norm(q, axis=1))
        scores = (tree.x @ q.T).reshape(len(centre), -1, 50).max(axis=1).T
        assert (bounds >= scores).all()
    best = balltree.Best(50, 5)
    seen = balltree.search(tree, np.arange(50), q, best)
    assert seen < 0.2 * 50 * len(tree.levels[-1][0])
    # told the k-th scores before, it looks at fewer still
    told = balltree.Best(50, 5, best.scores[:, -1].copy())
    assert balltree.search(tree, np.arange(50), q, told) <= seen
    assert (told.scores == best.scores).all() and (told.ids == best.ids).all()


def all_scores(rows, k=5):
    fine = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, v in fine:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_search_over_a_table(spark, block_bytes):
    pick = np.random.default_rng(6)
    rows = [(i, pick.normal(size=4).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(400)]  # a third of all are equal
    rows += [(2000, None), (2050, [math.nan] * 4), (2100, [None, 0.0, 0.0, 0.0]), (None, [9.0] * 4), (2150, [math.inf] * 4)]
    rows += [(2200, [1.0, 2.0]), (2201, [3.0, 4.0]), (150, [1.0, 1.0, 1.0, 1.0]), (77, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit(1) for c in ("place", "rank", "x")})
    x = balltree.quantised(df.repartition(5))
    got = balltree.top_inner_products(x.where(F.col("vec_id") % 50 == 0), x, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got)) == all_scores(rows)


def test_odd_tables(spark):
    def run(rows):
        x = balltree.quantised(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
        return sorted(map(tuple, balltree.top_inner_products(x.where(F.col("vec_id") % 50 == 0), x).collect()))

    assert run([]) == [] and run([(50, [1.0])]) == [] and run([(3, [1.0]), (4, [1.0])]) == []
    assert run([(0, [1.0]), (7, [-1.0])]) == [(0, 1, 7, -65536)]
    with pytest.raises(OverflowError):
        run([(0, [1e12]), (7, [1e12])])
