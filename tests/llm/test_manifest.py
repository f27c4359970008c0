"""The manifest against a tree built row by row."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from clearwell.llm import manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        under = levels[-1]
        levels.append([sha("".join(under[i : i + 3])) for i in range(0, len(under), 3)])
    return levels


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 3 * 3
        out.append((level[start:i], level[i + 1 : start + 3]))
        i //= 3
    return out


def plain(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[s]]) for s in order]
    top = tree([t[-1][0] for t in trees]) if trees else None
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path, text = sides(trees[k], i) + sides(top, k), r[4]
            if text is not None and zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*r[:4], text))
            for before, after in path:
                folded = sha("".join(before) + folded + "".join(after))
            proof = sha("".join("".join(b + a) for b, a in path))
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def some_rows():
    pick = random.Random(1)
    sources = [None, "", "a", "b", "é", "\U0001f600"] + ["hot"] * 4
    texts = [None, "", "x\ny", "text é", "\n"]
    rows = [(i, pick.choice(sources), pick.choice(["en", None]), pick.choice([None, 7]), pick.choice(texts)) for i in range(300)]
    rows += [(None, "a", "en", 3, "q\n")] + [(5, "hot", "x", 1, "dup\n")] * 40 + [(-3, "hot", "x", 1, "z" * 100_000)]
    return rows + [(900 + i, f"s{i}", None, i, "t") for i in range(30)]


@pytest.mark.parametrize("band", [1, 2, 6])
def test_manifest_as_row_by_row(spark, band):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "idx", "leaf", "part", "block")})
    got = manifest.prove(manifest.build(manifest.leaves_of(df), band)).select(*COLUMNS).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows))


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 9, 10, 28])
def test_trees_of_few_rows(spark, count):
    rows = [(i, "s", "en", 1, "a\nb") for i in range(count)]
    built = manifest.build(manifest.leaves_of(spark.createDataFrame(rows, SCHEMA)), 2)
    got = manifest.prove(built).select(*COLUMNS).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows))
    assert (built.root is None) == (count == 0)


def test_nodes_carry_intervals(spark):
    """Every level of a tree covers its leaves without gaps, and a node's interval is its children's."""
    rows = some_rows()
    built = manifest.build(manifest.leaves_of(spark.createDataFrame(rows, SCHEMA)), 2)
    levels = collections.defaultdict(list)
    for n in manifest.nodes(built).where("kind = 'rows'").collect():
        levels[n["tree"], n["level"]].append((n["lo"], n["hi"]))
    sizes = {r["tree"]: r["n"] for r in built.leaves.groupBy("tree").agg(F.count("*").alias("n")).collect()}
    for (number, level), intervals in levels.items():
        want = [(i, min(i + 3**level, sizes[number])) for i in range(0, sizes[number], 3**level)]
        assert sorted(intervals) == want


def test_no_key_of_a_join_is_large(spark):
    """Ancestors are attached block by block: a join key holds at most a block's items."""
    rows = [(i, "one", None, i, "t") for i in range(500)]
    built = manifest.build(manifest.leaves_of(spark.createDataFrame(rows, SCHEMA)), 2)
    assert built.leaves.groupBy("tree", F.expr("idx div 9")).count().agg(F.max("count")).first()[0] == 9
    assert [b.count() for b in built.bands] == [56, 7, 1]
