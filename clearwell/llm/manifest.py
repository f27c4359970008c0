"""A Merkle manifest of a dataset, its nodes labelled with the intervals of leaf ranks that they cover.

Each source has a tree over its rows in order of their ids, and one more tree stands over the sources' roots. A node
carries ``[lo, hi)``, the ranks of the leaves below it. Ancestors of a leaf are the nodes whose intervals contain its
rank; what is left of a parent's interval beside the one child that contains the rank are the siblings of a proof.

Levels come in bands of ``BAND``. A block of a band holds at most ``FAN ** BAND`` items, is hashed in one row, and its
top is an item of the next band. Proofs go down band by band: an item is joined with its ancestors of the band by
(tree, level, bucket of the level) and containment, and with what its block's top has above it as one more level. No
join key has more rows than a block has items, however large a tree is. Ranks come from a range partitioning of
(source, id, digest, row), whose sampled bounds cut a large source like any other stretch.

Nulls: a null field is ``-``; the null source comes first, and so does the null id, whose decimal text is empty. Rows of
one id are ordered by their digests, equal rows are leaves of their own. Only the named columns are read. A table
without rows has no root and no proofs.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fold, query, table

#: Children of a node, and levels of a band.
FAN, BAND = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """``leaves``: source, doc_id, leaf, probe, tree, idx. ``bands`` and ``upper``: the blocks of each band, from the
    leaves up, of the sources' trees and of the tree over them. ``root``: its hex digest, None without rows."""

    leaves: DataFrame
    bands: list[DataFrame]
    upper: list[DataFrame]
    root: str | None
    band: int


def digest(columns: list[Column]) -> Column:
    """Hex digest of fields, each with its length in UTF-8 bytes before it."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _number(batches):
    """Adds the number of the source within the partition and of the row within both; rows come sorted."""
    import pyarrow as pa

    last, tree, place = None, -1, 0
    for batch in batches:
        trees, places = [], []
        for value in batch.column("source").to_pylist():
            if tree >= 0 and value == last:
                place += 1
            else:
                last, tree, place = value, tree + 1, 0
            trees.append(tree)
            places.append(place)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(trees, pa.int64()), pa.array(places, pa.int64())],
            [*batch.schema.names, "tree", "place"],
        )


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with ``tree``, the rank of the source, and ``idx``, the rank within it.

    Only two numbers per partition go through the driver: how many trees begin before it, and how many rows of its
    first source lie before it.
    """
    spark = rows.sparkSession
    order = ["source", "doc_id", "leaf", "row"]
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    placed = placed.withColumn("part", F.spark_partition_id().cast("bigint"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    placed = materialize(placed.mapInArrow(_number, schema + ", tree bigint, place bigint"))
    ends = placed.groupBy("part").agg(
        F.min_by(F.struct("source"), "tree").alias("first"),
        F.max_by(F.struct("source", "tree", "place"), F.struct("tree", "place")).alias("last"),
    )
    starts, last, tree, rows_before = [], None, -1, 0
    for part in sorted(ends.collect(), key=lambda r: r["part"]):
        goes_on = last is not None and part["first"]["source"] == last["source"]
        base, before = (tree, rows_before) if goes_on else (tree + 1, 0)
        starts.append((part["part"], base, before))
        last = part["last"]
        tree = base + last["tree"]
        rows_before = last["place"] + 1 + (before if last["tree"] == 0 else 0)
    known = spark.createDataFrame(starts, "part bigint, base bigint, before bigint")
    return placed.join(F.broadcast(known), "part").select(
        *[c for c in placed.columns if c not in ("part", "tree", "place")],
        (F.col("base") + F.col("tree")).alias("tree"),
        (F.col("place") + F.when(F.col("tree") == 0, F.col("before")).otherwise(0)).alias("idx"),
    )


def _node_over(under: Column, k: int, band: int):
    """The node of level ``k`` over the i-th run of ``under``."""

    def node(i):
        run = F.slice(under, i * FAN + 1, FAN)
        joined = F.array_join(F.transform(run, lambda c: _hex(c["digest"])), "")
        return F.struct(
            F.lit(k).alias("level"),
            (F.col("block") * FAN ** (band - k) + i).alias("bucket"),
            run[0]["lo"].alias("lo"),
            F.element_at(run, -1)["hi"].alias("hi"),
            F.unhex(F.sha2(joined, 256)).alias("digest"),
            run.alias("children"),
        )

    return node


def _blocks(items: DataFrame, band: int) -> DataFrame:
    """``items``: tree, idx, lo, hi, digest. One row per block: its nodes above the items, each with its interval and
    its children's, and its top. A tree of one item has no node above it here."""
    blocks = items.groupBy("tree", F.expr(f"idx div {FAN**band}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "lo", "hi", "digest"))).alias("below")
    )
    size = F.size("below")
    depth = sum((F.when(size > FAN**k, 1).otherwise(0) for k in range(band)), F.lit(0))
    blocks = blocks.withColumn("depth", F.when(F.col("block") > 0, band).otherwise(depth))
    blocks = blocks.withColumn("level0", F.transform("below", lambda x: F.struct(x["lo"], x["hi"], x["digest"])))
    for k in range(1, band + 1):
        under = F.col(f"level{k - 1}")
        count = F.expr(f"(size(level{k - 1}) - 1) div {FAN}").cast("int")
        nodes = F.transform(F.sequence(F.lit(0), count), _node_over(under, k, band))
        blocks = blocks.withColumn(f"nodes{k}", F.when(F.col("depth") >= k, nodes))
        lifted = F.transform(f"nodes{k}", lambda x: F.struct(x["lo"], x["hi"], x["digest"]))
        blocks = blocks.withColumn(f"level{k}", F.coalesce(lifted, under))
    all_nodes = F.flatten(F.filter(F.array(*(f"nodes{k}" for k in range(1, band + 1))), lambda x: x.isNotNull()))
    return blocks.select("tree", "block", "depth", all_nodes.alias("nodes"), F.col(f"level{band}")[0].alias("top"))


def _climb(items: DataFrame, band: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all bands, and the roots of the trees: tree, digest."""
    bands = []
    while True:
        blocks = materialize(_blocks(items, band))
        bands.append(blocks)
        tops = blocks.select("tree", F.col("block").alias("idx"), "top.*")
        if blocks.where("block > 0").isEmpty():
            return bands, tops.select("tree", "digest")
        items = tops


def build(rows: DataFrame, band: int = BAND) -> Manifest:
    """``rows``: source, doc_id, leaf (hex) and probe (hex), what :func:`prove` folds."""
    leaves = materialize(_ranked(rows.select("source", "doc_id", "leaf", "probe")))
    items = leaves.select(
        "tree", "idx", F.col("idx").alias("lo"), (F.col("idx") + 1).alias("hi"), F.unhex("leaf").alias("digest")
    )
    bands, roots = _climb(items, band)
    tree = F.col("tree")
    upper, top = _climb(
        roots.select(F.lit(0).cast("bigint").alias("tree"), tree.alias("idx"), tree.alias("lo"), (tree + 1).alias("hi"), "digest"),
        band,
    )
    row = top.select(_hex(F.col("digest"))).first()
    return Manifest(leaves, bands, upper, row and row[0], band)


def nodes(manifest: Manifest) -> DataFrame:
    """All nodes above the leaves: ``kind`` ('rows' or 'sources'), tree, level, lo, hi, digest. ``lo`` and ``hi`` are
    ranks of rows of the tree's source, or of sources."""
    parts = [
        blocks.select("tree", F.explode("nodes").alias("n")).select(
            F.lit(kind).alias("kind"), "tree", (F.col("n.level") + i * manifest.band).alias("level"), "n.lo", "n.hi",
            _hex(F.col("n.digest")).alias("digest"),
        )
        for kind, bands in (("rows", manifest.bands), ("sources", manifest.upper))
        for i, blocks in enumerate(bands)
    ]
    return functools.reduce(DataFrame.unionByName, parts)


SIDES = "array<struct<before:binary,after:binary>>"


def _beside(items: DataFrame, blocks: DataFrame, above: DataFrame | None, band: int) -> DataFrame:
    """``items`` (tree, idx, lo, hi, kept) with ``sides``, the digests left and right of the path at each level up to
    the root, and ``subroot``.

    ``above``: tree, idx, sides and subroot of the blocks' tops.
    """
    known = blocks.select("tree", F.explode("nodes").alias("n")).select(
        "tree", "n.level", "n.bucket", "n.lo", "n.hi", "n.children",
        F.lit(None).cast(SIDES).alias("above"), F.lit(None).cast("binary").alias("subroot"),
    )
    if above is not None:
        empty = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("lo", "hi", "children")]
        level = F.lit(band + 1).alias("level")
        known = known.unionByName(
            above.select("tree", level, F.col("idx").alias("bucket"), *empty, F.col("sides").alias("above"), "subroot")
        )
    covers = F.array(*[F.lit(FAN ** min(k, band)).cast("bigint") for k in range(1, band + 2)])
    steps = items.select("tree", "idx", "lo", "hi", "kept", F.posexplode(covers).alias("step", "covered")).select(
        "tree", "idx", "lo", "hi", (F.col("step") + 1).alias("level"), F.expr("idx div covered").alias("bucket"),
        F.when(F.col("step") == 0, F.col("kept")).alias("kept"),
    )
    i, n = steps.alias("i"), known.alias("n")
    inside = F.col("n.lo").isNull() | ((F.col("n.lo") <= F.col("i.lo")) & (F.col("i.hi") <= F.col("n.hi")))
    same = [F.col(f"i.{c}") == F.col(f"n.{c}") for c in ("tree", "level", "bucket")]
    joined = i.join(n, functools.reduce(Column.__and__, same) & inside, "left")

    def part(keep):
        some = F.filter("n.children", keep)
        return F.aggregate(some, F.unhex(F.lit("")), lambda a, c: F.concat(a, c["digest"]))

    # what the parent's interval holds beside the child that the item lies in
    side = F.struct(
        F.col("i.level").alias("level"),
        part(lambda c: c["hi"] <= F.col("i.lo")).alias("before"),
        part(lambda c: c["lo"] >= F.col("i.hi")).alias("after"),
    )
    found = joined.select(
        "i.tree", "i.idx", "i.kept", "n.above", "n.subroot", F.when(F.col("n.children").isNotNull(), side).alias("side")
    )
    grouped = found.groupBy("tree", "idx").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("kept", "above", "subroot")],
        F.sort_array(F.collect_list("side")).alias("here"),
    )
    here = F.transform("here", lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after")))
    sides = F.concat(here, F.coalesce("above", F.array().cast(SIDES))).alias("sides")
    return grouped.select("tree", "idx", "kept", sides, "subroot")


def _descend(bands: list[DataFrame], above: DataFrame | None, band: int) -> DataFrame | None:
    """Sides of the tops of the lowest band, from those of the highest."""
    for under, blocks in zip(reversed(bands[:-1]), reversed(bands[1:])):
        nothing = F.lit(None).cast("string").alias("kept")
        tops = under.select("tree", F.col("block").alias("idx"), "top.lo", "top.hi", nothing)
        above = materialize(_beside(tops, blocks, above, band))
    return above


def prove(manifest: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, probe, subroot, root, ``sides``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``folded_root`` hashes the probe with the leaf's siblings, level by level.
    """
    m, band, tree, idx = manifest, manifest.band, F.col("tree"), F.col("idx")
    sources = m.bands[-1].select(
        F.lit(0).cast("bigint").alias("tree"), tree.alias("idx"), tree.alias("lo"), (tree + 1).alias("hi"),
        F.col("top.digest").alias("kept"),
    )
    over = _beside(sources, m.upper[0], _descend(m.upper, None, band), band)
    over = over.select(idx.alias("tree"), F.lit(0).cast("bigint").alias("idx"), "sides", F.col("kept").alias("subroot"))
    rows = m.leaves.select("tree", "idx", idx.alias("lo"), (idx + 1).alias("hi"), F.struct("doc_id", "leaf", "probe").alias("kept"))
    paths = _beside(rows, m.bands[0], _descend(m.bands, materialize(over), band), band)
    both = F.array_join(F.transform("sides", lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "")
    folded = F.aggregate(
        "sides", F.col("kept.probe"), lambda a, s: F.sha2(F.concat(_hex(s["before"]), a, _hex(s["after"])), 256)
    )
    found = paths.select(
        "kept.*", _hex(F.col("subroot")).alias("subroot"), F.lit(m.root).cast("string").alias("root"), "sides",
        F.sha2(both, 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """Rows for :func:`build`; the probe is the digest of the row after tampering: every second id, as its checksum
    falls, loses the line breaks of its text."""
    tampered = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    leaf = digest([F.col(c) for c in FIELDS])
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf.alias("leaf"),
        F.when(fold("doc_id", 2) == 0, digest(tampered)).otherwise(leaf).alias("probe"),
    )


FIELD_SQL = ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS[:-1])
SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN doc_id IS NULL OR (list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))),
        lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) + 1) % 2 = 0
      THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE
      sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS probe
  FROM (SELECT *, concat({FIELD_SQL}) AS head FROM documents)
), leaves AS (
  SELECT doc_id, leaf, probe, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, probe) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM docs
), up AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
  FROM up WHERE n > 1 GROUP BY tree, level, idx // 3, n
), subroots AS (SELECT tree, digest AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS idx, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3
  FROM top WHERE n > 1 GROUP BY level, idx // 3, n
), steps AS (
  SELECT l.tree, l.idx, u.level, u.idx AS place, u.digest, l.idx // CAST(pow(3, u.level) AS BIGINT) AS own
  FROM leaves l JOIN up u ON u.tree = l.tree AND u.n > 1 AND u.idx // 3 = l.idx // CAST(pow(3, u.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.tree, l.idx, 100 + t.level, t.idx, t.digest, l.tree // CAST(pow(3, t.level) AS BIGINT)
  FROM leaves l JOIN top t ON t.n > 1 AND t.idx // 3 = l.tree // CAST(pow(3, t.level + 1) AS BIGINT)
), sides AS (
  SELECT tree, idx, level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place < own), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place > own), '') AS after
  FROM steps GROUP BY tree, idx, level
), paths AS (
  SELECT tree, idx, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS path
  FROM sides GROUP BY tree, idx
), folded AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(l.probe, coalesce(p.path, [])),
      lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots s USING (tree) LEFT JOIN paths p ON p.tree = l.tree AND p.idx = l.idx
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


@query("op11_interval_manifest", SQL)
def op11_interval_manifest(spark, sf_dir):
    """A proof for each row of ``documents``, and whether it holds after tampering."""
    proofs = prove(build(leaves_of(table(spark, sf_dir, "documents"))))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
