"""Jaccard join of word shingles with signature trees, and its components.

A tree's leaves are shingle sets; each node holds the OR of its leaves' token bitmaps and the range of their sizes.
Tokens fall into buckets and a bucket's count is written in unary, so the OR holds the largest count and the bits that
two nodes share bound the overlap of any two of their leaves. Both ends of a join descend together and drop pairs of
nodes that can't reach the overlap which their smallest sets need, whose sizes exclude each other, or whose leaves are
all connected already. What is left is counted exactly.

Which sets meet in a tree: order all tokens in any one way, the same for all sets. Two sets within the threshold then
share one of their first tokens, counted up to what they may lack of each other. Rare tokens come first here: among a
share of the hash space twice as large as such a beginning, tokens of one set only, then by the number of sets, then all
other tokens by hash. So most sets share none of their first tokens with anyone and are done, and passages that many
texts quote decide little. Two sets that share one may be within the threshold only if their sizes, what is left of both
behind it (at the first token that they share, all that they share) and their sketches allow it. A sketch has a bit for
each bucket of tokens, whether their number is odd; two sets differ in as many tokens as their sketches in bits, at least.
Such sets are joined to a family, which therefore holds all links of its members; sets that share a few tokens by chance,
of which there are more the more texts there are, are not joined. Each set is shipped to its family once. Families of many sets are cut into cells: every cell meets the first one, then
the sets outside the largest component meet every cell, in blocks. No link is lost, and copies (equal sets) count once.

Nulls, empty texts and texts without words have the empty set and link with nothing. With fewer words than a shingle
the whole sequence is the only shingle. Repeated rows are copies. Tokens are 64-bit hashes, sets 128-bit digests.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import chunks, mixed, query, slice_hashes, table, texts, words_of
from .components import components

CHUNK_BYTES = 1 << 19
CELL_SETS, CELL_TOKENS, FANOUT, UNARY = 1024, 400_000, 8, 4
#: The share of the hash space in which tokens are ranked, in beginnings; the number of sets from which tokens are all
#: alike; bytes of the bitmaps of a tree's leaves.
RANKED, ALIKE, BITMAP_BYTES = 2, 1000, 1 << 26
#: Rows of tokens and sets that are looked at together; half as many sets of one token in reach of each other are linked
#: unseen. Words of a sketch.
JOIN_ROWS, SKETCH = 1 << 14, ["sketch0", "sketch1", "sketch2", "sketch3"]
#: Rows and bytes of a batch for the Python workers: few texts or many tokens.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1 << 14, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


def shingle_sets(strings: list[str], words: int) -> list:
    """The sorted distinct shingles of each string."""
    import numpy as np

    data, starts, ends, counts = words_of(strings)
    hashes = slice_hashes(data, starts, ends)
    factor = np.uint64(0x9E3779B97F4A7C15)
    runs = hashes[: max(0, len(hashes) - words + 1)].copy()
    for i in range(1, words):
        runs = mixed(runs * factor + hashes[i : i + len(runs)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(runs[at : at + n - words + 1]))
        else:
            short = np.full(min(n, 1), n, dtype=np.uint64)
            for h in hashes[at : at + n]:
                short = mixed(short * factor + h)
            out.append(short)
        at += n
    return out


def digest(tokens) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def overlap_needed(total, percent: int):
    """The smallest overlap with which two sets of ``total`` tokens together reach ``percent``."""
    return -(-percent * total // (100 + percent))


def first_tokens(n: int, percent: int) -> int:
    """How many of its first tokens a set of ``n`` must show, so that any set within the threshold shows one of them."""
    return n + (-percent * n // 100) + 1


def ranked_below(percent: int) -> int:
    """Tokens under this hash are ordered by the number of their sets."""
    return min(2**64 - 1, RANKED * (100 - percent) * 2**64 // 100)


def tree_links(sets: list, percent: int, labels=None) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``sets``, beyond what equal ``labels`` connect already."""
    import numpy as np

    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.lexsort((sizes, np.array([s[0] for s in sets], dtype=np.uint64)))
    sets, sizes = [sets[i] for i in order], sizes[order]
    labels = (np.arange(n) if labels is None else np.asarray(labels))[order].copy()
    buckets = max(64, 1 << int(sizes.max() // 2).bit_length())
    while buckets > 64 and n * buckets > BITMAP_BYTES:
        buckets >>= 1
    cells = np.repeat(np.arange(n), sizes) * buckets + (np.concatenate(sets) & np.uint64(buckets - 1)).astype(np.int64)
    cell, count = np.unique(cells, return_counts=True)
    unary = np.zeros(n * buckets, np.uint8)
    unary[cell] = (1 << np.minimum(count, UNARY)) - 1
    unary = unary.reshape(n, buckets)
    bits = np.ascontiguousarray(unary[:, 0::2] | unary[:, 1::2] << 4).view(np.uint64)
    spill = np.bincount(cell // buckets, np.maximum(count - UNARY, 0), n).astype(np.int64)
    levels = [(bits, spill, sizes, sizes)]
    while len(levels[-1][0]) > 1:
        bits, spill, low, high = levels[-1]
        at = np.arange(0, len(bits), FANOUT)
        levels.append(
            (np.bitwise_or.reduceat(bits, at), np.maximum.reduceat(spill, at), np.minimum.reduceat(low, at),
             np.maximum.reduceat(high, at))
        )
    left = right = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        bits, spill, low, high = levels[depth]
        first = np.minimum.reduceat(labels, np.arange(0, n, FANOUT**depth))
        last = np.maximum.reduceat(labels, np.arange(0, n, FANOUT**depth))
        keep = []
        for i in range(0, len(left), 1 << 15):
            a, b = left[i : i + (1 << 15)], right[i : i + (1 << 15)]
            most = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(spill[a], spill[b])
            most = np.minimum(most, np.minimum(high[a], high[b]))
            ok = most >= overlap_needed(low[a] + low[b], percent)
            ok &= (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
            ok &= (np.minimum(first[a], first[b]) != np.maximum(last[a], last[b])) & ((a != b) | (depth > 0))
            keep.append(ok)
        keep = np.concatenate(keep)
        left, right = left[keep], right[keep]
        if depth:
            step = np.arange(FANOUT)
            down = len(levels[depth - 1][0])
            a = np.repeat(left[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
            b = np.tile(right[:, None] * FANOUT + step, (1, FANOUT)).ravel()
            inside = (a < down) & (b < down) & (a <= b)
            left, right = a[inside], b[inside]
    links = []
    for i in range(0, len(left), 4096):
        a, b = left[i : i + 4096], right[i : i + 4096]
        open_ = labels[a] != labels[b]
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            if labels[x] != labels[y]:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    labels[labels == labels[y]] = labels[x]
                    links.append((int(order[x]), int(order[y])))
    return links


def sketches(sets: list):
    """A row of words for each set: of each bucket of its tokens, whether their number is odd."""
    import numpy as np

    bits = 64 * len(SKETCH)
    at = np.repeat(np.arange(len(sets)) * bits, [len(s) for s in sets])
    tokens = np.concatenate([np.empty(0, np.uint64), *sets])
    odd = np.bincount(at + (tokens & np.uint64(bits - 1)).astype(np.int64), minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sets), len(SKETCH))


def shingle_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``digest`` of each set, ``node``, the first bytes of the digest,
    ``short``, how many more tokens its beginning has than are ranked, and its sketch."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        limit = np.uint64(ranked_below(percent))
        for batch in chunks(batches, CHUNK_BYTES):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            digests = [digest(s) for s in sets]
            out = [
                batch.column(2),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([_node(d) for d in digests], pa.int64()),
                pa.array([first_tokens(len(s), percent) - int(np.searchsorted(s, limit)) for s in sets], pa.int64()),
                *map(pa.array, np.ascontiguousarray(sketches(sets).T)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names)

    names = ["doc_id", "text_hash", "n_shingles", "digest", "node", "short", *SKETCH]
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'digest' else 'bigint'}" for c in names))


def _node(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def offered_tokens(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``token``, ``node``: the ranked tokens of each distinct set, and the next ones of sets that have too few of them;
    copies in one task offer theirs once."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        limit, seen = np.uint64(ranked_below(percent)), set()
        for batch in chunks(batches, CHUNK_BYTES):
            tokens, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for own in shingle_sets(batch.column(1).to_pylist(), words):
                if len(own) and (node := _node(digest(own))) not in seen:
                    seen.add(node)
                    tokens.append(own[: max(int(np.searchsorted(own, limit)), first_tokens(len(own), percent))])
                    nodes.append(np.full(len(tokens[-1]), node))
            columns = [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node"])

    return texts(docs).mapInArrow(run, "token bigint, node bigint")


def _shared_runs(batches: Iterator):
    """From (token, node) in order: those of tokens with two nodes at least, with ``sets``, their number up to ALIKE."""
    import numpy as np
    import pyarrow as pa

    token, node, alike = np.empty(0, np.int64), np.empty(0, np.int64), None

    def out(t, n, sets):
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(n), pa.array(sets)], ["token", "node", "sets"])

    def finished(t, n):
        new = np.r_[True, t[1:] != t[:-1]] if len(t) else np.empty(0, bool)
        sets = np.minimum(np.diff(np.flatnonzero(np.r_[new, True])), ALIKE)[np.cumsum(new) - 1]
        if alike is not None:
            sets[t == alike] = ALIKE
        some = sets > 1
        return out(t[some], n[some], sets[some])

    for batch in batches:
        token = np.concatenate([token, batch.column(0).to_numpy()])
        node = np.concatenate([node, batch.column(1).to_numpy()])
        other = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(token) else np.empty(0, bool)
        token, node = token[other], node[other]
        if not len(token):
            continue
        # the last token may go on; once it has so many sets, what comes is alike
        last = token[-1]
        begin = int(np.searchsorted(token, last))
        yield finished(token[:begin], node[:begin])
        token, node = token[begin:], node[begin:]
        if len(token) >= ALIKE or last == alike:
            alike = last
            yield finished(token[:-1], node[:-1])
            token, node = token[-1:], node[-1:]
    yield finished(token, node)


def _merged(label, a, b):
    """``label``, the first row of each row's component, after linking rows ``a`` and ``b``."""
    import numpy as np

    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def _linked_rows(token, n, place, sketch, free, begin: int, percent: int):
    """Of rows in order of (token, n), the first row of each row's component, by pairs of one token that may be within
    the threshold. Of each pair one row is at ``begin`` or behind it; pairs with a ``free`` row need only fit in size."""
    import numpy as np

    label, i, k, found, held = np.arange(len(token)), np.arange(len(token)), 0, [], 0
    while len(i):
        k += 1
        i = i[: np.searchsorted(i, len(token) - k)]
        i = i[(token[i] == token[i + k]) & (100 * n[i] >= percent * n[i + k])]  # else no later row fits either
        a = i[(i + k >= begin) & (label[i] != label[i + k])]
        need = overlap_needed(n[a] + n[a + k], percent)
        ok = free[a] | (1 + np.minimum(n[a] - place[a], n[a + k] - place[a + k]) >= need)
        a, need = a[ok], need[ok]
        apart = np.bitwise_count(sketch[a] ^ sketch[a + k]).sum(axis=1, dtype=np.int64)
        a = a[free[a] | (apart <= n[a] + n[a + k] - 2 * need)]
        if len(a):
            found.append((a, a + k))
            held += len(a)
        if held > JOIN_ROWS or held and not len(i):
            label, found, held = _merged(label, *map(np.concatenate, zip(*found))), [], 0
    return label


def _candidates(batches: Iterator, percent: int):
    """From (token, node, n, place, sketch) in order of token and n: links (nodes a, b) that join all sets of a token
    that may be within the threshold.

    ``place`` is where the token stands in the set, or earlier. If too many sets of one token are in reach of each
    other, they are linked unseen, and the last one stands for all of them.
    """
    import numpy as np
    import pyarrow as pa

    def looked_at(batches, rows, free):
        """Links of ``rows`` and ``batches``, and what later rows may meet."""
        columns = [np.concatenate([r, *(b.column(i).to_numpy() for b in batches)]) for i, r in enumerate(rows)]
        token, node, n, place, *words = columns
        begin, free = len(free), np.r_[free, np.zeros(len(token) - len(free), bool)]
        sketch = np.stack(words, axis=1).view(np.uint64)
        label = _linked_rows(token, n, place, sketch, free, begin, percent)
        other = np.flatnonzero(label != np.arange(len(label)))
        links = [node[other], node[label[other]]]
        stay = np.flatnonzero((token == token[-1]) & (100 * n >= percent * n[-1])) if len(token) else np.empty(0, int)
        if len(stay) > JOIN_ROWS // 2:
            links = [np.r_[links[0], node[stay[:-1]]], np.r_[links[1], np.full(len(stay) - 1, node[-1])]]
            stay, free = stay[-1:], np.ones(len(token), bool)
        out = pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["a", "b"])
        return out, [c[stay] for c in columns], free[stay]

    rows, free, waiting, held = [np.empty(0, np.int64)] * (4 + len(SKETCH)), np.empty(0, bool), [], 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= JOIN_ROWS:
            out, rows, free = looked_at(waiting, rows, free)
            waiting, held = [], 0
            yield out
    yield looked_at(waiting, rows, free)[0]


def _family_links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (nodes a, b) that join all sets which share one of their first tokens and may be within the threshold."""
    offers = offered_tokens(docs, words, percent).repartition("token").sortWithinPartitions("token", "node")
    shared = materialize(offers.mapInArrow(_shared_runs, "token bigint, node bigint, sets bigint"))
    # hashes as signed numbers: the ranked ones are those that are not negative and under the limit, or wrap around
    limit = ranked_below(percent)
    high = F.col("token") < 0
    ranked = (~high & (F.col("token") < limit)) if limit < 2**63 else (~high | (F.col("token") < limit - 2**64))
    by_rank = shared.where(ranked).join(classes.select("node", "n_shingles", "short"), "node")
    order = W.partitionBy("node").orderBy("sets", "token")
    count = F.count(F.lit(1)).over(W.partitionBy("node"))
    placed = by_rank.withColumn("place", F.row_number().over(order)).withColumn("shared", count)
    # tokens that no other set has come first, and there are so many of the beginning left for shared ones
    placed = placed.where(F.col("place") <= F.col("short") + F.col("shared")).join(classes.select("node", *SKETCH), "node")
    others = shared.where(~ranked).join(classes.select("node", "n_shingles", "short", *SKETCH), "node")
    first = F.expr(f"n_shingles - ({percent} * n_shingles + 99) div 100 + 1")
    keys = [
        rows.select("token", "node", F.col("n_shingles").alias("n"), (first - F.col("short") + place).alias("place"), *SKETCH)
        for rows, place in ((placed, F.col("place") - F.col("shared")), (others, F.lit(1)))
    ]
    keys = keys[0].unionByName(keys[1]).repartition("token").sortWithinPartitions("token", "n")
    return keys.mapInArrow(functools.partial(_candidates, percent=percent), "a bigint, b bigint")


def _joined(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (digests a, b) within the units of ``members`` (text, digest, units, label)."""

    def sets_of(batches: Iterator):
        import pyarrow as pa

        for batch in chunks(batches, CHUNK_BYTES):
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist(), words)
            column = pa.array([s.tobytes() for s in sets], pa.binary())
            own = [digest(s) == d for s, d in zip(sets, batch.column(batch.schema.get_field_index("digest")).to_pylist())]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("units", "digest", "label")]
            out = pa.RecordBatch.from_arrays([*columns, column], ["units", "digest", "label", "tokens"])
            yield out.filter(pa.array(own, pa.bool_()))

    def join_units(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        def links(rows: dict):
            digests = list(rows)
            label = {}
            seeds = [label.setdefault(rows[d][0], len(label)) for d in digests]
            found = tree_links([np.frombuffer(rows[d][1], np.uint64) for d in digests], percent, seeds)
            pairs = [[digests[i] for i, _ in found], [digests[j] for _, j in found]]
            return pa.RecordBatch.from_arrays([pa.array(p, pa.binary()) for p in pairs], ["a", "b"])

        unit, rows = None, {}
        for batch in batches:
            for u, d, label, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit:
                    if len(rows) > 1:
                        yield links(rows)
                    unit, rows = u, {}
                rows[d] = (label, tokens)
        if len(rows) > 1:
            yield links(rows)

    sets = members.select("text", "units", "digest", "label").mapInArrow(sets_of, "units array<string>, digest binary, label binary, tokens binary")
    units = sets.select(F.explode("units").alias("unit"), "digest", "label", "tokens")
    units = units.repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(join_units, "a binary, b binary")


@contextlib.contextmanager
def _batches(spark):
    """Meanwhile batches hold as much as ARROW says."""
    before = {k: spark.conf.get(k) for k in ARROW}
    try:
        for k, v in ARROW.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, the smallest id that links reach, and ``root``.

    ``root`` is one digest of the component, null for the empty set.
    """
    with _batches(docs.sparkSession):
        return _placed(docs, words, percent)


def _placed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    sets = materialize(shingle_table(docs, words, percent))
    classes = sets.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n_shingles", "node", "short", *SKETCH)]
    )
    classes = materialize(classes)
    families = components(_family_links(docs, classes, words, percent))
    members = classes.join(families, "node").select("digest", "id", F.col("n_shingles").alias("n"), F.col("root").alias("family"))
    load = members.groupBy("family").agg(
        F.ceil(F.greatest(F.sum("n") / CELL_TOKENS, F.count(F.lit(1)) / CELL_SETS)).alias("cells")
    )
    members = members.join(load, "family").withColumn("cell", F.pmod(F.xxhash64("digest"), "cells"))
    members = members.select("family", "digest", "id", "cells", "cell").hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    members = materialize(texts(docs).join(members, same).select("text", "family", "digest", "cells", "cell"))
    one = F.array(F.lit(0).cast("bigint"))
    meets = F.when(F.col("cells") == 1, one).when(F.col("cell") > 0, F.array("cell"))
    meets = meets.otherwise(F.expr("sequence(1L, greatest(1L, cells - 1))"))
    unit = F.transform(meets, lambda u: F.concat_ws(":", F.col("family"), u))
    first = members.select("text", "digest", unit.alias("units"), F.col("digest").alias("label"))
    links = materialize(_joined(first, words, percent))
    found = components(links)

    crowded = members.where("cells > 1")
    large = crowded.select("family", "digest", "cells", "cell").distinct()
    if not large.isEmpty():
        roots = found.select(F.col("node").alias("digest"), "root")
        large = materialize(large.join(roots, "digest", "left").withColumn("label", F.coalesce("root", "digest")).drop("root"))
        shares = large.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
        main = shares.groupBy("family").agg(
            F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")
        )
        strays = main.where(F.col("all") > F.col("most")).withColumn(
            "blocks", F.ceil((F.col("all") - F.col("most")) / CELL_SETS)
        )
        rest = large.join(strays, "family")
        stray = F.col("label") != F.col("main")
        block = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("blocks"))
        name = lambda b, c: F.concat_ws(":", F.col("family"), b, c)
        in_cell = F.transform(F.expr("sequence(0L, blocks - 1)"), lambda b: name(b, F.col("cell")))
        in_block = F.transform(F.expr("sequence(0L, cells - 1)"), lambda c: name(block, c))
        units = F.when(stray, F.array_union(in_cell, in_block)).otherwise(in_cell)
        second = crowded.select("text", "digest").join(rest.select("digest", units.alias("units"), "label"), "digest")
        more = materialize(_joined(second, words, percent))
        if not more.isEmpty():
            found = components(links.unionByName(more))

    roots = found.select(F.col("node").alias("digest"), "root")
    placed = classes.select("digest", "id").join(roots, "digest", "left")
    least = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("component"))
    placed = placed.join(least, "root", "left").select(
        "digest", F.coalesce("component", "id").alias("component"), F.coalesce("root", "digest").alias("root")
    )
    joined = sets.join(materialize(placed), "digest", "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return joined.select("doc_id", "text_hash", "n_shingles", component, "root")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (with doc_id and text) with one row of each component, that of the smallest id."""
    found = materialize(near_duplicates(docs, words, percent))
    stays = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"))
    stays = stays.select("s.*").unionByName(found.where("root is null").select("doc_id", "text_hash"))
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    marked = docs.withColumn("__text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    kept = marked.join(stays.hint("shuffle_hash"), same, "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_hash"]).select(docs.columns)


@query("op9_signature_trees")
def op9(spark, sf_dir):
    """Every document with its component under four-word shingles and a similarity of 0.85."""
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")
