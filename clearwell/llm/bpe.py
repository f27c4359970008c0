"""Byte-level BPE: encoding to ids with byte offsets, and decoding.

Texts are cut without a regular expression. Each code point has a class; each class is a function on the states of a
small automaton; functions compose associatively, so the state after every code point comes from a blocked prefix
scan over whole batches. A token starts where state, class and next class say so. The slices go through a cache of
merged pieces; slices that are not in it are merged together, one pair of each per round, in arrays.

Nulls count as empty texts, which have no ids. Texts of any length are encoded whole; a long text is one chunk.
Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, query, slice_hashes, table, texts

# Classes of code points. Letters that can stand in a contraction have classes of their own.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, ONE, RV, E, L = range(10)
# States: what the last code point belongs to. FRESH: an apostrophe that starts a token; MAYBE_E, MAYBE_L: such an
# apostrophe and the first letter of a contraction of two; DONE: a whole contraction.
START, IN_L, IN_N, IN_O, IN_B, IN_S, FRESH, MAYBE_E, MAYBE_L, DONE = range(10)
BLOCK = 128
CHUNK_BYTES = 1 << 19
CACHE_PIECES = 600_000
TABLE_BITS = 21


def _step(state: int, cls: int) -> int:
    if cls == BLANK:
        return IN_B
    if cls == SPACE:
        return IN_S
    if cls == NUMBER:
        return IN_N
    if cls == OTHER:
        return IN_O
    if cls == QUOTE:
        return IN_O if state in (IN_B, IN_O, FRESH) else FRESH
    if state == FRESH:
        return {ONE: DONE, RV: MAYBE_E, L: MAYBE_L}.get(cls, IN_L)
    if (state, cls) in ((MAYBE_E, E), (MAYBE_L, L)):
        return DONE
    return IN_L


@functools.cache
def transitions():
    """Class -> function, class at a text's start -> function, products, function -> state reached from START."""
    import numpy as np

    plain = [tuple(_step(s, c) for s in range(10)) for c in range(10)]
    first = [tuple([_step(START, c)] * 10) for c in range(10)]
    functions = list(dict.fromkeys(plain + first))
    for f in functions:  # grows while it is read, until closed under composition
        for g in plain + first:
            h = tuple(g[f[s]] for s in range(10))
            if h not in functions:
                functions.append(h)
    number = {f: i for i, f in enumerate(functions)}
    product = np.array([[number[tuple(g[x] for x in f)] for g in functions] for f in functions], dtype=np.uint8)
    return (
        np.array([number[f] for f in plain], dtype=np.uint8),
        np.array([number[f] for f in first], dtype=np.uint8),
        product,
        np.array([f[START] for f in functions], dtype=np.uint8),
    )


@functools.cache
def code_point_classes():
    """Class of every code point, from the Unicode tables of the tokenizer library itself."""
    import numpy as np
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ranks = {bytes([i]): i for i in range(256)}
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = cls
    for chars, cls in ((" ", BLANK), ("'", QUOTE), ("stmd", ONE), ("rv", RV), ("e", E), ("l", L)):
        classes[[ord(c) for c in chars]] = cls
    return classes


def scan(functions, product):
    """Inclusive prefix products: within blocks side by side, then over the blocks' totals, then joined."""
    import numpy as np

    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    k, flat = len(product), product.ravel()
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, dtype=np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    for i in range(1, BLOCK):
        flat.take(grid[i - 1] * np.uint16(k) + grid[i], out=grid[i])
    before = scan(grid[-1], product)[:-1].astype(np.uint16) * k
    for i in range(BLOCK):
        grid[i, 1:] = flat.take(before + grid[i, 1:])
    return np.ascontiguousarray(grid.T).ravel()[:n]


def token_starts(points, lengths):
    """Whether a token starts at each code point of texts that lie one after another."""
    import numpy as np

    plain, at_start, product, state_of = transitions()
    n = len(points)
    cls = code_point_classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[np.concatenate(([0], np.cumsum(lengths)))] = True
    state = state_of[scan(np.where(first[:n], at_start[cls], plain[cls]), product)]
    before = np.empty(n, dtype=np.uint8)
    before[1:] = state[:-1]
    before[first[:n]] = START
    after = np.zeros(n, dtype=np.uint8)
    after[:-1] = state[1:]
    after[first[1:]] = START
    letter = (cls == LETTER) | (cls >= ONE)
    white = (cls == BLANK) | (cls == SPACE)
    was_white = (before == IN_B) | (before == IN_S)
    more = np.zeros(n, dtype=bool)  # a code point that is no white space follows in the same text
    more[:-1] = ~white[1:]
    more &= ~first[1:]
    kind = np.zeros(10, dtype=np.uint8)  # bit 1: a letter starts a token after it, bit 2: other signs don't
    kind[[START, IN_N, IN_S, DONE]], kind[[FRESH, IN_B]], kind[IN_O] = 1, 2, 3
    kind = kind[before]
    fresh = (kind & 1) == 1
    in_two = ((state == MAYBE_E) | (state == MAYBE_L)) & (after == DONE)
    after_quote = (before == FRESH) & (state != DONE) & ~in_two
    starts = np.where(letter, fresh | after_quote, False)
    starts |= (cls == NUMBER) & (before != IN_N) & (before != IN_B)
    starts |= ((cls == OTHER) | (cls == QUOTE)) & (kind < 2)
    starts |= white & (~was_white | more)
    return starts


class Pieces:
    """Numbers byte slices as they come: a table from a 64-bit rolling hash to a number, with the bytes for a check.

    The table doubles before it is half full.
    """

    def __init__(self, mask: int = (1 << 64) - 1):
        import numpy as np

        self.mask = np.uint64(mask)  # a test narrows the hash
        self.bits = TABLE_BITS
        self.slots, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.bytes, self.ends = 0, np.empty(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)

    def hashes(self, data, starts, ends):
        import numpy as np

        return (slice_hashes(data, starts, ends) & self.mask) | np.uint64(1)

    def find(self, hashes):
        """Number of each hash, -1 if it has none."""
        import numpy as np

        found, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            key = self.slots[slot]
            hit = key == hashes[todo]
            found[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return found

    def add(self, hashes, data, starts, ends):
        """Number new slices; a hash that is there already keeps its number, and the slice gets one of its own."""
        import numpy as np

        numbers = np.arange(self.n, self.n + len(starts))
        lens = ends - starts
        while self.n + len(starts) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        old = self.ends[self.n]
        self.ends[self.n + 1 : self.n + len(starts) + 1] = old + np.cumsum(lens)
        self.n += len(starts)
        while self.ends[self.n] > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.empty_like(self.bytes)])
        at = np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        self.bytes[old : self.ends[self.n]] = data[at]
        if 2 * self.n > len(self.slots):
            there = np.flatnonzero(self.slots)
            old_hashes, old_numbers = self.slots[there], self.values[there]
            self.bits = max(self.bits + 1, (2 * self.n).bit_length())
            self.slots, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(old_hashes, old_numbers)
        self._place(hashes, numbers)
        return numbers

    def _place(self, hashes, numbers):
        """Enter hashes with their numbers; one that is there already is left as it is."""
        import numpy as np

        todo, slot = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = hashes[todo[free]]
            mine = free & (self.slots[slot] == hashes[todo])
            self.values[slot[mine]] = numbers[todo[mine]]
            on = ~mine & (self.slots[slot] != hashes[todo])
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)

    def differs(self, numbers, data, starts, ends):
        """Slices whose bytes are not those of their number."""
        import numpy as np

        lens, begin = ends - starts, self.ends[numbers]
        odd = lens != self.ends[numbers + 1] - begin
        same = np.flatnonzero(~odd)
        lens = lens[same]
        step = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        unlike = self.bytes[np.repeat(begin[same], lens) + step] != data[np.repeat(starts[same], lens) + step]
        odd[same[np.repeat(np.arange(len(same)), lens)[unlike]]] = True
        return np.flatnonzero(odd)


class Bpe:
    """An encoder over byte strings. ``pairs``: (left id, right id) -> (priority, id of both together)."""

    def __init__(self, tokens: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]], whole: bool):
        import numpy as np

        self.tokens = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.tokens[i] = token
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int32)
        self.byte_ids = np.array([tokens[bytes([i])] for i in range(256)], dtype=np.int64)
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.array(list(pairs.values()), dtype=np.int64)[order]
        self.none = int(values[:, 0].max()) + 1
        self.priority, self.result = np.append(values[:, 0], self.none), np.append(values[:, 1], -1)
        self.known = tokens if whole else {}
        both = np.arange(256)
        self.byte_pairs = self._lookup(self.byte_ids[both][:, None], self.byte_ids[both][None, :])
        self._reset()

    def _reset(self):
        import numpy as np

        self.cache = Pieces()
        self.flat, self.ends, self.used = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    @classmethod
    def from_ranks(cls, path: str) -> Bpe:
        """A rank file: any two neighbours whose joined bytes have a rank may merge, lowest rank first."""
        with open(path, "rb") as lines:
            tokens = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        pairs = {}
        for token, rank in tokens.items():
            for i in range(1, len(token)):
                if token[:i] in tokens and token[i:] in tokens:
                    pairs[tokens[token[:i]], tokens[token[i:]]] = (rank, rank)
        return cls(tokens, pairs, whole=True)

    @classmethod
    def from_json(cls, path: str) -> Bpe:
        """A tokenizer file with a vocabulary of byte-level tokens and a list of merges."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        to_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        tokens = {b: model["vocab"][t] for t, b in to_bytes.items()}
        pairs = {}
        for i, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs[model["vocab"][left], model["vocab"][right]] = (i, model["vocab"][left + right])
        return cls(tokens, pairs, whole=False)

    def _lookup(self, left, right):
        """Place of each pair in the table of pairs, the last place if it has none."""
        import numpy as np

        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def _merge(self, pieces: list[bytes]):
        """Ids of all pieces, one after another, and their counts: each round merges the best pair of each piece."""
        import numpy as np

        none = len(self.keys) - 1
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids, owner = self.byte_ids[data], np.repeat(np.arange(len(pieces)), lens)
        at = np.full(len(ids), none)  # of the pair that starts here
        at[:-1] = self.byte_pairs[data[:-1], data[1:]]
        at[np.cumsum(lens) - 1] = none
        done_ids, done_owner = [], []
        while len(ids):
            rank = self.priority[at]
            new = np.empty(len(ids), dtype=bool)
            new[0], new[1:] = True, owner[1:] != owner[:-1]
            begin = np.flatnonzero(new)
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(begin, append=len(ids))
            open_ = np.repeat(best < self.none, count)
            done_ids.append(ids[~open_])
            done_owner.append(owner[~open_])
            hit = np.flatnonzero((rank == np.repeat(best, count)) & open_)
            hit = hit[np.diff(owner[hit], prepend=-1) != 0]
            ids[hit] = self.result[at[hit]]
            at[hit] = at[hit + 1]  # of the pair with what follows, if anything does
            open_[hit + 1] = False
            stay = np.cumsum(open_) - 1
            ids, owner, at, hit = ids[open_], owner[open_], at[open_], stay[hit]
            if len(hit):
                follows = hit[hit + 1 < len(ids)]
                follows = follows[owner[follows + 1] == owner[follows]]
                at[follows] = self._lookup(ids[follows], ids[follows + 1])
                leads = hit[hit > 0]
                leads = leads[owner[leads - 1] == owner[leads]]
                at[leads - 1] = self._lookup(ids[leads - 1], ids[leads])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def _whole(self, pieces: list[bytes], ids, counts):
        """A slice that is a token is that token, whatever its merges lead to."""
        import numpy as np

        if not self.known:
            return ids, counts
        token = np.array([self.known.get(p, -1) for p in pieces], dtype=np.int64)
        odd = (token >= 0) & (counts != 1)
        if odd.any():
            keep = ~np.repeat(odd, counts)
            keep[(np.cumsum(counts) - counts)[odd]] = True
            ids = ids.copy()
            ids[(np.cumsum(counts) - counts)[odd]] = token[odd]
            ids, counts = ids[keep], np.where(odd, 1, counts)
        return ids, counts

    def _numbers(self, data, starts, ends):
        """The cache's number of each slice of ``data``; the new ones are merged together."""
        import numpy as np

        if self.cache.n > CACHE_PIECES:
            self._reset()
        hashes = self.cache.hashes(data, starts, ends)
        numbers = self.cache.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            distinct, first, place = np.unique(hashes[missing], return_index=True, return_inverse=True)
            numbers[missing] = self._add(distinct, data, starts[missing[first]], ends[missing[first]])[place]
        if len(odd := self.cache.differs(numbers, data, starts, ends)):
            numbers[odd] = self._add(hashes[odd], data, starts[odd], ends[odd])
        return numbers

    def _add(self, hashes, data, starts, ends):
        import numpy as np

        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        ids, counts = self._whole(pieces, *self._merge(pieces))
        numbers = self.cache.add(hashes, data, starts, ends)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.cache.n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[numbers + 1] = self.used + np.cumsum(counts)
        self.used += len(ids)
        return numbers

    def encode(self, strings: list[str]):
        """Ids of all strings, one after another, and the number of ids of each string."""
        import numpy as np

        joined = "".join(strings)
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(strings), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(token_starts(points, lengths))
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        ends = np.cumsum(width, dtype=np.int64)
        data = np.frombuffer(joined.encode(), np.uint8)
        cut = ends[starts] - width[starts]
        numbers = self._numbers(data, cut, np.append(cut[1:], len(data)))
        begin, count = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
        return ids, np.diff(total[bounds])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Bpe:
    """One encoder, with its cache, for each file and Python worker."""
    return Bpe.from_json(path) if path.endswith(".json") else Bpe.from_ranks(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``offsets``: the ids of each whole text, and the byte at which each one starts."""

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        bpe = encoder(path)
        for batch in chunks(batches, CHUNK_BYTES):
            ids, counts = bpe.encode(batch.column(1).to_pylist())
            bounds = np.concatenate(([0], np.cumsum(counts)))
            ends = np.concatenate(([0], np.cumsum(bpe.sizes[ids], dtype=np.int64)))
            offsets = (ends[:-1] - np.repeat(ends[bounds[:-1]], counts)).astype(np.int32)
            cut = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (ids, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "ids", "offsets"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encode`` with ``packed`` (ids as little-endian unsigned 32-bit integers) and ``decoded``.

    ``decoded`` holds bytes, as an id may end inside a character. A null list of ids is empty.
    """

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        token = encoder(path).tokens.__getitem__
        for batch in batches:
            ids = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            ends = np.asarray(ids.offsets)
            flat = np.asarray(ids.values)
            packed = flat.astype("<u4").tobytes()
            plain = flat.tolist()
            out = [
                pa.array([packed[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                pa.array([b"".join(map(token, plain[a:b])) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "packed", "decoded"])

    source = encoded.select("doc_id", "ids", "offsets")
    return source.mapInArrow(run, "doc_id bigint, ids array<int>, offsets array<int>, packed binary, decoded binary")


@query("op2_byte_bpe")
def op2(spark, sf_dir):
    """Every document encoded and decoded, as counts and digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
