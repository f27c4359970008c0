"""Packing examples into training sequences as vector bin packing.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. The dot-product heuristic fills one
sequence after another: of the examples that still fit, it takes the one whose demand vector has the largest dot
product with what the sequence has left, each dimension in units of its limit. Examples come in windows: a task holds
``window`` tails of fewer than ``tokens`` ids, full cuts of long examples leave at once, and what a window can't place
goes to the next one. There is no shuffle: each task packs the rows that it reads, and sequence numbers start with the
number of its partition, so a lost task is simply run again.

A gap of more than ``slack`` tokens is filled by cutting an example. The last sequence of a task is cut into sequences
whose lengths are powers of two, which need no padding. Null and empty texts have one token, the end. An example that
breaks a limit by itself is cut. Repeated rows are packed as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK_BYTES, encoder
from .common import chunks, query, table, texts

OUT = (
    "doc_id bigint, start bigint, length bigint, ids binary, loss_tokens bigint, doc_tokens bigint, "
    "sequence_id bigint, segment bigint, offset bigint"
)


@dataclass(frozen=True)
class Limits:
    """``loss`` None: as many as tokens. ``slack``: the largest gap that stays unfilled."""

    tokens: int = 2048
    segments: int = 512
    loss: int | None = None
    slack: int = 8
    window: int = 4096


class Packer:
    """Packs the examples of one task. Rows come out of ``ready``, as tuples in the order of ``OUT``."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.next = limits, first_sequence
        self.loss = limits.loss or limits.tokens
        self.items: list[tuple] = []  # key, start, ids, mask or None, tokens of the whole example
        self.ready: list[tuple] = []

    def _fitting(self, mask, tokens: int, loss: int) -> int:
        """The longest cut of at most ``tokens`` ids with at most ``loss`` loss-bearing ones."""
        import numpy as np

        if mask is None:
            return min(tokens, loss)
        return min(tokens, int(np.searchsorted(np.cumsum(mask[:tokens]), loss, side="right")))

    def add(self, key, ids, mask=None) -> None:
        start, total = 0, len(ids)
        while total - start >= self.limits.tokens or (mask is not None and int(mask[start:].sum()) > self.loss):
            n = self._fitting(None if mask is None else mask[start:], self.limits.tokens, self.loss)
            self._emit([(key, start, ids[start : start + n], None if mask is None else mask[start : start + n], total)])
            start += n
        if start < total:
            self.items.append((key, start, ids[start:].copy(), None if mask is None else mask[start:].copy(), total))
        if len(self.items) >= self.limits.window:
            self.pack(last=False)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for segment, (key, start, ids, mask, total) in enumerate(pieces):
            loss = len(ids) if mask is None else int(mask.sum())
            packed = ids.astype("<u4").tobytes()
            self.ready.append((key, start, len(ids), packed, loss, total, self.next, segment, offset))
            offset += len(ids)
        self.next += 1

    def pack(self, last: bool) -> None:
        """Fill sequences from the window; unless it is the last, what doesn't fill one waits for the next."""
        import numpy as np

        limits, items = self.limits, self.items
        need = np.array(
            [(len(i[2]), 1, len(i[2]) if i[3] is None else int(i[3].sum())) for i in items], dtype=np.int64
        ).reshape(-1, 3)
        order = np.argsort(-need[:, 0], kind="stable")
        items, need = [items[i] for i in order], need[order]
        limit = np.array([limits.tokens, limits.segments, self.loss], dtype=np.int64)
        open_ = np.arange(len(items))
        while len(open_):
            left, chosen, pool = limit.copy(), [], open_
            while len(pool):
                demand = need[pool]
                fits = (demand <= left).all(axis=1)
                pool, demand = pool[fits], demand[fits]
                if not len(pool):
                    break
                best = int(np.argmax(demand @ (left / limit / limit)))
                chosen.append(int(pool[best]))
                left -= demand[best]
                pool = np.delete(pool, best)
            taken = np.zeros(len(items), dtype=bool)
            taken[chosen] = True
            open_ = open_[~taken[open_]]
            pieces = [items[i] for i in chosen]
            if left[0] > limits.slack and left[1] and left[2] and len(open_):  # cut what is open, largest first
                i = int(open_[np.argmax(need[open_, 0])])
                key, start, ids, mask, total = items[i]
                if n := self._fitting(mask, int(left[0]), int(left[2])):
                    pieces.append((key, start, ids[:n], None if mask is None else mask[:n], total))
                    items[i] = (key, start + n, ids[n:], None if mask is None else mask[n:], total)
                    need[i, 0] -= n
                    need[i, 2] -= n if mask is None else int(mask[:n].sum())
                    left[0] -= n
            if len(open_) or left[0] <= limits.slack:
                self._emit(pieces)
            elif last:
                self._emit_powers(pieces)
            else:
                self.items = pieces
                return
        self.items = []

    def _emit_powers(self, pieces: list[tuple]) -> None:
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = room = 1 << (left.bit_length() - 1)
            some = []
            while room:
                key, start, ids, mask, total = pieces.pop(0)
                n = min(room, len(ids))
                some.append((key, start, ids[:n], None if mask is None else mask[:n], total))
                if n < len(ids):
                    pieces.insert(0, (key, start + n, ids[n:], None if mask is None else mask[n:], total))
                room -= n
            self._emit(some)
            left -= size

    def take(self, at_least: int = 1):
        import pyarrow as pa

        if len(self.ready) >= at_least:
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
            names = [c.split()[0] for c in OUT.split(", ")]
            rows, self.ready = self.ready, []
            for i in range(0, len(rows), 1024):
                columns = [pa.array(c, k) for c, k in zip(zip(*rows[i : i + 1024]), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)


def _packer(limits: Limits) -> Packer:
    from pyspark import TaskContext

    return Packer(limits, TaskContext.get().partitionId() << 36)


def pack_documents(docs: DataFrame, path: str, end_id: int, limits: Limits = Limits()) -> DataFrame:
    """Tokenise whole texts, end each with ``end_id`` and pack them: one row per piece, ids packed as uint32."""

    def run(batches: Iterator):
        import numpy as np

        bpe, packer = encoder(path), _packer(limits)
        for batch in chunks(batches, CHUNK_BYTES):
            ids, counts = bpe.encode(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            for key, n, end in zip(batch.column(0).to_pylist(), counts.tolist(), ends.tolist()):
                packer.add(key, np.append(ids[end - n : end], np.int32(end_id)))
            yield from packer.take(1024)
        packer.pack(last=True)
        yield from packer.take()

    return texts(docs).mapInArrow(run, OUT)


def pack_examples(
    examples: DataFrame, limits: Limits, id_col: str = "doc_id", ids_col: str = "ids", mask_col: str | None = None
) -> DataFrame:
    """Pack tokenised examples; ``mask_col`` marks with 1 the tokens that bear loss, without it all do.

    A null or empty list of ids gives no piece; a null mask marks every token.
    """
    mask = F.col(mask_col).cast("array<int>") if mask_col else F.lit(None).cast("array<int>")
    source = examples.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"), mask.alias("mask")
    )

    def run(batches: Iterator):
        import numpy as np

        packer = _packer(limits)
        for batch in batches:
            for key, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                marked = None if mask is None else np.array(mask, dtype=np.int8)
                packer.add(key, np.array(ids or [], dtype=np.int32), marked)
            yield from packer.take(1024)
        packer.pack(last=True)
        yield from packer.take()

    return source.mapInArrow(run, OUT)


@query("op4_packing")
def op4(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens, pieces with the checksum of their ids."""
    return pieces_of(table(spark, sf_dir, "documents"))


def pieces_of(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
