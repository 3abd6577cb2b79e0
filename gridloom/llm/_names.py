"""Rounds of naming: which of many strings occur elsewhere, and which occur earlier.

A block is a run of rows of one input partition (at most about BLOCK bytes of
text). In a round every block turns its strings into 64-bit names in order of
position, drops local repeats, and sends the sorted distinct names to buckets by
their upper bits. A bucket sorts (name, document) pairs and sends back two bits
for each name: it occurs in another block, and an earlier document (smaller
doc_id) has it. The bits of a block end in one file in the shared folder, read
when the block is met in the next round. So a hot string costs one name a block,
names need no positions, and text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._bytes import U, release, releasing, text_bytes
from ._shared import SharedDir

#: Bytes of text in a block, but for one longer text.
BLOCK = 4 << 20
LAST_ID = np.iinfo(np.int64).max


class Block:
    """Rows of one block in order of doc_id (null last), with their text's bytes."""

    def __init__(self, table: pa.Table, key: str) -> None:
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end")
        self.table, self.key = table.take(order), key
        self.data, self.offsets = text_bytes(self.table["text"])
        self.ids = self.table["doc_id"].combine_chunks().cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK) -> Iterator[Block]:
    """Cuts a partition's rows into blocks, alike for whatever sizes the batches have."""
    part, sub, held, size = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum(pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy(), dtype=np.int64) if len(table) else np.empty(0, np.int64)
        at = 0
        while at < len(table):
            base = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, base + limit - size, "left")) + 1
            piece = table.slice(at, min(stop, len(table)) - at)
            held.append(piece)
            size += int(ends[at + len(piece) - 1] - base)
            at += len(piece)
            if size >= limit:
                yield Block(pa.concat_tables(held), f"{part}-{sub}")
                held, size, sub = [], 0, sub + 1
                release()
    if held:
        yield Block(pa.concat_tables(held), f"{part}-{sub}")
        held.clear()
        release()


class Sorted:
    """Names in order of position as a sorted list of distinct ones."""

    def __init__(self, names: np.ndarray) -> None:
        self.order = np.argsort(names, kind="stable")
        ranked = names[self.order]
        self.first = np.ones(len(names), bool)
        self.first[1:] = ranked[1:] != ranked[:-1]
        self.names = ranked[self.first]

    def spread(self, bits: np.ndarray, others: bool) -> np.ndarray:
        """Bits of the distinct names for all positions: a name's first position gets its bit, the others ``others`` or the bit."""
        group = np.cumsum(self.first) - 1
        out = np.empty(len(self.order), bool)
        out[self.order] = np.where(self.first, bits[group], others)
        return out

    def alone(self) -> np.ndarray:
        """For each distinct name: it has one position here."""
        counts = np.diff(np.append(np.flatnonzero(self.first), len(self.order)))
        return counts == 1


def _pack(names: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Header, sorted names as 6-byte gaps where they fit, documents as an index into a list."""
    docs, index = np.unique(ids, return_inverse=True)
    gaps = np.diff(names, prepend=U(0))
    gaps[0] = 0
    small = not len(gaps) or int(gaps.max()) < 1 << 48
    body = gaps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if small else names.tobytes()
    index = index.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32)
    return [np.array([len(names), len(docs), small, names[0] if len(names) else 0], U).tobytes() + docs.tobytes() + index.tobytes() + body]


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, small, start = (int(x) for x in np.frombuffer(raw, U, 4))
    docs = np.frombuffer(raw, np.int64, m, 32)
    kind = np.uint16 if m <= 1 << 16 else np.uint32
    index = np.frombuffer(raw, kind, n, at := 32 + 8 * m)
    at += n * np.dtype(kind).itemsize
    if not small:
        return np.frombuffer(raw, U, n, at), docs[index]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, at).reshape(n, 6)
    return np.cumsum(wide.reshape(-1).view(U), dtype=U) + U(start), docs[index]


@releasing
def _reduce(table: pa.Table) -> pa.Table:
    keys, bucket = table["block"].to_pylist(), table["bucket"][0].as_py()
    parts = sorted(zip(keys, (x.as_buffer() for x in table["payload"]), strict=True), key=lambda p: p[0])
    got = [_unpack(raw) for _, raw in parts]
    sizes = [len(n) for n, _ in got]
    names, ids = np.concatenate([n for n, _ in got]), np.concatenate([i for _, i in got])
    del got
    order = np.lexsort((ids, names))
    ranked = names[order]
    del ids
    same = np.zeros(len(names) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    later, twice = np.empty(len(names), bool), np.empty(len(names), bool)
    later[order], twice[order] = same[:-1], same[:-1] | same[1:]
    cuts = np.cumsum(sizes)[:-1]
    bits = [np.packbits(np.concatenate([a, b])).tobytes() for a, b in zip(np.split(later, cuts), np.split(twice, cuts), strict=True)]
    return pa.table({"block": [k for k, _ in parts], "bucket": pa.array([bucket] * len(parts), pa.int32()), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())})


def name_round(docs: DataFrame, emit: Callable[[Block], tuple[np.ndarray, np.ndarray]], n_buckets: int, out: SharedDir, label: str) -> None:
    """Runs a round over ``docs`` (doc_id, text); ``emit`` gives a block's names and each one's row, in order of position."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            names, rows = emit(block)
            mine = Sorted(names)
            ids = block.ids[rows[mine.order[mine.first]]]
            ends = np.searchsorted((mine.names >> U(40)) * U(n_buckets) >> U(24), np.arange(n_buckets + 1, dtype=U), "left")
            for b in range(n_buckets):
                if ends[b + 1] > ends[b]:
                    raw = _pack(mine.names[ends[b] : ends[b + 1]], ids[ends[b] : ends[b + 1]])
                    yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "block": [block.key], "payload": pa.array(raw, pa.binary())})

    @releasing
    def keep(table: pa.Table) -> pa.Table:
        key = table["block"][0].as_py()
        rows = sorted(zip(table["bucket"].to_pylist(), table["n"].to_pylist(), table["bits"].to_pylist(), strict=True))
        both = [np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * n).astype(bool) for _, n, bits in rows]
        later, twice = (np.concatenate([x[half * len(x) // 2 : (half + 1) * len(x) // 2] for x in both]) for half in (0, 1))
        out.write(f"{label}/{key}", np.array([len(later)], U), np.packbits(later), np.packbits(twice))
        return pa.table({"block": [key], "n": pa.array([len(later)], pa.int64())})

    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket int, block string, payload binary")
    back = sent.groupBy("bucket").applyInArrow(_reduce, "block string, bucket int, n long, bits binary")
    back.groupBy("block").applyInArrow(keep, "block string, n long").agg({"n": "sum"}).collect()


def bits_of(block: Block, mine: Sorted, out: SharedDir, label: str) -> tuple[np.ndarray, np.ndarray]:
    """What the round said of a block's distinct names: an earlier document has it, another block has it."""
    if not len(mine.names):
        return np.empty(0, bool), np.empty(0, bool)
    with out.open(f"{label}/{block.key}") as f:
        raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[:8].view(U)[0])
    if n != len(mine.names):
        raise RuntimeError(f"block {block.key} has {len(mine.names)} names and had {n}: the input's partitions changed between two reads")
    half = (n + 7) // 8
    return tuple(np.unpackbits(raw[8 + i * half : 8 + (i + 1) * half], count=n).astype(bool) for i in (0, 1))
