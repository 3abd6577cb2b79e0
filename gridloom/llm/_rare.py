"""Candidate groups that stay large are split by their sets' rarest tokens.

Tokens are ordered by the number of sets of the large groups that hold them, ties
by hash. Two sets of likeness >= t have at least ceil(t * size) tokens in common,
for either's size, so they share one of the first size - ceil(t * size) + 1 tokens
of each in this order. Tokens of one set only have no partner. So many texts that
merely hold the same common passage do not meet, and a set whose own tokens
outnumber what may differ is linked with nothing.

Counts travel as in a round of names (see _names): packed, without texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytes import U, mix, releasing
from ._names import _pack, _unpack, blocks
from ._shared import SharedDir

#: Higher counts are taken for equal; then the hash decides, as with any tie.
MOST = (1 << 16) - 1


def star(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct signatures in order, for each its least holder, and pairs of every other holder with the least one."""
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    chief = who[new][np.cumsum(new) - 1] if len(sig) else who
    return sig[new], who[new], np.unique(np.stack([who, chief], axis=1)[who != chief], axis=0)


def cuts(names: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where sorted names are cut into buckets by their upper bits."""
    return np.searchsorted((names >> U(40)) * U(n_buckets) >> U(24), np.arange(n_buckets + 1, dtype=U), "left")


def rarest(s: np.ndarray, counts: np.ndarray, t: Fraction) -> np.ndarray:
    """Of a set's tokens with these counts those of which linked sets share one."""
    order = np.lexsort((s, counts))[: len(s) + 1 - -(-len(s) * t.numerator // t.denominator)]
    return s[order][counts[order] > 1]


def rare_links(texts: DataFrame, n: int, t: Fraction, n_buckets: int) -> DataFrame:
    """Edges (u, v) between ids of ``texts`` (doc_id: the id of its set, text; one row a set) that connect all sets which may be linked.

    The table is read twice and needs the same partitions each time; a change raises an error.
    """
    from .jaccard_join import Levels, shingle_sets

    out = SharedDir.new(texts.sparkSession, "counts")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            names, counts = np.unique(np.concatenate(shingle_sets(block.table["text"], n)), return_counts=True)
            ends = cuts(names, n_buckets)
            for b in np.flatnonzero(np.diff(ends)).tolist():
                k = slice(ends[b], ends[b + 1])
                yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "block": [block.key], "payload": pa.array(_pack(names[k], counts[k].astype(np.int64)), pa.binary())})

    @releasing
    def total(table: pa.Table) -> pa.Table:
        got = [_unpack(raw.as_buffer()) for raw in table["payload"]]
        _, at = np.unique(np.concatenate([names for names, _ in got]), return_inverse=True)
        sums = np.minimum(np.bincount(at, np.concatenate([counts for _, counts in got])), MOST).astype(np.uint16)[at]
        parts = np.split(sums, np.cumsum([len(names) for names, _ in got])[:-1])
        return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    @releasing
    def keep(table: pa.Table) -> pa.Table:
        key = table["block"][0].as_py()
        out.write(key, *[raw for _, raw in sorted(zip(table["bucket"].to_pylist(), table["counts"].to_pylist(), strict=True))])
        return pa.table({"n": pa.array([len(table)], pa.int64())})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(t)
        for block in blocks(batches):
            sets = shingle_sets(block.table["text"], n)
            names = np.unique(np.concatenate(sets))
            with out.open(block.key) as f:
                counts = np.frombuffer(f.read(), np.uint16)
            if len(counts) != len(names):
                raise RuntimeError(f"block {block.key} has {len(names)} tokens and had {len(counts)}: the input's partitions changed between two reads")
            sigs, whos = [np.empty(0, U)], [np.empty(0, np.int64)]
            for s, who in zip(sets, block.ids.tolist(), strict=True):
                rare, level = rarest(s, counts[np.searchsorted(names, s)], t), levels.of(len(s))
                for at in {level, max(level - 1, 0)}:  # linked sets lie in one level or in two neighbours
                    sigs.append(mix(rare + mix(np.array([at + 1], U))))
                    whos.append(np.full(len(rare), who, np.int64))
            sig, who, pairs = star(np.concatenate(sigs), np.concatenate(whos))
            ends = cuts(sig, n_buckets)
            for b in range(n_buckets):
                mine, k = pairs[len(pairs) * b // n_buckets : len(pairs) * (b + 1) // n_buckets], slice(ends[b], ends[b + 1])
                if len(mine) or ends[b + 1] > ends[b]:
                    raw = np.array([len(mine)], np.int64).tobytes() + mine.tobytes() + sig[k].tobytes() + who[k].tobytes()
                    yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "payload": pa.array([raw], pa.binary())})

    @releasing
    def meet(table: pa.Table) -> pa.Table:
        pairs, sigs, whos = [], [], []
        for raw in table["payload"]:
            x = np.frombuffer(raw.as_buffer(), np.int64)
            at = 1 + 2 * int(x[0])
            pairs.append(x[1:at].reshape(-1, 2))
            sig, who = np.split(x[at:], 2)
            sigs.append(sig.view(U))
            whos.append(who)
        pair = np.unique(np.concatenate([*pairs, star(np.concatenate(sigs), np.concatenate(whos))[2]]), axis=0)
        return pa.table({"u": pa.array(pair[:, 0]), "v": pa.array(pair[:, 1])})

    counted = texts.mapInArrow(send, "bucket int, block string, payload binary").groupBy("bucket").applyInArrow(total, "block string, bucket int, counts binary")
    counted.groupBy("block").applyInArrow(keep, "n long").agg({"n": "sum"}).collect()
    return texts.mapInArrow(emit, "bucket int, payload binary").groupBy("bucket").applyInArrow(meet, "u long, v long")
