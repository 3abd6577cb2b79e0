"""Suffix-array dedup: removes repeats of long byte strings by prefix doubling, with hashes for ranks.

A position's rank for L bytes is a 64-bit name of these bytes; pairing the names of
positions p and p + L' gives those of L + L' bytes. Names are equal where ranks would
be, so that what matters here - is a string unique, which of several is first - needs
no order among different strings, and no rank has to travel back. Names go to buckets
by their upper bits and are sorted there (see _names); positions whose name is unique
leave, the others go on until the threshold. Three rounds suffice:

1. whole texts: later copies need no positions at all,
2. names of 32 bytes at window minima: every ``threshold``-byte string holds the
   minimum of its 32-byte names, so a unique minimum makes the string unique,
3. names of ``threshold`` bytes, doubled within the worker from those of 32, at the
   positions that are left: the earliest stays.

Equal strings get equal names; different ones share a 64-bit name with probability
2**-64 a pair. ``ranked_starts`` is the same with true ranks: Spark sorts pairs of
ranks of all positions. Its rows are the text many times over (the README has
figures), so the operator doesn't use it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import TILE, U, mix, prefix_hash, sliding_min
from ._names import LAST_ID, Block, Sorted, bits_of, blocks, name_round
from ._shared import SharedDir, buckets_for, settle


#: Bytes of text that make the first rank of ranked_starts.
FIRST = 8


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + b)


class _Spans:
    """The strings of ``threshold`` bytes of a block."""

    def __init__(self, threshold: int) -> None:
        self.t = threshold
        self.k = max(1, min(32, threshold // 3))
        self.w = threshold - self.k + 1

    def copies(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Names of whole texts that are long enough."""
        size = np.diff(block.offsets)
        rows = np.flatnonzero(size >= self.t)
        raw = block.data
        names = [hashlib.blake2b(raw[block.offsets[r] : block.offsets[r + 1]], digest_size=8).digest() for r in rows]
        return np.frombuffer(b"".join(names), U), rows

    def tiles(self, block: Block, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per tile: valid positions (in the block's bytes), their rows, and the tile's 32-byte names with the first one's position."""
        off, n = block.offsets, len(block.data)
        for a in range(0, n, TILE):
            b = min(a + TILE, n)
            first, last = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")
            if not keep[first:last].any():
                continue
            rows = np.repeat(np.arange(first, last), np.minimum(off[first + 1 : last + 1], b) - np.maximum(off[first:last], a))
            at = np.arange(a, b)
            fine = keep[rows] & (at + self.t <= off[rows + 1])
            if not fine.any():
                continue
            p, down = prefix_hash(block.data[a : min(n, b + self.t)])
            names = mix((p[self.k :] - p[: -self.k]) * down[: len(p) - self.k]) if len(p) > self.k else np.empty(0, U)
            yield at[fine], rows[fine], names, a

    def anchors(self, block: Block, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Per tile: names and rows of the window minima, the number of positions each is minimum for, those positions, the names."""
        for at, rows, names, a in self.tiles(block, keep):
            mark = (names & ~U(0xFFFFF)) | np.arange(len(names), dtype=U)
            where = (sliding_min(mark, self.w)[at - a] & U(0xFFFFF)).astype(np.int64)
            new = np.ones(len(where), bool)
            new[1:] = (where[1:] != where[:-1]) | (rows[1:] != rows[:-1])
            start = np.flatnonzero(new)
            yield names[where[start]], rows[start], np.diff(np.append(start, len(at))), at, names, a

    def spans(self, at: np.ndarray, names: np.ndarray, a: int) -> np.ndarray:
        """Names of ``threshold`` bytes by doubling."""
        have = self.k
        while have < self.t:
            step = min(have, self.t - have)
            names, have = _pair(names[:-step], names[step:]), have + step
        return names[at - a]


def repeated_spans(docs: DataFrame, threshold: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every byte that lies in a ``threshold``-byte string which also starts earlier.

    Earlier: in a document with smaller doc_id, or in the same one further left
    (overlaps count). Strings are judged on the input and never cross documents.

    Returns per row of ``docs`` the columns ``carry``, then doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 (lowercase hex of the
    remaining bytes) and kept (those bytes as text; a character cut in half goes).

    Null and empty texts: 0 bytes, nothing removed. Null doc_ids come last in the
    order. Rows with equal doc_id keep the one met first. Extra columns are ignored
    unless carried; a carried column that clashes with a result's name comes under
    its own name with a leading underscore. ``docs`` is read four times and must be
    dealt alike each time, as files and checkpoints are; a change raises an error.
    """
    spark, work = docs.sparkSession, _Spans(threshold)
    own = {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"}
    n_buckets, out = buckets_for(spark, docs), SharedDir.new(spark, "spans")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def fresh(block: Block) -> np.ndarray:
        """Rows that are no later copy of a whole text."""
        names, rows = work.copies(block)
        mine = Sorted(names)
        later, _ = bits_of(block, mine, out, "copies")
        keep = np.ones(len(block.ids), bool)
        keep[rows[mine.spread(later, True)]] = False
        return keep

    def emit_anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
        got = [(n, r) for n, r, *_ in work.anchors(block, fresh(block))]
        return (np.concatenate([n for n, _ in got]), np.concatenate([r for _, r in got])) if got else (np.empty(0, U), np.empty(0, np.int64))

    def candidates(block: Block, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of the strings whose minimum occurs elsewhere."""
        anchors = [n for n, *_ in work.anchors(block, keep)]
        mine = Sorted(np.concatenate(anchors) if anchors else np.empty(0, U))
        _, twice = bits_of(block, mine, out, "anchors")
        again = mine.spread(twice | ~mine.alone(), True)
        got, done = [], 0
        for names, _, runs, at, grams, a in work.anchors(block, keep):
            use = np.repeat(again[done : done + len(names)], runs)
            done += len(names)
            if use.any():
                got.append((at[use], work.spans(at[use], grams, a)))
        return (np.concatenate([p for p, _ in got]), np.concatenate([n for _, n in got])) if got else (np.empty(0, np.int64), np.empty(0, U))

    def emit_spans(block: Block) -> tuple[np.ndarray, np.ndarray]:
        at, names = candidates(block, fresh(block))
        return names, np.searchsorted(block.offsets, at, "right") - 1

    fields = [T.StructField(f"_{f.name}" if f.name in own else f.name, f.dataType) for f in docs.schema if f.name in carry]
    schema = T.StructType([*fields, T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keep = fresh(block)
            at, names = candidates(block, keep)
            mine = Sorted(names)
            later, _ = bits_of(block, mine, out, "spans")
            gone = at[mine.spread(later, True)]
            dead = np.zeros(len(block.data), bool)
            new = np.ones(len(gone), bool)
            new[1:] = gone[1:] > gone[:-1] + threshold
            starts = np.flatnonzero(new)
            for i, j in zip(gone[starts].tolist(), gone[np.append(starts[1:], len(gone))[: len(starts)] - 1].tolist(), strict=True):
                dead[i : j + threshold] = True
            del at, names, mine, later, gone, new
            off = block.offsets
            for r in np.flatnonzero(~keep):
                dead[off[r] : off[r + 1]] = True
            rows = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for r in range(len(block.ids)):
                d, raw = dead[off[r] : off[r + 1]], block.data[off[r] : off[r + 1]]
                n = int(np.count_nonzero(d))
                left = raw[~d].tobytes() if n else raw.tobytes()
                rows["n_bytes"].append(len(d))
                rows["n_removed"].append(n)
                rows["n_spans"].append(int(d[0]) + int(np.count_nonzero(d[1:] & ~d[:-1])) if n else 0)
                rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                rows["kept"].append(left.decode("utf-8", "ignore"))
            table = block.table
            cols = {f.name: table[f"c{i}"].combine_chunks() for i, f in enumerate(fields)} | {"doc_id": table["doc_id"].combine_chunks()} | {k: pa.array(v, pa.string() if k.startswith("kept") else pa.int64()) for k, v in rows.items()}
            yield pa.record_batch(list(cols.values()), names=list(cols))

    name_round(slim, work.copies, n_buckets, out, "copies")
    name_round(slim, emit_anchors, n_buckets, out, "anchors")
    name_round(slim, emit_spans, n_buckets, out, "spans")
    kept = [f.name for f in docs.schema if f.name in carry]
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    return wide.mapInArrow(cut, schema)


def ranked_starts(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """Distributed prefix doubling as such: (row, pos) of every ``threshold``-byte string that also starts earlier.

    Ranks begin as 8 bytes of text. At offsets 8, 16, ... Spark joins each position's
    rank with that of the position one offset on, sorts the pairs in ranges and
    numbers the distinct ones; a position whose pair is unique leaves, and with it all
    that would need its rank. Each round is written to the shared folder. ``row``
    numbers the rows of ``docs`` in order of doc_id (null last).
    """
    order = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    now = settle(order.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "texts")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode() if text.is_valid else b""
                if len(raw) >= threshold:
                    eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), FIRST)
                    rank = np.ascontiguousarray(eight).view(">i8").reshape(-1).astype(np.int64)
                    yield pa.record_batch({"row": pa.array(np.full(len(rank), row)), "pos": pa.array(np.arange(len(rank))), "rank": pa.array(rank)})

    now, have = now.select("row", "text").mapInArrow(begin, "row long, pos long, rank long"), FIRST
    while have < threshold:
        step = min(have, threshold - have)
        ahead = now.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = now.join(ahead, ["row", "pos"]).repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Numbers distinct pairs of a range; ranges hold a pair whole."""
            seen, last = TaskContext.get().partitionId() << 40, None
            for batch in batches:
                a, b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                new[:1] = [last != (a[0], b[0])] if len(a) else []
                rank = seen + np.cumsum(new)
                if len(a):
                    seen, last = int(rank[-1]), (a[-1], b[-1])
                yield pa.record_batch({"row": batch.column(0), "pos": batch.column(1), "rank": pa.array(rank)})

        ranked = settle(pairs.select("row", "pos", "rank", "next").mapInArrow(number, "row long, pos long, rank long"), "ranks")
        counts = ranked.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1")
        now, have = ranked.join(counts, "rank", "left_semi").select("row", "pos", "rank"), have + step
    first = now.groupBy("rank").agg(F.min(F.struct("row", "pos")).alias("first"))
    return now.join(first, "rank").where(F.struct("row", "pos") != F.col("first")).select("row", "pos")


def op7_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_spans(docs, 100).drop("kept")
