"""Document fingerprints by winnowing.

Every ``k`` bytes of a text have a rolling hash; of every ``window`` neighbouring
hashes the least is kept, the rightmost on ties, with its position. Two texts that
share a run of k + window - 1 bytes share a kept hash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import TILE, U, mix, prefix_hash, sliding_min, text_bytes
from ._shared import buckets_for

LOW = U(0xFFFFF)
FIRST_ID = -(1 << 63)
#: Characters of text that are held at once, but for one longer text.
HELD = 4 << 20


def winnow(data: np.ndarray, offsets: np.ndarray, k: int, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row (bytes data[offsets[i]:offsets[i + 1]]) the kept hashes (uint32) and their positions (uint32).

    A text of fewer than ``window`` hashes is one window; of fewer than k bytes, but
    not none, it has the hash of the whole; an empty one has none.
    """
    hashes, places, rows = [], [], []
    n, size = len(data), np.diff(offsets)
    for a in range(0, n, TILE):
        b = min(a + TILE, n)
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        row = np.repeat(np.arange(first, last), np.minimum(offsets[first + 1 : last + 1], b) - np.maximum(offsets[first:last], a))
        at = np.arange(a, b)
        fine = at + (k + window - 1) <= offsets[row + 1]
        if not fine.any():
            continue
        p, down = prefix_hash(data[a : min(n, b + k + window)])
        h = mix((p[k:] - p[:-k]) * down[: len(p) - k])
        mark = (h & ~LOW) | (LOW - np.arange(len(h), dtype=U))
        where = (LOW - (sliding_min(mark, window)[at[fine] - a] & LOW)).astype(np.int64)
        row = row[fine]
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
        hashes.append(h[where[new]] >> U(32))
        places.append(where[new] + a)
        rows.append(row[new])
    h, at, row = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (hashes, places, rows))
    new = np.ones(len(at), bool)  # a tile's first may be the last of the one before
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    h, at, row = h[new].astype(np.uint32), at[new], row[new]
    cuts = np.searchsorted(row, np.arange(len(size) + 1))
    out = []
    for i, s in enumerate(size.tolist()):
        start = int(offsets[i])
        if s >= k + window - 1:
            c = slice(cuts[i], cuts[i + 1])
            out.append((h[c], (at[c] - start).astype(np.uint32)))
        elif s >= k:
            p, down = prefix_hash(data[start : start + s])
            g = mix((p[k:] - p[:-k]) * down[: s - k + 1])
            j = len(g) - 1 - int(np.argmin((g & ~LOW)[::-1]))
            out.append(((g[j : j + 1] >> U(32)).astype(np.uint32), np.array([j], np.uint32)))
        elif s:
            p, _ = prefix_hash(data[start : start + s])
            out.append(((mix(p[-1:] + U(s)) >> U(32)).astype(np.uint32), np.zeros(1, np.uint32)))
        else:
            out.append((np.empty(0, np.uint32), np.empty(0, np.uint32)))
    return out


def encode(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of (hash, position) pairs of 32 bits each."""
    return base64.b64encode(np.stack(print_, axis=1).astype("<u4").tobytes()).decode()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard likeness of the kept hashes; 1 for two empty fingerprints."""
    x, y = np.unique(a[0]), np.unique(b[0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0


def _prints(texts: list[str], k: int, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return winnow(*text_bytes(pa.array(texts, pa.large_string())), k, window)


def neighbour_fingerprints(docs: DataFrame, k: int = 24, window: int = 100) -> DataFrame:
    """Fingerprints of every text and of an edited one, in which its last floor(n_chars / 3) code points give way to
    the first as many (or all) of the next document's, in descending order of doc_id (the last's next is the first).

    Returns per row of ``docs``: doc_id, n_chars (code points), edited_sha256 (lowercase
    hex of the UTF-8), fingerprint, edited_fingerprint (see encode), near_edited and
    near_next (see likeness: with the edited text's, with the next document's).

    Null texts are empty. Null doc_ids come last; rows of one doc_id are ordered by
    their text. An empty table gives no rows; a single document is its own next.
    Other columns are ignored. Texts are shuffled once, into ranges of doc_id; the
    first document of a range also goes to the range before which it comes.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("ord", F.coalesce("doc_id", F.lit(FIRST_ID)))
    parts = buckets_for(spark, docs)
    bounds = sorted({float(x) for x in slim.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    splits = [-float("inf"), *bounds, float("inf")]
    if len(splits) > 2:
        slim = Bucketizer(splits=splits, inputCol="at", outputCol="b").transform(slim.withColumn("at", F.col("ord").cast("double"))).drop("at").withColumn("b", F.col("b").cast("int"))
    else:
        slim = slim.withColumn("b", F.lit(0))
    heads = sorted((r.b, r.top) for r in slim.groupBy("b").agg(F.max("ord").alias("top")).collect())  # a row for each range
    extra = [(top, heads[i + 1][0] if i + 1 < len(heads) else heads[0][0]) for i, (_, top) in enumerate(heads)]
    # what lies in the range above comes first: its last document is followed by this range's head; the highest head follows the lowest range
    tail = spark.createDataFrame(extra or [(0, 0)], "top long, to int")
    dealt = slim.join(F.broadcast(tail), F.col("ord") == F.col("top"), "left")
    dealt = dealt.select("doc_id", "ord", "text", F.explode_outer(F.when(F.col("to").isNull(), F.array(F.struct("b", F.lit(0).alias("tail")))).otherwise(F.array(F.struct("b", F.lit(0).alias("tail")), F.struct(F.col("to").alias("b"), F.lit(1).alias("tail"))))).alias("x"))
    dealt = dealt.select("doc_id", "ord", "text", "x.b", "x.tail")
    ranged = dealt.repartitionById(len(splits) - 1, F.col("b")).sortWithinPartitions("b", "tail", F.desc("ord"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows (b, tail, doc_id, text); each but the last has its next behind it
        size = 0

        def flush(end: bool) -> Iterator[pa.RecordBatch]:
            own = [i for i in range(len(held) - (0 if end else 1)) if not held[i][1] and i + 1 < len(held)]
            if not own:
                return
            prints = _prints([r[3] for r in held], k, window)
            edited = []
            for i in own:
                text, after = held[i][3], held[i + 1][3]
                m = len(text) // 3
                edited.append(text[: len(text) - m] + after[:m])
            changed = _prints(edited, k, window)
            yield pa.record_batch({
                "doc_id": pa.array([held[i][2] for i in own], pa.int64()), "n_chars": pa.array([len(held[i][3]) for i in own], pa.int64()),
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": [encode(prints[i]) for i in own], "edited_fingerprint": [encode(c) for c in changed],
                "near_edited": pa.array([likeness(prints[i], c) for i, c in zip(own, changed, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
            })

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][1] and row[1] and held[-1][0] == row[0]:
                    continue  # of several heads with one doc_id the first follows
                held.append(row)
                size += len(row[3])
                if size >= HELD and not row[1]:
                    yield from flush(False)
                    held, size = held[-1:], len(row[3])
        yield from flush(True)

    return ranged.select("b", "tail", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8, 8)
