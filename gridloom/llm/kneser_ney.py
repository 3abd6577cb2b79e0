"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and stored as sorted hash arrays.

Counting: blocks of texts send sorted distinct words, then distinct n-grams with
counts, to buckets by the upper bits of their hashes (of the context's hash for
n-grams), so one heavy word costs one entry a block. N-grams travel as columns of word
ids in order, the first as gaps, compressed. Each bucket merges its part and writes it
to the shared folder as flat little-endian arrays:

- words: sorted 64-bit hashes and counts. A word's id is its rank over all buckets.
- level n: sorted 64-bit keys (16 bits of the context's hash, 48 of the n-gram's)
  with counts, and sorted hashes of contexts with total and numbers of followers seen
  once, twice and more often. A context that was seen once only has no entry: it is
  the n-gram of the level below that ends before the word, with one follower, once.

Counts are bytes, larger ones stand in a list behind. The highest level has counts of
occurrence, lower ones numbers of distinct words before (each merged n-gram of the
level above counts its suffix once). Scoring workers map the arrays into memory and
look sorted keys up; nothing is held whole.

P(w | h) = max(c - D(c), 0) / T(h) + (D1 N1 + D2 N2 + D3 N3) / T(h) * P(w | shorter h),
with the discounts of the modified method from each level's counts of counts, and
below the first level 1 / (V + 1): V distinct tokens and one for all unknown ones.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import U, mix, releasing, text_bytes, word_hashes
from ._names import blocks
from ._shared import SharedDir, buckets_for

#: The hash of the token that ends every text.
END = 0x2545F4914F6CDD1D
#: Bytes of text that are counted together, and that are scored together.
COUNTED, SCORED = 16 << 20, 8 << 20
#: Array files that a worker keeps mapped; those longest unused are closed.
MAPS = 4096
#: What a word's id is raised by in n-grams, and the mark that stands before a text's start.
SHIFT, START = U(2), U(1)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 1; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's last being END, and each text's number of them."""
    words, counts = word_hashes(*text_bytes(column))
    return np.insert(words, np.cumsum(counts), U(END)), counts + 1


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(48)) * U(n)) >> U(16)


def _ends(h: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(bucket_of(h, n), np.arange(n + 1, dtype=U), "left")


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def sum_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and a place of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = _starts(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else np.empty(0, np.int64), order[at]


def _counts_bytes(counts: np.ndarray) -> bytes:
    """Counts as bytes, those over 254 behind."""
    big = counts > 254
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype(np.int64).tobytes()


def _counts_read(raw: memoryview, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    big = out == 255
    out[big] = np.frombuffer(raw, np.int64, int(big.sum()), n)
    return out


def columns(ids: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The token ``order - 1`` places before each token, and so on up to the token itself; before a text's start stand marks."""
    n, ends = len(ids), np.cumsum(sizes)
    place = np.arange(n) - np.repeat(ends - sizes, sizes)
    for back in range(order - 1, -1, -1):
        own = np.zeros(n, U)
        own[back:] = ids[: n - back] + SHIFT
        own[place < back] = START
        yield own


def context_hash(cols: list[np.ndarray], n: int) -> np.ndarray:
    h = np.zeros(n, U)
    for c in cols:
        h = mix(h * U(0x9E3779B97F4A7C15) + c)
    return h


def _home(ctx: np.ndarray, word: np.ndarray, level: int) -> np.ndarray:
    """What an entry's bucket and key begin with: the context's hash, or at the first level the word's."""
    return ctx if level > 1 else mix(word + U(1))


def _keys(ctx: np.ndarray, word: np.ndarray, level: int) -> np.ndarray:
    return (_home(ctx, word, level) & U(0xFFFF << 48)) | (mix(ctx * U(0xD6E8FEB86659FD93) + word + U(1)) >> U(16))


def distinct(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns, in order, with their summed counts. Columns too wide for 64 bits together are sorted by these; rows that then stay apart are merged in their bucket."""
    bits = max([int(c.max(initial=0)).bit_length() for c in cols] + [1])
    key, room = np.zeros(len(counts), U), 64
    for c in cols:
        take = min(bits, room)
        key, room = (key << U(take) if take < 64 else key) | (c >> U(bits - take)) if take else key, room - take
    order = np.argsort(key)
    cols = [c[order] for c in cols]
    at = _starts(*cols)
    return [c[at] for c in cols], np.add.reduceat(counts[order], at) if len(at) else np.empty(0, np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def pack(cols: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows in order as gaps of the first column, the other columns and counts, compressed."""
    wide = any(len(c) and int(c.max()) >= 1 << 32 for c in cols)
    kind = U if wide else np.uint32
    parts = [_planes((np.diff(c, prepend=U(0)) if i == 0 else c).astype(kind)) for i, c in enumerate(cols)]
    head = np.array([len(counts), len(cols), wide], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *parts, _counts_bytes(counts)]))


def unpack(raw: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    buf = memoryview(zstandard.ZstdDecompressor().decompress(raw))
    n, m, wide = np.frombuffer(buf, np.int64, 3).tolist()
    width, cols = 8 if wide else 4, []
    for i in range(m):
        planes = np.frombuffer(buf, np.uint8, n * width, 24 + i * n * width).reshape(width, n)
        c = np.ascontiguousarray(planes.T).view(U if wide else np.uint32).reshape(n).astype(U)
        cols.append(np.cumsum(c, dtype=U) if i == 0 else c)
    return cols, _counts_read(buf[24 + m * n * width :], n)


@dataclass(frozen=True)
class Model:
    """Where a model lies and its global figures; small, whatever the corpus."""

    files: SharedDir
    order: int
    n_buckets: int
    train_tokens: int
    n_words: int
    word_base: tuple[int, ...]
    discounts: tuple[tuple[float, float, float], ...]
    bottom: tuple[float, float]  # weight of the uniform part and total at the first level

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Memory-mapped arrays of a model, opened when asked for; at most MAPS files stay open."""

    def __init__(self, model: Model) -> None:
        self.m, self.maps = model, OrderedDict()

    def _file(self, name: str) -> tuple:
        """Keys with their counts, and contexts' hashes with their figures."""
        if name in self.maps:
            self.maps.move_to_end(name)
            return self.maps[name]
        raw = self.m.files.map(name) if self.m.files.exists(name) else np.empty(0, np.uint8)
        self.maps[name] = (_Table(raw, 0), _Table(raw, 1)) if len(raw) else (_Table(None, 0), _Table(None, 1))
        if len(self.maps) > MAPS:
            self.maps.popitem(last=False)
        return self.maps[name]

    def _find(self, kind: str, asked: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """For hashes: the place of each in its bucket's array (global for words), or -1; and the values there, a row for each column."""
        order = np.argsort(asked)
        asked = asked[order]
        place = np.full(len(asked), -1, np.int64)
        value = np.zeros((4 if which else 1, len(asked)), np.int64)
        ends = _ends(asked, self.m.n_buckets)
        for b in np.flatnonzero(ends[1:] > ends[:-1]):
            table = self._file(f"{kind}/{b}")[which]
            if not table.n:
                continue
            k = slice(ends[b], ends[b + 1])
            at, hit = table.find(asked[k])
            place[k] = np.where(hit, at + (self.m.word_base[b] if kind == "words" else 0), -1)
            value[:, k] = np.where(hit, table.values(at), 0)
        places, values = np.empty_like(place), np.empty_like(value)
        places[order], values[:, order] = place, value
        return places, values

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (n_words for unknown ones) and training counts of words."""
        place, count = self._find("words", hashes, 0)
        return np.where(place >= 0, place, self.m.n_words).astype(U), count[0]

    def log10(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 P of every token given those before it."""
        p = np.full(len(ids), 1.0 / (self.m.n_words + 1))
        cols = list(columns(ids, sizes, self.m.order))
        first = np.zeros(len(ids), bool)
        first[np.cumsum(sizes) - sizes] = True
        seen = np.zeros(len(ids), bool)
        for level in range(1, self.m.order + 1):
            ctx, word = context_hash(cols[self.m.order - level : -1], len(ids)), cols[-1]
            d = np.array([0.0, *self.m.discounts[level - 1]])
            place, c = self._find(f"level{level}", _keys(ctx, word, level), 0)
            own = np.maximum(c[0] - d[np.minimum(c[0], 3)], 0)
            if level == 1:
                gamma, total = self.m.bottom
                p = own / max(total, 1) + gamma / max(total, 1) * p if total else p
            else:
                _, s = self._find(f"level{level}", ctx, 1)
                once = (s[0] == 0) & ~first & np.roll(seen, 1)  # the level below has the n-gram that ends before the word
                s[:2, once] = 1
                known = s[0] > 0
                total = np.where(known, s[0], 1)
                p = np.where(known, own / total + (d[1] * s[1] + d[2] * s[2] + d[3] * s[3]) / total * p, p)
            seen = place >= 0
        return np.log10(p)


class _Table:
    """Sorted 64-bit keys of a mapped file with columns of counts.

    Keys of the same 16 upper bits stand together, by a list of ends, as 32 and 16
    lower bits; counts are bytes, and for 255 there is a list of places and numbers.
    """

    def __init__(self, raw: np.ndarray | None, which: int) -> None:
        self.n, self.small, self.large, at = 0, [], [], 0
        for i in range(2 if raw is not None else 0):
            n, top, groups, width = raw[at : at + 32].view(np.int64).tolist()
            parts, at = [], at + 32
            for size, kind in ((8 * (groups + 1), np.int64), (4 * n, np.uint32), (2 * n, np.uint16)):
                parts.append(raw[at : at + size].view(kind))
                at += size + -size % 8
            small, large = [], []
            for _ in range(width):
                m = int(raw[at : at + 8].view(np.int64)[0])
                large.append(raw[at + 8 : at + 8 + 16 * m].view(np.int64).reshape(2, m))
                at += 8 + 16 * m
                small.append(raw[at : at + n])
                at += n + -n % 8
            if i == which:
                self.n, self.top, (self.ends, self.high, self.low), self.small, self.large = n, top, parts, small, large

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key and whether it is there."""
        group = (asked >> U(48)).astype(np.int64) - self.top
        fine = (group >= 0) & (group < len(self.ends) - 1)
        group = np.where(fine, group, 0)
        lo, end = self.ends[group], np.where(fine, self.ends[group + 1], self.ends[group])
        high, low, hi, last = (asked >> U(16)).astype(np.uint32), asked.astype(np.uint16), end.copy(), self.n - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.high[np.minimum(mid, last)] < high)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        while True:  # of keys with equal upper 48 bits the lower ones are passed over
            at = np.minimum(lo, last)
            same = (lo < end) & (self.high[at] == high)
            less = same & (self.low[at] < low)
            if not less.any():
                return at, same & (self.low[at] == low)
            lo = lo + less

    def values(self, at: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.small), len(at)), np.int64)
        for i, (small, large) in enumerate(zip(self.small, self.large, strict=True)):
            out[i] = small[at]
            big = np.flatnonzero(out[i] == 255)
            if len(big):
                out[i, big] = large[1][np.searchsorted(large[0], at[big])]
        return out


def store(files: SharedDir, name: str, keys: np.ndarray, counts: np.ndarray, heads: np.ndarray, own: np.ndarray) -> None:
    """Keys with counts, then contexts' hashes with their four figures (see _Table)."""
    parts = []
    for names, cols in ((keys, [counts]), (heads, list(own))):
        group = (names >> U(48)).astype(np.int64)
        top, last = (int(group[0]), int(group[-1])) if len(names) else (0, -1)
        ends = np.searchsorted(group, np.arange(top, last + 2))
        parts += [np.array([len(names), top, last + 1 - top, len(cols)], np.int64), ends.astype(np.int64)]
        for x in ((names >> U(16)).astype(np.uint32), names.astype(np.uint16)):
            parts += [x, np.zeros(-x.nbytes % 8, np.uint8)]
        for c in cols:
            big = np.flatnonzero(c > 254)
            parts += [np.array([len(big)], np.int64), big.astype(np.int64), c[big].astype(np.int64), np.where(c > 254, 255, c).astype(np.uint8), np.zeros(-len(c) % 8, np.uint8)]
    files.write(name, *parts)


def _word_blobs(words: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    keys, counts, _ = sum_sorted(words, np.ones(len(words), np.int64))
    ends = _ends(keys, n_buckets)
    for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        k = slice(ends[b], ends[b + 1])
        yield b, pack([keys[k]], counts[k])


def _gram_blobs(cols: list[np.ndarray], counts: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Distinct n-grams with their counts, by bucket."""
    cols, counts = distinct(cols, counts)
    bucket = bucket_of(_home(context_hash(cols[:-1], len(counts)), cols[-1], len(cols)), n_buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1), "left")
    for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        k = order[ends[b] : ends[b + 1]]
        yield b, pack([c[k] for c in cols], counts[k])


def train(docs: DataFrame, order: int = 3, skip_held_out: bool = True) -> Model:
    """Counts a model over whole texts. Texts of held-out ids (see held_out) are left out unless skip_held_out is false.

    Null texts are empty (their end is a token); an empty table gives a model of no
    tokens, under which all is unknown.
    """
    spark = docs.sparkSession
    slim = _slim(docs)
    nb, files = min(buckets_for(spark, docs), 1 << 16), SharedDir.new(spark, "ngrams")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for block in blocks(batches, COUNTED):
            table = block.table
            yield table.filter(pc.invert(table["held"])) if skip_held_out else table

    def rows(blobs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for b, raw in blobs:
            yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "payload": pa.array([raw], pa.binary())})

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in learn(batches):
            yield from rows(_word_blobs(tokens(table["text"])[0], nb))

    @releasing
    def keep_words(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        got = [unpack(raw.as_buffer()) for raw in table["payload"]]
        keys, counts, _ = sum_sorted(np.concatenate([k[0] for k, _ in got]), np.concatenate([c for _, c in got]))
        store(files, f"words/{b}", keys, counts, np.empty(0, U), np.empty((4, 0), np.int64))
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    sizes = slim.mapInArrow(send_words, "bucket int, payload binary").groupBy("bucket").applyInArrow(keep_words, "bucket int, n long, total long").collect()
    per = [0] * nb
    for r in sizes:
        per[r.bucket] = r.n
    base = tuple(np.concatenate([[0], np.cumsum(per)[:-1]]).tolist())
    vocabulary = Model(files, order, nb, sum(r.total for r in sizes), sum(per), base, (), (0.0, 0.0))

    def send_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = vocabulary.reader()
        for table in learn(batches):
            hashes, n = tokens(table["text"])
            ids, _ = reader.words(hashes)
            yield from rows(_gram_blobs(list(columns(ids, n, order)), np.ones(len(ids), np.int64), nb))

    def keep_level(level: int):  # noqa: ANN202
        """A bucket -l holds what the buckets of level l have counted of their counts: six sums."""

        @releasing
        def keep(table: pa.Table) -> pa.Table:
            b = table["bucket"][0].as_py()
            if b < 0:
                sums = np.sum([np.frombuffer(raw.as_buffer(), np.int64) for raw in table["payload"]], axis=0)
                return pa.table({"bucket": pa.array([b], pa.int32()), "payload": pa.array([sums.tobytes()], pa.binary())})
            got = [unpack(raw.as_buffer()) for raw in table["payload"]]
            cols, counts = [np.concatenate([c[i] for c, _ in got]) for i in range(level)], np.concatenate([c for _, c in got])
            del got
            ctx = context_hash(cols[:-1], len(counts))
            keys, sums, pick = sum_sorted(_keys(ctx, cols[-1], level), counts)
            ctx, cols = ctx[pick], [c[pick] for c in cols]
            heads, own = np.empty(0, U), np.empty((4, 0), np.int64)
            if level > 1:
                by = np.argsort(ctx)
                at, each = _starts(ctx[by]), sums[by]
                own = np.stack([np.add.reduceat(w.astype(np.int64), at) for w in (each, each == 1, each == 2, each > 2)])
                more = (own[0] > 1) | (cols[-2][by[at]] == START)  # a text's start is no n-gram of the level below
                heads, own = ctx[by[at[more]]], own[:, more]
            store(files, f"level{level}/{b}", keys, sums, heads, own)
            stats = np.array([np.count_nonzero(sums == i) for i in (1, 2, 3, 4)] + [int(sums.sum()), np.count_nonzero(sums > 2)], np.int64)
            out = [(-level, stats.tobytes()), *(_gram_blobs(cols[1:], np.ones(len(sums), np.int64), nb) if level > 1 else ())]
            return pa.table({"bucket": pa.array([x for x, _ in out], pa.int32()), "payload": pa.array([x for _, x in out], pa.binary())})

        return keep

    now = slim.mapInArrow(send_grams, "bucket int, payload binary")
    for level in range(order, 0, -1):
        now = now.groupBy("bucket").applyInArrow(keep_level(level), "bucket int, payload binary")
    stats = {level: np.zeros(6, np.int64) for level in range(1, order + 1)}
    for r in now.collect():  # a row for each bucket of the first level and each other level
        stats[-r.bucket] = stats[-r.bucket] + np.frombuffer(r.payload, np.int64)
    discounts, bottom = [], (0.0, 0.0)
    for level in range(1, order + 1):
        n1, n2, n3, n4, total, many = stats[level].tolist()
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = [min(max(x, 0.01), i + 0.99) for i, x in enumerate(d)]
        discounts.append(tuple(d))
        if level == 1:
            bottom = (d[0] * n1 + d[1] * n2 + d[2] * many, float(total))
    return Model(files, order, nb, vocabulary.train_tokens, vocabulary.n_words, base, tuple(discounts), bottom)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    score is the model's log10 probability of the text's tokens, its end included;
    base_score that of add-a-half single words; perplexity 10**(-score / n_tokens).
    Null texts are empty: one token, the end. Null doc_ids stay null (held_out
    false). Repeated rows are scored each; other columns are ignored.
    """
    slim = _slim(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for block in blocks(batches, SCORED):
            table = block.table
            hashes, n = tokens(table["text"])
            ids, c = reader.words(hashes)
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            base = np.log10((c + 0.5) / (model.train_tokens + 0.5 * (model.n_words + 1)))
            total = np.add.reduceat(reader.log10(ids, n), at)
            yield pa.record_batch({
                "doc_id": table["doc_id"].combine_chunks(), "held_out": table["held"].combine_chunks(), "n_tokens": pa.array(n),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), "train_tokens": pa.array(np.full(len(n), model.train_tokens)),
                "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(total), "perplexity": pa.array(10 ** np.minimum(-total / n, 300)),
            })

    return slim.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op1_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, 3))
