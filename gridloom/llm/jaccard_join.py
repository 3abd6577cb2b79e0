"""Self-join of documents by the Jaccard likeness of their word n-gram sets: signatures deal documents into candidate groups, signature trees find the links within these.

1. Every document becomes the set of hashes of its word n-grams; equal sets are one
   class. Signatures deal the classes out: two sets of likeness >= t differ in at
   most H tokens, so of more than H parts of the hash space at least one holds the
   same tokens in both. For large sets fewer parts do: as hashed tokens fall at
   random, one part without a differing token is left, but for a chance of at most
   2^-64 (that of two equal hashes). Classes without a signature in common can't be
   linked. Size levels make H depend on the set's size.
2. Classes that signatures connect, directly or by others, form a candidate group.
   Common passages connect ever more texts that are not alike, so groups that are
   large are first split by their sets' rarest tokens (see _rare); only texts of
   groups are fetched, where they lie. A group is one block, or if still too large
   it is cut by size level and then by hash, and
   blocks meet in pairs of compatible sizes. They are joined by dual traversal of
   signature trees: a node holds the OR of its sets' token bitmaps and the range of
   their sizes, and a pair of nodes is left out when the largest possible overlap
   is too small, or when both lie in one component already. What remains is
   compared exactly.
3. The links found connect classes to components.

No step forms all pairs of a group: a block hands on at most one link fewer than it
has sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U, mix, releasing, text_bytes, word_hashes
from ._components import components
from ._names import LAST_ID, blocks
from ._rare import cuts, rare_links, star
from ._shared import SharedDir, buckets_for, settle
from ._skew import join_unique

BITS = 2048
FANOUT = 16
#: Bits of a row's number within its partition.
PART = 33
#: Chance, at most, that a link between two sets at the threshold is not found.
MISS = 2.0**-64
#: Weight of a block of a candidate group: tokens, and SET for each set's bitmap.
BLOCK_WEIGHT = 1 << 20
SET = 64
#: Weight from which on a candidate group is split by rare tokens.
LARGE = BLOCK_WEIGHT // 4


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word n-grams; of fewer words the whole sequence; of none an empty array."""
    words, counts = word_hashes(*text_bytes(column))
    ends, out = np.cumsum(counts), []
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for i in range(1, n):
            grams = grams * U(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
        grams = mix(grams)
    for end, c in zip(ends.tolist(), counts.tolist(), strict=True):
        if c >= n:
            out.append(np.unique(grams[end - c : end - n + 1]))
        elif c:
            h = np.array([c], U)
            for w in words[end - c : end]:
                h = mix(h * U(0x9E3779B97F4A7C15) + w)
            out.append(h)
        else:
            out.append(np.empty(0, U))
    return out


def class_id(s: np.ndarray) -> int:
    """A 63-bit id of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=U) ^ U(len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], U))[0] >> U(1))


class Levels:
    """Size levels i with sizes lows[i] to highs[i]; sets linked at likeness t = p/q lie in one level or in two neighbours."""

    def __init__(self, t: Fraction) -> None:
        self.t, self.lows, self.highs = t, [1], []
        self.plans: list[tuple[int, int, int]] = []

    def of(self, size: int) -> int:
        while not self.highs or self.highs[-1] < size:
            self.highs.append(int(self.lows[-1] / self.t))
            self.lows.append(self.highs[-1] + 1)
        return int(np.searchsorted(self.highs, size, "left"))

    def plan(self, level: int) -> tuple[int, int, int]:
        """For pairs of which the smaller set is of this level: into how many parts sets are cut, from how many tokens on a part is handed in, and with how many smaller ones that still holds."""
        while len(self.highs) < level + 2:
            self.of(self.highs[-1] + 1 if self.highs else 1)
        while len(self.plans) <= level:
            self.plans.append(self._plan(len(self.plans)))
        return self.plans[level]

    def _plan(self, level: int) -> tuple[int, int, int]:
        low, high = 2 * self.lows[level], self.highs[level] + self.highs[level + 1]  # of both sizes together
        t = float(self.t)
        most = int((1 - self.t) / (1 + self.t) * high)
        each = low / 2 / (most + 1)
        mean = 1.2 * most * math.exp(-each)
        spare = 1 + math.ceil(mean + 3 * math.sqrt(mean))
        best = (self._chance(most + 1 + spare, 1, low / 2), most + 1 + spare, 1, spare)
        for least in range(1, 7):
            parts = self._fewest(least, [((1 - t) / (1 + t) * x, t / (1 + t) * x) for x in (low, high)])
            if parts:
                best = min(best, (self._chance(parts, least, low / 2), parts, least, parts))
        return best[1:]

    @staticmethod
    def _tail(mean: float, least: int) -> float:
        return 1 - math.exp(-mean) * sum(mean**k / math.factorial(k) for k in range(least))

    def _chance(self, parts: int, least: int, size: float) -> float:
        """Signatures in common of two sets that share a fifth of their tokens, expected."""
        mean = size / parts
        return parts * math.exp(-0.8 * mean) * self._tail(mean * 0.2, least)

    def _fewest(self, least: int, ends: list[tuple[float, float]]) -> int:
        """The fewest parts of which one has no differing token and ``least`` common ones, but for a chance of MISS; 0 if no number does."""

        def sure(parts: int) -> bool:
            return all(parts * (1 - 1 / parts) ** math.ceil(d) * self._tail(c / parts, least) * 0.97 >= -math.log(MISS) for d, c in ends)

        top = int(ends[1][1] / least) + 2
        return next((p for p in range(2, top, max(1, top // 400)) if sure(p)), 0)


def signatures(s: np.ndarray, levels: Levels) -> np.ndarray:
    """The set's signatures at its own level and the one below.

    Linked sets agree on more parts than may be empty. So a set with no more empty
    parts need not hand them in; one with more hands in all, and meets its like there.
    """
    out = []
    level = levels.of(len(s))
    prefix = np.zeros(len(s) + 1, U)
    np.cumsum(mix(s), out=prefix[1:])
    for at in (level, level - 1):
        if at >= 0:
            parts, least, spare = levels.plan(at)
            cuts = np.searchsorted(s, (np.arange(parts + 1, dtype=U) * U((1 << 64) // parts if parts > 1 else 0)), "left")
            cuts[-1] = len(s)
            body = prefix[cuts[1:]] - prefix[cuts[:-1]]
            sig = mix(body * U(0xD6E8FEB86659FD93) + mix(np.arange(parts, dtype=U) + U(at) * U(1 << 32) + U(1)))
            full = cuts[1:] - cuts[:-1] >= least
            out.append(sig[full] if np.count_nonzero(~full) <= spare else sig)
    return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both * t.denominator >= t.numerator * (len(a) + len(b) - both)


class Tree:
    """Signature tree over sets in order of rough size and least token: per node the OR of bitmaps, the size range, and the most tokens that share a bit."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        order = sorted(range(len(sets)), key=lambda i: (int(math.log(len(sets[i])) * 10), int(sets[i][0])))
        self.sets = [sets[i] for i in order]
        self.order = np.array(order)
        bits = np.zeros((len(sets), BITS // 8), np.uint8)
        for i, s in enumerate(self.sets):
            bits[i] = np.packbits(np.bincount((s & U(BITS - 1)).astype(np.int64), minlength=BITS) > 0)
        bits = bits.view(U)
        size = np.array([len(s) for s in self.sets])
        slack = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, size, size, slack, np.arange(len(sets)), np.arange(len(sets)) + 1)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sl, s, e = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at), s[at], e[np.minimum(at + FANOUT, len(b)) - 1]))


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def tree_links(left: Tree, right: Tree, t: Fraction, forest: Forest, shift: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join components of ``forest``, in which the right tree's sets come ``shift`` later (0: one tree with itself)."""
    same = left is right

    def one(tree: Tree, level: int, node: int, by: int) -> int:
        """The component of all sets below a node, or -1."""
        s, e = tree.levels[level][4][node], tree.levels[level][5][node]
        first = forest.root(int(tree.order[s]) + by)
        return first if all(forest.root(int(i) + by) == first for i in tree.order[s + 1 : e]) else -1

    need = float(t / (1 + t))
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        if la == 0 and lb == 0:
            i, j = int(left.order[a]), int(right.order[b]) + shift
            if not (same and a == b) and forest.root(i) != forest.root(j) and linked(left.sets[a], right.sets[b], t):
                forest.up[forest.root(j)] = forest.root(i)
                yield i, j
            continue
        if (x := one(left, la, a, 0)) >= 0 and x == one(right, lb, b, shift):
            continue
        ka, kb = np.array([a]), np.array([b])
        down = max(la, lb)
        if la == down:
            la -= 1
            ka = np.arange(a * FANOUT, min((a + 1) * FANOUT, len(left.levels[la][0])))
        if lb == down:
            lb -= 1
            kb = np.arange(b * FANOUT, min((b + 1) * FANOUT, len(right.levels[lb][0])))
        (bits_a, lo_a, hi_a, slack_a), (bits_b, lo_b, hi_b, slack_b) = ([f[ka][:, None] for f in left.levels[la][:4]], [f[kb][None] for f in right.levels[lb][:4]])
        fits = (hi_a * t.denominator >= t.numerator * lo_b) & (hi_b * t.denominator >= t.numerator * lo_a)
        if same and la == lb:
            fits &= ka[:, None] <= kb[None]
        if fits.any():
            shared = np.bitwise_count(bits_a & bits_b).sum(axis=2)
            fits &= np.minimum(np.minimum(hi_a, hi_b), shared + np.minimum(slack_a, slack_b)) >= need * (lo_a + lo_b) - 1e-6
            stack += [(la, int(ka[i]), lb, int(kb[j])) for i, j in zip(*np.nonzero(fits), strict=True)]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a number for each row: the same again as long as the input has the same partitions (files and checkpoints do)."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def fetched(slim: DataFrame, members: DataFrame) -> DataFrame:
    """class_id, large, text of ``members`` (class_id, rep, large), by their row ``rep`` in ``slim``. No text is shuffled: each partition of ``slim`` reads which of its rows are wanted."""
    out = SharedDir.new(slim.sparkSession, "wanted")

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rows, ids, large = (table[c].combine_chunks().cast(pa.int64()).to_numpy() for c in ("rep", "class_id", "large"))
        out.write(str(rows[0] >> PART), rows, ids, large)
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = None, 0
        for batch in batches:
            rows = batch["row"].to_numpy()
            if not len(rows):
                continue
            if wanted is None:
                wanted, part = np.empty((3, 0), np.int64), str(rows[0] >> PART)
                if out.exists(part):
                    with out.open(part) as f:
                        wanted = np.frombuffer(f.read(), np.int64).reshape(3, -1)
            mine = wanted[:, seen : np.searchsorted(wanted[0], rows[-1], "right")]
            seen += mine.shape[1]
            if mine.size:
                yield pa.record_batch({"class_id": pa.array(mine[1]), "large": pa.array(mine[2]).cast(pa.bool_()), "text": batch["text"].take(pa.array(mine[0] - rows[0]))})
        if wanted is not None and seen < wanted.shape[1]:
            raise RuntimeError("the input's partitions changed between two reads")

    members.groupBy(F.shiftright("rep", PART)).applyInArrow(keep, "n long").agg({"n": "sum"}).collect()
    return slim.select("row", "text").mapInArrow(fetch, "class_id long, large boolean, text string")


def jaccard_components(docs: DataFrame, n: int = 3, threshold: float = 0.9) -> DataFrame:
    """Links documents whose word n-gram sets have a Jaccard likeness of at least ``threshold``.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Texts of fewer than n
    words have their whole sequence as the only element; null texts and those
    without words have an empty set and are linked with nothing.

    Returns one row per row of ``docs``: doc_id, n_shingles (size of the set),
    class_id (equal for equal sets, null for empty ones), component_id (the smallest
    doc_id reachable by links, the row's own included). Rows with a null doc_id take
    part; they get the smallest known doc_id of their component, or null. Repeated
    rows and doc_ids are kept. Other columns are ignored. Elements and sets are
    compared by 64-bit hashes.
    """
    return jaccard_rows(docs, n, threshold).drop("row", "keeper")


def jaccard_rows(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """jaccard_components with ``row`` (see numbered) and ``keeper``: of the component's rows the one of the smallest doc_id (null last), of several the first.

    The input is read twice and needs the same partitions each time; a change raises an error.
    """
    spark, t = docs.sparkSession, Fraction(str(threshold))
    slim = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    n_buckets = buckets_for(spark, docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(t)
        for block in blocks(batches):
            sets = shingle_sets(block.table["text"], n)
            ids = np.array([class_id(s) if len(s) else -1 for s in sets], np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            _, once = np.unique(ids, return_index=True)
            once = once[sizes[once] > 0]
            sigs = [signatures(sets[i], levels) for i in once]
            who = np.repeat(ids[once], [len(s) for s in sigs])
            sig = np.concatenate(sigs) if sigs else np.empty(0, U)
            sig, who, pairs = star(sig, who)
            ends = cuts(sig, n_buckets)
            rows = block.table["row"].combine_chunks().to_numpy()
            info = np.stack([np.where(block.ids == LAST_ID, np.iinfo(np.int64).min, block.ids), sizes, ids, rows])
            home = zlib.crc32(block.key.encode()) % n_buckets
            for b in range(n_buckets):
                parts = [info if b == home else np.empty((4, 0), np.int64), pairs if b == home else np.empty((0, 2), np.int64)]
                k = slice(ends[b], ends[b + 1])
                if parts[0].size or parts[1].size or ends[b + 1] > ends[b]:
                    raw = b"".join([np.array([parts[0].shape[1], len(parts[1]), ends[b + 1] - ends[b]], np.int64).tobytes(), parts[0].tobytes(), parts[1].tobytes(), sig[k].tobytes(), who[k].tobytes()])
                    yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "payload": pa.array([raw], pa.binary())})

    @releasing
    def meet(table: pa.Table) -> pa.Table:
        infos, pairs, sigs, whos = [], [], [], []
        for raw in table["payload"]:
            x = np.frombuffer(raw.as_buffer(), np.int64)
            a, b, c = x[:3].tolist()
            infos.append(x[3 : 3 + 4 * a].reshape(4, a))
            pairs.append(x[3 + 4 * a : 3 + 4 * a + 2 * b].reshape(b, 2))
            sigs.append(x[(at := 3 + 4 * a + 2 * b) : at + c].view(U))
            whos.append(x[at + c : at + 2 * c])
        info = np.concatenate(infos, axis=1)
        pair = np.unique(np.concatenate([*pairs, star(np.concatenate(sigs), np.concatenate(whos))[2]]), axis=0)
        m, k = info.shape[1], len(pair)
        return pa.table({
            "size": pa.array(np.concatenate([info[1], np.full(k, -1, np.int64)])),
            "a": pa.array(np.concatenate([info[0], pair[:, 0]]), mask=np.concatenate([info[0] == np.iinfo(np.int64).min, np.zeros(k, bool)])),
            "b": pa.array(np.concatenate([info[2], pair[:, 1]])),
            "row": pa.array(np.concatenate([info[3], np.full(k, -1, np.int64)])),
        })

    met = settle(slim.mapInArrow(send, "bucket int, payload binary").groupBy("bucket").applyInArrow(meet, "size long, a long, b long, row long"), "met")
    info = met.where("size >= 0").select(F.col("a").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("b")).alias("class_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    classes = info.where("class_id is not null").groupBy("class_id").agg(first, F.max("n_shingles").alias("size"), F.count("*").alias("rows"))
    classes = settle(classes.select("class_id", "first", F.col("first.row").alias("rep"), "size", "rows"), "classes")
    groups = components(met.where("size = -1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    ratio = math.log(max(float(1 / t), 1.01))
    members = settle(groups.join(classes, F.col("node") == F.col("class_id")).select("root", "class_id", "rep", "size"), "members")
    weights = settle(members.groupBy("root").agg(F.sum(F.col("size") + SET).alias("w"), F.count("*").alias("k")).select("root", "k", (F.col("w") > LARGE).alias("large")), "weights")
    members = settle(join_unique(members, weights, "root", "k", ["large"]), "members")
    texts = settle(fetched(slim, members.select("class_id", "rep", "large")), "texts")
    if weights.where("large").limit(1).count():
        parts = settle(components(rare_links(texts.where("large").select(F.col("class_id").alias("doc_id"), "text"), n, t, n_buckets)), "parts")
        parts = parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "part")
        split = members.where("large").join(parts, F.col("class_id") == F.col("node"))
        members = settle(members.where("not large").select("root", "class_id", "size").unionByName(split.select(F.col("part").alias("root"), "class_id", "size")), "members")
    members = members.select("root", "class_id", "size", F.floor(F.log("size") / ratio + 1e-9).alias("lvl")).withColumn("cell", F.concat_ws(":", "root", "lvl"))
    cells = members.groupBy("root", "lvl", "cell").agg(F.sum(F.col("size") + SET).alias("w"), F.count("*").alias("n_cell"))
    whole = cells.groupBy("root").agg(F.sum("w").alias("w_root"))
    cells = cells.join(whole, "root").select("cell", "n_cell", F.when(F.col("w_root") > BLOCK_WEIGHT, F.ceil(F.col("w") / BLOCK_WEIGHT)).otherwise(0).alias("n_blk"))
    part = F.col("lvl") * (1 << 32) + F.pmod(F.xxhash64("class_id"), F.col("n_blk"))
    blocks_of = join_unique(members, cells, "cell", "n_cell", ["n_blk"]).select("root", "class_id", "size", F.when(F.col("n_blk") > 0, part).otherwise(-1).alias("blk"))
    blocks_of = settle(blocks_of, "blocks")
    spans = blocks_of.groupBy("root", "blk").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    near = spans.alias("x").join(spans.alias("y"), F.expr(f"x.root = y.root AND x.blk <= y.blk AND x.hi * {t.denominator} >= {t.numerator} * y.lo")).select(F.col("x.root").alias("root"), F.col("x.blk").alias("i"), F.col("y.blk").alias("j"))
    wanted = near.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    tiles = blocks_of.join(wanted, ["root", "blk"]).select("root", "i", "j", "blk", "class_id")
    found = tiles.join(texts, "class_id").select("root", "i", "j", "blk", "class_id", "text")

    @releasing
    def compare(table: pa.Table) -> pa.Table:
        sets: dict[int, dict[int, np.ndarray]] = {}
        texts = table["text"].combine_chunks()
        for blk, want, s in zip(table["blk"].to_pylist(), table["class_id"].to_pylist(), shingle_sets(texts, n), strict=True):
            if not len(s) or class_id(s) != want:
                raise ValueError("the input's partitions changed between two reads")
            sets.setdefault(blk, {})[want] = s
        names = [c for b in sorted(sets) for c in sorted(sets[b])]
        trees = [Tree([sets[b][c] for c in sorted(sets[b])]) for b in sorted(sets)]
        out = list(tree_links(trees[0], trees[-1], t, Forest(len(names)), len(names) - len(trees[-1].sets))) if trees else []
        return pa.table({"u": pa.array([names[a] for a, _ in out], pa.int64()), "v": pa.array([names[b] for _, b in out], pa.int64())})

    links = found.groupBy("root", "i", "j").applyInArrow(compare, "u long, v long")
    roots = components(links)
    labelled = classes.join(roots, F.col("class_id") == F.col("node"), "left").select("class_id", "first", "rows", F.coalesce("root", "class_id").alias("top"))
    least = labelled.groupBy("top").agg(F.min("first").alias("least"), F.count("*").alias("k"))
    classes = settle(join_unique(labelled, least, "top", "k", ["least"]).select("class_id", "rows", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keeper")), "labels")
    out = join_unique(info, classes, "class_id", "rows", ["component_id", "keeper"])
    return out.select("row", "doc_id", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("keeper", "row").alias("keeper"))


def op9_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 0.9)
