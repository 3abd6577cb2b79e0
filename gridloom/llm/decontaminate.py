"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of a text are hashed; k-grams of words are named by pairing hashes at offsets
1, 2, 4; of every ``window`` neighbouring k-grams the one with the least name is kept
with its position. A span of k + window - 1 words that a document shares with an item
has the same least k-gram in both, so that joining the two tables of kept k-grams
misses none. Each hit is extended: the spans of that many words around it are joined
with the items' spans word by word. Items with fewer words are joined as a whole,
every word sequence of their length being kept (a window of one).

Long documents are cut into chunks of CHUNK words that overlap, so no row grows with
a text's length. The items' side is broadcast only below BROADCAST_ROWS k-grams and
is shuffled beyond that. Arrays are exploded with explode_outer: for explode Spark
infers a filter and pushes it down through all steps, which repeats each many times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import settle

CHUNK = 1 << 12
#: Kept k-grams (about 16 bytes each) and spans up to which the benchmark is broadcast: 16 MB at most.
BROADCAST_ROWS = 100_000
_SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; an empty array for null."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.filter(F.split(low, _SPLIT), lambda w: w != ""), F.array().cast("array<string>"))


def _shift(a: str, by: int) -> str:
    return f"slice({a}, {by + 1}, greatest(size({a}) - {by}, 0))"


def _head(a: str, less: int) -> str:
    return f"slice({a}, 1, greatest(size({a}) - {less}, 0))"


def _pairs(df: DataFrame, source: str, out: str, k: int) -> DataFrame:
    """Column ``out``: a hash of every k neighbouring elements of ``source`` (hashes of single ones), by pairing at growing offsets."""
    have, now = 1, source
    while have < k:
        step = min(have, k - have)
        df = df.withColumn(f"{out}_{have + step}", F.expr(f"zip_with({_head(now, step)}, {_shift(now, step)}, (a, b) -> xxhash64(a, b))"))
        now, have = f"{out}_{have + step}", have + step
    return df.withColumn(out, F.col(now))


def _least(df: DataFrame, source: str, out: str, w: int) -> DataFrame:
    """Column ``out``: the least of every w neighbours (of all, if there are fewer), by doubling."""
    have, now = 1, source
    while have < w:
        step = min(have, w - have)
        df = df.withColumn(f"{out}_{have + step}", F.expr(f"zip_with({_head(now, step)}, {_shift(now, step)}, (a, b) -> least(a, b))"))
        now, have = f"{out}_{have + step}", have + step
    return df.withColumn(out, F.expr(f"CASE WHEN size({now}) > 0 THEN array_distinct({now}) WHEN size({source}) > 0 THEN array(array_min({source})) ELSE cast(array() AS array<bigint>) END"))


def fingerprints(df: DataFrame, k: int, window: int) -> DataFrame:
    """Adds ``fp``: the kept k-grams of the array ``words`` as hash << 12 | (4095 - position), rightmost on ties."""
    df = df.withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))
    df = _pairs(df, "h", "g", k)
    df = df.withColumn("p", F.expr(f"transform(g, (x, i) -> (x & {-CHUNK}L) | ({CHUNK - 1}L - i))"))
    return _least(df, "p", "fp", window)


def chunked(df: DataFrame, span: int) -> DataFrame:
    """Rows with an array ``all`` to chunks: ``words`` and ``base``, the place of a chunk's first word; every span lies whole in one chunk."""
    step = CHUNK - span + 1
    starts = F.expr(f"CASE WHEN size(all) <= {CHUNK} THEN array(0) ELSE sequence(0, size(all) - {span}, {step}) END")
    df = df.withColumn("base", F.explode_outer(starts))
    return df.withColumn("words", F.expr(f"CASE WHEN size(all) <= {CHUNK} THEN all ELSE slice(all, base + 1, {CHUNK}) END")).drop("all")


def _covered(intervals: str) -> str:
    """SQL for the number of words in the union of intervals (s, e), sorted."""
    return f"aggregate({intervals}, struct(0L AS n, 0L AS upto), (acc, x) -> struct(acc.n + greatest(0L, x.e - greatest(x.s, acc.upto)) AS n, greatest(acc.upto, x.e) AS upto), acc -> acc.n)"


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 8, share: int = 20) -> DataFrame:
    """Finds the words of documents that lie in spans of ``span`` words shared with benchmark items.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Spans of an
    item: any ``span`` neighbouring words; an item of fewer, but not none, is one
    span. A document word in any occurrence of a span is hit.

    Returns per row of ``docs``: all its columns, and n_words, n_hit, n_items (items
    with occurring spans), items_sha256 (of those item_ids as text, sorted,
    comma-joined; lowercase hex), contaminated (n_hit > 0 and share * n_hit >=
    n_words). Columns of ``docs`` with these names are replaced. Null texts have no
    words; null item_ids are left out; equal items count each. Empty tables give no
    hits. ``docs`` is read twice (once for its words, whose hits are written to the
    shared folder) and must be dealt alike, as files and checkpoints are; a change
    raises an error.
    """
    window = span - k + 1
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("all")).where("item is not null and size(all) > 0")
    spans = items.select("item", F.expr(f"CASE WHEN size(all) < {span} THEN array(all) ELSE transform(sequence(1, size(all) - {span - 1}), i -> slice(all, i, {span})) END").alias("s"))
    spans = spans.select("item", F.explode_outer("s").alias("w")).select("item", F.size("w").alias("len"), F.array_join("w", " ").alias("span"))
    sets = spans.groupBy("span", "len").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set_id", F.xxhash64(F.array_join("items", ","))).cache()
    kinds = sets.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("named")).collect()  # at most `span` rows
    small = sum(r.n + r.named for r in kinds) <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda x: x)
    short = sorted(r.len for r in kinds if r.len < span)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("rid"), F.xxhash64("text").alias("now"))
    base = rows.select("rid", F.col("now").alias("seen"), words_of(F.col("doc.text").cast("string")).alias("all")).withColumn("n_words", F.size("all").cast("long"))
    chunks = chunked(base, span)

    # names of the items' spans: kept k-grams of full ones (one for each span at least, as in the documents), all words of shorter ones
    full = fingerprints(items.where(F.size("all") >= span).transform(lambda d: chunked(d, span)), k, window)
    names = full.select(F.explode_outer("fp").alias("x")).where("x is not null").select(F.lit(span).alias("il"), F.expr(f"x & {-CHUNK}L").alias("ih"))
    folded = "aggregate(slice(transform(split(span, ' '), w -> xxhash64(w)), 2, 99), element_at(transform(split(span, ' '), w -> xxhash64(w)), 1), (a, b) -> xxhash64(a, b))"
    names = names.unionByName(sets.where(F.col("len") < span).select(F.col("len").alias("il"), F.expr(folded).alias("ih"))).distinct()

    # one pass over the documents: kept k-grams as (span, first word of the neighbourhood, name), and every word sequence of the short lengths
    marked, last = fingerprints(chunks, k, window), "h"
    marks = [f"transform(fp, x -> named_struct('len', {span}, 'at', greatest(cast({CHUNK - 1} - (x & {CHUNK - 1}L) AS int) - {window - 1}, 0), 'name', x & {-CHUNK}L))"]
    for i in range(1, max(short, default=0) + 1):
        if i > 1:
            marked = marked.withColumn(f"s{i}", F.expr(f"zip_with({_head(last, 1)}, {_shift('h', i - 1)}, (a, b) -> xxhash64(a, b))"))
            last = f"s{i}"
        if i in short:
            marks.append(f"transform({last}, (x, i) -> named_struct('len', {i}, 'at', i, 'name', x))")
    marks.append("CASE WHEN base = 0 THEN array(named_struct('len', 0, 'at', 0, 'name', 0L)) ELSE array() END")
    marked = marked.select("rid", "seen", "n_words", "base", "words", F.explode_outer(F.expr(f"concat({', '.join(marks)})")).alias("x")).where("x is not null")
    marked = marked.select("rid", "seen", "n_words", "base", "words", "x.len", "x.at", "x.name")
    around = F.slice("words", F.col("at") + 1, F.when(F.col("len") == span, F.lit(span + window - 1)).otherwise(F.col("len")))
    if not small:  # the chunk's words would be shuffled with every name: only those around it go along
        marked = marked.withColumn("words", around)
    hits = marked.join(near(names), (F.col("len") == F.col("il")) & (F.col("name") == F.col("ih")), "left").where("ih is not null or len = 0")
    hits = hits.select("rid", "seen", "n_words", (F.col("base") + F.col("at")).cast("long").alias("start"), "len", F.when(F.col("ih").isNotNull(), around if small else F.col("words")).alias("near"))
    spread = hits.select("rid", "seen", "n_words", "start", "len", F.explode_outer(F.expr("CASE WHEN len > 0 AND size(near) >= len THEN transform(sequence(0, size(near) - len), i -> named_struct('i', i, 'span', array_join(slice(near, i + 1, len), ' '))) END")).alias("c"))
    found = spread.select("rid", "seen", "n_words", (F.col("start") + F.col("c.i")).alias("s"), F.col("c.span").alias("text_span"), F.col("len").cast("long").alias("len"))
    met = found.join(near(sets.select("span", "set_id")), F.col("text_span") == F.col("span"), "left")
    per = met.groupBy("rid").agg(
        F.max("n_words").alias("n_words"),
        F.max("seen").alias("seen"),
        F.array_sort(F.collect_set(F.when(F.col("set_id").isNotNull(), F.struct("s", (F.col("s") + F.col("len")).alias("e"))))).alias("iv"),
        F.collect_set("set_id").alias("ids"),
    )
    per = settle(per.select("rid", "seen", "n_words", F.expr(_covered("iv")).alias("n_hit"), "ids"), "hits")
    whole = sets.select("set_id", "items").dropDuplicates(["set_id"])
    named = per.where(F.size("ids") > 0).select("rid", F.explode("ids").alias("set_id")).join(near(whole), "set_id").select("rid", F.explode("items").alias("item")).groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("names"))
    per = per.drop("ids").join(named, "rid", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    per = per.select("rid", "seen", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"))
    per = per.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    alike = F.when(F.col("seen") == F.col("now"), F.col("n_words")).otherwise(F.raise_error(F.lit("the input's partitions changed between two reads")).cast("long"))
    joined = rows.join(per, "rid", "left").withColumn("n_words", alike)
    return joined.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in own], *own)


def op4_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs.select("doc_id", "text"), bench).drop("text")
