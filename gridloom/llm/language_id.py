"""Language identification by Bayesian fusion of evidence.

log posterior(L) = tempered log P(text | L) + log P(declared language | L)
                 + log P(address suffix | L) + log prior(L | host)

The text part is a model of hashed byte trigrams, fitted on a bounded sample of rows
with a declared language; a text that no known language explains better than evenly
spread trigrams is of none of them (``und``). The declared language is a column's or
a page's own markup. The host's prior is smoothed over a hierarchy: counts of the
text's best language by host are drawn to those of the host's parent domain, these to
the whole corpus's, by grouped aggregation over all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, TILE, release, text_bytes
from ._shared import settle
from ._skew import join_unique
from .url_filter import split_url

#: Distinct texts from which the text model is fitted: so many for all languages together, but LEAST_ROWS for each.
SAMPLE_ROWS, LEAST_ROWS = 4_000, 50
CELLS = 1 << 15
#: Hosts (about 100 bytes each) up to which their priors are broadcast.
BROADCAST_HOSTS = 50_000
#: The language of a text that is of none of the known ones.
NONE = "und"
#: Public country-code suffixes and the language they speak for.
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def _grams(data: np.ndarray) -> np.ndarray:
    """A cell for every byte trigram, A-Z lower-cased, digits and other ASCII signs as spaces."""
    x = _FOLD[data].astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(17)).astype(np.int64)


_FOLD = LOWER.copy()
for _i in range(128):
    if not chr(_i).isalpha():
        _FOLD[_i] = 32


def row_grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trigram cells and their rows, tile by tile; those across two texts and of three spaces are left out."""
    data, off = text_bytes(column)
    for a in range(0, len(data), TILE):
        part = data[a : a + TILE + 2]
        if len(part) < 3:
            continue
        at = np.arange(a, a + len(part) - 2)
        row = np.searchsorted(off, at, "right") - 1
        fold = _FOLD[part] == 32
        fine = (at + 3 <= off[row + 1]) & ~(fold[:-2] & fold[1:-1] & fold[2:])
        yield _grams(part)[fine], row[fine]


def text_scorer(weights: np.ndarray):  # noqa: ANN201
    """An Arrow function of a text: per language the mean log likelihood of its trigrams, then their number."""
    table = weights.T.copy()  # cells x languages

    @F.arrow_udf("array<double>")
    def score(text: pa.Array) -> pa.Array:
        n, k = len(text), table.shape[1]
        total, count = np.zeros((n, k)), np.zeros(n)
        for cells, rows in row_grams(text):
            if len(rows):
                lo, hi = rows[0], rows[-1] + 1
                count[lo:hi] += np.bincount(rows - lo, minlength=hi - lo)
                for j in range(k):
                    total[lo:hi, j] += np.bincount(rows - lo, table[cells, j], hi - lo)
        out = np.concatenate([total / np.maximum(count, 1)[:, None], count[:, None]], axis=1)
        release()
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), k + 1).cast(pa.list_(pa.float64()))

    return score


def language_code(value: Column) -> Column:
    """The language of a tag like ``de-AT``: two or three letters in lower case, else null."""
    code = F.lower(F.trim(F.split(value.cast("string"), "[-_]")[0]))
    return F.when(code.rlike("^[a-z]{2,3}$"), code)


def markup_language(html: Column) -> Column:
    """The language that a page declares for itself: of its html tag, else of its content-language."""
    tag = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-_]+)", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([A-Za-z-_]+)", 1)
    return F.coalesce(language_code(F.nullif(tag, F.lit(""))), language_code(F.nullif(meta, F.lit(""))))


def markup_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "&[A-Za-z0-9#]{1,10};", " ")


def fit_text(docs: DataFrame, declared: Column, text: Column, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages (all that any row declares, with a text) and their log trigram weights.

    Of every language the same number of distinct texts is taken, those with the
    least hashes: rows / languages, but LEAST_ROWS at least.
    """
    said = docs.select(declared.alias("lang"), text.cast("string").alias("text")).where("lang is not null and length(text) > 0").withColumn("h", F.xxhash64("text"))
    kinds = {r.lang: r.n for r in said.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row for each language code
    if not kinds:
        return [], np.zeros((0, CELLS))
    each = max(LEAST_ROWS, rows // len(kinds))
    share = F.create_map(*[x for lang, n in kinds.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * each / max(n, 1))))])[F.col("lang")]
    some = said.where(F.col("h") / F.lit(2.0**64) + 0.5 <= share).groupBy("lang", "h").agg(F.first("text").alias("text"))  # copies count once
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # over at most some 2 * each rows of a language
    sample = some.withColumn("i", first).where(F.col("i") <= each).select("lang", "text").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for cells, rows_ in row_grams(batch.column(1)):
                for lang in set(langs[rows_].tolist()):
                    sums.setdefault(lang, np.zeros(CELLS, np.int64))
                    sums[lang] += np.bincount(cells[langs[rows_] == lang], minlength=CELLS)
        for lang, c in sums.items():
            yield pa.record_batch({"lang": [lang], "n": pa.array([zlib.compress(c.astype(np.int32).tobytes(), 1)], pa.binary())})

    sums: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "lang string, n binary").collect():  # of the bounded sample
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(zlib.decompress(r.n), np.int32).astype(np.int64)
    langs = sorted(sums)
    weights = np.array([np.log((sums[x] + 0.5) / (sums[x].sum() + 0.5 * CELLS)) for x in langs]) if langs else np.zeros((0, CELLS))
    return langs, weights


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", trust_declared: float = 0.9, trust_suffix: float = 0.7, smoothing: float = 20.0, evidence: float = 60.0, none: float = 0.01, min_posterior: float = 0.5, allowed: tuple[str, ...] | None = None, keep_text: bool = True) -> DataFrame:
    """Adds to every row: id_lang, id_posterior, id_text_lang, id_accepted.

    id_text_lang is the text's best language alone (null without trigrams),
    id_lang the fused one, or ``und``. The text's mean log likelihood counts as that of
    at most ``evidence`` trigrams, as neighbouring ones are not independent. A declared
    language agrees with the true one with probability trust_declared, a country
    suffix of the host with trust_suffix; unknown or missing ones are no evidence.
    ``smoothing`` is the weight of the parent's distribution, in rows; ``none`` the
    prior probability of another language or of no language, under which trigrams are
    spread evenly and evidence is no better than chance.

    A row is rejected when its text has no trigram of letters (null and empty ones
    too), when it is ``und``, when the posterior stays under min_posterior, or when
    id_lang isn't in ``allowed`` (None: all). Null hosts use the corpus's prior. A
    table without any declared language gives null languages and rejects all. All
    columns of ``docs`` stay, but those of the four result names (and the text, unless
    keep_text); rows and repeats are kept. Ties go to the first language by name.
    Texts are scored once; rows with their scores are written to the shared folder.
    """
    names = ["id_lang", "id_posterior", "id_text_lang", "id_accepted"]
    kept = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc")
    said = language_code(F.col(declared))
    langs, weights = fit_text(docs, said, F.col(text))
    back = [F.col("doc").getField(c).alias(c) for c in kept]
    if not langs:
        return docs.select(whole).select(*back, F.lit(None).cast("string").alias(names[0]), F.lit(None).cast("double").alias(names[1]), F.lit(None).cast("string").alias(names[2]), F.lit(False).alias(names[3]))
    k, scorer = len(langs), text_scorer(weights)
    table = F.array(*[F.lit(x) for x in [*langs, NONE]])
    place = F.lower(F.col(host).cast("string"))
    parent = F.when(place.contains("."), F.substring_index(place, ".", -2)).otherwise(F.lit(""))
    held = settle(docs.select(whole, said.alias("said"), place.alias("host"), parent.alias("parent"), scorer(F.col(text).cast("string")).alias("s")), "scored")

    best = F.when(F.col("s")[k] > 0, F.expr(f"cast(array_position(slice(s, 1, {k}), array_max(slice(s, 1, {k}))) as int)"))
    held = held.withColumn("best", best)
    counts = held.where("best is not null").groupBy("host", "parent").agg(*[F.count_if(F.col("best") == i + 1).alias(f"n{i}") for i in range(k)], F.count("*").alias("n")).cache()
    totals = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(k)]).first()
    everything = sum(totals)
    prior = [(totals[i] + 1.0) / (everything + k) for i in range(k)]
    up = counts.where("host is not null").groupBy("parent").agg(*[F.sum(f"n{i}").alias(f"p{i}") for i in range(k)], F.sum("n").alias("pn"))
    hosts = counts.where("host is not null").join(up, "parent")
    mixed = [(F.col(f"n{i}") + smoothing * (F.col(f"p{i}") + smoothing * prior[i]) / (F.col("pn") + smoothing)) / (F.col("n") + smoothing) for i in range(k)]
    hosts = hosts.select(F.col("host").alias("at"), "n", F.array(*[F.log(m) for m in mixed]).alias("prior"))
    if hosts.count() <= BROADCAST_HOSTS:
        held = held.join(F.broadcast(hosts.drop("n")), F.col("host") == F.col("at"), "left")
    else:
        held = join_unique(held, hosts.withColumnRenamed("at", "host"), "host", "n", ["prior"])
    suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[F.substring_index(F.col("host"), ".", -1)]
    held = held.withColumn("suffix", F.when(F.col("host").contains("."), suffix)).withColumn("size", F.least(F.col("s")[k], F.lit(evidence)))
    parts, away = [], max(k - 1, 1)
    for i, lang in enumerate(langs):
        declares = F.when(F.col("said").isin(langs), F.when(F.col("said") == lang, math.log(trust_declared)).otherwise(math.log((1 - trust_declared) / away))).otherwise(0.0)
        points = F.when(F.col("suffix").isin(langs), F.when(F.col("suffix") == lang, math.log(trust_suffix)).otherwise(math.log((1 - trust_suffix) / away))).otherwise(0.0)
        parts.append(F.col("s")[i] * F.col("size") + declares + points + F.coalesce(F.col("prior")[i], F.lit(math.log(prior[i]))) + math.log(1 - none))
    chance = [F.when(F.col(c).isin(langs), math.log(1 / k)).otherwise(0.0) for c in ("said", "suffix")]
    parts.append(F.col("size") * -math.log(CELLS) + chance[0] + chance[1] + math.log(none))
    held = held.withColumn("p", F.array(*parts)).withColumn("e", F.expr("transform(p, x -> exp(x - array_max(p)))"))
    held = held.withColumn("id_lang", F.element_at(table, F.expr("cast(array_position(p, array_max(p)) as int)")))
    held = held.withColumn("id_posterior", F.expr("array_max(e) / aggregate(e, 0D, (a, b) -> a + b)"))
    held = held.withColumn("id_text_lang", F.element_at(table, F.col("best")))
    fits = (F.col("s")[k] > 0) & (F.col("id_lang") != NONE) & (F.col("id_posterior") >= min_posterior)
    if allowed is not None:
        fits &= F.col("id_lang").isin(list(allowed))
    return held.withColumn("id_accepted", fits).select(*back, *names)


def op2_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Documents (declared language and source) and pages (markup, address) in one corpus. Pages have doc_ids below 0 (-1 - page_id); page_id is null for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "lang", "source", "n_chars")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    shown = pages.select((-1 - F.col("page_id")).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), markup_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("lang"), split_url(F.col("url"))[0].alias("source"))
    return identify(docs.unionByName(shown.withColumn("n_chars", F.char_length("text").cast("long"))), keep_text=False)
