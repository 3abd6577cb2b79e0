"""Mixing sources to target weights by Poisson replication.

A document's number of copies inverts the Poisson distribution with its source's mean
repetition rate at a uniform number hashed from seed and doc_id, so that it needs no
state and is the same whenever it is computed. Copies are then shuffled globally by a
hash of seed, doc_id and copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._skew import join_unique

#: Sources (about 50 bytes each) up to which their rates are broadcast.
BROADCAST_SOURCES = 50_000
#: A larger rate is dealt to several draws, as exp(-rate) must not vanish.
MOST_RATE = 500.0


def uniform(*parts: str) -> str:
    """SQL for a number in (0, 1) hashed from the parts (SQL strings)."""
    return f"(cast(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) as bigint) + 0.5D) / 4503599627370496D"


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, seed: str = "mix") -> DataFrame:
    """Replicates documents so that sources reach their target shares of characters.

    ``weights``: target weights by source; None: equal ones. Sources without a weight
    get 0. ``total``: target size in characters, None: that of ``docs``. A source's
    mean rate is its share of the total over its size.

    Returns the columns of ``docs``, then copy (1, 2, ...), n_copies, rate and
    shuffle_key, in order of shuffle_key. Documents with 0 copies leave, as the
    distribution wants. Null sources are one source; null texts have no characters;
    a source without characters has rate 0. A null doc_id hashes as empty text;
    rows that repeat a doc_id get the same count. Columns with the result's names
    are replaced. An empty table gives no rows.
    """
    own = ["copy", "n_copies", "rate", "shuffle_key"]
    kept = [c for c in docs.columns if c not in own]
    doc = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc")
    rows = docs.select(doc, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("key"))
    chars = F.coalesce(F.char_length(F.col("doc.text").cast("string")), F.lit(0))
    sizes = rows.groupBy("key").agg(F.sum(chars).alias("size"), F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([("null" if k is None else f"s{k}", float(v)) for k, v in weights.items()] or [("s", 0.0)], "key string, w double")
        sizes = sizes.join(given, "key", "left").fillna(0.0, ["w"])
    sizes = sizes.cache()
    sums = sizes.agg(F.sum("size").alias("chars"), F.sum(F.when(F.col("size") > 0, F.col("w"))).alias("w"), F.count("*").alias("n")).first()
    goal, weight = float(sums.chars or 0) if total is None else float(total), float(sums.w or 0)
    rates = sizes.select("key", "n", F.when((F.col("size") > 0) & (F.lit(weight) > 0), F.col("w") / F.lit(weight or 1.0) * F.lit(goal) / F.col("size")).otherwise(F.lit(0.0)).alias("rate"))
    if sums.n <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(rates.drop("n")), "key", "left")
    else:
        rows = join_unique(rows, rates, "key", "n", ["rate"])
    draws = f"cast(greatest(1, ceil(rate / {MOST_RATE}D)) as int)"
    ident = "coalesce(cast(doc.doc_id as string), '')"
    u = uniform(f"'{seed}'", ident, "cast(j as string)")
    inverse = f"""aggregate(sequence(1, cast(ceil(r + 12 * sqrt(r) + 24) as int)), named_struct('k', 0L, 'p', exp(-r), 'cdf', exp(-r), 'u', {u}),
        (acc, i) -> CASE WHEN acc.u > acc.cdf THEN named_struct('k', cast(i as bigint), 'p', acc.p * r / i, 'cdf', acc.cdf + acc.p * r / i, 'u', acc.u) ELSE acc END, acc -> acc.k)"""
    rows = rows.withColumn("r", F.expr(f"rate / {draws}"))
    rows = rows.withColumn("n_copies", F.expr(f"aggregate(sequence(1, {draws}), 0L, (s, j) -> s + {inverse})"))
    rows = rows.where("n_copies > 0").withColumn("copy", F.explode_outer(F.expr("sequence(1L, n_copies)")))
    rows = rows.withColumn("shuffle_key", F.expr(f"conv(substring(md5(concat_ws(':', '{seed}', 'order', {ident}, cast(copy as string))), 1, 15), 16, 10)").cast("long"))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in kept], *own).orderBy("shuffle_key")


def op10_query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH z AS (SELECT coalesce('s' || source, 'null') AS k, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1),
t AS (SELECT sum(size) AS chars, count(*) FILTER (size > 0) AS m FROM z),
r AS (SELECT z.k, CASE WHEN size > 0 THEN 1.0::DOUBLE / t.m * t.chars::DOUBLE / size ELSE 0.0 END AS rate FROM z, t),
c AS (SELECT k, rate, i, CASE WHEN rate > 0 THEN sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) OVER (PARTITION BY k ORDER BY i) ELSE 1.0 END AS cdf
  FROM r, range(0, 400) g(i)),
d AS (SELECT documents.*, coalesce('s' || source, 'null') AS k,
  (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.rate, (SELECT count(*) FROM c WHERE c.k = d.k AND c.cdf < d.u) AS n_copies FROM d JOIN r ON r.k = d.k),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies, rate,
  ('0x' || substr(md5('mix:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM e
"""
