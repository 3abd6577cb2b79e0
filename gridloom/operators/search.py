"""Full-text search over titles and descriptions, and metadata checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def words(col: Column) -> Column:
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")


def bm25(docs: DataFrame, key: str, text: str, query: list[str], limit: int = 10) -> DataFrame:
    """The best ``limit`` documents that hold all words of the query: pos, key, score."""
    query = sorted(set(query))
    slim = docs.select(key, words(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    sums = slim.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    terms = slim.select(key, "len", F.explode_outer(F.filter("w", lambda x: x.isin(query))).alias("term")).where("term IS NOT NULL").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    scored = terms.join(F.broadcast(df), "term").crossJoin(F.broadcast(sums))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hits = scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(query)).orderBy(F.desc("score"), key).limit(limit)
    return hits.select(F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long").alias("pos"), key, "score")


def search_catalog(catalog: DataFrame, query: str, field: str = "title", limit: int = 10) -> DataFrame:
    """Entries (id, title, description) that hold all words of a query in their title, or in title and description: pos, id, title, score."""
    if field not in ("title", "description"):
        raise ValueError(f"no field {field}")
    text = F.col("title") if field == "title" else F.concat_ws(" ", "title", "description")
    hits = bm25(catalog.select("id", text.alias("text")), "id", "text", re.findall("[a-z0-9]+", query.lower()), limit)
    return hits.join(catalog.select("id", "title"), "id").select("pos", "id", "title", "score")


def metadata_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``complete``: all columns hold more than white space."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return df.withColumn("complete", ok)
