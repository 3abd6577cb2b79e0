"""From raw documents to a mixed training corpus, in five stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import settle
from gridloom.llm.decontaminate import contamination
from gridloom.llm.jaccard_join import jaccard_rows, numbered
from gridloom.llm.language_id import identify
from gridloom.llm.mixing import mix
from gridloom.llm.suffix_dedup import repeated_spans


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified."""
    return identify(docs).where("id_accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at 0.8 or more, directly or by others, one stays: that of the smallest doc_id (null last), of several the first."""
    losers = jaccard_rows(docs, 5, 0.8).where("row <> keeper").select(F.col("row").alias("_lost"))
    return numbered(docs.select(F.struct(*docs.columns).alias("_doc"))).join(losers, F.col("row") == F.col("_lost"), "left_anti").select("_doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 100-byte strings that also start earlier; a document of which no word is left goes."""
    cut = repeated_spans(docs, 100, tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars")))
    own = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cut.where("n_removed = 0 OR trim(kept) <> ''").select(*[own[c].alias(c) if c in own else F.col(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a span of 13 words (or a whole item of fewer) of the benchmark go, whatever their length."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).where("n_hit = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents to equal shares of the sources and shuffles them."""
    return mix(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontaminate),
    ("mixing", mixing),
]

#: Suffix dedup, components and language models are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
