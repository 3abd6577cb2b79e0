"""Numbers and blocks of rows in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Adds ``name``: 0, 1, ... in order of ``keys``. Rows are sorted into ranges; only the ranges' sizes meet.

    Rows that agree in all keys are numbered in any order. The sorted rows are kept in
    memory or on disk, as their ranges are read twice.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).persist()
    sizes = sorted((r.part, r.n) for r in ranged.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    if not sizes:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("_at")
    before, pairs = 0, []
    for part, n in sizes:
        pairs += [F.lit(part).cast("long"), F.lit(before).cast("long")]
        before += n
    return ranged.withColumn(name, F.create_map(*pairs)[F.shiftright("_at", 33)] + (F.col("_at").bitwiseAND((1 << 33) - 1))).drop("_at")


def contiguous_folds(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Adds ``fold`` 0 to n - 1: blocks of neighbouring rows in order of ``keys``; the first (rows mod n) folds have a row more."""
    rows = numbered(df, keys, "_n")
    total = df.count()
    size, more = divmod(total, n)
    edge = more * (size + 1)
    late = F.floor((F.col("_n") - edge) / max(size, 1)) + more
    return rows.withColumn("fold", F.when(F.col("_n") < edge, F.floor(F.col("_n") / (size + 1))).otherwise(late).cast("int")).drop("_n")
