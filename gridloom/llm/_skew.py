"""Joins that stay even when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than a 256th of all are hot; there are under 256 of them, so that their side is a proven small broadcast.
HOT_PARTS = 256


def join_unique(left: DataFrame, right: DataFrame, key: str, n: str, values: list[str]) -> DataFrame:
    """Left join on ``key`` with ``right``, which has one row for each key and in ``n`` the left rows of the key.

    Hot keys (at most HOT_PARTS) come by broadcast and their rows are dealt out at
    random by a salted key that matches nothing; all others by a shuffled join. A
    null key matches nothing.
    """
    total = right.agg(F.sum(n).alias("_total"))
    hot = right.crossJoin(F.broadcast(total)).where(F.col(n) * HOT_PARTS > F.col("_total")).select(F.col(key).alias("_hk"), *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_hot"))
    cold = right.select(F.col(key).cast("string").alias("_ck"), *[F.col(v).alias(f"_c_{v}") for v in values])
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    salt = F.concat(F.lit("\u0000salt"), F.pmod(F.monotonically_increasing_id(), F.lit(100_003)).cast("string"))
    out = out.withColumn("_k", F.when(F.col("_hot"), salt).when(F.col(key).isNull(), salt).otherwise(F.col(key).cast("string")))
    out = out.join(cold, F.col("_k") == F.col("_ck"), "left")
    for v in values:
        out = out.withColumn(v, F.when(F.col("_hot"), F.col(f"_h_{v}")).otherwise(F.col(f"_c_{v}")))
    return out.drop("_hk", "_hot", "_k", "_ck", *[f"_h_{v}" for v in values], *[f"_c_{v}" for v in values])
