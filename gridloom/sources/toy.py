"""Toy cubes and samples of any size, made by rule on the executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timedim

# Fixed values of the toy calendar: four intervals a year.
START, END, STEPS = "20141202", "20201201", [109, 96, 80, 80]


def ndvi(spark: SparkSession, height: int = 256, width: int = 256, gappy: bool = False) -> DataFrame:
    """A cube (px, row, col, grp, start_date, end_date, value) of 24 layers ``ndvi``: a season, a slow rise and noise; gappy: a fifth of the cells is null."""
    days = timedim.intervals_df(spark, timedim.date_range(START, END, "days", STEPS))
    px = spark.range(height * width).select(F.col("id").alias("px"), F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    noise = F.pmod(F.xxhash64("px", "i"), F.lit(1000)) / 1000.0
    value = 50 + 30 * F.sin(F.col("i") * (math.pi / 2)) + F.col("i") * F.col("row") / height + 5 * noise
    if gappy:
        value = F.when(F.pmod(F.xxhash64("i", "px"), F.lit(5)) > 0, value)
    return px.crossJoin(F.broadcast(days)).select("px", "row", "col", F.lit("ndvi").alias("grp"), "start_date", "end_date", value.alias("value"))


def samples(spark: SparkSession, n: int = 256, height: int = 256, width: int = 256) -> DataFrame:
    """Points (pt_id, row, col, date, target, label), spread by a hash."""
    place = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)) for k, m in ((1, height), (2, width), (3, 6), (4, 4))]
    rows = spark.range(n).select(F.col("id").alias("pt_id"), *[p.alias(c) for p, c in zip(place, ("row", "col", "y", "target"), strict=True)])
    return rows.select("pt_id", "row", "col", F.make_date((F.col("y") + 2015).cast("int"), F.lit(1), F.lit(1)).alias("date"), F.col("target").cast("int").alias("target"), F.concat(F.lit("class "), "target").alias("label"))
