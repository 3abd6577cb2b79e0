"""Cubes, points and catalogs made of the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_cube(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Mean quantity of a supplier (and return flag) in a quarter."""
    return _lineitem(spark, sf_dir, "quarter", 3, by)


def month_cube(spark: SparkSession, sf_dir: str, by: str | None = "l_returnflag") -> DataFrame:
    return _lineitem(spark, sf_dir, "month", 1, by)


def _lineitem(spark: SparkSession, sf_dir: str, unit: str, months: int, by: str | None) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("px"), (F.col(by) if by else F.lit("qty")).alias("grp"), F.trunc(F.to_date("l_shipdate"), unit).alias("start_date"), "l_quantity")
    out = rows.groupBy("px", "grp", "start_date").agg(F.avg("l_quantity").alias("value"))
    return out.select("px", "grp", "start_date", F.date_sub(F.add_months("start_date", months), 1).alias("end_date"), "value")


def day_cube(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Mean value of a user and event type on a day."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("px"), F.col("event_type").alias("grp"), F.to_date("ts").alias("start_date"), "value")
    if kind:
        rows = rows.where(F.col("grp") == kind)
    return rows.groupBy("px", "grp", "start_date").agg(F.avg("value").alias("value")).select("px", "grp", "start_date", F.col("start_date").alias("end_date"), "value")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a raster: row, col, value, and a class for each row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("label"), F.posexplode_outer("embedding").alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"), "label")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pt_id"), (F.col("l_quantity") + 0.5).alias("x"), (F.pmod("l_orderkey", F.lit(500)) + 0.5).alias("y"), F.to_date("l_shipdate").alias("date"))


def _line_sql(unit: str, months: int, by: str | None) -> str:
    return f"""SELECT l_suppkey AS px, {by or "'qty'"} AS grp, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS start_date,
    CAST(date_trunc('{unit}', l_shipdate) + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE) AS end_date, avg(l_quantity) AS value
    FROM lineitem GROUP BY 1, 2, 3, 4"""


QUARTER = _line_sql("quarter", 3, None)
QUARTER_FLAG = _line_sql("quarter", 3, "l_returnflag")
MONTH = _line_sql("month", 1, "l_returnflag")
DAY = "SELECT user_id AS px, event_type AS grp, CAST(ts AS DATE) AS start_date, CAST(ts AS DATE) AS end_date, avg(value) AS value FROM events GROUP BY 1, 2, 3, 4"
RASTER = "SELECT vec_id AS row, CAST(i - 1 AS BIGINT) AS col, CAST(embedding[i] AS DOUBLE) AS value, label FROM embeddings, range(1, 65) r(i)"
POINTS = "SELECT l_orderkey || '-' || l_linenumber AS pt_id, l_quantity + 0.5 AS x, CAST(l_orderkey % 500 + 0.5 AS DOUBLE) AS y, CAST(l_shipdate AS DATE) AS date FROM lineitem"
