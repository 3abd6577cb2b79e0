"""Windowed aggregation of event streams with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return _sums(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "3 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return _sums(events, F.window("ts", width, step), late)


def _sums(events: DataFrame, window, late: str) -> DataFrame:  # noqa: ANN001
    out = events.withWatermark("ts", late) if events.isStreaming else events
    out = out.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late) if events.isStreaming else events
    out = out.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def run_to_end(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a bounded stream to its end and returns the result: of every key (columns that aren't null) the last row.

    Each batch's changed rows go to a folder of their own below ``folder``, which driver
    and executors share, together with the progress; a batch that runs twice replaces
    its rows, and nothing passes the driver.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/b{batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    none = spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long"))
    none.write.mode("overwrite").parquet(f"{folder}/rows/none")  # a stream without rows has no batch
    rows = spark.read.schema(none.schema).parquet(f"{folder}/rows/*")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in values]).select(*stream.columns)
