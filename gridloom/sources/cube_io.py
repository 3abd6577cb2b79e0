"""Reading and writing cubes, points and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGERS = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647)}


def read_cube(spark: SparkSession, path: str, nodata: float | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A cube in Parquet; nodata becomes null; window (first row, last row, first column, last column) is pushed to the scan."""
    df = spark.read.parquet(path)
    if window:
        df = df.where(F.col("row").between(window[0], window[1]) & F.col("col").between(window[2], window[3]))
    return df if nodata is None else df.withColumn("value", F.nullif("value", F.lit(nodata)))


def write_cube(cube: DataFrame, path: str, expr: str | None = None) -> None:
    """Writes the groups that fulfil ``expr``, a folder for each group; nothing if none does."""
    (cube.where(expr) if expr else cube).write.mode("overwrite").partitionBy("grp").parquet(path)


def fit_in_dtype(value: Column, dtype: str, nodata: int) -> Column:
    """Rounds half to even, clamps, moves values that equal nodata at an end of the range by one, and writes nulls as nodata."""
    lo, hi = INTEGERS[dtype]
    v = F.least(F.greatest(F.rint(value), F.lit(float(lo))), F.lit(float(hi)))
    if nodata == lo:
        v = F.when(v == lo, float(lo + 1)).otherwise(v)
    elif nodata == hi:
        v = F.when(v == hi, float(hi - 1)).otherwise(v)
    return F.when(value.isNull(), float(nodata)).otherwise(v).cast("long")


def find_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths of files below a folder that match a glob, sorted."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path")


def read_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Points from CSV, also compressed."""
    return spark.read.csv(path, header=True, schema=schema)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet: columns ending in _list become arrays, those in _date timestamps (null if they can't be read)."""
    df = spark.read.csv(path, header=True)
    for c in df.columns:
        if c.endswith("_list"):
            df = df.withColumn(c, F.split(c, r"\s*,\s*"))
        elif c.endswith("_date"):
            df = df.withColumn(c, F.try_to_timestamp(c))
    return df


def read_sheets(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The sheets of a workbook that is stored as a CSV file for each; sheets without a header are left out."""
    sheets = {name: read_sheet(spark, path) for name, path in paths.items()}
    return {name: df for name, df in sheets.items() if df.columns}
