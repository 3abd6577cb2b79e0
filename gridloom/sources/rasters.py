"""Raster files in and out: layers of a catalog to cells, and cells to files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .cube_io import INTEGERS, fit_in_dtype
from .geotiff import Grid, Tiff, encode

CELL = "row long, col long, value double"


def grids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Of every file its path (as Spark names it), bands, data type, and grid (gt0 left edge, gt1, gt3 upper edge, gt5, width, height, epsg, nodata)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = Tiff(raw.as_buffer().to_pybytes())
                g = t.grid
                yield pa.RecordBatch.from_pylist([{"path": path, "bands": t.bands, "dtype": t.dtype.name, "gt0": g.left, "gt1": g.dx, "gt3": g.top, "gt5": g.dy, "width": g.width, "height": g.height, "epsg": g.epsg, "nodata": g.nodata}], schema=_GRID)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, bands long, dtype string, gt0 double, gt1 double, gt3 double, gt5 double, width long, height long, epsg long, nodata double")


_GRID = pa.schema([("path", pa.string()), ("bands", pa.int64()), ("dtype", pa.string()), ("gt0", pa.float64()), ("gt1", pa.float64()), ("gt3", pa.float64()), ("gt5", pa.float64()), ("width", pa.int64()), ("height", pa.int64()), ("epsg", pa.int64()), ("nodata", pa.float64())])


def read_layers(layers: DataFrame, window: tuple[int, int, int, int] | None = None, bounds: tuple[float, float, float, float] | None = None, overview: int | None = None, mask: DataFrame | None = None, on_error: str = "raise") -> DataFrame:
    """Cells of a catalog's layers (grp, path, band, start_date, end_date, name; see catalog): px, row, col, grp, start_date, end_date, name, value.

    window: first row, first column, rows, columns; bounds: a box in the raster's
    coordinates. Of either only the part inside a raster is read; if nothing is, the
    whole layer comes as missing cells of the window's size (a raster that lies
    elsewhere is no error). overview: of every so many rows and columns the first.
    mask: cells (row, col, mask); where mask is 0 or missing the value is null. Missing
    cells (nodata, NaN) are null. px counts the cells of a row first.

    A layer of many files (see save_layers) has a row for each, with row0 and col0, the
    file's first row and column in the layer, and width, the layer's columns. Windows,
    rows, columns and px are the layer's; a file that lies outside adds no cells.

    A file that can't be read raises, or with on_error "null" is a layer of nulls (with
    a window) or of no cells (also if it is one of many). Files come by Spark's own
    reader, from wherever it reads.
    """
    if overview is not None and overview < 1:
        raise ValueError(f"no overview of level {overview}")
    spark = layers.sparkSession
    if "row0" not in layers.columns:
        layers = layers.withColumns({c: F.lit(None).cast("long") for c in ("row0", "col0", "width")})
    elif window and not bounds:  # files that begin behind the window are not opened
        layers = layers.where(F.col("row0").isNull() | ((F.col("row0") < window[0] + window[2]) & (F.col("col0") < window[1] + window[3])))
    paths = [r.path for r in layers.select("path").distinct().collect()]  # a catalog is small
    if not paths:
        return spark.createDataFrame([], f"px long, {CELL}, grp string, start_date date, end_date date, name string")
    at = F.regexp_replace("path", "^file:/*", "/").alias("at")  # as it compares
    keys = layers.select("grp", F.coalesce("band", F.lit(1)).cast("long").alias("band"), "start_date", "end_date", "name", *[F.col(c).cast("long") for c in ("row0", "col0", "width")], at)
    content = spark.read.format("binaryFile").load(paths).select(at, "content")
    rows = keys.join(content, "at").select("grp", "band", "start_date", "end_date", "name", "row0", "col0", "width", "content")
    schema = pa.schema([("grp", pa.string()), ("start_date", pa.date32()), ("end_date", pa.date32()), ("name", pa.string()), ("width", pa.int64()), ("row", pa.int64()), ("col", pa.int64()), ("value", pa.float64())])

    def part(raw: bytes, band: int, row0: int | None, col0: int | None, width: int | None) -> tuple[int, int, int, np.ndarray]:
        """First row, first column, the layer's width, values."""
        try:
            t = Tiff(raw)
            g = t.grid
            down, right = row0 or 0, col0 or 0
            row, col, high, wide = g.box(*bounds) if bounds else (window[0] - down, window[1] - right, *window[2:]) if window else (0, 0, g.height, g.width)
            r0, c0, r1, c1 = max(row, 0), max(col, 0), min(row + high, g.height), min(col + wide, g.width)
            if r0 >= r1 or c0 >= c1:
                return row, col, width or g.width, np.full((high, wide) if row0 is None else (0, 0), np.nan)
            v = t.read(band, (r0, c0, r1 - r0, c1 - c0)).astype(float)
            return down + r0, right + c0, width or g.width, v if g.nodata is None else np.where(v == g.nodata, np.nan, v)
        except (ValueError, KeyError, IndexError, OSError):
            if on_error != "null":
                raise
            row, col, high, wide = window if window and row0 is None else (0, 0, 0, 0)
            return row, col, col + wide, np.full((high, wide), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grp, band, start, end, name, *place = (batch.column(c)[i].as_py() for c in range(8))
                row, col, width, v = part(batch.column(8)[i].as_buffer().to_pybytes(), band, *place)
                at, left = np.indices(v.shape)
                at, left = at + row, left + col
                if overview:
                    keep = (at % overview == 0) & (left % overview == 0)
                    at, left, v, width = at[keep] // overview, left[keep] // overview, v[keep], -(-width // overview)
                flat = v.reshape(-1)
                n = len(flat)
                same = [pa.array([x] * n, f.type) for x, f in zip((grp, start, end, name, width), schema, strict=False)]
                for k in range(0, n, 1 << 20):
                    cut = slice(k, min(n, k + (1 << 20)))
                    yield pa.record_batch([*[a.slice(k, cut.stop - k) for a in same], pa.array(at.reshape(-1)[cut]), pa.array(left.reshape(-1)[cut]), pa.array(flat[cut], mask=np.isnan(flat[cut]))], schema=schema)

    cells = rows.mapInArrow(run, "grp string, start_date date, end_date date, name string, width long, row long, col long, value double")
    cells = cells.withColumn("px", F.col("row") * F.col("width") + F.col("col"))
    if mask is not None:
        cells = cells.join(mask.select("row", "col", (F.col("mask") != 0).alias("_keep")), ["row", "col"], "left").withColumn("value", F.when(F.col("_keep"), F.col("value")))
    return cells.select("px", "row", "col", "grp", "start_date", "end_date", "name", "value")


def save_layers(cells: DataFrame, folder: str, grid: Grid, dtype: str = "float32", block: int = 2048, on_file: Callable[[str], None] | None = None) -> DataFrame:
    """Writes cells (name, row, col, value) as GeoTIFF files and returns them: name, path, row0, col0, n_cells (with a value).

    A layer of at most ``block`` rows and columns is ``{name}.tif``; a larger one is a
    file for each block, ``{name}_{block row}_{block column}.tif``, each with its own
    grid, so that no task holds more than a block. Nulls are the grid's nodata (NaN for
    floats if unset); integers are rounded half to even, clamped, and moved off nodata.
    ``on_file`` is called with each file's path in the task that wrote it. The result
    must be evaluated for the files to be written; a task that runs twice writes the
    same files again.
    """
    whole = np.issubdtype(np.dtype(dtype), np.integer)
    nodata = grid.nodata if grid.nodata is not None else (INTEGERS[dtype][0] if whole else float("nan"))
    value: Column = fit_in_dtype(F.col("value"), dtype, int(nodata)).cast("double") if whole else F.coalesce("value", F.lit(nodata))
    one = grid.height <= block and grid.width <= block
    rows = cells.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    rows = rows.select("name", "row", "col", value.alias("v"), F.col("value").isNotNull().alias("has"), F.floor(F.col("row") / block).cast("long").alias("br"), F.floor(F.col("col") / block).cast("long").alias("bc"))

    def run(table: pa.Table) -> pa.Table:
        name, br, bc = (table[c][0].as_py() for c in ("name", "br", "bc"))
        row, col = br * block, bc * block
        high, wide = min(block, grid.height - row), min(block, grid.width - col)
        band = np.full((high, wide), nodata, dtype)
        band[table["row"].to_numpy() - row, table["col"].to_numpy() - col] = table["v"].to_numpy().astype(dtype)
        path = f"{folder}/{name}.tif" if one else f"{folder}/{name}_{br}_{bc}.tif"
        part = grid.window(row, col, high, wide)
        files.write_whole(path, encode(band, Grid(part.left, part.dx, part.top, part.dy, wide, high, part.epsg, nodata)))
        if on_file:
            on_file(path)
        return pa.table({"name": [name], "path": [path], "row0": pa.array([row], pa.int64()), "col0": pa.array([col], pa.int64()), "n_cells": pa.array([int(table["has"].to_numpy(zero_copy_only=False).sum())], pa.int64())})

    return rows.groupBy("name", "br", "bc").applyInArrow(run, "name string, path string, row0 long, col0 long, n_cells long")
