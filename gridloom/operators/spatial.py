"""Grids, tiles, blocks and overlay: range joins turned into equal keys by arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd


def cell_of(x: Column, y: Column, left: float, top: float, res: float) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point."""
    return F.floor((top - y) / res).cast("long"), F.floor((x - left) / res).cast("long")


def in_bounds(x: Column, y: Column, left: float, bottom: float, right: float, top: float) -> Column:
    return x.between(left, right) & y.between(bottom, top)


def block_of(row: Column, col: Column, height: int, width: int) -> tuple[Column, Column]:
    return F.floor(row / height).cast("long"), F.floor(col / width).cast("long")


def block_plan(points: DataFrame, layers: DataFrame) -> DataFrame:
    """Points (pt_id, x, y) in the blocks of layers (layer, gt0, gt1, gt3, gt5, block_h, block_w): pt_id, layer, row, col, block_row, block_col.

    Layers of one grid share their points' cells, which are found once for each distinct grid.
    """
    grid = ["gt0", "gt1", "gt3", "gt5", "block_h", "block_w"]
    plans = points.crossJoin(F.broadcast(layers.select(*grid).distinct()))  # a few grids
    row, col = F.floor((F.col("y") - F.col("gt3")) / F.col("gt5")).cast("long"), F.floor((F.col("x") - F.col("gt0")) / F.col("gt1")).cast("long")
    placed = plans.withColumns({"row": row, "col": col}).withColumns({"block_row": F.floor(row / F.col("block_h")).cast("long"), "block_col": F.floor(col / F.col("block_w")).cast("long")})
    return placed.join(layers, grid).select("pt_id", "layer", "row", "col", "block_row", "block_col")


def in_block(x: Column, y: Column, left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Half-open: left <= x < right and bottom < y <= top."""
    return (x >= left) & (x < right) & (y > bottom) & (y <= top)


def space_overlay(points: DataFrame, cells: DataFrame, layers: list[str]) -> DataFrame:
    """Every point (pt_id, row, col) with a column for each layer of cells (row, col, layer, value); null outside."""
    wide = cells.groupBy("row", "col").pivot("layer", layers).agg(F.first("value"))
    return points.join(wide, ["row", "col"], "left")


def spacetime_overlay(points: DataFrame, cells: DataFrame, layers: dict[str, int | tuple[int, ...]]) -> DataFrame:
    """Like space_overlay for layers of a year: ``layers`` maps names to offsets from the point's year; other years' columns end in _m1, _p1 and so on."""
    out = points
    for name, offsets in layers.items():
        for off in offsets if isinstance(offsets, tuple) else (offsets,):
            side = cells.where(F.col("layer") == name).select("row", "col", (F.col("year") - off).alias("year"), F.col("value").alias(name if off == 0 else f"{name}_{'m' if off < 0 else 'p'}{abs(off)}"))
            out = out.join(side, ["row", "col", "year"], "left")
    return out


def point_query(points: DataFrame, cube: DataFrame) -> DataFrame:
    """The values of all layers at each point (pt_id, px), in long form."""
    return points.join(cube, "px")


def tiles(spark: SparkSession, size: float, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Tiles of an extent, x outer and y inner; the last ones are cut at the extent."""
    nx, ny = (int(-(-(b - a) // size)) for a, b in ((left, right), (bottom, top)))
    i, j = F.floor(F.col("id") / ny), F.pmod("id", F.lit(ny))
    return spark.range(nx * ny).select(F.col("id").alias("tile_id"), (left + i * size).cast("double").alias("minx"), (bottom + j * size).cast("double").alias("miny"), F.least(left + (i + 1) * size, F.lit(right)).cast("double").alias("maxx"), F.least(bottom + (j + 1) * size, F.lit(top)).cast("double").alias("maxy"))


def zonal_stats(cells: DataFrame, key: str = "tile_id") -> DataFrame:
    """Per tile: minimum, most frequent value (the least of several), its count, maximum; of values that aren't null."""
    counts = cells.where("value IS NOT NULL").groupBy(key, "value").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("value", "n"), F.struct("n", -F.col("value")))
    return counts.groupBy(key).agg(F.min("value").alias("raster_min"), best["value"].alias("raster_mode_value"), best["n"].alias("raster_mode_count"), F.max("value").alias("raster_max"))


def block_aggregate(cells: DataFrame, partial: Column, final: Column) -> DataFrame:
    """``partial`` over the cells of each block (as column part), then ``final`` over the blocks."""
    return cells.groupBy("block_row", "block_col").agg(partial.alias("part")).agg(final)


def block_stack(layers: list[DataFrame], key: str = "px") -> DataFrame:
    """Cells that are valid in all layers, a column ``value_i`` for each."""
    out = layers[0].where("value IS NOT NULL").select(key, F.col("value").alias("value_0"))
    for i, d in enumerate(layers[1:], 1):
        out = out.join(d.where("value IS NOT NULL").select(key, F.col("value").alias(f"value_{i}")), key)
    return out


def point_in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule for a ring of corners."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            odd = odd != (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1))
    return odd


def overview(cells: DataFrame, level: int) -> DataFrame:
    """Nearest decimation: of every level x level cells the first. A level below 1 raises a ValueError."""
    if level < 1:
        raise ValueError(f"no overview of level {level}")
    key = F.struct("row", "col")
    return cells.groupBy("layer", F.floor(F.col("row") / level).alias("orow"), F.floor(F.col("col") / level).alias("ocol")).agg(F.min_by("value", key).alias("value"))


def regrid(cells: DataFrame, scale: float, shift_row: float = 0.0, shift_col: float = 0.0) -> DataFrame:
    """Nearest resampling to a grid whose cells are ``scale`` times as large and whose origin lies ``shift`` source cells before the source's.

    Every cell of the new grid takes the source cell that holds its centre; each source
    cell says itself which ones these are, so nothing is shuffled.
    """

    def takers(at: str, shift: float) -> Column:
        low, high = (F.ceil((F.col(at) + F.lit(d + shift)) / F.lit(scale) - 0.5).cast("long") for d in (0.0, 1.0))
        return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    rows = cells.select("layer", F.explode(takers("row", shift_row)).alias("row"), "col", "value")
    return rows.select("layer", "row", F.explode(takers("col", shift_col)).alias("col"), "value")


def common_grid(grids: DataFrame) -> DataFrame:
    """Of rasters (gt0 left edge, gt3 upper edge, gt1 and gt5 cell sizes, width, height): the union of their extents and the least cell size."""
    size = F.least(F.min(F.abs("gt1")), F.min(F.abs("gt5")))
    return grids.agg(
        F.min("gt0").alias("minx"), F.min(F.col("gt3") + F.col("gt5") * F.col("height")).alias("miny"),
        F.max(F.col("gt0") + F.col("gt1") * F.col("width")).alias("maxx"), F.max("gt3").alias("maxy"), size.alias("res"),
    )


def align(cells: DataFrame, grids: DataFrame, extent: tuple[float, float, float, float], res: float) -> DataFrame:
    """Cells (layer, row, col, value) of rasters with grids of their own (layer, gt0, gt1, gt3, gt5) on one grid from the extent's upper left corner (minx, miny, maxx, maxy), nearest.

    Cells of the new grid beyond a raster have no row. The rasters' grids are a small table.
    """
    minx, miny, maxx, maxy = extent
    last = {"row": math.ceil((maxy - miny) / res - 1e-9) - 1, "col": math.ceil((maxx - minx) / res - 1e-9) - 1}

    def takers(at: str, edge: Column, size: Column) -> Column:
        low, high = (F.greatest(F.lit(0), F.least(F.ceil((edge + size * (F.col(at) + d)) / F.lit(res) - 0.5), F.lit(last[at] + 1))).cast("long") for d in (0, 1))
        return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    own = cells.join(grids.select("layer", "gt0", "gt1", "gt3", "gt5"), "layer")
    rows = own.select("layer", F.explode(takers("row", F.lit(maxy) - F.col("gt3"), -F.col("gt5"))).alias("row"), "col", "value", "gt0", "gt1")
    return rows.select("layer", "row", F.explode(takers("col", F.col("gt0") - F.lit(minx), F.col("gt1"))).alias("col"), "value")


def pixel_window(bounds: tuple[float, float, float, float], left: float, top: float, res: float) -> tuple[int, int, int, int]:
    """First and last row, first and last column of a box (minx, miny, maxx, maxy): begin and lengths are rounded to whole cells."""
    minx, miny, maxx, maxy = bounds
    row, col = math.floor((top - maxy) / res + 1e-9), math.floor((minx - left) / res + 1e-9)
    return row, row + round((maxy - miny) / res) - 1, col, col + round((maxx - minx) / res) - 1


def tile_windows(tiles: DataFrame, left: float, top: float, res: float) -> DataFrame:
    """Adds to tiles the pixel window they cover: row0, row1, col0, col1 (inclusive)."""
    row0, col0 = F.floor((F.lit(top) - F.col("maxy")) / res + 1e-9).cast("long"), F.floor((F.col("minx") - F.lit(left)) / res + 1e-9).cast("long")
    rows, cols = F.round((F.col("maxy") - F.col("miny")) / res).cast("long"), F.round((F.col("maxx") - F.col("minx")) / res).cast("long")
    return tiles.withColumns({"row0": row0, "row1": row0 + rows - 1, "col0": col0, "col1": col0 + cols - 1})


def process_tiles(cells: DataFrame, fn: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str, height: int, width: int, only: list[int] | None = None, n_cols: int | None = None) -> DataFrame:
    """Runs ``fn(tile_id, cells)`` on every tile of ``height`` x ``width`` cells (row, col, ...), or on those in ``only``; a tile is one task's group.

    tile_id counts rows of tiles first: floor(row / height) * tiles in a row + floor(col / width);
    n_cols (the grid's width in cells) gives the tiles in a row, by default as many as the cells reach.
    """
    import pandas as pd

    per_row = -(-n_cols // width) if n_cols else cells.agg(F.floor(F.max("col") / width)).first()[0] or 0
    per_row = max(int(per_row) + (0 if n_cols else 1), 1)
    tile = (F.floor(F.col("row") / height) * per_row + F.floor(F.col("col") / width)).cast("long")
    rows = cells.withColumn("tile_id", tile)
    if only is not None:
        rows = rows.where(F.col("tile_id").isin(only))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return fn(int(key[0]), part.drop(columns="tile_id"))

    return rows.groupBy("tile_id").applyInPandas(run, schema)


def apply_along_time(cube: DataFrame, fn: Callable[[np.ndarray], np.ndarray], suffix: str) -> DataFrame:
    """Runs a function of a matrix (series x dates, NaN for nulls) that keeps its shape, on whole batches of equally long series; groups get the suffix."""
    from .temporal import from_series, lists, matrix, to_series

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        x, sizes = matrix(v)
        for n in np.unique(sizes[sizes > 0]).tolist():
            x[sizes == n, :n] = fn(x[sizes == n, :n])
        return lists(x, sizes)

    return from_series(to_series(cube).withColumn("out", run(F.col("ts.value"))), {"out": suffix})


def block_write(cells: DataFrame, ring: list[tuple[float, float]], value: Column, left: float, top: float, res: float, height: int, width: int) -> DataFrame:
    """A new layer over the blocks that a polygon meets: ``value`` at cells whose centre lies inside, null elsewhere.

    Blocks are found by the polygon's bounds alone, which the scan of ``cells`` (row, col, ...) can prune by.
    """
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    first, last = math.floor((top - max(ys)) / res / height) * height, (math.floor((top - min(ys)) / res / height) + 1) * height - 1
    west, east = math.floor((min(xs) - left) / res / width) * width, (math.floor((max(xs) - left) / res / width) + 1) * width - 1
    near = cells.where(F.col("row").between(first, last) & F.col("col").between(west, east))
    x, y = left + (F.col("col") + 0.5) * res, top - (F.col("row") + 0.5) * res
    return near.withColumn("value", F.when(point_in_polygon(x, y, ring), value))


def land_coverage(cells: DataFrame, wetlands: bool = False, ice: bool = False) -> DataFrame:
    """Share of land cells (class under 10, and 11 wetlands, 12 ice if asked for) with a value; null without any."""
    land = (F.col("land") < 10) | (F.lit(ice) & (F.col("land") == 12)) | (F.lit(wetlands) & (F.col("land") == 11))
    return cells.agg(F.try_divide(F.count_if(land & F.col("value").isNotNull()), F.count_if(land)).alias("coverage"))


def stretch(v: str, lo: float = 0.02, hi: float = 0.98) -> str:
    """SQL of a percentile stretch to [0, 1] over columns {v}_lo and {v}_hi; 0 where these are equal."""
    return f"least(greatest(try_divide({v} - {v}_lo, {v}_hi - {v}_lo), 0D), 1D)"


def rgb(wide: DataFrame, bands: tuple[str, str, str], lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Stretched bands and alpha, 0 where any band is missing."""
    limits = wide.agg(*[F.percentile(b, q).alias(f"{b}_{s}") for b in bands for q, s in ((lo, "lo"), (hi, "hi"))])
    out = wide.crossJoin(F.broadcast(limits))
    out = out.withColumn("alpha", F.when(F.greatest(*[F.col(b).isNull().cast("int") for b in bands]) == 1, 0).otherwise(1))
    return out.withColumns({c: F.expr(stretch(b)) for c, b in zip(("r", "g", "b"), bands, strict=True)}).drop(*limits.columns)
