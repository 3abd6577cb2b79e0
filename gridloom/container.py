"""A container of layers and their cells with chained operations. Containers don't change: every operation returns a new one."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators import timedim
from .operators.runners import GroupRunner, Runner
from .sources import rasters
from .sources.geotiff import Grid

LAYER = "grp string, path string, band int, start_date date, end_date date, temporal boolean"
CELLS = ["px", "row", "col", "grp", "start_date", "end_date", "value"]


@dataclass(frozen=True)
class Naming:
    """How dates stand in names: style (interval, start_date or end_date), format, and whether leap days are passed over."""

    style: str = "interval"
    fmt: str = "%Y%m%d"
    ignore_29feb: bool = True


@dataclass(frozen=True)
class Cube:
    layers: DataFrame
    cells: DataFrame | None = None
    grid: Grid | None = None
    naming: Naming = Naming()

    @classmethod
    def of(cls, spark: SparkSession, files: str | list | dict[str, str | list]) -> Cube:
        """From a path, a list, or lists by group; entries are paths, (path, band) or (path, band, start, end).

        A group is temporal if a path holds {dt} or all its entries have a start.
        """
        groups = files if isinstance(files, dict) else {"default": files}
        rows = []
        for grp, given in groups.items():
            entries = [e if isinstance(e, tuple) else (e,) for e in (given if isinstance(given, list) else [given])]
            if any(len(e) not in (1, 2, 4) for e in entries):
                raise ValueError("an entry is a path, (path, band) or (path, band, start, end)")
            full = [(*e, 1, None, None)[:4] if len(e) == 1 else (*e, None, None)[:4] for e in entries]
            dated = all(e[2] is not None for e in full)
            rows += [(grp, p, int(b), _date(s), _date(t), dated or "{dt}" in p) for p, b, s, t in full]
        return cls(C.with_name(spark.createDataFrame(rows, LAYER)))

    @classmethod
    def of_cells(cls, cells: DataFrame, grid: Grid | None = None) -> Cube:
        """From a cube in long form; the catalog has its groups and dates."""
        return cls(_catalog_of(cells, Naming(), "{gr}_{dt}"), cells, grid)

    def groups(self) -> list[str]:
        """Names of the groups, sorted; a catalog is small."""
        return sorted(r.grp for r in self.layers.select("grp").distinct().collect())

    def timespan(self, start: str, end: str, unit: str, step: int | str | list[int], style: str = "interval", fmt: str = "%Y%m%d", ignore_29feb: bool = True, group: str | list[str] = ()) -> Cube:
        """Every path with {dt} once for each interval of a calendar; other layers, and groups not asked for, stay."""
        asked = [group] if isinstance(group, str) else list(group)
        spans = timedim.date_range(start, end, unit, step, ignore_29feb=ignore_29feb, fmt=fmt)
        mine = self.layers.where(F.col("grp").isin(asked)) if asked else self.layers
        made = C.timespan(mine.drop("start_date", "end_date", "temporal", "name"), spans, fmt, ignore_29feb, style)
        if asked:
            made = made.unionByName(self.layers.where(~F.col("grp").isin(asked)))
        return replace(self, layers=made, naming=Naming(style, fmt, ignore_29feb))

    def read(self, window: tuple[int, int, int, int] | None = None, bounds: tuple[float, float, float, float] | None = None, overview: int | None = None, mask: DataFrame | None = None, on_error: str = "raise") -> Cube:
        """The layers' cells (see rasters.read_layers), lazily; the grid is that of the catalog's last path."""
        last = self.layers.agg(F.max("path")).first()[0]
        g = rasters.grids(self.layers.sparkSession, [last]).first() if last and on_error == "raise" else None
        grid = g and Grid(g.gt0, g.gt1, g.gt3, g.gt5, g.width, g.height, g.epsg, g.nodata)
        return replace(self, cells=rasters.read_layers(self.layers, window, bounds, overview, mask, on_error).select(*CELLS), grid=grid)

    def run(self, process: Runner | GroupRunner, group: str | list[str] = (), outname: str = "{nm}_{gr}_{dt}", drop_input: bool = False) -> Cube:
        """Adds an operator's layers. A group runner takes the groups asked for (all if none) whose temporal flag is its own; drop_input removes these."""
        name = type(process).__name__.lower()
        if isinstance(process, GroupRunner):
            asked = [group] if isinstance(group, str) else list(group)
            fit = C.eligible(self.layers, process.temporal)
            fit = fit.where(F.col("grp").isin(asked)) if asked else fit
            taken = [r.grp for r in fit.select("grp").distinct().collect()]
            cells = self.cells.where(F.col("grp").isin(taken))
            got = process.apply(cells.select("px", "grp", "start_date", "end_date", "value")) if taken else None
        else:
            taken, got = self.groups(), process.run(self)
        kept = self.drop(taken) if drop_input else self
        if got is None:
            return kept
        cells = got if "row" not in self.cells.columns else got.join(self.cells.select("px", "row", "col").distinct(), "px")
        cells = cells.select(*[c for c in CELLS if c in self.cells.columns])
        layers = _catalog_of(got, self.naming, outname, name)
        return replace(kept, layers=kept.layers.unionByName(layers, allowMissingColumns=True), cells=kept.cells.unionByName(cells))

    def _where(self, layers: DataFrame) -> Cube:
        """With some of the layers, and their cells."""
        if self.cells is None:
            return replace(self, layers=layers)
        keys = layers.select("grp", F.col("start_date").alias("_s"), F.col("end_date").alias("_e")).distinct()
        same = (F.col("c.grp") == F.col("k.grp")) & F.col("start_date").eqNullSafe(F.col("_s")) & F.col("end_date").eqNullSafe(F.col("_e"))
        return replace(self, layers=layers, cells=self.cells.alias("c").join(keys.alias("k"), same, "left_semi"))

    def filter(self, expr: str) -> Cube:
        return self._where(C.filter_expr(self.layers, expr))

    def filter_contains(self, pattern: str) -> Cube:
        return self._where(C.filter_contains(self.layers, pattern))

    def filter_date(self, start: date, end: date | None = None, overlap: bool = False) -> Cube:
        return self._where(C.filter_date(self.layers, start, end, overlap))

    def drop(self, groups: str | list[str]) -> Cube:
        names = [groups] if isinstance(groups, str) else groups
        return replace(self, layers=C.drop_groups(self.layers, names), cells=None if self.cells is None else C.drop_groups(self.cells, names))

    def rename(self, names: dict[str, str]) -> Cube:
        return replace(self, layers=C.rename_groups(self.layers, names), cells=None if self.cells is None else C.rename_groups(self.cells, names))

    def densify(self) -> Cube:
        """A row for every missing cell of a layer (see catalog.densify), as fillers ask for."""
        return replace(self, cells=C.densify(self.cells))

    def to_dir(self, folder: str, expr: str | None = None, dtype: str = "float32", on_file=None) -> DataFrame:  # noqa: ANN001
        """Writes the layers (of the groups that fulfil ``expr``) as {name}.tif and returns the files; nothing if none does."""
        layers = C.filter_expr(self.layers, expr) if expr else self.layers
        keys = layers.select("grp", F.col("start_date").alias("_s"), F.col("end_date").alias("_e"), "name")
        same = (F.col("c.grp") == F.col("k.grp")) & F.col("start_date").eqNullSafe(F.col("_s")) & F.col("end_date").eqNullSafe(F.col("_e"))
        cells = self.cells.alias("c").join(keys.alias("k"), same).select("name", "row", "col", "value")
        grid = self.grid or Grid(height=self.cells.agg(F.max("row")).first()[0] + 1, width=self.cells.agg(F.max("col")).first()[0] + 1)
        written = rasters.save_layers(cells, folder, grid, dtype, on_file=on_file)
        return written.sparkSession.createDataFrame(written.collect(), written.schema)  # a row for each file

    def point_query(self, points: DataFrame) -> DataFrame:
        """The series of all layers at points (pt_id, x, y) inside the grid: pt_id, grp, start_date, end_date, value."""
        g = self.grid
        at = points.select("pt_id", F.floor((F.col("y") - g.top) / g.dy).cast("long").alias("row"), F.floor((F.col("x") - g.left) / g.dx).cast("long").alias("col"))
        return at.join(self.cells, ["row", "col"]).select("pt_id", "grp", "start_date", "end_date", "value")


def _date(value: str | date | None) -> date | None:
    return datetime.strptime(value, "%Y-%m-%d").date() if isinstance(value, str) else value


def _catalog_of(cells: DataFrame, naming: Naming, template: str, nm: str = "") -> DataFrame:
    """Layers of cells: a row for each group and interval, named by a template of {nm}, {gr}, {dt}. Any group that contains "default" is named without its group."""
    keys = cells.select("grp", "start_date", "end_date").distinct()
    gr = F.when(F.contains(F.col("grp"), F.lit("default")), F.lit("")).otherwise(F.col("grp"))
    name = C.fill_template(F.lit(template), nm=F.lit(nm), gr=gr, dt=F.coalesce(C.date_text(naming.style, naming.fmt, naming.ignore_29feb), F.lit("")))
    return keys.select("grp", name.alias("path"), F.lit(1).alias("band"), "start_date", "end_date", F.col("start_date").isNotNull().alias("temporal"), name.alias("name"))
