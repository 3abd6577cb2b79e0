"""Operators as objects for a container's ``run``, and the points to subclass.

A runner takes a container and returns cells of new layers (px, grp, start_date,
end_date, value). A group runner is applied to the groups whose layers have dates (or
have none, by its ``temporal`` flag); since the group is a column, all groups run in
one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from . import aggregate, bandmath, temporal, timedim, trend

if TYPE_CHECKING:
    from ..container import Cube


class Runner:
    """Runs on a whole container."""

    def run(self, cube: Cube) -> DataFrame:
        raise NotImplementedError


class GroupRunner:
    """Runs on cells of groups; ``apply`` is the point to subclass."""

    temporal = True

    def apply(self, cells: DataFrame) -> DataFrame:
        raise NotImplementedError


class Transformer(GroupRunner):
    """As many layers out as in, of the group with a suffix: ``series`` gets series (px, grp, ts) and adds the array ``out``."""

    suffix = "out"

    def series(self, series: DataFrame) -> DataFrame:
        raise NotImplementedError

    def apply(self, cells: DataFrame) -> DataFrame:
        return temporal.from_series(self.series(temporal.to_series(cells)), {"out": self.suffix})


class Filler(Transformer):
    """A transformer that fills gaps; ``report`` counts them before and after."""

    def report(self, cells: DataFrame) -> DataFrame:
        return aggregate.filled(cells, self.apply(cells))


class Derivator(GroupRunner):
    """Any number of layers out: ``apply`` returns them."""


@dataclass
class SeasConvFill(Filler):
    season_size: int
    att_seas: float = 60.0
    att_env: float = 20.0
    conv_vect_future: list[float] = field(default_factory=list)
    conv_vect_past: list[float] = field(default_factory=list)
    return_qa: bool = False

    def apply(self, cells: DataFrame) -> DataFrame:
        return temporal.seasconv_fill(cells, self.season_size, self.att_seas, self.att_env, self.conv_vect_past or None, self.conv_vect_future or None, self.return_qa)

    def report(self, cells: DataFrame) -> DataFrame:
        return aggregate.filled(cells, temporal.seasconv_fill(cells, self.season_size, self.att_seas, self.att_env, self.conv_vect_past or None, self.conv_vect_future or None))


@dataclass
class WhittakerSmooth(Transformer):
    lmbd: float = 1.0
    d: int = 2
    suffix = "whittaker"

    def series(self, series: DataFrame) -> DataFrame:
        return temporal.whittaker_series(series, self.lmbd, self.d).withColumnRenamed("smooth", "out")


@dataclass
class TimeAggregate(Derivator):
    """``kinds`` of windows (see timedim.windows); a kind ending in ``_15p`` selects 15 days more at either end."""

    kinds: list[str]
    operations: list[str]
    start: object
    end: object
    overlap: bool = False

    def apply(self, cells: DataFrame) -> DataFrame:
        out = None
        for kind in self.kinds:
            pad = 15 if kind.endswith("_15p") else 0
            got = aggregate.time_aggregate(cells, timedim.windows_df(cells.sparkSession, self.start, self.end, kind.removesuffix("_15p"), pad), self.operations, self.overlap)
            out = got if out is None else out.unionByName(got)
        return out


@dataclass
class TrendAnalysis(Derivator):
    season_size: int
    season_smoother: int | None = None
    trend_smoother: int | None = None
    log_rescale: tuple[float, float] | None = None
    scale_factor: float = 10000.0

    def apply(self, cells: DataFrame) -> DataFrame:
        return trend.trend_analysis(cells, self.season_size, self.season_smoother, self.trend_smoother, self.log_rescale, self.scale_factor)


@dataclass
class Calc(Runner):
    expressions: dict[str, str]
    mask_group: str | None = None
    mask_values: list[float] | None = None

    def run(self, cube: Cube) -> DataFrame:
        groups = cube.groups()
        out = bandmath.calc(cube.cells, groups, self.expressions, self.mask_group, self.mask_values)
        return out.where(out.grp.isin([g for g in self.expressions if g not in groups]))


@dataclass
class Map(Runner):
    fn: Callable[[dict], dict]
    out: list[str]

    def run(self, cube: Cube) -> DataFrame:
        groups = cube.groups()
        got = bandmath.map_groups(cube.cells, groups, self.fn, self.out)
        return got.where(got.grp.isin([g for g in self.out if g not in groups]))
