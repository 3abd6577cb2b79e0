"""The layer catalog and cubes in long form: filters, naming, time expansion.

A cube has px, grp, start_date, end_date, value; a catalog has layer columns (grp,
path, band, start_date, end_date, temporal, name). Every function takes and returns
DataFrames lazily.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timedim import format_day


def filter_expr(df: DataFrame, expr: str) -> DataFrame:
    return df.where(F.expr(expr))


def filter_contains(df: DataFrame, pattern: str) -> DataFrame:
    """Layers whose name holds a match of the regular expression."""
    return df.where(F.col("name").rlike(pattern))


def filter_date(df: DataFrame, start: date, end: date | None = None, overlap: bool = False) -> DataFrame:
    """Layers within [start, end] (open end: from start on), or overlapping it. With a single ``date`` column only start counts."""
    if "start_date" not in df.columns:
        return df.where(F.col("date") >= F.lit(start))
    if end is None:
        return df.where(F.col("end_date" if overlap else "start_date") >= F.lit(start))
    if overlap:
        return df.where((F.col("end_date") >= F.lit(start)) & (F.col("start_date") <= F.lit(end)))
    return df.where((F.col("start_date") >= F.lit(start)) & (F.col("end_date") <= F.lit(end)))


def active_group(df: DataFrame, grp: str) -> DataFrame:
    return df.where(F.col("grp") == grp)


def eligible(df: DataFrame, temporal: bool) -> DataFrame:
    return df.where(F.col("temporal") == temporal)


def drop_groups(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.where(~F.col("grp").isin(groups))


def rename_groups(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Exact replacement in grp and, if there, name."""
    for c in ("grp", "name"):
        if c in df.columns:
            df = df.replace(names, subset=[c])
    return df


def timespan(templates: DataFrame, spans: list[tuple[date, date]], fmt: str = "%Y%m%d", ignore_29feb: bool = True, style: str = "interval") -> DataFrame:
    """Every path with {dt} once for each interval, {dt} filled by style: start_end (interval), start_date or end_date; static ones stay, without dates."""
    spark = templates.sparkSession
    rows = []
    for a, b in spans:
        texts = {"start_date": format_day(a, fmt, ignore_29feb), "end_date": format_day(b, fmt, ignore_29feb)}
        rows.append((a, b, texts.get(style, "_".join(texts.values()))))
    days = spark.createDataFrame(rows, "start_date date, end_date date, dt string")
    moving = templates.where("contains(path, '{dt}')").crossJoin(F.broadcast(days)).withColumn("path", F.replace("path", F.lit("{dt}"), F.col("dt"))).withColumn("temporal", F.lit(True)).drop("dt")
    still = templates.where("NOT contains(path, '{dt}')").select("*", F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(False).alias("temporal"))
    return with_name(moving.unionByName(still))


#: Directives of date formats and what Spark calls them.
DATE_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%j": "DDD", "%y": "yy", "%%": "%"}


def date_text(style: str, fmt: str, ignore_29feb: bool = True) -> Column:
    """start_date and end_date as text, by style (see timespan); with %j and ignore_29feb, days after February of a leap year count as in a common year."""
    parts = re.findall(r"%.|[^%]+", fmt)
    if unknown := [p for p in parts if p.startswith("%") and p not in DATE_PARTS]:
        raise ValueError(f"unknown directives: {unknown}")
    pattern = "".join(DATE_PARTS.get(p) or "'" + p.replace("'", "''") + "'" for p in parts)

    def text(c: str) -> Column:
        day = F.col(c)
        if ignore_29feb and "%j" in fmt:
            leap = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366
            day = F.when(leap & (F.month(day) > 2), F.date_sub(day, 1)).otherwise(day)
        return F.date_format(day, pattern)

    return text(style) if style in ("start_date", "end_date") else F.concat_ws("_", text("start_date"), text("end_date"))


def with_name(df: DataFrame) -> DataFrame:
    """name: the path's last part without query string and extension."""
    base = F.substring_index(F.substring_index("path", "?", 1), "/", -1)
    return df.withColumn("name", F.regexp_replace(base, r"\.[^.]*$", ""))


def fill_template(template: Column, **parts: Column) -> Column:
    """Replaces {key} by the parts, as text only."""
    for key, value in parts.items():
        template = F.replace(template, F.lit("{" + key + "}"), value)
    return template


def update_by_separator(col: Column, sep: str, position: int, value: str) -> Column:
    """Replaces the token at ``position`` (from 0), or appends behind the last."""
    parts = F.split(col, re.escape(sep))
    return F.when(F.size(parts) > position, F.array_join(F.transform(parts, lambda x, i: F.when(i == position, F.lit(value)).otherwise(x)), sep)).otherwise(F.concat(col, F.lit(sep + value)))


def pick_tokens(col: Column, sep: str, positions: list[int]) -> Column:
    parts = F.split(col, re.escape(sep))
    return F.concat_ws(sep, *[F.get(parts, F.lit(p)) for p in positions])


def rename_layers(col: Column, rules: dict[str, str]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, to in rules.items():
        col = F.regexp_replace(col, pattern, to)
    return col


def select_features(df: DataFrame, names: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Feature columns by name (in the table's order) or by prefix (in the prefixes' order)."""
    cols = [c for c in df.columns if c in names] if names else [c for p in prefixes or [] for c in df.columns if c.startswith(p)]
    if not cols:
        raise ValueError("no feature columns found")
    return df.select(*cols)


def require_features(df: DataFrame, names: list[str], allow_more: bool = False) -> DataFrame:
    """Columns in the model's order; missing ones raise, and others too unless allowed."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing features: {missing}")
    if not allow_more and (more := [c for c in df.columns if c not in names]):
        raise ValueError(f"unknown features: {more}")
    return df.select(*names)


def min_samples(df: DataFrame, target: str, share: float) -> DataFrame:
    """Rows of classes with at least a share of all rows that have a class."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    keep = counts.crossJoin(F.broadcast(total)).where(F.col("_n") >= share * F.col("_t")).select(target)
    return df.join(keep, target, "left_semi")


def densify(cube: DataFrame) -> DataFrame:
    """A row, with a null value, for every missing (px, layer) of each group."""
    px = cube.select("grp", "px").distinct()
    layers = cube.select("grp", "start_date", "end_date").distinct()
    return px.join(layers, "grp").join(cube, ["grp", "px", "start_date", "end_date"], "left")


def href_merge(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Assets (href, band, date) with the files made of them (href, path) as layers of their band with one date; assets without a file go. Of repeated hrefs one stays."""
    both = assets.dropDuplicates(["href"]).join(files, "href")
    return with_name(both.select(F.col("band").alias("grp"), "path", F.lit(1).alias("band"), F.col("date").alias("start_date"), F.col("date").alias("end_date"), F.lit(True).alias("temporal")))


def calibration_subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def mask(cube: DataFrame, cells: DataFrame, keep: str = "mask <> 0") -> DataFrame:
    """Values of cells (px, mask) that don't fulfil ``keep`` become null."""
    return cube.join(cells.select("px", F.expr(keep).alias("_keep")), "px", "left").withColumn("value", F.when(F.col("_keep"), F.col("value"))).drop("_keep")
