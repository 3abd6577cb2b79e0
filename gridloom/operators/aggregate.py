"""Aggregation of a cube over time windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import to_series

#: Cells that a task works on at once, and about the most rows of a batch that it returns.
CELLS = 1 << 17
#: More than all days of a calendar together; keeps pairs of days apart.
DAYS = 1 << 26

SIMPLE = {
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop,
    "min": F.min, "max": F.max, "median": F.median, "count": F.count,
}


def op_column(op: str, value: Column, single: bool = False) -> Column:
    """An aggregate by name: sum, mean, std, var (of populations), min, max, median, count, argmin, argmax, or p0 to p100.

    Percentiles interpolate; one of a single value is null but for p50, unless ``single``.
    """
    if op in SIMPLE:
        return SIMPLE[op](value)
    if op in ("argmin", "argmax"):
        return (F.min_by if op == "argmin" else F.max_by)(F.datediff("start_date", F.lit("1970-01-01")).cast("double"), value)
    if (q := percent_of(op)) is not None:
        exact = F.percentile(value, q / 100)
        return exact if single or q == 50 else F.when(F.count(value) > 1, exact)
    raise ValueError(f"unknown operation {op}")


def percent_of(op: str) -> int | None:
    m = re.fullmatch(r"p(\d{1,3})", op)
    return int(m[1]) if m and int(m[1]) <= 100 else None


def _kernel(op: str, single: bool) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function of rows sorted with NaN behind, rows in order of time, and the days of their cells."""

    def share(q: float, low: int):  # noqa: ANN202
        def run(ranked: np.ndarray, rows: np.ndarray, days: np.ndarray) -> np.ndarray:
            n = (~np.isnan(ranked)).sum(axis=1)
            at = (np.maximum(n, 1) - 1) * q
            a = np.floor(at).astype(int)
            i = np.arange(len(ranked))
            left, right = ranked[i, a], ranked[i, np.minimum(a + 1, np.maximum(n, 1) - 1)]
            return np.where(n >= low, left + (right - left) * (at - a), np.nan)

        return run

    def moments(ranked: np.ndarray, rows: np.ndarray, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = (~np.isnan(rows)).sum(axis=1)
        mean = np.where(n, np.nansum(rows, axis=1) / np.maximum(n, 1), np.nan)
        dev = np.nan_to_num(rows - mean[:, None])
        return n, mean, np.where(n, (dev * dev).sum(axis=1) / np.maximum(n, 1), np.nan)

    def extreme(best):  # noqa: ANN001, ANN202
        def run(ranked: np.ndarray, rows: np.ndarray, days: np.ndarray) -> np.ndarray:
            none = np.isnan(rows).all(axis=1)
            return np.where(none, np.nan, days[np.arange(len(rows)), best(np.where(none[:, None], 0, rows), axis=1)])

        return run

    simple = {
        "sum": lambda r, x, d: np.nansum(x, axis=1), "mean": lambda r, x, d: moments(r, x, d)[1], "var": lambda r, x, d: moments(r, x, d)[2], "std": lambda r, x, d: np.sqrt(moments(r, x, d)[2]),
        "min": lambda r, x, d: r[:, 0], "max": lambda r, x, d: r[np.arange(len(r)), np.maximum((~np.isnan(r)).sum(axis=1), 1) - 1], "count": lambda r, x, d: (~np.isnan(x)).sum(axis=1).astype(float),
        "median": share(0.5, 1), "argmin": extreme(np.nanargmin), "argmax": extreme(np.nanargmax),
    }
    if op in simple:
        return simple[op]
    if (q := percent_of(op)) is not None:
        return share(q / 100, 1 if single or q == 50 else 2)
    raise ValueError(f"unknown operation {op}")


def time_aggregate(cube: DataFrame, windows: DataFrame, ops: list[str], overlap: bool = False, single: bool = False) -> DataFrame:
    """px, grp (with window and operation appended), start_date, end_date, value for every window that has layers.

    Layers belong to a window that contains them (or overlaps them); windows of one
    win_id pool theirs. A pixel's series meets all windows in one place: cells are
    shuffled once, by pixel, whatever the number of windows and operations. A task takes
    CELLS at a time, so that its memory doesn't grow with the table. NaN counts as null.
    argmin and argmax give the day (since 1970) of the first such layer.
    """
    rows_of: dict[tuple, list[tuple[int, int]]] = {}
    names = [(o, _kernel(o, single)) for o in ops]
    for w in windows.collect():  # a calendar, small whatever the cube
        rows_of.setdefault((w.win_id, w.tm or "", w.out_start, w.out_end), []).append((_number(w.sel_start), _number(w.sel_end)))
    series = to_series(cube).select("px", "grp", F.transform("ts.start_date", F.unix_date).alias("a"), F.transform("ts.end_date", F.unix_date).alias("b"), F.col("ts.value").alias("v"))
    px = cube.schema["px"].dataType.simpleString()

    def tables(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, str, tuple[int, int], np.ndarray]]:
        """Of every window and operation the series that have layers in it, the suffix, first and last day, and values."""
        owner = np.repeat(np.arange(len(part)), np.diff(part.column(2).offsets.to_numpy()))
        a, b, v = (part.column(i).flatten().to_numpy(zero_copy_only=False).astype(float) for i in (2, 3, 4))
        code = pa.array(a * DAYS + b).dictionary_encode().indices.to_numpy()  # layers by their days, which are few
        cells = np.argsort(code, kind="stable")
        edges = np.flatnonzero(np.diff(code[cells], prepend=-1, append=-1))
        starts, ends = a[cells[edges[:-1]]], b[cells[edges[:-1]]]
        for (_, tm, out_start, out_end), sel in rows_of.items():
            inside = np.zeros(len(starts), bool)
            for lo, hi in sel:
                inside |= (ends >= lo) & (starts <= hi) if overlap else (starts >= lo) & (ends <= hi)
            if not inside.any():
                continue
            at = np.sort(np.concatenate([cells[edges[i] : edges[i + 1]] for i in np.flatnonzero(inside)]))  # by series and time
            new = np.diff(owner[at], prepend=-1) != 0
            first, row = np.flatnonzero(new), np.cumsum(new) - 1
            col = np.arange(len(at)) - first[row]
            rows = np.full((len(first), col.max() + 1), np.nan)
            rows[row, col] = v[at]
            days = np.zeros(rows.shape)
            days[row, col] = a[at]
            ranked = np.sort(rows, axis=1)
            for op, kernel in names:
                with np.errstate(invalid="ignore"):
                    yield owner[at[first]], f".{tm}.{op}" if tm else f".{op}", (_number(out_start), _number(out_end)), kernel(ranked, rows, days)

    def packed(part: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
        own, suffixes, spans, values = zip(*made, strict=True)
        sizes, at, value = [len(x) for x in own], pa.array(np.concatenate(own)), np.concatenate(values)
        suffix = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(suffixes, pa.string())).cast(pa.string())
        days = [pa.array(np.repeat([x[i] for x in spans], sizes).astype(np.int32)).cast(pa.date32()) for i in (0, 1)]
        return pa.record_batch([part.column(0).take(at), part.column(1).take(at), suffix, *days, pa.array(value, mask=np.isnan(value))], names=["px", "grp", "suffix", "start_date", "end_date", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                made, n = [], 0
                for table in tables(part):
                    made.append(table)
                    n += len(table[0])
                    if n >= CELLS:
                        yield packed(part, made)
                        made, n = [], 0
                if made:
                    yield packed(part, made)

    out = series.mapInArrow(run, f"px {px}, grp string, suffix string, start_date date, end_date date, value double")
    return out.select("px", F.concat("grp", "suffix").alias("grp"), "start_date", "end_date", "value")


def _number(day) -> int:  # noqa: ANN001
    return day.toordinal() - 719163


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch of series in slices that have at most CELLS cells as a matrix, or one series."""
    first = widest = 0
    for i, n in enumerate(np.diff(batch.column(column).offsets.to_numpy()).tolist()):
        widest = max(widest, n)
        if i > first and (i + 1 - first) * widest > CELLS:
            yield batch.slice(first, i - first)
            first, widest = i, n
    if first < batch.num_rows:
        yield batch.slice(first)


def gap_counts(cube: DataFrame) -> DataFrame:
    """Per group: cells, gaps, series and the share of cells that are gaps (percent) of a dense cube, without series that have no value at all."""
    series = cube.groupBy("grp", "px").agg(F.count("*").alias("n"), F.count("value").alias("seen")).where("seen > 0")
    return series.groupBy("grp").agg(F.sum("n").alias("cells"), F.sum(F.col("n") - F.col("seen")).alias("gaps"), F.count("*").alias("series"))


def filled(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per group of a dense cube and what a filler made of it (groups with a suffix): gaps before, gaps after, percent filled (null without gaps)."""
    a = gap_counts(before).select("grp", F.col("gaps").alias("gaps_before"))
    b = gap_counts(after).select(F.regexp_replace("grp", r"\.[^.]*$", "").alias("grp"), F.col("gaps").alias("gaps_after"))
    out = a.join(b, "grp", "left").fillna(0, ["gaps_after"])
    return out.withColumn("percent", F.try_divide((F.col("gaps_before") - F.col("gaps_after")) * 100.0, F.col("gaps_before")))
