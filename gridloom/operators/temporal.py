"""Per-pixel operators over time that are linear in the data: gap filling and smoothing.

A series becomes one row with an array of its values in order of time (one shuffle by
pixel); an Arrow function multiplies whole batches of series with one small matrix.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_series(cube: DataFrame) -> DataFrame:
    """px, grp, ts: array of (start_date, end_date, value) in order of time."""
    return cube.groupBy("px", "grp").agg(F.array_sort(F.collect_list(F.struct("start_date", "end_date", "value"))).alias("ts"))


def from_series(series: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """Back to long form: for every array a group with the suffix it is given (empty: none). Series are exploded once."""
    names = [F.concat_ws(".", "grp", *([F.lit(suffix)] if suffix else [])) for suffix in arrays.values()]
    rows = series.select("px", "grp", F.explode_outer(F.arrays_zip("ts", *[F.col(c).alias(f"v{i}") for i, c in enumerate(arrays)])).alias("x"))
    if len(arrays) == 1:
        return rows.select("px", names[0].alias("grp"), "x.ts.start_date", "x.ts.end_date", F.col("x.v0").alias("value"))
    each = F.array(*[F.struct(n.alias("grp"), F.col(f"x.v{i}").alias("value")) for i, n in enumerate(names)])
    return rows.select("px", "x.ts.start_date", "x.ts.end_date", F.explode_outer(each).alias("y")).select("px", "y.grp", "start_date", "end_date", "y.value")


def matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A batch of equally long arrays as a matrix with NaN for nulls; for ragged batches shorter rows are padded. Also the lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(column), width), sizes
    out = np.full((len(column), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def lists(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of a matrix, cut to their lengths, as arrays with nulls for NaN."""
    flat = rows.reshape(-1) if (sizes == rows.shape[1]).all() else rows[np.arange(rows.shape[1]) < sizes[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, mask=np.isnan(flat)))


def seasonal_weights(n: int, season: int, att_seas: float = 60.0, att_env: float = 20.0) -> np.ndarray:
    """Weight by distance in time: a seasonal triangle and an envelope, both in decibels."""
    half = season / 2
    slope = att_seas / 10 / half
    k = np.arange(season)
    b = np.where(k <= half, -slope * k, slope * (k - half) - att_seas / 10)
    i = np.arange(n)
    return 10 ** (b[i % season] - att_env / 10 / n * i)


def convolution_matrix(n: int, season: int, att_seas: float, att_env: float, past: list[float] | None = None, future: list[float] | None = None) -> tuple[np.ndarray, float]:
    w = seasonal_weights(n, season, att_seas, att_env)
    back, ahead = (np.asarray(v, float)[:n] if v else w for v in (past, future))
    i, j = np.indices((n, n))
    both = np.concatenate([back, ahead])
    return np.where(i >= j, back[np.abs(i - j)], ahead[np.abs(i - j)]), float(both[both > 0].min())


@functools.lru_cache(maxsize=64)
def _convolution(n: int, season: int, att_seas: float, att_env: float, past: tuple[float, ...] | None, future: tuple[float, ...] | None) -> tuple[np.ndarray, float, float]:
    """The transposed matrix, the least positive weight, and the most weight that quality is measured by."""
    m, least = convolution_matrix(n, season, att_seas, att_env, past, future)
    return np.ascontiguousarray(m.T), least, float(m[:, 1:].sum(axis=1).max() if n > 1 else m.max())


def seasconv_series(series: DataFrame, season: int, att_seas: float = 60.0, att_env: float = 20.0, past: list[float] | None = None, future: list[float] | None = None, source: str = "ts.value", parts: tuple[str, ...] = ("filled",)) -> DataFrame:
    """Adds to series (see to_series) the arrays asked for: ``filled`` and ``qa``, in one pass (see seasconv_fill)."""
    back, ahead = (tuple(v) if v else None for v in (past, future))

    def run(x: np.ndarray, m: np.ndarray, least: float, norm: float) -> dict[str, np.ndarray]:
        seen = ~np.isnan(x)
        weight = seen.astype(float) @ m
        enough, out = weight >= least, {}
        if "filled" in parts:
            with np.errstate(invalid="ignore", divide="ignore"):
                out["filled"] = np.where(seen, x, np.where(enough, (np.where(seen, x, 0.0) @ m) / weight, np.nan))
        if "qa" in parts:
            out["qa"] = np.where(seen, 100.0, np.where(enough & (weight > 0), 100 * weight / norm, np.nan))
        return out

    def arrays(column: pa.Array) -> list[pa.Array]:
        x, sizes = matrix(column)
        out = {p: np.full_like(x, np.nan) for p in parts}
        for n in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == n)
            whole = len(rows) == len(x)
            got = run(x if whole else x[rows, :n], *_convolution(n, season, att_seas, att_env, back, ahead))
            for p in parts:
                if whole:
                    out[p] = got[p]
                else:
                    out[p][rows, :n] = got[p]
        return [lists(out[p], sizes) for p in parts]

    if len(parts) == 1:

        @F.arrow_udf("array<double>")
        def fill(v: pa.Array) -> pa.Array:
            return arrays(v)[0]

        return series.withColumn(parts[0], fill(F.col(source)))

    @F.arrow_udf(", ".join(f"{p} array<double>" for p in parts))
    def both(v: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(arrays(v), names=list(parts))

    return series.withColumn("both", both(F.col(source))).select(*series.columns, "both.*")


def seasconv_fill(cube: DataFrame, season: int, att_seas: float = 60.0, att_env: float = 20.0, past: list[float] | None = None, future: list[float] | None = None, return_qa: bool = False) -> DataFrame:
    """Fills gaps of a dense cube with weighted means of the pixel's other dates; observed cells stay. Groups end in .seasconv (.seasconv.qa).

    QA is 100 where observed, 0 to 100 by the weight of what was there to fill from,
    null where nothing was.
    """
    suffixes = {"filled": "seasconv", "qa": "seasconv.qa"} if return_qa else {"filled": "seasconv"}
    return from_series(seasconv_series(to_series(cube), season, att_seas, att_env, past, future, parts=tuple(suffixes)), suffixes)


def seasconv_quality(cube: DataFrame, season: int, att_seas: float = 60.0, att_env: float = 20.0, past: list[float] | None = None, future: list[float] | None = None) -> DataFrame:
    """The quality layers of seasconv_fill alone."""
    return from_series(seasconv_series(to_series(cube), season, att_seas, att_env, past, future, parts=("qa",)), {"qa": "seasconv.qa"})


def whittaker_matrix(n: int, lmbd: float, d: int) -> np.ndarray:
    if n <= d:
        return np.eye(n)
    diff = np.diff(np.eye(n), d, axis=0)
    return np.linalg.inv(np.eye(n) + lmbd * diff.T @ diff)


@functools.lru_cache(maxsize=64)
def _hat(n: int, lmbd: float, d: int) -> np.ndarray:
    return np.ascontiguousarray(whittaker_matrix(n, lmbd, d).T)


def whittaker_series(series: DataFrame, lmbd: float = 1.0, d: int = 2, source: str = "ts.value") -> DataFrame:
    """Adds the array ``smooth`` to series (see whittaker)."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        x, sizes = matrix(v)
        for n in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero((sizes == n) & ~np.isnan(x[:, :n]).any(axis=1))
            x[rows, :n] = x[rows, :n] @ _hat(n, lmbd, d)
        return lists(x, sizes)

    return series.withColumn("smooth", run(F.col(source)))


def whittaker(cube: DataFrame, lmbd: float = 1.0, d: int = 2) -> DataFrame:
    """Whittaker smoothing; series with a gap stay as they are. Groups end in .whittaker."""
    return from_series(whittaker_series(to_series(cube), lmbd, d), {"smooth": "whittaker"})
