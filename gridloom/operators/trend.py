"""Trend analysis: seasonal-trend decomposition by loess (Cleveland et al. 1990) and regression on the trend."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import from_series, lists, matrix, to_series


@functools.lru_cache(maxsize=256)
def _weights(n: int, q: int, first: int, count: int) -> tuple[np.ndarray, ...]:
    """Tricube weights (points x places) of the q points nearest to each of ``count`` places from ``first`` on; these times the distance, and its square."""
    x, w, far = np.arange(n, dtype=float), np.zeros((n, count)), np.zeros((n, count))
    for k in range(count):
        p = first + k
        dist = np.abs(x - p)
        near = np.argsort(dist, kind="stable")[: min(q, n)]
        h = dist[near].max() + max(0, q - n) / 2
        w[near, k] = np.where(dist[near] <= 0.001 * h, 1.0, np.where(dist[near] >= 0.999 * h, 0.0, (1 - (dist[near] / max(h, 1e-12)) ** 3) ** 3))
        far[:, k] = x - p
    return w, w * far, w * far * far


def loess(y: np.ndarray, q: int, robust: np.ndarray | None = None, first: int = 0, count: int | None = None) -> np.ndarray:
    """Local linear smoothing of rows at ``count`` places from ``first`` on (default: all points), window of q points, tricube weights times ``robust``.

    The weights depend on the place alone, so that all sums are products of matrices.
    """
    n = y.shape[1]
    count = n if count is None else count
    w, wx, wxx = _weights(n, q, first, count)
    if robust is None:
        s0, s1, s2, t0, t1 = w.sum(axis=0), wx.sum(axis=0), wxx.sum(axis=0), y @ w, y @ wx
    else:
        ry = robust * y
        s0, s1, s2, t0, t1 = robust @ w, robust @ wx, robust @ wxx, ry @ w, ry @ wx
    safe = np.where(s0 > 0, s0, 1)
    xm, ym = s1 / safe, t0 / safe  # relative to the place
    sxx = np.maximum(s2 / safe - xm * xm, 0)
    flat = np.sqrt(sxx) <= 0.001 * (n - 1)
    slope = np.where(flat, 0, (t1 / safe - xm * ym) / np.where(flat, 1, sxx))
    own = np.clip(np.arange(first, first + count), 0, n - 1)
    return np.where(s0 > 0, ym - slope * xm, y[:, own])


def _average(x: np.ndarray, n: int) -> np.ndarray:
    c = np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1)
    return (c[:, n:] - c[:, :-n]) / n


def stl(y: np.ndarray, period: int, seasonal: int, trend: int, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part of every row; all rows at once."""
    low = period + 1 + period % 2
    n, t, s, weight = y.shape[1], np.zeros_like(y), np.zeros_like(y), None
    for _ in range(15 if robust else 1):
        for _ in range(2 if robust else 5):
            c = np.zeros((len(y), n + 2 * period))
            for k in range(period):
                own = np.arange(k, n, period)
                c[:, k : k + period * (len(own) + 2) : period] = loess((y - t)[:, own], seasonal, None if weight is None else weight[:, own], -1, len(own) + 2)
            smooth = loess(_average(_average(_average(c, period), period), 3), low)
            s = c[:, period : period + n] - smooth
            t = loess(y - s, trend, weight)
        if not robust:
            break
        r = np.abs(y - t - s)
        h = 6 * np.median(r, axis=1, keepdims=True)
        h = np.maximum(h, 1e-9 * np.abs(y).max(axis=1, keepdims=True) * 1e3)  # residuals of rounding alone are no outliers
        u = r / np.where(h > 0, h, 1)
        weight = np.where(r <= 0.001 * h, 1.0, np.where(r > 0.999 * h, 0.0, (1 - u**2) ** 2))
    return t, s


def p_value(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t by the closed form for whole degrees of freedom."""
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    sin, cos2 = F.sin(theta), F.pow(F.cos(theta), 2)

    def series(first: int) -> Column:
        steps = F.when(dof - 2 >= first, F.sequence(F.lit(first), (dof - 2).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))
        acc = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        return F.aggregate(steps, acc, lambda a, m: F.struct((a["term"] * (m - 1) / m * cos2).alias("term"), (a["sum"] + a["term"] * (m - 1) / m * cos2).alias("sum")), lambda a: a["sum"])

    even = sin * series(2)
    odd = F.when(dof == 1, 2 * theta / math.pi).otherwise(2 / math.pi * (theta + sin * F.cos(theta) * series(3)))
    return F.lit(1.0) - F.when(dof % 2 == 0, even).otherwise(odd)


def ols(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key: intercept (alpha) and slope (beta), each as value, standard error, t and p, r2 and n of a line y over x."""
    c = rows.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_avgx(y, x).alias("mx"))
    c = c.withColumn("s2", F.when(F.col("n") > 2, F.greatest((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2), F.lit(0.0))))
    c = c.withColumn("sb", F.sqrt(F.try_divide("s2", "sxx"))).withColumn("sa", F.sqrt(F.col("s2") * (1 / F.col("n") + F.try_divide(F.col("mx") ** 2, F.col("sxx")))))
    c = c.withColumn("ta", F.when(F.col("sa") > 0, F.col("a") / F.col("sa"))).withColumn("tb", F.when(F.col("sb") > 0, F.col("b") / F.col("sb")))
    dof = (F.col("n") - 2).cast("int")
    return c.select(*keys, F.col("n"), F.col("a").alias("alpha_m"), F.col("sa").alias("alpha_sd"), F.col("ta").alias("alpha_tv"), p_value(F.col("ta"), dof).alias("alpha_pv"), F.col("b").alias("beta_m"), F.col("sb").alias("beta_sd"), F.col("tb").alias("beta_tv"), p_value(F.col("tb"), dof).alias("beta_pv"), F.col("r2").alias("r2_m"))


def decompose(cube: DataFrame, season: int, seasonal: int | None = None, trend: int | None = None, log_rescale: tuple[float, float] | None = None) -> DataFrame:
    """Trend layers ({grp}.trend.m); null for series with a gap or without variation. log_rescale clips them to its range."""
    ns, nt = seasonal or season + 1, trend or 2 * season + 1

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        x, sizes = matrix(v)
        out = np.full_like(x, np.nan)
        for n in np.unique(sizes[sizes >= 2 * season]):
            rows = (sizes == n) & ~np.isnan(x[:, :n]).any(axis=1)
            rows[rows] = x[np.ix_(rows, np.arange(n))].std(axis=1) > 0
            if rows.any():
                t = stl(x[np.ix_(rows, np.arange(n))], season, ns, nt)[0]
                out[np.ix_(rows, np.arange(n))] = np.clip(t, *log_rescale) if log_rescale else t
        return lists(out, sizes)

    return from_series(to_series(cube).withColumn("trend", run(F.col("ts.value"))), {"trend": "trend.m"})


def trend_analysis(cube: DataFrame, season: int, seasonal: int | None = None, trend: int | None = None, log_rescale: tuple[float, float] | None = None, scale_factor: float = 10000.0) -> DataFrame:
    """Trend layers and nine scalar layers per pixel (alpha and beta as m, sd, tv, pv; r2.m) in long form.

    Scalars are scaled by ``scale_factor``, r2 by 100; their dates span the cube.
    """
    layers = decompose(cube, season, seasonal, trend, log_rescale)
    series = layers.where("value IS NOT NULL").groupBy("px", "grp").agg(F.array_sort(F.collect_list(F.struct("start_date", "value"))).alias("ts"))
    points = series.select("px", F.regexp_replace("grp", r"\.trend\.m$", "").alias("base"), F.size("ts").alias("T"), F.posexplode_outer("ts").alias("i", "p"))
    y = F.col("p.value") if not log_rescale else F.log1p(F.col("p.value") / log_rescale[1])
    lines = ols(points.select("px", "base", (F.col("i") / F.col("T")).alias("x"), y.alias("y")), ["px", "base"], "x", "y")
    names = [f"{k}_{s}" for k in ("alpha", "beta") for s in ("m", "sd", "tv", "pv")]
    wide = lines.select("px", "base", *[(F.col(c) * scale_factor).alias(c) for c in names], (F.col("r2_m") * 100).alias("r2_m"))
    span = cube.agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
    scalars = wide.unpivot(["px", "base"], [*names, "r2_m"], "k", "value").crossJoin(F.broadcast(span))
    return layers.unionByName(scalars.select("px", F.concat_ws(".", "base", F.replace("k", F.lit("_"), F.lit("."))).alias("grp"), "start_date", "end_date", "value"))
