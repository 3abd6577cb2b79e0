import math
import tracemalloc
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregate, bandmath, catalog, metrics, spatial, temporal, timedim, trend
from gridloom.sources import cube_io

SCHEMA = "px long, grp string, start_date date, end_date date, value double"


def cube(spark, rows):
    """rows: {px: values}, a month for each value."""
    days = [timedim.shift(date(2015, 1, 1), "months", i) for i in range(100)]
    return spark.createDataFrame([(p, "g", days[i], days[i + 1] - timedelta(days=1), v) for p, vs in rows.items() for i, v in enumerate(vs)], SCHEMA)


def values(df, grp):
    out = {}
    for r in df.where(F.col("grp") == grp).orderBy("px", "start_date").collect():
        out.setdefault(r.px, []).append(r.value)
    return out


def test_percentile_rule(spark):
    c = cube(spark, {1: [1.0, 2.0, 4.0, None], 2: [7.0, None], 3: [None, None]})
    got = aggregate.time_aggregate(c, timedim.windows_df(spark, date(2015, 1, 1), date(2015, 12, 31), "yearly"), ["p25", "p50", "p75", "sum", "std", "mean"])
    rows = {(r.px, r.grp.rsplit(".", 1)[1]): r.value for r in got.collect()}
    assert [rows[1, p] for p in ("p25", "p50", "p75")] == [1.5, 2.0, 3.0]
    assert [rows[2, p] for p in ("p25", "p50", "p75")] == [None, 7.0, None]
    assert rows[3, "p50"] is None and rows[3, "sum"] == 0.0
    assert rows[1, "std"] == pytest.approx(1.247219, abs=1e-6)
    assert {r.grp for r in got.collect()} == {f"g.yearly.{o}" for o in ("p25", "p50", "p75", "sum", "std", "mean")}


def test_windows_drop_straddling_layers(spark):
    spans = timedim.date_range("20141202", "20201201", "days", [109, 96, 80, 80])
    c = spark.createDataFrame([(1, "g", a, b, 1.0) for a, b in spans], SCHEMA)
    w = timedim.windows_df(spark, spans[0][0], spans[-1][1], "yearly")
    inside = {r.start_date.year: r.value for r in aggregate.time_aggregate(c, w, ["sum"]).collect()}
    over = {r.start_date.year: r.value for r in aggregate.time_aggregate(c, w, ["sum"], overlap=True).collect()}
    assert inside == {y: 3.0 for y in range(2015, 2021)}
    assert over == {2014: 1.0, **{y: 5.0 for y in range(2015, 2020)}, 2020: 4.0}


def test_seasonal_fill(spark):
    c = cube(spark, {1: [5.0, None, 5.0, 5.0, None, 5.0], 2: [None] * 6, 3: [1.0, 2.0, 3.0, 4.0, None, 6.0]})
    got = temporal.seasconv_fill(c, 3, return_qa=True)
    fill, qa = values(got, "g.seasconv"), values(got, "g.seasconv.qa")
    assert fill[1] == pytest.approx([5.0] * 6)
    assert fill[2] == qa[2] == [None] * 6
    m, _ = temporal.convolution_matrix(6, 3, 60, 20)
    seen = [0, 1, 2, 3, 5]
    assert fill[3][4] == pytest.approx(sum(m[4][j] * [1, 2, 3, 4, 0, 6][j] for j in seen) / sum(m[4][j] for j in seen))
    assert fill[3][:4] == [1.0, 2.0, 3.0, 4.0] and qa[3][0] == 100.0 and 0 < qa[3][4] < 100


def test_whittaker(spark):
    y = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0]
    c = cube(spark, {1: [float(i) for i in range(7)], 2: y, 3: [1.0, None, 2.0, 8.0, 3.0, 9.0, 4.0]})
    got = values(temporal.whittaker(c), "g.whittaker")
    assert got[1] == pytest.approx(list(range(7)))
    d = np.diff(np.eye(7), 2, axis=0)
    assert got[2] == pytest.approx(np.linalg.solve(np.eye(7) + d.T @ d, y).tolist())
    assert got[3] == [1.0, None, 2.0, 8.0, 3.0, 9.0, 4.0]


def test_trend(spark):
    line = [0.5 * i + [3, -1, -2, 0][i % 4] for i in range(24)]
    t, s = trend.stl(np.array([line]), 4, 5, 9)
    assert np.abs(t[0] - 0.5 * np.arange(24)).max() < 1e-6
    c = cube(spark, {1: line, 2: [4.0] * 24})
    got = {r.grp: r.value for r in trend.trend_analysis(c, 4).where("px = 1").collect()}
    assert got["g.beta.m"] == pytest.approx(0.5 * 24 * 10000, rel=1e-6)
    assert got["g.r2.m"] == pytest.approx(100.0)
    assert trend.trend_analysis(c, 4).where("px = 2 AND value IS NOT NULL").count() == 0


@pytest.mark.parametrize(("t", "dof", "p"), [(2.0, 26, 0.0560481875), (0.5, 25, 0.6214477852), (1.7, 3, 0.1876906416), (2.2, 22, 0.0386066452)])
def test_p_values(spark, t, dof, p):
    got = spark.range(1).select(trend.p_value(F.lit(t), F.lit(dof)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize(("expr", "want"), [
    ("where((a > 1) & (b < 2), log(a ** 2), arcsin(b))", math.log(9)), ("((a + b) * 2) ** 2", 49.0), ("a ** 2 ** 3", 6561.0), ("sqrt(abs(0 - a)) ** 2", 3.0), ("where(a > 0, a, b) ** 2", 9.0),
    ("a / (b - b)", None), ("a % 2", 1.0), ("-a ** 2", -9.0), ("where((a > 1) ^ (b > 1), 1, 2)", 1.0), ("where(~(a > 5), 1, 0)", 1.0), ("arctan2(b, a)", math.atan2(0.5, 3)), ("where(0 < b < 1, 7, 8)", 7.0), ("floor(a) | 4", 7.0),
])
def test_expressions(spark, expr, want):
    got = spark.createDataFrame([(3.0, 0.5)], "a double, b double").select(bandmath.to_column(expr).cast("double").alias("v")).first().v
    assert got == (want if want is None else pytest.approx(want))


def test_expressions_refuse_others():
    for bad in ("__import__('os')", "a.b()", "a if b else c", "[a]", "a << 2"):
        with pytest.raises((ValueError, SyntaxError)):
            bandmath.to_column(bad)


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0, 1.0), (2, 2.0, 2.0, 2.0)], "px long, v double, w double, x double")
    assert metrics.regression_metrics(df, "v", "x").first().r2 is None
    assert metrics.correction_factor(df, "x", ["v", "w"]).first().factor is None
    assert trend.ols(df.withColumn("x", F.lit(1.0)), ["w"], "x", "v").first().beta_m is None
    assert spatial.land_coverage(df.select(F.lit(99).alias("land"), F.col("v").alias("value"))).first().coverage is None
    assert {r.r for r in spatial.rgb(df, ("v", "w", "x")).collect()} == {0.0}


def test_regrid_takes_the_cell_at_the_centre(spark):
    cells = spark.createDataFrame([("v", r, c, float(10 * r + c)) for r in range(6) for c in range(6)], "layer string, row long, col long, value double")
    got = {(r.row, r.col): r.value for r in spatial.regrid(cells, 3.0).collect()}
    assert got == {(0, 0): 11.0, (0, 1): 14.0, (1, 0): 41.0, (1, 1): 44.0}
    finer = {(r.row, r.col): r.value for r in spatial.regrid(cells, 0.75).collect()}
    assert len(finer) == 64 and all(v == 10 * int((i + 0.5) * 0.75) + int((j + 0.5) * 0.75) for (i, j), v in finer.items())
    with pytest.raises(ValueError, match="overview"):
        spatial.overview(cells, 0)


def test_windows_of_cells():
    assert spatial.pixel_window((90.0, 440.0, 180.0, 500.0), 0.0, 530.0, 30.0) == (1, 2, 3, 5)


def test_ragged_series_in_windows(spark):
    rows = [(1, "g", date(2015, m, 1), date(2015, m, 27), float(m)) for m in (1, 2, 3)] + [(2, "g", date(2015, 5, 1), date(2015, 5, 27), 9.0), (2, "g", date(2016, 5, 1), date(2016, 5, 27), float("nan"))]
    got = aggregate.time_aggregate(spark.createDataFrame(rows, SCHEMA), timedim.windows_df(spark, date(2015, 1, 1), date(2016, 12, 31), "yearly"), ["mean", "count", "argmax"])
    have = {(r.px, r.start_date.year, r.grp.rsplit(".", 1)[1]): r.value for r in got.collect()}
    assert have[1, 2015, "mean"] == 2.0 and have[2, 2015, "mean"] == 9.0 and have[2, 2016, "count"] == 0.0 and have[2, 2016, "mean"] is None
    assert (1, 2016, "mean") not in have and have[1, 2015, "argmax"] == (date(2015, 3, 1) - date(1970, 1, 1)).days


def _task(spark, monkeypatch, kind, ops, overlap=False, pad=0):
    """What time_aggregate runs in a task, over batches of its own."""
    taken, empty = [], spark.createDataFrame([], SCHEMA)
    real = type(empty).mapInArrow
    monkeypatch.setattr(type(empty), "mapInArrow", lambda self, run, *args, **kw: taken.append(run) or real(self, run, *args, **kw))
    aggregate.time_aggregate(empty, timedim.windows_df(spark, date(1995, 1, 1), date(2001, 12, 31), kind, pad), ops, overlap)
    return taken[0]


def _ragged(n):
    """A batch of n series, each with about three quarters of 84 months, and its cells in monthly windows: none with a 29 February, by the calendar's rule."""
    r = np.random.default_rng(n)
    days = [timedim.shift(date(1995, 1, 1), "months", i).toordinal() - 719163 for i in range(85)]
    own = [np.flatnonzero(r.random(84) < 0.75) for _ in range(n)]
    lists = [[[days[m + i] - i for m in x] for x in own] for i in (0, 1)]
    v = [[None if r.random() < 0.1 else float(m % 7) for m in x] for x in own]
    return pa.record_batch([pa.array(range(n), pa.int64()), pa.array(["g"] * n), *[pa.array(x, pa.list_(pa.int32())) for x in lists], pa.array(v, pa.list_(pa.float64()))], names=["px", "grp", "a", "b", "v"]), sum((~np.isin(x, (13, 61))).sum() for x in own)


def test_time_aggregate_holds_a_bounded_part_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "CELLS", 4000, raising=False)
    run, peaks = _task(spark, monkeypatch, "monthly", ["mean", "max"]), []
    for n in (100, 400):
        batch, cells = _ragged(n)
        tracemalloc.start()
        assert sum(out.num_rows for out in run(iter([batch]))) == 2 * cells
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize(("kind", "ops", "pad"), [
    ("monthly", ["mean", "count"], 15),
    ("quarterly", ["mean", "min"], 0),
    ("bimonthly", ["p25", "p50", "p75"], 0),
    ("monthly_longterm", ["mean", "std"], 0),
    ("bimonthly_longterm", ["p50"], 0),
])
def test_windows_of_any_kind_hold_a_bounded_part_of_a_batch(spark, monkeypatch, kind, ops, pad):
    monkeypatch.setattr(aggregate, "CELLS", 4000, raising=False)
    run, peaks = _task(spark, monkeypatch, kind, ops, pad=pad), []
    for n in (100, 400):
        batch, _ = _ragged(n)
        tracemalloc.start()
        assert sum(out.num_rows for out in run(iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize("overlap", [False, True])
def test_time_aggregate_in_parts(spark, monkeypatch, overlap):
    ops = ["sum", "mean", "std", "min", "max", "count", "p25", "p50", "argmin", "argmax"]
    run, (batch, _) = _task(spark, monkeypatch, "bimonthly", ops, overlap), _ragged(40)
    whole = [r for out in run(iter([batch])) for r in out.to_pylist()]
    monkeypatch.setattr(aggregate, "CELLS", 300)
    parts = list(run(iter([batch.slice(0, 0), batch.slice(0, 17), batch.slice(17)])))
    key = lambda r: (r["px"], r["suffix"], r["start_date"])
    assert len(parts) > 10 and sorted((r for out in parts for r in out.to_pylist()), key=key) == sorted(whole, key=key)
    layers = list(zip(*[batch[c][5].as_py() for c in "abv"], strict=True))
    for start, end in {r["start_date"]: r["end_date"] for r in whole}.items():
        lo, hi = (d.toordinal() - 719163 for d in (start, end))
        mine = {a: v for a, b, v in layers if (b >= lo and a <= hi if overlap else a >= lo and b <= hi)}
        seen = {d: v for d, v in mine.items() if v is not None}
        got = {r["suffix"]: r["value"] for r in whole if r["px"] == 5 and r["start_date"] == start}
        assert bool(got) == bool(mine)
        if got:
            best = (max(seen, key=seen.get), min(seen, key=seen.get)) if seen else (None, None)
            assert (got[".argmax"], got[".argmin"], got[".count"], got[".sum"]) == (*best, len(seen), sum(seen.values()))


def test_tiles_blocks_and_polygons(spark):
    t = {r.tile_id: tuple(r)[1:] for r in spatial.tiles(spark, 2, 0, 0, 5, 3).collect()}
    assert len(t) == 6 and t[0] == (0, 0, 2, 2) and t[1] == (0, 2, 2, 3) and t[4] == (4, 0, 5, 2) and t[5] == (4, 2, 5, 3)
    pts = spark.createDataFrame([(0.0, 2.0), (2.0, 1.0), (1.0, 0.0), (1.0, 2.0)], "x double, y double")
    lit = [F.lit(float(v)) for v in (0, 0, 2, 2)]
    got = [r[0] for r in pts.select(spatial.in_block(F.col("x"), F.col("y"), *lit)).collect()]
    assert got == [True, False, False, True]


def test_fit_in_dtype(spark):
    df = spark.createDataFrame([(-3.0,), (2.5,), (3.5,), (300.0,), (255.0,), (None,)], "v double")
    assert [r[0] for r in df.select(cube_io.fit_in_dtype(F.col("v"), "uint8", 255)).collect()] == [0, 2, 4, 254, 254, 255]
    assert df.select(cube_io.fit_in_dtype(F.lit(0.0), "uint8", 0)).first()[0] == 1


def test_sample_groups(spark):
    df = spark.createDataFrame([(10.0, 10.0, "a"), (1500.0, 10.0, "a")], "x double, y double, g string")
    assert [r.cv_group for r in metrics.sample_groups(df, ["g"], 1000.0).collect()] == ["ax0y0", "ax1y0"]
    with pytest.raises(ValueError):
        metrics.sample_groups(df)


def test_cube_round_trip(spark, tmp_path):
    c = cube(spark, {1: [1.0, -9.0], 2: [3.0, 4.0]}).withColumns({"row": F.col("px"), "col": F.lit(0)})
    cube_io.write_cube(c, str(tmp_path / "c"), "grp = 'g'")
    got = cube_io.read_cube(spark, str(tmp_path / "c"), nodata=-9.0, window=(1, 1, 0, 0))
    assert sorted((r.px, r.value) for r in got.collect() if r.value is not None) == [(1, 1.0)]
    assert got.where("value IS NULL").count() == 1


def test_catalog_errors(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id long, b1 double, b2 double")
    assert catalog.select_features(df, prefixes=["b"]).columns == ["b1", "b2"]
    with pytest.raises(ValueError):
        catalog.select_features(df, names=["zz"])
    with pytest.raises(ValueError):
        catalog.require_features(df, ["b1", "nope"])
