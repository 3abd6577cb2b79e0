"""All queries of the grid engine by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import bandmath as BM
from ..operators import catalog as C
from ..container import Cube
from ..functions import rows
from ..operators import eo, mapper, search, temporal, timedim, trend
from ..operators import metrics as M
from ..operators import runners as R
from ..operators import spatial as S
from ..sources import cube_io, files, rasters
from ..sources.geotiff import Grid
from ..streaming import windows as ST
from . import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FIRST, LAST = date(1995, 1, 1), date(2001, 12, 31)
Y1, Y2 = date(1996, 1, 1), date(1997, 12, 31)


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols or ("value",)})


# --- time windows -------------------------------------------------------------------


def _windows_sql(kind: str, pad: int = 0) -> str:
    """The windows by rules of their own: whole months, of which a 29 February is cut off the end, but for long-term ones."""
    days = f"generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL %d MONTH) g(d)"
    if kind == "yearly":
        return f"(SELECT CAST(year(d) AS INT) AS win_id, 'yearly' AS tm, CAST(d AS DATE) AS sel_start, make_date(year(d), 12, 31) AS sel_end, CAST(d AS DATE) AS out_start, make_date(year(d), 12, 31) AS out_end FROM {days % 12}) w"
    months = {"monthly": 1, "bimonthly": 2, "quarterly": 3, "monthly_longterm": 1, "bimonthly_longterm": 2}[kind]
    spans = f"(SELECT CAST(d AS DATE) AS a, CAST(d + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE) AS e, (month(d) - 1) // {months} + 1 AS part FROM {days % months})"
    if kind.endswith("longterm"):
        return f"(SELECT part AS win_id, '{kind[0]}' || lpad(CAST(part AS VARCHAR), 2, '0') AS tm, a AS sel_start, e AS sel_end, DATE '{FIRST}' AS out_start, DATE '{LAST}' AS out_end FROM {spans}) w"
    cut = "CASE WHEN month(e) = 2 AND day(e) = 29 THEN e - 1 ELSE e END"
    return f"(SELECT row_number() OVER (ORDER BY a) AS win_id, '' AS tm, a - {pad} AS sel_start, {cut} + {pad} AS sel_end, a AS out_start, {cut} AS out_end FROM {spans}) w"


_OPS = {
    "p25": "CASE WHEN count(value) > 1 THEN quantile_cont(value, 0.25) END", "p50": "quantile_cont(value, 0.5)", "p75": "CASE WHEN count(value) > 1 THEN quantile_cont(value, 0.75) END",
    "std": "stddev_pop(value)", "var": "var_pop(value)", "mean": "avg(value)", "sum": "coalesce(sum(value), 0)", "min": "min(value)", "max": "max(value)", "median": "median(value)", "count": "CAST(count(value) AS DOUBLE)",
    "argmax": "CAST(arg_max(date_diff('day', DATE '1970-01-01', start_date), value ORDER BY start_date) AS DOUBLE)", "argmin": "CAST(arg_min(date_diff('day', DATE '1970-01-01', start_date), value ORDER BY start_date) AS DOUBLE)",
}


def _agg_sql(cube: str, kind: str, ops: list[str], overlap: bool = False, pad: int = 0) -> str:
    inside = "c.end_date >= w.sel_start AND c.start_date <= w.sel_end" if overlap else "c.start_date >= w.sel_start AND c.end_date <= w.sel_end"
    parts = " UNION ALL ".join(
        f"SELECT px, grp || CASE WHEN tm = '' THEN '' ELSE '.' || tm END || '.{op}' AS grp, out_start AS start_date, out_end AS end_date, round({_OPS[op]}, 6) AS value FROM j GROUP BY px, grp, win_id, tm, out_start, out_end" for op in ops
    )
    return f"WITH c AS ({cube}), j AS (SELECT c.*, w.* FROM c JOIN {_windows_sql(kind, pad)} ON {inside}) {parts}"


def _agg(name: str, cube: Callable, cube_sql: str, kind: str, ops: list[str], overlap: bool = False, pad: int = 0) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(A.time_aggregate(cube(spark, sf_dir), timedim.windows_df(spark, FIRST, LAST, kind, pad), ops, overlap))

    query(name, _agg_sql(cube_sql, kind, ops, overlap, pad))(run)


_agg("agg_yearly_p50_std", B.quarter_cube, B.QUARTER, "yearly", ["p50", "std"])
_agg("agg_monthly", B.month_cube, B.MONTH, "monthly", ["mean", "max"])
_agg("agg_monthly_15p", B.month_cube, B.MONTH, "monthly", ["mean", "count"], pad=15)
_agg("agg_bimonthly", B.month_cube, B.MONTH, "bimonthly", ["p25", "p50", "p75"])
_agg("agg_quarterly", B.month_cube, B.MONTH, "quarterly", ["mean", "min"])
_agg("agg_monthly_longterm", B.month_cube, B.MONTH, "monthly_longterm", ["mean", "std"])
_agg("agg_bimonthly_longterm", B.month_cube, B.MONTH, "bimonthly_longterm", ["p50"])
_agg("agg_overlap", B.quarter_cube, B.QUARTER, "bimonthly", ["mean", "count"], overlap=True)
_agg("agg_simple_ops", B.quarter_cube, B.QUARTER, "yearly", ["sum", "mean", "std", "var", "min", "max", "median", "argmax", "argmin"])


# --- per-pixel time series ------------------------------------------------------------

def _dense(cube: str) -> str:
    return f"""v AS ({cube}), l AS (SELECT DISTINCT grp, start_date FROM v), t AS (SELECT grp, start_date, row_number() OVER (PARTITION BY grp ORDER BY start_date) - 1 AS t, count(*) OVER (PARTITION BY grp) AS n FROM l),
d AS (SELECT p.px, t.grp, t.t, t.n, t.start_date, v.value FROM (SELECT DISTINCT px, grp FROM v) p JOIN t ON t.grp = p.grp LEFT JOIN v ON v.px = p.px AND v.grp = p.grp AND v.start_date = t.start_date)"""


_DENSE = _dense(B.DAY)


def _weight(season: float, n: str, k: str = "abs(a.t - b.t)") -> str:
    half = season / 2
    return f"pow(10, CASE WHEN {k} % {season} <= {half} THEN -(6 / {half}) * ({k} % {season}) ELSE (6 / {half}) * ({k} % {season} - {half}) - 6 END - 2.0 / {n} * {k})"


@query("seasconv_fill", f"""WITH {_DENSE},
f AS (SELECT a.px, a.grp, a.t, sum({_weight(7, 'a.n')} * b.value) / sum({_weight(7, 'a.n')}) AS fill FROM d a JOIN d b ON a.px = b.px AND a.grp = b.grp AND b.value IS NOT NULL GROUP BY 1, 2, 3)
SELECT d.px, d.grp || '.seasconv' AS grp, d.start_date, d.start_date AS end_date, round(coalesce(d.value, f.fill), 6) AS value FROM d LEFT JOIN f ON f.px = d.px AND f.grp = d.grp AND f.t = d.t""")  # fmt: skip
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.seasconv_fill(C.densify(B.day_cube(spark, sf_dir)), 7))


@query("seasconv_qa", f"""WITH {_DENSE},
w AS (SELECT a.px, a.grp, a.t, sum({_weight(7, 'a.n')}) AS s FROM d a JOIN d b ON a.px = b.px AND a.grp = b.grp AND b.value IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT grp, max(s) AS s FROM (SELECT a.grp, a.t, sum({_weight(7, 'a.n')}) AS s FROM t a JOIN t b ON a.grp = b.grp AND b.t >= 1 GROUP BY 1, 2) GROUP BY 1)
SELECT d.px, d.grp || '.seasconv.qa' AS grp, d.start_date, d.start_date AS end_date, round(CASE WHEN d.value IS NOT NULL THEN 100.0 ELSE 100 * w.s / m.s END, 6) AS value FROM d JOIN m USING (grp) LEFT JOIN w ON w.px = d.px AND w.grp = d.grp AND w.t = d.t""")  # fmt: skip
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.seasconv_quality(C.densify(B.day_cube(spark, sf_dir)), 7))


@query("gap_counts", f"""WITH c AS ({B.DAY}), p AS (SELECT grp, px, count(*) AS seen FROM c GROUP BY 1, 2), l AS (SELECT grp, count(DISTINCT start_date) AS n FROM c GROUP BY 1)
SELECT grp, CAST(sum(n) AS BIGINT) AS cells, CAST(sum(n - seen) AS BIGINT) AS gaps, count(*) AS series FROM p JOIN l USING (grp) GROUP BY grp""")  # fmt: skip
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gap_counts(C.densify(B.day_cube(spark, sf_dir)))


def _smooth_sql(source: str, keys: str) -> str:
    """CTEs s and z: series (keys, ys, n) of ``source`` (keys, t, value) smoothed by solving (I + D'D) z = y for second differences D.

    Steps z + (y - A z) / 9 come nearer by 8 / 9 each, as A has eigenvalues from 1 to 17.
    """
    bend = "list_transform(range(1, n - 1), lambda i: z[i] - 2 * z[i + 1] + z[i + 2])"
    back = "(CASE WHEN i <= n - 2 THEN e[i] ELSE 0 END - 2 * CASE WHEN i > 1 AND i <= n - 1 THEN e[i - 1] ELSE 0 END + CASE WHEN i > 2 THEN e[i - 2] ELSE 0 END)"
    return f"""s AS (SELECT {keys}, list(value ORDER BY t) AS ys, count(*) AS n FROM {source} GROUP BY {keys}),
    r AS (SELECT {keys}, ys, n, ys AS z, 0 AS k FROM s UNION ALL SELECT {keys}, ys, n, list_transform(range(1, n + 1), lambda i: z[i] + (ys[i] - z[i] - {back}) / 9), k + 1 FROM (SELECT *, {bend} AS e FROM r WHERE k < 270) u),
    z AS (SELECT {keys}, n, unnest(z) AS value, generate_subscripts(z, 1) - 1 AS t FROM r WHERE k = 270)"""


@query("whittaker", f"""WITH RECURSIVE c AS ({B.QUARTER}), d AS (SELECT *, row_number() OVER (PARTITION BY px ORDER BY start_date) - 1 AS t FROM c), {_smooth_sql('d', 'px')}
SELECT d.px, 'qty.whittaker' AS grp, d.start_date, d.end_date, round(z.value, 6) AS value FROM d JOIN z ON z.px = d.px AND z.t = d.t""")  # fmt: skip
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.whittaker(B.quarter_cube(spark, sf_dir)))


_OLS = """s AS (SELECT px, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx FROM p GROUP BY px),
e AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM s), f AS (SELECT *, sqrt(s2 / sxx) AS sb, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS sa FROM e)"""


@query("trend_ols", f"""WITH c AS ({B.QUARTER}), p AS (SELECT px, (row_number() OVER (PARTITION BY px ORDER BY start_date) - 1) / count(*) OVER (PARTITION BY px) AS x, value AS y FROM c), {_OLS}
SELECT px, n, round(a, 6) AS alpha_m, round(sa, 6) AS alpha_sd, round(a / sa, 6) AS alpha_tv, round(b, 6) AS beta_m, round(sb, 6) AS beta_sd, round(b / sb, 6) AS beta_tv, round(r2, 6) AS r2_m FROM f""")  # fmt: skip
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = temporal.to_series(B.quarter_cube(spark, sf_dir))
    rows = series.select("px", F.size("ts").alias("T"), F.posexplode_outer("ts").alias("i", "p")).select("px", (F.col("i") / F.col("T")).alias("x"), F.col("p.value").alias("y"))
    out = trend.ols(rows, ["px"], "x", "y").drop("alpha_pv", "beta_pv").withColumn("n", F.col("n").cast("long"))
    return rounded(out, *[c for c in out.columns if c not in ("px", "n")])


@query("trend_stl")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trend.trend_analysis(B.quarter_cube(spark, sf_dir), 4), digits=4)


# --- band math ------------------------------------------------------------------------

_WIDE = f"c AS ({B.MONTH}), p AS (SELECT px, start_date, end_date, max(value) FILTER (grp = 'A') AS a, max(value) FILTER (grp = 'N') AS n, max(value) FILTER (grp = 'R') AS r FROM c GROUP BY 1, 2, 3)"


def _long_sql(cols: dict[str, str], source: str = "p") -> str:
    return " UNION ALL ".join(f"SELECT px, '{g}' AS grp, start_date, end_date, round({e}, 6) AS value FROM {source}" for g, e in cols.items())


@query("calc_ndvi", f"WITH {_WIDE} " + _long_sql({"A": "a", "N": "n", "R": "r", "nd": "(n - a) / (n + a)"}))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(BM.calc(B.month_cube(spark, sf_dir), ["A", "N", "R"], {"nd": "(N - A) / (N + A)"}))


@query("calc_chain", f"WITH {_WIDE}, q AS (SELECT *, sqrt(pow(a, 2) + pow(r, 2)) AS m FROM p), z AS (SELECT *, CASE WHEN m > 40 AND n > 20 THEN ln(m) ELSE 0 - m END AS k FROM q) " + _long_sql({"A": "a", "N": "n", "R": "r", "m": "m", "k": "k"}, "z"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(BM.calc(B.month_cube(spark, sf_dir), ["A", "N", "R"], {"m": "sqrt(A ** 2 + R ** 2)", "k": "where((m > 40) & (N > 20), log(m), 0 - m)"}))


@query("calc_zero", f"WITH {_WIDE} " + _long_sql({"A": "a", "N": "n", "R": "r", "z": "CASE WHEN a - a <> 0 THEN (n - a) / (a - a) END", "q": "CASE WHEN floor(r / 30) <> 0 THEN n / floor(r / 30) END"}))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(BM.calc(B.month_cube(spark, sf_dir), ["A", "N", "R"], {"z": "(N - A) / (A - A)", "q": "N / floor(R / 30)"}))


@query("calc_nested", f"WITH {_WIDE} " + _long_sql({"A": "a", "N": "n", "R": "r", "p": "pow((a + n) * 2, 2)", "t": "pow(a / 25, pow(2, 3))", "u": "pow(sqrt(abs(a - n)), 2)", "w": "pow(CASE WHEN a > n THEN a ELSE r END, 2)", "x": "CASE WHEN (a > 25) <> (n > 25) THEN 1 WHEN a IS NULL OR n IS NULL THEN NULL ELSE -(a % 7) END"}))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    expressions = {"p": "((A + N) * 2) ** 2", "t": "(A / 25) ** 2 ** 3", "u": "sqrt(abs(A - N)) ** 2", "w": "where(A > N, A, R) ** 2", "x": "where(A + N > -1, where((A > 25) ^ (N > 25), 1, -(A % 7)), A + N)"}
    return rounded(BM.calc(B.month_cube(spark, sf_dir), ["A", "N", "R"], expressions))


@query("calc_mask", f"WITH {_WIDE}, h AS (SELECT *, coalesce(floor(r / 10) IN (2, 3), false) AS hid FROM p) " + _long_sql({"A": "CASE WHEN NOT hid THEN a END", "N": "CASE WHEN NOT hid THEN n END", "flag": "floor(r / 10)", "s": "CASE WHEN NOT hid THEN a + n END"}, "h"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = B.month_cube(spark, sf_dir).replace({"R": "flag"}, subset=["grp"]).withColumn("value", F.when(F.col("grp") == "flag", F.floor(F.col("value") / 10)).otherwise(F.col("value")))
    return rounded(BM.calc(cube, ["A", "N", "flag"], {"s": "A + N"}, "flag", [2.0, 3.0]))


@query("map_fn", f"WITH {_WIDE} " + _long_sql({"A": "a", "N": "n", "R": "r", "top": "CASE WHEN a IS NOT NULL AND n IS NOT NULL THEN greatest(a, n) END"}))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    out = BM.map_groups(B.month_cube(spark, sf_dir), ["A", "N", "R"], lambda g: {"top": np.maximum(g["A"], g["N"])}, ["top"])
    return rounded(out.withColumn("value", F.when(~F.isnan("value"), F.col("value"))))


# --- catalog --------------------------------------------------------------------------

_CAT = f"WITH c AS ({B.QUARTER_FLAG}), k AS (SELECT DISTINCT grp, 'x/' || grp || '_' || strftime(start_date, '%Y%m%d') || '.tif' AS path, start_date, end_date, grp || '_' || strftime(start_date, '%Y%m%d') AS name, true AS temporal FROM c) "


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = B.quarter_cube(spark, sf_dir, "l_returnflag").select("grp", "start_date", "end_date").distinct()
    return C.with_name(layers.select("grp", F.concat(F.lit("x/"), "grp", F.lit("_"), F.date_format("start_date", "yyyyMMdd"), F.lit(".tif")).alias("path"), "start_date", "end_date")).withColumn("temporal", F.lit(True))


_COLS = "SELECT grp, path, start_date, end_date, name, temporal FROM k WHERE "
query("filter_expr", _CAT + _COLS + "grp <> 'N' AND year(start_date) = 1997")(lambda s, d: C.filter_expr(_catalog(s, d), "grp <> 'N' AND year(start_date) = 1997"))
query("filter_contains", _CAT + _COLS + "regexp_matches(name, '^A_.*0[14]01$')")(lambda s, d: C.filter_contains(_catalog(s, d), "^A_.*0[14]01$"))
query("filter_date", _CAT + _COLS + "start_date >= DATE '1996-01-01' AND end_date <= DATE '1997-12-31'")(lambda s, d: C.filter_date(_catalog(s, d), Y1, Y2))
query("filter_date_overlap", _CAT + _COLS + "end_date >= DATE '1996-02-01' AND start_date <= DATE '1997-02-01'")(lambda s, d: C.filter_date(_catalog(s, d), date(1996, 2, 1), date(1997, 2, 1), True))
query("filter_date_open", _CAT + _COLS + "start_date >= DATE '2000-05-01'")(lambda s, d: C.filter_date(_catalog(s, d), date(2000, 5, 1)))
query("active_group", _CAT + _COLS + "grp = 'R' AND temporal")(lambda s, d: C.eligible(C.active_group(_catalog(s, d), "R"), True))
query("drop_group", _CAT + _COLS + "grp NOT IN ('A', 'R')")(lambda s, d: C.drop_groups(_catalog(s, d), ["A", "R"]))
query("rename_group", _CAT + "SELECT CASE grp WHEN 'A' THEN 'accepted' ELSE grp END AS grp, path, start_date, end_date, name, temporal FROM k")(lambda s, d: C.rename_groups(_catalog(s, d), {"A": "accepted"}))
query("union_distinct", _CAT + "SELECT DISTINCT grp, year(start_date) AS y FROM k")(lambda s, d: (lambda k: k.unionByName(k).select("grp", F.year("start_date").alias("y")).distinct())(_catalog(s, d)))


_SPANS = timedim.date_range("20141202", "20161201", "days", [109, 96, 80, 80])
#: The same, by hand.
_SPANS_SQL = ", ".join(f"(DATE '{y - 1}-12-02', DATE '{y}-03-20'), (DATE '{y}-03-21', DATE '{y}-06-24'), (DATE '{y}-06-25', DATE '{y}-09-12'), (DATE '{y}-09-13', DATE '{y}-12-01')" for y in (2015, 2016))


@query("timespan", "WITH t(grp, path) AS (SELECT n_name, 'd/' || n_name || '_{dt}.tif' FROM nation UNION ALL SELECT r_name, 's/' || r_name || '.tif' FROM region), i(a, b) AS (VALUES "
       + _SPANS_SQL
       + ") SELECT grp, replace(path, '{dt}', strftime(a, '%Y%m%d') || '_' || strftime(b, '%Y%m%d')) AS path, a AS start_date, b AS end_date, true AS temporal, regexp_replace(split_part(replace(path, '{dt}', strftime(a, '%Y%m%d') || '_' || strftime(b, '%Y%m%d')), '/', 2), '\\.[^.]*$', '') AS name FROM t, i WHERE contains(path, '{dt}')"
       " UNION ALL SELECT grp, path, NULL, NULL, false, regexp_replace(split_part(path, '/', 2), '\\.[^.]*$', '') FROM t WHERE NOT contains(path, '{dt}')")  # fmt: skip
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    moving = B.table(spark, sf_dir, "nation").select(F.col("n_name").alias("grp"), F.concat(F.lit("d/"), "n_name", F.lit("_{dt}.tif")).alias("path"))
    still = B.table(spark, sf_dir, "region").select(F.col("r_name").alias("grp"), F.concat(F.lit("s/"), "r_name", F.lit(".tif")).alias("path"))
    return C.timespan(moving.unionByName(still), _SPANS)


_R16 = timedim.date_range("2013001", "2019001", "days", "16," * 22 + "13", fmt="%Y%j")
# A year has 23 intervals; those behind February begin, and those that reach behind it end, a day later in a leap year.
query("date_range_16d", """WITH y AS (SELECT y, i, make_date(y, 1, 1) AS d, y % 4 = 0 AS leap, 16 * i AS s, 16 * (i + 1) - CASE WHEN i = 22 THEN 3 ELSE 0 END AS e FROM range(2013, 2020) a(y), range(23) b(i) WHERE y < 2019 OR i = 0)
SELECT CAST(row_number() OVER (ORDER BY y, i) - 1 AS INT) AS i, d + CAST(s + CASE WHEN leap AND s >= 59 THEN 1 ELSE 0 END AS INT) AS start_date, d + CAST(e - 1 + CASE WHEN leap AND e > 59 THEN 1 ELSE 0 END AS INT) AS end_date FROM y""")(lambda s, d: timedim.intervals_df(s, _R16))  # fmt: skip
query("date_strings", "SELECT CAST(y AS INT) AS y, string_agg(a || '-' || b, ',' ORDER BY a) AS days FROM (SELECT y, i, lpad(CAST(16 * i + 1 AS VARCHAR), 3, '0') AS a, CASE WHEN i = 22 THEN '365' ELSE lpad(CAST(16 * i + 16 AS VARCHAR), 3, '0') END AS b FROM range(2013, 2019) a(y), range(23) b(i)) GROUP BY y")(
    lambda s, d: s.createDataFrame([(int(a[:4]), a[4:], b[4:]) for a, b in timedim.date_strings(_R16[:-1], "%Y%j")], "y int, a string, b string").groupBy("y").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "a", "b"))), ",").alias("days"))
)
query("date_range_static", "SELECT 0 AS i, DATE '2015-03-01' AS start_date, DATE '2016-02-29' AS end_date")(lambda s, d: timedim.intervals_df(s, timedim.date_range("20150301", "20160229", "static", 1)))
query("template_names", _CAT + "SELECT 'grid_x_' || grp || '_' || strftime(start_date, '%Y%m%d') AS out FROM k")(
    lambda s, d: _catalog(s, d).select(C.fill_template(F.lit("grid_{nm}_{gr}_{dt}"), nm=F.lit("x"), gr=F.col("grp"), dt=F.date_format("start_date", "yyyyMMdd")).alias("out"))
)
query("update_by_separator", "SELECT p_partkey, CASE WHEN len(string_split(p_type, ' ')) > 1 THEN array_to_string(list_concat(list_concat(string_split(p_type, ' ')[1:1], ['NEW']), string_split(p_type, ' ')[3:]), ' ') ELSE p_type || ' NEW' END AS out, coalesce(string_split(p_type, ' ')[1], '') AS token FROM part")(
    lambda s, d: B.table(s, d, "part").select("p_partkey", C.update_by_separator(F.col("p_type"), " ", 1, "NEW").alias("out"), C.pick_tokens(F.col("p_type"), " ", [0]).alias("token"))
)
query("rename_layers", "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[aeiou]', '_', 'g'), '_+', '-', 'g') AS out FROM part")(lambda s, d: B.table(s, d, "part").select("p_partkey", C.rename_layers(F.col("p_name"), {"[aeiou]": "_", "_+": "-"}).alias("out")))


# --- overlay and grids ------------------------------------------------------------------

_PT = f"WITH p AS ({B.POINTS}), q AS (SELECT *, CAST(floor(500 - y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col FROM p), r AS ({B.RASTER}) "


def _points_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = S.cell_of(F.col("x"), F.col("y"), 0.0, 500.0, 1.0)
    return B.points(spark, sf_dir).withColumns({"row": row, "col": col})


@query("space_overlay", _PT + "SELECT q.pt_id, q.row, q.col, round(r.value, 6) AS v, CAST(r.label AS DOUBLE) AS label FROM q LEFT JOIN r ON r.row = q.row AND r.col = q.col")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = B.raster(spark, sf_dir)
    cells = r.select("row", "col", F.lit("v").alias("layer"), "value").unionByName(r.select("row", "col", F.lit("label").alias("layer"), F.col("label").cast("double").alias("value")))
    return rounded(S.space_overlay(_points_cells(spark, sf_dir).select("pt_id", "row", "col"), cells, ["v", "label"]).select("pt_id", "row", "col", "v", "label"), "v", "label")


@query("spacetime_overlay", _PT + ", y AS (SELECT unnest(range(1995, 2002)) AS year) SELECT q.pt_id, q.row, q.col, CAST(year(q.date) AS INT) AS year, round(a.value * year(q.date), 6) AS t, CASE WHEN year(q.date) > 1995 THEN round(a.value * (year(q.date) - 1), 6) END AS t_m1 FROM q LEFT JOIN r a ON a.row = q.row AND a.col = q.col")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.range(1995, 2002).select(F.col("id").cast("int").alias("year"))
    cells = B.raster(spark, sf_dir).crossJoin(F.broadcast(years)).select("row", "col", "year", F.lit("t").alias("layer"), (F.col("value") * F.col("year")).alias("value"))
    pts = _points_cells(spark, sf_dir).select("pt_id", "row", "col", F.year("date").alias("year"))
    both = S.spacetime_overlay(pts, cells, {"t": (0, -1)})
    return rounded(both.select("pt_id", "row", "col", "year", "t", "t_m1"), "t", "t_m1")


query("point_query", f"WITH c AS ({B.QUARTER}) SELECT s_suppkey AS pt_id, c.px, c.grp, c.start_date, c.end_date, round(value, 6) AS value FROM supplier JOIN c ON c.px = s_suppkey")(
    lambda s, d: rounded(S.point_query(B.table(s, d, "supplier").select(F.col("s_suppkey").alias("pt_id"), F.col("s_suppkey").alias("px")), B.quarter_cube(s, d)).select("pt_id", "px", "grp", "start_date", "end_date", "value"))
)
query("block_overlay", _PT + "SELECT CAST(floor(row / 64.0) AS BIGINT) AS block_row, CAST(floor(col / 16.0) AS BIGINT) AS block_col, count(*) AS n FROM q GROUP BY 1, 2")(
    lambda s, d: _points_cells(s, d).select(*[c.alias(n) for c, n in zip(S.block_of(F.col("row"), F.col("col"), 64, 16), ("block_row", "block_col"), strict=True)]).groupBy("block_row", "block_col").agg(F.count("*").alias("n"))
)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    br, bc = S.block_of(F.col("row"), F.col("col"), 50, 16)
    return B.raster(spark, sf_dir).withColumns({"block_row": br, "block_col": bc})


query("block_aggregate", f"WITH r AS ({B.RASTER}), b AS (SELECT floor(row / 50.0) AS i, floor(col / 16.0) AS j, avg(value) AS part FROM r GROUP BY 1, 2) SELECT round(avg(part), 6) AS value FROM b")(
    lambda s, d: rounded(S.block_aggregate(_blocks(s, d), F.avg("value"), F.avg("part").alias("value")))
)
query("block_stack", f"WITH a AS ({B.QUARTER_FLAG}) SELECT x.px, x.start_date, round(x.value, 6) AS value_0, round(y.value, 6) AS value_1 FROM a x JOIN a y ON x.px = y.px AND x.start_date = y.start_date WHERE x.grp = 'A' AND y.grp = 'R'")(
    lambda s, d: (lambda c: rounded(S.block_stack([C.active_group(c, g).withColumn("k", F.struct("px", "start_date")) for g in ("A", "R")], "k").select("k.px", "k.start_date", "value_0", "value_1"), "value_0", "value_1"))(B.quarter_cube(s, d, "l_returnflag"))
)
query("tiles", "SELECT x * 4 + y AS tile_id, CAST(128 * x AS DOUBLE) AS minx, CAST(128 * y AS DOUBLE) AS miny, CAST(least(128 * (x + 1), 600) AS DOUBLE) AS maxx, CAST(least(128 * (y + 1), 500) AS DOUBLE) AS maxy FROM range(5) a(x), range(4) b(y)")(
    lambda s, d: S.tiles(s, 128, 0, 0, 600, 500)
)
query("zonal_stats", f"WITH r AS ({B.RASTER}), t AS (SELECT CAST(floor(row / 50.0) * 4 + floor(col / 16.0) AS BIGINT) AS tile_id, CAST(label AS DOUBLE) AS v FROM r), c AS (SELECT tile_id, v, count(*) AS n FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY n DESC, v) AS o FROM c) SELECT tile_id, min(v) AS raster_min, max(CASE WHEN o = 1 THEN v END) AS raster_mode_value, max(CASE WHEN o = 1 THEN n END) AS raster_mode_count, max(v) AS raster_max FROM k GROUP BY tile_id")(
    lambda s, d: S.zonal_stats(_blocks(s, d).select((F.col("block_row") * 4 + F.col("block_col")).alias("tile_id"), F.col("label").cast("double").alias("value")))
)
query("land_coverage", f"WITH r AS ({B.RASTER}) SELECT round(count(*) FILTER (value > 0 AND label < 8) / count(*) FILTER (label < 8), 6) AS coverage FROM r")(
    lambda s, d: rounded(S.land_coverage(B.raster(s, d).select(F.when(F.col("label") >= 8, 20).otherwise(F.col("label")).alias("land"), F.when(F.col("value") > 0, F.col("value")).alias("value"))), "coverage")
)
query("overview", f"WITH r AS ({B.RASTER}) SELECT 'v' AS layer, CAST(floor(row / 4.0) AS BIGINT) AS orow, CAST(floor(col / 4.0) AS BIGINT) AS ocol, round(value, 6) AS value FROM r WHERE row % 4 = 0 AND col % 4 = 0")(
    lambda s, d: rounded(S.overview(B.raster(s, d).select(F.lit("v").alias("layer"), "row", "col", "value"), 4).select("layer", "orow", "ocol", "value"))
)
query("regrid", f"WITH r AS ({B.RASTER}) SELECT 'v' AS layer, row // 2 AS row, col // 2 AS col, round(value, 6) AS value FROM r WHERE row % 2 = 1 AND col % 2 = 1")(
    lambda s, d: rounded(S.regrid(B.raster(s, d).select(F.lit("v").alias("layer"), "row", "col", "value"), 2.0))
)
query("mask_layer", f"WITH c AS ({B.QUARTER}) SELECT c.px, c.grp, start_date, end_date, CASE WHEN s_acctbal > 0 THEN round(value, 6) END AS value FROM c LEFT JOIN supplier ON s_suppkey = px")(
    lambda s, d: rounded(C.mask(B.quarter_cube(s, d), B.table(s, d, "supplier").select(F.col("s_suppkey").alias("px"), F.col("s_acctbal").alias("mask")), "mask > 0").select("px", "grp", "start_date", "end_date", "value"))
)
query("fit_in_dtype", "SELECT o_orderkey, CAST(CASE WHEN v = 255 THEN 254 ELSE v END AS BIGINT) AS v FROM (SELECT o_orderkey, least(greatest(round_even(o_totalprice / 1000 - 20, 0), 0), 255) AS v FROM orders)")(
    lambda s, d: B.table(s, d, "orders").select("o_orderkey", cube_io.fit_in_dtype(F.col("o_totalprice") / 1000 - 20, "uint8", 255).alias("v"))
)
query("point_in_polygon", f"WITH p AS ({B.POINTS}) SELECT count(*) AS n FROM p WHERE x + y < 200 AND x > 10 AND y > 20 AND x <> 10 AND y <> 20")(
    lambda s, d: B.points(s, d).where(S.point_in_polygon(F.col("x"), F.col("y"), [(10.0, 20.0), (180.0, 20.0), (10.0, 190.0)])).agg(F.count("*").alias("n"))
)
query("stretch_rgb", f"WITH {_WIDE}, l AS (SELECT quantile_cont(a, 0.02) AS a0, quantile_cont(a, 0.98) AS a1, quantile_cont(n, 0.02) AS n0, quantile_cont(n, 0.98) AS n1, quantile_cont(r, 0.02) AS r0, quantile_cont(r, 0.98) AS r1 FROM p) SELECT px, start_date, CASE WHEN a IS NULL OR n IS NULL OR r IS NULL THEN 0 ELSE 1 END AS alpha, CASE WHEN a IS NOT NULL THEN round(least(greatest((a - a0) / (a1 - a0), 0), 1), 6) END AS r, CASE WHEN n IS NOT NULL THEN round(least(greatest((n - n0) / (n1 - n0), 0), 1), 6) END AS g, CASE WHEN p.r IS NOT NULL THEN round(least(greatest((p.r - r0) / (r1 - r0), 0), 1), 6) END AS b FROM p, l")(
    lambda s, d: rounded(S.rgb(BM.to_wide(B.month_cube(s, d), ["A", "N", "R"]).withColumnsRenamed({"A": "ba", "N": "bn", "R": "br"}), ("ba", "bn", "br")).withColumns({c: F.when(F.col(o).isNotNull(), F.col(c)) for c, o in (("r", "ba"), ("g", "bn"), ("b", "br"))}).select("px", "start_date", "alpha", "r", "g", "b"), "r", "g", "b")
)

# --- sampling and metrics ------------------------------------------------------------------

query("sample_groups", f"WITH p AS ({B.POINTS}) SELECT pt_id, 'x' || CAST(floor(x / 10) - (SELECT min(floor(x / 10)) FROM p) AS BIGINT) || 'y' || CAST(floor(y / 10) - (SELECT min(floor(y / 10)) FROM p) AS BIGINT) || 't' || CAST(floor(date_diff('day', (SELECT min(date) FROM p), date) / 365.0) AS BIGINT) AS cv_group FROM p")(
    lambda s, d: M.sample_groups(B.points(s, d), resolution=10.0, days=365).select("pt_id", "cv_group")
)
query("min_samples", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 0.04 * (SELECT count(*) FROM customer))")(
    lambda s, d: C.min_samples(B.table(s, d, "customer"), "c_nationkey", 0.04).select("c_custkey", "c_nationkey")
)
query("label_encode", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS code FROM customer")(lambda s, d: M.label_encode(B.table(s, d, "customer"), "c_mktsegment").select("c_custkey", F.col("code").cast("int").alias("code")))
query("impute", "SELECT c_custkey, round(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)), 6) AS v FROM customer")(
    lambda s, d: rounded(M.impute(B.table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v")), ["v"]), "v")
)
_PRED = "SELECT vec_id, label, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS pred, (vec_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM embeddings"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("pred"), ((F.col("vec_id") * 7919 % 1000) / 1000.0).alias("score"))


query("confusion_matrix", f"SELECT label AS actual, pred AS predicted, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2")(lambda s, d: M.confusion(_predictions(s, d), "label", "pred"))
query("class_report", f"WITH p AS ({_PRED}), l AS (SELECT DISTINCT label FROM p) SELECT l.label, round(hit / said, 6) AS precision, round(hit / support, 6) AS recall, round(2 * (hit / said) * (hit / support) / (hit / said + hit / support), 6) AS f1, support FROM (SELECT l.label, count(*) FILTER (p.label = l.label) AS support, count(*) FILTER (p.pred = l.label) AS said, count(*) FILTER (p.label = l.label AND p.pred = l.label) AS hit FROM l, p GROUP BY l.label) l")(
    lambda s, d: rounded(M.class_report(_predictions(s, d), "label", "pred"), "precision", "recall", "f1")
)
query("regression_metrics", f"WITH p AS ({_PRED}) SELECT round(1 - sum(pow(label - pred, 2)) / (var_pop(label) * count(*)), 6) AS r2, round(sqrt(avg(pow(label - pred, 2))), 6) AS rmse FROM p")(lambda s, d: rounded(M.regression_metrics(_predictions(s, d).select(F.col("label").cast("double").alias("label"), F.col("pred").cast("double").alias("pred")), "label", "pred"), "r2", "rmse"))
query("log_loss", f"SELECT round(avg(-ln(greatest(least(score, 1 - 1e-15), 1e-15))), 6) AS log_loss FROM ({_PRED})")(lambda s, d: rounded(M.log_loss(_predictions(s, d), "score"), "log_loss"))
_CURVE = f"p AS ({_PRED}), k AS (SELECT label AS k, pred = label AS y, score FROM p), g AS (SELECT k, score AS threshold, sum(CAST(y AS BIGINT)) AS tp, count(*) AS n FROM k GROUP BY 1, 2), u AS (SELECT k, threshold, sum(tp) OVER w AS tp, sum(n) OVER w AS n, sum(tp) OVER (PARTITION BY k) AS al FROM g WINDOW w AS (PARTITION BY k ORDER BY threshold DESC)), c AS (SELECT k, threshold, tp / n AS precision, CASE WHEN al > 0 THEN tp / al ELSE 0 END AS recall FROM u)"


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pr_curve(_predictions(spark, sf_dir).select(F.col("label").alias("k"), (F.col("pred") == F.col("label")).alias("y"), "score"), "y", "score", "k")


query("pr_curve", f"WITH {_CURVE} SELECT k, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c")(lambda s, d: rounded(_curve(s, d), "precision", "recall"))
query("pr_auc", f"WITH {_CURVE}, a AS (SELECT k, (recall - coalesce(lag(recall) OVER w, 0)) * (precision + coalesce(lag(precision) OVER w, 1)) / 2 AS s FROM c WINDOW w AS (PARTITION BY k ORDER BY threshold DESC)) SELECT k, round(sum(s), 6) AS auc FROM a GROUP BY k")(lambda s, d: rounded(M.pr_auc(_curve(s, d), "k"), "auc"))
query("opt_threshold", f"WITH {_CURVE} SELECT k, threshold FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY 1 - abs(precision - recall) DESC, threshold DESC) AS o FROM c WHERE precision > 0 AND recall > 0) WHERE o = 1")(lambda s, d: M.optimal_threshold(_curve(s, d), "k"))
_THREE = f"SELECT vec_id, pred = label AS hit, score AS a, score * score AS b, sqrt(score) AS c FROM ({_PRED})"


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("vec_id", (F.col("pred") == F.col("label")).cast("double").alias("hit"), F.col("score").alias("a"), (F.col("score") * F.col("score")).alias("b"), F.sqrt("score").alias("c"))


query("corr_factor", f"WITH t AS ({_THREE}), m AS (SELECT *, (a + b + c) / 3 AS mean FROM t) SELECT round(sqrt(avg(pow(CAST(hit AS DOUBLE) - mean, 2))) / avg(sqrt((pow(a - mean, 2) + pow(b - mean, 2) + pow(c - mean, 2)) / 3)), 6) AS factor FROM m")(lambda s, d: rounded(M.correction_factor(_three(s, d), "hit", ["a", "b", "c"]), "factor"))
query("hard_class", f"WITH t AS ({_THREE}) SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS class, round(100 * greatest(a, b, c), 6) AS prob FROM t")(
    lambda s, d: (lambda t: rounded(t.select("vec_id", *[x.alias(n) for x, n in zip(M.hard_class(F.array("a", "b", "c")), ("class", "prob"), strict=True)]), "prob"))(_three(s, d))
)
query("entropy", f"WITH t AS ({_THREE}), p AS (SELECT vec_id, greatest(a, 1e-15) AS a, greatest(b, 1e-15) AS b, greatest(c, 1e-15) AS c FROM t) SELECT vec_id, round(-(a * log2(a) + b * log2(b) + c * log2(c)) / log2(3), 6) AS entropy FROM p")(lambda s, d: rounded(_three(s, d).select("vec_id", M.relative_entropy(F.array("a", "b", "c")).alias("entropy")), "entropy"))

# --- earth observation, search, catalog ----------------------------------------------------

_SCENES = "SELECT l_orderkey % 40 AS scene, l_suppkey AS px, l_linenumber AS band, CAST(l_quantity AS INT) % 20 AS qa, l_extendedprice AS value FROM lineitem"


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("scene"), F.col("l_suppkey").alias("px"), F.col("l_linenumber").alias("band"), (F.col("l_quantity").cast("int") % 20).alias("qa"), F.col("l_extendedprice").alias("value"))


_CLEAR = "(qa BETWEEN 1 AND 2 OR qa BETWEEN 5 AND 6)"
_VALID = f"CASE WHEN {_CLEAR} AND value BETWEEN 1 AND CASE WHEN band = 6 THEN 65000 ELSE 40000 END THEN value END"
query("clear_sky", f"SELECT px, band, count(*) AS n, count(*) FILTER ({_CLEAR} OR qa BETWEEN 11 AND 17) AS clear FROM ({_SCENES}) GROUP BY 1, 2")(lambda s, d: eo.scale_qa(_scenes(s, d)).groupBy("px", "band").agg(F.count("*").alias("n"), F.count_if(eo.clear_sky(F.col("qa"), False)).alias("clear")))
query("scene_filter", f"WITH s AS ({_SCENES}), k AS (SELECT scene FROM s GROUP BY 1 HAVING count(*) FILTER ({_CLEAR}) / count(*) >= 0.2) SELECT scene, count(*) AS n FROM s WHERE scene IN (SELECT scene FROM k) GROUP BY 1")(lambda s, d: eo.clear_scenes(_scenes(s, d)).groupBy("scene").agg(F.count("*").alias("n")))
query("eo_percentiles", f"WITH s AS (SELECT px, band, {_VALID} AS value FROM ({_SCENES})) SELECT px, band, round({_OPS['p25']}, 6) AS p25, round({_OPS['p50']}, 6) AS p50, round({_OPS['p75']}, 6) AS p75, count(value) AS n_clear FROM s GROUP BY 1, 2")(lambda s, d: rounded(eo.scene_percentiles(_scenes(s, d), [25, 50, 75]), "p25", "p50", "p75"))
query("quantise", f"SELECT px, CAST(floor(max({_VALID}) / 40000 * 255) AS INT) AS q FROM ({_SCENES}) GROUP BY px")(lambda s, d: _scenes(s, d).withColumn("v", F.when(eo.clear_sky(F.col("qa")), eo.valid(F.col("value"), F.col("band")))).groupBy("px").agg(F.max("v").alias("v")).select("px", eo.quantise(F.col("v")).alias("q")))
query("interval_ids", "SELECT o_orderkey, CAST((year(o_orderdate) - 1980) * 23 + 1 + floor((dayofyear(o_orderdate) - 1) / 16.0) AS INT) AS id FROM orders")(lambda s, d: B.table(s, d, "orders").select("o_orderkey", eo.interval_id(F.year("o_orderdate"), 1 + F.floor((F.dayofyear("o_orderdate") - 1) / 16)).cast("int").alias("id")))
query("stac_expand", _CAT + "SELECT grp AS collection, grp || '_' || strftime(start_date, '%Y%m%d') || '_' || strftime(end_date, '%Y%m%d') AS item, start_date, end_date, path AS assets FROM k")(lambda s, d: eo.stac_items(_catalog(s, d).unionByName(_catalog(s, d))).withColumn("assets", F.array_join("assets", ",")))
query("stac_extent", _CAT + "SELECT grp AS collection, min(start_date) AS first_date, max(end_date) AS last_date, count(*) AS n_items FROM k GROUP BY 1")(lambda s, d: eo.collection_extent(eo.stac_items(_catalog(s, d))))
query("search_bm25", """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents), s AS (SELECT doc_id, len(w) AS l, avg(len(w)) OVER () AS m, count(*) OVER () AS n, w FROM d),
t AS (SELECT doc_id, l, m, n, term, count(*) AS tf FROM (SELECT doc_id, l, m, n, unnest(w) AS term FROM s) WHERE term IN ('the', 'that', 'of') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
h AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM t JOIN f USING (term) GROUP BY 1 HAVING count(*) = 3)
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS pos, doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 10""")(lambda s, d: search.bm25(B.table(s, d, "documents"), "doc_id", "text", ["the", "that", "of"]))  # fmt: skip
query("metadata_qc", "SELECT p_partkey, trim(p_name) <> '' AND trim(p_brand) <> '' AND trim(p_type) <> '' AS complete FROM part")(lambda s, d: search.metadata_check(B.table(s, d, "part"), ["p_name", "p_brand", "p_type"]).select("p_partkey", "complete"))

# --- learning, streaming --------------------------------------------------------------------


@query("stacking")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "embeddings")
    cols = [f"f{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    pts = rows.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)])
    model, _ = mapper.train(pts, "vec_id", "label", cols, n_folds=3)
    return rounded(model.predict(pts).select("vec_id", "class", "prob", "uncertainty"), "prob", "uncertainty", digits=4)


@query("window_tumbling", "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ST.tumbling(B.table(spark, sf_dir, "events")), "total", digits=4)


@query("stream_tumbling", SQL["window_tumbling"])
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = B.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(ST.run_to_end(ST.tumbling(stream), ["start", "stop", "event_type"], files.shared_folder(spark, "stream")), "total", digits=4)


# --- further catalog and table operators ------------------------------------------------------

query("filter_single_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderdate >= DATE '1998-03-01'")(
    lambda s, d: C.filter_date(B.table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), date(1998, 3, 1), date(1998, 4, 1))
)
query("in_bounds", f"SELECT pt_id FROM ({B.POINTS}) WHERE x >= 10.5 AND x <= 20.5 AND y >= 100.5 AND y <= 300.5")(
    lambda s, d: B.points(s, d).where(S.in_bounds(F.col("x"), F.col("y"), 10.5, 100.5, 20.5, 300.5)).select("pt_id")
)
query("select_features", "SELECT p_size, p_retailprice, p_partkey FROM part")(lambda s, d: C.select_features(B.table(s, d, "part"), prefixes=["p_s", "p_r", "p_partk"]))
query("require_features", "SELECT p_retailprice, p_size FROM part")(lambda s, d: C.require_features(B.table(s, d, "part"), ["p_retailprice", "p_size"], allow_more=True))
query("calibration_subset", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")(
    lambda s, d: C.calibration_subset(B.table(s, d, "supplier"), B.table(s, d, "nation").where("n_regionkey = 1").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select("s_suppkey")
)
_COMMON = "CAST(dayofyear({d}) - CASE WHEN year({d}) % 4 = 0 AND month({d}) > 2 THEN 1 ELSE 0 END AS INT)"
query("day_of_year_names", _CAT + f"SELECT grp || '-' || year(start_date) || lpad(CAST({_COMMON.format(d='start_date')} AS VARCHAR), 3, '0') || '_' || year(end_date) || lpad(CAST({_COMMON.format(d='end_date')} AS VARCHAR), 3, '0') AS out FROM k")(
    lambda s, d: _catalog(s, d).select(F.concat_ws("-", "grp", C.date_text("interval", "%Y%j")).alias("out"))
)
query("href_merge", _CAT + "SELECT grp, 'v/' || name || '.vrt' AS path, 1 AS band, start_date, start_date AS end_date, true AS temporal, name FROM k WHERE year(start_date) <> 1999")(
    lambda s, d: (lambda k: C.href_merge(k.unionByName(k).select(F.col("path").alias("href"), F.col("grp").alias("band"), F.col("start_date").alias("date")), k.where("year(start_date) <> 1999").select(F.col("path").alias("href"), F.concat(F.lit("v/"), "name", F.lit(".vrt")).alias("path"))))(_catalog(s, d))
)


@query("write_groups", f"WITH c AS ({B.QUARTER_FLAG}) SELECT px, grp, start_date, end_date, CASE WHEN px <> 3 THEN round(value, 6) END AS value FROM c WHERE grp <> 'N'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.shared_folder(spark, "groups")
    cube = B.quarter_cube(spark, sf_dir, "l_returnflag")
    cube_io.write_cube(cube.withColumn("value", F.when(F.col("px") == 3, -9.0).otherwise(F.col("value"))), folder, "grp <> 'N'")
    return rounded(cube_io.read_cube(spark, folder, nodata=-9.0).select("px", "grp", "start_date", "end_date", "value"))


query("report_averages", f"""WITH p AS ({_PRED}), l AS (SELECT DISTINCT label FROM p), c AS (SELECT l.label, count(*) FILTER (p.label = l.label) AS support, count(*) FILTER (p.label = l.label AND p.pred = l.label) / count(*) FILTER (p.pred = l.label) AS pr, count(*) FILTER (p.label = l.label AND p.pred = l.label) / count(*) FILTER (p.label = l.label) AS re FROM l, p GROUP BY 1),
f AS (SELECT *, 2 * pr * re / (pr + re) AS f1 FROM c), a AS (SELECT round(count(*) FILTER (label = pred) / count(*), 6) AS v, count(*) AS n FROM p)
SELECT 'accuracy' AS label, v AS precision, v AS recall, v AS f1, n AS support FROM a
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")(lambda s, d: rounded(M.report_averages(_predictions(s, d), "label", "pred"), "precision", "recall", "f1"))  # fmt: skip
query("class_log_loss", f"WITH p AS ({_PRED}), c AS (SELECT CAST(i AS INT) AS label, vec_id, p.label = i AS hit, greatest(least(CASE WHEN i % 2 = 0 THEN score ELSE 1 - score END, 1 - 1e-15), 1e-15) AS q FROM p, range(10) r(i)) SELECT label, round(avg(-ln(CASE WHEN hit THEN q ELSE 1 - q END)), 6) AS log_loss FROM c GROUP BY label")(
    lambda s, d: rounded(M.class_log_loss(_predictions(s, d).withColumn("p", F.array(*[F.col("score") if i % 2 == 0 else 1 - F.col("score") for i in range(10)])), "label", list(range(10)), "p"), "log_loss")
)
query("balanced_weights", "SELECT c_custkey, round((SELECT count(*) FROM customer) / ((SELECT count(DISTINCT c_mktsegment) FROM customer) * CAST(count(*) OVER (PARTITION BY c_mktsegment) AS DOUBLE)), 6) AS weight FROM customer")(
    lambda s, d: rounded(mapper.balanced_weights(B.table(s, d, "customer"), "c_mktsegment").select("c_custkey", "weight"), "weight")
)
query("contiguous_folds", "WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), z AS (SELECT *, n // 7 AS s, n % 7 AS m FROM o) SELECT c_custkey, CAST(CASE WHEN i < m * (s + 1) THEN i // (s + 1) ELSE (i - m * (s + 1)) // s + m END AS INT) AS fold FROM z")(
    lambda s, d: rows.contiguous_folds(B.table(s, d, "customer"), 7, ["c_custkey"]).select("c_custkey", "fold")
)


# --- grids, tiles, files and the container -----------------------------------------------------

_GRIDS = "SELECT n_nationkey AS layer, CAST(n_nationkey * 10 AS DOUBLE) AS gt0, CAST(1 + n_regionkey AS DOUBLE) AS gt1, CAST(500 - n_nationkey AS DOUBLE) AS gt3, -CAST(1 + n_regionkey AS DOUBLE) AS gt5, CAST(20 AS BIGINT) AS width, CAST(30 AS BIGINT) AS height FROM nation"


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = B.table(spark, sf_dir, "nation"), (F.col("n_regionkey") + 1).cast("double")
    return n.select(F.col("n_nationkey").alias("layer"), (F.col("n_nationkey") * 10).cast("double").alias("gt0"), size.alias("gt1"), (500 - F.col("n_nationkey")).cast("double").alias("gt3"), (-size).alias("gt5"), F.lit(20).cast("long").alias("width"), F.lit(30).cast("long").alias("height"))


query("common_grid", f"SELECT min(gt0) AS minx, min(gt3 + gt5 * height) AS miny, max(gt0 + gt1 * width) AS maxx, max(gt3) AS maxy, min(gt1) AS res FROM ({_GRIDS})")(lambda s, d: S.common_grid(_grids(s, d)))
query("footprint", f"SELECT layer, gt0 AS minx, gt3 + gt5 * height AS miny, gt0 + gt1 * width AS maxx, gt3 AS maxy, gt3 AS corner FROM ({_GRIDS})")(
    lambda s, d: eo.footprint(_grids(s, d)).select("layer", "minx", "miny", "maxx", "maxy", F.get_json_object("footprint", "$.coordinates[0][1][1]").cast("double").alias("corner"))
)


@query("align", f"""WITH g AS ({_GRIDS}), c AS (SELECT layer, r.row, k.col, CAST(layer * 1000 + r.row * 20 + k.col AS DOUBLE) AS value FROM g, range(30) r(row), range(20) k(col)),
t AS (SELECT g.*, r.row AS nr, k.col AS nc, floor((g.gt3 - (500 - (r.row + 0.5) * 2.0)) / -g.gt5) AS sr, floor((k.col + 0.5) * 2.0 - g.gt0) AS raw, floor(((k.col + 0.5) * 2.0 - g.gt0) / g.gt1) AS sc FROM g, range(100) r(row), range(170) k(col))
SELECT t.layer, t.nr AS row, t.nc AS col, c.value FROM t JOIN c ON c.layer = t.layer AND c.row = t.sr AND c.col = t.sc""")  # fmt: skip
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grids(spark, sf_dir)
    cells = g.select("layer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("row")).select("layer", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("col"))
    cells = cells.withColumn("value", (F.col("layer") * 1000 + F.col("row") * 20 + F.col("col")).cast("double"))
    return S.align(cells, g, (0.0, 300.0, 340.0, 500.0), 2.0).select("layer", "row", "col", "value")


query("block_plan", f"WITH p AS ({B.POINTS}), l(layer, res, h) AS (VALUES ('a', 1, 64), ('b', 1, 64), ('c', 2, 50)) SELECT pt_id, layer, CAST(floor((500 - y) / res) AS BIGINT) AS row, CAST(floor(x / res) AS BIGINT) AS col, CAST(floor(floor((500 - y) / res) / h) AS BIGINT) AS block_row, CAST(floor(floor(x / res) / 16) AS BIGINT) AS block_col FROM p, l")(
    lambda s, d: S.block_plan(B.points(s, d), s.createDataFrame([(n, 0.0, float(r), 500.0, -float(r), h, 16) for n, r, h in (("a", 1, 64), ("b", 1, 64), ("c", 2, 50))], "layer string, gt0 double, gt1 double, gt3 double, gt5 double, block_h int, block_w int"))
)
query("interval_urls", "SELECT i AS id, 'http://h/030E/' || i || '.tif' AS url FROM range(850, 874) r(i)")(lambda s, d: eo.interval_urls(850, 873, "030E", "http://h", s))
query("search_catalog", """WITH c AS (SELECT p_partkey AS id, p_name AS title, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM part), q AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM part WHERE p_partkey = 1),
s AS (SELECT id, title, len(w) AS l, avg(len(w)) OVER () AS m, count(*) OVER () AS n, w FROM c), t AS (SELECT id, title, l, m, n, term, count(*) AS tf FROM (SELECT id, title, l, m, n, unnest(w) AS term FROM s) JOIN q USING (term) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
h AS (SELECT id, title, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM t JOIN f USING (term) GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM q))
SELECT row_number() OVER (ORDER BY score DESC, id) AS pos, id, title, score FROM h ORDER BY score DESC, id LIMIT 10""")(
    lambda s, d: (lambda p: search.search_catalog(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description")), p.where("p_partkey = 1").first().p_type, "description"))(B.table(s, d, "part"))
)
query("regrid_fine", f"WITH r AS ({B.RASTER}) SELECT 'v' AS layer, row * 2 + a AS row, col * 2 + b AS col, round(value, 6) AS value FROM r, range(2) x(a), range(2) y(b)")(
    lambda s, d: rounded(S.regrid(B.raster(s, d).select(F.lit("v").alias("layer"), "row", "col", "value"), 0.5))
)
query("tile_windows", "SELECT x * 4 + y AS tile_id, 500 - least(128 * (y + 1), 500) AS row0, 499 - 128 * y AS row1, 128 * x AS col0, least(128 * (x + 1), 600) - 1 AS col1 FROM range(5) a(x), range(4) b(y)")(
    lambda s, d: S.tile_windows(S.tiles(s, 128, 0, 0, 600, 500), 0.0, 500.0, 1.0).select("tile_id", "row0", "row1", "col0", "col1")
)
query("process_tiles", f"WITH r AS ({B.RASTER}) SELECT CAST(floor(row / 50.0) * 4 + floor(col / 16.0) AS BIGINT) AS tile_id, round(avg(value), 6) AS mean, count(*) AS n FROM r GROUP BY 1")(
    lambda s, d: rounded(S.process_tiles(B.raster(s, d).select("row", "col", "value"), _tile_mean, "tile_id long, mean double, n long", 50, 16, n_cols=64), "mean")
)
query("block_write", f"WITH r AS ({B.RASTER}), p AS (SELECT *, col + 0.5 AS x, 500 - (row + 0.5) AS y FROM r WHERE row BETWEEN 300 AND 499 AND col BETWEEN 0 AND 47) SELECT row, col, CASE WHEN x + y < 200 AND x > 10 AND y > 20 AND x < 47 THEN round(value * 2, 6) END AS value FROM p WHERE row BETWEEN 300 AND 499")(
    lambda s, d: rounded(S.block_write(B.raster(s, d).select("row", "col", "value"), [(10.0, 20.0), (47.0, 20.0), (47.0, 153.0), (10.0, 190.0)], F.col("value") * 2, 0.0, 500.0, 1.0, 50, 16).select("row", "col", "value"))
)
query("along_time", f"WITH c AS ({B.QUARTER}) SELECT px, grp || '.dev' AS grp, start_date, end_date, round(value - avg(value) OVER (PARTITION BY px, grp), 6) AS value FROM c")(
    lambda s, d: rounded(S.apply_along_time(B.quarter_cube(s, d), _deviation, "dev"))
)


def _tile_mean(tile: int, cells):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.DataFrame({"tile_id": [tile], "mean": [cells["value"].mean()], "n": [len(cells)]})


def _deviation(x):  # noqa: ANN001, ANN202
    return x - x.mean(axis=1, keepdims=True)


@query("geotiff_round_trip", f"WITH r AS ({B.RASTER}) SELECT name, row, col, CASE WHEN name = 'v' THEN round(value, 4) ELSE CAST(greatest(label, 1) AS DOUBLE) END AS value FROM r, (VALUES ('v'), ('class')) n(name) WHERE row BETWEEN 10 AND 39 AND col BETWEEN 10 AND 41")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, r = files.shared_folder(spark, "tiffs"), B.raster(spark, sf_dir)
    size = r.agg(F.max("row"), F.max("col")).first()
    grid = Grid(1000.0, 30.0, 9000.0, -30.0, (size[1] or 0) + 1, (size[0] or 0) + 1, 3035)
    written = rasters.save_layers(r.select(F.lit("v").alias("name"), "row", "col", "value"), folder, grid).collect()
    written += rasters.save_layers(r.select(F.lit("class").alias("name"), "row", "col", F.col("label").cast("double").alias("value")), folder, Grid(1000.0, 30.0, 9000.0, -30.0, grid.width, grid.height, 3035, 0.0), "uint8").collect()
    layers = spark.createDataFrame([("g", w.path, 1, None, None, w.name, w.row0, w.col0, grid.width) for w in written], "grp string, path string, band int, start_date date, end_date date, name string, row0 long, col0 long, width long")
    return rounded(rasters.read_layers(layers, window=(10, 10, 30, 32)).select("name", "row", "col", "value"), digits=4)


@query("container_chain", f"WITH c AS ({B.MONTH}), p AS (SELECT px, start_date, end_date, max(value) FILTER (grp = 'A') AS a, max(value) FILTER (grp = 'N') AS n FROM c GROUP BY 1, 2, 3), z AS (SELECT px, year(start_date) AS y, (n - a) / (n + a) AS v FROM p) SELECT px, 'index' AS grp, make_date(y, 1, 1) AS start_date, make_date(y, 12, 31) AS end_date, CASE WHEN count(v) > 1 THEN round(quantile_cont(v, 0.25), 6) END AS value FROM z WHERE y >= 1996 GROUP BY px, y")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = Cube.of_cells(B.month_cube(spark, sf_dir).where("grp <> 'R'"))
    made = cube.run(R.Calc({"nd": "(N - A) / (N + A)"})).drop(["A", "N"]).run(R.TimeAggregate(["yearly"], ["p25"], FIRST, LAST), drop_input=True)
    return rounded(made.rename({"nd.yearly.p25": "index"}).filter_date(Y1).cells.select("px", "grp", "start_date", "end_date", "value"))


query("container_layers", _CAT + "SELECT grp, grp || '_' || strftime(start_date, '%Y%m%d') || '_' || strftime(end_date, '%Y%m%d') AS name, start_date, end_date, true AS temporal FROM k WHERE grp <> 'R'")(
    lambda s, d: Cube.of_cells(B.quarter_cube(s, d, "l_returnflag")).filter("grp <> 'R'").layers.select("grp", "name", "start_date", "end_date", "temporal")
)
query("fill_report", f"WITH {_DENSE} SELECT grp, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS gaps_before, CAST(0 AS BIGINT) AS gaps_after, CASE WHEN count(*) FILTER (value IS NULL) > 0 THEN CAST(100 AS DOUBLE) END AS percent FROM d GROUP BY grp")(
    lambda s, d: R.SeasConvFill(7).report(C.densify(B.day_cube(s, d)))
)
query("catalog_json", _CAT + "SELECT grp || '/' || i || '/' || i || '.json' AS path, i AS id, strftime(start_date, '%Y-%m-%dT00:00:00Z') AS start FROM (SELECT *, grp || '_' || strftime(start_date, '%Y%m%d') || '_' || strftime(end_date, '%Y%m%d') AS i FROM k) UNION ALL SELECT DISTINCT grp || '/collection.json', grp, NULL FROM k UNION ALL SELECT 'catalog.json', 'layers', NULL")(
    lambda s, d: eo.catalog_json(eo.stac_items(_catalog(s, d)), "layers").select("path", F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.properties.start_datetime").alias("start"))
)


@query("flagship", f"""WITH RECURSIVE {_dense(B.MONTH)},
f AS (SELECT a.px, a.grp, a.t, sum({_weight(12, 'a.n')} * b.value) / sum({_weight(12, 'a.n')}) AS fill FROM d a JOIN d b ON a.px = b.px AND a.grp = b.grp AND b.value IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT d.px, d.grp, d.t, d.start_date, coalesce(d.value, f.fill) AS value FROM d LEFT JOIN f ON f.px = d.px AND f.grp = d.grp AND f.t = d.t), {_smooth_sql('w', 'px, grp')},
q AS (SELECT w.px, w.grp, date_trunc('quarter', w.start_date) AS q, quantile_cont(z.value, 0.5) AS value FROM w JOIN z ON z.px = w.px AND z.grp = w.grp AND z.t = w.t GROUP BY 1, 2, 3),
p AS (SELECT px, grp, (row_number() OVER (PARTITION BY px, grp ORDER BY q) - 1) / count(*) OVER (PARTITION BY px, grp) AS x, value AS y FROM q)
SELECT px, grp || '.seasconv.whittaker.p50' AS grp, count(*) AS n, round(regr_intercept(y, x), 6) AS alpha_m, round(regr_slope(y, x), 6) AS beta_m, round(regr_r2(y, x), 6) AS r2_m FROM p GROUP BY px, grp""")  # fmt: skip
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled, smoothed, aggregated by quarter, and a line through each pixel's quarters."""
    series = temporal.to_series(C.densify(B.month_cube(spark, sf_dir)))
    smooth = temporal.whittaker_series(temporal.seasconv_series(series, 12), source="filled")  # filled and smoothed as series, exploded once
    cube = temporal.from_series(smooth, {"smooth": "seasconv.whittaker"})
    quarters = A.time_aggregate(cube, timedim.windows_df(spark, FIRST, LAST, "quarterly"), ["p50"])
    series = temporal.to_series(quarters).select("px", "grp", F.size("ts").alias("T"), F.posexplode_outer("ts").alias("i", "p"))
    return rounded(trend.ols(series.select("px", "grp", (F.col("i") / F.col("T")).alias("x"), F.col("p.value").alias("y")), ["px", "grp"], "x", "y"), "alpha_m", "beta_m", "r2_m").select("px", "grp", "n", "alpha_m", "beta_m", "r2_m")
