"""Raster files, containers, models and catalogs."""

import os
from datetime import date

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.container import Cube
from gridloom.functions import rows
from gridloom.operators import eo, mapper, metrics, runners
from gridloom.plans import registry
from gridloom.sources import cube_io, geotiff, rasters, toy

GRID = geotiff.Grid(10.0, 30.0, 500.0, -30.0, 77, 130, 3035, 255.0)


@pytest.mark.parametrize("kind", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
def test_tiff_round_trip(kind):
    a = (np.random.default_rng(1).random((3, 130, 77)) * 120).astype(kind)
    t = geotiff.Tiff(geotiff.encode(a, GRID))
    assert t.grid == GRID and t.bands == 3 and t.dtype == a.dtype
    assert all((t.read(b + 1) == a[b]).all() for b in range(3))
    assert (t.read(2, (60, 10, 20, 5)) == a[1, 60:80, 10:15]).all()
    for bad in ((0, 0, 131, 1), (-1, 0, 1, 1), (0, 0, 0, 1)):
        with pytest.raises(ValueError, match="outside"):
            t.read(1, bad)
    with pytest.raises(ValueError, match="band"):
        t.read(4)


def test_tiff_predictors_and_packing():
    a = np.arange(12, dtype=np.int16).reshape(3, 4) * 7
    t = geotiff.Tiff(geotiff.encode(a, GRID.window(0, 0, 3, 4)))
    t.tags[geotiff.COMPRESSION] = (geotiff.NONE,)
    t.tags[geotiff.PREDICTOR] = (2,)
    d = np.diff(a, axis=1, prepend=np.zeros((3, 1), np.int16))
    assert (t._block(d.astype("<i2").tobytes(), 3, 4, 1)[:, :, 0] == a).all()
    f = a.astype(np.float32)
    t.tags |= {geotiff.PREDICTOR: (3,), geotiff.SAMPLE_FORMAT: (3,), geotiff.BITS: (32,)}
    planes = f.astype(">f4").view(np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    coded = np.diff(planes, axis=1, prepend=np.zeros((3, 1), np.uint8)).astype(np.uint8)
    assert (t._block(coded.tobytes(), 3, 4, 1)[:, :, 0] == f).all()
    assert geotiff.unpackbits(bytes([2, 1, 2, 3, 254, 7])) == bytes([1, 2, 3, 7, 7, 7])
    with pytest.raises(ValueError, match="TIFF"):
        geotiff.Tiff(b"no raster at all")


def lzw(data):
    table, width, codes, word = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        codes.append((table[word], width))
        table[word + c] = len(table) + 2
        width += len(table) + 2 >= 1 << width and width < 12
        if len(table) == 4092:
            codes.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = c
    codes.append((table[word], width))
    width += len(table) + 3 >= 1 << width and width < 12
    bits = "".join(f"{c:0{w}b}" for c, w in [*codes, (257, width)])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_lzw():
    for kinds in (2, 6, 256):
        data = np.random.default_rng(kinds).integers(0, kinds, 20_000, np.uint8).tobytes()
        assert geotiff.unlzw(lzw(data)) == data


def layer(spark, path, band=1, name="x"):
    return spark.createDataFrame([("g", path, band, date(2015, 1, 1), date(2015, 1, 31), name)], "grp string, path string, band int, start_date date, end_date date, name string")


@pytest.fixture
def stored(tmp_path):
    a = np.arange(200, dtype=np.int16).reshape(2, 10, 10)
    path = f"{tmp_path}/a_1.tif"
    with open(path, "wb") as f:
        f.write(geotiff.encode(a, geotiff.Grid(0.0, 10.0, 100.0, -10.0, 10, 10, 4326, 7.0)))
    return path, a


def test_read_layers(spark, stored):
    path, a = stored
    got = {(r.row, r.col): r.value for r in rasters.read_layers(layer(spark, path)).collect()}
    assert len(got) == 100 and got[0, 7] is None and got[3, 4] == 34.0
    second = {(r.row, r.col): r.value for r in rasters.read_layers(layer(spark, path, 2), window=(2, 3, 4, 2)).collect()}
    assert second == {(r, c): float(a[1, r, c]) for r in range(2, 6) for c in (3, 4)}
    box = {(r.row, r.col) for r in rasters.read_layers(layer(spark, path), bounds=(20.0, 50.0, 40.0, 80.0)).collect()}
    assert box == {(r, c) for r in (2, 3, 4) for c in (2, 3)}
    away = rasters.read_layers(layer(spark, path), window=(50, 50, 2, 2)).collect()
    assert len(away) == 4 and all(r.value is None for r in away)
    coarse = {(r.row, r.col): r.value for r in rasters.read_layers(layer(spark, path), overview=4).collect()}
    assert coarse == {(r, c): float(a[0, r * 4, c * 4]) for r in range(3) for c in range(3)}
    mask = spark.createDataFrame([(3, 4, 1), (3, 5, 0)], "row long, col long, mask int")
    masked = {(r.row, r.col): r.value for r in rasters.read_layers(layer(spark, path), mask=mask).collect()}
    assert masked[3, 4] == 34.0 and masked[3, 5] is None and masked[0, 0] is None
    g = rasters.grids(spark, [path]).first()
    assert (g.bands, g.dtype, g.gt0, g.gt5, g.width, g.epsg, g.nodata) == (2, "int16", 0.0, -10.0, 10, 4326, 7.0)
    with pytest.raises(ValueError, match="overview"):
        rasters.read_layers(layer(spark, path), overview=0)


def test_unreadable_files(spark, tmp_path):
    path = f"{tmp_path}/bad.tif"
    with open(path, "wb") as f:
        f.write(b"nothing")
    with pytest.raises(Exception, match="TIFF"):
        rasters.read_layers(layer(spark, path)).collect()
    got = rasters.read_layers(layer(spark, path), window=(0, 0, 2, 3), on_error="null").collect()
    assert len(got) == 6 and all(r.value is None for r in got)


def test_save_layers_in_blocks(spark, tmp_path):
    cells = spark.createDataFrame([("n", r, c, None if (r, c) == (4, 4) else float(r * 10 + c)) for r in range(5) for c in range(5)], "name string, row long, col long, value double")
    grid = geotiff.Grid(0.0, 10.0, 50.0, -10.0, 5, 5, 3035, 0.0)
    files = rasters.save_layers(cells, str(tmp_path), grid, "uint8", block=3).orderBy("row0", "col0").collect()
    assert [(os.path.basename(f.path), f.row0, f.col0, f.n_cells) for f in files] == [("n_0_0.tif", 0, 0, 9), ("n_0_1.tif", 0, 3, 6), ("n_1_0.tif", 3, 0, 6), ("n_1_1.tif", 3, 3, 3)]
    t = geotiff.Tiff(open(files[3].path, "rb").read())
    assert (t.grid.left, t.grid.top) == (30.0, 20.0) and t.read().tolist() == [[33, 34], [43, 0]]
    assert geotiff.Tiff(open(files[0].path, "rb").read()).read()[0, 0] == 1  # 0 is nodata


def test_read_layers_of_many_files(spark, tmp_path):
    cells = spark.createDataFrame([("n", r, c, float(r * 10 + c + 1)) for r in range(5) for c in range(5)], "name string, row long, col long, value double")
    written = rasters.save_layers(cells, str(tmp_path), geotiff.Grid(0.0, 10.0, 50.0, -10.0, 5, 5, 3035, 0.0), "uint8", block=2).collect()
    layers = spark.createDataFrame([("g", f.path, 1, None, None, f.name, f.row0, f.col0, 5) for f in written], "grp string, path string, band int, start_date date, end_date date, name string, row0 long, col0 long, width long")

    def read(**kw):
        return sorted((r.row, r.col, r.px, r.value) for r in rasters.read_layers(layers, **kw).collect())

    assert read() == [(r, c, r * 5 + c, float(r * 10 + c + 1)) for r in range(5) for c in range(5)]
    assert read(window=(1, 1, 2, 3)) == read(bounds=(10.0, 20.0, 40.0, 40.0)) == [(r, c, r * 5 + c, float(r * 10 + c + 1)) for r in (1, 2) for c in (1, 2, 3)]
    assert read(overview=3) == [(r, c, r * 2 + c, float(r * 30 + c * 3 + 1)) for r in (0, 1) for c in (0, 1)]
    with open(next(f.path for f in written if (f.row0, f.col0) == (2, 2)), "wb") as f:
        f.write(b"nothing")
    assert {r[:2] for r in read(window=(1, 1, 3, 3), on_error="null")} == {(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)}


def test_round_trip_of_a_raster_in_blocks(spark, tmp_path):
    rows = [(i, [float((i * 64 + j) % 977) / 8 for j in range(64)], i % 10) for i in range(2060)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT name, row, col, value FROM ({registry.SQL['geotiff_round_trip']})").fetchall()
    got = registry.QUERIES["geotiff_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_container(spark, stored, tmp_path):
    path, a = stored
    os.rename(path, f"{tmp_path}/a_20150101_20150131.tif")
    cube = Cube.of(spark, {"a": f"{tmp_path}/a_{{dt}}.tif"}).timespan("20150101", "20150131", "months", 1)
    assert [(r.grp, r.name, r.temporal) for r in cube.layers.collect()] == [("a", "a_20150101_20150131", True)]
    read = cube.read(window=(1, 1, 2, 2))
    assert read.grid.dx == 10.0

    class Double(runners.Transformer):
        suffix = "double"

        def series(self, series):
            return series.withColumn("out", F.transform("ts.value", lambda v: v * 2))

    both = read.run(Double(), outname="{nm}_{gr}_{dt}")
    assert both.groups() == ["a", "a.double"]
    assert {r.name for r in both.layers.collect()} == {"a_20150101_20150131", "double_a.double_20150101_20150131"}
    assert {(r.row, r.col): r.value for r in both.cells.where("grp = 'a.double'").collect()} == {(r, c): 2.0 * a[0, r, c] for r in (1, 2) for c in (1, 2)}
    alone = read.run(Double(), drop_input=True).rename({"a.double": "b"})
    assert alone.groups() == ["b"]
    asked = read.run(Double(), group="other")
    assert asked.groups() == ["a"]
    out = alone.to_dir(f"{tmp_path}/out", dtype="int16").collect()
    assert len(out) == 1 and geotiff.Tiff(open(out[0].path, "rb").read()).read()[2, 2] == 44
    assert alone.to_dir(f"{tmp_path}/none", "grp = 'zz'").count() == 0
    pts = spark.createDataFrame([(1, 15.0, 85.0), (2, 999.0, 0.0)], "pt_id long, x double, y double")
    assert [(r.pt_id, r.value) for r in read.point_query(pts).collect()] == [(1, 11.0)]
    with pytest.raises(ValueError, match="entry"):
        Cube.of(spark, [("a", 1, "2015-01-01")])
    two = Cube.of(spark, {"a": [("p/x.tif", 2, "2015-01-01", "2015-02-01")], "default": "q/y.tif?v=1"}).layers.orderBy("grp").collect()
    assert [(r.grp, r.band, r.temporal, r.name) for r in two] == [("a", 2, True, "x"), ("default", 1, False, "y")]


def points(spark):
    r = np.random.default_rng(3)
    data = [(i, "hot" if x > 0 else "cold", float(x), float(y), 1.0) for i, (x, y) in enumerate(r.normal(size=(200, 2)))]
    return spark.createDataFrame(data, "id long, target string, a double, b double, w double")


def test_model_weights_save_and_dates(spark, tmp_path):
    pts = points(spark)
    weighted = pts.withColumn("w", F.when(F.col("target") == "hot", 1000.0).otherwise(0.001))
    estimators = mapper.default_estimators()
    estimators[0].setParams(numTrees=3, maxDepth=2)
    model, oof = mapper.train(weighted.withColumn("a", F.col("b")), "id", "target", ["a", "b"], estimators, n_folds=2, weight="w", contiguous=True)
    assert {r["class"] for r in model.predict(pts).collect()} == {2} and oof.count() == 200
    model, _ = mapper.train(pts, "id", "target", ["a", "b"], estimators, n_folds=2)
    model.save(f"{tmp_path}/m")
    again = mapper.StackedModel.load(f"{tmp_path}/m")
    key = lambda m: [(r.id, r["class"], r.prob) for r in m.predict(pts).orderBy("id").collect()]
    assert key(model) == key(again)
    cube = spark.createDataFrame([(p, g, date(2015, m, 1), date(2015, m, 28), v) for p in (1, 2) for m in (1, 2) for g, v in (("a", 2.0 if p == m else -2.0),)], "px long, grp string, start_date date, end_date date, value double")
    static = spark.createDataFrame([(1, 0.1), (2, None)], "px long, b double")
    got = {(r.px, r.start_date.month): r for r in again.predict_dates(cube, static).collect()}
    assert got[1, 1]["class"] == 2 and got[1, 2]["class"] == 1 and got[2, 1]["class"] is None
    assert sum(got[1, 1].probs) == pytest.approx(100) and len(got[1, 1].uncertainties) == 2
    layers = mapper.prediction_layers(again.predict_dates(cube, static), "lc", 2)
    assert {r.grp for r in layers.collect()} == {"lc_b1", "lc_b2", "lc_b1_uncertainty", "lc_b2_uncertainty", "lc_hcl", "lc_hcl_prob"}


def test_search_for_parameters(spark):
    found = mapper._assemble(points(spark).withColumn("code", (F.col("a") > 0).cast("double")), ["a", "b"])
    best, params = mapper.search(mapper.default_estimators()[1], {"regParam": [0.01, 100.0]}, found, 2)
    assert params == {"regParam": 0.01} and best.getRegParam() == 0.01


def test_neural_network_as_a_member(spark):
    pts = points(spark)
    model, _ = mapper.train(pts, "id", "target", ["a", "b"], [mapper.neural_network(2, 2, (4,), iterations=30)], n_folds=2)
    right = model.predict(pts).where("(class = 2) = (target = 'hot')").count()
    assert right >= 180


def test_contiguous_folds(spark):
    got = [r.fold for r in rows.contiguous_folds(spark.range(11).repartition(3), 3, ["id"]).orderBy("id").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_catalog_files(spark, tmp_path):
    items = spark.createDataFrame([("c", "i1", date(2015, 1, 1), date(2015, 1, 31), ["s/a.tif"], 3, 0.0, 1.0, 2.0, 3.0)], "collection string, item string, start_date date, end_date date, assets array<string>, cloud int, minx double, miny double, maxx double, maxy double")
    docs = eo.catalog_json(items, "top", spark.createDataFrame([("c", "Title")], "collection string, title string"))
    assert {r.path for r in eo.save_catalog(docs, str(tmp_path)).collect()} == {"c/i1/i1.json", "c/collection.json", "catalog.json"}
    text = open(f"{tmp_path}/c/i1/i1.json").read()
    assert '"cloud":3' in text and '"bbox":[0.0,1.0,2.0,3.0]' in text and '"Title"' in open(f"{tmp_path}/c/collection.json").read()


def test_toy_data(spark):
    cube = toy.ndvi(spark, 4, 5, gappy=True).cache()
    assert cube.count() == 4 * 5 * 24 and 0 < cube.where("value IS NULL").count() < 240
    first = cube.agg(F.min("start_date"), F.max("end_date")).first()
    assert tuple(first) == (date(2014, 12, 2), date(2020, 12, 1))
    pts = toy.samples(spark, 50, 4, 5)
    assert pts.where("row < 4 AND col < 5 AND target BETWEEN 0 AND 3 AND year(date) BETWEEN 2015 AND 2020").count() == 50
    assert runners.SeasConvFill(4).report(cube.drop("row", "col")).first().percent == 100.0


def test_thumbnails_and_styles(spark):
    import zlib

    cells = spark.createDataFrame([("a", r, c, None if r == c == 0 else float(c)) for r in range(4) for c in range(6)], "name string, row long, col long, value double")
    png = eo.thumbnails(cells, most=3, lo=0.0, hi=1.0).first().png
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[16:24] == (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
    body = zlib.decompress(png[png.index(b"IDAT") + 4 :])
    assert list(body) == [0, 0, 0, 102, 255, 204, 255, 0, 0, 255, 102, 255, 204, 255]
    sld = "<a xmlns:s='u'><s:ColorMapEntry color='#ff0000' quantity='3'/><s:ColorMapEntry color='#00ff00' quantity='-1.5'/></a>"
    got = eo.color_map(spark.createDataFrame([(sld,)], "sld string")).first()
    assert (got.colors, got.quantities, got.low, got.high) == (["#ff0000", "#00ff00"], [3.0, -1.5], -1.5, 3.0)


def test_evaluation(spark):
    df = spark.createDataFrame([(0, 0, [0.9, 0.1], 1.0, 1.5), (1, 1, [0.2, 0.8], 2.0, 2.0), (1, 0, [0.6, 0.4], 3.0, 2.5)], "t int, p int, q array<double>, y double, z double")
    kinds = metrics.evaluate(df, "t", "predict", pred="p")
    assert {(r.actual, r.predicted): r.n for r in kinds["confusion"].collect()} == {(0, 0): 1, (1, 1): 1, (1, 0): 1}
    assert kinds["averages"].where("label = 'accuracy'").first().f1 == pytest.approx(2 / 3)
    soft = metrics.evaluate(df, "t", "predict_proba", probabilities="q", classes=[0, 1])
    assert soft["log_loss"].first()[0] == pytest.approx(-np.mean(np.log([0.9, 0.8, 0.4])))
    assert {r.label: r.log_loss for r in soft["class_log_loss"].collect()}[1] == pytest.approx(-np.mean(np.log([0.9, 0.8, 0.4])))
    assert {r.label: r.auc for r in soft["auc"].collect()}[1] == pytest.approx(1.0)
    assert metrics.evaluate(df, "y", "regression", pred="z")["metrics"].first().rmse == pytest.approx(np.sqrt(0.5 / 3))
    with pytest.raises(ValueError, match="method"):
        metrics.evaluate(df, "t", "other")


def test_sheets(spark, tmp_path):
    for name, text in (("a", "id,b_list,c_date\n1,\"x, y\",2015-01-02\n2,z,never\n"), ("empty", "")):
        with open(f"{tmp_path}/{name}.csv", "w") as f:
            f.write(text)
    sheets = cube_io.read_sheets(spark, {n: f"{tmp_path}/{n}.csv" for n in ("a", "empty")})
    assert list(sheets) == ["a"]
    rows = {r.id: (r.b_list, r.c_date and r.c_date.date()) for r in sheets["a"].collect()}
    assert rows == {"1": (["x", "y"], date(2015, 1, 2)), "2": (["z"], None)}
