"""Earth-observation recipes: clear-sky masks, scenes, composites, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_VALUE, MAX_THERMAL, THERMAL_BAND = 40_000, 65_000, 6


def clear_sky(qa: Column, strict: bool = True) -> Column:
    good = qa.between(1, 2) | qa.between(5, 6)
    return good if strict else good | qa.between(11, 17)


def scale_qa(df: DataFrame) -> DataFrame:
    """Divides all QA by 100 when any is over 255."""
    top = df.agg(F.max("qa").alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("qa", F.when(F.col("_top") > 255, F.col("qa") / 100).otherwise(F.col("qa"))).drop("_top")


def clear_scenes(df: DataFrame, least: float = 0.2, strict: bool = True) -> DataFrame:
    """Pixels of scenes with at least a share of clear ones."""
    keep = df.groupBy("scene").agg((F.count_if(clear_sky(F.col("qa"), strict)) / F.count("*")).alias("share")).where(F.col("share") >= least).select("scene")
    return df.join(keep, "scene", "left_semi")


def valid(value: Column, band: Column) -> Column:
    """Values from 1 to the band's largest, else null."""
    return F.when(value.between(1, F.when(band == THERMAL_BAND, MAX_THERMAL).otherwise(MAX_VALUE)), value)


def scene_percentiles(df: DataFrame, qs: list[int], strict: bool = True) -> DataFrame:
    """Percentiles over clear scenes of each pixel and band, and the count of valid values."""
    from .aggregate import op_column

    rows = df.withColumn("value", F.when(clear_sky(F.col("qa"), strict), valid(F.col("value"), F.col("band"))))
    return rows.groupBy("px", "band").agg(*[op_column(f"p{q}", F.col("value")).alias(f"p{q}") for q in qs], F.count("value").alias("n_clear"))


def quantise(value: Column) -> Column:
    return F.floor(value / MAX_VALUE * 255).cast("int")


def interval_id(year: Column, interval: Column) -> Column:
    """Running number of the 16-day interval (1 to 23) of a year from 1980 on."""
    return (year - 1980) * 23 + interval


def interval_urls(start: int, end: int, tile: str, base: str, spark) -> DataFrame:  # noqa: ANN001
    """id, url of every interval from one to another: base/tile/id.tif."""
    return spark.range(start, end + 1).select("id", F.format_string(f"{base}/{tile}/%d.tif", "id").alias("url"))


def color_map(styles: DataFrame, xml: str = "sld") -> DataFrame:
    """Adds to style documents: colors (hex, as given), quantities, and their least and greatest (low, high), of their colour map entries."""
    entries = "//*[local-name()='ColorMapEntry']"
    values = F.transform(F.xpath(F.col(xml), F.lit(f"{entries}/@quantity")), lambda v: v.cast("double"))
    return styles.withColumns({"colors": F.xpath(F.col(xml), F.lit(f"{entries}/@color")), "quantities": values, "low": F.array_min(values), "high": F.array_max(values)})


def thumbnails(cells: DataFrame, most: int = 675, lo: float = 0.08, hi: float = 0.92) -> DataFrame:
    """name, png of layers (name, row, col, value): at most ``most`` columns, every so many cells taken, grey between two percentiles; missing cells are transparent."""
    import pyarrow as pa

    from ..sources import png

    size = cells.groupBy("name").agg(F.ceil((F.max("col") + 1) / most).cast("long").alias("every"))
    some = cells.join(size, "name").where("row % every = 0 AND col % every = 0")
    limits = cells.groupBy("name").agg(F.percentile("value", lo).alias("lo"), F.percentile("value", hi).alias("hi"))
    grey = F.round(F.least(F.greatest(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)) * 255)
    rows = some.join(limits, "name").select("name", F.floor(F.col("row") / F.col("every")).alias("r"), F.floor(F.col("col") / F.col("every")).alias("c"), F.when(F.col("value").isNotNull(), grey).cast("int").alias("v"))

    def draw(table: pa.Table) -> pa.Table:
        return pa.table({"name": table["name"].slice(0, 1), "png": pa.array([png.grey(table["r"].to_numpy(), table["c"].to_numpy(), table["v"].to_numpy(zero_copy_only=False))], pa.binary())})

    return rows.groupBy("name").applyInArrow(draw, "name string, png binary")


def stac_items(layers: DataFrame) -> DataFrame:
    """Layers as (collection, item, asset) rows: one item for each date, assets deduplicated by href."""
    assets = layers.select(F.col("grp").alias("collection"), F.concat_ws("_", "grp", F.date_format("start_date", "yyyyMMdd"), F.date_format("end_date", "yyyyMMdd")).alias("item"), "start_date", "end_date", F.col("path").alias("href")).dropDuplicates(["href"])
    return assets.groupBy("collection", "item", "start_date", "end_date").agg(F.sort_array(F.collect_list("href")).alias("assets"))


def collection_extent(items: DataFrame) -> DataFrame:
    """Per collection first and last date and number of items, and if items have a bbox (minx, miny, maxx, maxy) that of the first item (by date, then name)."""
    box = [F.min_by(F.struct(*[F.col(c) for c in BOX]), F.struct("start_date", "item")).alias("bbox")] if all(c in items.columns for c in BOX) else []
    return items.groupBy("collection").agg(F.min("start_date").alias("first_date"), F.max("end_date").alias("last_date"), F.count("*").alias("n_items"), *box)


BOX = ("minx", "miny", "maxx", "maxy")


def footprint(grids: DataFrame) -> DataFrame:
    """Adds to grids (gt0, gt1, gt3, gt5, width, height) the bbox columns, and footprint: its ring as a GeoJSON polygon."""
    right, low = F.col("gt0") + F.col("gt1") * F.col("width"), F.col("gt3") + F.col("gt5") * F.col("height")
    out = grids.withColumns({"minx": F.col("gt0"), "miny": low, "maxx": right, "maxy": F.col("gt3")})
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("minx", "miny"), ("minx", "maxy"), ("maxx", "maxy"), ("maxx", "miny"), ("minx", "miny"))])
    return out.withColumn("footprint", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))


def catalog_json(items: DataFrame, catalog: str, about: DataFrame | None = None) -> DataFrame:
    """Documents of a catalog as JSON: path, json; one for each item and collection, and catalog.json.

    Item columns beyond the known ones become its properties, without nulls; ``about``
    (collection, title, ...) gives collections more fields.
    """
    known = ["collection", "item", "start_date", "end_date", "assets", *BOX]
    more = [c for c in items.columns if c not in known]
    when = [F.date_format("start_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("start_datetime"), F.date_format("end_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("end_datetime")]
    box = [F.array(*[F.col(c) for c in BOX]).alias("bbox")] if all(c in items.columns for c in BOX) else []
    links = F.array(F.struct(F.lit("collection").alias("rel"), F.concat(F.lit("../collection.json")).alias("href")))
    body = F.struct(F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), F.col("item").alias("id"), "collection", *box, F.struct(*when, *more).alias("properties"), F.transform("assets", lambda h: F.struct(F.substring_index(h, "/", -1).alias("name"), h.alias("href"))).alias("assets"), links.alias("links"))
    one = items.select(F.concat_ws("/", "collection", "item", F.concat("item", F.lit(".json"))).alias("path"), F.to_json(body).alias("json"))
    spans = collection_extent(items)
    spans = spans if about is None else spans.join(about, "collection", "left")
    extra = [c for c in (about.columns if about is not None else []) if c != "collection"]
    extent = F.struct(F.array(F.date_format("first_date", "yyyy-MM-dd"), F.date_format("last_date", "yyyy-MM-dd")).alias("temporal"), *([F.col("bbox").alias("spatial")] if "bbox" in spans.columns else []))
    group = spans.select(F.concat(F.col("collection"), F.lit("/collection.json")).alias("path"), F.to_json(F.struct(F.lit("Collection").alias("type"), F.lit("1.0.0").alias("stac_version"), F.col("collection").alias("id"), extent.alias("extent"), "n_items", *extra)).alias("json"))
    top = spans.agg(F.array_sort(F.collect_list("collection")).alias("c")).select(F.lit("catalog.json").alias("path"), F.to_json(F.struct(F.lit("Catalog").alias("type"), F.lit("1.0.0").alias("stac_version"), F.lit(catalog).alias("id"), F.transform("c", lambda x: F.struct(F.lit("child").alias("rel"), F.concat(x, F.lit("/collection.json")).alias("href"))).alias("links"))).alias("json"))
    return one.unionByName(group).unionByName(top)


def save_catalog(documents: DataFrame, folder: str) -> DataFrame:
    """Writes documents (path, json) as files below a folder, each by the task that holds it, and returns their paths."""
    from ..sources import files

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files.write_whole(f"{folder}/{path}", text.encode())
            yield batch.select(["path"])

    return documents.select("path", "json").mapInArrow(run, "path string")
