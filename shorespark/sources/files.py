"""Readers and writers of the file formats around the engine: GeoJSON, CSV, JSON, OSM XML and pixel tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<array<double>>"
FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


# --- GeoJSON -------------------------------------------------------------------------------------------------------


def features(documents: DataFrame, text: str) -> DataFrame:
    """properties (map), kind, lines (array of arrays of struct lon, lat) of all features of FeatureCollection texts.

    Points are lines of one vertex and polygons their rings, closing vertex included; multi-part kinds give one row
    with several lines. Null, unreadable and empty collections give no rows; unknown kinds have no lines.
    """
    doc = F.from_json(text, f"struct<type:string,features:array<{FEATURE}>>")
    f = documents.select(F.explode(doc["features"]).alias("f")).select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    vertex = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    flat = lambda a: F.transform(a, vertex)
    one = F.from_json("c", "array<double>")
    two = F.from_json("c", POINTS)
    three = F.from_json("c", f"array<{POINTS}>")
    four = F.from_json("c", f"array<array<{POINTS}>>")
    k = F.col("kind")
    lines = (
        F.when(k == "Point", F.array(F.array(vertex(one))))
        .when(k.isin("LineString", "MultiPoint"), F.array(flat(two)))
        .when(k.isin("MultiLineString", "Polygon"), F.transform(three, flat))
        .when(k == "MultiPolygon", F.transform(F.flatten(four), flat))
    )
    return f.select("properties", "kind", lines.alias("lines"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files (one collection each)."""
    return features(spark.read.text(path, wholetext=True), "value")


def single_line(df: DataFrame) -> DataFrame:
    """seq, lon, lat of the only feature, which must be a LineString; another count or kind is an error."""
    n = df.agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.first("lines").alias("lines"))
    ok = F.assert_true((F.col("n") == 1) & (F.col("kind") == "LineString"), F.lit("one LineString expected"))
    return n.select(F.when(ok.isNull(), F.col("lines")).alias("l")).select(F.posexplode(F.col("l")[0]).alias("seq", "p")).select("seq", "p.lon", "p.lat")


def feature_text(properties: list[str], kind: str, coordinates: Column) -> Column:
    """One GeoJSON feature as text from property columns and nested arrays of numbers; null properties are written."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})


def write_features(df: DataFrame, path: str, properties: list[str], kind: str, coordinates: Column) -> None:
    """Features as newline-delimited GeoJSON, written by all tasks; an earlier output is replaced."""
    df.select(feature_text(properties, kind, coordinates).alias("value")).write.mode("overwrite").text(path)


# --- tables --------------------------------------------------------------------------------------------------------

REQUIRED = ("event_id", "start_date", "end_date", "source_agency", "source_url", "affects_cartagena")  #: columns of an event file


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Storm events of a CSV with header, ordered by start and id, affects as BOOLEAN. Missing required columns, a
    missing date, an end before the start and a boolean other than true or false are errors."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    if missing := sorted(set(REQUIRED) - set(raw.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    said = F.lower(F.trim("affects_cartagena"))
    df = raw.withColumns({"start_date": F.to_date("start_date"), "end_date": F.to_date("end_date"), "affects_cartagena": F.when(said == "true", True).when(said == "false", False)})
    fine = F.assert_true(F.coalesce(F.col("end_date") >= F.col("start_date"), F.lit(False)), F.lit("an event ends before it starts or lacks a date"))
    known = F.assert_true(F.col("affects_cartagena").isNotNull(), F.lit("affects_cartagena must be true or false"))
    return df.where(fine.isNull() & known.isNull()).orderBy("start_date", "event_id")


SCENE = (
    "year int, item_id string, acquired_at string, cloud_cover_pct double, provider string, collection string, processing_level string, tile_code string, coverage_fraction double, "
    "green_asset string, nir_asset string, scl_asset string, product_asset string, requires_authentication boolean, item_url string, data_status string"
)


def catalogue_scenes(documents: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """The scenes of catalogue documents with the columns of SCENE and ordinal, their place in the document, which is the
    order that later steps keep within a year. Documents without scenes and unreadable ones give no rows."""
    doc = F.from_json(text, f"struct<scenes:array<struct<{SCENE.replace(', ', ',').replace(' ', ':')}>>>")
    return documents.select(*(keep or []), F.posexplode(doc["scenes"]).alias("ordinal", "s")).select(*(keep or []), "ordinal", "s.*")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The scenes of catalogue files (one document each), with their file and ordinal."""
    return catalogue_scenes(spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()), "value", ["file"])


def read_csv_or_error(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame | None, str | None]:
    """(rows, error): the rows of a CSV with header, or why there are none: no file, or the columns that it lacks."""
    try:
        df = spark.read.csv(path, header=True, encoding="UTF-8")
    except AnalysisException as e:
        return None, str(e).split("\n")[0]
    missing = [c for c in columns if c not in df.columns]
    return (None, f"missing columns: {', '.join(missing)}") if missing else (df, None)


def wave_days(documents: DataFrame, text: str) -> DataFrame:
    """day, height_m of JSON maps from day to height; a height that is no number or negative is an error."""
    m = documents.select(F.explode(F.from_json(text, "map<string,double>")).alias("day", "height_m"))
    fine = F.assert_true(F.coalesce(F.col("height_m") >= 0, F.lit(False)), F.lit("heights must be numbers from 0 on"))
    return m.where(fine.isNull())


def elevation_samples(documents: DataFrame, text: str) -> DataFrame:
    """station_id, offset_m, elevation_m of the samples of elevation documents; null elevations are left out."""
    doc = F.from_json(text, "struct<samples:array<struct<station_id:string,offset_m:int,elevation_m:double>>>")
    return documents.select(F.inline(doc["samples"])).where("elevation_m IS NOT NULL")


def read_json_or_error(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """value (struct) and error (text) of JSON files: never raises for unreadable content; null where there is no error."""
    raw = spark.read.text(path, wholetext=True)
    value = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    bad = F.col("value").isNull() | (F.length(F.trim("value")) == 0)
    df = raw.select(value.alias("v"), bad.alias("bad"), F.get_json_object("value", "$").isNull().alias("broken"))
    failed = F.col("bad") | F.col("broken")
    return df.select(F.when(~failed, F.col("v")).alias("value"), F.when(failed, F.lit("not a JSON object")).alias("error"))


# --- OpenStreetMap -------------------------------------------------------------------------------------------------


def osm_way(documents: DataFrame, text: str, way: int) -> DataFrame:
    """seq, node, lon, lat of a way's ring in OSM XML texts, in order. A node that is referred to but missing gives null
    coordinates; a way that is absent gives no rows."""
    ids = F.xpath(text, F.lit("/osm/node/@id"))
    lons, lats = F.xpath(text, F.lit("/osm/node/@lon")), F.xpath(text, F.lit("/osm/node/@lat"))
    nodes = documents.select(F.explode(F.arrays_zip(ids.alias("id"), lons.alias("lon"), lats.alias("lat"))).alias("n")).select(F.col("n.id").alias("node"), F.col("n.lon").cast("double").alias("lon"), F.col("n.lat").cast("double").alias("lat"))
    refs = documents.select(F.posexplode(F.xpath(text, F.lit(f"/osm/way[@id='{int(way)}']/nd/@ref"))).alias("seq", "node"))
    return refs.join(nodes.distinct(), "node", "left").select("seq", F.col("node").cast("long").alias("node"), "lon", "lat")


def way_checks(ring: DataFrame) -> DataFrame:
    """n_nodes, n_missing and closed of a way's ring."""
    return ring.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("lon").isNull()).alias("n_missing"), (F.min_by("node", "seq") == F.max_by("node", "seq")).alias("closed"))


def tagged_ring(documents: DataFrame, text: str, way: int, key: str = "natural", value: str = "beach") -> DataFrame:
    """seq, node, lon, lat of a way that must have the tag, know all its nodes and be closed; anything else is an error."""
    ring = osm_way(documents, text, way)
    tags = documents.select(F.explode(F.xpath(text, F.lit(f"/osm/way[@id='{int(way)}']/tag[@k='{key}']/@v"))).alias("v")).agg(F.coalesce(F.bool_or(F.col("v") == value), F.lit(False)).alias("fits"))
    fine = F.assert_true(F.col("fits"), F.lit(f"the way is not tagged {key}={value}"))
    whole = F.assert_true((F.col("n_missing") == 0) & F.col("closed") & (F.col("n_nodes") > 3), F.lit("the way is open or lacks nodes"))
    ok = way_checks(ring).crossJoin(F.broadcast(tags)).where(fine.isNull() & whole.isNull()).select(F.lit(True).alias("_ok"))  # one row each
    return ring.crossJoin(F.broadcast(ok)).drop("_ok")


OVERPASS = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>,members:array<struct<role:string,geometry:array<struct<lon:double,lat:double>>>>>>>"


def overpass(documents: DataFrame, text: str) -> DataFrame:
    """osm_id ('way/1'), feature_type ('building' or 'road'), kind, name and line (array of struct lon, lat).

    Buildings are ways or outer members of relations tagged building, closed where needed, of at least four vertices;
    roads are ways tagged highway of at least two. Other and too short elements give no rows.
    """
    e = documents.select(F.explode(F.from_json(text, OVERPASS)["elements"]).alias("e")).select("e.*")
    outer = F.filter("members", lambda m: (m["role"] == "outer") & m["geometry"].isNotNull())
    lines = F.when(F.col("type") == "relation", F.transform(outer, lambda m: m["geometry"])).otherwise(F.array("geometry"))
    tag = lambda n: F.try_element_at("tags", F.lit(n))
    e = e.select(F.concat_ws("/", "type", "id").alias("osm_id"), tag("building").alias("building"), tag("highway").alias("highway"), tag("name").alias("name"), F.posexplode(lines).alias("part", "line")).where("line IS NOT NULL")
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    ring = F.when((first["lon"] == last["lon"]) & (first["lat"] == last["lat"]), F.col("line")).otherwise(F.concat("line", F.array(first)))
    n = F.size("line")
    b = e.where(F.col("building").isNotNull() & (n > 2)).withColumn("line", ring).where(F.size("line") >= 4)
    r = e.where(F.col("building").isNull() & F.col("highway").isNotNull() & (n > 1))
    of = lambda d, t, k: d.select("osm_id", F.lit(t).alias("feature_type"), F.col(k).alias("kind"), "name", "part", "line")
    return of(b, "building", "building").unionByName(of(r, "road", "highway"))


def overpass_outlines(documents: DataFrame, text: str) -> DataFrame:
    """osm_id, ring and line (array of struct lon, lat, closed) of the outer rings of relations tagged building, whose outer
    ways are put together end to end (`lines.closed_rings`); members without a role are outer too. Ways that close no ring
    give no rows. The relations' ids must be unique."""
    from shorespark.operators.lines import closed_rings

    e = documents.select(F.explode(F.from_json(text, OVERPASS)["elements"]).alias("e")).select("e.*").where((F.col("type") == "relation") & F.try_element_at("tags", F.lit("building")).isNotNull())
    ways = F.filter("members", lambda m: F.coalesce(m["role"], F.lit("outer")).isin("", "outer") & (F.size(m["geometry"]) > 1))
    e = e.select(F.concat_ws("/", "type", "id").alias("line"), F.transform(ways, lambda m: m["geometry"]).alias("g"))
    end = lambda g, i, c: F.element_at(g, i)[c]
    whole = lambda g: (end(g, 1, "lon") + end(g, 1, "lat") + end(g, -1, "lon") + end(g, -1, "lat")).isNotNull()
    e = e.withColumn("g", F.filter("g", whole)).where(F.size("g") > 0)
    ends = F.transform("g", lambda g: F.array(end(g, 1, "lon"), end(g, 1, "lat"), end(g, -1, "lon"), end(g, -1, "lat")))
    # a relation's ways come and stay in one row: nothing is shuffled, joined or broadcast
    r = closed_rings(e.withColumn("ends", ends), "ends", "rings").select("line", "g", F.posexplode("rings").alias("ring", "ways"))
    way = lambda w: F.when(w["turned"], F.reverse(F.get("g", w["part"]))).otherwise(F.get("g", w["part"]))
    # the first vertex of each way is the last one of the way before; the ring closes on its first vertex
    inner = F.flatten(F.transform("ways", lambda w: F.slice(way(w), 1, F.size(way(w)) - 1)))
    return r.select(F.col("line").alias("osm_id"), "ring", inner.alias("line")).select("osm_id", "ring", F.concat("line", F.slice("line", 1, 1)).alias("line")).where(F.size("line") >= 4)


def overpass_query(south: float, west: float, north: float, east: float, timeout: int = 60) -> str:
    """Text of a request for the buildings and roads of a box; the box must have an area and lie on the globe."""
    if not (-90 <= south < north <= 90 and -180 <= west < east <= 180):
        raise ValueError("bounds must satisfy south < north and west < east")
    box = f"({south},{west},{north},{east})"
    wanted = "".join(f"{what}{box};" for what in ('way["building"]', 'relation["building"]', 'way["highway"]'))
    return f"[out:json][timeout:{timeout}];({wanted});out tags geom;"


# --- pixels --------------------------------------------------------------------------------------------------------


def write_pixels(pixels: DataFrame, path: str, by: str = "item_id") -> None:
    """A pixel table partitioned by item and sorted by row and column inside, so that windows prune files and groups.
    Only the items written are replaced."""
    sorted_ = pixels.repartition(F.col(by), F.floor(F.col("row") / 512)).sortWithinPartitions(by, "row", "col")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The pixels of a window, both ends included; the bounds reach the scan."""
    return spark.read.parquet(path).where(F.col("row").between(*rows) & F.col("col").between(*cols))


def cached_pixels(spark: SparkSession, path: str, item: str, threshold: float) -> DataFrame:
    """Cached index pixels of an item; an error if there are none or they were made for another threshold."""
    df = spark.read.parquet(path).where(F.col("item_id") == item)
    if df.isEmpty():
        raise ValueError(f"no cached pixels of {item}")
    same = F.assert_true(F.col("threshold") == threshold, F.lit("cached for another threshold"))
    return df.where(same.isNull())


def resampled_bands(target: DataFrame, source: DataFrame, value: str, scale: float, nearest: bool) -> DataFrame:
    """Target cells (row, col) with the value of a coarser source grid whose cells are `scale` target cells wide: the
    nearest cell, or bilinear between the four centres around, weights of absent cells left out."""
    pos = lambda c: (F.col(c) + 0.5) / scale - 0.5
    if nearest:
        t = target.select("row", "col", F.floor((F.col("row") + 0.5) / scale).alias("r"), F.floor((F.col("col") + 0.5) / scale).alias("c"))
        s = source.select(F.col("row").alias("r"), F.col("col").alias("c"), value)
        return t.join(s, ["r", "c"], "left").select("row", "col", value)
    t = target.select("row", "col", pos("row").alias("pr"), pos("col").alias("pc"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k"))
    t = t.select("row", "col", (F.floor("pr") + F.col("k.a")).alias("r"), (F.floor("pc") + F.col("k.b")).alias("c"), ((1 - F.abs(F.floor("pr") + F.col("k.a") - F.col("pr"))) * (1 - F.abs(F.floor("pc") + F.col("k.b") - F.col("pc")))).alias("w"))
    j = t.join(source.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).cast("double").alias("v")), ["r", "c"]).where("v IS NOT NULL")
    return target.select("row", "col").join(j.groupBy("row", "col").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias(value)), ["row", "col"], "left")


def write_table(df: DataFrame, path: str, drop: list[str] | None = None) -> None:
    """CSV with header, without nested or dropped columns; an earlier output is replaced."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.drop(*nested, *(drop or [])).write.mode("overwrite").csv(path, header=True)


def write_document(rows: DataFrame, path: str) -> None:
    """Small results as JSON documents, one per row, nulls written; published by the commit protocol as a whole."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
