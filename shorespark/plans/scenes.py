"""Queries of the raster, catalogue, source and text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorespark.functions.geo import same_longitude
from shorespark.operators import catalog, polygons, quality, raster, text
from shorespark.plans.coast import rounded
from shorespark.sources import files
from shorespark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- raster: order lines as pixels ---------------------------------------------------------------------------------

PIXEL_SQL = "px AS (SELECT l_orderkey, l_linenumber AS scl, CAST(l_extendedprice * (1 - l_discount) AS FLOAT) AS green, CAST(l_extendedprice * l_tax * 25 AS FLOAT) AS nir, l_returnflag AS zone FROM lineitem), ix AS (SELECT *, CASE WHEN green > 0 AND nir > 0 AND scl NOT IN (0, 1, 3, 8, 9, 10, 11) THEN (green - nir) / nullif(green + nir, 0) END AS v FROM px)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    p = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("scl"), (price * (1 - F.col("l_discount"))).cast("float").alias("green"), (price * F.col("l_tax") * 25).cast("float").alias("nir"), F.col("l_returnflag").alias("zone"))
    g, n = F.col("green"), F.col("nir")
    return p.withColumn("v", raster.ndwi(g, n, raster.valid_pixel(g, n, F.col("scl"))))


@query(f"WITH {PIXEL_SQL} SELECT l_orderkey, scl, round(CAST(v AS DOUBLE), 4) + 0.0 AS ndwi FROM ix")
def ndwi_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("l_orderkey", "scl", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("ndwi"))


@query(f"WITH {PIXEL_SQL} SELECT scl, count(*) AS n, count(v) AS n_valid, count(*) FILTER (v > 0) AS n_water FROM ix GROUP BY 1")
def ndwi_water_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).groupBy("scl").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), F.count_if(raster.water(F.col("v"))).alias("n_water"))


@query(f"WITH {PIXEL_SQL} SELECT zone, round(min(CAST(v AS DOUBLE)), 4) + 0.0 AS v_min, round(avg(CAST(v AS DOUBLE)), 4) + 0.0 AS v_mean, round(max(CAST(v AS DOUBLE)), 4) + 0.0 AS v_max, round(stddev_pop(CAST(v AS DOUBLE)), 4) + 0.0 AS v_std, count(v) AS n FROM ix GROUP BY 1")
def ndwi_zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.zonal(_pixels(spark, d), ["zone"], "v"))


@query("WITH m AS (SELECT l_partkey AS cell, l_orderkey * 8 + l_linenumber AS scene, l_quantity > 25 AS wet FROM lineitem) SELECT cell, count(*) FILTER (wet) AS votes, count(DISTINCT scene) AS n_scenes, count(*) FILTER (wet) >= count(DISTINCT scene) // 2 + 1 AS water FROM m GROUP BY 1")
def strict_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cell"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scene"), (F.col("l_quantity") > 25).alias("wet"))
    return raster.majority(m, ["cell"], "scene", "wet")


MASK_SQL = """g AS (SELECT DISTINCT CAST(l_orderkey % 16 AS BIGINT) AS tile, CAST(l_partkey % 40 AS BIGINT) AS "row", CAST(l_suppkey % 40 AS BIGINT) AS col FROM lineitem),
m AS (SELECT DISTINCT CAST(l_orderkey % 16 AS BIGINT) AS tile, CAST(l_partkey % 40 AS BIGINT) AS "row", CAST(l_suppkey % 40 AS BIGINT) AS col FROM lineitem WHERE l_quantity > 10)"""


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells of 16 tiles of 40 x 40 that have a line, and the set ones among them."""
    li = table(spark, d, "lineitem")
    cells = lambda x: x.select((F.col("l_orderkey") % 16).alias("tile"), (F.col("l_partkey") % 40).alias("row"), (F.col("l_suppkey") % 40).alias("col")).distinct()
    return cells(li), cells(li.where("l_quantity > 10"))


def _step_sql(src: str, out: str, need: int) -> str:
    return f"{out} AS (SELECT g.tile, g.\"row\", g.col FROM g JOIN {src} s ON s.tile = g.tile AND abs(s.\"row\" - g.\"row\") <= 1 AND abs(s.col - g.col) <= 1 GROUP BY 1, 2, 3 HAVING count(*) >= {need})"


@query(f"WITH {MASK_SQL}, {_step_sql('m', 'e1', 9)}, {_step_sql('e1', 'd1', 1)}, {_step_sql('d1', 'd2', 1)}, {_step_sql('d2', 'e2', 9)} SELECT tile, \"row\", col FROM e2")
def morphology_open_close(spark: SparkSession, d: str) -> DataFrame:
    grid, mask = _grid(spark, d)
    return raster.opened_closed(mask, grid, "tile")


TILE_SQL = """c AS (SELECT l_orderkey // 1600 AS tile, l_orderkey % 1600 // 40 AS "row", l_orderkey % 40 AS col, avg(l_quantity) AS q FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT tile, "row", col FROM c), m AS (SELECT tile, "row", col FROM c WHERE q > 10 + 30 * col / 40.0)"""


def _tiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A cell per order, 1600 keys making a tile of 40 x 40, and the set ones: mean quantities above a bound that grows
    with the column, about half of all at any size, dense on one side and sparse on the other."""
    k = F.col("l_orderkey")
    c = table(spark, d, "lineitem").where(k.isNotNull()).groupBy(F.expr("l_orderkey div 1600").alias("tile"), F.expr("l_orderkey % 1600 div 40").alias("row"), (k % 40).alias("col")).agg(F.avg("l_quantity").alias("q"))
    cells = lambda x: x.select("tile", "row", "col")
    return cells(c), cells(c.where(F.col("q") > 10 + 30 * F.col("col") / 40.0))


@query(f"WITH {TILE_SQL}, {_step_sql('m', 'e1', 9)}, {_step_sql('e1', 'd1', 1)}, {_step_sql('d1', 'd2', 1)}, {_step_sql('d2', 'e2', 9)} SELECT tile, \"row\", col FROM e2")
def tile_open_close(spark: SparkSession, d: str) -> DataFrame:
    """Opening and closing over tiles whose number grows with the table; morphology_open_close keeps its 16."""
    grid, mask = _tiles(spark, d)
    return raster.opened_closed(mask, grid, "tile")


_COMPONENTS = f"""WITH RECURSIVE {TILE_SQL}, r(tile, "row", col, c) USING KEY (tile, "row", col) AS (SELECT tile, "row", col, "row" * 2147483648 + col FROM m UNION
SELECT m.tile, m."row", m.col, min(n.c) FROM m JOIN r n ON n.tile = m.tile AND abs(n."row" - m."row") + abs(n.col - m.col) = 1 JOIN recurring.r o ON o.tile = m.tile AND o."row" = m."row" AND o.col = m.col GROUP BY m.tile, m."row", m.col, o.c HAVING min(n.c) < o.c)"""


@query(f'{_COMPONENTS} SELECT tile, "row", col, c AS component FROM r')
def water_components(spark: SparkSession, d: str) -> DataFrame:
    return raster.components(_tiles(spark, d)[1], "tile")


@query(f"""{_COMPONENTS}, fr AS (SELECT tile, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM g GROUP BY 1),
z AS (SELECT tile, c, count(*) AS n, bool_or("row" IN (r0, r1) OR col IN (c0, c1)) AS edge FROM r JOIN fr USING (tile) GROUP BY 1, 2 HAVING count(*) >= 80),
b AS (SELECT tile, arg_max(c, (CAST(edge AS INTEGER), n, -c)) AS c FROM z GROUP BY 1) SELECT r.tile, r."row", r.col, r.c AS component FROM r JOIN b ON b.tile = r.tile AND b.c = r.c""")
def main_component(spark: SparkSession, d: str) -> DataFrame:
    grid, mask = _tiles(spark, d)
    return raster.main_component(raster.components(mask, "tile"), grid, "tile")


@query(f"WITH {MASK_SQL}, a AS (SELECT tile, count(*) AS n FROM m GROUP BY 1), i AS (SELECT m.tile, count(*) AS k FROM m JOIN m o ON o.tile = m.tile AND ((o.\"row\" = m.\"row\" + 1 AND o.col = m.col) OR (o.\"row\" = m.\"row\" AND o.col = m.col + 1)) GROUP BY 1) SELECT a.tile, CAST((4 * n - 2 * coalesce(k, 0)) * 10 AS DOUBLE) AS perimeter_m FROM a LEFT JOIN i USING (tile)")
def mask_outline(spark: SparkSession, d: str) -> DataFrame:
    s = raster.outline(_grid(spark, d)[1], "tile", 10.0)
    return s.groupBy("tile").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter_m"))


@query(f"""WITH {TILE_SQL}, s AS (SELECT tile, unnest([{{'r': "row" - 1, 'c': col, 'ra': "row", 'ca': col, 'rb': "row", 'cb': col + 1}}, {{'r': "row" + 1, 'c': col, 'ra': "row" + 1, 'ca': col, 'rb': "row" + 1, 'cb': col + 1}}, {{'r': "row", 'c': col - 1, 'ra': "row", 'ca': col, 'rb': "row" + 1, 'cb': col}}, {{'r': "row", 'c': col + 1, 'ra': "row", 'ca': col + 1, 'rb': "row" + 1, 'cb': col + 1}}]) AS q FROM m)
SELECT s.tile, q.ca * 10.0::DOUBLE AS x1, q.ra * 10.0::DOUBLE AS y1, q.cb * 10.0::DOUBLE AS x2, q.rb * 10.0::DOUBLE AS y2 FROM s ANTI JOIN m ON m.tile = s.tile AND m."row" = q.r AND m.col = q.c""")
def tile_outline(spark: SparkSession, d: str) -> DataFrame:
    """The sides of the outlines over tiles whose number grows with the table; mask_outline keeps its 16 and sums them."""
    return raster.outline(_tiles(spark, d)[1], "tile", 10.0).select("tile", "x1", "y1", "x2", "y2")


@query(f"""{_COMPONENTS}, n AS (SELECT tile, count(*) AS n_cells FROM m GROUP BY 1), k AS (SELECT tile, count(DISTINCT c) AS n_outer FROM r GROUP BY 1),
e AS (SELECT m.tile, 4 * count(*) AS s FROM m GROUP BY 1), i AS (SELECT m.tile, count(*) AS k FROM m JOIN m o ON o.tile = m.tile AND ((o."row" = m."row" + 1 AND o.col = m.col) OR (o."row" = m."row" AND o.col = m.col + 1)) GROUP BY 1)
SELECT tile, n_outer, s - 2 * coalesce(k, 0) AS n_sides, n_cells * 100.0::DOUBLE AS area_m2 FROM n JOIN k USING (tile) JOIN e USING (tile) LEFT JOIN i USING (tile)""")
def tile_rings(spark: SparkSession, d: str) -> DataFrame:
    """Per tile the outer rings of its set cells, the sides of all rings and their area less the holes."""
    s = raster.rings(_tiles(spark, d)[1], "tile", 10.0)
    n = s.groupBy("tile").agg(F.count("*").alias("n_sides"))
    a = raster.ring_areas(s, "tile").groupBy("tile").agg(F.count_if(F.col("area") > 0).alias("n_outer"), F.sum("area").alias("area_m2"))
    return n.join(a, "tile").select("tile", "n_outer", "n_sides", "area_m2")


@query(f"""WITH {TILE_SQL}, z(zone, xa, ya, xb, yb, xc, yc) AS (VALUES ('low', 0.3, 0.2, 39.7, 0.4, 0.3, 38.9), ('high', 5.2, 39.6, 39.8, 5.1, 39.9, 39.7)),
k AS (SELECT zone, q, sign((xb - xa) * ("row" + 0.5 - ya) - (yb - ya) * (col + 0.5 - xa)) AS a, sign((xc - xb) * ("row" + 0.5 - yb) - (yc - yb) * (col + 0.5 - xb)) AS b, sign((xa - xc) * ("row" + 0.5 - yc) - (ya - yc) * (col + 0.5 - xc)) AS d FROM c CROSS JOIN z)
SELECT zone, round(min(q), 4) AS v_min, round(avg(q), 4) AS v_mean, round(max(q), 4) AS v_max, round(stddev_pop(q), 4) AS v_std, count(*) AS n FROM k WHERE a = b AND b = d GROUP BY 1""")
def polygon_zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean quantities of the orders' cells under two triangles that lie on every tile."""
    k = F.col("l_orderkey")
    c = table(spark, d, "lineitem").where(k.isNotNull()).groupBy(k.alias("k")).agg(F.avg("l_quantity").alias("q"))
    px = c.select((F.expr("k % 40") + 0.5).alias("x"), (F.expr("k % 1600 div 40") + 0.5).alias("y"), "q")
    zones = spark.createDataFrame([("low", [0.3, 39.7, 0.3], [0.2, 0.4, 38.9]), ("high", [5.2, 39.8, 39.9], [39.6, 5.1, 39.7])], "zone string, xs array<double>, ys array<double>")
    return rounded(raster.zonal_by_polygon(px, zones, "zone", "q"))


def _quads(spark: SparkSession, d: str) -> DataFrame:
    """A four-sided polygon per supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") + 5.3).alias("w"), (F.pmod(F.col("s_suppkey"), F.lit(17)) + 4.7).alias("h"))
    return s.select("k", "w", "h", F.array(F.lit(0.0), F.col("w"), F.col("w") + 3.0, F.lit(2.0)).alias("xs"), F.array(F.lit(0.0), F.lit(1.0), F.col("h"), F.col("h") + 2.0).alias("ys"))


QUAD_SQL = "q AS (SELECT s_suppkey AS k, s_nationkey + 5.3 AS w, s_suppkey % 17 + 4.7 AS h FROM supplier), sides AS (SELECT k, unnest([{'xa': 0.0, 'ya': 0.0, 'xb': w, 'yb': 1.0}, {'xa': w, 'ya': 1.0, 'xb': w + 3.0, 'yb': h}, {'xa': w + 3.0, 'ya': h, 'xb': 2.0, 'yb': h + 2.0}, {'xa': 2.0, 'ya': h + 2.0, 'xb': 0.0, 'yb': 0.0}]) AS s FROM q)"


@query(f"WITH {QUAD_SQL}, c AS (SELECT k, r AS \"row\", c AS col, r + 0.5 AS y, c + 0.5 AS x FROM q, range(40) a(r), range(60) b(c)), h AS (SELECT c.k, c.\"row\", c.col, count(*) AS n FROM c JOIN sides ON sides.k = c.k AND (s.ya > y) <> (s.yb > y) AND x < s.xa + (y - s.ya) / (s.yb - s.ya) * (s.xb - s.xa) GROUP BY 1, 2, 3) SELECT k, \"row\", col FROM h WHERE n % 2 = 1")
def rasterize_polygons(spark: SparkSession, d: str) -> DataFrame:
    return raster.rasterised(_quads(spark, d), "k", 1.0).select("k", F.col("row").cast("long"), F.col("col").cast("long"))


@query(f"WITH {QUAD_SQL}, a AS (SELECT k, sum(s.xa * s.yb - s.xb * s.ya) / 2 AS a, sum((s.xa + s.xb) * (s.xa * s.yb - s.xb * s.ya)) AS cx, sum((s.ya + s.yb) * (s.xa * s.yb - s.xb * s.ya)) AS cy FROM sides GROUP BY 1) SELECT k, round(abs(a), 4) AS area, round(cx / (6 * a), 4) AS cx, round(cy / (6 * a), 4) AS cy FROM a")
def polygon_area_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = polygons.centroid(F.col("xs"), F.col("ys"))
    return rounded(_quads(spark, d).select("k", F.abs(polygons.signed_area(F.col("xs"), F.col("ys"))).alias("area"), c["x"].alias("cx"), c["y"].alias("cy")))


@query("SELECT s_suppkey AS k, round(least(8, s_nationkey + 3.5) * least(6, s_suppkey % 17 + 1.5) / 48, 6) AS coverage FROM supplier")
def scene_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") + 3.5).alias("w"), (F.pmod(F.col("s_suppkey"), F.lit(17)) + 1.5).alias("h"))
    s = s.withColumns({"xs": F.array(F.lit(0.0), F.col("w"), F.col("w"), F.lit(0.0)), "ys": F.array(F.lit(0.0), F.lit(0.0), F.col("h"), F.col("h"))})
    return polygons.coverage(s, "xs", "ys", F.lit(0.0), F.lit(0.0), F.lit(8.0), F.lit(6.0), "coverage").select("k", "coverage")


@query("""WITH w AS (SELECT CAST(floor(sqrt(max(p_partkey))) AS BIGINT) + 1 AS w FROM part), s AS (SELECT p_partkey // w AS r, p_partkey % w AS c, p_retailprice AS v FROM part, w),
t AS (SELECT r * 2 + i AS "row", c * 2 + j AS col FROM s, range(2) a(i), range(2) b(j)), p AS (SELECT "row", col, ("row" + 0.5) / 2 - 0.5 AS pr, (col + 0.5) / 2 - 0.5 AS pc FROM t),
k AS (SELECT "row", col, pr, pc, CAST(floor(pr) AS BIGINT) + i AS r, CAST(floor(pc) AS BIGINT) + j AS c FROM p, range(2) a(i), range(2) b(j))
SELECT "row", col, round(sum(v * (1 - abs(r - pr)) * (1 - abs(c - pc))) / sum((1 - abs(r - pr)) * (1 - abs(c - pc))), 4) + 0.0 AS p_retailprice FROM k JOIN s USING (r, c) GROUP BY 1, 2""")
def band_resampling(spark: SparkSession, d: str) -> DataFrame:
    """A coarse band of all parts, laid out in a square by key, brought to a grid of half its cell size, bilinear."""
    p = table(spark, d, "part").where("p_partkey IS NOT NULL")
    wide = p.agg((F.floor(F.sqrt(F.max("p_partkey"))) + 1).alias("w"))  # one row
    coarse = p.crossJoin(F.broadcast(wide)).select(F.floor(F.col("p_partkey") / F.col("w")).alias("row"), (F.col("p_partkey") % F.col("w")).alias("col"), "p_retailprice")
    four = F.explode(F.array(*[F.struct((F.col("row") * 2 + i).alias("row"), (F.col("col") * 2 + j).alias("col")) for i in (0, 1) for j in (0, 1)]))
    grid = coarse.select("row", "col").distinct().select(four.alias("k")).select("k.row", "k.col")
    return rounded(files.resampled_bands(grid, coarse, "p_retailprice", 2.0, False))


# --- catalogue: orders as scenes -----------------------------------------------------------------------------------

SCENE_SQL = "sc AS (SELECT o_orderkey AS ordinal, CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey % 50 AS grp, o_orderdate AS t, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice % 100 END AS cloud, 0.9 + (o_orderkey % 11) / 100.0 AS coverage FROM orders)"


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 50).alias("grp"), F.col("o_orderdate").alias("t"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") % 100).alias("cloud"), (0.9 + (F.col("o_orderkey") % 11) / 100.0).alias("coverage"),
    )


_DEDUPED = f"{SCENE_SQL}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, y, t ORDER BY coverage DESC, coalesce(cloud, 999), ordinal) AS n FROM sc) WHERE n = 1)"


@query(f"WITH {_DEDUPED}, w AS (SELECT *, max(CAST(coverage >= 0.98 AS INTEGER)) OVER (PARTITION BY grp, y) AS has FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY grp, y ORDER BY coalesce(cloud, 999), coverage DESC, t, ordinal) AS r FROM w WHERE has = 0 OR coverage >= 0.98) SELECT grp, y, CAST(r AS INTEGER) AS rank, ordinal FROM k WHERE r <= 3")
def scene_dedupe_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    u = catalog.deduplicated(_scenes(spark, d), ["grp", "y"], "t", "coverage", "cloud", "ordinal")
    return catalog.ranked(u, ["grp", "y"], "t", "coverage", "cloud", "ordinal", 3).select("grp", "y", "rank", "ordinal")


@query(f"WITH {SCENE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, y ORDER BY t, ordinal) AS i, count(*) OVER (PARTITION BY grp, y) AS n FROM sc) SELECT grp, y, n, ordinal FROM r WHERE i = n // 2 + 1")
def scene_representative(spark: SparkSession, d: str) -> DataFrame:
    return catalog.representative(_scenes(spark, d), ["grp", "y"], "t", "ordinal").select("grp", "y", "n", "ordinal")


@query(f"WITH {SCENE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, y ORDER BY ordinal) AS i FROM sc) SELECT grp, y, CAST(i AS INTEGER) AS rank, ordinal FROM r WHERE i <= 2")
def catalog_first_candidates(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_candidates(_scenes(spark, d), ["grp", "y"], "ordinal", 2).select("grp", "y", "rank", "ordinal")


@query("SELECT CAST(i AS INTEGER) AS missing_year FROM range(1990, 2011) r(i) WHERE i NOT IN (SELECT year(o_orderdate) FROM orders)")
def catalog_missing_years(spark: SparkSession, d: str) -> DataFrame:
    return catalog.missing_years(_scenes(spark, d), "y", 1990, 2010)


@query(f"WITH {SCENE_SQL}, o AS (SELECT *, coalesce(cloud <= 5, true) AS ok FROM sc), g AS (SELECT *, bool_or(ok) OVER (PARTITION BY grp, y) AS has, row_number() OVER (PARTITION BY grp, y ORDER BY coalesce(cloud, 999), coverage DESC, t, ordinal) AS r FROM o) SELECT ordinal, grp, y, CASE WHEN ok THEN 'accepted' ELSE 'fallback_above_limit' END AS status FROM g WHERE ok OR (NOT has AND r = 1)")
def catalog_cloud_fallback(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_fallback(_scenes(spark, d), ["grp", "y"], "cloud", "coverage", "t", "ordinal", 5.0).select("ordinal", "grp", "y", "status")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey % 50 AS grp, count(*) AS scene_count, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1, 2")
def catalog_document(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 50).alias("grp"), "o_orderkey", "o_orderpriority", "o_totalprice")
    doc = catalog.document(s, ["y", "grp"], "y", {"priorities": "o_orderpriority"}, ["o_orderkey", "o_totalprice"], "o_orderkey")
    return doc.select("y", "grp", "scene_count", F.array_join("priorities", ";").alias("priorities"))


@query("""WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'earth-search' WHEN 1 THEN 'earth-search-l1c' WHEN 2 THEN 'copernicus-data-space' ELSE 'elsewhere' END AS provider, o_orderkey % 7 = 0 AS bare, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CAST(y AS INTEGER) AS scene_year, provider, CASE provider WHEN 'earth-search' THEN 'sentinel-2-l2a' WHEN 'earth-search-l1c' THEN 'sentinel-s2-l1c' WHEN 'copernicus-data-space' THEN 'named' END AS collection, CASE provider WHEN 'earth-search' THEN 'L2A' WHEN 'elsewhere' THEN NULL ELSE 'L1C' END AS level,
CASE provider WHEN 'earth-search' THEN '/g' WHEN 'earth-search-l1c' THEN 'https://sentinel-s2-l1c.s3.eu-central-1.amazonaws.com/' || o_orderkey || '/g' WHEN 'copernicus-data-space' THEN '/b3' END AS href_green, CASE provider WHEN 'copernicus-data-space' THEN '/product' END AS href_product,
CASE provider WHEN 'copernicus-data-space' THEN true WHEN 'elsewhere' THEN NULL ELSE false END AS needs_auth, CASE WHEN provider = 'elsewhere' THEN 'unknown_provider' WHEN bare THEN 'incomplete' WHEN provider = 'earth-search' THEN 'public_cog_ready' WHEN provider = 'earth-search-l1c' THEN 'public_l1c_jp2_ready' ELSE 'catalogued_auth_download_required' END AS status FROM k""")
def stac_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items of three known providers and an unknown one; every seventh has no near-infrared asset."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    n = F.col("o_orderkey") % 4
    provider = F.when(n == 0, "earth-search").when(n == 1, "earth-search-l1c").when(n == 2, "copernicus-data-space").otherwise("elsewhere")
    ref = lambda c: F.struct(c.alias("href"))
    green = F.when(n == 1, F.concat(F.lit("s3://sentinel-s2-l1c/"), k, F.lit("/g"))).otherwise("/g")
    nir = F.when(F.col("o_orderkey") % 7 != 0, k)
    assets = F.create_map(F.lit("green"), ref(green), F.lit("B03"), ref(F.lit("/b3")), F.lit("nir"), ref(nir), F.lit("Product"), ref(F.lit("/product")))
    links = F.array(F.struct(F.lit("self").alias("rel"), k.alias("href")))
    when = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    items = o.select(k.alias("id"), F.when(n == 2, "named").alias("collection"), F.create_map(F.when(F.col("o_orderkey") % 5 == 0, "start_datetime").otherwise("datetime"), when).alias("properties"), assets.alias("assets"), links.alias("links"), provider.alias("provider"))
    got = catalog.stac_items(items)
    return got.select(F.col("item_id").cast("long").alias("o_orderkey"), "scene_year", "provider", "collection", "level", "href_green", "href_product", "needs_auth", "status")


@query("SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY o_orderkey) - 1 AS INTEGER) AS ordinal, CAST(year(o_orderdate) AS INTEGER) AS scene_year, 'i' || o_orderkey AS item_id, CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice % 100, 4) END AS cloud_cover_pct FROM (SELECT *, o_custkey % 50 AS grp FROM orders)")
def catalogue_reader(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as catalogue documents, one for each fiftieth of the customers, and read again in their order."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("grp"), "o_orderkey", F.struct(F.year("o_orderdate").alias("year"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("item_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") % 100).alias("cloud_cover_pct")).alias("s"))
    docs = o.groupBy("grp").agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "s"))), lambda x: x["s"]).alias("scenes"))).alias("text"))
    return files.catalogue_scenes(docs, "text", ["grp"]).select("grp", "ordinal", F.col("year").alias("scene_year"), "item_id", F.round("cloud_cover_pct", 4).alias("cloud_cover_pct"))


# --- sources -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT transect_id, round(seaward_lon, 7) AS lon1, round(seaward_lat, 7) AS lat1, round(landward_lon, 7) AS lon2, round(landward_lat, 7) AS lat2 FROM transects")
def geojson_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Transects written as GeoJSON features, a collection per beach, and read again."""
    t = table(spark, d, "transects")
    line = F.array(F.array("seaward_lon", "seaward_lat"), F.array("landward_lon", "landward_lat"))
    f = t.select("beach_code", files.feature_text(["transect_id"], "LineString", line).alias("f"))
    docs = f.groupBy("beach_code").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("text"))
    p = F.col("lines")[0]
    return rounded(files.features(docs, "text").select(F.col("properties")["transect_id"].alias("transect_id"), p[0]["lon"].alias("lon1"), p[0]["lat"].alias("lat1"), p[1]["lon"].alias("lon2"), p[1]["lat"].alias("lat2")), 7)


@query("SELECT lower(trim(osm_id)) AS osm_id, count(*) AS n, CAST(5 AS BIGINT) AS n_vertices, round(min(longitude), 7) AS lon, round(min(latitude), 7) AS lat FROM buildings_risk GROUP BY 1")
def overpass_features(spark: SparkSession, d: str) -> DataFrame:
    """Building rows written as elements of responses and parsed again, by id: their number, vertices and place."""
    b = table(spark, d, "buildings_risk").select(F.split(F.lower(F.trim("osm_id")), "/").alias("o"), same_longitude(F.col("longitude")).alias("lon"), F.col("latitude").alias("lat"), "delivery_id")
    at = lambda i, j: F.struct((F.col("lon") + i * 1e-4).alias("lon"), (F.col("lat") + j * 1e-4).alias("lat"))
    ring = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))
    way = F.col("o")[0] == "way"
    e = F.struct(F.col("o")[0].alias("type"), F.col("o")[1].cast("long").alias("id"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"), F.when(way, ring).alias("geometry"), F.when(~way, F.array(F.struct(F.lit("outer").alias("role"), ring.alias("geometry")))).alias("members"))
    docs = b.groupBy((F.col("delivery_id") % 500).alias("g")).agg(F.to_json(F.struct(F.collect_list(e).alias("elements"))).alias("text"))
    got = files.overpass(docs, "text").withColumns({"lon": F.array_min(F.transform("line", lambda p: p["lon"])), "lat": F.array_min(F.transform("line", lambda p: p["lat"]))})
    return got.groupBy("osm_id").agg(F.count("*").alias("n"), F.max(F.size("line")).cast("long").alias("n_vertices"), F.round(F.min("lon"), 7).alias("lon"), F.round(F.min("lat"), 7).alias("lat"))


@query("SELECT 'relation/' || delivery_id AS osm_id, CAST(5 AS BIGINT) AS n, round(longitude, 7) AS lon, round(latitude, 7) AS lat FROM buildings_risk")
def overpass_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Building rows as relations whose outline comes in two ways, one turned round, put together again."""
    b = table(spark, d, "buildings_risk").select("delivery_id", same_longitude(F.col("longitude")).alias("lon"), F.col("latitude").alias("lat"))
    at = lambda i, j: F.struct((F.col("lon") + i * 1e-4).alias("lon"), (F.col("lat") + j * 1e-4).alias("lat"))
    way = lambda role, *p: F.struct(F.lit(role).alias("role"), F.array(*p).alias("geometry"))
    members = F.array(way("outer", at(0, 0), at(1, 0), at(1, 1)), way("", at(0, 0), at(0, 1), at(1, 1)), way("inner", at(0, 0), at(1, 1)))
    e = F.struct(F.lit("relation").alias("type"), F.col("delivery_id").alias("id"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"), members.alias("members"))
    docs = b.groupBy((F.col("delivery_id") % 500).alias("g")).agg(F.to_json(F.struct(F.collect_list(e).alias("elements"))).alias("text"))
    got = files.overpass_outlines(docs, "text")
    return got.select("osm_id", F.size("line").cast("long").alias("n"), F.round(F.array_min(F.transform("line", lambda p: p["lon"])), 7).alias("lon"), F.round(F.array_min(F.transform("line", lambda p: p["lat"])), 7).alias("lat"))


@query("SELECT event_type, count(*) AS n, round(max(value), 4) AS max_height_m, round(avg(value), 4) AS mean_height_m, CAST(arg_min(CAST(ts AS DATE), struct_pack(v := -value, d := CAST(ts AS DATE))) AS VARCHAR) AS max_day FROM events WHERE value IS NOT NULL GROUP BY 1")
def wave_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(quality.wave_summary(e, ["event_type"], "day", "value"))


# --- text and provenance -------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents")
def provenance_sha256(spark: SparkSession, d: str) -> DataFrame:
    return quality.provenance(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(sha256(doc_id || ':' || sha256(text)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest_sum FROM documents")
def provenance_bundle(spark: SparkSession, d: str) -> DataFrame:
    p = quality.provenance(table(spark, d, "documents"), "doc_id", "text")
    return quality.bundle_hash(p, "doc_id", "sha256")


@query("""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}\\p{M}_][\\p{L}\\p{N}\\p{M}_]+') AS w FROM documents UNION ALL SELECT -1, regexp_extract_all(lower('Marejada y erosión en la línea de costa'), '[\\p{L}\\p{N}\\p{M}_][\\p{L}\\p{N}\\p{M}_]+')),
t AS (SELECT doc_id, unnest(w) AS term FROM tok UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) + 1 AS n FROM documents),
wt AS (SELECT doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM wt GROUP BY 1),
s AS (SELECT a.doc_id, sum(a.w * q.w) AS dot FROM wt a JOIN wt q ON q.term = a.term AND q.doc_id = -1 WHERE a.doc_id <> -1 GROUP BY 1)
SELECT doc_id, round(coalesce(dot / (l.l * (SELECT l FROM l WHERE doc_id = -1)), 0), 6) AS score FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) ORDER BY round(coalesce(dot / (l.l * (SELECT l FROM l WHERE doc_id = -1)), 0), 9) DESC, doc_id DESC LIMIT 5""")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    top = text.top_k(table(spark, d, "documents"), "doc_id", "text", "Marejada y erosión en la línea de costa", 5)
    return rounded(top, 6)


@query("SELECT count(*) FILTER (n_observations > 0) > 0 AND count(*) = count(DISTINCT rate_id) AND min(temporal_completeness_pct) >= 50 AS ready, concat_ws(';', CASE WHEN NOT count(*) FILTER (n_observations > 0) > 0 THEN 'no_rates' END, CASE WHEN count(*) <> count(DISTINCT rate_id) THEN 'repeated_ids' END, CASE WHEN NOT min(temporal_completeness_pct) >= 50 THEN 'incomplete' END) AS reasons FROM transect_rates")
def readiness_gate(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "transect_rates")
    facts = r.agg(F.count_if(F.col("n_observations") > 0).alias("with_rates"), F.count("*").alias("n"), F.countDistinct("rate_id").alias("ids"), F.min("temporal_completeness_pct").alias("least"))
    return quality.gate(facts, {"no_rates": F.col("with_rates") > 0, "repeated_ids": F.col("n") == F.col("ids"), "incomplete": F.col("least") >= 50})
