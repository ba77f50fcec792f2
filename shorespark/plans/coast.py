"""Queries of the shoreline operators on lines, rates, storms and exposure, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorespark.functions import labels
from shorespark.functions.geo import same_longitude, with_degrees, with_utm
from shorespark.functions.places import places
from shorespark.operators import catalog, change, exposure, intervals, lines, quality, scenario, spatial, storms, tides
from shorespark.operators.clocks import instant_column
from shorespark.plans.sqltext import SCENES_SQL, USABLE_SQL, instant_cte, utm_cte
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


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; -0 becomes 0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- projection ---------------------------------------------------------------------------------------------------


@query(f"WITH {utm_cte('u', 'transects', 'seaward_lon', 'seaward_lat', 'x', 'y')} SELECT transect_id, round(x, 3) AS x, round(y, 3) AS y FROM u")
def utm_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(with_utm(table(spark, d, "transects"), "seaward_lon", "seaward_lat").select("transect_id", "x", "y"), 3)


@query("SELECT transect_id, round(landward_lon, 7) AS lon, round(landward_lat, 7) AS lat FROM transects")
def utm_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = with_utm(table(spark, d, "transects").select("transect_id", "landward_lon", "landward_lat"), "landward_lon", "landward_lat")
    return rounded(with_degrees(t, "x", "y").select("transect_id", "lon", "lat"), 7)


# --- lines: the baseline of each beach ---------------------------------------------------------------------------


def baselines(spark: SparkSession, d: str) -> DataFrame:
    return lines.vertices(table(spark, d, "transects"), "beach_code", "chainage_m", "baseline_x", "baseline_y", step=50.0)


def shore_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The last known shoreline of each beach: the transects' origins moved by their last position."""
    t, r = table(spark, d, "transects"), table(spark, d, "transect_rates")
    one = r.where("last_position_m IS NOT NULL").groupBy("transect_id").agg(F.min_by("last_position_m", "rate_id").alias("p"))
    j = t.join(one, "transect_id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    moved = j.select("beach_code", "chainage_m", (F.col("baseline_x") + F.col("p") * F.col("positive_dx")).alias("x"), (F.col("baseline_y") + F.col("p") * F.col("positive_dy")).alias("y"))
    return lines.vertices(moved, "beach_code", "chainage_m", "x", "y", step=50.0)


VERTEX_SQL = "v AS (SELECT beach_code AS line, CAST(round(chainage_m / 50) AS BIGINT) AS seq, baseline_x AS x, baseline_y AS y FROM transects)"
SHORE_SQL = """one AS (SELECT transect_id, arg_min(last_position_m, rate_id) AS p FROM transect_rates WHERE last_position_m IS NOT NULL GROUP BY 1),
w AS (SELECT beach_code AS line, CAST(round(chainage_m / 50) AS BIGINT) AS seq, baseline_x + coalesce(p, 0) * positive_dx AS x, baseline_y + coalesce(p, 0) * positive_dy AS y FROM transects LEFT JOIN one USING (transect_id))"""


def _segment_sql(v: str, s: str) -> str:
    return f"""{s}_a AS (SELECT line, seq, x AS x1, y AS y1, lead(x) OVER (PARTITION BY line ORDER BY seq) AS x2, lead(y) OVER (PARTITION BY line ORDER BY seq) AS y2 FROM {v}),
{s}_b AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM {s}_a WHERE x2 IS NOT NULL),
{s} AS (SELECT *, sum(len) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING) - len AS cum FROM {s}_b)"""


def _at_sql(s: str, targets: str, keys: str, out: str) -> str:
    """Points at distance d of `targets` (line, {keys}, d) clamped to the line of segments s."""
    k = ", ".join(f"t.{c.strip()}" for c in keys.split(","))
    return f"""{out}_l AS (SELECT line, sum(len) AS length FROM {s} GROUP BY 1),
{out}_c AS (SELECT t.*, greatest(0, least(t.d, l.length)) AS dd FROM {targets} t JOIN {out}_l l USING (line)),
{out}_j AS (SELECT t.line, {k}, max(s.cum) AS cum FROM {out}_c t JOIN {s} s ON s.line = t.line AND s.cum <= t.dd GROUP BY t.line, {k}),
{out} AS (SELECT t.line, {k}, s.x1 + least(1, (t.dd - s.cum) / s.len) * (s.x2 - s.x1) AS x, s.y1 + least(1, (t.dd - s.cum) / s.len) * (s.y2 - s.y1) AS y
  FROM {out}_c t JOIN {out}_j j ON j.line = t.line AND {' AND '.join(f'j.{c.strip()} = t.{c.strip()}' for c in keys.split(','))} JOIN {s} s ON s.line = t.line AND s.cum = j.cum)"""


@query(f"WITH {VERTEX_SQL}, {_segment_sql('v', 's')} SELECT line, seq, round(len, 4) AS len, round(cum, 4) AS cum FROM s")
def line_chainage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.segments(baselines(spark, d)).select("line", "seq", "len", "cum"))


_RESAMPLE = "t AS (SELECT line, i, length * i / 149 AS d FROM (SELECT line, sum(len) AS length FROM s GROUP BY 1), range(150) r(i))"


@query(f"WITH {VERTEX_SQL}, {_segment_sql('v', 's')}, {_RESAMPLE}, {_at_sql('s', 't', 'i', 'o')} SELECT line, CAST(i AS INTEGER) AS i, round(x, 3) AS x, round(y, 3) AS y FROM o")
def line_resample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.resampled(baselines(spark, d)), 3)


_BOTH = f"""WITH {VERTEX_SQL}, {SHORE_SQL}, {_segment_sql('v', 's')}, {_segment_sql('w', 'z')}, {_RESAMPLE}, {_at_sql('s', 't', 'i', 'o')},
tz AS (SELECT line, i, length * i / 149 AS d FROM (SELECT line, sum(len) AS length FROM z GROUP BY 1), range(150) r(i)), {_at_sql('z', 'tz', 'i', 'oz')}"""


@query(f"{_BOTH} SELECT o.line, round(avg(sqrt((o.x - oz.x) * (o.x - oz.x) + (o.y - oz.y) * (o.y - oz.y))), 4) AS mean_displacement_m FROM o JOIN oz ON o.line = oz.line AND o.i = oz.i GROUP BY 1")
def mean_displacement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.mean_displacement(lines.resampled(baselines(spark, d)), lines.resampled(shore_vertices(spark, d))))


@query(f"{_BOTH} SELECT o.line, CAST(o.i AS INTEGER) AS i, round(o.x * 0.75 + oz.x * 0.25, 3) AS x, round(o.y * 0.75 + oz.y * 0.25, 3) AS y FROM o JOIN oz ON o.line = oz.line AND o.i = oz.i")
def line_interpolate(spark: SparkSession, d: str) -> DataFrame:
    back = lines.resampled(shore_vertices(spark, d)).withColumn("i", 149 - F.col("i"))  # is turned round before it is met
    return rounded(lines.between(lines.resampled(baselines(spark, d)), back, 0.25), 3)


@query(f"{_BOTH} SELECT line AS \"group\", CAST(i AS INTEGER) AS i, round(median(x), 3) AS x, round(median(y), 3) AS y FROM (SELECT * FROM o UNION ALL SELECT * FROM oz) GROUP BY 1, 2")
def median_line(spark: SparkSession, d: str) -> DataFrame:
    a = lines.resampled(baselines(spark, d)).select(F.col("line").alias("group"), F.lit(1).alias("line"), "i", "x", "y")
    b = lines.resampled(shore_vertices(spark, d)).select(F.col("line").alias("group"), F.lit(2).alias("line"), (149 - F.col("i")).alias("i"), "x", "y")  # the other way round
    return rounded(lines.median_line(a.unionByName(b)), 3)


_TRANSECT = f"""WITH {VERTEX_SQL}, {_segment_sql('v', 's')},
n AS (SELECT line, sum(len) AS length FROM s GROUP BY 1),
g AS (SELECT line, length, unnest(range(CAST(floor(length / 100) AS BIGINT) + 1)) AS k FROM n),
t AS (SELECT line, k, k * 100.0 AS d, length FROM g UNION ALL SELECT line, CAST(floor(length / 100) AS BIGINT) + 1, length, length FROM n WHERE length - floor(length / 100) * 100 > 1e-7),
ta AS (SELECT line, k, d - least(10, greatest(0.5, 10, length / 10000)) AS d FROM t), tb AS (SELECT line, k, d + least(10, greatest(0.5, 10, length / 10000)) AS d FROM t),
{_at_sql('s', 't', 'k', 'o')}, {_at_sql('s', 'ta', 'k', 'a')}, {_at_sql('s', 'tb', 'k', 'b')},
j AS (SELECT o.line, o.k, t.d AS chainage_m, o.x, o.y, (b.x - a.x) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS tx, (b.y - a.y) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS ty
  FROM o JOIN t ON t.line = o.line AND t.k = o.k JOIN a ON a.line = o.line AND a.k = o.k JOIN b ON b.line = o.line AND b.k = o.k)"""


@query(f"{_TRANSECT} SELECT line, CAST(k AS INTEGER) AS k, round(chainage_m, 3) AS chainage_m, round(x, 3) AS origin_x, round(y, 3) AS origin_y, round(-ty, 5) + 0.0 AS normal_x, round(tx, 5) + 0.0 AS normal_y, round(x + 100 * ty, 3) AS sea_x, round(y - 100 * tx, 3) AS sea_y, round(x - 300 * ty, 3) AS land_x, round(y + 300 * tx, 3) AS land_y FROM j")
def fixed_transects(spark: SparkSession, d: str) -> DataFrame:
    t = lines.fixed_transects(baselines(spark, d))
    return t.select("line", "k", *[(F.round(c, 5 if c.startswith("normal") else 3) + 0.0).alias(c) for c in t.columns[2:]])


def _transect_segments(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transects")
    end = lambda c, s: F.col(f"baseline_{c}") + F.lit(s) * F.col(f"positive_d{c}")
    return t.select(F.col("beach_code").alias("g"), F.col("transect_id").alias("id"), end("x", -100.0).alias("x1"), end("y", -100.0).alias("y1"), end("x", 300.0).alias("x2"), end("y", 300.0).alias("y2"))


_CROSS = f"""WITH {SHORE_SQL}, {_segment_sql('w', 'z')},
a AS (SELECT beach_code AS g, transect_id AS id, baseline_x - 100 * positive_dx AS x1, baseline_y - 100 * positive_dy AS y1, baseline_x + 300 * positive_dx AS x2, baseline_y + 300 * positive_dy AS y2 FROM transects),
c AS (SELECT a.g, a.id, z.seq, a.x1, a.y1, a.x2, a.y2, z.x1 AS bx1, z.y1 AS by1, z.x2 AS bx2, z.y2 AS by2, nullif((a.x2 - a.x1) * (z.y2 - z.y1) - (a.y2 - a.y1) * (z.x2 - z.x1), 0) AS det FROM a JOIN z ON a.g = z.line),
h AS (SELECT *, ((bx1 - x1) * (by2 - by1) - (by1 - y1) * (bx2 - bx1)) / det AS t, ((bx1 - x1) * (y2 - y1) - (by1 - y1) * (x2 - x1)) / det AS u FROM c),
k AS (SELECT *, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM h WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


def _shore_segments(spark: SparkSession, d: str) -> DataFrame:
    return lines.segments(shore_vertices(spark, d)).select(F.col("line").alias("g"), F.col("seq").alias("id"), "x1", "y1", "x2", "y2")


_NUDGED = _CROSS.replace("baseline_x - 100 * positive_dx AS", "baseline_x - 100 * positive_dx + 7.3 * positive_dy AS").replace("baseline_y - 100 * positive_dy AS", "baseline_y - 100 * positive_dy - 7.3 * positive_dx AS").replace("baseline_x + 300 * positive_dx AS", "baseline_x + 300 * positive_dx + 7.3 * positive_dy AS").replace("baseline_y + 300 * positive_dy AS", "baseline_y + 300 * positive_dy - 7.3 * positive_dx AS")


@query(f"{_NUDGED} SELECT g, id AS a_id, seq AS b_id, round(t, 6) AS t, round(x, 3) AS x, round(y, 3) AS y FROM k")
def transect_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Every crossing of the last shorelines with the transects moved 7.3 m along the coast, off the shores' vertices."""
    t = table(spark, d, "transects")
    end = lambda c, o, f, e: F.col(f"baseline_{c}") + F.lit(f) * F.col(f"positive_d{c}") + F.lit(e) * F.col(f"positive_d{o}")
    moved = t.select(F.col("beach_code").alias("g"), F.col("transect_id").alias("id"), end("x", "y", -100.0, 7.3).alias("x1"), end("y", "x", -100.0, -7.3).alias("y1"), end("x", "y", 300.0, 7.3).alias("x2"), end("y", "x", 300.0, -7.3).alias("y2"))
    got = lines.crossings(moved, _shore_segments(spark, d))
    return got.select("g", "a_id", "b_id", F.round("t", 6).alias("t"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"{_CROSS}, p AS (SELECT DISTINCT g, id, round(t * 400 - 100, 6) AS p FROM k), b AS (SELECT g, id, arg_min(p, abs(p)) AS position_m, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT DISTINCT line AS g FROM z) SELECT a.g, a.id, round(b.position_m, 5) + 0.0 AS position_m, CAST(coalesce(n, 0) AS BIGINT) AS candidate_count, CASE WHEN n IS NULL THEN 'no_intersection' WHEN n = 1 THEN 'single_point' ELSE 'nearest_of_multiple' END AS intersection_method FROM a JOIN q USING (g) LEFT JOIN b USING (g, id)")
def nearest_crossing(spark: SparkSession, d: str) -> DataFrame:
    shores = _shore_segments(spark, d).withColumn("shore", F.lit(1))
    return lines.nearest_crossings(_transect_segments(spark, d), shores, 100.0).select("g", "id", (F.round("position_m", 5) + 0.0).alias("position_m"), F.col("candidate_count").cast("long"), "intersection_method")


@query(f"WITH {VERTEX_SQL}, e AS (SELECT line, arg_min(y, seq) AS ya, arg_max(y, seq) AS yb, max(seq) AS m FROM v GROUP BY 1) SELECT line, CASE WHEN ya < yb THEN m - seq ELSE seq END AS seq, round(x, 3) AS x, round(y, 3) AS y FROM v JOIN e USING (line)")
def orient_lines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.north_to_south(baselines(spark, d)), 3)


@query(f"""WITH {VERTEX_SQL}, {_segment_sql('v', 's')}, e AS (SELECT line, max(seq) AS m, arg_min((x1, y1), seq) AS a, arg_max((x2, y2), seq) AS b FROM s GROUP BY 1)
SELECT line, seq AS part, CAST(CASE WHEN a < b THEN seq ELSE m - seq END AS INTEGER) AS place, (seq % 2 = 1) = (a < b) AS turned FROM s JOIN e USING (line)""")
def merge_lines(spark: SparkSession, d: str) -> DataFrame:
    """Segments of every baseline given as loose parts, half of them turned round, put together again from the end with
    the smaller coordinates."""
    s = lines.segments(baselines(spark, d))
    odd = F.col("seq") % 2 == 1
    pick = lambda a, b: F.when(odd, F.col(b)).otherwise(F.col(a))
    parts = s.select("line", F.col("seq").alias("part"), pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"))
    return lines.merged_order(parts)


_OFFSET = """oa AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM v WINDOW w AS (PARTITION BY line ORDER BY seq)),
ob AS (SELECT *, (x - px) / sqrt(pow(x - px, 2) + pow(y - py, 2)) AS ux, (y - py) / sqrt(pow(x - px, 2) + pow(y - py, 2)) AS uy, (qx - x) / sqrt(pow(qx - x, 2) + pow(qy - y, 2)) AS wx, (qy - y) / sqrt(pow(qx - x, 2) + pow(qy - y, 2)) AS wy FROM oa),
oc AS (SELECT line, seq, x, y, coalesce((ux + wx) / 2, ux, wx) AS mx, coalesce((uy + wy) / 2, uy, wy) AS my FROM ob)"""


@query(f"""WITH RECURSIVE {SHORE_SQL}, r(line, a, b) AS (SELECT line, min(seq), max(seq) FROM w GROUP BY 1 UNION ALL
SELECT line, unnest([a, m]), unnest([m, b]) FROM (SELECT r.line, r.a, r.b, arg_max(v.seq, (hypot_, -v.seq)) AS m, max(hypot_) AS far FROM r JOIN w p ON p.line = r.line AND p.seq = r.a JOIN w q ON q.line = r.line AND q.seq = r.b JOIN w v ON v.line = r.line AND v.seq > r.a AND v.seq < r.b,
LATERAL (SELECT greatest(0, least(1, coalesce(((v.x - p.x) * (q.x - p.x) + (v.y - p.y) * (q.y - p.y)) / nullif(pow(q.x - p.x, 2) + pow(q.y - p.y, 2), 0), 0))) AS t) AS tt,
LATERAL (SELECT sqrt(pow(v.x - p.x - t * (q.x - p.x), 2) + pow(v.y - p.y - t * (q.y - p.y), 2)) AS hypot_) AS hh GROUP BY 1, 2, 3) WHERE far > 2),
kept AS (SELECT line, a AS seq FROM r UNION SELECT line, b FROM r)
SELECT line, seq, round(x, 3) AS x, round(y, 3) AS y FROM w JOIN kept USING (line, seq)""")
def line_simplify(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.simplified(shore_vertices(spark, d), 2.0), 3)


@query(f"WITH {VERTEX_SQL}, {_OFFSET} SELECT line, seq, round(x - coalesce(my, 0) * coalesce(25 / (mx * mx + my * my), 0), 3) AS x, round(y + coalesce(mx, 0) * coalesce(25 / (mx * mx + my * my), 0), 3) AS y FROM oc")
def line_offset(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.offset_points(baselines(spark, d), 25.0), 3)


@query()
def line_offset_curve(spark: SparkSession, d: str) -> DataFrame:
    """The curves 40 m seaward with round corners, and whether each crosses itself."""
    c = lines.offset_curve(baselines(spark, d), -40.0).withColumn("order", F.col("seq") * 1000 + F.col("place"))
    v = places(c, ["line"], "order", 4096_000.0, "n").select("line", F.col("n").alias("seq"), "x", "y")
    return rounded(v.join(lines.self_crossings(v).withColumnRenamed("n", "self_crossings"), "line"), 3)


@query(f"WITH {VERTEX_SQL}, {_segment_sql('v', 's')}, l AS (SELECT line, sum(len) AS length FROM s GROUP BY 1), n AS (SELECT line, count(*) AS n_vertices, arg_min(y, seq) > arg_max(y, seq) AS north_to_south FROM v GROUP BY 1) SELECT line, n_vertices, round(length, 3) AS length_m, true AS simple, north_to_south, n_vertices BETWEEN 20 AND 60 AND north_to_south AS fit FROM n JOIN l USING (line)")
def arc_checks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.arc_checks(baselines(spark, d), 20, 60), 3)


@query(f"""WITH {VERTEX_SQL}, {_OFFSET}, n AS (SELECT line, count(*) AS n FROM v GROUP BY 1), back AS (SELECT line, 2 * n - 1 - seq AS seq, x - coalesce(my, 0) * coalesce(200 / (mx * mx + my * my), 0) AS x, y + coalesce(mx, 0) * coalesce(200 / (mx * mx + my * my), 0) AS y FROM oc JOIN n USING (line)),
ring AS (SELECT line, seq, x, y FROM v UNION ALL SELECT * FROM back), k AS (SELECT line, seq, sqrt(pow(x - coalesce(lead(x) OVER w, first(x) OVER w), 2) + pow(y - coalesce(lead(y) OVER w, first(y) OVER w), 2)) AS len FROM ring WINDOW w AS (PARTITION BY line ORDER BY seq)),
l AS (SELECT line, sum(len) FILTER (seq < n - 1) AS there, sum(len) FILTER (seq >= n - 1) AS around FROM k JOIN n USING (line) GROUP BY 1)
SELECT line, 1 AS direction, seq, round(x, 3) AS x, round(y, 3) AS y FROM v JOIN l USING (line) WHERE there IS NOT NULL AND NOT around BETWEEN 0.99 * there AND 1.05 * there""")
def ring_arcs(spark: SparkSession, d: str) -> DataFrame:
    """The vertices of every beach's closed outline (baseline and back 200 m inland) on the arc along its baseline."""
    v = baselines(spark, d)
    n = v.groupBy("line").agg(F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    back = lines.offset_points(v, 200.0).join(n, "line").select("line", (2 * F.col("n") - 1 - F.col("seq")).alias("seq"), "x", "y")
    anchors = n.join(lines.lengths(lines.segments(v)), "line").select("line", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), (0.99 * F.col("length")).alias("least"), (1.05 * F.col("length")).alias("most"))
    return rounded(lines.ring_arc(v.unionByName(back), anchors, 1.0), 3)


@query("""WITH r AS (SELECT beach_code AS g, CAST(round(chainage_m / 50) AS BIGINT) AS c, min(last_position_m) AS v FROM transect_rates WHERE last_position_m IS NOT NULL GROUP BY 1, 2),
p AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, v FROM r),
m AS (SELECT p.g, p.i, p.n, any_value(p.v) AS v, median(q.v) AS m FROM p, range(-2, 3) k(k), p q WHERE q.g = p.g AND q.i = least(p.n - 1, greatest(0, p.i + k)) GROUP BY 1, 2, 3),
s AS (SELECT m.g, m.i, m.n, any_value(m.v) AS v, sum(q.m * exp(-k * k / 2.0)) / sum(exp(-k * k / 2.0)) AS s FROM m, range(-4, 5) k(k), m q WHERE q.g = m.g AND q.i = least(m.n - 1, greatest(0, m.i + k)) GROUP BY 1, 2, 3)
SELECT g AS beach_code, i, round(CASE WHEN n < 5 THEN v ELSE s END, 4) + 0.0 AS v FROM s""")
def smooth_median_gauss(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "transect_rates").where("last_position_m IS NOT NULL").groupBy("beach_code", F.round(F.col("chainage_m") / 50).cast("long").alias("c")).agg(F.min("last_position_m").alias("v"))
    placed = places(r, ["beach_code"], "c", 4096.0, "i")
    return rounded(lines.smoothed(placed.select("beach_code", "i", "v"), "beach_code", "i", "v"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT beach_code AS g, CAST(round(chainage_m / 50) AS BIGINT) AS i, unnest([first_position_m, last_position_m, lrr_position_at_reference_m]) AS p FROM transect_rates),
l AS (SELECT g, i, list(p) AS a, list(p) FILTER (p BETWEEN -250 AND 60) AS b FROM c WHERE p IS NOT NULL GROUP BY 1, 2),
o AS (SELECT g, i, CASE WHEN len(b) > 0 THEN b ELSE a END AS ps, row_number() OVER (PARTITION BY g ORDER BY i) AS n FROM l),
f(g, n, i, prev, taken) AS (SELECT g, n, i, list_sort(list_transform(ps, lambda p: (abs(p), p)))[1][2], true FROM o WHERE n = 1 UNION ALL
SELECT g, n, i, CASE WHEN abs(best - prev) <= 80 THEN best ELSE prev END, abs(best - prev) <= 80 FROM (SELECT o.g, o.n, o.i, f.prev, list_sort(list_transform(o.ps, lambda p: (abs(p - f.prev) + 0.08 * abs(p), p)))[1][2] AS best FROM f JOIN o ON o.g = f.g AND o.n = f.n + 1))
SELECT g AS beach_code, i, round(prev, 4) + 0.0 AS p FROM f WHERE taken""")
def guided_continuity(spark: SparkSession, d: str) -> DataFrame:
    """One position per station by the continuity fold over first, last and reference positions as candidates."""
    r = table(spark, d, "transect_rates").select("beach_code", F.round(F.col("chainage_m") / 50).cast("long").alias("i"), F.explode(F.array("first_position_m", "last_position_m", "lrr_position_at_reference_m")).alias("p"))
    return rounded(lines.continuous(r.where("p IS NOT NULL"), "beach_code", "i", "p"))


# --- rates ---------------------------------------------------------------------------------------------------------

OBS = SCENES_SQL + ", obs AS (SELECT series_id AS id, year(make_timestamp(us)) AS year, position_m AS p FROM sc), y AS (SELECT id, year, avg(p) AS p FROM obs WHERE p IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2)"


def _scene_times(spark: SparkSession, d: str) -> DataFrame:
    """The scenes with the instant t that their time text states."""
    s = table(spark, d, "storm_scene_join").select("obs_id", "sector_id", "series_id", "position_m", "acquired_at", "clock_zone")
    return instant_column(s, "acquired_at", "clock_zone", "t").drop("acquired_at", "clock_zone")


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Positions by series and year of the scene; scenes without a readable time have no year."""
    return _scene_times(spark, d).select(F.col("series_id").alias("id"), F.year(F.timestamp_micros("t")).alias("year"), F.col("position_m").alias("p"))


@query(f"WITH {OBS}, g AS (SELECT id, count(*) AS n_observations, min(year) AS first_year, max(year) AS last_year, arg_min(p, year) AS a, arg_max(p, year) AS b FROM y GROUP BY 1) SELECT id, n_observations, CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year, round(a, 8) AS first_position_m, round(b, 8) AS last_position_m, CASE WHEN last_year > first_year THEN round(b - a, 8) + 0.0 END AS nsm_m, CASE WHEN last_year > first_year THEN round((b - a) / (last_year - first_year), 8) + 0.0 END AS epr_m_per_year FROM g")
def net_shoreline_movement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(change.net_movement(_observations(spark, d), ["id"], "year", "p"), 8)


_FIT = f"""WITH {OBS}, f AS (SELECT id, count(*) AS n, avg(year) AS my, avg(p) AS mp, regr_slope(p, year) AS b, min(year) AS y0, max(year) AS y1 FROM y GROUP BY 1),
r AS (SELECT y.id, sum(pow(p - mp - coalesce(b, 0) * (year - my), 2)) AS sse, sum(pow(p - mp, 2)) AS sst, sum(pow(year - my, 2)) AS sxx FROM y JOIN f ON y.id = f.id GROUP BY 1),
e AS (SELECT f.*, sse, sst, sxx, CASE WHEN n >= 3 THEN sqrt(greatest(0, sse / nullif(n - 2, 0)) / nullif(sxx, 0)) END AS se FROM f JOIN r ON f.id = r.id)"""


@query(f"{_FIT} SELECT id, CASE WHEN y1 > y0 THEN round(b, 4) + 0.0 END AS lrr_m_per_year, CASE WHEN y1 > y0 THEN round(CASE WHEN sst <= 1e-12 THEN (CASE WHEN sse <= 1e-12 THEN 1.0 END) ELSE greatest(0, least(1, 1 - sse / sst)) END, 4) + 0.0 END AS lrr_r2, CASE WHEN y1 > y0 THEN round(my, 4) END AS lrr_reference_year, CASE WHEN y1 > y0 THEN round(mp, 4) + 0.0 END AS lrr_position_at_reference_m, round(se, 4) + 0.0 AS lrr_standard_error_m_per_year FROM e")
def linear_regression_rate(spark: SparkSession, d: str) -> DataFrame:
    r = change.rates(_observations(spark, d), ["id"], "year", "p").where("n_observations > 0")
    return rounded(r.select("id", "lrr_m_per_year", "lrr_r2", "lrr_reference_year", "lrr_position_at_reference_m", "lrr_standard_error_m_per_year"))


# The table of Student's t again, for the SQL: 1 to 30 degrees of freedom, then by ranges.
_T_SQL = """CASE WHEN n - 2 BETWEEN 1 AND 30 THEN [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042][CAST(n - 2 AS INTEGER)]::DOUBLE WHEN n - 2 <= 40 THEN 2.021 WHEN n - 2 <= 60 THEN 2.0 WHEN n - 2 <= 120 THEN 1.98 ELSE 1.96 END"""


@query(f"{_FIT}, x AS (SELECT count(DISTINCT year) AS k FROM obs WHERE year IS NOT NULL) SELECT o.id, coalesce(n, 0) AS n_observations, k AS n_expected_years, round(100.0 * coalesce(n, 0) / k, 4) AS temporal_completeness_pct, round(b - {_T_SQL} * se, 4) + 0.0 AS lrr_ci95_low_m_per_year, round(b + {_T_SQL} * se, 4) + 0.0 AS lrr_ci95_high_m_per_year, CASE WHEN se IS NULL THEN 'not_available' ELSE 'student_t_95' END AS uncertainty_method, CASE WHEN n IS NULL THEN 'no_intersections' WHEN n < 2 THEN 'insufficient_observations' WHEN y1 <= y0 THEN 'insufficient_time_span' WHEN se IS NULL THEN 'ok_without_lrr_uncertainty' ELSE 'ok' END AS analysis_status FROM (SELECT DISTINCT id FROM obs) o LEFT JOIN e USING (id) CROSS JOIN x")
def rate_status_completeness(spark: SparkSession, d: str) -> DataFrame:
    r = change.rates(_observations(spark, d), ["id"], "year", "p")
    return rounded(r.select("id", "n_observations", "n_expected_years", "temporal_completeness_pct", "lrr_ci95_low_m_per_year", "lrr_ci95_high_m_per_year", "uncertainty_method", "analysis_status"))


# --- tides ---------------------------------------------------------------------------------------------------------


@query("SELECT correction_id, round(tide_height_m / beach_slope, 8) + 0.0 AS shift_m, round(tide_height_m / 0.03, 8) + 0.0 AS shift_0_03_m, round(tide_height_m / 0.08, 8) + 0.0 AS shift_0_08_m FROM tide_corrections")
def tide_shift_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tide_corrections")
    df = tides.sensitivity(t.withColumn("shift_m", tides.shift(F.col("tide_height_m"), F.col("beach_slope"))), "tide_height_m", digits=8)
    return rounded(df.select("correction_id", "shift_m", "shift_0_03_m", "shift_0_08_m"), 8)


_SHIFTS = "SELECT beach_code AS line, avg(tide_height_m / beach_slope) AS shift_m FROM tide_corrections WHERE tide_height_m IS NOT NULL GROUP BY 1"


@query(f"""WITH {VERTEX_SQL}, sh AS ({_SHIFTS}),
a AS (SELECT *, coalesce(lag(x) OVER w, x) AS px, coalesce(lag(y) OVER w, y) AS py, coalesce(lead(x) OVER w, x) AS qx, coalesce(lead(y) OVER w, y) AS qy FROM v WINDOW w AS (PARTITION BY line ORDER BY seq)),
n AS (SELECT *, -(qy - py) / nullif(sqrt(pow(qx - px, 2) + pow(qy - py, 2)), 0) AS nx, (qx - px) / nullif(sqrt(pow(qx - px, 2) + pow(qy - py, 2)), 0) AS ny FROM a)
SELECT line, seq, round(x - coalesce(nx, 0) * shift_m, 3) AS x, round(y - coalesce(ny, 0) * shift_m, 3) AS y, CASE WHEN nx IS NULL THEN 'undetermined' ELSE 'land_reference' END AS direction_method FROM n JOIN sh USING (line)""")
def tide_vertex_correction(spark: SparkSession, d: str) -> DataFrame:
    v = baselines(spark, d)
    t = table(spark, d, "tide_corrections")
    shifts = t.groupBy(F.col("beach_code").alias("line")).agg(F.avg(tides.shift(F.col("tide_height_m"), F.col("beach_slope"))).alias("shift_m")).where("shift_m IS NOT NULL")
    # every vertex has the land to its left: a reference far to the left of the middle
    return rounded(tides.corrected(v, shifts, land=tides.land_reference(v, 20_000.0)), 3)


# Principal tidal constituents, speed in degrees per hour; amplitudes and phases are examples.
CONSTITUENTS = (("M2", 28.9841042, 0.45, 110.0), ("S2", 30.0, 0.15, 135.0), ("N2", 28.4397295, 0.1, 85.0), ("K1", 15.0410686, 0.16, 310.0), ("O1", 13.9430356, 0.11, 280.0))


@query(
    "SELECT event_id, round("
    + " + ".join(f"{a} * cos(radians({s} * (epoch_us(ts) / 3600000000.0) + {p}))" for _, s, a, p in sorted(CONSTITUENTS, key=lambda c: c[2]))
    + ", 4) + 0.0 AS tide_height_m FROM events"
)
def tide_harmonic_sum(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame([(n, s, a, p) for n, s, a, p in CONSTITUENTS], "name string, speed_deg_per_hour double, amplitude_m double, phase_deg double")
    return rounded(tides.harmonic(table(spark, d, "events").withColumn("t", F.unix_micros("ts")), ["event_id"], "t", c))


# --- storms --------------------------------------------------------------------------------------------------------


def _notices(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.unix_date(c).cast("long") * storms.DAY
    return intervals.usable_notices(table(spark, d, "marejadas_oficiales_armada")).select("sector_id", "event_id", day("start_date").alias("s"), day("end_date").alias("e"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    s = _scene_times(spark, d).select("obs_id", "sector_id", "t")
    return storms.tagged(s, "obs_id", "t", _notices(spark, d), "event_id", "s", "e", ["sector_id"])


_EV = f"{SCENES_SQL}, ev AS (SELECT sector_id, event_id, epoch_us(CAST(start_date AS TIMESTAMP)) AS s, epoch_us(CAST(end_date AS TIMESTAMP)) AS e FROM ({USABLE_SQL}))"


@query(f"WITH {_EV}, h AS (SELECT obs_id, count(*) AS n, string_agg(event_id, ';' ORDER BY s, event_id) AS ids FROM sc JOIN ev ON sc.sector_id = ev.sector_id AND us BETWEEN s - 259200000000 AND e + 259200000000 GROUP BY 1) SELECT obs_id, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS official_storm_event, CAST(coalesce(n, 0) AS INTEGER) AS official_event_count, coalesce(ids, '') AS official_event_ids FROM sc LEFT JOIN h USING (obs_id)")
def storm_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("obs_id", "official_storm_event", "official_event_count", "official_event_ids")


@query(f"WITH {_EV}, h AS (SELECT obs_id, min(greatest(0, s - us, us - e)) AS m FROM sc JOIN ev ON sc.sector_id = ev.sector_id WHERE us IS NOT NULL GROUP BY 1) SELECT obs_id, m / 86400000000.0 AS nearest_official_event_days FROM sc LEFT JOIN h USING (obs_id)")
def storm_nearest_event(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("obs_id", "nearest_official_event_days")


@query(f"""WITH {SCENES_SQL}, m AS (SELECT series_id, us AS t, median(position_m) AS p FROM sc WHERE position_m IS NOT NULL AND us IS NOT NULL GROUP BY 1, 2),
y AS (SELECT *, (t - min(t) OVER (PARTITION BY series_id)) / {storms.YEAR!r} AS y FROM m),
f AS (SELECT series_id, count(*) AS n, regr_slope(p, y) AS b, avg(p) AS mp, avg(y) AS my FROM y GROUP BY 1)
SELECT series_id, t, round(p, 4) + 0.0 AS position_m, CASE WHEN n >= 3 THEN round(mp + b * (y - my), 4) + 0.0 END AS position_trend_m, CASE WHEN n >= 3 THEN round(p - (mp + b * (y - my)), 4) + 0.0 END AS position_anomaly_m FROM y JOIN f USING (series_id)""")
def position_anomaly_detrend(spark: SparkSession, d: str) -> DataFrame:
    s = _scene_times(spark, d).select("series_id", "t", "position_m")
    return rounded(storms.anomalies(s, ["series_id"], "t", "position_m"))


@query("""WITH d AS (SELECT provider, position_anomaly_m AS y, official_storm_event AS x FROM storm_scene_join WHERE position_anomaly_m IS NOT NULL AND official_storm_event IS NOT NULL)
SELECT provider, count(*) AS n, count(*) FILTER (x = 1) AS n_event, count(*) FILTER (x = 0) AS n_no_event, CASE WHEN count(*) >= 5 AND count(*) FILTER (x = 1) >= 2 AND count(*) FILTER (x = 0) >= 2 THEN round(corr(x, y), 4) + 0.0 END AS correlation_r, CASE WHEN count(*) >= 5 AND count(*) FILTER (x = 1) >= 2 AND count(*) FILTER (x = 0) >= 2 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END AS status FROM d GROUP BY 1""")
def storm_point_biserial(spark: SparkSession, d: str) -> DataFrame:
    r = storms.point_biserial(table(spark, d, "storm_scene_join"), "position_anomaly_m", "official_storm_event", ["provider"])
    return rounded(r.drop("p_value"))


@query("""WITH d AS (SELECT sector_id, position_anomaly_m AS y, official_storm_event AS x FROM storm_scene_join WHERE position_anomaly_m IS NOT NULL AND official_storm_event IS NOT NULL),
g AS (SELECT sector_id, count(*) AS n, count(*) FILTER (x = 1) AS n1, count(*) FILTER (x = 0) AS n0, corr(x, y) AS r FROM d GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (x = 1) >= 2 AND count(*) FILTER (x = 0) >= 2),
a AS (SELECT *, n - 2 AS k, atan(abs(r) / sqrt(1 - r * r)) AS theta FROM g),
i AS (SELECT sector_id, sum(CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * pow(cos(theta * j / 2000.0), k - 1)) * theta / 6000 AS area FROM a, range(2001) q(j) GROUP BY sector_id, theta)
SELECT sector_id, n, round(1 - 2 * exp(lgamma((k + 1) / 2.0) - lgamma(k / 2.0)) / sqrt(pi()) * area, 6) AS p_value FROM a JOIN i USING (sector_id)""")
def storm_point_biserial_p(spark: SparkSession, d: str) -> DataFrame:
    """p of the sectors with enough pairs; its SQL integrates the density of Student's t."""
    r = storms.point_biserial(table(spark, d, "storm_scene_join"), "position_anomaly_m", "official_storm_event", ["sector_id"])
    return r.where("status = 'OK'").select("sector_id", "n", F.round("p_value", 6).alias("p_value"))


# --- exposure ------------------------------------------------------------------------------------------------------


def _transect_rates(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "transect_rates").groupBy("transect_id").agg(F.min_by("lrr_m_per_year", "rate_id").alias("rate"))
    return _transect_segments(spark, d).select(F.col("id").alias("transect_id"), "x1", "y1", "x2", "y2").join(r, "transect_id")


def _buildings(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "buildings_risk").select(F.lower(F.trim("osm_id")).alias("osm"), same_longitude(F.col("longitude")).alias("lon"), F.col("latitude").alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    return with_utm(b.groupBy("osm").agg(F.min(F.struct("lon", "lat")).alias("p")).select("osm", "p.lon", "p.lat"), "lon", "lat", "px", "py")


_NEAR = f"""WITH bd AS (SELECT osm, p.lon AS lon, p.lat AS lat FROM (SELECT lower(trim(osm_id)) AS osm, min(struct_pack(lon := longitude, lat := latitude)) AS p FROM buildings_risk GROUP BY 1)),
{utm_cte('bu', 'bd', 'lon', 'lat', 'px', 'py')},
tr AS (SELECT t.transect_id AS line, baseline_x - 100 * positive_dx AS x1, baseline_y - 100 * positive_dy AS y1, baseline_x + 300 * positive_dx AS x2, baseline_y + 300 * positive_dy AS y2, rate FROM transects t JOIN (SELECT transect_id, arg_min(lrr_m_per_year, rate_id) AS rate FROM transect_rates GROUP BY 1) r ON r.transect_id = t.transect_id WHERE rate IS NOT NULL),
j AS (SELECT osm, line, rate, px - x1 AS ax, py - y1 AS ay, x2 - x1 AS dx, y2 - y1 AS dy FROM bu CROSS JOIN tr),
k AS (SELECT osm, line, rate, sqrt(pow(ax - greatest(0, least(1, (ax * dx + ay * dy) / (dx * dx + dy * dy))) * dx, 2) + pow(ay - greatest(0, least(1, (ax * dx + ay * dy) / (dx * dx + dy * dy))) * dy, 2)) AS dist FROM j),
b AS (SELECT osm, min(dist) AS dist, arg_min(line, dist) AS line, arg_min(rate, dist) AS rate FROM k GROUP BY 1)"""


@query(f"{_NEAR} SELECT osm, line AS transect_id, round(dist, 4) AS distance_m, round(rate, 8) + 0.0 AS rate FROM b")
def nearest_rate_join(spark: SparkSession, d: str) -> DataFrame:
    r = exposure.nearest_rates(_buildings(spark, d), "osm", "px", "py", _transect_rates(spark, d), "transect_id", "rate")
    return r.select("osm", "transect_id", F.round("distance_m", 4).alias("distance_m"), (F.round("rate", 8) + 0.0).alias("rate"))


@query("SELECT delivery_id, CASE WHEN erosion_rate_m_per_year > 0 THEN round(distance_to_shoreline_m / erosion_rate_m_per_year, 4) END AS years, CASE WHEN erosion_rate_m_per_year > 0 AND distance_to_shoreline_m / erosion_rate_m_per_year < 10 THEN 'under_10' WHEN erosion_rate_m_per_year > 0 AND distance_to_shoreline_m / erosion_rate_m_per_year <= 30 THEN 'to_30' ELSE 'beyond' END AS span FROM buildings_risk")
def time_to_impact(spark: SparkSession, d: str) -> DataFrame:
    y = exposure.years_to_impact(F.col("distance_to_shoreline_m"), F.col("erosion_rate_m_per_year"))
    b = table(spark, d, "buildings_risk").withColumn("y", y)
    return b.select("delivery_id", F.round("y", 4).alias("years"), exposure.by_limits(F.col("y"), [(10.0, False, "under_10"), (30.0, True, "to_30")], "beyond").alias("span"))


@query("SELECT count(*) AS n, count(*) FILTER (strip_accents(lower(trim(risk_level))) = 'critico') AS n_worst, round(coalesce(sum(exposed_length_m), 0), 2) AS exposed_length_m, round(coalesce(sum(exposed_area_m2), 0), 2) AS exposed_area_m2 FROM buildings_risk")
def infrastructure_summary(spark: SparkSession, d: str) -> DataFrame:
    from shorespark.operators.snapshots import folded

    b = table(spark, d, "buildings_risk").withColumn("level", folded(F.col("risk_level")))
    return rounded(exposure.summary(b, "level", "exposed_length_m", "exposed_area_m2", "critico"), 2)


@query("WITH k AS (SELECT unnest(['critico', 'moderado', 'bajo', 'extremo', 'sin_clasificar']) AS level), n AS (SELECT CASE WHEN strip_accents(lower(trim(risk_level))) IN ('critico', 'moderado', 'bajo', 'extremo') THEN strip_accents(lower(trim(risk_level))) ELSE 'sin_clasificar' END AS level, count(*) AS n FROM buildings_risk GROUP BY 1) SELECT level, coalesce(n, 0) AS n FROM k LEFT JOIN n USING (level)")
def risk_histogram(spark: SparkSession, d: str) -> DataFrame:
    from shorespark.operators.snapshots import folded

    return exposure.histogram(table(spark, d, "buildings_risk"), folded(F.col("risk_level")), ["critico", "moderado", "bajo", "extremo"])


_LON, _LAT = -71.6, -20.1
_FAR = f"round(2 * 6371008.8 * asin(sqrt(pow(sin(radians({{lat}} - ({_LAT})) / 2), 2) + cos(radians({_LAT})) * cos(radians({{lat}})) * pow(sin(radians({{lon}} - ({_LON})) / 2), 2))), 3)"


@query(f"SELECT layer, key, distance_m FROM (SELECT 'building' AS layer, 0 AS o, lower(trim(osm_id)) AS key, {_FAR.format(lat='latitude', lon='longitude')} AS distance_m FROM buildings_risk UNION ALL SELECT 'transect', 1, transect_id, {_FAR.format(lat='landward_lat', lon='landward_lon')} FROM transects) ORDER BY distance_m, o, key LIMIT 1")
def nearest_feature_click(spark: SparkSession, d: str) -> DataFrame:
    from shorespark.functions.geo import ground_distance

    far = lambda lon, lat: F.round(ground_distance(F.lit(_LON), F.lit(_LAT), F.col(lon), F.col(lat)), 3)
    b = table(spark, d, "buildings_risk").select(F.lower(F.trim("osm_id")).alias("key"), far("longitude", "latitude").alias("m"))
    t = table(spark, d, "transects").select(F.col("transect_id").alias("key"), far("landward_lon", "landward_lat").alias("m"))
    return exposure.nearest_feature([("building", b), ("transect", t)], "key", "m")


_SHORE = f"WITH {SHORE_SQL}, {_segment_sql('w', 'z')}"
_BUILT = f"""bd AS (SELECT osm, p.lon AS lon, p.lat AS lat FROM (SELECT lower(trim(osm_id)) AS osm, min(struct_pack(lon := longitude, lat := latitude)) AS p FROM buildings_risk GROUP BY 1)),
{utm_cte('bu', 'bd', 'lon', 'lat', 'px', 'py')}"""


def _far_sql(px: str, py: str, s: str) -> str:
    """Distance of a point from the segment s (x1..y2)."""
    t = f"greatest(0, least(1, coalesce((({px} - {s}.x1) * ({s}.x2 - {s}.x1) + ({py} - {s}.y1) * ({s}.y2 - {s}.y1)) / nullif(pow({s}.x2 - {s}.x1, 2) + pow({s}.y2 - {s}.y1, 2), 0), 0)))"
    return f"sqrt(pow({px} - {s}.x1 - {t} * ({s}.x2 - {s}.x1), 2) + pow({py} - {s}.y1 - {t} * ({s}.y2 - {s}.y1), 2))"


def _margin_sql(s: str) -> str:
    """CTEs mg: per building its nearest segment of s with distance and side; at a shared vertex the one more across."""
    return f"""ma AS (SELECT osm, s.line, s.seq, {_far_sql('px', 'py', 's')} AS d, s.cum + greatest(0, least(s.len, ((px - s.x1) * (s.x2 - s.x1) + (py - s.y1) * (s.y2 - s.y1)) / s.len)) AS ch, (s.x2 - s.x1) * (py - s.y1) - (s.y2 - s.y1) * (px - s.x1) AS c, s.len FROM bu CROSS JOIN {s} s),
mg AS (SELECT osm, arg_min(line, k) AS line, arg_min(ch, k) AS ch, arg_min(d, k) AS d, arg_min(sign(c), k) AS side FROM (SELECT *, (round(d, 6), -abs(coalesce(c / nullif(len, 0), 0)), seq) AS k FROM ma) GROUP BY 1)"""


@query(f"""{_SHORE},
a AS (SELECT transect_id AS id, baseline_x - 100 * positive_dx AS ax1, baseline_y - 100 * positive_dy AS ay1, baseline_x + 300 * positive_dx AS ax2, baseline_y + 300 * positive_dy AS ay2 FROM transects),
j AS (SELECT a.*, z.x1 AS bx, z.y1 AS by_, z.x2 - z.x1 AS ux, z.y2 - z.y1 AS uy, z.len AS ul, ax2 - ax1 AS dx, ay2 - ay1 AS dy FROM a JOIN z ON least(ax1, ax2) - 45 <= greatest(z.x1, z.x2) AND greatest(ax1, ax2) + 45 >= least(z.x1, z.x2) AND least(ay1, ay2) - 45 <= greatest(z.y1, z.y2) AND greatest(ay1, ay2) + 45 >= least(z.y1, z.y2)),
q AS (SELECT *, dx * dx + dy * dy AS aa, ((ax1 - bx) * ux + (ay1 - by_) * uy) / ul AS al, (dx * ux + dy * uy) / ul AS ad, ((ay1 - by_) * ux - (ax1 - bx) * uy) / ul AS cl, (dy * ux - dx * uy) / ul AS cd, (ax1 - bx) * dx + (ay1 - by_) * dy AS h1, pow(ax1 - bx, 2) + pow(ay1 - by_, 2) - 2025 AS e1, (ax1 - bx - ux) * dx + (ay1 - by_ - uy) * dy AS h2, pow(ax1 - bx - ux, 2) + pow(ay1 - by_ - uy, 2) - 2025 AS e2 FROM j),
f AS (SELECT *, h1 * h1 - aa * e1 AS d1, h2 * h2 - aa * e2 AS d2, CASE WHEN ad = 0 THEN CASE WHEN al BETWEEN 0 AND ul THEN -1e300 ELSE 1e300 END ELSE least((0 - al) / ad, (ul - al) / ad) END AS s0, CASE WHEN ad = 0 THEN CASE WHEN al BETWEEN 0 AND ul THEN 1e300 ELSE -1e300 END ELSE greatest((0 - al) / ad, (ul - al) / ad) END AS s1, CASE WHEN cd = 0 THEN CASE WHEN abs(cl) <= 45 THEN -1e300 ELSE 1e300 END ELSE least((-45 - cl) / cd, (45 - cl) / cd) END AS c0, CASE WHEN cd = 0 THEN CASE WHEN abs(cl) <= 45 THEN 1e300 ELSE -1e300 END ELSE greatest((-45 - cl) / cd, (45 - cl) / cd) END AS c1 FROM q),
g AS (SELECT id, aa, greatest(0, least(CASE WHEN d1 >= 0 THEN (-h1 - sqrt(greatest(d1, 0))) / aa ELSE 2 END, CASE WHEN d2 >= 0 THEN (-h2 - sqrt(greatest(d2, 0))) / aa ELSE 2 END, CASE WHEN greatest(s0, c0) <= least(s1, c1) THEN greatest(s0, c0) ELSE 2 END)) AS t0, least(1, greatest(CASE WHEN d1 >= 0 THEN (-h1 + sqrt(greatest(d1, 0))) / aa ELSE -1 END, CASE WHEN d2 >= 0 THEN (-h2 + sqrt(greatest(d2, 0))) / aa ELSE -1 END, CASE WHEN greatest(s0, c0) <= least(s1, c1) THEN least(s1, c1) ELSE -1 END)) AS t1 FROM f),
o AS (SELECT id, aa, t0, t1, max(t1) OVER (PARTITION BY id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g WHERE t0 < t1),
e AS (SELECT id, sum(greatest(0, t1 - greatest(t0, coalesce(b, 0))) * sqrt(aa)) AS l FROM o GROUP BY 1)
SELECT id, round(coalesce(l, 0), 4) AS exposed_length_m FROM a LEFT JOIN e USING (id)""")
def exposed_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of each transect that lies within 45 m of a last shoreline, for all transects."""
    t = _transect_segments(spark, d).select("id", "x1", "y1", "x2", "y2").withColumn("reach", F.lit(45.0))
    s = _shore_segments(spark, d).select(F.concat_ws(":", "g", "id").alias("id"), "x1", "y1", "x2", "y2")
    return rounded(exposure.exposed_length(t, s, "reach"))


@query(f"""{_SHORE}, {VERTEX_SQL}, {_segment_sql('v', 's')},
p AS (SELECT s.line, s.seq, least({_far_sql('s.x1', 's.y1', 'z')}, {_far_sql('s.x2', 's.y2', 'z')}, {_far_sql('z.x1', 'z.y1', 's')}, {_far_sql('z.x2', 'z.y2', 's')}) AS d, (s.x2 - s.x1) * (z.y2 - z.y1) - (s.y2 - s.y1) * (z.x2 - z.x1) AS det, (z.x1 - s.x1) * (z.y2 - z.y1) - (z.y1 - s.y1) * (z.x2 - z.x1) AS ta, (z.x1 - s.x1) * (s.y2 - s.y1) - (z.y1 - s.y1) * (s.x2 - s.x1) AS ua FROM s CROSS JOIN z)
SELECT line || ':' || seq AS id, round(min(CASE WHEN ta / nullif(det, 0) BETWEEN 0 AND 1 AND ua / nullif(det, 0) BETWEEN 0 AND 1 THEN 0 ELSE d END), 3) AS distance_m FROM p GROUP BY 1""")
def transect_shore_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each stretch of baseline from the nearest last shoreline, 0 where they cross."""
    f = lines.segments(baselines(spark, d)).select(F.concat_ws(":", "line", "seq").alias("id"), "x1", "y1", "x2", "y2")
    s = _shore_segments(spark, d).select(F.concat_ws(":", "g", "id").alias("id"), "x1", "y1", "x2", "y2")
    return rounded(exposure.line_distance(f, s), 3)


@query(f"""{_SHORE}, {_BUILT}, {_margin_sql('z')}
SELECT osm AS point, line, round(d, 3) AS distance_m, side, round(d - 21, 3) + 0.0 AS margin_m, side >= 0 AND d <= 21 AS reached, CASE WHEN d - 21 <= 25 THEN 'to_25' WHEN d - 21 <= 60 THEN 'to_60' ELSE 'beyond' END AS span FROM mg""")
def scenario_margins(spark: SparkSession, d: str) -> DataFrame:
    b = _buildings(spark, d).select(F.col("osm").alias("point"), F.col("px").alias("x"), F.col("py").alias("y"))
    m = scenario.margins(b, lines.segments(shore_vertices(spark, d)), scenario.retreat(F.lit(2040), F.lit(1.5), 2026))
    span = exposure.by_limits(F.col("margin_m"), [(25.0, True, "to_25"), (60.0, True, "to_60")], "beyond")
    return rounded(m.select("point", "line", "distance_m", "side", "margin_m", "reached", span.alias("span")), 3)


@query(f"""WITH {VERTEX_SQL}, {_segment_sql('v', 's')}, e AS (SELECT line, max(seq) AS last FROM s GROUP BY 1),
c AS (SELECT s.*, (i + 0.5) * 5 AS px, (j + 0.5) * 5 AS py FROM s, LATERAL (SELECT unnest(range(CAST(floor((least(x1, x2) - 81) / 5) AS BIGINT), CAST(ceil((greatest(x1, x2) + 81) / 5) AS BIGINT) + 1)) AS i), LATERAL (SELECT unnest(range(CAST(floor((least(y1, y2) - 81) / 5) AS BIGINT), CAST(ceil((greatest(y1, y2) + 81) / 5) AS BIGINT) + 1)) AS j)),
k AS (SELECT line, seq, px, py, round({_far_sql('px', 'py', 'c')}, 9) AS d, (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) AS cr, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (len * len) AS raw, len FROM c),
b AS (SELECT line, px, py, min((d, -abs(cr / len), seq, cr, raw)) AS b FROM k WHERE d <= 81 GROUP BY 1, 2, 3),
m AS (SELECT line, b[1] AS d FROM b JOIN e USING (line) WHERE NOT (b[3] = 0 AND b[5] < 0) AND NOT (b[3] = last AND b[5] > 1) AND b[4] > 0)
SELECT line, CASE WHEN d <= 21 THEN 'reached' WHEN d <= 46 THEN 'near' ELSE 'middle' END AS band, count(*) * 25.0::DOUBLE AS area_m2 FROM m GROUP BY 1, 2""")
def scenario_band_areas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenario.band_areas(baselines(spark, d), {"reached": (0.0, 21.0), "near": (21.0, 46.0), "middle": (46.0, 81.0)}, cell=5.0))


_STATIONS = f"""n AS (SELECT line, sum(len) AS length FROM s GROUP BY 1), t AS (SELECT line, k, length * k / 10 AS d, least(8, greatest(2, length / 500)) AS w FROM n, range(11) r(k)),
ta AS (SELECT line, k, d - w AS d FROM t), tb AS (SELECT line, k, d + w AS d FROM t), {_at_sql('s', 't', 'k', 'o')}, {_at_sql('s', 'ta', 'k', 'a')}, {_at_sql('s', 'tb', 'k', 'b')},
st AS (SELECT o.line, 'E' || lpad(CAST(o.k + 1 AS VARCHAR), 2, '0') AS station, CAST(f AS DOUBLE) AS offset_m, o.x - (b.y - a.y) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) * f AS x, o.y + (b.x - a.x) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) * f AS y
  FROM o JOIN a ON a.line = o.line AND a.k = o.k JOIN b ON b.line = o.line AND b.k = o.k, unnest([-50, 50, 150, 250, 260]) u(f))"""


@query(f"WITH {VERTEX_SQL}, {_segment_sql('v', 's')}, {_STATIONS} SELECT line, station, offset_m, round(x, 3) AS x, round(y, 3) AS y FROM st")
def station_network(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenario.stations(baselines(spark, d)), 3)


@query("SELECT station_id, round(avg(elevation_m) FILTER (offset_m = 50), 4) + 0.0 AS elevation_50_m, round(avg(elevation_m) FILTER (offset_m = 150), 4) + 0.0 AS elevation_150_m, round(avg(elevation_m) FILTER (offset_m = 250), 4) + 0.0 AS elevation_250_m, round((avg(elevation_m) FILTER (offset_m = 250) - avg(elevation_m) FILTER (offset_m = 50)) / 200 * 100, 4) + 0.0 AS slope_pct FROM elevation_profile_open_meteo GROUP BY 1")
def elevation_profile_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenario.profile(table(spark, d, "elevation_profile_open_meteo"), "station_id", "offset_m", "elevation_m"))


@query("""WITH p AS (SELECT osm_id, snapshot_date, latitude AS y, longitude AS x, delivery_id FROM buildings_risk)
SELECT delivery_id, floor(x * 10) AS zx, floor(y * 10) AS zy FROM p""")
def point_in_polygon_zonal(spark: SparkSession, d: str) -> DataFrame:
    """The tenth-degree square of each building row, found by the triangle join with squares on whole tenths."""
    b = table(spark, d, "buildings_risk").select(F.col("delivery_id").cast("string").alias("point"), F.col("longitude").alias("px"), F.col("latitude").alias("py"))
    z = b.select(F.floor(F.col("px") * 10).alias("zx"), F.floor(F.col("py") * 10).alias("zy")).distinct()
    x, y = F.col("zx") / 10, F.col("zy") / 10
    squares = z.select(F.concat_ws(":", "zx", "zy").alias("region"), F.array(x, x + 0.1, x + 0.1, x).alias("xs"), F.array(y, y, y + 0.1, y + 0.1).alias("ys"))
    hit = spatial.in_regions(b, squares)
    # a point on a shared border lies in two squares; the greater one counts
    one = hit.select("point", F.split("region", ":").alias("z")).select("point", F.struct(F.col("z")[0].cast("long"), F.col("z")[1].cast("long")).alias("z")).groupBy("point").agg(F.max("z").alias("z"))
    return one.select(F.col("point").cast("long").alias("delivery_id"), F.col("z.col1").cast("double").alias("zx"), F.col("z.col2").cast("double").alias("zy"))


@query(f"""{_SHORE}, {_BUILT},
c AS (SELECT osm, px, py, (i + 0.5) * 2 AS cx, (j + 0.5) * 2 AS cy FROM bu, LATERAL (SELECT unnest(range(CAST(ceil((px - 8) / 2 - 0.5) AS BIGINT), CAST(ceil((px + 8) / 2 - 0.5) AS BIGINT))) AS i), LATERAL (SELECT unnest(range(CAST(ceil((py - 6) / 2 - 0.5) AS BIGINT), CAST(ceil((py + 6) / 2 - 0.5) AS BIGINT))) AS j)),
n AS (SELECT osm, z.* FROM bu JOIN z ON px + 140 >= least(z.x1, z.x2) AND px - 140 <= greatest(z.x1, z.x2) AND py + 140 >= least(z.y1, z.y2) AND py - 140 <= greatest(z.y1, z.y2)),
h AS (SELECT c.osm, cx, cy, min({_far_sql('cx', 'cy', 'n')}) AS d FROM c JOIN n ON n.osm = c.osm GROUP BY 1, 2, 3), k AS (SELECT osm, count(*) AS k FROM h WHERE d <= 120 GROUP BY 1)
SELECT osm AS id, coalesce(k, 0) * 4.0::DOUBLE AS exposed_area_m2 FROM bu LEFT JOIN k USING (osm)""")
def exposed_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area of a 16 x 12 m square about each building within 120 m of the last shoreline."""
    b = _buildings(spark, d).select(F.col("osm").alias("id"), "px", "py")
    side = lambda c, a, e: F.array(F.col(c) - a, F.col(c) + (a if e else -a), F.col(c) + a, F.col(c) + (-a if e else a))
    sq = b.select("id", side("px", 8.0, True).alias("xs"), side("py", 6.0, False).alias("ys"), F.lit(120.0).alias("reach"))
    s = _shore_segments(spark, d).select(F.concat_ws(":", "g", "id").alias("id"), "x1", "y1", "x2", "y2")
    return rounded(exposure.exposed_area(sq, s, "reach", 2.0))


@query(f"WITH {VERTEX_SQL} SELECT line, round(min(x) - 500, 3) AS x0, round(min(y) - 500, 3) AS y0, round(max(x) + 500, 3) AS x1, round(max(y) + 500, 3) AS y1 FROM v GROUP BY 1")
def line_surroundings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.surroundings(baselines(spark, d), 500.0), 3)


@query(f"""WITH {VERTEX_SQL}, {_segment_sql('v', 's')}, {_BUILT}, {_margin_sql('s')}, {_STATIONS},
ns AS (SELECT osm, min((sqrt(pow(px - x, 2) + pow(py - y, 2)), line || chr(30) || station || chr(30) || CAST(offset_m AS VARCHAR), station, offset_m)) AS b FROM bu CROSS JOIN st GROUP BY 1)
SELECT osm AS point, round(px, 3) AS x, round(py, 3) AS y, line, round(ch, 3) AS chainage_m, round(d, 3) AS distance_m, side, 21.0::DOUBLE AS retreat_m, round(d - 21, 3) + 0.0 AS margin_m, side >= 0 AND d <= 21 AS reached, b[3] AS station, b[4] AS offset_m, round(b[1], 3) AS station_distance_m, CASE WHEN side < 0 AND d > 5 THEN 'outside' WHEN d - 21 <= 25 THEN 'to_25' WHEN d - 21 <= 60 THEN 'to_60' ELSE 'beyond' END AS label FROM mg JOIN bu USING (osm) JOIN ns USING (osm)""")
def scenario_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Every building under the scenario of 2040 at 1.5 m a year with its nearest station sample."""
    b = _buildings(spark, d).select(F.col("osm").alias("point"), F.col("px").alias("x"), F.col("py").alias("y"))
    return rounded(scenario.evaluated(b, baselines(spark, d), 2040, 1.5, 2026, [(25.0, True, "to_25"), (60.0, True, "to_60")], "beyond", 5.0), 3)


@query(f"WITH {VERTEX_SQL}, {_segment_sql('v', 's')}, {_BUILT}, {_margin_sql('s')} SELECT osm AS point, line, round(ch, 3) AS chainage_m, round(d, 3) AS distance_m FROM mg")
def line_project(spark: SparkSession, d: str) -> DataFrame:
    """The place of every building along its nearest baseline."""
    got = lines.projected(_buildings(spark, d).select(F.col("osm").alias("point"), "px", "py"), lines.segments(baselines(spark, d)))
    return rounded(got, 3)


@query(f"WITH {VERTEX_SQL}, {_segment_sql('v', 's')} SELECT line, round(sum((x1 + x2) / 2 * len) / sum(len), 3) AS x, round(sum((y1 + y2) / 2 * len) / sum(len), 3) AS y FROM s GROUP BY 1")
def line_centroid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.centroids(lines.segments(baselines(spark, d))), 3)


@query("SELECT beach_code, scene_year, correction_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY beach_code, scene_year ORDER BY correction_id) AS n FROM tide_corrections) WHERE n = 1")
def keep_first_corrections(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tide_corrections").select("beach_code", "scene_year", "correction_id", "item_id")
    return quality.keep_first(t, ["beach_code", "scene_year"], ["correction_id"])


_NODE = "SELECT r, c, n, w, (0.2 + 0.1 * ((r * 7 + c * 3 + n) % 5)) AS a, CAST((r * 31 + c * 17 + n * 40) % 360 AS DOUBLE) AS ph"


@query(f"""WITH {instant_cte('tc', 'tide_corrections', 'acquired_at_utc', 'clock_zone', 'correction_id, reference_longitude, reference_latitude')},
p AS (SELECT correction_id, reference_longitude / 0.25 AS u, reference_latitude / 0.25 AS v, us FROM tc WHERE us IS NOT NULL AND reference_longitude IS NOT NULL AND reference_latitude IS NOT NULL),
k AS (SELECT *, CAST(floor(v) AS BIGINT) + i AS r, CAST(floor(u) AS BIGINT) + j AS c FROM p, range(2) a(i), range(2) b(j)),
g AS ({_NODE} FROM (SELECT DISTINCT r, c FROM k WHERE abs(r + c) % 3 <> 0), (VALUES (1, 28.9841042), (2, 30.0), (3, 15.0410686)) z(n, w)),
e AS (SELECT correction_id, us, n, any_value(w) AS w, sum((1 - abs(v - r)) * (1 - abs(u - c)) * a * cos(radians(ph))) / sum((1 - abs(v - r)) * (1 - abs(u - c))) AS re, sum((1 - abs(v - r)) * (1 - abs(u - c)) * a * sin(radians(ph))) / sum((1 - abs(v - r)) * (1 - abs(u - c))) AS im FROM k JOIN g USING (r, c) GROUP BY 1, 2, 3),
h AS (SELECT correction_id, sum(re * cos(radians(w * (us / 3600000000.0))) - im * sin(radians(w * (us / 3600000000.0)))) AS h FROM e GROUP BY 1)
SELECT correction_id, round(h, 4) + 0.0 AS tide_height_m FROM tide_corrections LEFT JOIN h USING (correction_id)""")
def tide_gridded(spark: SparkSession, d: str) -> DataFrame:
    """Heights from a gridded model of three constituents with holes, at the reference place and time of every correction."""
    t = table(spark, d, "tide_corrections").select("correction_id", "reference_longitude", "reference_latitude", "acquired_at_utc", "clock_zone")
    t = instant_column(t, "acquired_at_utc", "clock_zone", "t")
    u, v = F.col("reference_longitude") / 0.25, F.col("reference_latitude") / 0.25
    corner = F.explode(F.array(*[F.struct((F.floor(v) + i).alias("row"), (F.floor(u) + j).alias("col")) for i in (0, 1) for j in (0, 1)]))
    node = t.where("t IS NOT NULL AND reference_longitude IS NOT NULL AND reference_latitude IS NOT NULL").select(corner.alias("k")).select("k.*").distinct().where(F.abs(F.col("row") + F.col("col")) % 3 != 0)
    grid = node.withColumn("m", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in ((1, 28.9841042), (2, 30.0), (3, 15.0410686))])))
    r, c, n = F.col("row"), F.col("col"), F.col("m.n")
    grid = grid.select("row", "col", n.cast("string").alias("name"), F.col("m.w").alias("speed_deg_per_hour"), (0.2 + 0.1 * ((r * 7 + c * 3 + n) % 5)).alias("amplitude_m"), ((r * 31 + c * 17 + n * 40) % 360).cast("double").alias("phase_deg"))
    return rounded(tides.gridded(t, ["correction_id"], "reference_longitude", "reference_latitude", "t", grid, 0.25))


@query(f"""{_NEAR.replace('WITH bd', f'WITH {SHORE_SQL}, {_segment_sql("w", "z")}, bd')},
sq AS (SELECT osm, px, py, unnest([{{'xa': -8, 'ya': -6, 'xb': 8, 'yb': -6}}, {{'xa': 8, 'ya': -6, 'xb': 8, 'yb': 6}}, {{'xa': 8, 'ya': 6, 'xb': -8, 'yb': 6}}, {{'xa': -8, 'ya': 6, 'xb': -8, 'yb': -6}}]) AS q FROM bu),
sd AS (SELECT osm, px + q.xa AS x1, py + q.ya AS y1, px + q.xb AS x2, py + q.yb AS y2 FROM sq),
pd AS (SELECT osm, least({_far_sql('sd.x1', 'sd.y1', 'z')}, {_far_sql('sd.x2', 'sd.y2', 'z')}, {_far_sql('z.x1', 'z.y1', 'sd')}, {_far_sql('z.x2', 'z.y2', 'sd')}) AS dd, (sd.x2 - sd.x1) * (z.y2 - z.y1) - (sd.y2 - sd.y1) * (z.x2 - z.x1) AS det, (z.x1 - sd.x1) * (z.y2 - z.y1) - (z.y1 - sd.y1) * (z.x2 - z.x1) AS ta, (z.x1 - sd.x1) * (sd.y2 - sd.y1) - (z.y1 - sd.y1) * (sd.x2 - sd.x1) AS ua FROM sd CROSS JOIN z),
fd AS (SELECT osm, min(CASE WHEN ta / nullif(det, 0) BETWEEN 0 AND 1 AND ua / nullif(det, 0) BETWEEN 0 AND 1 THEN 0 ELSE dd END) AS far FROM pd GROUP BY 1),
cc AS (SELECT osm, b.rate * 30 AS reach, (i + 0.5) * 2 AS cx, (j + 0.5) * 2 AS cy FROM bu JOIN b USING (osm), LATERAL (SELECT unnest(range(CAST(ceil((px - 8) / 2 - 0.5) AS BIGINT), CAST(ceil((px + 8) / 2 - 0.5) AS BIGINT))) AS i), LATERAL (SELECT unnest(range(CAST(ceil((py - 6) / 2 - 0.5) AS BIGINT), CAST(ceil((py + 6) / 2 - 0.5) AS BIGINT))) AS j) WHERE b.rate > 0),
hh AS (SELECT cc.osm, cx, cy, any_value(reach) AS reach, min({_far_sql('cx', 'cy', 'z')}) AS dd FROM cc CROSS JOIN z GROUP BY 1, 2, 3), kk AS (SELECT osm, count(*) AS k FROM hh WHERE dd <= reach GROUP BY 1)
SELECT osm AS id, line AS transect_id, round(rate, 6) + 0.0 AS rate, round(far, 3) AS distance_m, CASE WHEN rate > 0 THEN round(far / rate, 3) END AS years_to_impact, 30 AS horizon_years, coalesce(k, 0) * 4.0::DOUBLE AS exposed_area_m2 FROM b JOIN fd USING (osm) LEFT JOIN kk USING (osm)""")
def building_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Every building as a square of 16 x 12 m against the last shorelines over 30 years."""
    b = _buildings(spark, d)
    side = lambda c, a, e: F.array(F.col(c) - a, F.col(c) + (a if e else -a), F.col(c) + a, F.col(c) + (-a if e else a))
    sq = b.select(F.col("osm").alias("id"), side("px", 8.0, True).alias("xs"), side("py", 6.0, False).alias("ys"))
    s = _shore_segments(spark, d).select(F.concat_ws(":", "g", "id").alias("id"), "x1", "y1", "x2", "y2")
    got = exposure.assessed(sq, s, _transect_rates(spark, d), "transect_id", "rate", 30, 2.0)
    return got.select("id", "transect_id", (F.round("rate", 6) + 0.0).alias("rate"), F.round("distance_m", 3).alias("distance_m"), F.round("years_to_impact", 3).alias("years_to_impact"), "horizon_years", "exposed_area_m2")


@query("SELECT delivery_id, CASE lower(trim(risk_level)) WHEN 'bajo' THEN 'low' WHEN 'moderado' THEN 'medium' WHEN 'critico' THEN 'high' ELSE 'none' END AS label, printf('https://www.openstreetmap.org/?mlat=%.7f&mlon=%.7f', latitude, longitude) AS link, round(exposed_area_m2 / 10000, 8) + 0.0 AS hectares, 'B' || CASE WHEN length(CAST(delivery_id AS VARCHAR)) >= 6 THEN CAST(delivery_id AS VARCHAR) ELSE lpad(CAST(delivery_id AS VARCHAR), 6, '0') END AS code FROM buildings_risk")
def feature_labels(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "buildings_risk")
    names = {"bajo": "low", "moderado": "medium", "critico": "high"}
    return b.select("delivery_id", labels.by_name(F.col("risk_level"), names, "none").alias("label"), labels.map_link(F.col("latitude"), F.col("longitude")).alias("link"), (F.round(labels.hectares(F.col("exposed_area_m2")), 8) + 0.0).alias("hectares"), labels.numbered("B", F.col("delivery_id"), 6).alias("code"))


@query("SELECT CAST(y AS INTEGER) AS missing_year FROM range(2015, 2029) r(y) WHERE y NOT IN (SELECT year(start_date) FROM marejadas_oficiales_armada WHERE start_date IS NOT NULL)")
def years_without_events(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "marejadas_oficiales_armada").where("start_date IS NOT NULL").select(F.year("start_date").alias("y"))
    return catalog.missing_years(n, "y", 2015, 2028)


@query("WITH o AS (SELECT beach_code, arg_min(correction_id, (abs(tide_height_m), correction_id)) AS correction_id FROM tide_corrections WHERE tide_height_m IS NOT NULL GROUP BY 1) SELECT t.transect_id, o.correction_id FROM transects t LEFT JOIN o USING (beach_code)")
def tide_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The calmest correction of each beach looked up for its transects, many to one with the key checked."""
    c = table(spark, d, "tide_corrections").where("tide_height_m IS NOT NULL")
    dim = c.groupBy("beach_code").agg(F.min_by("correction_id", F.struct(F.abs("tide_height_m"), "correction_id")).alias("correction_id"))
    return quality.many_to_one(table(spark, d, "transects").select("transect_id", "beach_code"), dim, ["beach_code"]).select("transect_id", "correction_id")
