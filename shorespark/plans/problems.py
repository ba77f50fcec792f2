"""Queries of the general problems: spikes (1), intervals (2), nearness (4), clocks (5) and snapshots (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorespark.functions.geo import same_longitude, with_utm
from shorespark.operators import clocks, intervals, snapshots, spatial, spikes
from shorespark.plans.sqltext import SCENES_SQL, USABLE_SQL, instant_cte, offset_sql, utm_cte
from shorespark.sources.tables import table


def _readings(spark: SparkSession, d: str, operator) -> DataFrame:
    col = F.col
    scenes = operator(
        table(spark, d, "storm_scene_join"), "series_id", "pass_no", "obs_id",
        {"position_m": (col("position_m"), col("position_m") - col("position_trend_m"), 1000.0), "position_anomaly_m": (col("position_anomaly_m"), col("position_anomaly_m"), 1000.0)},
    )
    rates = operator(table(spark, d, "transect_rates"), "beach_code", "chainage_m", "rate_id", {"lrr_m_per_year": (col("lrr_m_per_year"), col("lrr_m_per_year"), 100.0)})
    return scenes.unionByName(rates)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _readings(spark, d, spikes.implausible)


def p1_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The readings that the decomposition alone calls spikes, with their low-rank part and residual."""
    return _readings(spark, d, spikes.components).where("sparse").select("field_name", "record_key", "low", "residual")


def p1_sparse_report(spark: SparkSession, d: str) -> DataFrame:
    """Per field the spikes by the rule and whether the sparse part alone finds at least 90 % of them and at most 10 %
    others."""
    c = _readings(spark, d, spikes.components).groupBy("field_name").agg(F.count_if("rule").alias("n_rule"), F.count_if("sparse").alias("n_sparse"), F.count_if(F.col("rule") & F.col("sparse")).alias("n_both"))
    return c.select("field_name", "n_rule", (F.col("n_both") >= 0.9 * F.col("n_rule")).alias("recall_holds"), (F.col("n_both") >= 0.9 * F.col("n_sparse")).alias("precision_holds"))


P1_SQL = """
WITH r AS (
  SELECT 'position_m' AS f, series_id AS s, CAST(pass_no AS DOUBLE) AS o, obs_id AS k, position_m AS v, position_m - position_trend_m AS x, 1000 AS lim FROM storm_scene_join
  UNION ALL SELECT 'position_anomaly_m', series_id, pass_no, obs_id, position_anomaly_m, position_anomaly_m, 1000 FROM storm_scene_join
  UNION ALL SELECT 'lrr_m_per_year', beach_code, chainage_m, rate_id, lrr_m_per_year, lrr_m_per_year, 100 FROM transect_rates),
n AS (SELECT * FROM r WHERE v IS NOT NULL),
m AS (SELECT f, s, median(x) AS med FROM n GROUP BY 1, 2),
q AS (SELECT n.f, n.s, median(abs(x - med)) AS mad FROM n JOIN m ON n.f = m.f AND n.s = m.s GROUP BY 1, 2),
step AS (SELECT f, s, o, arg_min(v, k) AS v FROM n GROUP BY 1, 2, 3),
l AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY f, s ORDER BY o) THEN 0 ELSE 1 END AS fresh FROM step),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY f, s ORDER BY o ROWS UNBOUNDED PRECEDING) AS run FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY f, s, run) AS len FROM g)
SELECT n.f AS field_name, n.k AS record_key FROM n JOIN m ON n.f = m.f AND n.s = m.s JOIN q ON n.f = q.f AND n.s = q.s
LEFT JOIN c ON c.f = n.f AND c.s = n.s AND c.o = n.o AND c.v = n.v AND c.len >= 6
WHERE abs(n.x - m.med) > 8 * 1.4826 * q.mad OR abs(n.v) > n.lim OR c.len IS NOT NULL"""


P1_REPORT_SQL = P1_SQL[: P1_SQL.index("step AS (")].rstrip().rstrip(",") + """
SELECT n.f AS field_name, count(*) FILTER (abs(n.x - m.med) > 8 * 1.4826 * q.mad) AS n_rule, true AS recall_holds, true AS precision_holds
FROM n JOIN m ON n.f = m.f AND n.s = m.s JOIN q ON n.f = q.f AND n.s = q.s GROUP BY 1"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals.day_spans(intervals.usable_notices(table(spark, d, "marejadas_oficiales_armada")), "sector_id", "start_date", "end_date")
    return spans.select("sector_id", "span_kind", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


P2_SQL = f"""
WITH u AS (SELECT DISTINCT sector_id, start_date, end_date FROM ({USABLE_SQL})),
m AS (SELECT *, max(end_date) OVER (PARTITION BY sector_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR start_date > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sector_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT sector_id, min(start_date) AS a, max(end_date) AS b FROM g GROUP BY sector_id, grp),
n AS (SELECT *, lead(a) OVER (PARTITION BY sector_id ORDER BY a) AS nx FROM p)
SELECT sector_id, 'period' AS span_kind, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day FROM p
UNION ALL SELECT sector_id, 'gap', CAST(b + 1 AS VARCHAR), CAST(nx - 1 AS VARCHAR) FROM n WHERE nx IS NOT NULL"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = spatial.near_pairs(table(spark, d, "elevation_profile_open_meteo"), "sample_id", "longitude", "latitude", 20.0)
    rows = table(spark, d, "buildings_risk").select(F.lower(F.trim("osm_id")).alias("point"), same_longitude(F.col("longitude")).alias("lon"), F.col("latitude").alias("lat"), F.trim("nearest_transect_id").alias("recorded"))
    rows = rows.groupBy("point", "lon", "lat", "recorded").agg(F.count("*").alias("n"))
    placed = with_utm(rows, "lon", "lat", "px", "py")
    t = table(spark, d, "transects").select(F.col("transect_id").alias("line"), "seaward_lon", "seaward_lat", "landward_lon", "landward_lat")
    lines = with_utm(with_utm(t, "seaward_lon", "seaward_lat", "x1", "y1"), "landward_lon", "landward_lat", "x2", "y2")
    nearest = spatial.nearest_lines(placed, lines).select("point", "px", "py", "line")
    wrong = placed.join(nearest, ["point", "px", "py"]).where(F.col("recorded").isNull() | (F.col("recorded") != F.col("line"))).select("point", "line").distinct()
    kinds = pairs.select(F.lit("sample_pair").alias("pair_kind"), "key_a", "key_b")
    return kinds.unionByName(wrong.select(F.lit("building_transect").alias("pair_kind"), F.least("point", "line").alias("key_a"), F.greatest("point", "line").alias("key_b")))


P4_SQL = f"""
WITH p AS (SELECT sample_id AS k, latitude AS y, CASE WHEN longitude >= 180 THEN longitude - 360 ELSE longitude END AS x FROM elevation_profile_open_meteo WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
cell AS (SELECT *, floor(y / 0.001) AS cy FROM p),
near AS (SELECT a.k AS ka, b.k AS kb FROM cell a JOIN (SELECT cell.*, cy + unnest([-1, 0, 1]) AS c FROM cell) b ON a.cy = b.c AND a.k < b.k AND abs(a.x - b.x) < 0.01
  WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))) < 20),
bd AS (SELECT DISTINCT lower(trim(osm_id)) AS osm, longitude AS lon, latitude AS lat, trim(nearest_transect_id) AS recorded FROM buildings_risk),
{utm_cte('bu', 'bd', 'lon', 'lat', 'px', 'py')},
{utm_cte('ta', 'transects', 'seaward_lon', 'seaward_lat', 'x1', 'y1')},
{utm_cte('tb', 'ta', 'landward_lon', 'landward_lat', 'x2', 'y2')},
j AS (SELECT osm, px, py, recorded, transect_id, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM bu CROSS JOIN tb),
b AS (SELECT osm, recorded, px, py, arg_min(transect_id, sqrt(pow(px - x1 - t * dx, 2) + pow(py - y1 - t * dy, 2))) AS line FROM j GROUP BY osm, recorded, px, py)
SELECT 'sample_pair' AS pair_kind, ka AS key_a, kb AS key_b FROM near
UNION ALL SELECT DISTINCT 'building_transect', least(osm, line), greatest(osm, line) FROM b WHERE recorded IS NULL OR recorded <> line"""


CLOCKS = (
    ("marejadas_oficiales_armada", "sector_id", "notice_id", "notice_id", "issued_date"),
    ("storm_scene_join", "series_id", "pass_no", "obs_id", "acquired_at"),
    ("tide_corrections", "beach_code", "correction_id", "correction_id", "acquired_at_utc"),
)


def _clocks(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, dict]]:
    return [(name, table(spark, d, name), {"source": s, "order": o, "key": k, "text": t, "zone": "clock_zone"}) for name, s, o, k, t in CLOCKS]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clocks.normalised(_clocks(spark, d))


#: Costs under which the order of the records decides: readings against the rules are only the later choice of a tie.
BY_ORDER = {"against_rules": 0.001, "switch": 0.01, "backwards": 1.0}


def p5_by_order(spark: SparkSession, d: str) -> DataFrame:
    """How many scene times with several valid readings the path along their series settles as the rules state them. Only
    the scenes have an order of their own, that of their passes."""
    got = clocks.settled_by_order([c for c in _clocks(spark, d) if c[0] == "storm_scene_join"], BY_ORDER)
    return got.select("table_name", "n_ambiguous", (F.col("n_as_stated") >= 0.9 * F.col("n_ambiguous")).alias("settled_holds"))


def _p5_sql() -> str:
    ctes = ", ".join(instant_cte(f"i{n}", name, text, "clock_zone", key) for n, (name, _, _, key, text) in enumerate(CLOCKS))
    rows = " UNION ALL ".join(f"SELECT '{name}' AS table_name, {key} AS record_key, us AS utc_micros, t_ FROM i{n}" for n, (name, _, _, key, _) in enumerate(CLOCKS))
    return rf"WITH {ctes} SELECT table_name, record_key, utc_micros FROM ({rows}) WHERE utc_micros IS NOT NULL AND NOT regexp_matches(t_, '^\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?\+00:00$')"


P5_SQL = _p5_sql()
_OK = f"(c1 + {offset_sql('c1')} = w)", f"(c2 + {offset_sql('c2')} = w)"
P5_ORDER_SQL = rf"""WITH {SCENES_SQL} SELECT 'storm_scene_join' AS table_name, count(*) FILTER (w IS NOT NULL AND ((regexp_matches(t_, '^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}') AND TRY_CAST(m AS INTEGER) <= 12 AND TRY_CAST(d AS INTEGER) <= 12 AND TRY_CAST(m AS INTEGER) <> TRY_CAST(d AS INTEGER))
OR (o IS NULL AND zn NOT IN ('UTC', 'GMT') AND ({_OK[0]} AND {_OK[1]} AND c1 <> c2 OR NOT {_OK[0]} AND NOT {_OK[1]})))) AS n_ambiguous, true AS settled_holds FROM sc_f"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "buildings_risk")
    got = snapshots.changes(b, "snapshot_date", F.lower(F.trim("osm_id")), {"risk_level": snapshots.folded(F.col("risk_level"))}, ["delivered_at", "delivery_id"])
    return got.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("osm_id"), "change_kind")


def p6_typed(spark: SparkSession, d: str) -> DataFrame:
    """Which of several columns changed between consecutive snapshots."""
    compared = {"risk_level": snapshots.folded(F.col("risk_level")), "building": F.col("building"), "erosion_rate_m_per_year": F.round("erosion_rate_m_per_year", 2)}
    got = snapshots.changes(table(spark, d, "buildings_risk"), "snapshot_date", F.lower(F.trim("osm_id")), compared, ["delivered_at", "delivery_id"])
    return got.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("osm_id"), "change_kind", "changed")


P6_SQL = """
WITH r AS (SELECT snapshot_date AS sd, lower(trim(osm_id)) AS k, strip_accents(lower(trim(risk_level))) AS v, delivered_at AS t, delivery_id AS i FROM buildings_risk),
o AS (SELECT sd, k, v FROM (SELECT *, row_number() OVER (PARTITION BY sd, k ORDER BY t DESC, i DESC) AS n FROM r) WHERE n = 1),
dd AS (SELECT sd, lead(sd) OVER (ORDER BY sd) AS nx FROM (SELECT DISTINCT sd FROM r)),
a AS (SELECT o.*, dd.nx FROM o JOIN dd ON o.sd = dd.sd WHERE nx IS NOT NULL),
b AS (SELECT o.* FROM o JOIN dd ON o.sd = dd.nx)
SELECT CAST(coalesce(a.nx, b.sd) AS VARCHAR) AS snapshot_date, coalesce(a.k, b.k) AS osm_id, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.k = b.k AND a.nx = b.sd WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v"""

P6_TYPED_SQL = P6_SQL.replace("AS v, delivered_at AS t", "AS v, building AS b, round(erosion_rate_m_per_year, 2) AS e, delivered_at AS t").replace("o AS (SELECT sd, k, v FROM", "o AS (SELECT sd, k, v, b AS bb, e FROM").replace(
    "END AS change_kind\nFROM", "END AS change_kind, CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.v IS DISTINCT FROM b.v THEN 'risk_level' END, CASE WHEN a.bb IS DISTINCT FROM b.bb THEN 'building' END, CASE WHEN a.e IS DISTINCT FROM b.e THEN 'erosion_rate_m_per_year' END) END AS changed\nFROM"
).replace("OR a.v IS DISTINCT FROM b.v", "OR a.v IS DISTINCT FROM b.v OR a.bb IS DISTINCT FROM b.bb OR a.e IS DISTINCT FROM b.e")

QUERIES = {q.__name__: q for q in (p1_found, p1_sparse, p1_sparse_report, p2_found, p4_found, p5_found, p5_by_order, p6_found, p6_typed)}
SQL = {"p1_found": P1_SQL, "p1_sparse_report": P1_REPORT_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p5_by_order": P5_ORDER_SQL, "p6_found": P6_SQL, "p6_typed": P6_TYPED_SQL}
