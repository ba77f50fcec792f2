"""Numbers that the shoreline operators must reach on analytic inputs and on published results."""

import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from shorespark.operators import catalog, change, exposure, lines, polygons, quality, raster, scenario, storms, tides
from shorespark.sources import files

US = lambda s: int(datetime.fromisoformat(s).astimezone(timezone.utc).timestamp() * 1e6)

# Published positions of 11 scenes with their trend, and the correlation of the anomaly with the event class.
SCENES = [
    ("2016-02-04 14:42:56+00:00", -2.8996139494502526, -24.083254740882428, 0), ("2017-03-10 14:51:18.458000+00:00", -27.048929522871845, -27.948922824003407, 1),
    ("2018-03-15 14:52:18.040000+00:00", -78.4032768296123, -31.5246204793146, 1),
]


def test_known_rate(spark):
    rows = [(f"T{t}", y, 10.0 * t + 2 * (y - 2016)) for t in range(3) for y in (2016, 2018, 2020, 2026)]
    rows += [("one", 2016, 1.0), ("two", 2016, 1.0), ("two", 2018, 3.0), ("none", 2016, None), ("flat", 2016, 5.0), ("flat", 2017, 5.0), ("flat", 2018, 5.0), ("T0", 2016, float("nan"))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, year int, p double")
    got = {r.id: r for r in change.rates(df, ["id"], "year", "p").collect()}
    for t in range(3):
        r = got[f"T{t}"]
        assert (r.nsm_m, r.epr_m_per_year, r.analysis_status) == (20.0, 2.0, "ok")
        assert abs(r.lrr_m_per_year - 2) < 1e-12 and r.lrr_r2 == pytest.approx(1) and r.lrr_standard_error_m_per_year < 1e-10 and r.lrr_ci95_low_m_per_year == pytest.approx(2)
    assert got["one"].analysis_status == "insufficient_observations" and got["one"].lrr_m_per_year is None
    assert got["two"].analysis_status == "ok_without_lrr_uncertainty" and got["two"].lrr_m_per_year == 1.0 and got["two"].lrr_ci95_low_m_per_year is None
    assert got["none"].analysis_status == "no_intersections" and got["flat"].lrr_r2 == 1.0
    assert got["two"].temporal_completeness_pct == pytest.approx(100 * 2 / 5)


def test_critical_values(spark):
    row = spark.range(1).select(*[change.critical_t(F.lit(d)).alias(f"t{d}") for d in (0, 5, 9, 30, 35, 50, 100, 500)]).first()
    assert list(row) == [None, 2.571, 2.262, 2.042, 2.021, 2.0, 1.98, 1.96]


def test_student_p_of_the_published_correlation(spark):
    r = spark.range(1).select(storms.student_p(F.lit(-1.3303106976), F.lit(9)).alias("p"), storms.student_p(F.lit(2.0), F.lit(4)).alias("q"), storms.student_p(F.lit(1.0), F.lit(1)).alias("c")).first()
    assert r.p == pytest.approx(0.21613851567735565, abs=1e-9) and r.q == pytest.approx(0.11611652351681559) and r.c == pytest.approx(0.5)


def test_point_biserial_guards(spark):
    of = lambda rows: storms.point_biserial(spark.createDataFrame(rows, "y double, x int"), "y", "x").first()
    assert of([(1.0, 0), (2.0, 0), (9.0, 1), (10.0, 1), (1.5, 0)]).correlation_r > 0.9
    assert of([(1.0, 0)] * 3 + [(1.0, 1)] * 3).status == "INSUFFICIENT_DATA"
    assert of([(1.0, 0), (2.0, 0), (3.0, 0), (4.0, 0), (5.0, 1)]).status == "INSUFFICIENT_DATA"
    assert of([]).n == 0


def test_published_anomalies_and_distances(spark):
    s = spark.createDataFrame([(i, "a", US(t)) for i, (t, *_) in enumerate(SCENES)], "k int, g string, t long")
    e = spark.createDataFrame([("ARMADA-54-2016", "a", US("2016-11-16T00:00+00:00"), US("2016-11-19T00:00+00:00")), ("ARMADA-11MAR-2017", "a", US("2017-03-11T00:00+00:00"), US("2017-03-15T00:00+00:00"))], "id string, g string, s long, e long")
    got = {r.k: r for r in storms.tagged(s, "k", "t", e, "id", "s", "e", ["g"]).collect()}
    assert got[0].nearest_official_event_days == pytest.approx(285.3868518518519) and got[0].official_storm_event == 0 and got[0].official_event_ids == ""
    assert got[1].nearest_official_event_days == pytest.approx(0.38103636574074073) and got[1].official_event_ids == "ARMADA-11MAR-2017"


def test_tagged_equals_brute_force(spark):
    rnd = random.Random(6)
    day = storms.DAY
    ev = [(f"e{i}", rnd.choice("ab"), (s := rnd.randint(0, 400)) * day, (s + rnd.randint(0, 5)) * day) for i in range(60)]
    sc = [(i, rnd.choice("abc"), rnd.randint(-50 * day, 500 * day)) for i in range(400)] + [(900, "a", None), (901, None, 5)]
    got = {r.k: r for r in storms.tagged(spark.createDataFrame(sc, "k int, g string, t long"), "k", "t", spark.createDataFrame(ev + ev[:5], "id string, g string, s long, e long"), "id", "s", "e", ["g"]).collect()}
    assert len(got) == len(sc)
    for k, g, t in sc:
        own = [x for x in ev if x[1] == g] if t is not None else []
        hit = sorted((s, i) for i, _, s, e in own if s - 3 * day <= t <= e + 3 * day)
        assert got[k].official_event_ids == ";".join(i for _, i in hit) and got[k].official_event_count == len(hit)
        far = min((max(0, s - t, t - e) for _, _, s, e in own), default=None)
        assert got[k].nearest_official_event_days == (pytest.approx(far / day) if far is not None else None)


def line(spark, name, pts):
    return spark.createDataFrame([(name, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "line string, seq long, x double, y double")


def test_transects_are_perpendicular_and_of_their_length(spark):
    v = line(spark, "a", [(0, 1000 - 10 * i) for i in range(101)])
    t = lines.fixed_transects(v, spacing=300.0).orderBy("k").collect()
    assert [r.chainage_m for r in t] == [0, 300, 600, 900, 1000]
    assert all((r.normal_x, r.normal_y) == (1.0, 0.0) and r.sea_x == -100 and r.land_x == 300 for r in t)
    with pytest.raises(ValueError):
        lines.fixed_transects(v, positive_side="up")


def test_crossings_and_median(spark):
    a = spark.createDataFrame([("g", "t1", 5.0, -50.0, 5.0, 250.0), ("g", "t2", 500.0, -50.0, 500.0, 250.0)], "g string, id string, x1 double, y1 double, x2 double, y2 double")
    shore = lines.segments(line(spark, "g", [(-100, 20), (5, 20), (100, 120), (4, 140)])).select(F.col("line").alias("g"), F.col("seq").alias("id"), "x1", "y1", "x2", "y2").withColumn("shore", F.lit(1))
    got = {r.id: r for r in lines.nearest_crossings(a, shore, 50.0).collect()}
    assert got["t1"].position_m == pytest.approx(20.0) and got["t1"].candidate_count == 2 and got["t1"].intersection_method == "nearest_of_multiple"
    assert got["t2"].position_m is None and got["t2"].intersection_method == "no_intersection"
    ups = [line(spark, f"l{i}", pts) for i, pts in enumerate(([(0, 0), (100, 0)], [(100, 10), (0, 10)], [(0, 4), (100, 4)]))]
    rs = lines.resampled(ups[0].unionByName(ups[1]).unionByName(ups[2]), 5).withColumn("group", F.lit("g"))
    m = lines.median_line(rs).orderBy("i").collect()
    assert [(round(r.x, 6), round(r.y, 6)) for r in m] == [(25 * i, 4.0) for i in range(5)]


def test_tide_correction_moves_seaward_and_water_wins(spark):
    v = line(spark, "a", [(0, 100 - 10 * i) for i in range(6)])
    shifts = spark.createDataFrame([("a", 20.0)], "line string, shift_m double")
    land = spark.createDataFrame([("a", 500.0, 50.0)], "line string, x double, y double")
    water = spark.createDataFrame([("a", [0.0, 400.0, 400.0, 0.0], [-100.0, -100.0, 300.0, 300.0])], "line string, xs array<double>, ys array<double>")
    assert {round(r.x, 6) for r in tides.corrected(v, shifts, land=land).collect()} == {-20.0}
    moved = tides.corrected(v, shifts, water=water, land=land).collect()
    assert {round(r.x, 6) for r in moved} == {20.0} and {r.direction_method for r in moved} == {"water_polygon"}
    assert {r.direction_method for r in tides.corrected(v, shifts).collect()} == {"undetermined"}
    r = spark.range(1).select(tides.shift(F.lit(1.0), F.lit(0.05)).alias("a"), tides.shift(F.lit(1.0), F.lit(0.0)).alias("b"), tides.shift(F.lit(None).cast("double"), F.lit(0.05)).alias("c")).first()
    assert list(r) == [20.0, None, None]


def test_index_and_majority(spark):
    df = spark.createDataFrame([(3.0, 1.0, 4), (1.0, 3.0, 4), (0.0, 0.0, 4), (3.0, 1.0, 9), (3.0, 1.0, None), (None, 1.0, 4)], "g double, n double, s int")
    got = [r[0] for r in df.select(raster.ndwi(F.col("g"), F.col("n"), raster.valid_pixel(F.col("g"), F.col("n"), F.col("s")))).collect()]
    assert got == [0.5, -0.5, None, None, None, None]
    m = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True), (2, "b", True), (3, "a", None), (3, "b", False)], "c int, s string, w boolean")
    assert {r.c: r.water for r in raster.majority(m, ["c"], "s", "w").collect()} == {1: False, 2: True, 3: False}


def test_components_equal_flood_fill(spark):
    rnd = random.Random(8)
    cells = {(r, c) for r in range(25) for c in range(25) if rnd.random() < 0.6}
    df = spark.createDataFrame([("k", r, c) for r, c in cells], "k string, row long, col long")
    got = {}
    for r in raster.components(df, "k").collect():
        got.setdefault(r.component, set()).add((r.row, r.col))
    want, left = [], set(cells)
    while left:
        todo, part = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        want.append(part)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert raster.components(df.limit(0), "k").collect() == []


def test_polygons(spark):
    df = spark.createDataFrame([([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 2.0, 2.0]), ([0.0, 1.0], [0.0, 1.0])], "xs array<double>, ys array<double>")
    x, y = F.col("xs"), F.col("ys")
    r = df.select(polygons.signed_area(x, y).alias("a"), polygons.centroid(x, y).alias("c"), polygons.contains(x, y, F.lit(1.0), F.lit(1.0)).alias("i"), polygons.contains(x, y, F.lit(5.0), F.lit(1.0)).alias("o")).collect()
    assert (r[0].a, tuple(r[0].c), r[0].i, r[0].o) == (8.0, (2.0, 1.0), True, False) and r[1].a is None
    cut = polygons.coverage(df, "xs", "ys", F.lit(2.0), F.lit(1.0), F.lit(6.0), F.lit(3.0), "s").collect()
    assert [q.s for q in cut] == [0.25, 0.0]
    w = spark.range(1).select(polygons.length_within(*[F.lit(v) for v in (-10.0, 0.0, 10.0, 0.0, 0.0, 3.0, 5.0)])).first()[0]
    assert w == pytest.approx(8.0)


def test_margins_and_bands(spark):
    v = line(spark, "a", [(0, 0), (0, -100), (50, -200)])
    pts = spark.createDataFrame([("land", 30.0, -50.0), ("sea", -30.0, -50.0), ("far", 300.0, -50.0)], "point string, x double, y double")
    got = {r.point: r for r in scenario.margins(pts, lines.segments(v), scenario.retreat(F.lit(2046), F.lit(2.0), 2026)).collect()}
    assert got["land"].reached and got["land"].margin_m == pytest.approx(-10) and not got["sea"].reached and not got["far"].reached
    straight = line(spark, "s", [(0, 0), (0, -100)])
    areas = {r.band: r.area_m2 for r in scenario.band_areas(straight, {"a": (0.0, 20.0), "b": (20.0, 60.0)}, 1.0).collect()}
    assert areas == {"a": pytest.approx(2000, rel=0.02), "b": pytest.approx(4000, rel=0.02)}


def test_exposure(spark):
    roads = spark.createDataFrame([("r", 0.0, 0.0, 100.0, 0.0, 30.0), ("x", 0.0, 500.0, 10.0, 500.0, -1.0)], "id string, x1 double, y1 double, x2 double, y2 double, reach double")
    shore = spark.createDataFrame([("s", 0.0, -10.0, 0.0, 10.0), ("t", -5.0, 900.0, -5.0, 910.0)], "id string, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.exposed_length_m for r in exposure.exposed_length(roads, shore, "reach").collect()}
    assert got == {"r": pytest.approx(30, abs=1), "x": 0.0}
    far = {r.id: r.distance_m for r in exposure.line_distance(roads, shore).collect()}
    assert far["r"] == 0 and far["x"] == pytest.approx(math.hypot(5 + 0, 400), rel=1e-9)
    r = spark.range(1).select(exposure.years_to_impact(F.lit(10.0), F.lit(-1.0)).alias("a"), exposure.by_limits(F.lit(30.0), [(10.0, False, "x"), (30.0, True, "y")], "z").alias("b"), exposure.by_limits(F.lit(None).cast("double"), [(10.0, False, "x")], "z").alias("c")).first()
    assert list(r) == [None, "y", "z"]


def test_catalogue_window_and_items(spark):
    assert catalog.month_window(2024, 1, 2) == ("2024-01-01T00:00:00Z", "2024-02-29T23:59:59Z")
    s = spark.createDataFrame([("a", "/x", True, "ready"), ("b", "/y", True, "ready")], "item_id string, href string, needs_auth boolean, status string")
    o = spark.createDataFrame([("a", "/local")], "item_id string, href string")
    got = {r.item_id: (r.href, r.needs_auth, r.status) for r in catalog.localised(s, o, "item_id", ["href"]).collect()}
    assert got == {"a": ("/local", False, "local"), "b": ("/y", True, "ready")}


OSM = """<osm><node id="1" lat="-33.1" lon="-71.1"/><node id="2" lat="-33.2" lon="-71.2"/><node id="3" lat="-33.3" lon="-71.3"/>
<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="9"/><nd ref="1"/><tag k="natural" v="beach"/></way></osm>"""


def test_sources(spark, tmp_path):
    ring = files.osm_way(spark.createDataFrame([(OSM,)], "t string"), "t", 7)
    assert [(r.seq, r.node, r.lon) for r in ring.orderBy("seq").collect()] == [(0, 1, -71.1), (1, 2, -71.2), (2, 9, None), (3, 1, -71.1)]
    assert tuple(files.way_checks(ring).first()) == (4, 1, True)
    head = "event_id,start_date,end_date,affects_cartagena,source_agency,source_url\n"
    events = lambda name, *rows: ((tmp_path / name).write_text(head + "\n".join(rows) + "\n", "utf-8"), files.read_events(spark, str(tmp_path / name)))[1]
    got = events("e.csv", "b,2017-03-11,2017-03-15,TRUE,m,u", "a,2016-03-11,2016-03-15,false,m,u")
    assert [(r.event_id, r.affects_cartagena) for r in got.collect()] == [("a", False), ("b", True)]
    with pytest.raises(Exception, match="ends before"):
        events("bad.csv", "b,2017-03-11,2017-03-05,TRUE,m,u").collect()
    with pytest.raises(Exception, match="true or false"):
        events("what.csv", "b,2017-03-11,2017-03-15,maybe,m,u").collect()
    (tmp_path / "few.csv").write_text("event_id\nx\n", "utf-8")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_events(spark, str(tmp_path / "few.csv"))
    assert files.read_csv_or_error(spark, str(tmp_path / "few.csv"), ["event_id"])[1] is None and "missing" in files.read_csv_or_error(spark, str(tmp_path / "few.csv"), ["x"])[1]
    assert files.read_csv_or_error(spark, str(tmp_path / "absent.csv"), [])[0] is None
    (tmp_path / "c.catalogue").write_text('{"scenes": [{"year": 2017, "item_id": "z", "cloud_cover_pct": 0.0}, {"year": 2016, "item_id": "a"}]}')
    assert [(r.ordinal, r.year, r.item_id, r.cloud_cover_pct) for r in files.read_catalogue(spark, str(tmp_path / "c.catalogue")).orderBy("ordinal").collect()] == [(0, 2017, "z", 0.0), (1, 2016, "a", None)]
    waves = files.wave_days(spark.createDataFrame([('{"2017-03-10": 2.558, "2017-01-19": 1.699, "2017-04-01": 2.558}',)], "t string"), "t")
    w = quality.wave_summary(waves, [], "day", "height_m").first()
    assert (w.n, w.max_height_m, w.max_day) == (3, 2.558, "2017-03-10")
    assert tuple(quality.wave_summary(waves.limit(0), [], "day", "height_m").first()) == (0, None, None, None)
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("{broken")
    got = sorted((r.error is None) for r in files.read_json_or_error(spark, str(tmp_path / "*.json"), "struct<x:int>").collect())
    assert got == [False, True]
    with pytest.raises(ValueError):
        files.overpass_query(1, 1, 0, 2)


def test_features_and_pixels_round_trip(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":1},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4.5]]}}]}'
    (tmp_path / "l.geojson").write_text(text)
    f = files.read_features(spark, str(tmp_path / "l.geojson"))
    assert [tuple(r) for r in files.single_line(f).collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.5)]
    two = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[5,6]}}]}'
    got = files.features(spark.createDataFrame([(two,), ("nonsense",), (None,)], "t string"), "t").collect()
    assert [(r.kind, len(r.lines[0])) for r in got] == [("Polygon", 4), ("Point", 1)]
    with pytest.raises(Exception, match="LineString"):
        files.single_line(files.features(spark.createDataFrame([(two,)], "t string"), "t")).collect()
    px = raster.synthetic_pixels(spark, 40, 30).withColumns({"item_id": F.lit("i"), "threshold": F.lit(0.0)})
    files.write_pixels(px, str(tmp_path / "px"))
    assert files.read_window(spark, str(tmp_path / "px"), (5, 9), (0, 3)).count() == 20
    assert files.cached_pixels(spark, str(tmp_path / "px"), "i", 0.0).count() == 1200
    with pytest.raises(Exception, match="another threshold"):
        files.cached_pixels(spark, str(tmp_path / "px"), "i", 0.5).collect()
    v = line(spark, "z", [(0, 0), (5, 0.1), (10, 0), (10, 10)])
    assert sorted(r.seq for r in lines.simplified(v, 1.0).collect()) == [0, 2, 3]


def test_gate(spark):
    f = spark.createDataFrame([(1, None)], "a int, b int")
    r = quality.gate(f, {"x": F.col("a") > 0, "y": F.col("b") > 0}).first()
    assert (r.ready, r.reasons) == (False, "y")


def test_waterline_follows_the_generator(spark):
    from shorespark.plans.waterline import synthetic_waterline

    got = synthetic_waterline(spark, "").collect()
    assert {r.scene for r in got} == {"a", "b", "c"} and len(got) > 3 * 140
    for r in got:
        true = (60 + 6 * math.sin((r.y / 10 - 0.5) / 9)) * 10
        assert abs(r.x - true) < 12


def test_places_do_not_depend_on_blocks(spark):
    from shorespark.functions.places import places

    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.uniform(-50, 50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o double, i int")
    for span in (7.0, 1000.0):
        got = {r.i: r.p for r in places(df, ["g"], "o", span, "p").collect()}
        for g in ("a", "b", None):
            own = sorted((o, i) for x, o, i in rows if x == g)
            assert [got[i] for _, i in own] == list(range(len(own)))


def test_clip_area_and_joins(spark):
    s = spark.createDataFrame([("in", 1.0, 1.0, 2.0, 2.0), ("cut", -5.0, 5.0, 15.0, 5.0), ("out", 20.0, 0.0, 20.0, 9.0)], "id string, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: (r.x1, r.x2) for r in lines.clipped_segments(s, F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).collect()}
    assert got == {"in": (1.0, 2.0), "cut": (0.0, 10.0)}
    b = spark.createDataFrame([("b", [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0], 5.0)], "id string, xs array<double>, ys array<double>, reach double")
    shore = spark.createDataFrame([("s", 0.0, -50.0, 0.0, 50.0)], "id string, x1 double, y1 double, x2 double, y2 double")
    assert exposure.exposed_area(b, shore, "reach", 0.5).first().exposed_area_m2 == pytest.approx(50.0)
    dim = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    left = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted((r.k, r.v) for r in quality.many_to_one(left, dim, ["k"]).collect()) == [(1, "x"), (3, None)]
    with pytest.raises(Exception, match="repeated keys"):
        quality.many_to_one(left, dim.unionByName(dim), ["k"]).collect()
    z = spark.createDataFrame([([1, 2], ["a", "b"])], "n array<int>, s array<string>")
    assert [tuple(r) for r in quality.zipped(z, "n", "s").collect()] == [(0, 1, "a"), (1, 2, "b")]
    with pytest.raises(Exception, match="differ in length"):
        quality.zipped(z.withColumn("s", F.array(F.lit("a"))), "n", "s").collect()
    assert sorted(map(tuple, quality.missing_and_extra(dim, "v", ["x", "z"]).collect())) == [("y", "extra"), ("z", "missing")]
    a = spark.createDataFrame([("k", 10.0), ("k", 20.0)], "k string, a double")
    assert tuple(raster.area_statistics(a, ["k"], "a").first())[1:] == (15.0, 5.0, pytest.approx(100 / 3))
    m = spark.createDataFrame([("k", s, r, c) for s in ("a", "b", "c") for r in range(6) for c in range(6) if s != "c" or r < 3], "k string, s string, row long, col long")
    grid = spark.range(36).select(F.lit("k").alias("k"), F.floor(F.col("id") / 6).alias("row"), (F.col("id") % 6).alias("col"))
    scenes = lambda *n: spark.createDataFrame([("k", x) for x in n], "k string, s string")
    assert raster.consensus(m, scenes("a", "b", "c"), grid, "k", "s").count() == 16  # the frame falls away
    assert raster.consensus(m, scenes("a", "b", "c", "d", "e", "f"), grid, "k", "s").count() == 0  # dry scenes vote too


def test_smoothing_equals_brute_force(spark):
    rnd, rows, want = random.Random(1), [], {}
    for g, n in (("a", 40), ("b", 5), ("c", 4), ("d", 1)):
        v = [rnd.uniform(0, 10) for _ in range(n)]
        rows += [(g, i, x) for i, x in enumerate(v)]
        at = lambda u, i, n=n: u[min(max(i, 0), n - 1)]
        m = [sorted(at(v, i + k) for k in range(-2, 3))[2] for i in range(n)]
        w = [math.exp(-k * k / 2) for k in range(-4, 5)]
        want[g] = v if n < 5 else [sum(w[k + 4] * at(m, i + k) for k in range(-4, 5)) / sum(w) for i in range(n)]
    got = lines.smoothed(spark.createDataFrame(rows, "g string, i long, v double"), "g", "i", "v").collect()
    assert len(got) == len(rows) and all(r.v == pytest.approx(want[r.g][r.i]) for r in got)


def test_labels_and_documents(spark, tmp_path):
    from shorespark.functions import labels

    df = spark.createDataFrame([(7, ["a", "b"], 1.25, None), (1234, ["a"], float("nan"), " BAJO ")], "n int, ids array<string>, m double, l string")
    got = df.select(labels.numbered("T", F.col("n"), 3), labels.consensus_group(F.col("ids")), labels.elevation_label(F.col("m")), labels.by_name(F.col("l"), {"bajo": "low"}, "none"), labels.is_subset(F.col("ids"), F.array(F.lit("a"), F.lit("c"))), labels.osm_id(F.lit("way"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("T007", "consensus:a,b", "1.3 m", "none", False, "way/7"), ("T1234", "a", "sin dato", "low", True, "way/1234")]
    files.write_document(df.select("n", "l"), str(tmp_path / "doc"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "doc")).collect()) == ['{"n":1234,"l":" BAJO "}', '{"n":7,"l":null}']
    files.write_table(df, str(tmp_path / "csv"), ["l"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["n", "m"]


def test_scenario_evaluation(spark):
    v = line(spark, "a", [(0, 0), (0, -100), (0, -1000)])
    p = spark.createDataFrame([("land", 40.0, -500.0), ("sea", -30.0, -500.0)], "point string, x double, y double")
    got = {r.point: r for r in scenario.evaluated(p, v, 2036, 1.5, 2026, [(25.0, True, "near"), (60.0, True, "middle")], "far", 5.0).collect()}
    assert got["land"].label == "near" and got["land"].station == "E06" and got["land"].offset_m == 50.0 and got["land"].margin_m == pytest.approx(25.0)
    assert got["sea"].label == "outside"


def test_continuity_keeps_a_shore_beyond_the_band(spark):
    rows = [("a", i, 50.0 + 4 * min(i, 5)) for i in range(12)] + [("a", 9, 10.0), ("b", 0, 70.0), ("b", 1, 69.0), ("b", 2, -300.0)]
    got = {}
    for r in lines.continuous(spark.createDataFrame(rows, "g string, i long, p double"), "g", "i", "p").orderBy("g", "i").collect():
        got.setdefault(r.g, []).append(r.p)
    # retreats to 70 m; at 9 the candidate inside the band goes first; -300 would jump
    assert got == {"a": [50.0, 54.0, 58.0, 62.0, 66.0, 70.0, 70.0, 70.0, 70.0, 10.0, 70.0, 70.0], "b": [70.0, 69.0]}


def test_every_ring_has_its_arc(spark):
    square = lambda n, s: line(spark, n, [(0, 0), (s, 0), (s, 3 * s), (0, 3 * s)])
    rings = square("a", 10).unionByName(square("b", 20)).unionByName(square("c", 30))
    anchors = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0, 9.0, 11.0), ("b", 20.0, 0.0, 20.0, 60.0, 50.0, 70.0), ("c", 0.0, 0.0, 30.0, 0.0, 1.0, 2.0)], "line string, ax double, ay double, bx double, by double, least double, most double")
    got = sorted((r.line, r.seq, r.x, r.y) for r in lines.ring_arc(rings, anchors, 1.0).collect())
    assert got == [("a", 0, 0.0, 0.0), ("a", 1, 10.0, 0.0), ("b", 0, 20.0, 0.0), ("b", 1, 20.0, 60.0)]


def test_every_beach_has_its_arc(spark):
    from shorespark.plans import coast

    d = "/root/testdata/sf0.001"
    long = {r.line for r in lines.segments(coast.baselines(spark, d)).select("line").distinct().collect()}
    assert len(long) > 1 and {r.line for r in coast.ring_arcs(spark, d).select("line").distinct().collect()} == long


def test_exposed_length_is_exact(spark):
    rnd = random.Random(4)
    cols = "id string, x1 double, y1 double, x2 double, y2 double"
    shore = [(f"s{i}", *[rnd.uniform(0, 600) for _ in range(2)]) for i in range(30)]
    shore = [(n, x, y, x + rnd.uniform(-80, 80), y + rnd.uniform(-80, 80)) for n, x, y in shore] + [("dot", 300.0, 300.0, 300.0, 300.0)]
    roads = [(f"r{i}", *[rnd.uniform(0, 600) for _ in range(4)], rnd.uniform(5, 60)) for i in range(25)]
    roads += [("short", 700.0, 0.0, 715.0, 0.0, 3.0), ("along", 720.0, 4.0, 760.0, 4.0, 5.0), ("past", 740.0, -90.0, 740.0, 90.0, 45.0)]
    shore += [("post", 702.0, 0.0, 702.0, 0.0), ("flat", 730.0, 0.0, 740.0, 0.0)]
    got = {r.id: r.exposed_length_m for r in exposure.exposed_length(spark.createDataFrame(roads, cols + ", reach double"), spark.createDataFrame(shore, cols), "reach").collect()}
    assert got["short"] == pytest.approx(5) and got["along"] == pytest.approx(16) and got["past"] == pytest.approx(90)

    def near(x, y, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        t = max(0, min(1, ((x - s[1]) * dx + (y - s[2]) * dy) / (dx * dx + dy * dy or 1)))
        return math.hypot(x - s[1] - t * dx, y - s[2] - t * dy)

    for n, x1, y1, x2, y2, r in roads:
        k = 4000
        hit = sum(min(near(x1 + (i + 0.5) / k * (x2 - x1), y1 + (i + 0.5) / k * (y2 - y1), s) for s in shore) <= r for i in range(k))
        assert got[n] == pytest.approx(hit / k * math.hypot(x2 - x1, y2 - y1), abs=1.5)


def test_exposed_lengths_query_has_no_steps(spark):
    from shorespark.plans import coast

    got = [r.exposed_length_m for r in coast.exposed_lengths(spark, "/root/testdata/sf0.001").where("exposed_length_m > 0").collect()]
    assert got and sum(abs(v / 20 - round(v / 20)) > 1e-3 for v in got) > len(got) / 2


def test_resampling_uses_every_part(spark):
    from shorespark.plans import scenes
    from shorespark.sources.tables import table

    part = {r.p_partkey: r.p_retailprice for r in table(spark, "/root/testdata/sf0.1", "part").collect()}
    got = {(r["row"], r["col"]): r.p_retailprice for r in scenes.band_resampling(spark, "/root/testdata/sf0.1").collect()}
    wide = math.isqrt(max(part)) + 1
    assert len(got) == 4 * len(part)
    for k in (max(part), 1500, 1024):
        r, c = divmod(k, wide)
        s = [(float(part[(r + i) * wide + c + j]), w) for i in (-1, 0) for j in (-1, 0) if 0 <= c + j and (r + i) * wide + c + j in part for w in [(0.75 if i == 0 else 0.25) * (0.75 if j == 0 else 0.25)]]
        assert got[2 * r, 2 * c] == pytest.approx(sum(v * w for v, w in s) / sum(w for _, w in s), abs=1e-3)


def test_waterline_passes_a_lagoon_by(spark):
    from shorespark.plans.waterline import guided_waterline

    # sea up to column 30; a lagoon in columns 36 to 45 that an inlet in rows 0 to 3 joins to it; the guide runs at 350 m
    px = spark.range(60 * 60).select(F.floor(F.col("id") / 60).alias("row"), (F.col("id") % 60).alias("col"))
    wet = (F.col("col") < 30) | F.col("col").between(36, 45) & F.col("row").between(0, 50) | (F.col("row") < 4) & (F.col("col") < 46)
    px = px.select("row", "col", F.lit("a").alias("scene"), F.when(wet, 0.3).otherwise(0.1).alias("green"), F.when(wet, 0.1).otherwise(0.3).alias("nir"))
    got = guided_waterline(px, "scene", 10.0, line(spark, "ref", [(350, 590 - 10 * i) for i in range(60)])).collect()
    there = [r for r in got if 80 < r.y < 480]
    # the nearest crossing is the lagoon's seaward shore at x = 360, which has the land on the wrong side
    assert len(there) > 35 and all(r.x == pytest.approx(300, abs=1) for r in there)
    kept = [r for r in got if r.kept]
    assert 2 <= len(kept) < len(got) / 2 and {min(r.station for r in got), max(r.station for r in got)} <= {r.station for r in kept}


def test_tiles_grow_with_the_table_and_stay_half_set(spark):
    from shorespark.plans import scenes

    orders = {}
    for f in ("sf0.001", "sf0.01"):
        grid, mask = scenes._tiles(spark, f"/root/testdata/{f}")
        orders[f] = grid.count()
        assert 0.4 < mask.count() / orders[f] < 0.6
    assert orders["sf0.01"] > 9 * orders["sf0.001"]
    sizes = [r["count"] for r in scenes.water_components(spark, "/root/testdata/sf0.01").groupBy("tile", "component").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 1600


def test_simplified_does_not_depend_on_blocks(spark):
    rnd = random.Random(12)
    v = line(spark, "w", [(i, 30 * math.sin(i / 37) + rnd.uniform(-3, 3)) for i in range(700)]).unionByName(line(spark, "s", [(i, 0) for i in range(90)])).unionByName(line(spark, "p", [(1, 1)]))
    want = sorted((r.line, r.seq) for r in lines.simplified(v, 2.0).collect())
    assert sum(n == "s" for n, _ in want) == 2 and ("p", 0) in want and 20 < len(want) < 700
    for block in (3, 20, 100):
        assert sorted((r.line, r.seq) for r in lines.simplified(v, 2.0, block).collect()) == want


def test_smoothing_does_not_depend_on_blocks(spark):
    rnd = random.Random(13)
    df = spark.createDataFrame([("a", i, rnd.uniform(0, 9)) for i in range(57)], "g string, i long, v double")
    got = [sorted((r.i, round(r.v, 9)) for r in lines.smoothed(df, "g", "i", "v", b).collect()) for b in (8, 13, 4096)]
    assert len(got[0]) == 57 and got[0] == got[1] == got[2]


def test_segments_over_many_blocks(spark, monkeypatch):
    rnd = random.Random(14)
    pts = [(rnd.uniform(0, 9), rnd.uniform(0, 9)) for _ in range(50)]
    v = line(spark, "a", pts).unionByName(line(spark, "b", pts[:3]))
    want = [(r.line, r.seq, r.cum, r.length) for r in lines.segments(v).orderBy("line", "seq").collect()]
    monkeypatch.setattr(lines, "BLOCK", 7)
    got = [(r.line, r.seq, r.cum, r.length) for r in lines.segments(v).orderBy("line", "seq").collect()]
    assert len(got) == 51 and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:]) for a, b in zip(got, want))
    assert lines.resampled(v, 40).count() == 80 and lines.fixed_transects(v, 3.0).count() == sum(math.floor(n / 3) + 2 for n in {w[0]: w[3] for w in want}.values())


def test_overlap_and_self_crossings(spark):
    t = spark.createDataFrame([("g", "t", 0.0, -50.0, 0.0, 250.0)], "g string, id string, x1 double, y1 double, x2 double, y2 double")
    shore = lambda pts: lines.segments(line(spark, "g", pts)).select(F.col("line").alias("g"), F.col("seq").alias("id"), "x1", "y1", "x2", "y2").withColumn("shore", F.lit(1))
    r = lines.nearest_crossings(t, shore([(-100, 30), (0, 30), (0, 90), (80, 90)]), 50.0).first()
    assert (r.position_m, r.candidate_count, r.intersection_method) == (30.0, 0, "nearest_on_overlap")
    r = lines.nearest_crossings(t, shore([(-100, 30), (0, 30), (0, 90), (80, 90), (80, 120), (-80, 120)]), 50.0).first()
    assert (r.position_m, r.candidate_count, r.intersection_method) == (120.0, 1, "single_point")
    loop = line(spark, "l", [(0, 0), (10, 0), (10, 10), (5, -5)]).unionByName(line(spark, "r", [(0, 0), (9, 0), (9, 9), (0, 0)]))
    assert {r.line: r.n for r in lines.self_crossings(loop).collect()} == {"l": 1, "r": 0}


def test_offset_curve_has_round_corners(spark):
    v = line(spark, "a", [(0, 0), (100, 0), (100, 100)])
    out = [(r.x, r.y) for r in lines.offset_curve(v, -10.0).orderBy("seq", "place").collect()]  # to the right: the outer side
    assert len(out) == 11 and out[0] == pytest.approx((0, -10)) and out[-1] == pytest.approx((110, 100))
    assert all(math.hypot(x - 100, y) == pytest.approx(10) for x, y in out[1:-1])
    inner = [(r.x, r.y) for r in lines.offset_curve(v, 10.0).orderBy("seq", "place").collect()]
    assert inner == [pytest.approx(p) for p in [(0, 10), (90, 10), (90, 100)]]


def test_student_p_at_any_degrees(spark):
    # published: t 0.975 quantiles; the normal limit for very many degrees
    cases = [(12.706204736, 1), (2.228138852, 10), (1.983971519, 100), (1.960201, 10_000), (1.9599640, 3_000_000), (0.0, 5), (40.0, 7)]
    got = [r.p for r in spark.createDataFrame(cases, "t double, n long").select(storms.student_p(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got[:5] == [pytest.approx(0.05, abs=2e-7)] * 5 and got[5] == 1.0 and 0 < got[6] < 1e-8


def test_scenes_of_the_tables_follow_their_positions(spark):
    from shorespark.plans import waterline

    d = "/root/testdata/sf0.001"
    px = waterline.coast_pixels(spark, d)
    got = waterline.scene_waterlines(spark, d).collect()
    wet = {(r.scene, r["row"]): r.n for r in px.where("green > nir").groupBy("scene", "row").agg(F.count("*").alias("n")).collect()}
    last = {r.scene: r.m for r in px.groupBy("scene").agg(F.max("row").alias("m")).collect()}
    assert len(got) > 100
    near = 0
    for r in got:
        row = min(last[r.scene], max(0, int(r.y // 25)))
        near += abs(wet.get((r.scene, row), 0) * 25 - r.x) <= 60
    assert near > 0.8 * len(got)
    lines_ = {r.line for r in waterline.consensus_waterlines(spark, d).collect()}
    assert lines_ and lines_ <= {r.scene.split("/")[0] for r in got}


def test_gridded_tides(spark):
    grid = spark.createDataFrame([(0, 0, "m2", 30.0, 1.0, 0.0), (0, 1, "m2", 30.0, 3.0, 0.0), (1, 0, "m2", 30.0, 1.0, 0.0), (1, 1, "m2", 30.0, 3.0, 0.0)], "row int, col int, name string, speed_deg_per_hour double, amplitude_m double, phase_deg double")
    hour = 3_600_000_000
    pts = spark.createDataFrame([(1, 0.05, 0.05, 0), (2, 0.05, 0.05, 6 * hour), (3, 0.15, 0.05, 0), (4, 5.0, 5.0, 0), (5, None, 0.0, 0), (6, 0.1, 0.1, 0), (7, -0.05, -0.03, 0)], "k int, x double, y double, t long")
    got = {r.k: r.tide_height_m for r in tides.gridded(pts, ["k"], "x", "y", "t", grid, 0.1).collect()}
    assert got[1] == pytest.approx(2.0) and got[2] == pytest.approx(-2.0) and got[3] == pytest.approx(3.0) and got[4] is None and got[5] is None and got[6] == pytest.approx(3.0)
    assert got[7] == pytest.approx(1.0)  # one of its corners is there
    # beyond the last node: the nearest one within 10 km (0.05 degrees are 5.6 km), none at 15 km
    off = spark.createDataFrame([(1, 0.05, -0.05, 0), (2, 0.05, -0.135, 0)], "k int, x double, y double, t long")
    fine = spark.createDataFrame([(0, 1, "m2", 30.0, 3.0, 0.0)], "row int, col int, name string, speed_deg_per_hour double, amplitude_m double, phase_deg double")
    assert {r.k: r.tide_height_m for r in tides.gridded(off, ["k"], "x", "y", "t", fine, 0.05, 10.0).collect()} == {1: pytest.approx(3.0), 2: None}


def test_model_folder_check(spark):
    f = spark.createDataFrame([("file:/m/M2.nc", bytearray(b"\x89HDF\r\n\x1a\n...")), ("file:/m/zz.nc", bytearray(b"text"))], "path string, content binary")
    r = tides.model_check(f, ["m2", "s2"]).first()
    assert tuple(r) == ("s2", "zz", "zz", 2, False)


def test_rings_of_a_mask(spark):
    # a block with a hole, and a cell that meets it at a corner only
    cells = [(r, c) for r in range(3) for c in range(4) if (r, c) != (1, 1)] + [(3, 4)]
    s = raster.rings(spark.createDataFrame([("k", r, c) for r, c in cells + cells[:2]], "k string, row long, col long"), "k", 10.0)
    rows = {}
    for r in s.orderBy("ring", "place").collect():
        rows.setdefault(r.ring, []).append(r)
    assert sorted(len(x) for x in rows.values()) == [4, 4, 14]
    for x in rows.values():
        assert [r.place for r in x] == list(range(len(x))) and all((a.x2, a.y2) == (b.x1, b.y1) for a, b in zip(x, x[1:] + x[:1]))
    assert sorted(r.area for r in raster.ring_areas(s, "k").collect()) == [-100.0, 100.0, 1200.0]


def test_stitched_ways(spark):
    p = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0), ("a", 1, 0.0, 0.0, 1.0, 1.0), ("a", 2, 5.0, 5.0, 6.0, 6.0), ("a", 3, 9.0, 9.0, 9.0, 9.0), ("b", 0, 0.0, 0.0, 1.0, 0.0)], "line string, part int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.line, r.part, r.ring, r.place, r.turned) for r in lines.stitched(p).collect())
    assert got == [("a", 0, 0, 0, False), ("a", 1, 0, 1, True), ("a", 3, 1, 0, False)]


def test_published_zonal_statistics(spark):
    want = {
        "norte": (-0.5347180962562561, 0.8570998907089233, 0.058361531575520834, 0.5803804454934435), "centro": (-0.5288863778114319, 0.854817271232605, 0.06065518527560764, 0.571784744062164),
        "sur": (-0.5207223296165466, 0.8183582425117493, 0.1664309353298611, 0.5580729883252181),
    }
    px = raster.sample_scene(spark)
    g, n = F.col("green"), F.col("nir")
    got = raster.zonal_by_polygon(px.withColumn("v", raster.ndwi(g, n, F.lit(True))), raster.sample_zones(spark), "zone", "v").collect()
    assert {r.zone for r in got} == set(want) and all(r.n == 4500 and (r.v_min, r.v_max, r.v_mean, r.v_std) == pytest.approx(want[r.zone], abs=2e-7) for r in got)
    none = spark.createDataFrame([("far", [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])], "zone string, xs array<double>, ys array<double>")
    assert [tuple(r) for r in raster.zonal_by_polygon(px.withColumn("v", g), none, "zone", "v").collect()] == [("far", None, None, None, None, 0)]


def test_tolerance_labels_and_tagged_rings(spark, tmp_path):
    from shorespark.functions import labels

    df = spark.createDataFrame([([0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 2.0, 2.0], 4.1, 1.0, "Riesgo ALTO")], "xs array<double>, ys array<double>, x double, y double, l string")
    c = lambda t: polygons.covers(F.col("xs"), F.col("ys"), F.col("x"), F.col("y"), t)
    r = df.select(c(0.05).alias("a"), c(0.15).alias("b"), labels.by_part(F.col("l"), {"alto": "red", "riesgo": "grey"}, "none").alias("c"), labels.by_part(F.col("l"), {"bajo": "green"}, "none").alias("d")).first()
    assert tuple(r) == (False, True, "red", "none")
    osm = lambda tag, last: spark.createDataFrame([(f'<osm>{"".join(f"""<node id="{i}" lat="-33.{i}" lon="-71.{i}"/>""" for i in (1, 2, 3))}<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="{last}"/><tag k="natural" v="{tag}"/></way></osm>',)], "t string")
    assert files.tagged_ring(osm("beach", 1), "t", 7).count() == 4
    for bad, why in ((osm("wood", 1), "tagged"), (osm("beach", 2), "open"), (osm("beach", 9), "open")):
        with pytest.raises(Exception, match=why):
            files.tagged_ring(bad, "t", 7).collect()


def test_lines_are_turned_before_they_are_met(spark):
    a = spark.createDataFrame([("l", i, float(i), 0.0) for i in range(5)], "line string, i int, x double, y double")
    b = spark.createDataFrame([("l", i, 4.0 - i, 2.0) for i in range(5)], "line string, i int, x double, y double")
    got = sorted((r.i, r.x, r.y) for r in lines.between(a, b, 0.5).collect())
    assert got == [(i, float(i), 1.0) for i in range(5)]


def test_distances_and_areas_meet_few_pairs(spark, monkeypatch):
    # features far from a slanting shore and one odd reach: what is held against each other stays in proportion
    from shorespark.operators import spatial

    rng = random.Random(5)
    pts = [(i * 10.0, i * 10.0 + rng.uniform(-3, 3)) for i in range(400)]
    shore = spark.createDataFrame([(str(i), *a, *b) for i, (a, b) in enumerate(zip(pts, pts[1:]))], "id string, x1 double, y1 double, x2 double, y2 double")
    at = [(rng.uniform(2000, 4500), rng.uniform(-800, 1500)) for _ in range(25)] + [(1000.0, 1003.0), (500.0, 490.0)]
    roads = [(f"r{i}", x, y, x + rng.uniform(-16, 16), y + rng.uniform(-16, 16)) for i, (x, y) in enumerate(at)] + [("dot", 900.0, 0.0, 900.0, 0.0)]
    pairs, real = [], spatial.in_regions

    def counted(*a):
        got = real(*a)
        pairs.append(got.count())
        return got

    monkeypatch.setattr(exposure, "in_regions", counted)
    monkeypatch.setattr(spatial, "in_regions", counted)
    far = {r.id: r.distance_m for r in exposure.line_distance(spark.createDataFrame(roads, "id string, x1 double, y1 double, x2 double, y2 double"), shore).collect()}

    def apart(px, py, s):
        d = (s[2] - s[0]) ** 2 + (s[3] - s[1]) ** 2
        t = min(1.0, max(0.0, ((px - s[0]) * (s[2] - s[0]) + (py - s[1]) * (s[3] - s[1])) / d)) if d else 0.0
        return math.hypot(px - s[0] - t * (s[2] - s[0]), py - s[1] - t * (s[3] - s[1]))

    def cross(a, b):
        side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
        return side(a, *b[:2]) * side(a, *b[2:]) < 0 and side(b, *a[:2]) * side(b, *a[2:]) < 0

    segs = [(*a, *b) for a, b in zip(pts, pts[1:])]
    want = {n: min(0.0 if cross(r, s) else min(apart(*r[:2], s), apart(*r[2:], s), apart(*s[:2], r), apart(*s[2:], r)) for s in segs) for n, *r in roads}
    assert far == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    squares = [(str(i), [x, x + 8, x + 8, x], [y, y, y + 8, y + 8], 100_000.0 if i == 3 else 6.0) for i, (x, y) in enumerate(at)]
    area = {r.id: r.exposed_area_m2 for r in exposure.exposed_area(spark.createDataFrame(squares, "id string, xs array<double>, ys array<double>, reach double"), shore, "reach", 2.0).collect()}
    for i, xs, ys, reach in squares:
        cells = [(2 * a + 1.0, 2 * b + 1.0) for a in range(int(xs[0] // 2) - 1, int(xs[1] // 2) + 2) for b in range(int(ys[0] // 2) - 1, int(ys[2] // 2) + 2)]
        assert area[i] == 4 * sum(xs[0] <= x < xs[1] and ys[0] <= y < ys[2] and min(apart(x, y, s) for s in segs) <= reach for x, y in cells)
    assert sum(pairs) < 200


def test_outlines_stay_in_their_rows(spark):
    import json

    g = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    part = lambda role, *p: {"role": role, "geometry": g(*p)}
    two = [part("outer", (0.0, 0.0), (1.0, 0.0), (1.0, 1.0)), part("inner", (5.0, 5.0), (6.0, 6.0)), part(None, (0.0, 0.0), (0.0, 1.0), (1.0, 1.0)), part("", (9.0, 9.0), (8.0, 9.0), (8.0, 8.0), (9.0, 9.0)), part("outer", (3.0, 3.0), (4.0, 4.0)), {"role": "outer"}]
    els = [{"type": "relation", "id": 1, "tags": {"building": "yes"}, "members": two}, {"type": "relation", "id": 2, "tags": {"building": "yes"}, "members": two[:1]}, {"type": "relation", "id": 3, "tags": {}, "members": two}, {"type": "way", "id": 4, "tags": {"building": "yes"}}]
    df = files.overpass_outlines(spark.createDataFrame([(json.dumps({"elements": els}),)], "text string"), "text")
    got = sorted((r.osm_id, r.ring, [(p.lon, p.lat) for p in r.line]) for r in df.collect())
    assert got == [("relation/1", 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]), ("relation/1", 1, [(9.0, 9.0), (8.0, 9.0), (8.0, 8.0), (9.0, 9.0), (9.0, 9.0)][:3] + [(9.0, 9.0)])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan


def test_band_areas_shuffle_segments_only(spark, monkeypatch):
    v = line(spark, "a", [(0, 0), (60, 10), (60, 10), (90, 70), (40, 120)]).unionByName(line(spark, "b", [(-30, 5), (300, 5)]))
    bounds = {"x": (0.0, 10.0), "y": (10.0, 35.0)}
    areas = lambda: {(r.line, r.band): r.area_m2 for r in scenario.band_areas(v, bounds, 2.0).collect()}
    whole = areas()
    assert whole["b", "x"] == pytest.approx(330 * 10, rel=0.05) and whole["b", "y"] == pytest.approx(330 * 25, rel=0.05) and len(whole) == 4
    monkeypatch.setattr(scenario, "TILE", 7)
    assert areas() == whole
    plan = scenario.band_areas(v, bounds, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [line#" in plan and ", i#" not in plan.split("MapInArrow")[0]


def test_masks_in_tiles_of_any_size(spark, monkeypatch):
    rng = random.Random(3)
    grid = {(r, c) for r in range(-9, 14) for c in range(-7, 19) if (r, c) != (2, 3)}
    mask = {p for p in grid if rng.random() < 0.8} - {(r, 4) for r in range(-9, 12)}
    near = lambda p: [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    want = mask
    for every in (True, False, False, True):
        want = {p for p in grid if (all if every else any)(q in want for q in near(p))}
    names, left = {}, set(mask)
    while left:
        first = min(left)
        todo, left = [first], left - {first}
        while todo:
            r, c = todo.pop()
            names[r, c] = first[0] * 2**31 + first[1]
            step = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & left
            left -= step
            todo += step
    table = lambda cells: spark.createDataFrame([("k", *p) for p in cells] + [("k", None, 0)], "k string, row long, col long")
    m, g = table(list(mask) + list(mask)[:5]), table(grid)
    for tile in (256, 5):
        monkeypatch.setattr(raster, "TILE", tile)
        opened = raster.opened_closed(m, g, "k")
        assert {(r["row"], r["col"]) for r in opened.collect()} == want and want
        assert {(r["row"], r["col"]): r.component for r in raster.components(m, "k").collect()} == names
    assert opened._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1  # one shuffle, no join
