import math
import random

import numpy as np
from shorespark.functions.geo import with_degrees, with_utm
from shorespark.operators import spatial


def area(xs, ys):
    return sum(xs[i] * ys[(i + 1) % len(xs)] - xs[(i + 1) % len(xs)] * ys[i] for i in range(len(xs))) / 2


def test_ear_clipping_keeps_area():
    rnd = random.Random(1)
    for n in range(3, 30):
        a = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
        r = [rnd.uniform(1, 10) for _ in range(n)]
        xs, ys = [q * math.cos(t) for q, t in zip(r, a)], [q * math.sin(t) for q, t in zip(r, a)]
        for x, y in ((xs, ys), (xs[::-1], ys[::-1]), (xs + xs[:1], ys + ys[:1])):
            tri = spatial.ear_clip(x, y)
            assert len(tri) <= n - 2
            total = sum(abs(area([x[i] for i in t], [y[i] for i in t])) for t in tri)
            if max(np.diff([*a, a[0] + 2 * math.pi])) < math.pi:  # star-shaped about the origin, so simple
                assert abs(total - abs(area(xs, ys))) < 1e-9 * total
    assert spatial.ear_clip([0, 1], [0, 1]) == [] and spatial.ear_clip([0, 1, 2], [0, 1, 2]) == []


def test_in_regions_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    pts = [(str(i), rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(2000)] + [(f"c{i}", 50.0, 50.0) for i in range(800)] + [("n", None, 1.0), ("b", 20.0, 20.0)]
    polys = [(f"r{i}", [x, x + w, x + w, x], [y, y, y + h, y + h]) for i in range(300) for x, y, w, h in [(rnd.uniform(0, 95), rnd.uniform(0, 95), rnd.uniform(0, 15), rnd.uniform(0, 15))]]
    polys += [("q1", [10.0, 20.0, 20.0, 10.0], [10.0, 10.0, 20.0, 20.0]), ("q2", [20.0, 30.0, 30.0, 20.0], [20.0, 20.0, 30.0, 30.0]), ("none", [1.0, 1.0, 1.0], [0.0, 5.0, 9.0]), ("empty", [], [])]
    want = {(p, r) for p, x, y in pts if x is not None for r, xs, ys in polys if r not in ("none", "empty") and min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys)}
    P = spark.createDataFrame(pts, "point string, px double, py double")
    R = spark.createDataFrame(polys, "region string, xs array<double>, ys array<double>")
    for sizes in ({}, {"LEAF_ROWS": 40, "BLOCK": 100, "SAMPLE": 500}):
        for k, v in sizes.items():
            monkeypatch.setattr(spatial, k, v)
        got = [(r.point, r.region) for r in spatial.in_regions(P, R).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert spatial.in_regions(P.limit(0), R).collect() == [] and spatial.in_regions(P, R.limit(0)).collect() == []


def test_near_pairs_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"k{i}", -71.6 + rnd.uniform(0, 0.004), -33.5 + rnd.uniform(0, 0.004)) for i in range(700)]
    rows += [("w1", 179.99995, 10.0), ("w2", -179.99995, 10.0), ("w3", 180.00005, 10.0), ("p", 288.4, -33.4983), ("q", -71.6, -33.4983), ("x", None, 1.0), (None, 1.0, 1.0), ("y", 1.0, 95.0), ("pole1", 10.0, 89.99995), ("pole2", 190.0, 89.99995)]
    rows += rows[:5]

    def far(a, b):
        p, q, dl = math.radians(a[2]), math.radians(b[2]), math.radians(b[1] - a[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    good = [r for r in dict.fromkeys(rows) if r[0] and r[1] is not None and abs(r[2]) <= 90]
    want = {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and far(a, b) < 20}
    df = spark.createDataFrame(rows, "k string, lon double, lat double")
    got = [(r.key_a, r.key_b) for r in spatial.near_pairs(df, "k", "lon", "lat", 20.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("w1", "w2") in want and ("p", "q") in want and ("pole1", "pole2") in want


def test_nearest_lines_equals_brute_force(spark):
    rnd = random.Random(4)
    lines = [(f"t{i:03d}", x, y, x + rnd.uniform(-30, 30), y + rnd.uniform(-30, 30)) for i in range(120) for x, y in [(rnd.uniform(0, 900), rnd.uniform(0, 900))]]
    lines += [("dot", 5.0, 5.0, 5.0, 5.0), ("t000b", *lines[0][1:])]
    pts = [(f"p{i}", rnd.uniform(-50, 950), rnd.uniform(-50, 950)) for i in range(300)] + [("far", 50_000.0, 2.0), ("null", None, 1.0)]

    def dist(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        t = max(0, min(1, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy)

    want = {p[0]: min((dist(p, s), s[0]) for s in lines) for p in pts if p[1] is not None}
    got = spatial.nearest_lines(spark.createDataFrame(pts, "point string, px double, py double"), spark.createDataFrame(lines, "line string, x1 double, y1 double, x2 double, y2 double")).collect()
    assert len(got) == len(want)
    assert all(r.line == want[r.point][1] and abs(r.distance - want[r.point][0]) < 1e-6 for r in got)


def test_nearest_of_no_lines(spark):
    p = spark.createDataFrame([("a", 1.0, 2.0)], "point string, px double, py double")
    none = spark.createDataFrame([], "line string, x1 double, y1 double, x2 double, y2 double")
    assert spatial.nearest_lines(p, none).collect() == [] and spatial.nearest_lines(p, none, most=10.0).collect() == []


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(-71.616, -33.508), (-69.0, -20.0), (None, -20.0)], "lon double, lat double")
    rows = with_degrees(with_utm(df, "lon", "lat"), "x", "y", "lon2", "lat2").collect()
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in rows[:2])
    assert abs(rows[1].x - 500_000) < 1e-6 and rows[2].x is None


def _dist(p, s):
    dx, dy = s[3] - s[1], s[4] - s[2]
    t = max(0, min(1, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy)


def test_descent_equals_brute_force_in_small_leaves(spark, monkeypatch):
    rnd = random.Random(11)
    lines = [(f"t{i:03d}", x, y, x + rnd.uniform(-20, 20), y + rnd.uniform(-20, 20)) for i in range(600) for x, y in [(rnd.gauss(500, 200), rnd.gauss(500, 60))]]
    lines += [("long", 0.0, 0.0, 5000.0, 4000.0), ("dot", 5.0, 5.0, 5.0, 5.0), ("t000b", *lines[0][1:])]
    pts = [(f"p{i}", rnd.gauss(500, 400), rnd.gauss(500, 400)) for i in range(400)] + [("far", 50_000.0, 2.0), ("on", lines[0][1], lines[0][2])]
    P, L = spark.createDataFrame(pts, "point string, px double, py double"), spark.createDataFrame(lines, "line string, x1 double, y1 double, x2 double, y2 double")
    want = {p[0]: min((_dist(p, s), s[0]) for s in lines) for p in pts}
    monkeypatch.setattr(spatial, "LEAF_ROWS", 40)
    monkeypatch.setattr(spatial, "BLOCK", 60)
    for most in (math.inf, 35.0):
        got = {r.point: (r.distance, r.line) for r in spatial.descended(P, L, most, sample=80).collect()}
        assert got.keys() == {k for k, w in want.items() if w[0] <= most}
        assert all(abs(d - want[k][0]) < 1e-9 and line == want[k][1] for k, (d, line) in got.items())


def test_far_points_meet_few_lines(spark, monkeypatch):
    # 1000 points 40 km off 1000 lines: the trees meet a few lines for each point, not all
    rnd = np.random.default_rng(5)
    seg = np.c_[rnd.uniform(0, 50_000, 1000), rnd.uniform(-200, 200, 1000)]
    seg = np.c_[seg, seg + rnd.uniform(-200, 200, (1000, 2))]
    names = np.array([f"t{i:04d}" for i in range(1000)], dtype=object)
    pts = np.c_[rnd.uniform(0, 50_000, 1000), np.full(1000, 40_000.0)]
    met = []
    plain = spatial._distances
    monkeypatch.setattr(spatial, "_distances", lambda p, s: met.append(len(p)) or plain(p, s))
    tree = spatial.SegmentTree(seg, names)
    number, d = tree.nearest(pts, np.full(1000, np.inf))
    met, tested = [], sum(met)
    assert tested < 20_000
    every = np.array([[_dist((0, *p), (0, *s)) for s in seg] for p in pts[::50]])
    assert np.allclose(d[::50], every.min(1)) and [tree.names[i] for i in number[::50]] == [names[i] for i in every.argmin(1)]
