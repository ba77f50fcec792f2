"""Polygons as arrays of ring coordinates (xs, ys), open or closed, in the plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorespark.functions.geo import point_segment_distance


def _sides(xs: Column, ys: Column) -> Column:
    n = F.size(xs)
    at = lambda a, i: F.element_at(a, i)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(at(xs, i).alias("xa"), at(ys, i).alias("ya"), at(xs, i % n + 1).alias("xb"), at(ys, i % n + 1).alias("yb")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(xs: Column, ys: Column) -> Column:
    """Shoelace area, positive if the ring runs to the left; null for fewer than three corners."""
    return F.when(F.size(xs) > 2, _sum(F.transform(_sides(xs, ys), lambda s: s["xa"] * s["yb"] - s["xb"] * s["ya"])) / 2)


def centroid(xs: Column, ys: Column) -> Column:
    """struct(x, y) of the area's centre; null without area. Computed about the first corner, so far-away rings keep
    their digits."""
    x0, y0 = F.element_at(xs, 1), F.element_at(ys, 1)
    dx, dy = F.transform(xs, lambda v: v - x0), F.transform(ys, lambda v: v - y0)
    s = _sides(dx, dy)
    a6 = 6 * signed_area(dx, dy)
    part = lambda c: _sum(F.transform(s, lambda t: (t[f"{c}a"] + t[f"{c}b"]) * (t["xa"] * t["yb"] - t["xb"] * t["ya"])))
    return F.when(F.abs(a6) > 0, F.struct((x0 + F.try_divide(part("x"), a6)).alias("x"), (y0 + F.try_divide(part("y"), a6)).alias("y")))


def contains(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Even-odd rule by crossings of the ray to the right."""
    hit = F.filter(_sides(xs, ys), lambda s: ((s["ya"] > y) != (s["yb"] > y)) & (x < s["xa"] + F.coalesce(F.try_divide(y - s["ya"], s["yb"] - s["ya"]), F.lit(0.0)) * (s["xb"] - s["xa"])))
    return F.size(hit) % 2 == 1


def covers(xs: Column, ys: Column, x: Column, y: Column, tolerance: float = 0.0) -> Column:
    """The polygon holds the point, or the point is at most `tolerance` away from one of its sides."""
    far = F.transform(_sides(xs, ys), lambda s: point_segment_distance(x, y, s["xa"], s["ya"], s["xb"], s["yb"]))
    return contains(xs, ys, x, y) | (F.array_min(far) <= tolerance)


def _clip_half(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    """One step of Sutherland-Hodgman: the part of a ring (array of struct x, y) on one side of an axis-parallel line."""
    n = F.size(ring)
    other = "y" if axis == "x" else "x"
    inside = lambda p: (p[axis] >= bound) if keep_above else (p[axis] <= bound)

    def step(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        t = F.coalesce(F.try_divide(bound - a[axis], b[axis] - a[axis]), F.lit(0.0))
        cut = F.struct(*(x.alias(c) for c, x in sorted({axis: bound.cast("double"), other: a[other] + t * (b[other] - a[other])}.items())))
        end = F.struct(b["x"].alias("x"), b["y"].alias("y"))
        return F.array_compact(F.array(F.when(inside(a) != inside(b), cut), F.when(inside(b), end)))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), step))).otherwise(ring)


def clipped(df: DataFrame, xs: str, ys: str, x0: Column, y0: Column, x1: Column, y1: Column, out: str = "ring") -> DataFrame:
    """df with the ring (array of struct x, y) of each convex or concave polygon cut to a rectangle; empty outside."""
    df = df.withColumn(out, F.zip_with(xs, ys, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))))
    for axis, bound, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        df = df.withColumn(out, _clip_half(F.col(out), axis, bound, above))
    return df


def ring_area(ring: Column) -> Column:
    return F.coalesce(F.abs(signed_area(F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"]))), F.lit(0.0))


def coverage(df: DataFrame, xs: str, ys: str, x0: Column, y0: Column, x1: Column, y1: Column, out: str) -> DataFrame:
    """df with the share of the rectangle that the polygon covers, in [0, 1] and rounded to six places; 0 if the
    rectangle has no area."""
    cut = clipped(df, xs, ys, x0, y0, x1, y1, "_ring")
    share = F.coalesce(F.try_divide(ring_area(F.col("_ring")), (x1 - x0) * (y1 - y0)), F.lit(0.0))
    return cut.withColumn(out, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 6)).drop("_ring")


def length_within(px: Column, py: Column, qx: Column, qy: Column, cx: Column, cy: Column, r: Column) -> Column:
    """Length of the segment p-q inside the circle of radius r about c (an exact circle); 0 for r <= 0."""
    dx, dy, fx, fy = qx - px, qy - py, px - cx, py - cy
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(F.lit(0.0), disc))
    t0 = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(-b - root, 2 * a), F.lit(0.0)))
    t1 = F.least(F.lit(1.0), F.coalesce(F.try_divide(-b + root, 2 * a), F.lit(0.0)))
    return F.when((r > 0) & (disc > 0), F.greatest(F.lit(0.0), t1 - t0) * F.sqrt(a)).otherwise(0.0)
