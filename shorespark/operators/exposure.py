"""Exposure of features to a moving shoreline: nearest rate, time to impact, exposed lengths and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorespark.functions.geo import fenced, point_segment_distance
from shorespark.operators.lines import crossings
from shorespark.operators.polygons import centroid
from shorespark.operators.raster import rasterised
from shorespark.operators.spatial import descended, in_regions, nearest_lines
from shorespark.session import written


def nearest_rates(features: DataFrame, key: str, x: str, y: str, rates: DataFrame, line: str, rate: str) -> DataFrame:
    """key, line, distance_m and rate of the transect (line, x1, y1, x2, y2, rate not null) nearest to each feature's
    centre. Equally near: the smaller line id."""
    known = rates.where(F.col(rate).isNotNull())
    near = nearest_lines(features.select(F.col(key).cast("string").alias("point"), F.col(x).alias("px"), F.col(y).alias("py")), known.select(F.col(line).alias("line"), "x1", "y1", "x2", "y2"))
    one = known.groupBy(F.col(line).alias("line")).agg(F.first(rate).alias(rate))
    return near.join(one, "line").select(F.col("point").alias(key), F.col("line").alias(line), F.col("distance").alias("distance_m"), rate)


def years_to_impact(distance: Column, rate: Column) -> Column:
    """distance / rate where the rate is positive, else null."""
    return F.when(rate > 0, F.try_divide(distance, rate))


def by_limits(value: Column, limits: list[tuple[float, bool, str]], beyond: str) -> Column:
    """The label of the first limit that the value is below (or at, where its flag is true); `beyond` for greater,
    null and non-finite values."""
    out = None
    for limit, closed, label in limits:
        test = (value <= limit) if closed else (value < limit)
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(value.isNull() | F.isnan(value), beyond).otherwise(out.otherwise(beyond)) if out is not None else F.lit(beyond)


def summary(df: DataFrame, level: str, length: str, area: str, worst: str) -> DataFrame:
    """Counts and null-safe sums over all features, one row."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), F.count_if(F.lower(F.trim(level)) == worst).alias("n_worst"), total(length).alias("exposed_length_m"), total(area).alias("exposed_area_m2"))


def histogram(df: DataFrame, level: Column, names: list[str], other: str = "sin_clasificar") -> DataFrame:
    """level and n for every name, zero included; null and unknown levels count as `other`."""
    spark = df.sparkSession
    keys = spark.createDataFrame([(n,) for n in [*names, other]], "level string")
    n = df.select(F.when(level.isin(*names), level).otherwise(other).alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    return keys.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def nearest_feature(layers: list[tuple[str, DataFrame]], key: str, distance: str) -> DataFrame:
    """layer, key and distance of the feature nearest to a place over several layers; on a tie the earlier layer, then
    the smaller key. At most one row; no sort of all features, only a least."""
    rows = None
    for i, (name, df) in enumerate(layers):
        part = df.select(F.lit(name).alias("layer"), F.lit(i).alias("_o"), F.col(key).alias("key"), F.col(distance).alias("distance_m"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.where("distance_m IS NOT NULL").agg(F.min(F.struct("distance_m", "_o", "key", "layer")).alias("b")).where("b IS NOT NULL")
    return best.select("b.layer", "b.key", "b.distance_m")


def _within(points: DataFrame, shore: DataFrame, features: DataFrame, reach: str) -> DataFrame:
    """point and distance to the shore of the points within the greatest reach of the features. The points descend the
    hierarchies: corridors as wide as the greatest reach, which one odd rate may set, would hold every point."""
    most = features.select(F.max(reach).alias("m")).first()["m"]
    lines = shore.select(F.col("id").cast("string").alias("line"), "x1", "y1", "x2", "y2").where("line IS NOT NULL AND x1 + y1 + x2 + y2 IS NOT NULL").distinct()
    points = points.select(F.col("point").cast("string").alias("point"), "px", "py").where("point IS NOT NULL AND px IS NOT NULL AND py IS NOT NULL")
    return descended(written(points, "points"), written(lines, "lines"), max(float(most or 0.0), 1e-6)).select("point", "distance")


def _reached(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, t0 and t1: the shares of the segment a (ax1..ay2) between which it lies within _r of the segment b (bx1..by2);
    t0 > t1 or null where it nowhere does. What lies within a distance of a segment is convex (two circles and a strip
    between them), so there is one stretch, from the least to the greatest root of the three. The steps are fenced: each
    is used several times and computed once."""
    e = F.expr
    df = fenced(df, [*keep, "bx1"], {"dx": e("ax2 - ax1"), "dy": e("ay2 - ay1"), "ux": e("bx2 - bx1"), "uy": e("by2 - by1"), "fx": e("ax1 - bx1"), "fy": e("ay1 - by1")})
    df = fenced(df, keep, {
        "a": e("dx * dx + dy * dy"), "ul": e("hypot(ux, uy)"), "h1": e("fx * dx + fy * dy"), "e1": e("fx * fx + fy * fy - _r * _r"),
        "h2": e("(fx - ux) * dx + (fy - uy) * dy"), "e2": e("(fx - ux) * (fx - ux) + (fy - uy) * (fy - uy) - _r * _r"),
        "al": e("fx * ux + fy * uy"), "ad": e("dx * ux + dy * uy"), "cl": e("fy * ux - fx * uy"), "cd": e("dy * ux - dx * uy"),
    })
    always = lambda start, low, high: F.when(start.between(low, high), 1e300).otherwise(-1e300)  # noqa: E731  # parallel: everywhere or nowhere

    def slab(start: str, slope: str, low: Column, high: Column) -> tuple[Column, Column]:
        ends = F.try_divide(low - F.col(start), F.col(slope)), F.try_divide(high - F.col(start), F.col(slope))
        level = always(F.col(start), low, high)
        return F.when(F.col(slope) == 0, -level).otherwise(F.least(*ends)), F.when(F.col(slope) == 0, level).otherwise(F.greatest(*ends))

    # along and across are in units of the length of b
    wide = F.col("_r") * F.col("ul")
    along, across = slab("al", "ad", F.lit(0.0), F.col("ul") * F.col("ul")), slab("cl", "cd", -wide, wide)
    df = fenced(df, [*keep, "a", "ul", "h1", "h2"], {"q1": e("h1 * h1 - a * e1"), "q2": e("h2 * h2 - a * e2"), "low": F.greatest(along[0], across[0]), "high": F.least(along[1], across[1])})

    def root(n: int, sign: int) -> Column:
        return F.when(F.col(f"q{n}") >= 0, F.try_divide(-F.col(f"h{n}") + sign * F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{n}"))), F.col("a")))

    strip = (F.col("ul") > 0) & (F.col("low") <= F.col("high"))
    t0 = F.greatest(F.lit(0.0), F.least(root(1, -1), root(2, -1), F.when(strip, F.col("low")), F.lit(2.0)))
    t1 = F.least(F.lit(1.0), F.greatest(root(1, 1), root(2, 1), F.when(strip, F.col("high")), F.lit(-1.0)))
    return fenced(df, keep, {"t0": t0, "t1": t1})


def exposed_length(roads: DataFrame, shore: DataFrame, reach: str, cell: float = 100.0) -> DataFrame:
    """id and the length of each road segment (id, x1..y2, reach) that lies within its reach of the shore's segments
    (id, x1..y2), exactly: between the roots of the distance, the stretches of several shore segments merged. Both
    sides are cut into parts of at most `cell` metres (or the greatest reach) and meet in grid cells. Repeated roads
    count once. A null reach or one not positive exposes nothing."""
    most = roads.select(F.max(reach).alias("m")).first()["m"]
    cell = max(cell, float(most or 0.0))

    def parts(d: DataFrame, n: str, keep: list[str]) -> DataFrame:
        d = d.select(*keep, "x1", "y1", "x2", "y2").where("x1 + y1 + x2 + y2 IS NOT NULL").distinct()
        d = d.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / cell)).cast("int"))
        d = d.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        at = lambda v, k: F.col(f"{v}1") + k / F.col("_n") * (F.col(f"{v}2") - F.col(f"{v}1"))
        return d.select(*keep, *[at(v, F.col("_k") + e - 1).alias(f"{n}{v}{e}") for e in (1, 2) for v in ("x", "y")])

    def celled(d: DataFrame, n: str, by: Column) -> DataFrame:
        ends = {f"{n}{f}{v}": g(f"{n}{v}1", f"{n}{v}2") + s * by for v in ("x", "y") for f, g, s in (("l", F.least, -1), ("h", F.greatest, 1))}
        d = d.withColumns(ends)
        for v in ("x", "y"):
            d = d.withColumn(f"c{v}", F.explode(F.sequence(F.floor(F.col(f"{n}l{v}") / cell), F.floor(F.col(f"{n}h{v}") / cell))))
        return d

    r = roads.withColumn("_r", F.col(reach).cast("double")).where("_r > 0")
    a = parts(r, "a", ["id", "_r"])
    j = celled(a, "a", F.col("_r") * 1.0001).join(celled(parts(shore, "b", []), "b", F.lit(0.0)), ["cx", "cy"])
    j = j.where("alx <= bhx AND blx <= ahx AND aly <= bhy AND bly <= ahy")
    j = j.where((F.floor(F.greatest("alx", "blx") / cell) == F.col("cx")) & (F.floor(F.greatest("aly", "bly") / cell) == F.col("cy")))
    part = ["id", "_r", "ax1", "ay1", "ax2", "ay2"]
    j = _reached(j, part).where("t0 < t1")
    before = F.max("t1").over(Window.partitionBy(*part).orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0.0), F.col("t1") - F.greatest("t0", before)) * F.hypot(F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1"))
    hit = j.select("id", new.alias("_l")).groupBy("id").agg(F.sum("_l").alias("exposed_length_m"))
    return roads.select("id").join(hit, "id", "left").select("id", F.coalesce("exposed_length_m", F.lit(0.0)).alias("exposed_length_m"))


def exposed_area(buildings: DataFrame, shore: DataFrame, reach: str, cell: float = 1.0) -> DataFrame:
    """id and the area of each polygon (id, xs, ys, reach) within its reach of the shore's segments, by cells of
    `cell` metres judged by their centres. A null reach or one not positive exposes nothing."""
    some = buildings.where(F.col(reach) > 0)
    cells = rasterised(some.select("id", "xs", "ys"), "id", cell).join(some.select("id", F.col(reach).alias("_r")), "id")
    c = cells.select("id", "_r", F.concat_ws("\x1f", "id", "row", "col").alias("point"), ((F.col("col") + 0.5) * cell).alias("px"), ((F.col("row") + 0.5) * cell).alias("py"))
    near = _within(c, shore, some, reach)
    hit = c.join(near, "point").where(F.col("distance") <= F.col("_r")).groupBy("id").agg((F.count("*") * cell * cell).alias("exposed_area_m2"))
    return buildings.select("id").join(hit, "id", "left").select("id", F.coalesce("exposed_area_m2", F.lit(0.0)).alias("exposed_area_m2"))


def line_distance(features: DataFrame, shore: DataFrame, cell: float = 100.0) -> DataFrame:
    """id and distance_m between each feature segment (id, x1..y2) and the nearest shore segment (id, x1..y2): 0 if
    they cross, else the least distance of an end of one from the other.

    The features' ends give a bound. A shore vertex nearer to the feature than that lies beside it, not beyond its ends,
    and is no nearer to its ends than the bound: it lies in one of two slabs along the feature, the thinner the farther
    the shore is, so only the vertices in those are measured.
    """
    def ends(d: DataFrame) -> DataFrame:
        p = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
        return d.select(F.col("id").cast("string").alias("point"), p.alias("p")).select("point", F.col("p.x").alias("px"), F.col("p.y").alias("py"))

    one = lambda d: d.select(F.lit(0).alias("g"), "id", "x1", "y1", "x2", "y2")
    forth = nearest_lines(ends(features), shore.select(F.col("id").alias("line"), "x1", "y1", "x2", "y2")).groupBy(F.col("point").alias("id")).agg(F.min("distance").alias("d"))
    forth = written(forth, "bounds")  # read for the slabs and for the result
    c = features.select(F.col("id").cast("string").alias("id"), "x1", "y1", "x2", "y2").join(forth, "id").where("d > 0")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    c = c.withColumns({"ux": F.try_divide(F.col("x2") - F.col("x1"), length), "uy": F.try_divide(F.col("y2") - F.col("y1"), length)}).where("ux IS NOT NULL")
    near = 1e-6  # metres by which a slab is widened, so that rounding loses no vertex on its border
    high = F.col("d") * (1 + 1e-9) + near
    low = F.sqrt(F.greatest(F.lit(0.0), (F.col("d") - length / 2) * (F.col("d") + length / 2))) * (1 - 1e-9) - near
    both = F.when(low > 0, F.array(F.struct(low.alias("a"), high.alias("b")), F.struct((-high).alias("a"), (-low).alias("b")))).otherwise(F.array(F.struct((-high).alias("a"), high.alias("b"))))
    c = c.withColumn("q", F.explode(both))
    ring = ((1, -near, "a"), (2, near, "a"), (2, near, "b"), (1, -near, "b"))
    xs = F.array(*[F.col(f"x{e}") + s * F.col("ux") - F.col(f"q.{t}") * F.col("uy") for e, s, t in ring])
    ys = F.array(*[F.col(f"y{e}") + s * F.col("uy") + F.col(f"q.{t}") * F.col("ux") for e, s, t in ring])
    name = F.concat_ws("\x1f", "x1", "y1", "x2", "y2", "id")
    slabs = written(c.select(name.alias("region"), xs.alias("xs"), ys.alias("ys")), "slabs")  # counted, sampled and joined
    inside = in_regions(ends(shore).distinct(), slabs)
    bits = F.split("region", "\x1f", 5)
    back = inside.select(bits[4].alias("id"), point_segment_distance(F.col("px"), F.col("py"), *[bits[i].cast("double") for i in range(4)]).alias("d"))
    crossing = crossings(one(features), one(shore), cell).select(F.col("a_id").cast("string").alias("id"), F.lit(0.0).alias("d"))
    return forth.unionByName(crossing).unionByName(back).groupBy("id").agg(F.min("d").alias("distance_m"))


def assessed(buildings: DataFrame, shore: DataFrame, rates: DataFrame, line: str, rate: str, horizon: int = 30, cell: float = 1.0) -> DataFrame:
    """id, transect, rate, distance_m, years_to_impact, horizon_years and exposed_area_m2 of every building (id, xs, ys): the
    rate of the transect nearest to its centre, its distance from the nearest shore segment (id, x1..y2), the time until
    the shore is there and the area within what it retreats in `horizon` years. Without a positive rate nothing is
    exposed and the time is null. `id` must be unique; polygons without area have no centre and are left out."""
    c = centroid(F.col("xs"), F.col("ys"))
    b = buildings.select(F.col("id").cast("string").alias("id"), "xs", "ys", c.alias("c")).where("c IS NOT NULL")
    b = written(b, "buildings")  # read for the rates, the sides and the result
    near = nearest_rates(b.select("id", F.col("c.x").alias("px"), F.col("c.y").alias("py")), "id", "px", "py", rates, line, rate).select("id", line, rate)
    n = F.size("xs")
    at = lambda a, i: F.element_at(a, i)
    sides = b.select("id", "xs", "ys", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    sides = sides.select(F.concat_ws("\x1e", F.col("i").cast("string"), "id").alias("id"), at("xs", F.col("i")).alias("x1"), at("ys", F.col("i")).alias("y1"), at("xs", F.col("i") % n + 1).alias("x2"), at("ys", F.col("i") % n + 1).alias("y2"))
    far = line_distance(sides, shore).groupBy(F.split("id", "\x1e", 2)[1].alias("id")).agg(F.min("distance_m").alias("distance_m"))
    j = written(b.drop("c").join(near, "id").join(far, "id", "left"), "assessed")
    # no cell of a polygon is nearer to the shore than its sides are, less the diagonal of its box
    wide = F.hypot(*[F.array_max(v) - F.array_min(v) for v in ("xs", "ys")])
    reach = F.greatest(F.lit(0.0), F.col(rate)) * horizon
    area = exposed_area(j.select("id", "xs", "ys", F.when(F.coalesce(F.col("distance_m"), F.lit(0.0)) - wide <= reach, reach).alias("reach")), shore, "reach", cell)
    return j.join(area, "id").select("id", line, rate, "distance_m", years_to_impact(F.col("distance_m"), F.col(rate)).alias("years_to_impact"), F.lit(horizon).alias("horizon_years"), "exposed_area_m2")
