"""Lines as vertex rows (line, seq, x, y); seq counts 0, 1, 2, ... along each line.

No operator orders a whole line in one task: neighbours and running lengths meet through blocks of a line, and every
segment knows its line's length, so points at regular distances come from the segments without a join. A missing number
breaks a line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorespark.functions.places import places
from shorespark.operators.spatial import nearest_lines
from shorespark.session import written

BLOCK = 4096
STRETCH = 100.0  #: metres of a line that share a join key


def vertices(df: DataFrame, line: str, order: str, x: str, y: str, step: float | None = None, span: float = 10_000.0) -> DataFrame:
    """Vertex rows of a table; seq is order/step where the order is a regular grid, else the place by order, found in
    blocks of `span` order units. Rows with null coordinates are left out and repeated order values keep the smallest
    (x, y)."""
    v = df.select(F.col(line).alias("line"), F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND o IS NOT NULL")
    v = v.groupBy("line", "o").agg(F.min(F.struct("x", "y")).alias("p"))
    if step:
        return v.select("line", F.round(F.col("o") / step).cast("long").alias("seq"), "p.x", "p.y")
    return places(v, ["line"], "o", span, "seq").select("line", "seq", "p.x", "p.y")


def _in_blocks(v: DataFrame) -> DataFrame:
    """The vertices by (line, block) with the block's two neighbours: the vertices next to a border belong to both blocks."""
    at = lambda k: F.floor((F.col("seq") + k) / BLOCK)
    b = v.select("line", "seq", "x", "y").where("line IS NOT NULL")
    return b.withColumn("block", F.explode(F.array_distinct(F.array(at(-1), at(0), at(1)))))


def neighbours(v: DataFrame) -> DataFrame:
    """line, block, seq, x, y, before and after (struct seq, x, y) of every vertex: those with the number before and behind
    it on its line; null at the line's ends and where a number is missing, which breaks the line. One shuffle by (line,
    block). Lines without a name are left out."""
    place, here = Window.partitionBy("line", "block").orderBy("seq"), F.struct("seq", "x", "y")
    w = _in_blocks(v).withColumns({"_p": F.lag(here).over(place), "_n": F.lead(here).over(place)}).where(F.floor(F.col("seq") / BLOCK) == F.col("block"))
    return w.select("line", "block", "seq", "x", "y", F.when(F.col("_p.seq") == F.col("seq") - 1, F.col("_p")).alias("before"), F.when(F.col("_n.seq") == F.col("seq") + 1, F.col("_n")).alias("after"))


def segments(v: DataFrame) -> DataFrame:
    """line, seq, x1, y1, x2, y2, len, cum and upto (length of the line before and with the segment), length (of the line),
    first and last (its least and greatest seq); lines of one vertex have none.

    Written once: running lengths inside blocks come from one shuffle, the blocks' sums, a row per block, are added up
    over the line. Every segment knows its line's length, so what follows scans this table alone.
    """
    n = neighbours(v).where("after IS NOT NULL")
    s = n.select("line", "block", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("after.x").alias("x2"), F.col("after.y").alias("y2"))
    s = s.withColumn("len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    place = Window.partitionBy("line", "block").orderBy("seq")
    s = s.withColumn("_u", F.sum("len").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_i", F.coalesce(F.lag("_u").over(place), F.lit(0.0)))
    t = s.groupBy("line", "block").agg(F.max("_u").alias("t"), F.min("seq").alias("a"), F.max("seq").alias("z"))
    row, whole = Window.partitionBy("line").orderBy("block"), Window.partitionBy("line")
    t = t.withColumn("u", F.sum("t").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.select("line", "block", F.coalesce(F.lag("u").over(row), F.lit(0.0)).alias("_b"), F.max("u").over(whole).alias("length"), F.min("a").over(whole).alias("first"), F.max("z").over(whole).alias("last"))
    j = s.join(t, ["line", "block"])
    return written(j.select("line", "seq", "x1", "y1", "x2", "y2", "len", (F.col("_b") + F.col("_i")).alias("cum"), (F.col("_b") + F.col("_u")).alias("upto"), "length", "first", "last"), "segments")


def lengths(segs: DataFrame) -> DataFrame:
    return segs.where(F.col("seq") == F.col("first")).select("line", "length")


def locate(segs: DataFrame, targets: DataFrame, distance: str, keep: list[str], x: str = "x", y: str = "y", stretch: float = STRETCH) -> DataFrame:
    """The point at a distance along the line for every target (line, distance, ...); distances are clamped to the line.
    For any distances: targets find their segment by an equi-join on stretches of the line."""
    t = targets.join(lengths(segs).withColumnRenamed("length", "_l"), "line").withColumn("_d", F.greatest(F.lit(0.0), F.least(F.col(distance), F.col("_l"))))
    t = t.withColumn("_b", F.floor(F.col("_d") / stretch))
    s = segs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("cum") / stretch), F.floor(F.col("upto") / stretch))))
    inside = (F.col("_d") >= F.col("cum")) & ((F.col("_d") < F.col("upto")) | (F.col("seq") == F.col("last")))
    j = s.join(t, ["line", "_b"]).where(inside)
    point = F.struct("seq", *_point(F.col("_d")))
    return j.groupBy("line", *keep).agg(F.min(point).alias("p")).select("line", *keep, F.col("p.x").alias(x), F.col("p.y").alias(y))


def _point(d: Column) -> tuple[Column, Column]:
    """x and y of the segment's point at a distance along its line."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(d - F.col("cum"), F.col("len")), F.lit(0.0))))
    return tuple((F.col(f"{c}1") + f * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c) for c in ("x", "y"))


def _regular(step: Column, most: Column, shift: Column, tail: bool) -> Column:
    """array of struct(k, e): the k of 0..most whose distance e = k step + shift, clamped to the line, lies in a segment,
    and with `tail` the line's end as k = most + 1 where it is not reached by a step (tolerance 1e-7)."""
    cum, upto, length = F.col("cum"), F.col("upto"), F.col("length")
    begins, ends = F.col("seq") == F.col("first"), F.col("seq") == F.col("last")
    at = lambda d: F.coalesce(F.ceil(F.try_divide(d - shift, step)), F.lit(0)).cast("long")
    low = F.when(begins, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), at(cum)))
    high = F.when(ends, most).otherwise(F.least(most, at(upto) - 1))
    clamp = lambda d: F.greatest(F.lit(0.0), F.least(length, d))
    none = F.array().cast("array<struct<k:bigint,e:double>>")
    some = F.transform(F.sequence(low, F.greatest(low, high)), lambda k: F.struct(k.alias("k"), clamp(k * step + shift).alias("e")))
    out = F.when(low <= high, some).otherwise(none)
    if tail:
        e = clamp(length + shift)
        here = (length - most * step > 1e-7) & (begins | (e >= cum)) & (ends | (e < upto))
        out = F.concat(out, F.when(here, F.array(F.struct((most + 1).alias("k"), e.alias("e")))).otherwise(none))
    return out


def at_steps(segs: DataFrame, step: Column, most: Column, tail: bool = False, window: Column | None = None) -> DataFrame:
    """line, k, d, x, y: the points at 0, step, ..., most x step along each line, with `tail` also its end; with `window`
    also tx, ty: the unit direction between the points `window` before and behind (points without one are left out).

    step, most and window may use the column `length`. Without `window` nothing is shuffled: each segment makes the
    points that lie on it; with it, one aggregate by (line, k) joins the three points.
    """
    most = most.cast("long")
    if window is None:
        e = segs.withColumn("_t", F.explode(_regular(step, most, F.lit(0.0), tail)))
        return e.select("line", F.col("_t.k").alias("k"), F.col("_t.e").alias("d"), *_point(F.col("_t.e")))
    three = F.array(*[F.struct(F.lit(i).alias("i"), _regular(step, most, s, tail).alias("a")) for i, s in enumerate((F.lit(0.0), -window, window))])
    e = segs.withColumn("_f", F.explode(three)).withColumn("_t", F.explode("_f.a"))
    e = e.select("line", F.col("_f.i").alias("i"), F.col("_t.k").alias("k"), F.col("_t.e").alias("d"), *_point(F.col("_t.e")))
    of = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    j = e.groupBy("line", "k").agg(of(0, "d").alias("d"), of(0, "x").alias("x"), of(0, "y").alias("y"), (of(2, "x") - of(1, "x")).alias("dx"), (of(2, "y") - of(1, "y")).alias("dy"))
    n = F.hypot("dx", "dy")
    return j.where("dx <> 0 OR dy <> 0").select("line", "k", "d", "x", "y", (F.col("dx") / n).alias("tx"), (F.col("dy") / n).alias("ty"))


def resampled(v: DataFrame, count: int = 150) -> DataFrame:
    """line, i, x, y: `count` points at equal distances along each line, its ends included."""
    points = at_steps(segments(v), F.col("length") / (count - 1), F.lit(count - 1))
    return points.select("line", F.col("k").cast("int").alias("i"), "x", "y")


def fixed_transects(v: DataFrame, spacing: float = 100.0, seaward: float = 100.0, landward: float = 300.0, positive_side: str = "left") -> DataFrame:
    """line, k, chainage_m, origin_x/y, normal_x/y (towards the positive side) and both ends of every transect."""
    if positive_side not in ("left", "right") or spacing <= 0 or seaward < 0 or landward < 0:
        raise ValueError("positive_side must be left or right, spacing positive and both lengths not negative")
    window = F.least(F.lit(10.0), F.greatest(F.lit(0.5), F.lit(spacing / 10), F.col("length") / 10_000))
    at = at_steps(segments(v), F.lit(float(spacing)), F.floor(F.col("length") / spacing), True, window)
    side = 1.0 if positive_side == "left" else -1.0
    j = at.withColumns({"nx": -F.col("ty") * side, "ny": F.col("tx") * side})
    end = lambda c, n, s: F.col(c) + F.lit(s) * F.col(n)
    return j.select(
        "line", F.col("k").cast("int").alias("k"), F.col("d").alias("chainage_m"), F.col("x").alias("origin_x"), F.col("y").alias("origin_y"), F.col("nx").alias("normal_x"), F.col("ny").alias("normal_y"),
        end("x", "nx", -seaward).alias("sea_x"), end("y", "ny", -seaward).alias("sea_y"), end("x", "nx", landward).alias("land_x"), end("y", "ny", landward).alias("land_y"),
    )


def crossings(a: DataFrame, b: DataFrame, cell: float = 100.0) -> DataFrame:
    """Where the segments a (g, id, x1..y2) and b (g, id, x1..y2) of the same group g meet: g, a_id, b_id, a_len, t, x, y and
    t_to, the share of a behind t up to which both lie on one line, null for a single point.

    Both sides are cut into parts of at most `cell` metres, which lie in few grid cells however long the segment is,
    and joined by cell; parts that share several cells meet in the lower corner of their boxes' overlap only, and a
    point counts for the parts that hold it, so each meeting is found once.
    """
    near = 1e-6  # metres by which a part's box is widened, so that rounding loses no point on its border

    def celled(s: DataFrame, n: str) -> DataFrame:
        s = s.select("g", F.col("id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}{c}") for c in ("x1", "y1", "x2", "y2")]).where(f"{n}x1 + {n}y1 + {n}x2 + {n}y2 IS NOT NULL")
        s = s.withColumn(f"{n}n", F.greatest(F.lit(1.0), F.ceil(F.hypot(F.col(f"{n}x2") - F.col(f"{n}x1"), F.col(f"{n}y2") - F.col(f"{n}y1")) / cell).cast("double")))
        s = s.withColumn(f"{n}k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{n}n").cast("long") - 1)))
        at = lambda c, k: F.col(f"{n}{c}1") + k / F.col(f"{n}n") * (F.col(f"{n}{c}2") - F.col(f"{n}{c}1"))
        k = F.col(f"{n}k")
        for c in ("x", "y"):
            s = s.withColumns({f"{n}l{c}": F.least(at(c, k), at(c, k + 1)) - near, f"{n}h{c}": F.greatest(at(c, k), at(c, k + 1)) + near})
        steps = lambda c: F.sequence(F.floor(F.col(f"{n}l{c}") / cell), F.floor(F.col(f"{n}h{c}") / cell))
        return s.withColumn("cx", F.explode(steps("x"))).withColumn("cy", F.explode(steps("y")))

    j = celled(a, "a").join(celled(b, "b"), ["g", "cx", "cy"])
    j = j.where("alx <= bhx AND blx <= ahx AND aly <= bhy AND bly <= ahy")
    j = j.where((F.floor(F.greatest("alx", "blx") / cell) == F.col("cx")) & (F.floor(F.greatest("aly", "bly") / cell) == F.col("cy")))
    j = j.withColumns({"dx": F.expr("ax2 - ax1"), "dy": F.expr("ay2 - ay1"), "ex": F.expr("bx2 - bx1"), "ey": F.expr("by2 - by1"), "fx": F.expr("bx1 - ax1"), "fy": F.expr("by1 - ay1")})
    j = j.withColumns({"a_len": F.hypot("dx", "dy"), "b_len": F.hypot("ex", "ey"), "det": F.expr("dx * ey - dy * ex")})
    along = F.abs("det") <= 1e-12 * F.col("a_len") * F.col("b_len")
    same = along & (F.abs(F.expr("fx * dy - fy * dx")) <= 1e-9 * F.col("a_len"))
    on = lambda x, y: F.try_divide(F.expr(f"({x}) * dx + ({y}) * dy"), F.col("a_len") * F.col("a_len"))
    j = j.withColumns({"along": along, "_p": on("fx", "fy"), "_q": on("fx + ex", "fy + ey")})
    t = F.when(~F.col("along"), F.try_divide(F.expr("fx * ey - fy * ex"), F.col("det"))).when(same, F.greatest(F.lit(0.0), F.least("_p", "_q")))
    j = j.withColumns({"t": t, "_e": F.when(same, F.least(F.lit(1.0), F.greatest("_p", "_q")))})
    u = F.when(~F.col("along"), F.try_divide(F.expr("fx * dy - fy * dx"), F.col("det"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("t") - F.col("_p"), F.col("_q") - F.col("_p")), F.lit(0.0)))))
    j = j.withColumn("u", u).where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AND (_e IS NULL OR t <= _e)")
    mine = lambda c, n: F.least(F.floor(F.col(c) * F.col(f"{n}n")), F.col(f"{n}n") - 1) == F.col(f"{n}k")
    j = j.where(mine("t", "a") & mine("u", "b"))
    return j.select("g", "a_id", "b_id", "a_len", "t", F.expr("ax1 + t * dx").alias("x"), F.expr("ay1 + t * dy").alias("y"), F.when(F.col("_e") > F.col("t"), F.col("_e")).alias("t_to"))


def nearest_crossings(transects: DataFrame, shores: DataFrame, seaward: float) -> DataFrame:
    """For every transect (g, id, x1..y2, from the seaward end) and shore (g, shore): position_m along the transect from
    its origin, `seaward` behind its first end, of the crossing nearest to the origin, with candidate_count and method.

    Points shared by two segments count once and points of a stretch that both share not at all; where there are only
    such stretches, the point of them nearest to the origin counts ('nearest_on_overlap', no candidates).
    Combinations without a crossing are kept with a null position. shores: segments (g, shore, id, x1..y2)."""
    hits = crossings(transects, shores.select("g", F.struct("shore", "id").alias("id"), "x1", "y1", "x2", "y2"))
    at = lambda c: F.round(F.col(c) * F.col("a_len") - seaward, 6)
    hits = hits.select("g", "a_id", F.col("b_id.shore").alias("shore"), at("t").alias("p"), at("t_to").alias("q"))
    hits = written(hits, "hits")  # few beside the segments, and read three times
    over = hits.where("q IS NOT NULL").select("g", "a_id", "shore", F.col("p").alias("p0"), F.col("q").alias("p1"))
    key = ["g", "a_id", "shore"]
    o = over.withColumnsRenamed({k: f"_{k}" for k in key})
    inside = (F.col("p") >= F.col("p0") - 1e-6) & (F.col("p") <= F.col("p1") + 1e-6)
    for k in key:
        inside = inside & (F.col(k) == F.col(f"_{k}"))
    points = hits.where("q IS NULL").select(*key, "p").join(o, inside, "left_anti").distinct().select(*key, "p", F.lit(1).alias("n"))
    spots = over.select(*key, F.greatest("p0", F.least("p1", F.lit(0.0))).alias("p"), F.lit(0).alias("n"))
    # a point goes before every stretch
    best = points.unionByName(spots).groupBy(*key).agg(F.min_by("p", F.struct(1 - F.col("n"), F.abs("p"), "p")).alias("position_m"), F.sum("n").alias("candidate_count"))
    combos = transects.select("g", F.col("id").alias("a_id")).join(shores.select("g", "shore").distinct(), "g")
    j = combos.join(best, key, "left")
    n = F.coalesce("candidate_count", F.lit(0))
    method = F.when(F.col("position_m").isNull(), "no_intersection").when(n == 0, "nearest_on_overlap").when(n == 1, "single_point").otherwise("nearest_of_multiple")
    return j.select("g", F.col("a_id").alias("id"), "shore", "position_m", n.alias("candidate_count"), method.alias("intersection_method"))


def self_crossings(v: DataFrame) -> DataFrame:
    """line and n: how often each line (line, seq, x, y) meets itself besides at the joints of successive segments; 0 for a
    simple line. The closing joint of a ring counts as none."""
    s = segments(v)
    one = s.select(F.col("line").alias("g"), F.col("seq").alias("id"), "x1", "y1", "x2", "y2")
    ends = s.groupBy("line").agg(F.min("first").alias("a"), F.max("last").alias("z"), F.max(F.when(F.col("seq") == F.col("first"), F.struct("x1", "y1"))).alias("s"), F.max(F.when(F.col("seq") == F.col("last"), F.struct("x2", "y2"))).alias("e"))
    pairs = crossings(one, one).where("a_id < b_id - 1").join(ends.withColumnRenamed("line", "g"), "g")
    closing = (F.col("s.x1") == F.col("e.x2")) & (F.col("s.y1") == F.col("e.y2")) & (F.col("a_id") == F.col("a")) & (F.col("b_id") == F.col("z")) & (F.col("t") == 0)
    n = pairs.where(~closing).groupBy(F.col("g").alias("line")).agg(F.count("*").alias("n"))
    return ends.select("line").join(n, "line", "left").select("line", F.coalesce("n", F.lit(0)).alias("n"))


def median_line(resamples: DataFrame) -> DataFrame:
    """group, i, x, y: the medians per place of several resampled lines (group, line, i, x, y) after turning round the
    lines whose first point is farther from the first line's start than their last point is."""
    resamples = written(resamples, "resamples")  # read for the ends and for the medians
    ends = resamples.groupBy("group", "line").agg(F.min_by(F.struct("x", "y"), "i").alias("a"), F.max_by(F.struct("x", "y"), "i").alias("b"), F.max("i").alias("m"))
    start = ends.groupBy("group").agg(F.min_by("a", "line").alias("s"))
    d = lambda p: F.hypot(F.col(f"{p}.x") - F.col("s.x"), F.col(f"{p}.y") - F.col("s.y"))
    turn = ends.join(start, "group").select("group", "line", "m", (d("b") < d("a")).alias("turned"))
    j = resamples.join(turn, ["group", "line"]).withColumn("i", F.when(F.col("turned"), F.col("m") - F.col("i")).otherwise(F.col("i")))
    return j.groupBy("group", "i").agg(F.median("x").alias("x"), F.median("y").alias("y"))


def between(a: DataFrame, b: DataFrame, progress: float) -> DataFrame:
    """line, i, x, y at a share (clamped to 0..1) of the way between two resampled lines of the same name and count; the
    second is turned round where its last point is nearer to the start of the first than its first point is."""
    p = min(1.0, max(0.0, progress))
    a, b = written(a, "resampled"), written(b, "resampled")  # read for the ends and for the points
    end = b.groupBy("line").agg(F.max("i").alias("m"), F.min_by(F.struct("x", "y"), "i").alias("s"), F.max_by(F.struct("x", "y"), "i").alias("e"))
    start = a.groupBy("line").agg(F.min_by(F.struct("x", "y"), "i").alias("p"))
    d = lambda q: F.hypot(F.col(f"{q}.x") - F.col("p.x"), F.col(f"{q}.y") - F.col("p.y"))
    turn = end.join(start, "line").select("line", "m", (d("e") < d("s")).alias("turned"))
    b = b.join(turn, "line").select("line", F.when(F.col("turned"), F.col("m") - F.col("i")).otherwise(F.col("i")).alias("i"), F.col("x").alias("bx"), F.col("y").alias("by"))
    j = a.join(b, ["line", "i"])
    return j.select("line", "i", (F.col("x") * (1 - p) + F.col("bx") * p).alias("x"), (F.col("y") * (1 - p) + F.col("by") * p).alias("y"))


def mean_displacement(a: DataFrame, b: DataFrame) -> DataFrame:
    """line and the mean distance of equally numbered points of two resampled lines."""
    j = a.join(b.withColumnsRenamed({"x": "bx", "y": "by"}), ["line", "i"])
    return j.groupBy("line").agg(F.avg(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).alias("mean_displacement_m"))


def north_to_south(v: DataFrame) -> DataFrame:
    """The vertices renumbered so that every line starts at its northern end."""
    ends = v.groupBy("line").agg(F.min_by("y", "seq").alias("ya"), F.max_by("y", "seq").alias("yb"), F.max("seq").alias("m"))
    return v.join(ends, "line").select("line", F.when(F.col("ya") < F.col("yb"), F.col("m") - F.col("seq")).otherwise(F.col("seq")).alias("seq"), "x", "y")


def merged_order(parts: DataFrame) -> DataFrame:
    """line, part, place, turned: the order in which the parts (line, part, x1, y1, x2, y2) of each line join end to end.

    Lines whose parts do not form one open chain (a fork, a gap, a ring) are left out. Parts of one line are gathered:
    a line's number of parts is small beside its vertices, which are not.
    """

    def chain(rows: list[tuple]) -> Iterator[tuple]:
        ends, at = _joints(rows)
        free = sorted(p for p, e in at.items() if len(e) == 1)
        if len(free) != 2 or any(len(e) > 2 for e in at.values()):
            return
        order, seen, here = [], set(), free[0]
        while nxt := [e for e in at[here] if e[0] not in seen]:
            i, side = nxt[0]
            seen.add(i)
            order.append((i, side))
            here = ends[i][1 - side]
        if len(order) == len(rows):
            yield from ((rows[i][1], place, bool(side)) for place, (i, side) in enumerate(order))

    return _by_line(parts, chain, {"place": pa.int32(), "turned": pa.bool_()})


def _joints(rows: list[tuple]) -> tuple[list, dict]:
    """Both ends of each part (line, part, x1, y1, x2, y2), and the parts' ends (number, side) by their place."""
    ends = [((r[2], r[3]), (r[4], r[5])) for r in rows]
    at: dict = {}
    for side in (0, 1):
        for i, e in enumerate(ends):
            at.setdefault(e[side], []).append((i, side))
    return ends, at


def _by_line(parts: DataFrame, make, columns: dict[str, pa.DataType]) -> DataFrame:
    """line, part and `columns` of the rows (part, ...) that make(parts of one line) gives; many lines go through a task in
    one stream. Parts with a null are left out."""
    p = parts.select("line", "part", "x1", "y1", "x2", "y2").where("line IS NOT NULL AND part IS NOT NULL AND x1 + y1 + x2 + y2 IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in p.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            schema = pa.schema([b.schema.field(0), b.schema.field(1), *columns.items()])
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != row[0]:
                    out += [(held[0][0], *r) for r in make(held)]
                    held = []
                held.append(row)
            if out:
                yield table(out)
        if held:
            yield table([(held[0][0], *r) for r in make(held)])

    types = {pa.int32(): "int", pa.bool_(): "boolean"}
    ddl = f"line {kinds['line']}, part {kinds['part']}, " + ", ".join(f"{n} {types[t]}" for n, t in columns.items())
    return p.repartition("line").sortWithinPartitions("line", "part").mapInArrow(run, ddl)


def stitched(parts: DataFrame) -> DataFrame:
    """line, part, ring, place, turned: the order in which the parts (line, part, x1, y1, x2, y2) of each line join end to end
    into closed rings, numbered by their smallest corner. Parts that belong to no simple ring are left out; a part that
    is closed by itself is a ring. The parts of one line, a shape's ways, are gathered."""

    def close(rows: list[tuple]) -> Iterator[tuple]:
        yield from ((rows[i][1], n, place, bool(side)) for n, ring in enumerate(_rings(rows)) for place, (i, side) in enumerate(ring))

    return _by_line(parts, close, {"ring": pa.int32(), "place": pa.int32(), "turned": pa.bool_()})


def _rings(rows: list[tuple]) -> list[list[tuple[int, int]]]:
    """The closed rings of parts (line, part, x1, y1, x2, y2), each the numbers of its parts in order with their first ends."""
    ends, at = _joints(rows)
    seen, found = set(), []
    for start in sorted(at):
        if len(at[start]) != 2 or at[start][0][0] in seen:
            continue
        ring, here = [], start
        while nxt := [e for e in at[here] if e[0] not in seen]:
            i, side = nxt[0]
            seen.add(i)
            ring.append((i, side))
            here = ends[i][1 - side]
        if here == start and all(len(at[p]) == 2 for i, _ in ring for p in ends[i]):
            found.append(ring)
    return found


def closed_rings(df: DataFrame, ends: str, out: str) -> DataFrame:
    """df with the closed rings (see `stitched`) of each row's own parts: `ends` is an array of arrays x1, y1, x2, y2, out the
    rings, each an array of struct part (number in `ends`), turned. Rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("part", pa.int32()), ("turned", pa.bool_())])))
        for b in batches:
            rings = [[[{"part": i, "turned": bool(side)} for i, side in ring] for ring in _rings([(None, k, *e) for k, e in enumerate(parts)])] for parts in b.column(b.schema.get_field_index(ends)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rings, kind)], [*b.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{ddl}, `{out}` array<array<struct<part:int,turned:boolean>>>")


def ring_arc(ring: DataFrame, anchors: DataFrame, tolerance: float) -> DataFrame:
    """line, direction, seq, x, y: the arc of each closed ring (line, seq, x, y; closing vertex left out) between the
    vertices nearest (by |dx| + |dy| within tolerance) to the line's two anchors whose length lies in [least, most];
    none if both directions or neither do. anchors: (line, ax, ay, bx, by, least, most), one row per line."""
    near = lambda p: F.abs(F.col("x") - F.col(f"{p}x")) + F.abs(F.col("y") - F.col(f"{p}y"))
    a = ring.join(anchors, "line").groupBy("line", "least", "most").agg(F.count("*").alias("n"), F.min(F.struct(near("a"), "seq")).alias("a"), F.min(F.struct(near("b"), "seq")).alias("b"))
    a = a.where((F.col("a.col1") <= tolerance) & (F.col("b.col1") <= tolerance)).select("line", "n", F.col("a.seq").alias("s"), F.col("b.seq").alias("e"))
    j = ring.join(a, "line")
    walks = j.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("place", F.pmod((F.col("seq") - F.col("s")) * F.col("direction"), "n"))
    walks = walks.where(F.col("place") <= F.pmod((F.col("e") - F.col("s")) * F.col("direction"), "n"))
    name = F.struct("line", "direction")
    path = walks.select(name.alias("line"), F.col("place").alias("seq"), "x", "y")
    fits = lengths(segments(path)).select(F.col("line.line").alias("r"), F.col("line").alias("l"), "length").join(anchors.select(F.col("line").alias("r"), "least", "most"), "r").where("length BETWEEN least AND most")
    one = fits.groupBy("r").agg(F.count("*").alias("c"), F.first("l").alias("l")).where("c = 1").select(F.col("l").alias("line"))
    return path.join(one, "line").select(F.col("line.line").alias("line"), F.col("line.direction").alias("direction"), "seq", "x", "y")


def centroids(segs: DataFrame) -> DataFrame:
    """line, x, y: the centre of each line, its segments weighted by their lengths; none for lines without length."""
    of = lambda c: F.try_divide(F.sum((F.col(f"{c}1") + F.col(f"{c}2")) / 2 * F.col("len")), F.sum("len")).alias(c)
    return segs.groupBy("line").agg(of("x"), of("y")).where("x IS NOT NULL")


def projected(points: DataFrame, segs: DataFrame) -> DataFrame:
    """point, line, chainage_m and distance_m: the place along the nearest line of the point of it that is nearest to each
    point (point, px, py). Equally near: the smaller (seq, line). Null coordinates are left out."""
    name = F.concat_ws("\x1e", F.lpad(F.col("seq").cast("string"), 12, "0"), "line")
    near = nearest_lines(points, segs.select(name.alias("line"), "x1", "y1", "x2", "y2"))
    bits = F.split("line", "\x1e", 2)
    j = near.select("point", "px", "py", "distance", bits[0].cast("long").alias("seq"), bits[1].alias("line")).join(segs.select("line", "seq", "x1", "y1", "x2", "y2", "len", "cum"), ["line", "seq"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, F.col("len")), F.lit(0.0))
    return j.select("point", "line", (F.col("cum") + F.greatest(F.lit(0.0), F.least(F.col("len"), t))).alias("chainage_m"), F.col("distance").alias("distance_m"))


def arc_checks(v: DataFrame, least: int, most: int) -> DataFrame:
    """line, n_vertices, length_m, simple, north_to_south and fit (a simple line from north to south with a number of
    vertices in [least, most]) of every line of at least two vertices."""
    n = v.groupBy("line").agg(F.count("*").alias("n_vertices"), (F.min_by("y", "seq") > F.max_by("y", "seq")).alias("north_to_south"))
    j = n.join(lengths(segments(v)).withColumnRenamed("length", "length_m"), "line").join(self_crossings(v), "line")
    j = j.withColumn("simple", F.col("n") == 0)
    return j.select("line", "n_vertices", "length_m", "simple", "north_to_south", (F.col("simple") & F.col("north_to_south") & F.col("n_vertices").between(least, most)).alias("fit"))


def _farthest(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the points that Douglas-Peucker keeps."""
    mark = np.zeros(len(p), bool)
    mark[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        t = np.clip(q @ d / (d @ d), 0, 1) if d.any() else np.zeros(len(q))
        far = np.hypot(*(q - t[:, None] * d).T)
        i = int(far.argmax())
        if far[i] > tolerance:
            mark[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return mark


def simplified(v: DataFrame, tolerance: float, block: int = BLOCK) -> DataFrame:
    """line, seq, x, y of the vertices that Douglas-Peucker keeps, the same for every `block`.

    A stretch between two kept vertices of more than `block` vertices is split where the whole table's aggregate finds
    its farthest vertex, all such stretches of all lines at once; shorter ones are finished in one task each. So no
    line is gathered. Equally far vertices: the first.
    """
    kind = v.schema["line"].dataType.simpleString()

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        p = pdf[["x", "y", "ex", "ey"]].to_numpy()
        mark = _farthest(np.r_[p[:, :2], p[-1:, 2:]], tolerance)[:-1]
        return pdf[mark][["line", "seq", "x", "y"]].astype({"line": object})

    # a stretch holds its first vertex, and its last one as (ex, ey); the line's last vertex is kept beside the stretches
    n = v.where("line IS NOT NULL").groupBy("line").agg(F.min("seq").alias("part"), F.max("seq").alias("last"), F.count("*").alias("n"))
    ends = v.join(n, "line").where(F.col("seq") == F.col("last")).select("line", "seq", "x", "y", "part", "n")
    out = ends.select("line", "seq", "x", "y")
    rows = v.join(ends.select("line", "part", F.col("seq").alias("e"), F.col("x").alias("ex"), F.col("y").alias("ey"), "n"), "line").where(F.col("seq") < F.col("e"))
    if n.where(F.col("n") > block).isEmpty():
        done = rows
    else:
        rows, done = written(rows, "stretches"), None
        while True:
            small = rows.where(F.col("n") <= block)
            done = small if done is None else done.unionByName(small)
            large = rows.where(F.col("n") > block)
            if large.isEmpty():
                break
            first = large.where(F.col("seq") == F.col("part")).select("line", "part", F.col("x").alias("sx"), F.col("y").alias("sy"))
            j = large.join(first, ["line", "part"])
            dx, dy, qx, qy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"), F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(qx * dx + qy * dy, dx * dx + dy * dy), F.lit(0.0))))
            j = j.withColumn("d", F.hypot(qx - t * dx, qy - t * dy))
            far = j.groupBy("line", "part").agg(F.max(F.struct("d", -F.col("seq"), "x", "y")).alias("m")).select("line", "part", F.col("m.d").alias("d"), (-F.col("m.col2")).alias("m"), F.col("m.x").alias("mx"), F.col("m.y").alias("my"))
            k = large.join(far, ["line", "part"])
            straight = k.where((F.col("d") <= tolerance) & (F.col("seq") == F.col("part"))).select("line", "seq", "x", "y")
            out = out.unionByName(straight)
            k = k.where(F.col("d") > tolerance).withColumn("behind", F.col("seq") >= F.col("m"))
            k = k.select("line", "seq", "x", "y", F.when(F.col("behind"), F.col("m")).otherwise(F.col("part")).alias("part"), F.when(F.col("behind"), F.col("e")).otherwise(F.col("m")).alias("e"), F.when(F.col("behind"), F.col("ex")).otherwise(F.col("mx")).alias("ex"), F.when(F.col("behind"), F.col("ey")).otherwise(F.col("my")).alias("ey"))
            size = k.groupBy("line", "part").agg(F.count("*").alias("n"))
            rows = written(k.join(size, ["line", "part"]), "stretches")
    return out.unionByName(done.groupBy("line", "part").applyInPandas(keep, f"line {kind}, seq long, x double, y double"))


def offset_points(v: DataFrame, distance: float) -> DataFrame:
    """line, seq, x, y: the vertices moved `distance` to the left along the mean normal of their two segments.
    A vertex whose segments turn back on themselves has no normal and stays."""
    j = _units(v)
    mx, my = (F.coalesce((F.col(f"u{c}") + F.col(f"w{c}")) / 2, F.col(f"u{c}"), F.col(f"w{c}")) for c in ("x", "y"))
    j = j.withColumns({"mx": mx, "my": my})
    j = j.withColumn("f", F.coalesce(F.try_divide(F.lit(float(distance)), F.col("mx") * F.col("mx") + F.col("my") * F.col("my")), F.lit(0.0)))
    return j.select("line", "seq", (F.col("x") - F.coalesce("my", F.lit(0.0)) * F.col("f")).alias("x"), (F.col("y") + F.coalesce("mx", F.lit(0.0)) * F.col("f")).alias("y"))


def _units(v: DataFrame) -> DataFrame:
    """The vertices with the unit directions ux, uy from the vertex before and wx, wy to the one behind; null at the ends and
    where both coincide."""
    j = neighbours(v)
    of = lambda a, b, c: (F.try_divide(b[c] - a[c], F.hypot(b["x"] - a["x"], b["y"] - a["y"])))
    here = F.struct("x", "y")
    return j.select("line", "seq", "x", "y", *[of(F.col("before"), here, c).alias(f"u{c}") for c in ("x", "y")], *[of(here, F.col("after"), c).alias(f"w{c}") for c in ("x", "y")])


def offset_curve(v: DataFrame, distance: float, quad_segs: int = 8) -> DataFrame:
    """line, seq, place, x, y: the curve `distance` to the left of each line (negative: to the right), by seq and place.

    Where the line turns away from the offset side the corner becomes an arc of `quad_segs` steps a quarter, elsewhere
    the two moved segments meet in their crossing. Corners sharper than the distance allows may cross themselves:
    `self_crossings` of the renumbered result tells. A vertex without any direction stays.
    """
    j = _units(v)
    d = float(distance)
    ux, uy, wx, wy = (F.coalesce(F.col(a), F.col(b), F.lit(0.0)) for a, b in (("ux", "wx"), ("uy", "wy"), ("wx", "ux"), ("wy", "uy")))
    j = j.withColumns({"ux": ux, "uy": uy, "wx": wx, "wy": wy})
    turn = F.atan2(F.expr("ux * wy - uy * wx"), F.expr("ux * wx + uy * wy"))
    j = j.withColumns({"turn": turn, "start": F.atan2(F.col("ux") * (1 if d >= 0 else -1), F.col("uy") * (-1 if d >= 0 else 1))})
    outer = F.col("turn") * d < -1e-12
    n = F.greatest(F.lit(1), F.ceil(F.abs("turn") / (math.pi / 2 / quad_segs) - 1e-9)).cast("int")
    arc = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("place"), (F.col("x") + abs(d) * F.cos(F.col("start") + F.col("turn") * i / n)).alias("px"), (F.col("y") + abs(d) * F.sin(F.col("start") + F.col("turn") * i / n)).alias("py")))
    c2 = F.expr("(1 + ux * wx + uy * wy)")
    mitre = F.struct(F.lit(0).alias("place"), (F.col("x") - d * F.coalesce(F.try_divide(F.expr("uy + wy"), c2), F.lit(0.0))).alias("px"), (F.col("y") + d * F.coalesce(F.try_divide(F.expr("ux + wx"), c2), F.lit(0.0))).alias("py"))
    return j.select("line", "seq", F.inline(F.when(outer, arc).otherwise(F.array(mitre)))).select("line", "seq", "place", F.col("px").alias("x"), F.col("py").alias("y"))


def smoothed(df: DataFrame, group: str, place: str, value: str, block: int = BLOCK) -> DataFrame:
    """group, place, value after a median of 5 and then a Gaussian of sigma 1 (radius 4), the ends repeated; groups of
    fewer than five values stay as they are. Places count 0, 1, 2, ...

    Windows over blocks of `block` places; six places on either side of a border are given to both blocks, which is as
    far as the two frames reach together.
    """
    b, p = block, F.col(place).cast("long")
    d = df.select(group, p.alias(place), F.col(value).alias("v"))
    d = d.withColumn("_b", F.explode(F.array_distinct(F.array(*[F.floor((F.col(place) + s) / b) for s in (-6, 0, 6)]))))
    w = Window.partitionBy(group, "_b").orderBy(place)

    def around(c: str, radius: int) -> list[Column]:
        """Values at -radius..radius; what lies beyond an end is the end's value."""
        before, behind = [F.col(c)], [F.col(c)]
        for k in range(1, radius + 1):
            before.append(F.coalesce(F.lag(c, k).over(w), before[-1]))
            behind.append(F.coalesce(F.lead(c, k).over(w), behind[-1]))
        return [*before[:0:-1], *behind]

    d = d.withColumns({"_m": F.element_at(F.array_sort(F.array(*around("v", 2))), 3), "_n": F.count("*").over(Window.partitionBy(group, "_b"))})
    weights = [math.exp(-k * k / 2) for k in range(-4, 5)]
    total = sum(x * F.lit(g / sum(weights)) for x, g in zip(around("_m", 4), weights))
    d = d.withColumn("_g", total).where(F.floor(F.col(place) / b) == F.col("_b"))
    return d.select(group, place, F.when((F.col("_b") == 0) & (F.col("_n") < 5), F.col("v")).otherwise(F.col("_g")).alias(value))


def continuous(candidates: DataFrame, group: str, place: str, position: str, most: float = 60.0, weight: float = 0.08, jump: float = 80.0, search: float = 250.0) -> DataFrame:
    """group, place, position: one candidate per place by a fold along the places.

    Candidates outside [-search, most] are no choice where the place has one inside. The first place takes the one
    nearest to zero; each later one the candidate that least differs from the previous choice, plus `weight` times its
    distance from zero (equal scores: the smaller position); a place whose choice would jump more than `jump` is
    skipped. Null groups, places and positions are left out. The fold goes from place to place, so a group is streamed
    through one task, in order; only the candidates of the place at hand and the last choice are held.
    """
    c = candidates.select(F.col(group).alias("g"), F.col(place).cast("long").alias("i"), F.col(position).cast("double").alias("p")).where("g IS NOT NULL AND i IS NOT NULL AND p IS NOT NULL").distinct()
    kind = c.schema["g"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, prev = None, [], None

        def choose() -> float | None:
            inside = [p for p in held if -search <= p <= most] or held
            best = min(inside, key=lambda p: (abs(p) if prev is None else abs(p - prev) + weight * abs(p), p))
            return best if prev is None or abs(best - prev) <= jump else None

        for b in batches:
            out: list[tuple] = []
            for g, i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if here is not None and here != (g, i):
                    if (got := choose()) is not None:
                        out.append((*here, got))
                        prev = got
                    held = []
                    if here[0] != g:
                        prev = None
                here = (g, i)
                held.append(p)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((b.schema.field(0).type, pa.int64(), pa.float64()))], ["g", "i", "p"])
        if here is not None and (got := choose()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here[0]], b.schema.field(0).type), pa.array([here[1]], pa.int64()), pa.array([got], pa.float64())], ["g", "i", "p"])

    ready = c.repartition("g").sortWithinPartitions("g", "i", "p")
    return ready.mapInArrow(fold, f"g {kind}, i long, p double").select(F.col("g").alias(group), F.col("i").alias(place), F.col("p").alias(position))


def clipped_segments(s: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """The parts of segments (..., x1, y1, x2, y2) inside a rectangle (Liang-Barsky); segments outside give no rows."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = [(-dx, F.col("x1") - x0), (dx, x1 - F.col("x1")), (-dy, F.col("y1") - y0), (dy, y1 - F.col("y1"))]
    t0 = F.greatest(F.lit(0.0), *[F.when(p < 0, F.try_divide(q, p)).otherwise(0.0) for p, q in sides])
    t1 = F.least(F.lit(1.0), *[F.when(p > 0, F.try_divide(q, p)).otherwise(1.0) for p, q in sides])
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))
    d = s.withColumns({"_t0": t0, "_t1": t1, "_o": outside}).where(~F.col("_o") & (F.col("_t0") <= F.col("_t1")))
    at = lambda c, t: F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1"))
    return d.withColumns({"_a": at("x", "_t0"), "_b": at("y", "_t0"), "_c": at("x", "_t1"), "_d": at("y", "_t1")}).withColumns({"x1": F.col("_a"), "y1": F.col("_b"), "x2": F.col("_c"), "y2": F.col("_d")}).select(*s.columns)


def surroundings(v: DataFrame, reach: float) -> DataFrame:
    """line, x0, y0, x1, y1: the box around each line with `reach` metres (100 to 2000) on every side."""
    if not 100 <= reach <= 2000:
        raise ValueError("reach must lie in [100, 2000]")
    return v.groupBy("line").agg((F.min("x") - reach).alias("x0"), (F.min("y") - reach).alias("y0"), (F.max("x") + reach).alias("x1"), (F.max("y") + reach).alias("y1"))
