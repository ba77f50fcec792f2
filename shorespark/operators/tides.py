"""Tide corrections of shorelines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorespark.functions.geo import ground_distance
from shorespark.operators import lines, polygons


def shift(height: Column, slope: Column) -> Column:
    """Horizontal shift height / slope; null unless the height is finite and 0 < slope <= 1."""
    finite = height.isNotNull() & ~F.isnan(height) & (F.abs(height) < float("inf"))
    return F.when(finite & (slope > 0) & (slope <= 1), F.try_divide(height, slope))


def sensitivity(df: DataFrame, height: str, slopes: tuple[float, ...] = (0.03, 0.08), digits: int = 3) -> DataFrame:
    """df with the shift at other slopes, rounded."""
    return df.withColumns({f"shift_{str(s).replace('.', '_')}_m": F.round(shift(F.col(height), F.lit(s)), digits) for s in slopes})


def harmonic(times: DataFrame, key: list[str], instant: str, constituents: DataFrame) -> DataFrame:
    """key and tide_height_m: the sum of amplitude x cos(speed x hours + phase) over the constituents (amplitude_m,
    speed_deg_per_hour, phase_deg), hours since 1970 UTC of `instant` in microseconds.

    The constituents become one array in one row beside each time, so the times are neither joined nor shuffled.
    Constituents with a null are left out; without any the height is 0.
    """
    c = constituents.select(F.col("amplitude_m").cast("double").alias("a"), F.col("speed_deg_per_hour").cast("double").alias("s"), F.col("phase_deg").cast("double").alias("p")).where("a + s + p IS NOT NULL")
    one = c.agg(F.sort_array(F.collect_list(F.struct("a", "s", "p"))).alias("_c"))  # one row, a few dozen constituents by nature
    hours = F.col(instant) / 3_600_000_000
    total = F.aggregate("_c", F.lit(0.0), lambda t, k: t + k["a"] * F.cos(F.radians(k["s"] * hours + k["p"])))
    return times.crossJoin(F.broadcast(one)).select(*key, total.alias("tide_height_m"))


def gridded(points: DataFrame, key: list[str], lon: str, lat: str, instant: str, grid: DataFrame, step: float, cutoff_km: float = 10.0) -> DataFrame:
    """key and tide_height_m at points (lon, lat in degrees, instant in microseconds) from a gridded model: rows (row, col,
    name, speed_deg_per_hour, amplitude_m, phase_deg) at latitude row x step and longitude col x step.

    Amplitude and phase of each constituent are interpolated as a complex number between the four surrounding nodes,
    the weights of absent ones left out; a point without any takes its nearest node within `cutoff_km`, beyond that,
    and for null places or times, the height is null. Points meet nodes by an equi-join on (row, col). `key` must be
    unique.
    """
    g = grid.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), F.col("name").alias("_n"), F.col("speed_deg_per_hour").alias("_w"), (F.col("amplitude_m") * F.cos(F.radians("phase_deg"))).alias("_re"), (F.col("amplitude_m") * F.sin(F.radians("phase_deg"))).alias("_im")).where("_re + _im + _w IS NOT NULL")
    pts = points.select(*key, F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y"), F.col(instant).alias("_t"))
    at = pts.where("_x + _y + _t IS NOT NULL").withColumns({"_i": F.floor(F.col("_y") / step), "_j": F.floor(F.col("_x") / step)})
    four = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    near = at.withColumn("_k", four).select(*key, "_t", (F.col("_i") + F.col("_k.a")).alias("_r"), (F.col("_j") + F.col("_k.b")).alias("_c"), "_x", "_y")
    near = near.withColumn("_f", (1 - F.abs(F.col("_y") / step - F.col("_r"))) * (1 - F.abs(F.col("_x") / step - F.col("_c")))).where("_f > 0")
    each = ["_n", "_w", "_f", "_re", "_im"]
    inside = near.join(g, ["_r", "_c"]).select(*key, "_t", *each)
    # the others look at the nodes as far as the cut-off reaches
    alone = at.join(inside.select(*key).distinct(), key, "left_anti")
    reach = int(math.ceil(cutoff_km / (110.5 * step))) + 1
    wide = F.least(F.lit(360.0 / step), F.ceil(reach / F.greatest(F.lit(0.01), F.cos(F.radians("_y"))))).cast("long")
    around = alone.withColumn("_r", F.explode(F.sequence(F.col("_i") - reach, F.col("_i") + reach))).withColumn("_c", F.explode(F.sequence(F.col("_j") - wide, F.col("_j") + wide)))
    far = ground_distance(F.col("_x"), F.col("_y"), F.col("_c") * step, F.col("_r") * step)
    nodes = g.select("_r", "_c").distinct()
    best = around.withColumn("_d", far).where(F.col("_d") <= cutoff_km * 1000).join(nodes, ["_r", "_c"]).groupBy(*key, "_t").agg(F.min(F.struct("_d", "_r", "_c")).alias("_b"))
    outside = best.select(*key, "_t", F.col("_b._r").alias("_r"), F.col("_b._c").alias("_c")).join(g, ["_r", "_c"]).withColumn("_f", F.lit(1.0)).select(*key, "_t", *each)
    mean = lambda c: F.sum(F.col("_f") * F.col(c)) / F.sum("_f")
    waves = inside.unionByName(outside).groupBy(*key, "_t", "_n").agg(F.first("_w").alias("_w"), mean("_re").alias("_re"), mean("_im").alias("_im"))
    turn = F.radians(F.col("_w") * F.col("_t") / 3_600_000_000)
    height = waves.groupBy(*key).agg(F.sum(F.col("_re") * F.cos(turn) - F.col("_im") * F.sin(turn)).alias("tide_height_m"))
    return points.select(*key).join(height, key, "left")


def model_check(files: DataFrame, expected: list[str]) -> DataFrame:
    """missing, unexpected and bad_header (sorted, joined by ';'), n and valid of a folder of model files (path, content as
    `binaryFile` reads them): the names without ending against the expected ones, and the eight bytes that open an HDF5
    container."""
    name = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    f = files.select(name.alias("name"), (F.hex(F.substring("content", 1, 8)) == "894844460D0A1A0A").alias("ok"))
    one = f.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("name")).alias("names"), F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("name")))).alias("bad"))
    want = F.array(*[F.lit(e.lower()) for e in sorted(expected)])
    missing, more = F.array_except(want, "names"), F.array_except("names", want)
    text = lambda a: F.array_join(a, ";")
    return one.select(text(missing).alias("missing"), text(more).alias("unexpected"), text("bad").alias("bad_header"), "n", ((F.size(missing) == 0) & (F.size("bad") == 0)).alias("valid"))


def corrected(v: DataFrame, shifts: DataFrame, water: DataFrame | None = None, land: DataFrame | None = None, probe: float = 5.0) -> DataFrame:
    """line, seq, x, y, direction_method: every vertex moved against its landward normal by its line's shift (line, shift_m).

    The normal stands on the direction from the previous to the next vertex (one-sided at the ends). The landward
    side is the one whose probe point, `probe` metres off the line, lies outside the line's water polygons (line, xs,
    ys) while the other lies inside; else that towards the land reference (line, x, y); else the vertex is not moved and has
    method 'undetermined'. Vertices that coincide with their neighbours have no normal.
    """
    here = F.struct("seq", "x", "y")
    a, b = F.coalesce("before", here), F.coalesce("after", here)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    j = lines.neighbours(v).withColumn("d", F.hypot(dx, dy)).withColumns({"nx": F.try_divide(-dy, F.col("d")), "ny": F.try_divide(dx, F.col("d"))}).drop("before", "after", "block")
    side = F.lit(None).cast("double")
    method = F.lit(None).cast("string")
    if water is not None:
        probes = j.where("nx IS NOT NULL").select("line", "seq", F.explode(F.array(F.lit(1), F.lit(-1))).alias("s"), "x", "y", "nx", "ny")
        probes = probes.select("line", "seq", "s", (F.col("x") + F.col("s") * probe * F.col("nx")).alias("qx"), (F.col("y") + F.col("s") * probe * F.col("ny")).alias("qy"))
        wet = probes.join(water, "line").groupBy("line", "seq").agg(
            F.max(F.when(F.col("s") == 1, polygons.contains(F.col("xs"), F.col("ys"), F.col("qx"), F.col("qy"))).otherwise(False)).alias("wet_left"),
            F.max(F.when(F.col("s") == -1, polygons.contains(F.col("xs"), F.col("ys"), F.col("qx"), F.col("qy"))).otherwise(False)).alias("wet_right"),
        )
        j = j.join(wet, ["line", "seq"], "left")
        clear = F.col("wet_left") != F.col("wet_right")
        side = F.when(clear, F.when(F.col("wet_right"), 1.0).otherwise(-1.0))
        method = F.when(clear, "water_polygon")
    if land is not None:
        j = j.join(land.select("line", F.col("x").alias("lx"), F.col("y").alias("ly")), "line", "left")
        towards = (F.col("lx") - F.col("x")) * F.col("nx") + (F.col("ly") - F.col("y")) * F.col("ny")
        side = F.coalesce(side, F.when(towards > 0, 1.0).when(towards < 0, -1.0))
        method = F.coalesce(method, F.when(towards != 0, "land_reference"))
    j = j.join(shifts.select("line", "shift_m"), "line").withColumns({"side": side, "m": F.coalesce(method, F.lit("undetermined"))})
    move = F.coalesce(F.col("side") * F.col("shift_m"), F.lit(0.0))
    return j.select("line", "seq", (F.col("x") - F.coalesce("nx", F.lit(0.0)) * move).alias("x"), (F.col("y") - F.coalesce("ny", F.lit(0.0)) * move).alias("y"), F.col("m").alias("direction_method"))


def methods(moved: DataFrame) -> DataFrame:
    """line and its vertices' direction methods, sorted and joined by '+'."""
    return moved.groupBy("line").agg(F.array_join(F.sort_array(F.collect_set("direction_method")), "+").alias("direction_method"))


def land_reference(v: DataFrame, distance: float = 300.0) -> DataFrame:
    """line, x, y: the point `distance` to the left of each line's middle."""
    window = F.least(F.lit(10.0), F.greatest(F.lit(0.5), F.col("length") / 10_000))
    at = lines.at_steps(lines.segments(v), F.col("length") / 2, F.lit(1), window=window).where("k = 1")
    return at.select("line", (F.col("x") - F.col("ty") * distance).alias("x"), (F.col("y") + F.col("tx") * distance).alias("y"))
