"""Retreat scenarios on a reference line: signed margins, bands, station networks and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorespark.functions.geo import point_segment_distance
from shorespark.operators import lines
from shorespark.operators.exposure import by_limits
from shorespark.operators.spatial import nearest_lines

TILE = 256  #: cells of a tile's side in `band_areas`


def retreat(year: Column, rate: Column, base: int) -> Column:
    """Metres of retreat since the base year; never negative."""
    return F.greatest(F.lit(0), year - base) * rate


def margins(points: DataFrame, segs: DataFrame, retreat_m: Column) -> DataFrame:
    """points (point, x, y, ...) with line (the nearest), chainage_m (the place along it), distance_m, side (1 to its left, -1 to its right, 0 on it),
    retreat_m, margin_m (distance less retreat) and reached (not to the right and within the retreat).

    The nearest segment comes from the spatial search; its neighbours are looked at too, as at a shared vertex the
    segment that is more across the view decides the side. `point` must be unique; null coordinates are left out.
    """
    s = segs.select(F.concat_ws("\x1e", "seq", "line").alias("id"), F.col("line").alias("l"), "seq", "x1", "y1", "x2", "y2", "len", "cum")
    near = nearest_lines(points.select(F.col("point").cast("string").alias("point"), F.col("x").alias("px"), F.col("y").alias("py")), s.withColumnRenamed("id", "line"))
    bits = F.split("line", "\x1e", 2)
    tries = near.select("point", "px", "py", bits[1].alias("l"), F.explode(F.array(*[bits[0].cast("long") + k for k in (-1, 0, 1)])).alias("seq"))
    j = tries.join(s.drop("id"), ["l", "seq"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = point_segment_distance(*[F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")])
    cross = dx * (F.col("py") - F.col("y1")) - dy * (F.col("px") - F.col("x1"))
    along = F.col("cum") + F.greatest(F.lit(0.0), F.least(F.col("len"), F.coalesce(F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, F.col("len")), F.lit(0.0))))
    best = j.groupBy("point").agg(F.min(F.struct(F.round(d, 6).alias("r"), (-F.abs(F.coalesce(F.try_divide(cross, F.hypot(dx, dy)), F.lit(0.0)))).alias("o"), "seq", F.signum(cross).alias("side"), d.alias("d"), F.col("l").alias("line"), along.alias("along"))).alias("b"))
    out = points.withColumn("point", F.col("point").cast("string")).join(best, "point").withColumns({"line": F.col("b.line"), "chainage_m": F.col("b.along"), "distance_m": F.col("b.d"), "side": F.col("b.side")}).drop("b")
    out = out.withColumn("retreat_m", retreat_m)
    return out.withColumns({"margin_m": F.col("distance_m") - F.col("retreat_m"), "reached": (F.col("side") >= 0) & (F.col("distance_m") <= F.col("retreat_m"))})


def band_areas(v: DataFrame, bounds: dict[str, tuple[float, float]], cell: float = 2.0) -> DataFrame:
    """line, band, area_m2: areas to the left of each line between two distances, by cells whose centres are judged by
    their signed distance; cells beyond the line's ends are left out. Cells are judged along each segment only as far
    as the widest band, and kept with their nearest segment.

    Only segments are shuffled, once for every tile of TILE x TILE cells that they reach. A tile's segments come in order
    and leave their mark on its cells, so a task holds one tile, and a row per tile and band goes on.
    """
    far = max(b for _, b in bounds.values())
    s = lines.segments(v).where("NOT isnan(x1 + y1 + x2 + y2)")
    low = lambda c: F.floor((F.least(f"{c}1", f"{c}2") - far) / cell)
    high = lambda c: F.ceil((F.greatest(f"{c}1", f"{c}2") + far) / cell)
    s = s.select("line", "seq", "x1", "y1", "x2", "y2", "len", "last", low("x").alias("i0"), high("x").alias("i1"), low("y").alias("j0"), high("y").alias("j1"))
    for t, c in (("ti", "i"), ("tj", "j")):
        s = s.withColumn(t, F.explode(F.sequence(F.floor(F.col(f"{c}0") / TILE), F.floor(F.col(f"{c}1") / TILE))))

    def counted(best: np.ndarray, mark: np.ndarray) -> list[tuple[str, int]]:
        d, out = best[mark], []
        left = np.ones(len(d), bool)
        for name, (a, b) in bounds.items():
            hit = left & (d > a if a > 0 else True) & (d <= b)
            left &= ~hit
            out.append((name, int(hit.sum())))
        return [x for x in out if x[1]]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kind = None, None
        best, across, mark = np.empty((TILE, TILE)), np.empty((TILE, TILE)), np.empty((TILE, TILE), bool)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.string(), pa.int64()))], ["line", "band", "n"])
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for line, seq, x1, y1, x2, y2, length, last, i0, i1, j0, j1, ti, tj in zip(*(c.to_pylist() for c in batch.columns)):
                if here != (line, ti, tj):
                    out += [(here[0], *r) for r in counted(best, mark)] if here else []
                    here = line, ti, tj
                    best.fill(np.inf)
                    across.fill(np.inf)
                    mark.fill(False)
                i0, i1, j0, j1 = max(i0, ti * TILE), min(i1, ti * TILE + TILE - 1), max(j0, tj * TILE), min(j1, tj * TILE + TILE - 1)
                px, py = (np.arange(i0, i1 + 1)[:, None] + 0.5) * cell, (np.arange(j0, j1 + 1)[None, :] + 0.5) * cell
                dx, dy = x2 - x1, y2 - y1
                square = dx * dx + dy * dy
                raw = ((px - x1) * dx + (py - y1) * dy) / square if square else np.zeros((i1 - i0 + 1, j1 - j0 + 1))
                t = np.clip(raw, 0.0, 1.0)
                d = np.round(np.hypot(px - x1 - t * dx, py - y1 - t * dy), 9)
                cross = dx * (py - y1) - dy * (px - x1)
                o = -np.abs(cross / length) if length else np.full(d.shape, -np.inf)
                at = np.s_[i0 - ti * TILE : i1 + 1 - ti * TILE, j0 - tj * TILE : j1 + 1 - tj * TILE]
                mine = (d <= far) & ((d < best[at]) | ((d == best[at]) & (o < across[at])))
                keep = cross > 0
                if seq == 0:
                    keep &= raw >= 0
                if seq == last:
                    keep &= raw <= 1
                best[at], across[at], mark[at] = np.where(mine, d, best[at]), np.where(mine, o, across[at]), np.where(mine, keep, mark[at])
            if out:
                yield made(out)
        if here and (out := [(here[0], *r) for r in counted(best, mark)]):
            yield made(out)

    tiles = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    ready = s.repartition(tiles, "line", "ti", "tj").sortWithinPartitions("line", "ti", "tj", "seq")
    n = ready.mapInArrow(judge, f"line {s.schema['line'].dataType.simpleString()}, band string, n long")
    return n.groupBy("line", "band").agg((F.sum("n") * cell * cell).alias("area_m2"))


def _stations(segs: DataFrame, count: int) -> DataFrame:
    """`count` points at equal distances along each line with the line's direction there."""
    window = F.least(F.lit(8.0), F.greatest(F.lit(2.0), F.col("length") / 500))
    return lines.at_steps(segs, F.col("length") / (count - 1), F.lit(count - 1), window=window)


def stations(v: DataFrame, count: int = 11, first: float = -50.0, last: float = 260.0, offsets: tuple[float, ...] = (50.0, 150.0, 250.0)) -> DataFrame:
    """line, station, offset_m, x, y: `count` stations at equal distances along each line with the ends of their cross
    lines and their samples, offsets counted to the left of the line."""
    segs = lines.segments(v)
    o = F.explode(F.array(*[F.lit(float(x)) for x in (first, *offsets, last)]))
    j = _stations(segs, count).withColumn("offset_m", o)
    return j.select("line", F.format_string("E%02d", F.col("k") + 1).alias("station"), "offset_m", (F.col("x") - F.col("ty") * F.col("offset_m")).alias("x"), (F.col("y") + F.col("tx") * F.col("offset_m")).alias("y"))


def profile(samples: DataFrame, station: str, offset: str, value: str, offsets: tuple[int, ...] = (50, 150, 250)) -> DataFrame:
    """station, elevation at each offset (mean of its surveys, null if none) and the slope in per cent between the
    first and the last offset, null unless both are known."""
    g = samples.groupBy(station).agg(*[F.avg(F.when(F.col(offset) == o, F.col(value))).alias(f"elevation_{o}_m") for o in offsets])
    a, b = offsets[0], offsets[-1]
    return g.withColumn("slope_pct", (F.col(f"elevation_{b}_m") - F.col(f"elevation_{a}_m")) / (b - a) * 100)


def rectangles(v: DataFrame, stations_count: int, offsets: tuple[float, ...], width: float, depth: float) -> DataFrame:
    """line, station, offset_m, xs, ys: rectangles along the line's direction, their centres at the offsets to its left."""
    segs = lines.segments(v)
    j = _stations(segs, stations_count).withColumn("offset_m", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    w, h = width / 2, depth / 2
    corner = [(-w, -h), (w, -h), (w, h), (-w, h)]
    xs = F.array(*[F.col("x") - F.col("ty") * (F.col("offset_m") + b) + F.col("tx") * a for a, b in corner])
    ys = F.array(*[F.col("y") + F.col("tx") * (F.col("offset_m") + b) + F.col("ty") * a for a, b in corner])
    return j.select("line", F.format_string("E%02d", F.col("k") + 1).alias("station"), "offset_m", xs.alias("xs"), ys.alias("ys"))


def nearest_station(points: DataFrame, network: DataFrame) -> DataFrame:
    """point, line, station, offset_m and distance_m of the sample of a station network (line, station, offset_m, x, y)
    nearest to each point (point, x, y); equally near samples: the smaller name."""
    name = F.concat_ws("\x1e", "line", "station", F.col("offset_m").cast("string"))
    dots = network.select(name.alias("line"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = nearest_lines(points.select(F.col("point").cast("string").alias("point"), F.col("x").alias("px"), F.col("y").alias("py")), dots)
    bits = F.split("line", "\x1e")
    return near.select("point", bits[0].alias("line"), bits[1].alias("station"), bits[2].cast("double").alias("offset_m"), F.col("distance").alias("distance_m"))


def evaluated(points: DataFrame, v: DataFrame, year: int, rate: float, base: int, limits: list[tuple[float, bool, str]], beyond: str, outside: float, step: int = 11) -> DataFrame:
    """points (point, x, y) with the nearest station sample, the margin of the scenario and its label: 'outside' for
    points more than `outside` metres to the sea side of the line, else by the limits of the margin."""
    m = margins(points.select("point", "x", "y"), lines.segments(v), retreat(F.lit(year), F.lit(rate), base))
    s = nearest_station(points, stations(v, step)).withColumnRenamed("distance_m", "station_distance_m").drop("line")
    label = F.when((F.col("side") < 0) & (F.col("distance_m") > outside), "outside").otherwise(by_limits(F.col("margin_m"), limits, beyond))
    return m.join(s, "point").withColumn("label", label)
