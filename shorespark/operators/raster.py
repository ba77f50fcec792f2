"""Raster operators on long pixel tables (scene, row, col, bands): no scene is ever gathered, only tiles of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorespark.operators.spatial import in_regions
from shorespark.session import materialised

# Scene classes that are no clear surface (no data, defects, cloud shadow, clouds, cirrus, snow).
UNCLEAR = (0, 1, 3, 8, 9, 10, 11)
TILE = 256  #: cells of a tile's side


def valid_pixel(green: Column, nir: Column, scl: Column | None = None) -> Column:
    """Both bands present and positive and, where a scene class is given, the class clear and not null."""
    ok = (green > 0) & (nir > 0)
    return F.coalesce(ok if scl is None else ok & ~scl.isin(*UNCLEAR), F.lit(False))


def ndwi(green: Column, nir: Column, valid: Column) -> Column:
    """(green - nir) / (green + nir) in single precision; null where not valid or the sum is 0."""
    g, n = green.cast("float"), nir.cast("float")
    return F.when(valid, F.try_divide((g - n).cast("float"), (g + n).cast("float")))


def water(index: Column, threshold: float = 0.0) -> Column:
    """True where the index is above the threshold (-1..1), false where it is not, is null or is NaN."""
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must lie in [-1, 1]")
    return F.coalesce((index > threshold) & ~F.isnan(index), F.lit(False))


def zonal(df: DataFrame, zone: list[str], value: str) -> DataFrame:
    """Least, mean, greatest value, population deviation and count per zone; null and NaN are no data."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*zone).agg(F.min(v).alias("v_min"), F.avg(v).alias("v_mean"), F.max(v).alias("v_max"), F.stddev_pop(v).alias("v_std"), F.count(v).alias("n"))


def majority(masks: DataFrame, cell: list[str], scene: str, mask: str) -> DataFrame:
    """cell, votes, n_scenes and the strict majority (votes >= n div 2 + 1) per cell; a null vote is a no."""
    n = F.countDistinct(scene)
    yes = F.sum(F.when(F.col(mask), 1).otherwise(0))
    return masks.groupBy(*cell).agg(yes.alias("votes"), n.alias("n_scenes")).withColumn("water", F.col("votes") >= F.floor(F.col("n_scenes") / 2) + 1)


def _by_tile(cells: DataFrame, key: str, halo: int, work: Callable, ddl: str) -> DataFrame:
    """Rows (key, row, col, ...) that work(planes, row, col) makes of each tile of TILE x TILE cells with `halo` cells around.

    cells: (key, row, col, plane). A tile is two planes of bits, 1 for the cells that are there, whose corner lies at
    (row, col); a task holds one tile at a time, whatever the scene. work gives arrays for `ddl`, int64 all of them.
    Cells with a null are left out, repeated ones count once.
    """
    kind, side = cells.schema[key].dataType.simpleString(), TILE + 2 * halo
    c = cells.select(F.col(key).alias("g"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("plane").cast("int").alias("plane")).where("g IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")
    for t, v in (("tr", "row"), ("tc", "col")):
        near = F.sequence(F.floor((F.col(v) - halo) / TILE), F.floor((F.col(v) + halo) / TILE))
        c = c.withColumn(t, F.explode(near) if halo else F.floor(F.col(v) / TILE))
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, schema = None, None
        planes = np.zeros((2, side, side), bool)

        def made() -> Iterator[pa.RecordBatch]:
            columns = work(planes, here[1] * TILE - halo, here[2] * TILE - halo)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(here[0], schema.field(0).type), len(columns[0])), *(pa.array(x, pa.int64()) for x in columns)], ["g", *names])

        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            row, col, plane, tr, tc = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            g = b.column(0)
            new = (np.diff(tr) != 0) | (np.diff(tc) != 0) | pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(new) + 1, len(row)]
            for i, j in zip(starts, starts[1:]):
                at = (g[int(i)].as_py(), int(tr[i]), int(tc[i]))
                if here != at:
                    if here is not None:
                        yield from made()
                    here = at
                    planes.fill(False)
                planes[plane[i:j], row[i:j] - at[1] * TILE + halo, col[i:j] - at[2] * TILE + halo] = True
        if here is not None:
            yield from made()

    ready = c.repartition("g", "tr", "tc").sortWithinPartitions("g", "tr", "tc")
    return ready.mapInArrow(run, f"g {kind}, {ddl}").withColumnRenamed("g", key)


def _around(m: np.ndarray, every: bool) -> np.ndarray:
    """The cells all of whose 3 x 3 surroundings are set, or any of them; what lies outside is not set."""
    p = np.pad(m, 1)
    join = np.logical_and if every else np.logical_or
    p = join(join(p[:-2], p[1:-1]), p[2:])
    return join(join(p[:, :-2], p[:, 1:-1]), p[:, 2:])


def opened_closed(mask: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Set cells (key, row, col) after a binary opening and closing with a 3 x 3 square on the cells of `grid`.

    Erosion and dilation treat what lies outside the grid as not set. One shuffle by tiles, which know the four cells
    around them that their result depends on; repeated cells count once.
    """

    def work(planes: np.ndarray, row: int, col: int) -> list[np.ndarray]:
        m, inside = planes
        for every in (True, False, False, True):
            m = _around(m, every) & inside
        r, c = np.nonzero(m[4:-4, 4:-4])
        return [r + row + 4, c + col + 4]

    both = mask.select(key, "row", "col", F.lit(0).alias("plane")).unionByName(grid.select(key, "row", "col", F.lit(1).alias("plane")))
    return _by_tile(both, key, 4, work, "row long, col long")


def _labels(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and the number (among these cells, by row and column) of the first cell of its 4-connected component of
    every set cell. The runs of set cells in a row take the least name of the runs they touch until nothing changes."""
    r, c = np.nonzero(m)
    first = np.r_[True, (np.diff(r) != 0) | (np.diff(c) != 1)][: len(r)]
    run = np.zeros(m.shape, int)
    run[r, c] = np.cumsum(first) - 1
    both = m[1:] & m[:-1]
    a, b = run[:-1][both], run[1:][both]
    name = np.arange(int(first.sum()))
    while True:
        new = name.copy()
        np.minimum.at(new, a, name[b])
        np.minimum.at(new, b, name[a])
        np.minimum.at(new, name, new.copy())  # the run a run is named after hears of it
        new = new[new]
        if (new == name).all():
            return r, c, np.flatnonzero(first)[name][run[r, c]]
        name = new


def components(mask: DataFrame, key: str) -> DataFrame:
    """key, row, col, component of the set cells: 4-connected components named by their least cell code.

    Components are found in tiles first, named by their first cell; only those that touch others over the border of
    tiles go on. Every round each takes the least name among its own and its neighbours', then the name of the one it
    is named after, until nothing changes; that jump keeps the rounds far below a component's length. Lineage is cut by
    reliable checkpoints. An empty mask gives no rows; repeated cells count once.
    """

    def work(planes: np.ndarray, row: int, col: int) -> list[np.ndarray]:
        r, c, at = _labels(planes[0])
        return [r + row, c + col, (r[at] + row) * 2**31 + c[at] + col]

    cells = materialised(_by_tile(mask.select(key, "row", "col", F.lit(0).alias("plane")), key, 0, work, "row long, col long, run long"))
    edges = None
    for v in ("row", "col"):
        ends = cells.where(F.pmod(F.col(v), F.lit(TILE)) == TILE - 1).withColumn(v, F.col(v) + 1)
        met = ends.join(cells.where(F.pmod(F.col(v), F.lit(TILE)) == 0).withColumnRenamed("run", "other"), [key, "row", "col"]).select(key, F.col("run").alias("a"), F.col("other").alias("b"))
        edges = met if edges is None else edges.unionByName(met)
    edges = materialised(edges.unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if edges.isEmpty():
        return cells.select(key, "row", "col", F.col("run").alias("component"))
    label = edges.select(key, F.col("a").alias("run")).distinct().withColumn("c", F.col("run"))
    while True:
        near = edges.join(label.withColumnRenamed("run", "b"), [key, "b"]).select(key, F.col("a").alias("run"), "c")
        least = label.select(key, "run", "c", F.col("c").alias("was")).unionByName(near.withColumn("was", F.lit(None).cast("long"))).groupBy(key, "run").agg(F.min("c").alias("c"), F.max("was").alias("was"))
        # pointer jumping: a component takes the name of the one it is named after
        jump = least.select(key, F.col("run").alias("c"), F.col("c").alias("up"))
        new = materialised(least.join(jump, [key, "c"]).select(key, "run", F.col("up").alias("c"), "was"))
        label = new.select(key, "run", "c")
        if new.where("c <> was").isEmpty():
            break
    return cells.join(label, [key, "run"], "left").select(key, "row", "col", F.coalesce("c", "run").alias("component"))


def main_component(labelled: DataFrame, grid: DataFrame, key: str, least: int = 80) -> DataFrame:
    """Cells of the component that counts per key: the largest of those with at least `least` cells that touch the
    frame of the grid, else the largest with at least `least`; none if there is none. Ties: the smaller name."""
    frame = grid.groupBy(key).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    j = labelled.join(frame, key).withColumn("edge", F.col("row").isin(F.col("r0"), F.col("r1")) | F.col("col").isin(F.col("c0"), F.col("c1")))
    size = j.groupBy(key, "component").agg(F.count("*").alias("n"), F.max("edge").alias("edge")).where(F.col("n") >= least)
    best = size.groupBy(key).agg(F.max_by("component", F.struct("edge", "n", -F.col("component"))).alias("component"))
    return labelled.join(best, [key, "component"], "left_semi")


def outline(mask: DataFrame, key: str, size: float, frame: DataFrame | None = None) -> DataFrame:
    """Boundary sides of the set cells as segments (key, x1, y1, x2, y2), the cell (0, 0) having its corner at the
    origin and y growing with the row. With `frame` (key, r0, r1, c0, c1) sides on the grid's frame are left out."""
    sides = [(0, 0, 0, 1, -1, 0), (1, 0, 1, 1, 1, 0), (0, 0, 1, 0, 0, -1), (0, 1, 1, 1, 0, 1)]
    each = F.explode(F.array(*[F.struct((F.col("row") + a).alias("ra"), (F.col("col") + b).alias("ca"), (F.col("row") + c).alias("rb"), (F.col("col") + d).alias("cb")) for a, b, c, d, _, _ in sides]))
    s = mask.select(key, each.alias("s")).groupBy(key, "s.ra", "s.ca", "s.rb", "s.cb").count().where("count = 1")  # inner sides occur twice
    if frame is not None:
        s = s.join(frame, key).where("NOT ((ra = rb AND (ra = r0 OR ra = r1 + 1)) OR (ca = cb AND (ca = c0 OR ca = c1 + 1)))")
    return s.select(key, (F.col("ca") * size).alias("x1"), (F.col("ra") * size).alias("y1"), (F.col("cb") * size).alias("x2"), (F.col("rb") * size).alias("y2"))


def rings(mask: DataFrame, key: str, size: float) -> DataFrame:
    """key, ring, place, x1, y1, x2, y2: the boundary of the set cells as closed rings of cell sides in order; cells that
    meet at a corner only are not joined. Outer rings turn left, holes right; `ring` is the code of the ring's least
    side. Repeated cells count once; an empty mask gives no rows.

    Every side knows the next one by an equi-join on corners. Jumping over 1, 2, 4, ... sides, each round one join, finds
    a ring's least side and then each side's distance from it, so the rounds grow with the logarithm of a ring's length.
    """
    cells = materialised(mask.select(key, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct())
    sides = [(0, 0, 0, -1, 0), (0, 1, 1, 0, 1), (1, 1, 2, 1, 0), (1, 0, 3, 0, -1)]  # start corner, direction (+x, +y, -x, -y), cell across
    each = F.explode(F.array(*[F.struct((F.col("row") + a).alias("r"), (F.col("col") + b).alias("c"), F.lit(d).alias("d"), (F.col("row") + e).alias("row"), (F.col("col") + f).alias("col")) for a, b, d, e, f in sides]))
    s = cells.select(key, each.alias("s")).select(key, "s.*").join(cells, [key, "row", "col"], "left_anti").select(key, "r", "c", "d")
    s = materialised(s.withColumn("id", (F.col("r") * F.lit(2**29) + F.col("c")) * 4 + F.col("d")))
    er = F.col("r") + F.when(F.col("d") == 1, 1).when(F.col("d") == 3, -1).otherwise(0)
    ec = F.col("c") + F.when(F.col("d") == 0, 1).when(F.col("d") == 2, -1).otherwise(0)
    here = s.select(key, "id", "d", er.alias("r"), ec.alias("c"))
    turn = F.pmod(F.col("d2") - F.col("d"), F.lit(4))
    nxt = here.join(s.select(key, "r", "c", F.col("d").alias("d2"), F.col("id").alias("id2")), [key, "r", "c"]).groupBy(key, "id").agg(F.min_by("id2", F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2)).alias("jump"))
    nxt = materialised(nxt)
    low = nxt.withColumn("low", F.col("id"))
    while True:
        there = low.select(key, F.col("id").alias("jump"), F.col("low").alias("low2"), F.col("jump").alias("jump2"))
        new = materialised(low.join(there, [key, "jump"]).select(key, "id", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        low = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    head = F.col("id") == F.col("low")
    rank = nxt.join(low.select(key, "id", "low"), [key, "id"]).select(key, "id", "low", F.when(head, F.col("id")).otherwise(F.col("jump")).alias("jump"), F.when(head, 0).otherwise(1).cast("long").alias("n"))
    while True:
        there = rank.select(key, F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("n").alias("n2"))
        rank = materialised(rank.join(there, [key, "jump"]).select(key, "id", "low", F.col("jump2").alias("jump"), (F.col("n") + F.col("n2")).alias("n")))
        if rank.where("jump <> low").isEmpty():
            break
    size_of = rank.groupBy(key, "low").agg((F.max("n") + 1).alias("whole"))
    j = rank.join(size_of, [key, "low"]).withColumn("place", F.pmod(-F.col("n"), F.col("whole"))).select(key, "id", F.col("low").alias("ring"), "place")
    return j.join(s, [key, "id"]).select(key, "ring", "place", (F.col("c") * size).alias("x1"), (F.col("r") * size).alias("y1"), (ec * size).alias("x2"), (er * size).alias("y2"))


def ring_areas(sides: DataFrame, key: str) -> DataFrame:
    """key, ring, area of rings of sides (key, ring, x1..y2), positive for outer rings, negative for holes."""
    return sides.groupBy(key, "ring").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def rasterised(polygons: DataFrame, key: str, size: float, most_cells: int = 4_000_000) -> DataFrame:
    """key, row, col of the cells whose centre lies in the polygon (key, xs, ys; open or closed ring, even-odd rule).

    Rows of cells are made first, then the crossings of each row's centre line with the ring, sorted; the cells
    between the crossings of a pair follow. Polygons whose box has more than most_cells cells raise an error.
    """
    n = F.size("xs")
    box = lambda c, f: f(F.col(c)) / size
    p = polygons.select(key, "xs", "ys").where(n > 2)
    p = p.withColumn("r0", F.floor(box("ys", F.array_min))).withColumn("r1", F.floor(box("ys", F.array_max)))
    cells = (F.col("r1") - F.col("r0") + 1) * (F.floor(box("xs", F.array_max)) - F.floor(box("xs", F.array_min)) + 1)
    p = p.withColumn("r1", F.when(cells > most_cells, F.raise_error(F.lit("polygon has too many cells")).cast("long")).otherwise(F.col("r1")))
    rows = p.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("yc", (F.col("row") + 0.5) * size)
    sides = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.element_at("xs", i).alias("xa"), F.element_at("ys", i).alias("ya"),
        F.element_at("xs", i % n + 1).alias("xb"), F.element_at("ys", i % n + 1).alias("yb")))
    yc = F.col("yc")
    cross = F.filter(sides, lambda s: (s["ya"] > yc) != (s["yb"] > yc))
    xs = F.array_sort(F.transform(cross, lambda s: s["xa"] + (yc - s["ya"]) / (s["yb"] - s["ya"]) * (s["xb"] - s["xa"])))
    rows = rows.withColumn("c", xs).where(F.size("c") > 1)
    pair = F.explode(F.sequence(F.lit(1), F.size("c") - 1, F.lit(2)))
    spans = rows.select(key, "row", "c", pair.alias("i")).select(key, "row", F.ceil(F.element_at("c", F.col("i")) / size - 0.5).alias("a"), (F.ceil(F.element_at("c", F.col("i") + 1) / size - 0.5) - 1).alias("b"))
    return spans.where("a <= b").select(key, "row", F.explode(F.sequence("a", "b")).alias("col"))


def synthetic_pixels(spark, rows: int, cols: int) -> DataFrame:
    """A deterministic pixel table (row, col, green, nir) of a coast: water to one side of a wavy line."""
    g = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    shore = cols / 2 + 6 * F.sin(F.col("row") / 9)
    wet = F.col("col") < shore
    return g.select("row", "col", (F.when(wet, 0.32).otherwise(0.21) + 0.02 * F.cos(F.col("row") / 7)).cast("float").alias("green"), (F.when(wet, 0.12).otherwise(0.28) + 0.02 * F.sin(F.col("col") / 5)).cast("float").alias("nir"))


# The published sample scene: 120 x 160 pixels of 30 m, its upper left corner in UTM, and its three zones.
SAMPLE_ROWS, SAMPLE_COLS, SAMPLE_SIZE, SAMPLE_X, SAMPLE_Y = 120, 160, 30.0, 245_000.0, 6_315_000.0
SAMPLE_ZONES = (("norte", "playa"), ("centro", "urbano"), ("sur", "humedal"))


def sample_scene(spark) -> DataFrame:
    """row, col, x, y, green, nir, dem of the published sample scene; x and y are the pixels' centres, rows run southward."""
    g = spark.range(SAMPLE_ROWS * SAMPLE_COLS).select(F.floor(F.col("id") / SAMPLE_COLS).alias("row"), (F.col("id") % SAMPLE_COLS).alias("col"))
    r, c = F.col("row"), F.col("col")
    inland = c - (58 + 0.22 * r + 6 * F.sin(r / 12))
    band = lambda wet, dry: F.when(inland < 0, wet).otherwise(dry)
    return g.select(
        "row", "col", (SAMPLE_X + (c + 0.5) * SAMPLE_SIZE).alias("x"), (SAMPLE_Y - (r + 0.5) * SAMPLE_SIZE).alias("y"),
        (band(0.42, 0.18) + 0.03 * F.sin(c / 10) + 0.01 * F.cos(r / 8)).cast("float").alias("green"),
        (band(0.08, 0.46) + 0.04 * F.cos(c / 14) - 0.01 * F.sin(r / 9)).cast("float").alias("nir"),
        (F.greatest(F.lit(0.0), 5 + 1.4 * inland) + 8 * F.sin(c / 18) + 4 * F.cos(r / 16)).cast("float").alias("dem"),
    )


def sample_zones(spark) -> DataFrame:
    """zone, use, xs, ys of the sample scene's zones: its thirds from north to south, 150 m inside their borders."""
    high, wide = SAMPLE_ROWS * SAMPLE_SIZE / 3, SAMPLE_COLS * SAMPLE_SIZE
    x0, x1 = SAMPLE_X + 150, SAMPLE_X + wide - 150
    rows = [(n, u, [x0, x1, x1, x0], [y - high + 150, y - high + 150, y - 150, y - 150]) for i, (n, u) in enumerate(SAMPLE_ZONES) for y in (SAMPLE_Y - i * high,)]
    return spark.createDataFrame(rows, "zone string, use string, xs array<double>, ys array<double>")


def zonal_by_polygon(pixels: DataFrame, zones: DataFrame, zone: str, value: str) -> DataFrame:
    """zone and the statistics (see `zonal`) of the pixels (x, y of the centre, value) whose centre lies in the zone's polygon
    (zone, xs, ys; a point on the border lies inside); zones without a pixel have a count of 0."""
    p = pixels.select(F.concat_ws("\x1f", F.col(value).cast("double").cast("string"), F.monotonically_increasing_id().cast("string")).alias("point"), F.col("x").alias("px"), F.col("y").alias("py"))
    hit = in_regions(p, zones.select(F.col(zone).cast("string").alias("region"), "xs", "ys"))
    v = F.split("point", "\x1f")
    got = hit.select(F.col("region").alias("_z"), F.when(F.size(v) > 1, v[0].cast("double")).alias("v"))
    s = zonal(got, ["_z"], "v")
    return zones.select(zone).join(s, F.col(zone).cast("string") == F.col("_z"), "left").drop("_z").withColumn("n", F.coalesce("n", F.lit(0)))


def area_statistics(areas: DataFrame, keys: list[str], area: str) -> DataFrame:
    """Mean, population deviation and coefficient of variation (per cent, null for a mean of 0) of areas per key."""
    g = areas.groupBy(*keys) if keys else areas.groupBy()
    m, s = F.avg(area), F.stddev_pop(area)
    return g.agg(m.alias("mean_m2"), s.alias("std_m2"), F.try_divide(100 * s, m).alias("cv_pct"))


def consensus(masks: DataFrame, scenes: DataFrame, grid: DataFrame, key: str, scene: str, least_scenes: int = 2) -> DataFrame:
    """key, row, col of the cells that the strict majority of a key's scenes calls water, opened and closed. scenes: (key,
    scene) of every scene, dry ones too, which vote as well; keys of fewer than `least_scenes` scenes have no cells.
    masks: (key, scene, row, col) of the water cells of each scene."""
    n = scenes.groupBy(key).agg(F.countDistinct(scene).alias("n")).where(F.col("n") >= least_scenes)
    votes = masks.join(scenes.select(key, scene).distinct(), [key, scene], "left_semi").groupBy(key, "row", "col").agg(F.countDistinct(scene).alias("v")).join(n, key)
    return opened_closed(votes.where(F.col("v") >= F.floor(F.col("n") / 2) + 1), grid, key)
