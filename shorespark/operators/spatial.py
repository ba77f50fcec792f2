"""Points in regions, points near points and the nearest line, through triangles and bounding-volume hierarchies.

Polygons are triangulated by ear clipping. A hierarchy of boxes over a bounded sample splits the plane; every
triangle goes to the leaves it touches, every point to its one leaf. Inside a leaf a hierarchy over its triangles
yields the candidates, which are tested exactly; a point on a boundary that several triangles of one region share is
assigned to the region once. Nearness is containment in regions around the points or lines, followed by a distance;
what no region settles descends the hierarchies to its nearest line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorespark.functions.geo import ground_distance, point_segment_distance, same_longitude
from shorespark.session import written

SAMPLE = 50_000  #: most boxes that the upper hierarchy is built from
LEAVES = 4096  #: most leaves of the upper hierarchy
LEAF_ROWS = 4000  #: rows a leaf aims at
BLOCK = 200_000  #: rows of either side that one task joins at a time


def ear_clip(xs: list[float], ys: list[float]) -> list[tuple[int, int, int]]:
    """Triangles (vertex numbers) of a simple polygon, closed or not, of either orientation. Fewer than three corners
    or no area give none; vertices on a straight side are skipped."""
    n = len(xs)
    if n > 1 and xs[0] == xs[-1] and ys[0] == ys[-1]:
        n -= 1
    area = sum(xs[i] * ys[(i + 1) % n] - xs[(i + 1) % n] * ys[i] for i in range(n)) if n > 2 else 0.0
    if area == 0 or area != area:
        return []
    left = list(range(n)) if area > 0 else list(range(n - 1, -1, -1))
    out = []

    def cross(a: int, b: int, c: int) -> float:
        return (xs[b] - xs[a]) * (ys[c] - ys[a]) - (ys[b] - ys[a]) * (xs[c] - xs[a])

    while len(left) > 3:
        m = len(left)
        for i in range(m):
            a, b, c = left[i - 1], left[i], left[(i + 1) % m]
            turn = cross(a, b, c)
            if turn == 0:
                left.pop(i)
                break
            if turn > 0 and not any(
                cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0
                for p in left
                if p not in (a, b, c) and (xs[p], ys[p]) not in ((xs[a], ys[a]), (xs[b], ys[b]), (xs[c], ys[c]))
            ):
                out.append((a, b, c))
                left.pop(i)
                break
        else:  # not simple: cut the sharpest corner, so that the loop ends
            i = max(range(m), key=lambda i: cross(left[i - 1], left[i], left[(i + 1) % m]))
            out.append((left[i - 1], left[i], left[(i + 1) % m]))
            left.pop(i)
    if len(left) == 3 and cross(*left) != 0:
        out.append(tuple(left))
    return out


_TRI = "region string, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"


def triangles(polygons: DataFrame) -> DataFrame:
    """region and corner coordinates of the triangles of polygons (region, xs, ys)."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r, xs, ys in zip(pdf["region"], pdf["xs"], pdf["ys"]):
                xs, ys = xs.tolist(), ys.tolist()
                rows += [(r, xs[a], ys[a], xs[b], ys[b], xs[c], ys[c]) for a, b, c in ear_clip(xs, ys)]
            if rows:
                yield pd.DataFrame(rows, columns=["region", "x1", "y1", "x2", "y2", "x3", "y3"])

    return polygons.select("region", "xs", "ys").mapInPandas(cut, _TRI)


class SplitTree:
    """The upper hierarchy: nested boxes given by their splitting lines; its leaves cover the whole plane."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaves: int):
        self.axis, self.at, self.child, self.leaf = [], [], [], []
        self.size = 0
        self._grow(np.asarray(x, float), np.asarray(y, float), max(1, leaves))
        self.axis, self.at = np.array(self.axis), np.array(self.at)
        self.child, self.leaf = np.array(self.child).reshape(-1, 2), np.array(self.leaf)

    def _grow(self, x: np.ndarray, y: np.ndarray, leaves: int) -> int:
        me = len(self.axis)
        self.axis.append(0)
        self.at.append(0.0)
        self.child.append((-1, -1))
        self.leaf.append(-1)
        if leaves > 1 and len(x) > 1:
            wide = 0 if np.ptp(x) >= np.ptp(y) else 1
            v = (x, y)[wide]
            at = float(np.median(v))
            low = v < at
            if low.any() and not low.all():
                self.axis[me], self.at[me] = wide, at
                self.child[me] = (self._grow(x[low], y[low], leaves // 2), self._grow(x[~low], y[~low], leaves - leaves // 2))
                return me
        self.leaf[me] = self.size
        self.size += 1
        return me

    def touched(self, x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row's box touches; a point touches exactly one."""
        row, node = np.arange(len(x0)), np.zeros(len(x0), int)
        rows, leaves = [], []
        while len(row):
            end = self.leaf[node] >= 0
            rows.append(row[end])
            leaves.append(self.leaf[node[end]])
            row, node = row[~end], node[~end]
            lo = np.where(self.axis[node] == 0, x0[row], y0[row])
            hi = np.where(self.axis[node] == 0, x1[row], y1[row])
            a, b = lo < self.at[node], hi >= self.at[node]
            row, node = np.r_[row[a], row[b]], np.r_[self.child[node[a], 0], self.child[node[b], 1]]
        return np.concatenate(rows), np.concatenate(leaves)


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of 16-bit numbers moved apart, for Morton codes."""
    v = v.astype(np.uint64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


class TriangleTree:
    """A leaf's hierarchy: triangles in Morton order, boxes of eight joined pairwise up to the root."""

    def __init__(self, tri: np.ndarray, width: int = 8):
        lo, hi = tri.reshape(-1, 3, 2).min(1), tri.reshape(-1, 3, 2).max(1)
        mid = (lo + hi) / 2
        span = np.maximum(np.ptp(mid, axis=0), 1e-300)
        cell = np.minimum(65535, (mid - mid.min(0)) / span * 65535)
        self.order = np.argsort(_spread(cell[:, 0]) | (_spread(cell[:, 1]) << np.uint64(1)), kind="stable")
        n = len(tri)
        leaves = 1 << max(0, int(np.ceil(np.log2(max(1, -(-n // width))))))
        self.width, self.tri = width, tri[self.order]
        blo, bhi = np.full((leaves * width, 2), np.inf), np.full((leaves * width, 2), -np.inf)
        blo[:n], bhi[:n] = lo[self.order], hi[self.order]
        level = [(blo.reshape(leaves, width, 2).min(1), bhi.reshape(leaves, width, 2).max(1))]
        while len(level[0][0]) > 1:
            a, b = level[0]
            level.insert(0, (a.reshape(-1, 2, 2).min(1), b.reshape(-1, 2, 2).max(1)))
        self.level = level

    def holding(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point number, triangle number) of all closed triangles that hold a point."""
        q, node = np.arange(len(p)), np.zeros(len(p), int)
        for i, (lo, hi) in enumerate(self.level):
            if i:
                q, node = np.repeat(q, 2), (np.repeat(node * 2, 2) + np.tile([0, 1], len(node)))
            keep = ((p[q] >= lo[node]) & (p[q] <= hi[node])).all(1)
            q, node = q[keep], node[keep]
        t = (np.repeat(node * self.width, self.width) + np.tile(np.arange(self.width), len(node)))
        q = np.repeat(q, self.width)
        real = t < len(self.tri)
        q, t = q[real], t[real]
        x, y = p[q, 0], p[q, 1]
        ax, ay, bx, by, cx, cy = self.tri[t].T
        d1 = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        d2 = (cx - bx) * (y - by) - (cy - by) * (x - bx)
        d3 = (ax - cx) * (y - cy) - (ay - cy) * (x - cx)
        inside = ~(((d1 < 0) | (d2 < 0) | (d3 < 0)) & ((d1 > 0) | (d2 > 0) | (d3 > 0)))
        return q[inside], self.order[t[inside]]


def _blocks(counts: np.ndarray, share: float) -> np.ndarray:
    return np.maximum(1, np.ceil(counts / max(share, 1e-12) / BLOCK)).astype(int)


def in_regions(points: DataFrame, polygons: DataFrame, best: Callable | None = None) -> DataFrame:
    """point, px, py, region of every point (point, px, py) in every closed polygon (region, xs, ys) that holds it, once.

    Points or polygons with null or non-finite coordinates and polygons without area hold nothing; copies of a point
    under another id are points of their own. The upper hierarchy comes from a sample of at most about SAMPLE boxes
    and only steers where rows go: every row is joined, whatever the sample. Leaves that the sample shows to be
    crowded are joined in blocks of either side, so no leaf is gathered in one task. `best` (places of the pairs' points,
    pairs' region numbers, region names -> which pairs stay) may thin out the pairs of a block before they are sent on.
    """
    pts = points.select("point", "px", "py").where("px BETWEEN -1e300 AND 1e300 AND py BETWEEN -1e300 AND 1e300")
    ends = {"x0": F.array_min("xs"), "y0": F.array_min("ys"), "x1": F.array_max("xs"), "y1": F.array_max("ys"), "w": (F.size("xs") - 2).cast("double")}
    box = polygons.where(F.size("xs") > 2).select(F.lit(0).alias("side"), *[e.alias(c) for c, e in ends.items()])
    both_sides = box.unionByName(pts.select(F.lit(1).alias("side"), F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"), F.lit(1.0).alias("w")))
    n = {r["side"]: r["count"] for r in both_sides.groupBy("side").count().collect()}
    n_box, n_pts = n.get(0, 0), n.get(1, 0)
    share_box, share_pts = min(1.0, SAMPLE / max(1, n_box)), min(1.0, SAMPLE / max(1, n_pts))
    both = both_sides.sampleBy("side", {0: share_box, 1: share_pts}, seed=7).toPandas().dropna()
    boxes, some = both[both["side"] == 0], both[both["side"] == 1]
    tree = SplitTree((both["x0"] / 2 + both["x1"] / 2).to_numpy(), (both["y0"] / 2 + both["y1"] / 2).to_numpy(), min(LEAVES, 1 + (n_box + n_pts) // LEAF_ROWS))

    def count(d: pd.DataFrame) -> np.ndarray:
        if not len(d):
            return np.zeros(tree.size)
        row, leaf = tree.touched(*(d[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1")))
        return np.bincount(leaf, d["w"].to_numpy()[row], minlength=tree.size)

    cut_p, cut_t = _blocks(count(some), share_pts), _blocks(count(boxes), share_box)

    def place_points(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for part in parts if len(part)):
            x, y = pdf["px"].to_numpy(), pdf["py"].to_numpy()
            row, leaf = tree.touched(x, y, x, y)
            again = cut_t[leaf]
            mine = np.arange(len(row)) % cut_p[leaf]
            r = np.repeat(np.arange(len(row)), again)
            t = np.arange(len(r)) - np.repeat(np.cumsum(again) - again, again)
            yield pdf.astype({"point": object}).iloc[row[r]].assign(leaf=leaf[r], a=mine[r], b=t)

    def place_triangles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for part in parts if len(part)):
            c = pdf[["x1", "y1", "x2", "y2", "x3", "y3"]].to_numpy()
            xs, ys = c[:, ::2], c[:, 1::2]
            row, leaf = tree.touched(xs.min(1), ys.min(1), xs.max(1), ys.max(1))
            again = cut_p[leaf]
            mine = np.arange(len(row)) % cut_t[leaf]
            r = np.repeat(np.arange(len(row)), again)
            t = np.arange(len(r)) - np.repeat(np.cumsum(again) - again, again)
            yield pdf.astype({"region": object}).iloc[row[r]].assign(leaf=leaf[r], a=t, b=mine[r])

    def join(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(t):
            return pd.DataFrame({"point": pd.Series(dtype=object), "px": pd.Series(dtype=float), "py": pd.Series(dtype=float), "region": pd.Series(dtype=object)})
        lower = TriangleTree(t[["x1", "y1", "x2", "y2", "x3", "y3"]].to_numpy())
        xy = p[["px", "py"]].to_numpy()
        code, names = pd.factorize(t["region"].to_numpy(dtype=object))
        found = []
        for i in range(0, len(p), 4096):
            q, tri = lower.holding(xy[i : i + 4096])
            found.append(np.unique((q + i).astype(np.int64) * len(names) + code[tri]))
        at, region = np.divmod(np.concatenate(found), len(names))
        if best is not None and len(at):
            stay = best(xy[at], at, region, names)
            at, region = at[stay], region[stay]
        # plain object columns: strings held in several chunks cannot be sent back
        return pd.DataFrame({"point": pd.Series(p["point"].to_numpy(dtype=object)[at], dtype=object), "px": xy[at, 0], "py": xy[at, 1], "region": pd.Series(names[region], dtype=object)})

    left = pts.mapInPandas(place_points, "point string, px double, py double, leaf int, a int, b int")
    right = triangles(polygons.where(F.size("xs") > 2)).mapInPandas(place_triangles, _TRI + ", leaf int, a int, b int")
    pairs = left.groupBy("leaf", "a", "b").cogroup(right.groupBy("leaf", "a", "b")).applyInPandas(join, "point string, px double, py double, region string")
    # triangles of one region may lie in several blocks of a leaf: one assignment is kept
    return pairs.distinct()


def near_pairs(points: DataFrame, key: str, lon: str, lat: str, metres: float) -> DataFrame:
    """key_a < key_b and distance_m of all pairs of points less than `metres` apart on the ground.

    Rows with a null key or position are left out; longitudes may follow any convention; rows at one place pair with
    each other; keys given twice count once per place. Each point gets a square that holds its circle; points found in
    the square are then measured exactly.
    """
    p = points.select(F.col(key).cast("string").alias("point"), same_longitude(F.col(lon)).alias("px"), F.col(lat).alias("py"))
    p = written(p.where("point IS NOT NULL AND px IS NOT NULL AND py BETWEEN -90 AND 90").distinct(), "places")  # read as points and as squares
    dy = metres / 110_500.0
    dx = F.least(F.lit(360.0), dy / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.lit(90.0), F.abs("py") + dy)))))
    sides = p.withColumn("dx", dx)
    # squares over the date line are given again on its other side
    shifts = F.array_compact(F.array(F.lit(0.0), F.when(F.col("px") - F.col("dx") < -180, 360.0), F.when(F.col("px") + F.col("dx") >= 180, -360.0)))
    sides = sides.withColumn("shift", F.explode(shifts)).withColumn("x", F.col("px") + F.col("shift"))
    x0, x1, y0, y1 = F.col("x") - F.col("dx"), F.col("x") + F.col("dx"), F.col("py") - dy, F.col("py") + dy
    name = F.concat_ws("\x1f", "px", "py", "point")
    squares = sides.select(name.alias("region"), F.array(x0, x1, x1, x0).alias("xs"), F.array(y0, y0, y1, y1).alias("ys"))
    got = in_regions(p, squares)
    bits = F.split("region", "\x1f", 3)
    pairs = got.select(F.col("point").alias("key_a"), "px", "py", bits[2].alias("key_b"), bits[0].cast("double").alias("qx"), bits[1].cast("double").alias("qy")).where("key_a < key_b")
    far = pairs.withColumn("distance_m", ground_distance(F.col("px"), F.col("py"), F.col("qx"), F.col("qy")))
    return far.where(F.col("distance_m") < metres).groupBy("key_a", "key_b").agg(F.min("distance_m").alias("distance_m"))


def _distances(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distance of each point (x, y) from the segment (x1, y1, x2, y2) in the same row."""
    dx, dy = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
    l2 = dx * dx + dy * dy
    t = np.clip(((p[:, 0] - s[:, 0]) * dx + (p[:, 1] - s[:, 1]) * dy) / np.where(l2 > 0, l2, 1.0), 0.0, 1.0)
    return np.hypot(p[:, 0] - (s[:, 0] + t * dx), p[:, 1] - (s[:, 1] + t * dy))


class SegmentTree:
    """A hierarchy of boxes over segments (n, 4), whose rows `part` (n, 4) are the parts of them that the boxes hold."""

    def __init__(self, seg: np.ndarray, names: np.ndarray, part: np.ndarray | None = None, width: int = 8):
        part = seg if part is None else part
        lo, hi = np.minimum(part[:, :2], part[:, 2:]), np.maximum(part[:, :2], part[:, 2:])
        mid = (lo + hi) / 2
        cell = np.minimum(65535, (mid - mid.min(0)) / np.maximum(np.ptp(mid, axis=0), 1e-300) * 65535)
        order = np.argsort(_spread(cell[:, 0]) | (_spread(cell[:, 1]) << np.uint64(1)), kind="stable")
        n = len(seg)
        leaves = 1 << max(0, int(np.ceil(np.log2(max(1, -(-n // width))))))
        self.width, self.seg = width, seg[order]
        self.names, code = np.unique(names.astype(object), return_inverse=True)
        self.code = code.ravel()[order]
        blo, bhi = np.full((leaves * width, 2), np.inf), np.full((leaves * width, 2), -np.inf)
        blo[:n], bhi[:n] = lo[order], hi[order]
        self.level = [(blo.reshape(leaves, width, 2).min(1), bhi.reshape(leaves, width, 2).max(1))]
        while len(self.level[0][0]) > 1:
            a, b = self.level[0]
            self.level.insert(0, (a.reshape(-1, 2, 2).min(1), b.reshape(-1, 2, 2).max(1)))

    def nearest(self, p: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(name number or -1, distance) of the segment nearest to each point, if not beyond `most`; equally near: the
        smaller name. All points go down level by level; a box farther than the best bound so far is left."""
        number, best = np.full(len(p), -1), np.full(len(p), np.inf)
        for i in range(0, len(p), 2048):
            number[i : i + 2048], best[i : i + 2048] = self._nearest(p[i : i + 2048], most[i : i + 2048].copy())
        return number, best

    def _nearest(self, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit = bound.copy()
        q, node = np.arange(len(p)), np.zeros(len(p), int)
        for i, (lo, hi) in enumerate(self.level):
            if i:
                q, node = np.repeat(q, 2), (np.repeat(node * 2, 2) + np.tile([0, 1], len(node)))
            full = lo[node, 0] <= hi[node, 0]
            q, node = q[full], node[full]
            a, b, c = lo[node], hi[node], p[q]
            np.minimum.at(bound, q, np.hypot(*np.maximum(np.abs(c - a), np.abs(c - b)).T))
            away = np.hypot(*np.maximum(0.0, np.maximum(a - c, c - b)).T)
            near = away <= bound[q] * (1 + 1e-9) + 1e-9
            q, node, away = q[near], node[near], away[near]

        def inside(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = (np.repeat(node * self.width, self.width) + np.tile(np.arange(self.width), len(node)))
            q = np.repeat(q, self.width)
            real = t < len(self.seg)
            return q[real], t[real], _distances(p[q[real]], self.seg[t[real]])

        # the nearest box of each point first: its segments bound the distance of the others
        order = np.lexsort((away, q))
        head = np.r_[True, np.diff(q[order]) != 0] if len(q) else np.zeros(0, bool)
        q1, t1, d1 = inside(q[order[head]], node[order[head]])
        np.minimum.at(bound, q1, d1)
        rest = order[~head]
        rest = rest[away[rest] <= bound[q[rest]] * (1 + 1e-9) + 1e-9]
        q, t, d = (np.concatenate(x) for x in zip((q1, t1, d1), inside(q[rest], node[rest])))
        q, t, d = q[d <= limit[q]], t[d <= limit[q]], d[d <= limit[q]]
        order = np.lexsort((self.code[t], d, q))
        q, t, d = q[order], t[order], d[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        number, best = np.full(len(p), -1), np.full(len(p), np.inf)
        number[q[first]], best[q[first]] = self.code[t[first]], d[first]
        return number, best


def _no_lines() -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object if c in ("point", "line") else float) for c in ("point", "px", "py", "line", "distance")})


def _found(p: pd.DataFrame, tree: SegmentTree, most: np.ndarray) -> pd.DataFrame:
    number, d = tree.nearest(p[["px", "py"]].to_numpy(float), most)
    hit = number >= 0
    return pd.DataFrame({"point": pd.Series(p["point"].to_numpy(dtype=object)[hit], dtype=object), "px": p["px"].to_numpy()[hit], "py": p["py"].to_numpy()[hit], "line": pd.Series(tree.names[number[hit]], dtype=object), "distance": d[hit]})


_XY = ["x1", "y1", "x2", "y2"]
_NEAREST = "point string, px double, py double, line string, distance double"


def descended(points: DataFrame, lines: DataFrame, most: float = np.inf, sample: int = SAMPLE) -> DataFrame:
    """point, px, py, line, distance of the line nearest to each point, if within `most`, for points however far off.

    A tree over at most about `sample` lines gives every point a bound on its distance. Where that is all lines (the
    count is checked), it is the answer. Otherwise every line, cut into parts of about twice the mean length, lies in
    one leaf of the upper hierarchy; a point goes to the leaves whose box is not beyond its bound and descends their
    trees, so it meets a few lines, not all. Crowded leaves are joined in blocks. Both tables are read several times.
    """
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n, mean = lines.agg(F.count("*"), F.avg(size)).first()
    if not n:
        return points.sparkSession.createDataFrame([], _NEAREST)
    share = min(1.0, sample / n)
    known = (lines if share == 1.0 else lines.sample(share, 11)).select("line", *_XY).toPandas()
    bound = SegmentTree(known[_XY].to_numpy(float), known["line"].to_numpy(dtype=object)) if len(known) else None
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(bound)

    if share == 1.0:

        def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield _found(p, shared.value, np.full(len(p), most))

        return points.select("point", "px", "py").mapInPandas(whole, _NEAREST)

    def within(p: np.ndarray) -> np.ndarray:
        got = np.full(len(p), most)
        return got if bound is None else np.minimum(got, shared.value.nearest(p, np.full(len(p), np.inf))[1])

    mid = known[_XY].to_numpy(float)
    tree = SplitTree((mid[:, 0] + mid[:, 2]) / 2, (mid[:, 1] + mid[:, 3]) / 2, min(LEAVES, 1 + n // LEAF_ROWS))
    length = 2 * float(mean) or 1.0
    pieces = F.greatest(F.lit(1), F.ceil(size / length)).cast("int")
    at = lambda c, k: F.col(f"{c}1") + (F.col("_k") + k) / F.col("_n") * (F.col(f"{c}2") - F.col(f"{c}1"))
    cut = lines.select("line", *_XY, pieces.alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cut = cut.select("line", *_XY, at("x", 0).alias("u1"), at("y", 0).alias("v1"), at("x", 1).alias("u2"), at("y", 1).alias("v2"))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in (part for part in parts if len(part)):
            x, y = ((d["u1"] + d["u2"]) / 2).to_numpy(), ((d["v1"] + d["v2"]) / 2).to_numpy()
            row, leaf = tree.touched(x, y, x, y)
            yield d.astype({"line": object}).iloc[row].assign(leaf=leaf)

    placed = written(cut.mapInPandas(place, "line string, " + ", ".join(f"{c} double" for c in (*_XY, "u1", "v1", "u2", "v2")) + ", leaf int"), "leaves")
    b = placed.groupBy("leaf").agg(F.least(F.min("u1"), F.min("u2")), F.least(F.min("v1"), F.min("v2")), F.greatest(F.max("u1"), F.max("u2")), F.greatest(F.max("v1"), F.max("v2")), F.count("*")).toPandas().to_numpy(float)
    leaves, boxes = b[:, 0].astype(int), b[:, 1:5]  # at most LEAVES rows
    cut_t = np.ones(tree.size, int)
    cut_t[leaves] = _blocks(b[:, 5], 1.0)

    def reached(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound = within(p)
        rows, hit = [], []
        for i in range(0, len(p), 512):
            c = p[i : i + 512]
            far = np.hypot(np.maximum(0.0, np.maximum(boxes[:, 0] - c[:, :1], c[:, :1] - boxes[:, 2])), np.maximum(0.0, np.maximum(boxes[:, 1] - c[:, 1:], c[:, 1:] - boxes[:, 3])))
            r, k = np.nonzero(far <= bound[i : i + 512, None] * (1 + 1e-9) + 1e-9)
            rows.append(r + i)
            hit.append(leaves[k])
        return np.concatenate(rows), np.concatenate(hit), bound

    n_pts = points.count()
    share_pts = min(1.0, sample / max(1, n_pts))
    some = points.sample(share_pts, 12).select("px", "py").toPandas().to_numpy(float)
    cut_p = _blocks(np.bincount(reached(some)[1], minlength=tree.size) if len(some) else np.zeros(tree.size), share_pts)

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in (part for part in parts if len(part)):
            row, leaf, bound = reached(d[["px", "py"]].to_numpy(float))
            mine = np.arange(len(row)) % cut_p[leaf]
            again = cut_t[leaf]
            r = np.repeat(np.arange(len(row)), again)
            t = np.arange(len(r)) - np.repeat(np.cumsum(again) - again, again)
            yield d.astype({"point": object}).iloc[row[r]].assign(most=bound[row[r]], leaf=leaf[r], a=mine[r], b=t)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in (part for part in parts if len(part)):
            leaf = d["leaf"].to_numpy()
            again = cut_p[leaf]
            mine = np.arange(len(leaf)) % cut_t[leaf]
            r = np.repeat(np.arange(len(leaf)), again)
            t = np.arange(len(r)) - np.repeat(np.cumsum(again) - again, again)
            yield d.astype({"line": object}).iloc[r].assign(a=t, b=mine[r])

    def join(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(t):
            return _no_lines()
        lower = SegmentTree(t[_XY].to_numpy(float), t["line"].to_numpy(dtype=object), t[["u1", "v1", "u2", "v2"]].to_numpy(float))
        return _found(p, lower, p["most"].to_numpy())

    left = points.select("point", "px", "py").mapInPandas(send, "point string, px double, py double, most double, leaf int, a int, b int")
    right = placed.mapInPandas(spread, placed.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", a int, b int")
    got = left.groupBy("leaf", "a", "b").cogroup(right.groupBy("leaf", "a", "b")).applyInPandas(join, _NEAREST)
    return got.groupBy("point", "px", "py").agg(F.min(F.struct("distance", "line")).alias("b")).select("point", "px", "py", F.col("b.line").alias("line"), F.col("b.distance").alias("distance"))


def _nearest_of_block(xy: np.ndarray, at: np.ndarray, region: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Of the pairs of a block those with the nearest line of their point; regions are named by x1, y1, x2, y2 and line."""
    bits = [n.split("\x1f", 4) for n in names]
    ends = np.array([b[:4] for b in bits], dtype=object).astype(float).reshape(-1, 4)
    rank = np.empty(len(bits), int)
    rank[sorted(range(len(bits)), key=lambda i: bits[i][4])] = np.arange(len(bits))
    d = _distances(xy, ends[region])
    order = np.lexsort((rank[region], d, at))
    return order[np.r_[True, np.diff(at[order]) != 0]]


def nearest_lines(points: DataFrame, lines: DataFrame, first: float = 60.0, most: float = np.inf) -> DataFrame:
    """point, px, py, line and distance of the line (line, x1, y1, x2, y2) nearest to each point (point, px, py) in the
    plane, if within `most`.

    Every line gets a corridor of half-width `first` around it, also beyond its ends, so all lines within that distance
    of a point are found with it, and a point whose nearest found line lies within it is settled. The others, however
    far off and however dense the lines are, descend the hierarchies (see `descended`). Ties: the smaller line id. Null
    coordinates are left out. Both sides are written once.
    """
    todo = points.select("point", "px", "py").where("point IS NOT NULL AND px IS NOT NULL AND py IS NOT NULL").distinct()
    todo = written(todo, "points")  # both steps read both sides several times
    lines = lines.select(F.col("line").cast("string"), *_XY).where("line IS NOT NULL AND x1 + y1 + x2 + y2 IS NOT NULL").distinct()
    lines = written(lines, "lines")
    r = min(first, most)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    ux, uy = (F.coalesce(F.try_divide(F.col(f"{a}2") - F.col(f"{a}1"), length), F.lit(d)) * r * 1.0001 for a, d in (("x", 1.0), ("y", 0.0)))
    c = lines.withColumns({"ux": ux, "uy": uy})
    corner = lambda e, s, t: F.col(f"x{e}") + s * F.col("ux") - t * F.col("uy"), lambda e, s, t: F.col(f"y{e}") + s * F.col("uy") + t * F.col("ux")
    ring = ((1, -1, -1), (2, 1, -1), (2, 1, 1), (1, -1, 1))
    region = F.concat_ws("\x1f", *_XY, "line")
    corridors = c.select(region.alias("region"), F.array(*[corner[0](*k) for k in ring]).alias("xs"), F.array(*[corner[1](*k) for k in ring]).alias("ys"))
    bits = F.split("region", "\x1f", 5)
    got = in_regions(todo, corridors, _nearest_of_block).select("point", "px", "py", bits[4].alias("line"), *[bits[i].cast("double").alias(k) for i, k in enumerate(_XY)])
    got = got.withColumn("distance", point_segment_distance(*[F.col(k) for k in ("px", "py", *_XY)])).where(F.col("distance") <= r)
    best = got.groupBy("point", "px", "py").agg(F.min(F.struct("distance", "line")).alias("b")).select("point", "px", "py", F.col("b.line").alias("line"), F.col("b.distance").alias("distance"))
    if most <= first:
        return best
    done = written(best, "nearest")
    rest = written(todo.join(done, ["point", "px", "py"], "left_anti"), "farther")
    return done.unionByName(descended(rest, lines, most))


__all__ = ["SegmentTree", "SplitTree", "TriangleTree", "descended", "ear_clip", "in_regions", "near_pairs", "nearest_lines", "triangles"]
