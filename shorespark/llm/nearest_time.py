"""Pairing of records with the nearest interval in time of the same entity, by a learned index.

Per entity and time shard the answer to "which interval is nearest" is a step function of time. Its steps are a sorted
array; a piecewise-linear model with a bounded error predicts the place of a time in it, and a search of that bounded
stretch finds the exact step. Shards overlap by the window, so each shard answers alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000
ERROR = 8  #: the model's prediction is at most so many places off


def piecewise_linear(keys: np.ndarray, error: int = ERROR) -> tuple[list[int], list[float], list[int]]:
    """Segments (first key, places per key unit, first place) that predict every key's place within `error`.

    One pass keeps, from a segment's first key, the cone of slopes that miss no key by more than error - 1; a key
    outside the cone opens the next segment.
    """
    first, slope, place = [], [], []
    slack = error - 1
    i, n = 0, len(keys)
    while i < n:
        lo, hi, j = 0.0, np.inf, i + 1
        while j < n:
            dx = float(keys[j] - keys[i])
            a, b = (j - i - slack) / dx, (j - i + slack) / dx
            if a > hi or b < lo:
                break
            lo, hi, j = max(lo, a), min(hi, b), j + 1
        first.append(int(keys[i]))
        slope.append(0.0 if j == i + 1 else (lo + hi) / 2)
        place.append(i)
        i = j
    return first, slope, place


def steps(start: np.ndarray, end: np.ndarray, name: np.ndarray) -> tuple[list[int], list[int]]:
    """The nearest interval as a step function of time: (from key, row of the interval). The first key is the least.

    Nearest: distance 0 from start to end, both included, else to the nearer end; on a tie the later start, then the
    smaller name. Between two covered stretches the two neighbours' borders meet in the middle, where the later one,
    which has the later start, wins the tie.
    """
    order = np.lexsort((name, -start))  # the winner of a tie comes first
    rank = np.empty(len(start), int)
    rank[order] = np.arange(len(start))
    events = sorted({int(t) for t in start} | {int(t) + 1 for t in end})
    by_start = np.argsort(start, kind="stable")
    keys, rows = [], []
    open_: list[tuple[int, int]] = []
    at = 0
    covered: list[tuple[int, int]] = []  # (time, row or -1): the winner among the intervals that cover a time
    for t in events:
        while at < len(by_start) and start[by_start[at]] <= t:
            heapq.heappush(open_, (int(rank[by_start[at]]), int(by_start[at])))
            at += 1
        while open_ and end[open_[0][1]] < t:
            heapq.heappop(open_)
        covered.append((t, open_[0][1] if open_ else -1))
    last_end = np.lexsort((rank, -end))  # of intervals that ended last, the tie's winner
    ended = {}
    for r in last_end[::-1]:
        ended[int(end[r]) + 1] = int(r)
    began = {}
    for r in order[::-1]:
        began[int(start[r])] = int(r)
    keys.append(-(2**62))
    rows.append(began[covered[0][0]])
    for i, (t, row) in enumerate(covered):
        if row >= 0:
            keys.append(t)
            rows.append(row)
        else:
            last = t - 1
            nxt = covered[i + 1][0] if i + 1 < len(covered) else None
            # the first time that is at least as near to the next start as to the last end
            middle = None if nxt is None else last + -(-(nxt - last) // 2)
            if middle is None or middle > t:
                keys.append(t)
                rows.append(ended[t])
            if middle is not None:
                keys.append(middle)
                rows.append(began[nxt])
    return keys, rows


_INDEX = "entity string, cls int, shard long, keys array<long>, names array<string>, starts array<long>, ends array<long>, seg_key array<long>, seg_slope array<double>, seg_place array<int>"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index row per (entity, class, shard) of rows sorted by these; a group may run over several batches."""
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32())]
    names = ["entity", "cls", "shard", "keys", "names", "starts", "ends", "seg_key", "seg_slope", "seg_place"]

    def index(group: tuple, start: np.ndarray, end: np.ndarray, name: np.ndarray) -> tuple:
        keys, rows = steps(start, end, name)
        first, slope, place = piecewise_linear(np.array(keys[1:], dtype=np.int64))
        return (*group, keys, name[rows].tolist(), start[rows].tolist(), end[rows].tolist(), first, slope, [p + 1 for p in place])

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    held: list[tuple] = []
    here = None

    def close() -> tuple:
        start, end, name = (np.concatenate([h[i] for h in held]) for i in range(3))
        return index(here, start, end, name)

    for b in batches:
        if not len(b):
            continue
        gid = b.column(0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True])
        entity, cls, shard = (b.column(i) for i in (1, 2, 3))
        start, end = b.column(4).to_numpy(), b.column(5).to_numpy()
        name = b.column(6).to_numpy(zero_copy_only=False)
        out = []
        for i, j in zip(cut[:-1], cut[1:]):
            group = (entity[i].as_py(), cls[i].as_py(), shard[i].as_py())
            if here is not None and group != here:
                out.append(close())
                held = []
            here = group
            held.append((start[i:j], end[i:j], name[i:j]))
        if out:
            yield emit(out)
    if held:
        yield emit([close()])


def _class(days: Column) -> Column:
    """Shards of windows up to 2^c days belong to class c."""
    return F.ceil(F.log2(F.greatest(days.cast("double"), F.lit(1.0)))).cast("int")


def nearest_in_time(left: DataFrame, key: str, entity: str, instant: str, window_days: str, right: DataFrame, right_entity: str, name: str, start: str, end: str, shard_days: int = 366, windows: DataFrame | None = None) -> DataFrame:
    """key, name and distance_us of the interval of the same entity nearest to each record, if within its window.

    `instant`, `start` and `end` are microseconds; intervals are closed. Ties: the later start, then the smaller name.
    Rows with a null entity, instant or window or a negative window have no partner; nor do entities without
    intervals; intervals with a null border, name or entity, or reversed, are left out; repeated intervals count once;
    repeated left rows each get their own row. Either table may be empty.

    A record looks into one shard: its entity, the class of its window (a power of two) and its time in units of
    shard_days times that power. Each interval is given to every shard within that window of it, so the nearest
    interval within the window is always at hand, and nothing else is needed. Of the intervals with equal borders
    only the smallest name can win, so a shard's index is bounded by its distinct borders. The left side is joined
    once, with one index row per shard; a crowded shard is split by adaptive execution, repeating only its index row.
    """
    span = lambda c: F.lit(shard_days * DAY) * F.pow(F.lit(2.0), c).cast("long")
    l = left.select(F.col(key).alias("_key"), F.col(entity).cast("string").alias("entity"), F.col(instant).alias("_t"), F.col(window_days).cast("long").alias("_w"))  # noqa: E741
    l = l.where("entity IS NOT NULL AND _t IS NOT NULL AND _w >= 0").withColumn("cls", _class(F.col("_w")))
    l = l.withColumn("shard", F.floor(F.col("_t") / span(F.col("cls"))).cast("long"))
    classes = sorted(r[0] for r in (windows or left).select(_class(F.col(window_days)).alias("c")).where("c IS NOT NULL").distinct().collect())
    r = right.select(F.col(right_entity).cast("string").alias("entity"), F.col(name).cast("string").alias("name"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    r = r.where("entity IS NOT NULL AND name IS NOT NULL AND start <= end").groupBy("entity", "start", "end").agg(F.min("name").alias("name"))
    r = r.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<int>")))
    reach = F.pow(F.lit(2.0), F.col("cls")).cast("long") * DAY
    shards = F.sequence(F.floor((F.col("start") - reach) / span(F.col("cls"))).cast("long"), F.floor((F.col("end") + reach) / span(F.col("cls"))).cast("long"))
    index = r.withColumn("shard", F.explode(shards))
    order = ["entity", "cls", "shard", "start"]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = index.repartition(n, *order[:3]).sortWithinPartitions(*order)
    index = index.select(F.xxhash64(*order[:3]), *order[:3], "start", "end", "name").mapInArrow(_build, _INDEX)
    t = F.col("_t")
    joined = l.join(index, ["entity", "cls", "shard"])
    seg = F.size(F.filter("seg_key", lambda k: k <= t))
    # before the first border the first step holds; else the model of the segment predicts the place
    at = F.greatest(seg, F.lit(1))
    guess = F.element_at("seg_place", at) + F.element_at("seg_slope", at) * (t - F.element_at("seg_key", at))
    top = F.when(at < F.size("seg_key"), F.element_at("seg_place", F.least(at + 1, F.size("seg_key")))).otherwise(F.size("keys"))
    low = F.greatest(F.lit(1), F.least(F.floor(guess), top) .cast("int") - ERROR)
    found = joined.select("_key", "_t", "_w", "keys", "names", "starts", "ends", F.when(seg == 0, F.lit(1)).otherwise(low).alias("_low"))
    place = F.col("_low") + F.greatest(F.lit(1), F.size(F.filter(F.slice("keys", F.col("_low"), F.lit(2 * ERROR + 3)), lambda k: k <= t))) - 1
    hit = found.select("_key", "_w", "_t", F.element_at("names", place).alias("name"), F.element_at("starts", place).alias("s"), F.element_at("ends", place).alias("e"))
    far = F.greatest(F.lit(0).cast("long"), F.col("s") - t, t - F.col("e"))
    return hit.select(F.col("_key").alias(key), F.col("name").alias(name), far.alias("distance_us"), "_w").where(F.col("distance_us") <= F.col("_w") * DAY).drop("_w")


__all__ = ["nearest_in_time", "piecewise_linear", "steps"]
