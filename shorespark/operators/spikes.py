"""Implausible readings per source: spikes, stuck values and impossible values.

Each source's readings, in their order, form a matrix of profiles. Robust principal components split it into a
low-rank part, kept inside the band of the source's ordinary variation, and a sparse part; the entries of the sparse
part are the candidates for spikes, which an exact rule on the source's median and median distance then decides.
Stuck values and impossible values are tested apart from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorespark.functions.groups import exact_medians
from shorespark.session import written

MAD_SCALE = 1.4826


@dataclass(frozen=True)
class Rules:
    """far: robust deviations beyond which a reading is a spike. band: the low-rank part stays within so many robust
    deviations of the median. run: successive equal readings that count as stuck. width: readings in a profile."""

    far: float = 8.0
    band: float = 3.0
    run: int = 6
    width: int = 16
    rank: int = 2
    rounds: int = 4


def robust_components(z: np.ndarray, known: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse part of a stack of matrices (b, rows, width) of standardised readings; known: mask.

    Alternating projections: the sparse part takes the entries that differ from the low-rank part by more than
    far - band, the low-rank part is the best rank-r fit of the rest, clipped to [-band, band]. An entry farther
    than `far` from the median therefore lies in the sparse part whatever the fit: |z - low| > far - band.
    """
    cut = rules.far - rules.band
    low = np.zeros_like(z)
    for _ in range(rules.rounds):
        sparse = np.where(known & (np.abs(z - low) > cut), z - low, 0.0)
        rest = np.where(known, z - sparse, low)
        gram = np.matmul(rest.transpose(0, 2, 1), rest)
        vectors = np.linalg.eigh(gram)[1][:, :, -rules.rank :]
        low = np.clip(np.matmul(np.matmul(rest, vectors), vectors.transpose(0, 2, 1)), -rules.band, rules.band)
    return low, np.where(known & (np.abs(z - low) > cut), z - low, 0.0)


def _medians(g: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
    """Exact median of x per group number; NaN for groups without values."""
    order = np.lexsort((x, g))
    xs, n = x[order], np.bincount(g, minlength=groups)
    start = np.cumsum(n) - n
    some = n > 0
    out = np.full(groups, np.nan)
    lo, hi = start + np.maximum(n - 1, 0) // 2, start + n // 2
    out[some] = (xs[lo[some]] + xs[hi[some]]) / 2
    return out


def sparse_candidates(g: np.ndarray, x: np.ndarray, med: np.ndarray, mad: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the readings x: mask of those in the sparse part of their group's profile matrix, and their low-rank part and
    residual in robust deviations. g: group numbers, ascending."""
    sigma = MAD_SCALE * mad[g]
    flat = sigma == 0  # more than half the readings are equal: any other value is off the constant low-rank part
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        z = np.where(flat, 0.0, (x - med[g]) / np.where(flat, 1.0, sigma))
    z = np.clip(z, -1e6, 1e6)
    found = flat & (x != med[g])
    fitted = np.zeros(len(x))
    n = np.bincount(g, minlength=len(med))
    start = np.cumsum(n) - n
    rows = -(-n // rules.width)
    place = np.arange(len(g)) - start[g]
    for r in np.unique(rows[n > 0]):
        own = np.flatnonzero(rows == r)
        for chunk in np.array_split(own, max(1, len(own) * int(r) * rules.width // 2_000_000)):
            slot = np.full(len(med), -1)
            slot[chunk] = np.arange(len(chunk))
            at = np.flatnonzero(slot[g] >= 0)
            stack = np.zeros((len(chunk), int(r) * rules.width))
            known = np.zeros(stack.shape, bool)
            stack[slot[g[at]], place[at]] = z[at]
            known[slot[g[at]], place[at]] = True
            shape = (len(chunk), int(r), rules.width)
            low, sparse = robust_components(stack.reshape(shape), known.reshape(shape), rules)
            found[at] |= sparse.reshape(stack.shape)[slot[g[at]], place[at]] != 0
            fitted[at] = low.reshape(stack.shape)[slot[g[at]], place[at]]
    return found, fitted, np.where(found & flat, np.inf, z - fitted)


def _runs(g: np.ndarray, order: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (g, order): the run number of each row's order step (-1 if the row's value is not its step's
    value) and the number of steps per run. A step is one order value; its value is that of its first row."""
    new_step = np.r_[True, (np.diff(g) != 0) | (np.diff(order) != 0)]
    step = np.cumsum(new_step) - 1
    sg, sv = g[new_step], v[new_step]
    run = np.cumsum(np.r_[True, (np.diff(sg) != 0) | (sv[1:] != sv[:-1])]) - 1
    length = np.bincount(run)
    return np.where(v == sv[step], run[step], -1), length


OUT = "field int, record_key long, source string, edge int, ord_lo double, ord_hi double, v double, steps int"
PARTS = "field int, record_key long, low double, residual double, rule boolean"


def _partition(fields: int, limits: list[float], rules: Rules, blocks: bool, parts: bool):
    """Over rows sorted by group and order: the cases (OUT), or with `parts` the components of every reading (PARTS).
    With `blocks` a group is a block of a source: medians come with the rows, and runs, which may go on in the next
    block, are sent on (the first, the last and all long ones) instead of being decided."""

    def find(t: pd.DataFrame) -> list[pd.DataFrame]:
        new = np.r_[True, np.diff(t["gid"].to_numpy()) != 0]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        order, key = t["ord"].to_numpy(np.float64), t["record_key"].to_numpy()
        out = []
        for f in range(fields):
            value, adjusted = t[f"v{f}"].to_numpy(np.float64), t[f"x{f}"].to_numpy(np.float64)
            bad = np.isfinite(value) & (np.abs(value) > limits[f]) | np.isinf(value)
            at = np.flatnonzero(np.isfinite(adjusted))
            g, x = group[at], adjusted[at]
            if blocks:
                med, mad = t[f"med{f}"].to_numpy(np.float64)[first], t[f"mad{f}"].to_numpy(np.float64)[first]
            else:
                med = _medians(g, x, len(first))
                mad = _medians(g, np.abs(x - med[g]), len(first))
            if len(at):
                likely, low, rest = sparse_candidates(g, x, med, mad, rules)
                far = np.abs(x - med[g]) > rules.far * MAD_SCALE * mad[g]
                if parts:
                    out.append(pd.DataFrame({"field": f, "record_key": key[at], "low": low, "residual": rest, "rule": far}))
                bad[at] |= likely & far
            if parts:
                continue
            at = np.flatnonzero(~np.isnan(value) & ~np.isnan(order))
            if len(at):
                run, length = _runs(group[at], order[at], value[at])
                if not blocks:
                    bad[at] |= (run >= 0) & (length[run] >= rules.run)
                else:
                    got = pd.DataFrame({"g": group[at], "run": run, "ord": order[at], "v": value[at]})[run >= 0]
                    ends = got.groupby("g").run.agg(["min", "max"])
                    spans = got.groupby(["g", "run"]).agg(ord_lo=("ord", "min"), ord_hi=("ord", "max"), v=("v", "first")).reset_index()
                    spans = spans.merge(ends, left_on="g", right_index=True)
                    head, tail = spans.run == spans["min"], spans.run == spans["max"]
                    spans = spans.assign(steps=length[spans.run.to_numpy()], edge=head * 1 + tail * 2 + ~(head | tail) * 4)
                    spans = spans[(spans.edge != 4) | (spans.steps >= rules.run)]
                    row = first[spans.g.to_numpy()]
                    out.append(pd.DataFrame({"field": f, "record_key": None, "source": t["source"].to_numpy()[row], "edge": spans.edge, "ord_lo": spans.ord_lo, "ord_hi": spans.ord_hi, "v": spans.v, "steps": spans.steps}))
            k = key[bad]
            out.append(pd.DataFrame({"field": f, "record_key": k, "source": None, "edge": 0, "ord_lo": None, "ord_hi": None, "v": None, "steps": None}, index=range(len(k))))
        return out

    whole = [("field", pa.int32()), ("record_key", pa.int64())]
    if parts:
        schema = pa.schema([*whole, ("low", pa.float64()), ("residual", pa.float64()), ("rule", pa.bool_())])
    else:
        schema = pa.schema([*whole, ("source", pa.string()), ("edge", pa.int32()), ("ord_lo", pa.float64()), ("ord_hi", pa.float64()), ("v", pa.float64()), ("steps", pa.int32())])

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for got in find(t.to_pandas()):
            if len(got):
                got = got.astype({c: "Int64" for c in ("field", "record_key", "edge", "steps") if c in got})
                yield from pa.Table.from_pandas(got, schema, preserve_index=False).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ids = t.column("gid").to_numpy()
            if not len(ids):
                continue
            cut = len(ids) - int(np.argmax((ids != ids[-1])[::-1])) if ids[0] != ids[-1] else 0
            if cut or (held and held[-1].column("gid")[-1].as_py() != ids[0]):
                yield from emit(pa.concat_tables([*held, t.slice(0, cut)]))
                held = []
            held.append(t.slice(cut))
        if held:
            yield from emit(pa.concat_tables(held))

    return run


def _run_names(fields: int) -> list[str]:
    return [f"{c}{f}" for f in range(fields) for c in ("v", "x")]


def _grouped(rows: DataFrame, fields: int, limits: list[float], rules: Rules, blocks: bool, parts: bool = False) -> DataFrame:
    cols = ["gid", "ord", "record_key", *_run_names(fields)]
    if blocks:
        cols += ["source", *[f"{m}{f}" for f in range(fields) for m in ("med", "mad")]]
    ready = rows.select(*cols).repartition("gid").sortWithinPartitions("gid", "ord", "record_key")
    return ready.mapInArrow(_partition(fields, limits, rules, blocks, parts), PARTS if parts else OUT)


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    on = F.lit(True)
    for c in cols:
        on = on & a[c].eqNullSafe(b[c])
    return on


def _blocked(d: DataFrame, names: list[str], limit: int) -> DataFrame:
    """d with the columns block and salt, which split every source into pieces of at most about `limit` rows.

    A block is a range of the order: quantiles split a crowded block into up to 256, and those again, until each is
    small or a single order value. Rows of a crowded order value are salted and lose their order, so that they take no
    part in runs; the first row with a reading of each field, which is the one that counts for runs, keeps it.
    """
    d = d.withColumn("block", F.lit(0).cast("long"))
    while True:
        size = d.groupBy("source", "block").agg(F.count("*").alias("_n"), (F.min("ord") < F.max("ord")).alias("_wide"), F.percentile_approx("ord", [i / 256 for i in range(1, 256)], 10000).alias("_q"))
        crowded = size.where((F.col("_n") > limit) & F.col("_wide")).select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.array_distinct("_q").alias("_q"), F.ceil(F.col("_n") / limit).alias("_n"))
        crowded = written(crowded, "crowded")
        if crowded.isEmpty():
            break
        j = d.join(crowded, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
        # the block's first value is below a quantile, its last one is not below any, unless one value is most of it
        at = F.when(F.col("_q").isNull(), 0).otherwise(F.size(F.filter("_q", lambda c: c <= F.col("ord"))) + F.when(F.array_max("_q") < F.col("ord"), 1).otherwise(0))
        d = written(j.withColumn("block", F.col("block") * 512 + at).select(*[c for c in d.columns]), "blocked")
    crowd = d.groupBy("source", "ord").agg(F.count("*").alias("_n"), *[F.min(F.when(F.col(n).isNotNull(), F.col("record_key"))).alias(f"_f{i}") for i, n in enumerate(names) if n.startswith("v")]).where(F.col("_n") > limit)
    crowd = written(crowd.withColumnsRenamed({"source": "_s", "ord": "_o"}), "crowd")
    if crowd.isEmpty():
        return d.withColumn("salt", F.lit(0))
    j = d.join(crowd, F.col("source").eqNullSafe(F.col("_s")) & F.col("ord").eqNullSafe(F.col("_o")), "left")
    leads = F.lit(False)
    for c in crowd.columns:
        if c.startswith("_f"):
            leads = leads | F.coalesce(F.col("record_key") == F.col(c), F.lit(False))
    aside = F.col("_n").isNotNull() & ~leads
    salt = F.when(aside, 1 + F.pmod(F.xxhash64("record_key"), F.ceil(F.col("_n") / limit))).otherwise(0)
    return j.withColumns({"salt": salt, "ord": F.when(~aside, F.col("ord"))}).select(*d.columns, "salt")


def _large_sources(rows: DataFrame, fields: int, limits: list[float], rules: Rules, limit: int, parts: bool = False) -> DataFrame:
    """Cases of the sources with more than `limit` readings: medians by ranks, profiles and runs by blocks of the
    order, runs over the blocks' borders joined afterwards; equal repeats are reduced to one reading first."""
    names = _run_names(fields)
    stats = None
    for f in range(fields):
        finite = F.abs(F.col(f"x{f}")) < float("inf")
        med = exact_medians(rows, ["source"], F.when(finite, F.col(f"x{f}")), f"med{f}")
        far = rows.join(med.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "inner")
        mad = exact_medians(far, ["source"], F.when(finite, F.abs(F.col(f"x{f}") - F.col(f"med{f}"))), f"mad{f}")
        for one in (med, mad):
            stats = one if stats is None else stats.join(one.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "full").withColumn("source", F.coalesce("source", "_s")).drop("_s")
    distinct = rows.groupBy("source", "ord", *names).agg(F.min("record_key").alias("record_key"))
    s = stats.withColumnRenamed("source", "_s")
    d = _blocked(distinct, names, limit)
    d = d.join(s, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("gid", F.xxhash64("source", "block", "salt"))
    got = _grouped(d, fields, limits, rules, True, parts)
    raw = rows.withColumnRenamed("record_key", "_key")
    if parts:
        each = got.join(distinct, "record_key")
        return raw.join(each, _same(raw, each, ["source", "ord", *names])).select("field", F.col("_key").alias("record_key"), "low", "residual", "rule")
    reps = got.where("edge = 0").select("field", "record_key")
    flagged = reps.join(distinct, "record_key")
    spikes = raw.join(flagged, _same(raw, flagged, ["source", "ord", *names])).select("field", F.col("_key").alias("record_key"))

    need = rules.run

    # a block of nulls has no edge, but every block with values sends its first and its last run, so successive edges by
    # order are neighbours; what lies inside a block (edge 4) is complete
    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        name, field, inner = pdf.source.iloc[0], int(pdf.field.iloc[0]), pdf[pdf.edge == 4]
        pdf = pdf[pdf.edge != 4].sort_values("ord_lo")
        out, cur = [], None
        for r in pdf.itertuples():
            if cur and cur[2] == r.v and r.edge in (1, 3) and cur[4] in (2, 3):
                cur = [cur[0], r.ord_hi, r.v, cur[3] + r.steps, r.edge]
            else:
                if cur and cur[3] >= need:
                    out.append(cur[:3])
                cur = [r.ord_lo, r.ord_hi, r.v, r.steps, r.edge]
        if cur and cur[3] >= need:
            out.append(cur[:3])
        got = pd.concat([pd.DataFrame(out, columns=["ord_lo", "ord_hi", "v"]).astype(float), inner[["ord_lo", "ord_hi", "v"]]], ignore_index=True)
        return got.assign(source=pd.Series([name] * len(got), dtype=object), field=field)[["source", "field", "ord_lo", "ord_hi", "v"]]

    edges = got.where("edge > 0").groupBy("source", "field").applyInPandas(stitch, "source string, field int, ord_lo double, ord_hi double, v double").withColumnRenamed("source", "_s")
    values = rows.select("source", "ord", "record_key", F.posexplode(F.array(*[F.col(f"v{f}") for f in range(fields)])).alias("_f", "_v"))
    stuck = values.join(edges, values.source.eqNullSafe(edges["_s"]) & (F.col("_f") == F.col("field")) & (F.col("_v") == F.col("v")) & F.col("ord").between(F.col("ord_lo"), F.col("ord_hi"))).select("field", "record_key")
    return spikes.unionByName(stuck).distinct()


def _every_source(df: DataFrame, source: str, order: str, key: str, fields: dict, rules: Rules, limit: int, parts: bool) -> DataFrame:
    names = list(fields)
    exprs = {f"{c}{i}": (F.nanvl(e.cast("double"), F.lit(None).cast("double"))) for i, n in enumerate(names) for c, e in (("v", fields[n][0]), ("x", fields[n][1]))}
    rows = df.select(F.col(source).cast("string").alias("source"), F.col(order).cast("double").alias("ord"), F.col(key).cast("long").alias("record_key"), *[e.alias(c) for c, e in exprs.items()])
    limits = [fields[n][2] for n in names]
    keep = PARTS.replace(" int", "").replace(" long", "").replace(" double", "").replace(" boolean", "").split(", ") if parts else ["field", "record_key"]
    large = df.groupBy(F.col(source).cast("string").alias("_big")).count().where(F.col("count") > limit).select("_big")
    if large.isEmpty():
        cases = _grouped(rows.withColumn("gid", F.xxhash64("source")), len(names), limits, rules, False, parts).select(*keep)
    else:
        is_large = F.col("source").eqNullSafe(F.col("_big"))
        ordinary = rows.join(large, is_large, "left_anti").withColumn("gid", F.xxhash64("source"))
        small = _grouped(ordinary, len(names), limits, rules, False, parts).select(*keep)
        cases = small.unionByName(_large_sources(rows.join(large, is_large, "left_semi"), len(names), limits, rules, limit, parts))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("field") + 1)
    return cases.select(label.alias("field_name"), *keep[1:])


def implausible(df: DataFrame, source: str, order: str, key: str, fields: dict[str, tuple[Column, Column, float]], rules: Rules = Rules(), limit: int = 200_000) -> DataFrame:
    """field_name, record_key of the readings that cannot be true for their source.

    fields: name -> (reading, reading without its trend, greatest possible absolute value). A reading is a case if
    (a) without its trend it lies farther from the source's median than far x 1.4826 x the median distance, (b) it is
    one of `run` or more successive equal readings, one per order value, nulls skipped, or (c) it exceeds the greatest
    value. Null and NaN readings are never cases and are skipped; infinite ones are always; readings without order
    take no part in (b); a null source is a source of its own; repeated rows are cases together; an empty table gives
    no rows. `key` must be unique. Sources beyond `limit` readings are never gathered: see `_large_sources`.
    """
    return _every_source(df, source, order, key, fields, rules, limit, False)


def components(df: DataFrame, source: str, order: str, key: str, fields: dict[str, tuple[Column, Column, float]], rules: Rules = Rules(), limit: int = 200_000) -> DataFrame:
    """field_name, record_key, low, residual, rule and sparse of every finite reading: its low-rank part and what is left
    of it, both in robust deviations from the source's median, whether rule (a) of `implausible` calls it a spike, and
    whether the decomposition alone does, which is where the residual is beyond `far`."""
    return _every_source(df, source, order, key, fields, rules, limit, True).withColumn("sparse", F.abs("residual") > rules.far)


__all__ = ["Rules", "components", "implausible", "robust_components", "sparse_candidates"]
