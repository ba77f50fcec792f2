"""Mixed timestamp texts of many sources turned into instants.

The fixed rules state one reading of every readable text, and where they decide each text is read by itself. Where the
order of the records shall decide, every text gets the array of all its valid readings and a Viterbi pass over each
source's records, in their order, chooses one reading per record. A path pays for readings against the fixed rules, for
a switch of the format and for time that runs backwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorespark.functions.groups import salted
from shorespark.functions.timestamps import to_utc, with_reading
from shorespark.session import written

#: Production costs. Readings against the rules cost more than the two transitions of a record can ever save, so they
#: never win where a reading by the rules exists, and `normalised` needs no path; lower `against_rules` to let the
#: records' order decide.
COSTS = {"against_rules": 1000.0, "switch": 1.0, "backwards": 2.0}
OUT = "table_code int, record_key long, us long, kind int, n_readings int"


def readings(df: DataFrame, text: str, zone: str | None) -> DataFrame:
    """df with r_main, r_kind, r_utc (the reading by the rules) and r_others: array of struct(kind, us) of all other
    valid readings, null if there is none: the month first, the second of a wall time that occurs twice, and a
    skipped wall time with the offset after the jump. Rows whose text is null or unreadable are dropped."""
    df = with_reading(df, text, zone).where(F.col("r_utc").isNotNull())
    place = F.coalesce(F.col(zone), F.lit("UTC")) if zone else F.lit("UTC")
    walled = F.col("r_offset").isNull() & ~place.isin("UTC", "GMT")
    shown = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), place))
    u = F.col("r_utc")
    df = df.withColumn("r_shown", F.when(walled, shown(u)))
    later = [F.when(F.col("r_shown").isNotNull() & (shown(u + m * 60_000_000) == F.col("r_us")), u + m * 60_000_000) for m in (30, 60)]
    again = F.coalesce(*later)
    skipped = F.when(F.col("r_shown") != F.col("r_us"), u - (F.col("r_shown") - F.col("r_us")))
    month_first = F.when(F.col("r_offset").isNotNull(), F.col("r_swapped") - F.col("r_offset").cast("long") * 60_000_000).otherwise(to_utc(F.col("r_swapped"), F.col(zone) if zone else F.lit(None).cast("string")))
    other = lambda kind, us: F.when(us.isNotNull(), F.struct(F.lit(kind).alias("kind"), us.alias("us")))
    df = df.withColumns({"r_again": again, "r_skipped": skipped, "r_first": F.when(F.col("r_swapped").isNotNull(), month_first)})
    listed = F.array_compact(F.array(other(7, F.col("r_first")), other(4, F.col("r_again")), other(4, F.col("r_skipped"))))
    some = F.col("r_first").isNotNull() | F.col("r_again").isNotNull() | F.col("r_skipped").isNotNull()
    return df.withColumn("r_others", F.when(some, listed)).drop("r_shown", "r_again", "r_skipped", "r_first", "r_us", "r_swapped", "r_offset")


def best_path(us: list[list[int]], kind: list[list[int]], cost: list[list[float]], left=None, right=None, costs=None) -> list[int]:
    """The cheapest choice of one reading per record; left and right are (kind, us) of fixed neighbours or None.
    Of equally cheap choices the earlier listed reading wins."""
    c = costs or COSTS

    def step(a_kind, a_us, b_kind, b_us):
        return c["switch"] * (a_kind != b_kind) + c["backwards"] * (b_us < a_us)

    score, back = [], []
    for i in range(len(us)):
        now, frm = [], []
        for k, u, e in zip(kind[i], us[i], cost[i]):
            if i == 0:
                now.append(e + (step(*left, k, u) if left else 0.0))
                frm.append(0)
            else:
                ways = [score[-1][j] + step(kind[i - 1][j], us[i - 1][j], k, u) for j in range(len(us[i - 1]))]
                j = min(range(len(ways)), key=ways.__getitem__)
                now.append(e + ways[j])
                frm.append(j)
        score.append(now)
        back.append(frm)
    last = [s + (step(k, u, *right) if right else 0.0) for s, k, u in zip(score[-1], kind[-1], us[-1])]
    j = min(range(len(last)), key=last.__getitem__)
    path = [j]
    for i in range(len(us) - 1, 0, -1):
        path.append(j := back[i][j])
    return path[::-1]


def _chosen(costs: dict[str, float], hold: int):
    def resolve(t: pa.Table, final: bool) -> tuple[pa.Table | None, pa.Table | None]:
        """Rows whose choice is settled, and the rows to wait with: from the last record of one reading on."""
        others = t.column("r_others").combine_chunks()
        free = others.is_valid().to_numpy(zero_copy_only=False)
        fixed = np.flatnonzero(~free)
        cut = len(t) if final or len(t) > hold else (int(fixed[-1]) if len(fixed) else 0)
        us = t.column("r_utc").to_numpy().copy()
        kind = t.column("r_kind").to_numpy().copy()
        count = np.ones(len(t), np.int32)
        gid = t.column("gid").to_numpy()
        at = np.flatnonzero(free[:cut])
        if len(at):
            split = np.flatnonzero((np.diff(at) > 1) | (np.diff(gid[at]) != 0)) + 1
            for run in np.split(at, split):
                a, b = int(run[0]), int(run[-1])
                alts = others.slice(a, b - a + 1).to_pylist()
                uss = [[int(us[i]), *(x["us"] for x in alt)] for i, alt in zip(range(a, b + 1), alts)]
                kinds = [[int(kind[i]), *(x["kind"] for x in alt)] for i, alt in zip(range(a, b + 1), alts)]
                emit = [[0.0] + [costs["against_rules"]] * len(alt) for alt in alts]
                left = (int(kind[a - 1]), int(us[a - 1])) if a > 0 and gid[a - 1] == gid[a] else None
                right = (int(kind[b + 1]), int(us[b + 1])) if b + 1 < len(t) and gid[b + 1] == gid[b] else None
                for i, j, u, k in zip(range(a, b + 1), best_path(uss, kinds, emit, left, right, costs), uss, kinds):
                    us[i], kind[i], count[i] = u[j], k[j], len(u)
        out = pa.table({"table_code": t.column("table_code").slice(0, cut), "record_key": t.column("record_key").slice(0, cut), "us": us[:cut], "kind": pa.array(kind[:cut], pa.int32()), "n_readings": count[:cut]}) if cut else None
        return out, (t.slice(cut) if cut < len(t) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            out, held = resolve(t if held is None else pa.concat_tables([held, t]).combine_chunks(), False)
            if out is not None:
                yield from out.combine_chunks().to_batches()
        if held is not None:
            out, _ = resolve(held.combine_chunks(), True)
            yield from out.combine_chunks().to_batches()

    return run


def chains(df: DataFrame, code: int, source: str, order: str, key: str, text: str, zone: str | None, span: int | None = None, limit: int = 200_000) -> DataFrame:
    """One table's readable records as chain rows; a chain is all of a source's records by their order, then their key.
    With `span` it is a source's records within `span` units of the order, and chains of more than `limit` records
    (copies of one pass, say) are salted; only ids are read to find them. See `resolved` for when that may be done."""
    base = df.select(F.col(source).alias("source"), F.col(order).cast("long").alias("ord"), F.col(key).cast("long").alias("record_key"), F.col(text).alias("text"), F.col(zone).alias("zone") if zone else F.lit(None).cast("string").alias("zone"))
    if span is None:
        r = readings(base.withColumns({"chain": F.xxhash64(F.lit(code), "source"), "salt": F.lit(0)}), "text", "zone")
    else:
        chain = F.xxhash64(F.lit(code), "source", F.floor(F.col("ord") / span))
        r = readings(salted(base.withColumn("chain", chain), ["chain"], "record_key", limit), "text", "zone")
    return r.select(F.lit(code).alias("table_code"), "chain", "salt", "ord", "record_key", "r_main", "r_kind", "r_utc", "r_others")


def cuts_are_harmless(costs: dict[str, float]) -> bool:
    """True if no transitions of a record can outweigh a reading against the rules, so that chains may be cut anywhere."""
    return 2 * (costs["switch"] + costs["backwards"]) < costs["against_rules"]


def resolved(rows: DataFrame, costs: dict[str, float] | None = None, hold: int = 50_000) -> DataFrame:
    """table_code, record_key, us, kind, n_readings of every chain row (see `chains`), for costs under which chains may be
    cut (`cuts_are_harmless`, an error otherwise: then `resolved_in_order`).

    A record with a single reading splits its chain exactly, so a partition is streamed and only the stretches
    between such records are solved; a stretch of more than `hold` ambiguous records is cut there. With these costs
    the choice cannot depend on that cut, nor on those of the chains: it is always the reading by the rules, so whoever
    needs only that, as `normalised`, takes it without this pass.
    """
    costs = costs or COSTS
    if not cuts_are_harmless(costs):
        raise ValueError("with these costs chains must stay whole: use resolved_in_order")
    gid = F.xxhash64("chain", "salt")
    ready = rows.select(gid.alias("gid"), "ord", "record_key", "table_code", "r_kind", "r_utc", "r_others")
    ready = ready.repartition("gid").sortWithinPartitions("gid", "ord", "record_key")
    return ready.mapInArrow(_chosen(costs, hold), OUT)


# --- whole chains: blocks of the order, joined by their transfer costs ---------------------------------------------


def transfer(us: list[list[int]], kind: list[list[int]], cost: list[list[float]], costs: dict[str, float]) -> list[list[float]]:
    """For every reading of the first and of the last record the cost of the cheapest path between them, both included."""
    inf = float("inf")
    rows = [[e if i == j else inf for j in range(len(cost[0]))] for i, e in enumerate(cost[0])]
    for n in range(1, len(us)):
        step = [[costs["switch"] * (kind[n - 1][a] != kind[n][b]) + costs["backwards"] * (us[n][b] < us[n - 1][a]) + cost[n][b] for a in range(len(us[n - 1]))] for b in range(len(us[n]))]
        rows = [[min(r[a] + s[a] for a in range(len(r))) for s in step] for r in rows]
    return rows


def _stretches(t: pa.Table, costs: dict[str, float]) -> Iterator[tuple]:
    """(first row, readings, kinds, costs) of every chain in a block of rows sorted by chain and order."""
    gid = t.column("chain").to_numpy()
    us, kind, others = t.column("r_utc").to_pylist(), t.column("r_kind").to_pylist(), t.column("r_others").to_pylist()
    cut = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        alts = [o or [] for o in others[a:b]]
        yield a, [[u, *(x["us"] for x in o)] for u, o in zip(us[a:b], alts)], [[k, *(x["kind"] for x in o)] for k, o in zip(kind[a:b], alts)], [[0.0] + [costs["against_rules"]] * len(o) for o in alts]


def _by_block(run):
    """run(block number, its rows) over rows that come sorted by block."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            yield from run(t.column("pid")[0].as_py(), t).to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            pid = t.column("pid").to_numpy()
            cut = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1], True]) if len(pid) else []
            for i, j in zip(cut[:-1], cut[1:]):
                if held and held[-1].column("pid")[0].as_py() != pid[i]:
                    yield from close()
                    held = []
                held.append(t.slice(i, j - i))
        if held:
            yield from close()

    return over


IN_ORDER = "table_code int, record_key long, us long, by_rules long, kind int, n_readings int"


def resolved_in_order(rows: DataFrame, costs: dict[str, float], limit: int = 100_000) -> DataFrame:
    """table_code, record_key, us, by_rules, kind, n_readings of every row of whole chains (`chains` without span): the
    cheapest path along each chain for any costs.

    The rows are split by ranges of (chain, order, key) into blocks of about `limit`, so a hot chain runs over many.
    Each block gives, for the chains that go over its borders, the costs between every reading of its first and of its
    last record there; those small tables, at most two a block, are joined on the driver, and then each block is solved
    with the readings at its borders fixed. Of equally cheap paths one is taken.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // limit))
    sort = ["chain", "ord", "record_key"]
    placed = written(rows.repartitionByRange(n, *sort).withColumn("pid", F.spark_partition_id()), "chains")
    ready = placed.select("pid", *sort, "table_code", "r_kind", "r_utc", "r_others").repartition("pid").sortWithinPartitions("pid", *sort)
    schema = pa.schema([("pid", pa.int32()), ("place", pa.int32()), ("chain", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("first_kind", pa.list_(pa.int32())), ("last_kind", pa.list_(pa.int32())), ("cost", pa.list_(pa.float64()))])

    def borders(pid: int, t: pa.Table) -> pa.Table:
        every = list(_stretches(t, costs))
        out = []
        for place, (a, us, kind, cost) in ([(0, every[0])] if len(every) == 1 else [(0, every[0]), (1, every[-1])]):
            flat = [x for r in transfer(us, kind, cost, costs) for x in r]
            out.append((pid, place, t.column("chain")[a].as_py(), us[0], us[-1], kind[0], kind[-1], flat))
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    ddl = "pid int, place int, chain long, first array<long>, last array<long>, first_kind array<int>, last_kind array<int>, cost array<double>"
    summary = sorted(tuple(r) for r in ready.mapInArrow(_by_block(borders), ddl).collect())
    fixed: dict[tuple[int, int], tuple[int, int]] = {}
    at = 0
    while at < len(summary):
        end = at
        while end < len(summary) and summary[end][2] == summary[at][2]:
            end += 1
        run = summary[at:end]  # one chain's parts, in order
        score, back = None, []
        for _, _, _, first, last, fk, lk, cost in run:
            enter = [(0.0, None)] * len(first)
            if score is not None:
                step = lambda a, b: costs["switch"] * (prev[1][a] != fk[b]) + costs["backwards"] * (first[b] < prev[0][a])  # noqa: B023, E731
                enter = [min((score[a] + step(a, b), a) for a in range(len(score))) for b in range(len(first))]
            ways = [min((enter[i][0] + cost[i * len(last) + j], i) for i in range(len(first))) for j in range(len(last))]
            back.append([(i, enter[i][1]) for _, i in ways])
            score, prev = [w for w, _ in ways], (last, lk)
        j = min(range(len(score)), key=score.__getitem__)
        for (pid, place, *_), b in zip(reversed(run), reversed(back)):
            i, before = b[j]
            fixed[pid, place] = (i, j)
            j = before
        at = end
    shared = spark.sparkContext.broadcast(fixed)

    def solve(pid: int, t: pa.Table) -> pa.Table:
        us_out, kind_out, count = t.column("r_utc").to_numpy().copy(), t.column("r_kind").to_numpy().copy(), np.ones(len(t), np.int32)
        every = list(_stretches(t, costs))
        for k, (a, us, kind, cost) in enumerate(every):
            pick = [list(range(len(u))) for u in us]
            ends = shared.value.get((pid, 0 if k == 0 else 1)) if k in (0, len(every) - 1) else None
            if ends:
                pick[0], pick[-1] = [ends[0]], [ends[1]]
            some = lambda values: [[v[i] for i in p] for v, p in zip(values, pick)]  # noqa: B023, E731
            for n, j in enumerate(best_path(some(us), some(kind), some(cost), costs=costs)):
                us_out[a + n], kind_out[a + n], count[a + n] = us[n][pick[n][j]], kind[n][pick[n][j]], len(us[n])
        return pa.table({"table_code": t.column("table_code"), "record_key": t.column("record_key"), "us": us_out, "by_rules": t.column("r_utc"), "kind": pa.array(kind_out, pa.int32()), "n_readings": count})

    return ready.mapInArrow(_by_block(solve), IN_ORDER)


def _by_rules(df: DataFrame, name: str, key: str, text: str, zone: str | None) -> DataFrame:
    base = df.select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("record_key"), F.col(text).alias("text"), F.col(zone).alias("zone") if zone else F.lit(None).cast("string").alias("zone"))
    return with_reading(base, "text", "zone").where(F.col("r_utc").isNotNull() & ~F.col("r_main")).select("table_name", "record_key", F.col("r_utc").alias("utc_micros"))


def normalised(tables: list[tuple[str, DataFrame, dict]], costs: dict[str, float] | None = None) -> DataFrame:
    """table_name, record_key, utc_micros of all readable texts not yet in the main form.

    Under costs by which the rules always win (`cuts_are_harmless`, as the production costs) no path can take another
    reading, so each text is read by the rules, without chains; under other costs the cheapest path along whole chains
    decides.

    tables: (name, df, arguments of `chains` besides df and code). Null, empty and unreadable texts give no row;
    repeated rows are separate records; an empty table gives no rows; columns other than those named are ignored.
    """
    if cuts_are_harmless(costs or COSTS):
        return reduce(DataFrame.unionByName, [_by_rules(df, name, how["key"], how["text"], how["zone"]) for name, df, how in tables])
    rows = reduce(DataFrame.unionByName, [chains(df, code, **(how | {"span": None})) for code, (_, df, how) in enumerate(tables)])
    out = resolved_in_order(rows, costs)
    names = F.create_map(*[F.lit(x) for code, (name, _, _) in enumerate(tables) for x in (code, name)])
    return out.where(F.col("kind") != 0).select(names[F.col("table_code")].alias("table_name"), "record_key", F.col("us").alias("utc_micros"))


def instant_column(df: DataFrame, text: str, zone: str | None, out: str) -> DataFrame:
    """df with the instant a text states by the fixed rules as microseconds, null if unreadable."""
    had = df.columns
    read = with_reading(df, text, zone, out="zz")
    return read.select(*had, F.col("zz_utc").alias(out))


def settled_by_order(tables: list[tuple[str, DataFrame, dict]], costs: dict[str, float]) -> DataFrame:
    """table_name, n_ambiguous (records with several valid readings) and n_as_stated (of them those where the path along
    the records' order takes the reading that the fixed rules state): how far the order alone settles a text."""
    rows = None
    for code, (_, df, how) in enumerate(tables):
        part = chains(df, code, **(how | {"span": None}))
        rows = part if rows is None else rows.unionByName(part)
    out = resolved_in_order(rows, costs).where("n_readings > 1")
    names = F.create_map(*[F.lit(x) for code, (name, _, _) in enumerate(tables) for x in (code, name)])
    return out.groupBy(names[F.col("table_code")].alias("table_name")).agg(F.count("*").alias("n_ambiguous"), F.count_if(F.col("us") == F.col("by_rules")).alias("n_as_stated"))


__all__ = ["COSTS", "best_path", "chains", "cuts_are_harmless", "instant_column", "normalised", "readings", "resolved", "resolved_in_order", "settled_by_order"]
