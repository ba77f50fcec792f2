import math
import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from shorespark.operators.spikes import Rules, components, implausible, robust_components

SCHEMA = "s string, o int, k long, v double, t double, extra string"


def brute(rows, limit=1000.0):
    found = set()
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s and r[3] is not None and not math.isnan(r[3])]
        if not own:
            continue
        xs = [r[3] - r[4] for r in own]
        m = median(xs)
        mad = median(abs(x - m) for x in xs)
        found |= {r[2] for r, x in zip(own, xs) if abs(x - m) > 8 * 1.4826 * mad or abs(r[3]) > limit}
        steps = {}
        for r in sorted(own, key=lambda r: r[2]):
            if r[1] is not None:
                steps.setdefault(r[1], r[3])
        run = []
        for o in sorted(steps):
            if run and steps[run[-1]] != steps[o]:
                run = []
            run.append(o)
            if len(run) >= 6:
                found |= {r[2] for r in own if r[1] in run and r[3] == steps[r[1]]}
    return found


def data(seed, n=400, sources=3):
    rnd = random.Random(seed)
    rows, k = [], 0
    for i in range(sources):
        base = rnd.uniform(-50, 50)
        for o in range(n):
            v = base + rnd.gauss(0, 2)
            if rnd.random() < 0.02:
                v += rnd.choice([-1, 1]) * rnd.uniform(20, 400)
            if rnd.random() < 0.01:
                v = 5000.0
            if 100 <= o < 108:
                v = base
            if rnd.random() < 0.03:
                v = None
            rows.append((f"S{i}", o, k, v, 0.1 * o, "x"))
            k += 1
            if rnd.random() < 0.05:
                rows.append((f"S{i}", o, k, v, 0.1 * o, "x"))
                k += 1
    rows += [(None, 1, k, 4.0, 0.0, "x"), (None, 2, k + 1, 2000.0, 0.0, "x"), ("S0", None, k + 2, float("nan"), 0.0, "x"), ("flat", 1, k + 3, 1.0, 0.0, "x")]
    rows += [("flat", i, k + 3 + i, 1.0 if i != 4 else 1.5, 0.0, "x") for i in range(2, 6)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = implausible(df, "s", "o", "k", {"v": (F.col("v"), F.col("v") - F.col("t"), 1000.0)}, **kw).collect()
    assert len(got) == len({r.record_key for r in got})
    return {r.record_key for r in got}


def test_equals_brute_force(spark):
    rows = data(1)
    assert run(spark, rows) == brute(rows)


def test_large_sources_equal_ordinary_ones(spark):
    rows = data(2, n=700, sources=2) + [("S1", 5, 100_000 + i, 3.5, 0.5, "x") for i in range(300)]  # many copies of one reading
    assert run(spark, rows, limit=100) == brute(rows)


def large(same, nulls=(), copies=0):
    """One source of 600 order values with equal readings at `same`, nulls at `nulls` and copies of the reading at 300."""
    rnd = random.Random(3)
    rows = [("S", o, o, 7.25 if o in same else None if o in nulls else rnd.gauss(0, 2), 0.0, "x") for o in range(600)]
    return rows + [("S", 300, 1000 + i, *rows[300][3:]) for i in range(copies)]


def test_runs_across_a_skipped_block(spark):
    crowded = large(range(296, 304), copies=250)  # the crowded order value skips a block number
    assert {296, 299, 300, 303, 1000} <= brute(crowded) and run(spark, crowded, limit=100) == brute(crowded)
    hollow = large([*range(196, 200), *range(400, 404)], nulls=range(200, 400))  # a block of nulls has no edge
    assert {196, 403} <= brute(hollow) and run(spark, hollow, limit=100) == brute(hollow)


def test_infinities_do_not_move_large_medians(spark):
    rows = [(*r[:3], math.inf if r[1] % 5 < 2 else 25.0 if r[1] == 303 else r[3], *r[4:]) for r in large([])]
    got = run(spark, rows, limit=100)
    assert 303 in got and got == run(spark, rows)


def test_empty_and_all_null(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", 1, 1, None, 0.0, "x"), ("a", None, 2, None, None, None)]) == set()


def test_components_keep_spikes_sparse():
    rnd = np.random.default_rng(0)
    z = rnd.normal(0, 1, (5, 9, 16))
    z[:, 3, 4] = 30
    z[1, :, 0] = 12  # a whole profile column off
    low, sparse = robust_components(z, np.ones(z.shape, bool), Rules())
    assert (np.abs(low) <= 3).all()
    assert (sparse[np.abs(z) > 8] != 0).all()
    assert (sparse != 0).mean() < 0.05


def test_any_number_of_blocks(spark):
    rnd = random.Random(7)
    rows = [("S", o, o, 7.25 if 300 <= o < 309 or 1500 <= o < 1506 else rnd.gauss(0, 2) + (90 if o % 211 == 5 else 0), 0.0, "x") for o in range(3000)]
    rows += [("S", 700, 10_000 + i, rnd.gauss(0, 2) + (500 if i % 40 == 0 else 0), 0.0, "x") for i in range(200)]  # different readings of one order value
    rows += [("S", None, 20_000 + i, rnd.gauss(0, 2), 0.0, "x") for i in range(60)]
    got = run(spark, rows, limit=8)  # over 400 blocks, and an order value of more than a block
    assert got == brute(rows) and {10_000, 300, 308, 1500} <= got


def test_components_of_large_sources_and_the_rule(spark):
    rows = data(4, n=500, sources=2)
    df = spark.createDataFrame(rows, SCHEMA)
    fields = {"v": (F.col("v"), F.col("v") - F.col("t"), 1000.0)}
    for limit in (200_000, 150):
        c = components(df, "s", "o", "k", fields, limit=limit).collect()
        assert len(c) == len({r.record_key for r in c}) == sum(r[3] is not None and not math.isnan(r[3]) for r in rows)
        rule, sparse = ({r.record_key for r in c if r[f]} for f in ("rule", "sparse"))
        assert len(rule & sparse) >= 0.9 * max(len(rule), len(sparse))
