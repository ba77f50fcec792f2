import random
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shorespark.operators.intervals import IntervalMap, day_spans, says_yes
from shorespark.operators.snapshots import changes, folded

DAY0 = date(2020, 1, 1)


def brute(rows):
    out = set()
    for e in {r[0] for r in rows}:
        days = set()
        for _, a, b in (r for r in rows if r[0] == e):
            if a and b and a <= b:
                days |= {a + timedelta(i) for i in range((b - a).days + 1)}
        if not days:
            continue
        kind = None
        for i in range((max(days) - min(days)).days + 1):
            d = min(days) + timedelta(i)
            now = "period" if d in days else "gap"
            if now != kind:
                start, kind = d, now
            last = d
            nxt = d + timedelta(1)
            if nxt > max(days) or ("period" if nxt in days else "gap") != kind:
                out.add((e, kind, start, last))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), max_size=25))
def test_map_equals_sets(spans):
    m, days = IntervalMap(), set()
    for a, n in spans:
        m.insert(a, a + n)
        days |= set(range(a, a + n + 1))
    assert {d for a, b in zip(m.starts, m.ends) for d in range(a, b + 1)} == days
    assert all(b + 1 < a for b, a in zip(m.ends, m.starts[1:]))
    assert {d for a, b in m.gaps() for d in range(a, b + 1)} == (set(range(min(days), max(days) + 1)) - days if days else set())


def test_spans_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        a = DAY0 + timedelta(rnd.randint(0, 300))
        b = a + timedelta(rnd.randint(-2, 6))
        rows.append((rnd.choice(["a", "a", "a", "b", None]), a if rnd.random() > 0.03 else None, b if rnd.random() > 0.03 else None))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "e string, a date, b date").repartition(3)
    for limit in (200_000, 5):
        got = [tuple(r) for r in day_spans(df, "e", "a", "b", limit).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("b", DAY0, DAY0 - timedelta(1))], "e string, a date, b date")
    assert day_spans(df, "e", "a", "b").collect() == []
    assert day_spans(df.limit(0), "e", "a", "b").collect() == []


def test_yes(spark):
    df = spark.createDataFrame([(x,) for x in [" TRUE", "sí", "Si", "1", "Verdadero", "no", "0", None, "", "falso", "f"]], "x string")
    assert [r[0] for r in df.select(says_yes(F.col("x"))).collect()] == [True] * 5 + [False] * 6


def test_stream_keeps_the_map(spark, tmp_path):
    from shorespark.streaming.intervals import streaming_day_spans

    rnd = random.Random(5)
    rows = [("abc"[i % 3], DAY0 + timedelta(x := rnd.randint(0, 90)), DAY0 + timedelta(x + rnd.randint(0, 5))) for i in range(90)]
    schema = "e string, a date, b date"
    for i in range(3):
        spark.createDataFrame(rows[i * 30 : i * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, n):
        for r in batch.collect():
            now = seen.setdefault(r.entity, set())
            span = (r.span_kind, r.first, r["last"])
            now.remove(span) if r.change == "withdrawn" else now.add(span)

    q = streaming_day_spans(s, "e", "a", "b").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    d = lambda x: (x - date(1970, 1, 1)).days
    want = {(e, k, d(a), d(b)) for e, k, a, b in brute(rows)}
    assert {(e, *s) for e in "abc" for s in seen[e]} == want


def _changes(spark, rows, **kw):
    df = spark.createDataFrame(rows, "snap date, id string, level string, at int, n int, key string")
    got = changes(df, "snap", F.lower(F.trim("id")), {"level": folded(F.col("level"))}, ["at", "n"], **kw).collect()
    assert all((r.changed == "level") == (r.change_kind == "changed") for r in got)
    return sorted(tuple(r)[:3] for r in got)


def test_changes(spark):
    a, b, c = date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)
    rows = [
        (a, "w/1", "bajo", 1, 1, "x"), (b, " W/1", "Bájo ", 1, 2, "x"), (c, "w/1", None, 1, 3, "x"),
        (a, "w/2", "bajo", 1, 4, "x"), (a, "w/2", "alto", 2, 5, "x"), (b, "w/2", "bajo", 1, 6, "x"),
        (b, "w/3", None, None, 7, "x"), (c, "w/3", None, 1, 8, "x"), (c, "w/3", None, 1, 8, "x"),
        (a, "w/4", "alto", 1, 9, "x"), (c, "w/4", "alto", 1, 10, "x"),
        (a, None, "alto", 1, 11, "x"), (None, "w/5", "alto", 1, 12, "x"), (a, "", "alto", 1, 13, "x"),
    ]
    want = [(b, "w/2", "changed"), (b, "w/3", "added"), (b, "w/4", "removed"), (c, "w/1", "changed"), (c, "w/2", "removed"), (c, "w/4", "added")]
    assert _changes(spark, rows) == want
    assert _changes(spark, rows, ranges=3) == want
    assert _changes(spark, []) == []
    assert _changes(spark, rows[:1]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_random(spark, seed):
    rnd = random.Random(seed)
    snaps = [DAY0 + timedelta(30 * i) for i in range(4)]
    rows = [(s, f"k{rnd.randint(0, 60)}", rnd.choice(["a", "b", None]), rnd.randint(0, 5), i, "x") for i in range(150) for s in [rnd.choice(snaps)]]
    best = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        best[(r[0], r[1])] = r[2]
    want = []
    for p, n in zip(snaps, snaps[1:]):
        ks = {k for s, k in best if s in (p, n)}
        for k in ks:
            o, w = (p, k) in best, (n, k) in best
            if o != w or best[(p, k)] != best[(n, k)]:
                want.append((n, k, "added" if not o else "removed" if not w else "changed"))
    assert _changes(spark, rows) == sorted(want)
