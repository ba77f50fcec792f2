import random
import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from shorespark.functions.timestamps import with_reading
from shorespark.operators import clocks
from shorespark.plans import problems

EPOCH = datetime(1970, 1, 1)
MONTHS = {m: i for i, m in enumerate("ene feb mar abr may jun jul ago sep oct nov dic".split(), 1)} | {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def brute(text, zone):
    """An independent reading of one text by the stated rules, or None."""
    s = (text or "").strip()
    if re.fullmatch(r"\d{10}", s):
        return int(s) * 10**6
    if re.fullmatch(r"\d{13}", s):
        return int(s) * 1000
    off = None
    m = re.search(r"(?:(?<=\d)|(?<=\d ))(Z|UTC|CLST|CLT|[+-]\d\d:?\d\d)$", s)
    if m and ":" in s[: m.start()] or m and re.match(r"\d{8}T", s) or m and re.match(r"\d{4}-\d{3}T", s):
        z = m[1]
        off = {"Z": 0, "UTC": 0, "CLT": -240, "CLST": -180}.get(z)
        if off is None:
            d = re.sub(r"\D", "", z)
            off = (-1 if z[0] == "-" else 1) * (int(d[:2]) * 60 + int(d[2:]))
        s = s[: m.start()].strip()
    s = re.sub(r"^[A-Z][a-z]{2}, ", "", s)
    half = None
    if m2 := re.search(r" (AM|PM)$", s):
        half, s = m2[1], s[:-3]
    date, _, clock = s.partition("T") if re.match(r"[\d-]+T", s) else re.match(r"(.*?)( |$)(\d{1,2}:.*|$)", s).groups()
    try:
        if x := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", date) or re.fullmatch(r"(\d{4})(\d\d)(\d\d)", date):
            day = datetime(*map(int, x.groups()))
        elif x := re.fullmatch(r"(\d{4})-(\d{3})", date):
            day = datetime(int(x[1]), 1, 1) + timedelta(days=int(x[2]) - 1)
            if day.year != int(x[1]):
                return None
        elif x := re.fullmatch(r"(\d\d?)[/.-](\d\d?)[/.-](\d{4})", date):
            day = datetime(int(x[3]), int(x[2]), int(x[1]))
        elif x := re.fullmatch(r"(\d\d?) (?:de )?([A-Za-z]+) (?:de )?(\d{4})", date):
            day = datetime(int(x[3]), MONTHS[x[2].lower()[:3]], int(x[1]))
        else:
            return None
        us = 0
        if clock:
            x = re.fullmatch(r"(\d\d):?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?", clock)
            h = int(x[1]) % 12 + 12 * (half == "PM") if half else int(x[1])
            t = day.replace(hour=h, minute=int(x[2]), second=int(x[3] or 0))
            us, day = int((x[4] or "0")[:6].ljust(6, "0")), t
    except (ValueError, TypeError, KeyError):
        return None
    if off is None:
        z = ZoneInfo(zone or "UTC")
        off = day.replace(tzinfo=z, fold=0).utcoffset() // timedelta(minutes=1)  # fold 0: the first, or the offset before a jump
    return ((day - EPOCH) // timedelta(microseconds=1)) + us - off * 60_000_000


CASES = [
    ("2017-01-11 14:39:30+00:00", None), ("2017-01-14T11:53:33", "America/Santiago"), ("01/02/2019 14:44:23", "Europe/Madrid"), ("31-03-2024 08:31", "UTC"),
    ("2017-01-21T11:42:52-03:00", "UTC"), ("2017-01-12 11:19:51-0300", None), ("20170119T145310Z", None), ("2017-01-17T14:46:08.036123999Z", None), ("1485875073", "Europe/Madrid"),
    ("1484749002123", None), ("01.01.2018 14:24 UTC", "America/Santiago"), ("2017-01-29 12:03:11 CLST", None), ("2017-05-14 10:36:57 CLT", None), ("2017-01-26 14:31:09,539Z", None),
    ("01/01/2021 12:34:01 PM", None), ("01/03/2021 12:34:59 AM", "Europe/Madrid"), ("2017-030T14:37:39Z", None), ("2020-366T14:37:39Z", None), ("2019-366T14:37:39Z", None),
    ("10 jul 2019 11:44:34", "Europe/Madrid"), ("1 de septiembre de 2021", "America/Santiago"), ("20170225", "America/Punta_Arenas"), ("2017-01-23", "America/Santiago"), ("Tue, 10 Mar 2020 11:23:09 -0300", "UTC"),
    ("2025-04-05 23:30:00", "America/Santiago"), ("2025-09-07 00:30:00", "America/Santiago"), ("26/10/2025 02:30:00", "Europe/Madrid"), ("30/03/2025 02:30:00", "Europe/Madrid"),
    ("29/02/2020 10:00:00", None), ("29/02/2021 10:00:00", None), ("0000-00-00 00:00:00", None), ("2019-13-45 25:61:00", None), ("pendiente", None), ("14/11", None), ("", None), (None, "UTC"), ("  2017-01-23  ", None),
]


def test_readings_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(CASES)], "i int, t string, z string")
    got = {r.i: r.r_utc for r in with_reading(df, "t", "z").collect()}
    assert {i: g for i, g in got.items() if g != brute(*CASES[i])} == {}
    assert got[CASES.index(("pendiente", None))] is None


def test_test_tables_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    for t, c in (("storm_scene_join", "acquired_at"), ("tide_corrections", "acquired_at_utc"), ("marejadas_oficiales_armada", "issued_date")):
        df = spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("t"), F.col("clock_zone").alias("z")).distinct()
        rows = with_reading(df, "t", "z").select("t", "z", "r_utc", "r_main").collect()
        bad = [(r.t, r.z, r.r_utc, brute(r.t, r.z)) for r in rows if not r.r_main and r.r_utc != brute(r.t, r.z)]
        assert rows and bad == []


def test_unknown_zone_is_unreadable(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00", "No/Where"), ("2020-01-01 10:00:00Z", "No/Where")], "t string, z string")
    assert sorted((r.r_utc is None) for r in with_reading(df, "t", "z").collect()) == [False, True]


def test_path_follows_order_when_rules_are_cheap():
    day = 86_400_000_000
    path = lambda costs: clocks.best_path([[10 * day, 40 * day]], [[4, 7]], [[0.0, costs["against_rules"]]], (4, 39 * day), (4, 41 * day), costs)
    assert path({"against_rules": 1000.0, "switch": 1.0, "backwards": 5.0}) == [0]
    assert path({"against_rules": 0.5, "switch": 1.0, "backwards": 5.0}) == [1]


def test_resolved_does_not_depend_on_cuts(spark):
    rows = [(f"s{i % 3}", i, i, f"{1 + i % 12:02d}/{1 + i // 40 % 12:02d}/2020 10:00:00", None, "clash") for i in range(900)]
    rows += [("s0", 5, 2000 + i, "01/02/2020 10:00:00", "Europe/Madrid", "c") for i in range(50)]
    df = spark.createDataFrame(rows, "source string, ord int, key long, text string, zone string, chain string")
    how = dict(source="source", order="ord", key="key", text="text", zone="zone", span=100)
    a = {tuple(r) for r in clocks.resolved(clocks.chains(df, 0, **how)).collect()}
    b = {tuple(r) for r in clocks.resolved(clocks.chains(df, 0, limit=20, **how), hold=3).collect()}
    assert a == b and len(a) == 950
    assert all(u == brute(rows[k][3], None) for _, k, u, _, _ in a if k < 900)


def test_empty_table(spark):
    df = spark.createDataFrame([], "s string, o int, k long, t string, z string")
    how = dict(source="s", order="o", key="k", text="t", zone="z", span=10)
    assert clocks.normalised([("x", df, how)]).collect() == []


def test_whole_chains_are_cheapest_for_any_costs(spark):
    rnd = random.Random(3)
    day = 86_400_000_000
    texts = [(f"s{i % 2}", i // 2, i, f"{1 + rnd.randint(0, 11):02d}/{1 + rnd.randint(0, 11):02d}/2020" if rnd.random() < 0.8 else f"2020-{1 + i % 12:02d}-15", None, "c") for i in range(240)]
    df = spark.createDataFrame(texts, "source string, ord int, key long, text string, zone string, chain string")
    rows = clocks.chains(df, 0, source="source", order="ord", key="key", text="text", zone="zone")
    costs = {"against_rules": 0.3, "switch": 0.4, "backwards": 1.0}
    listed = {}
    for r in rows.collect():
        listed.setdefault(r.chain, []).append((r.ord, r.record_key, [(r.r_utc, r.r_kind, 0.0)] + [(o.us, o.kind, costs["against_rules"]) for o in r.r_others or []]))

    def price(path):
        return sum(c for _, _, c in path) + sum(costs["switch"] * (a[1] != b[1]) + costs["backwards"] * (b[0] < a[0]) for a, b in zip(path, path[1:]))

    for limit in (100_000, 7):
        got = {r.record_key: (r.us, r.kind) for r in clocks.resolved_in_order(rows, costs, limit=limit).collect()}
        assert len(got) == 240
        for chain in listed.values():
            chain.sort(key=lambda r: r[:2])
            options = [o for _, _, o in chain]
            best = clocks.best_path([[u for u, _, _ in o] for o in options], [[k for _, k, _ in o] for o in options], [[c for _, _, c in o] for o in options], costs=costs)
            taken = [next(x for x in o if x[:2] == got[k]) for _, k, o in chain]
            assert abs(price(taken) - price([o[j] for o, j in zip(options, best)])) < 1e-9


def test_order_settles_day_and_month(spark):
    day = lambda i: (datetime(2020, 1, 3) + timedelta(days=5 * i))
    rows = [("s", i, i, day(i).strftime("%d/%m/%Y 10:00:00" if i % 4 else "%Y-%m-%d 10:00:00"), None) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, ord int, key long, text string, zone string")
    got = clocks.settled_by_order([("x", df, dict(source="source", order="ord", key="key", text="text", zone="zone", span=9))], {"against_rules": 0.001, "switch": 0.01, "backwards": 1.0}).collect()
    assert len(got) == 1 and got[0].n_ambiguous > 40 and got[0].n_as_stated >= 0.95 * got[0].n_ambiguous
    with pytest.raises(ValueError):
        clocks.resolved(clocks.chains(df, 0, source="source", order="ord", key="key", text="text", zone="zone"), {"against_rules": 1.0, "switch": 1.0, "backwards": 1.0})


def _no_path(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" not in plan and "InArrow" not in plan


def test_rules_run_no_path_and_lose_no_row(spark):
    odd = [*CASES, ("2020-01-01 10:00:00", "No/Where"), ("2020-01-01 10:00:00+00:00", None), ("02/01/2020 10:00:00", None), ("02/01/2020 10:00:00", None)]
    rows = [(f"s{i % 2}", i // 2, i, t, z) for i, (t, z) in enumerate(odd)] + [(None, None, 99, "03/04/2020", None)]
    df = spark.createDataFrame(rows, "source string, ord int, key long, text string, zone string")
    how = dict(source="source", order="ord", key="key", text="text", zone="zone", span=10)
    got = clocks.normalised([("x", df, how), ("y", df, how | {"zone": None})])
    assert _no_path(got)
    for name, h in (("x", how), ("y", how | {"zone": None})):
        path = clocks.resolved(clocks.chains(df, 0, **h)).collect()
        assert any(r.n_readings > 1 for r in path)
        assert sorted((r.record_key, r.utc_micros) for r in got.where(F.col("table_name") == name).collect()) == sorted((r.record_key, r.us) for r in path if r.kind != 0)
    known = {r.record_key: r.utc_micros for r in got.where("table_name = 'x'").collect()}
    assert known == {k: brute(t, z) for _, _, k, t, z in rows if z != "No/Where" and brute(t, z) is not None and not (t or "").endswith("+00:00")}


def test_p5_found_runs_no_path(spark):
    assert _no_path(problems.p5_found(spark, "/root/testdata/sf0.001"))


def test_normalised_by_order_takes_the_path(spark):
    texts = ["2020-01-10 10:00:00", "02/01/2020 10:00:00", "2020-02-10 10:00:00"]  # 1 February lies between, 2 January does not
    df = spark.createDataFrame([("s", i, i, t, None) for i, t in enumerate(texts)], "source string, ord int, key long, text string, zone string")
    tables = [("x", df, dict(source="source", order="ord", key="key", text="text", zone="zone", span=9))]
    at = lambda costs: {r.record_key: EPOCH + timedelta(microseconds=r.utc_micros) for r in clocks.normalised(tables, costs).collect()}[1]
    assert at(None) == datetime(2020, 1, 2, 10)
    assert at({"against_rules": 0.001, "switch": 0.01, "backwards": 1.0}) == datetime(2020, 2, 1, 10)
