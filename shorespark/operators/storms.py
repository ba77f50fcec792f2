"""Association of positions with storm intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorespark.operators.intervals import spans

DAY = 86_400_000_000
YEAR = 365.2425 * DAY


def interval_join(left: DataFrame, instant: str, right: DataFrame, first: str, last: str, on: list[str], bucket: int, how: str = "inner") -> DataFrame:
    """left x right where the keys `on` are equal and first <= instant <= last (microseconds, both ends included).

    Intervals are given to every bucket of time they touch and an equi-join on (keys, bucket) is refined; so neither
    side is joined with all of the other, and each pair is met in exactly one bucket, that of the instant.
    """
    l = left.withColumn("_b", F.floor(F.col(instant) / bucket))  # noqa: E741
    r = right.where(F.col(first) <= F.col(last)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.col(last) / bucket))))
    names = {k: f"_r_{k}" for k in on}
    r = r.withColumnsRenamed(names)
    cond = (l["_b"] == r["_b"]) & (l[instant] >= r[first]) & (l[instant] <= r[last])
    for k in on:
        cond = cond & (l[k] == r[names[k]])
    return l.join(r, cond, how).drop(r["_b"], *names.values()).drop("_b")


def tagged(scenes: DataFrame, key: str, instant: str, events: DataFrame, event: str, start: str, end: str, on: list[str], window_days: int = 3) -> DataFrame:
    """scenes with official_storm_event (0/1), official_event_count, official_event_ids (by start, then id, joined by
    ';', '' if none), nearest_official_event_days (null without events or instant) and storm_join_window_days.

    An event counts if the instant lies in [start - window, end + window]; the distance is to the unpadded interval, 0
    inside. The key must be unique. Distances come from the periods and gaps into which the events divide time, so
    they need neither a cross join nor a sort of a whole sector.
    """
    pad = window_days * DAY
    ev = events.select(*on, F.col(event).alias("_id"), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_s <= _e").distinct()
    base = scenes.select(key, *on, F.col(instant).alias("_t"))
    hits = interval_join(base.where("_t IS NOT NULL"), "_t", ev.withColumns({"_f": F.col("_s") - pad, "_l": F.col("_e") + pad}), "_f", "_l", on, 64 * DAY)
    each = hits.groupBy(key).agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("_s", "_id"))).alias("ids"))
    ids = each.select(key, "n", F.array_join(F.transform("ids", lambda x: x["_id"]), ";").alias("ids"))
    name = F.concat_ws("\x1f", *on) if on else F.lit("")
    parts = spans(ev.select(name.alias("entity"), F.col("_s").alias("first"), F.col("_e").alias("last")))
    # time before the first and after the last event of an entity, as far as the scenes reach
    reach = base.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    ends = parts.where("span_kind = 'period'").groupBy("entity").agg(F.min("first").alias("a"), F.max("last").alias("b")).crossJoin(F.broadcast(reach))  # one row on the right
    outer = ends.select("entity", F.lit("before").alias("span_kind"), "lo", (F.col("a") - 1).alias("hi")).unionByName(ends.select("entity", F.lit("after").alias("span_kind"), (F.col("b") + 1).alias("lo"), "hi"))
    whole = parts.select("entity", "span_kind", F.col("first").alias("lo"), F.col("last").alias("hi")).unionByName(outer)
    placed = interval_join(base.withColumn("entity", name).where("_t IS NOT NULL"), "_t", whole, "lo", "hi", ["entity"], 64 * DAY)
    t = F.col("_t")
    far = F.when(F.col("span_kind") == "period", 0).when(F.col("span_kind") == "before", F.col("hi") + 1 - t).when(F.col("span_kind") == "after", t - F.col("lo") + 1).otherwise(F.least(t - F.col("lo") + 1, F.col("hi") + 1 - t))
    nearest = placed.select(key, (far / DAY).alias("days"))
    out = scenes.join(ids, key, "left").join(nearest, key, "left")
    return out.select(
        *scenes.columns, F.when(F.col("n").isNull(), 0).otherwise(1).alias("official_storm_event"), F.coalesce("n", F.lit(0)).alias("official_event_count"),
        F.coalesce("ids", F.lit("")).alias("official_event_ids"), F.col("days").alias("nearest_official_event_days"), F.lit(window_days).alias("storm_join_window_days"),
    )


def anomalies(df: DataFrame, keys: list[str], instant: str, position: str) -> DataFrame:
    """keys, instant, position_m (median of its readings), position_trend_m and position_anomaly_m.

    The trend is the least-squares line over the years since the first instant; groups of fewer than three instants
    have none. Null readings and instants are left out.
    """
    m = df.where(F.col(instant).isNotNull() & F.col(position).isNotNull()).groupBy(*keys, F.col(instant).alias("t")).agg(F.median(position).alias("position_m"))
    first = m.groupBy(*keys).agg(F.min("t").alias("t0"))
    y = m.join(first, keys).withColumn("y", (F.col("t") - F.col("t0")) / YEAR)
    fit = y.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("position_m", "y").alias("b"), F.avg("position_m").alias("mp"), F.avg("y").alias("my"))
    trend = F.when(F.col("n") >= 3, F.col("mp") + F.col("b") * (F.col("y") - F.col("my")))
    return y.join(fit, keys).select(*keys, F.col("t").alias(instant), "position_m", trend.alias("position_trend_m"), (F.col("position_m") - trend).alias("position_anomaly_m"))


def _gamma_ratio(a: Column) -> Column:
    """log of Gamma(a + 1/2) / Gamma(a), by its asymptotic series 16 further on; no digits are lost for great a."""
    z = a + 16
    tail = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + 17 / (14336 * F.pow(z, 7))
    for k in range(16):
        tail = tail - F.log1p(0.5 / (a + k))
    return tail


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t: the regularised incomplete beta function I_x(df/2, 1/2) at x = df / (df + t^2), by its
    continued fraction, at every number of degrees of freedom. The fraction takes as many steps as it needs to settle,
    which grow with the root of df. Null below one degree of freedom."""
    n, t2 = df.cast("double"), t * t
    x, y = n / (n + t2), t2 / (n + t2)
    low = x < (n / 2 + 1) / (n / 2 + 2.5)
    a, b, v = F.when(low, n / 2).otherwise(0.5), F.when(low, 0.5).otherwise(n / 2), F.when(low, x).otherwise(y)
    s = F.struct(a.alias("a"), b.alias("b"), v.alias("v"))
    d0 = F.try_divide(F.lit(1.0), 1 - (a + b) * v / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"), s.alias("s"))
    one = lambda z: F.coalesce(F.try_divide(F.lit(1.0), z), F.lit(1e300))

    def step(acc: Column, m: Column) -> Column:
        p, q, u = acc["s"]["a"], acc["s"]["b"], acc["s"]["v"]
        even = m * (q - m) * u / ((p - 1 + 2 * m) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 1 + 2 * m))
        return F.transform(F.array(F.struct(one(1 + even * acc["d"]).alias("d"), (1 + even / acc["c"]).alias("c"))), lambda e: F.transform(
            F.array(F.struct(one(1 + odd * e["d"]).alias("d"), (1 + odd / e["c"]).alias("c"))),
            lambda o: F.struct(o["c"].alias("c"), o["d"].alias("d"), (acc["h"] * e["d"] * e["c"] * o["d"] * o["c"]).alias("h"), acc["s"].alias("s")),
        )[0])[0]

    steps = F.sequence(F.lit(1), (F.lit(60) + F.ceil(4 * F.sqrt(n))).cast("int"))
    fraction = F.aggregate(steps, start, step, lambda acc: acc["h"])
    front = F.exp(n / 2 * F.log1p(-y) + F.log(y) / 2 + _gamma_ratio(n / 2) - F.log(F.pi()) / 2)
    tail = front * fraction / a
    return F.when(df < 1, None).when(t2 == 0, 1.0).when(low, tail).otherwise(1 - tail)


def point_biserial(df: DataFrame, response: str, event: str, keys: list[str] | None = None) -> DataFrame:
    """n, n_event, n_no_event, correlation_r, p_value and status of the correlation of a number with a 0/1 class.

    INSUFFICIENT_DATA if there are fewer than five pairs, other classes than 0 and 1, fewer than two of either, or
    one response only. Pairs with a null are left out.
    """
    keys = keys or []
    d = df.select(*keys, F.col(response).cast("double").alias("y"), F.col(event).cast("double").alias("x")).where("y IS NOT NULL AND x IS NOT NULL AND NOT isnan(y)")
    g = d.groupBy(*keys) if keys else d.groupBy()
    a = g.agg(
        F.count("*").alias("n"), F.count_if(F.col("x") == 1).alias("n_event"), F.count_if(F.col("x") == 0).alias("n_no_event"),
        F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"), (F.min("y") < F.max("y")).alias("varied"),
    )
    enough = (F.col("n") >= 5) & (F.col("n_event") + F.col("n_no_event") == F.col("n")) & (F.col("n_event") >= 2) & (F.col("n_no_event") >= 2) & F.coalesce("varied", F.lit(False))
    r = F.when(enough, F.col("r"))
    t = F.try_divide(r * F.sqrt(F.col("n") - 2.0), F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)))
    p = student_p(t, F.greatest(F.lit(1), F.col("n") - 2))
    status = F.when(~enough, "INSUFFICIENT_DATA").when(r.isNull() | F.isnan(r), "INVALID_NUMERICAL_RESULT").otherwise("OK")
    return a.select(*keys, "n", "n_event", "n_no_event", r.alias("correlation_r"), F.when(enough, F.when(F.abs(r) >= 1, 0.0).otherwise(p)).alias("p_value"), status.alias("status"))
