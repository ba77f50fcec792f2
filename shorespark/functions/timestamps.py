"""Timestamp texts of many kinds as column expressions, entirely inside the JVM.

One regular expression splits a text into its parts; everything after is arithmetic on
days and microseconds, so no session setting and no Python worker takes part.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names in Spanish, English and Portuguese by their first letters.
MONTHS = {
    "ene": 1, "jan": 1, "feb": 2, "fev": 2, "mar": 3, "abr": 4, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "sep": 9, "set": 9, "oct": 10, "out": 10, "nov": 11, "dic": 12, "dec": 12, "dez": 12,
}
# Zone words in texts, as minutes east of Greenwich.
ZONE_WORDS = {"Z": 0, "UTC": 0, "GMT": 0, "CLT": -240, "CLST": -180}

MAIN_FORM = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?\+00:00$"

_DATE = (
    r"(?:(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"  # 1-3 year first
    r"|(\d{4})-(\d{3})(?!\d)"  # 4-5 day of the year
    r"|(\d{4})(\d\d)(\d\d)(?!\d)"  # 6-8 digits only
    r"|(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"  # 9-11 year last
    r"|(\d{1,2}) +(?:de +)?(\p{L}{3,10})\.?,? +(?:del? +)?(\d{4})"  # 12-14 day, month's name, year
    r"|(\p{L}{3,10})\.? +(\d{1,2}),? +(\d{4}))"  # 15-17 month's name, day, year
)
_TIME = r"(?:(?:[Tt]|,? +)(?:(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: *([AaPp])\.?[Mm]\.?)?|(\d\d)(\d\d)(\d\d)?))?"
_ZONE = r"(?: *(Z|z|UTC|GMT|CLT|CLST|[+-]\d\d:?(?:\d\d)?))?"
_WHOLE = rf"^(?:\p{{L}}{{2,10}}\.?,? +)?{_DATE}{_TIME}{_ZONE}$"
_GROUPS = 26

DAY_US = 86_400_000_000
#: Kinds of reading: the format a text is read by. Used for the format switches of `operators.clocks`.
KINDS = ("main", "year_first", "ordinal", "compact", "day_first", "named_month", "epoch", "month_first")


def known_zones() -> list[str]:
    """Region names a clock_zone may hold; any other makes a wall time unreadable."""
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))


def _days(y: Column, m: Column, d: Column) -> Column:
    return F.unix_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")).cast("long")


def _num(c: Column) -> Column:
    return c.try_cast("int")


def with_reading(df: DataFrame, text: str, zone: str | None, out: str = "r") -> DataFrame:
    """Adds what a timestamp text states, as the columns {out}_kind, {out}_us, {out}_swapped and {out}_offset.

    kind is an index into KINDS; us the wall clock in microseconds; swapped the wall clock if the month came
    first, where that is another valid date; offset the minutes of the text's own zone, null if it has none.
    us is null for null, empty and unreadable texts. zone is the clock_zone column (None: always UTC).
    {out}_utc is the instant by the fixed rules: the text's zone wins, else the wall clock is that of the zone
    column, or UTC if null; the first of a wall time that occurs twice; the offset before a jump.

    The steps are separate projections on purpose: each intermediate is used many times and computed once.
    """
    c = lambda name: F.col(f"{out}_{name}")
    given = set(df.columns)
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    words = F.create_map(*[F.lit(x) for kv in ZONE_WORDS.items() for x in kv])
    t = F.trim(F.col(text))
    df = df.withColumn(f"{out}_t", t)
    df = df.withColumn(f"{out}_main", F.coalesce(c("t").rlike(MAIN_FORM), F.lit(False)))
    replaced = F.regexp_replace(c("t"), _WHOLE, "|".join(f"${i}" for i in range(1, _GROUPS + 1)))
    df = df.withColumn(f"{out}_p", F.when(~c("main"), F.split(replaced, r"\|", -1)))
    g = lambda i: F.get(c("p"), F.lit(i - 1))
    named = lambda i: F.try_element_at(month, F.lower(F.substring(g(i), 1, 3))).cast("string")
    kind = F.when(c("main"), 0).when(
        F.size("{}_p".format(out)) == _GROUPS,
        F.when(g(9) != "", 4).when(g(1) != "", 1).when(g(6) != "", 3).when(g(4) != "", 2).when(g(12) != "", 5).otherwise(-5),
    ).when(c("t").rlike(r"^\d+$") & F.length(c("t")).isin(10, 13, 16), 6)
    df = df.withColumn(f"{out}_kind", kind)
    k = c("kind")
    pick = lambda *by: F.coalesce(*[F.when(k == i, e) for i, e in by])
    time = lambda i: F.when(g(23) != "", g(23 + i)).otherwise(g(18 + i))
    df = df.withColumns(
        {
            f"{out}_y": pick((4, g(11)), (1, g(1)), (3, g(6)), (2, g(4)), (5, g(14)), (-5, g(17))),
            f"{out}_m": pick((4, g(10)), (1, g(2)), (3, g(7)), (2, F.lit("01")), (5, named(13)), (-5, named(15))),
            f"{out}_d": pick((4, g(9)), (1, g(3)), (3, g(8)), (2, F.lit("01")), (5, g(12)), (-5, g(16))),
            f"{out}_doy": F.when(k == 2, _num(g(5))),
            f"{out}_h": F.when(k < 6, _num(time(0))),
            f"{out}_timed": (g(18) != "") | (g(23) != ""),
            f"{out}_mi": _num(time(1)),
            f"{out}_s": F.coalesce(_num(time(2)), F.lit(0)),
            f"{out}_micro": F.coalesce(_num(F.rpad(F.substring(g(21), 1, 6), 6, "0")), F.lit(0)),
            f"{out}_half": F.lower(g(22)),
            f"{out}_z": F.upper(g(26)),
        }
    )
    half = c("half")
    h24 = F.when(half == "", c("h")).when(c("h").between(1, 12), c("h") % 12 + F.when(half == "p", 12).otherwise(0))
    digits = F.regexp_replace(c("z"), "[^0-9]", "")
    minutes = _num(F.substring(digits, 1, 2)) * 60 + F.coalesce(_num(F.substring(digits, 3, 2)), F.lit(0))
    df = df.withColumns(
        {
            f"{out}_days": _days(c("y"), c("m"), c("d")) + F.when(k == 2, c("doy") - 1).otherwise(0),
            f"{out}_days2": F.when((k == 4) & (c("m") != c("d")), _days(c("y"), c("d"), c("m"))),
            f"{out}_h": h24,
            f"{out}_offset": F.when(k.isin(0, 6), 0).when(c("z") == "", None).when(
                c("z").rlike("^[+-]"), F.when(c("z").startswith("-"), -minutes).otherwise(minutes)
            ).otherwise(F.try_element_at(words, c("z"))),
        }
    )
    clock = F.when(~c("timed"), 0).when(
        c("h").between(0, 23) & c("mi").between(0, 59) & c("s").between(0, 59),
        (c("h") * 3600 + c("mi") * 60 + c("s")).cast("long") * 1_000_000 + c("micro"),
    )
    right_doy = (k != 2) | (c("doy").between(1, 365)) | ((c("doy") == 366) & (F.year(F.date_from_unix_date(c("days").cast("int"))) == _num(c("y"))))
    number = c("t").try_cast("long")
    df = df.withColumn(f"{out}_clock", clock).withColumn(f"{out}_ok", right_doy)
    df = df.withColumns(
        {
            f"{out}_us": F.when(k == 0, F.unix_micros(c("t").try_cast("timestamp")))
            .when(k == 6, F.when(F.length(c("t")) == 10, number * 1_000_000).when(F.length(c("t")) == 13, number * 1000).otherwise(number))
            .when(c("ok"), c("days") * DAY_US + c("clock")),
            f"{out}_swapped": c("days2") * DAY_US + c("clock"),
            f"{out}_kind": F.abs(k),
        }
    )
    place = F.col(zone) if zone else F.lit(None).cast("string")
    df = df.withColumn(
        f"{out}_utc",
        F.when(c("us").isNull(), None)
        .when(c("offset").isNotNull(), c("us") - c("offset").cast("long") * 60_000_000)
        .otherwise(to_utc(c("us"), place)),
    )
    names = [f"{out}_{x}" for x in ("main", "kind", "us", "swapped", "offset", "utc")]
    # The generator keeps later filters and inferred not-null conditions from being copied down through every step.
    one = F.inline_outer(F.array(F.struct(*[F.col(x) for x in names])))
    return df.select(*[x for x in df.columns if x in given], one)


def to_utc(us: Column, zone: Column) -> Column:
    """The first instant at which a wall clock of the zone shows us; a skipped wall time keeps the offset before the jump.
    Null for an unknown zone; a null zone is UTC."""
    known = F.coalesce(zone, F.lit("UTC"))
    safe = F.when(known.isin(known_zones()), known)
    return F.when(known.isin("UTC", "GMT"), us).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), safe)))
