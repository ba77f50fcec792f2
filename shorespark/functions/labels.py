"""Identifiers, links and labels as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbered(prefix: str, number: Column, width: int) -> Column:
    """prefix and the number with leading zeros, as in T001 or PG-07; longer numbers keep all digits."""
    n = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0")))


def osm_id(kind: Column, number: Column) -> Column:
    return F.concat_ws("/", kind, number.cast("string"))


def consensus_group(ids: Column) -> Column:
    """'consensus:a,b' of an array of scene ids in their order; the id itself if there is one only."""
    return F.when(F.size(ids) > 1, F.concat(F.lit("consensus:"), F.array_join(ids, ","))).otherwise(F.get(ids, F.lit(0)))


def map_link(lat: Column, lon: Column) -> Column:
    """A link that opens a place on a map, with seven decimals."""
    return F.format_string("https://www.openstreetmap.org/?mlat=%.7f&mlon=%.7f", lat, lon)


def elevation_label(metres: Column, unknown: str = "sin dato") -> Column:
    return F.when(metres.isNull() | F.isnan(metres), unknown).otherwise(F.format_string("%.1f m", metres))


def by_name(level: Column, names: dict[str, str], other: str) -> Column:
    """The label of a level, compared without letter case and outer blanks; `other` for unknown and null levels."""
    low = F.lower(F.trim(level))
    out = None
    for name, label in names.items():
        out = F.when(low == name, label) if out is None else out.when(low == name, label)
    return out.otherwise(other) if out is not None else F.lit(other)


def by_part(level: Column, names: dict[str, str], other: str) -> Column:
    """The label (or colour) of the first name that occurs in a level, compared without letter case; else `other`."""
    low = F.lower(level)
    out = F.lit(other)
    for name, label in reversed(names.items()):
        out = F.when(low.contains(name), label).otherwise(out)
    return out


def hectares(square_metres: Column) -> Column:
    return square_metres / 10_000


def is_subset(a: Column, b: Column) -> Column:
    """All values of the array a occur in b."""
    return F.size(F.array_except(a, b)) == 0
