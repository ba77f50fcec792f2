"""Overlapping and gapped day intervals per entity: continuous periods and the gaps between them.

An ordered map of disjoint intervals is kept per entity; each insertion finds its overlaps by binary search, merges
them and so updates the gaps. The map is filled inside each input partition, which leaves at most the disjoint
periods of each entity to shuffle, over groups of partitions, and per entity over those. A streaming form keeps the map as state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual English and Spanish spellings of a true boolean.
YES = ("true", "t", "yes", "y", "1", "si", "sí", "s", "verdadero", "v", "cierto", "on")


SALTS = 32  #: tasks that merge an entity's maps before the last one


def says_yes(text: Column) -> Column:
    """True where a text says yes in a usual English or Spanish spelling, whatever its case and outer blanks."""
    return F.coalesce(F.lower(F.trim(text)).isin(*YES, "1.0"), F.lit(False))


class IntervalMap:
    """Disjoint closed intervals of whole numbers in order; intervals that touch or follow directly are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or ()), list(ends or ())

    def insert(self, start: int, end: int) -> None:
        """Adds [start, end]; O(log n) to find the overlaps and O(n) to move what follows."""
        i = bisect_left(self.ends, start - 1)  # first interval that reaches start
        j = bisect_right(self.starts, end + 1)  # behind the last one that begins by end
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def gaps(self) -> list[tuple[int, int]]:
        return [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]


def _combine(limit: int):
    schema = pa.schema([("entity", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def flush(maps: dict) -> pa.RecordBatch:
        rows = [(k, s, e) for k, m in maps.items() for s, e in zip(m.starts, m.ends)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict = {}
        seen = 0
        for b in batches:
            # in order of the starts, so that an insertion moves little
            for k, s, e in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()), key=lambda r: r[1]):
                m = maps.get(k)
                if m is None:
                    m = maps[k] = IntervalMap()
                m.insert(s, e)
            seen += len(b)
            if seen >= limit and sum(len(m.starts) for m in maps.values()) >= limit:
                yield flush(maps)
                maps, seen = {}, 0
        if maps:
            yield flush(maps)

    return run


def _spans(pdf: pd.DataFrame) -> pd.DataFrame:
    m = IntervalMap()
    for s, e in sorted(zip(pdf["first"].tolist(), pdf["last"].tolist())):
        m.insert(s, e)
    rows = [("period", s, e) for s, e in zip(m.starts, m.ends)] + [("gap", s, e) for s, e in m.gaps()]
    out = pd.DataFrame(rows, columns=["span_kind", "first", "last"])
    out.insert(0, "entity", pdf["entity"].iloc[0])
    return out


def spans(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """entity, span_kind ('period' or 'gap'), first and last of the whole-number intervals (entity, first, last).

    Closed intervals that overlap, nest or follow directly form one period; a gap lies between two consecutive periods
    of an entity. A partition keeps at most about `limit` periods before it passes them on; what one entity gathers is
    bounded by its disjoint periods in SALTS groups of partitions, never by its rows or the number of partitions.
    """
    valid = df.select(F.col("entity").cast("string").alias("entity"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).where("first IS NOT NULL AND last IS NOT NULL AND last >= first")
    schema = "entity string, first long, last long"
    partial = valid.mapInArrow(_combine(limit), schema).withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    # an entity's partial maps meet in SALTS tasks first, so the last one gathers as many maps at most
    partial = partial.repartition("entity", "_s").drop("_s").mapInArrow(_combine(limit), schema)
    return partial.groupBy("entity").applyInPandas(_spans, "entity string, span_kind string, first long, last long")


def day_spans(df: DataFrame, entity: str, start: str, end: str, limit: int = 200_000) -> DataFrame:
    """entity, span_kind ('period' or 'gap'), first_day and last_day (DATE) per entity.

    Both days belong to an interval; intervals that overlap, nest or follow on the next day form one period, a gap is
    all days between two consecutive periods. Rows with a null date or an end before the start are left out; a null
    entity is an entity of its own; repeats change nothing; an entity without valid rows and an empty table give no
    rows. Disjoint periods of an entity are also bounded by the days of the calendar.
    """
    number = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    found = spans(df.select(F.col(entity).alias("entity"), number(start).alias("first"), number(end).alias("last")), limit)
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return found.select(F.col("entity").alias(entity), "span_kind", day("first").alias("first_day"), day("last").alias("last_day"))


def usable_notices(notices: DataFrame) -> DataFrame:
    """Storm notices that affect the coast, with both dates and the end not before the start."""
    return notices.where(says_yes(F.col("affects_cartagena")) & F.col("start_date").isNotNull() & F.col("end_date").isNotNull() & (F.col("end_date") >= F.col("start_date")))
