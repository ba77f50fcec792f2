"""The interval map as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shorespark.operators.intervals import IntervalMap

_OUT = "entity string, change string, span_kind string, first long, last long"
_STATE = "starts array<long>, ends array<long>"


def _spans(m: IntervalMap) -> set[tuple]:
    return {("period", s, e) for s, e in zip(m.starts, m.ends)} | {("gap", s, e) for s, e in m.gaps()}


def _update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*state.get) if state.exists else IntervalMap()
    old = _spans(m)
    for pdf in parts:
        for s, e in sorted(zip(pdf["first"].tolist(), pdf["last"].tolist())):
            m.insert(s, e)
    state.update((m.starts, m.ends))
    new = _spans(m)
    rows = [(key[0], "withdrawn", *x) for x in sorted(old - new)] + [(key[0], "added", *x) for x in sorted(new - old)]
    yield pd.DataFrame(rows, columns=["entity", "change", "span_kind", "first", "last"])


def streaming_day_spans(stream: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """The changes of the periods and gaps of every entity that a micro-batch touches (update mode): entity, change ('added' or
    'withdrawn', as a merge swallows periods and a new period splits a gap), span_kind, first and last day number. All
    changes so far add up to the present spans.

    State per entity is its ordered disjoint-interval map. Rows with a null date or a reversed interval are dropped.
    """
    days = stream.select(F.col(entity).cast("string").alias("entity"), F.unix_date(F.col(start).cast("date")).cast("long").alias("first"), F.unix_date(F.col(end).cast("date")).cast("long").alias("last"))
    valid = days.where("first IS NOT NULL AND last IS NOT NULL AND last >= first")
    return valid.groupBy("entity").applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
