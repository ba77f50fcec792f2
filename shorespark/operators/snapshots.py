"""What changed between consecutive full snapshots of a table.

The snapshots are range-partitioned by key and sorted inside each range; a range is then streamed once, and for each
pair of consecutive snapshots two pointers move over the sorted keys, emitting added, removed and changed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters of Spanish and Portuguese and their plain forms, letter by letter.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüñçý"
PLAIN = "aaaaaeeeeiiiiooooouuuuncy"


def folded(text: Column) -> Column:
    """A text without blanks at its ends, letter case and accents."""
    low = F.lower(F.trim(text))
    marks = F.regexp_replace(low, r"\p{Mn}+", "")
    return F.translate(marks, ACCENTED, PLAIN)


def _merge(snapshots: list[int], names: list[str]):
    """Streams rows (key, snapshot, value) sorted by key and snapshot; value holds the columns `names`."""
    after = dict(zip(snapshots, snapshots[1:]))
    before = dict(zip(snapshots[1:], snapshots))
    schema = pa.schema([("key", pa.string()), ("snapshot", pa.int32()), ("change_kind", pa.string()), ("changed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # `old` is the pointer into the earlier snapshot of a pair: the last row seen, not yet met by a later one
        old: tuple | None = None
        for b in batches:
            out: list[tuple] = []
            for key, snap, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if old is not None and old[0] == key and after.get(old[1]) == snap:  # both pointers stand on the key
                    if old[2] != value:
                        out.append((key, snap, "changed", ",".join(n for n, a, b in zip(names, old[2].split("\x1f"), value.split("\x1f")) if a != b)))
                else:
                    if old is not None and old[1] in after:  # the later snapshot has passed the old key
                        out.append((old[0], after[old[1]], "removed", ""))
                    if snap in before:
                        out.append((key, snap, "added", ""))
                old = (key, snap, value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(schema)], schema=schema)
        if old is not None and old[1] in after:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((old[0], after[old[1]], "removed", ""), schema)], schema=schema)

    return run


def changes(df: DataFrame, snapshot: str, key: Column, compared: dict[str, Column], latest: list[str], ranges: int | None = None) -> DataFrame:
    """snapshot_date (the later one), key, change_kind ('added', 'removed', 'changed') and changed (the names of the columns
    that changed, joined by commas) between consecutive snapshots.

    `compared` are the columns whose change counts; null is a value of its own. Of several rows of a key in one
    snapshot the one greatest by the `latest` columns counts (nulls lowest). Rows with a null or empty key or a null
    snapshot are left out; the first snapshot has no predecessor; with no or one snapshot there are no rows. Repeats are reduced by a map-side combined aggregate first,
    so a key that holds a third of all rows stays one row per snapshot. The list of snapshot dates, one number per
    delivery and so bounded by the calendar, is the only thing the driver reads.
    """
    value = F.concat_ws("\x1f", *[F.when(c.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("="), F.translate(c.cast("string"), "\x1f", "\x1e"))) for c in compared.values()])
    rows = df.select(key.alias("key"), F.unix_date(F.col(snapshot).cast("date")).alias("snapshot"), value.alias("value"), *[F.col(c).alias(f"_l{i}") for i, c in enumerate(latest)])
    rows = rows.where(F.col("snapshot").isNotNull() & (F.col("key") != ""))
    dates = sorted(r[0] for r in df.select(F.unix_date(F.col(snapshot).cast("date"))).distinct().collect() if r[0] is not None)
    order = F.struct(*[x for i in range(len(latest)) for x in (F.col(f"_l{i}").isNotNull(), F.col(f"_l{i}"))], F.col("value"))
    one = rows.groupBy("key", "snapshot").agg(F.max_by("value", order).alias("value"))
    parts = one.repartitionByRange(ranges, "key") if ranges else one.repartitionByRange("key")
    merged = parts.sortWithinPartitions("key", "snapshot").mapInArrow(_merge(dates, list(compared)), "key string, snapshot int, change_kind string, changed string")
    return merged.select(F.date_from_unix_date("snapshot").alias("snapshot_date"), "key", "change_kind", "changed")
