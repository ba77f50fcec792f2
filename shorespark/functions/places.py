"""Places and prefix sums inside groups of any size, in two levels: within bounded blocks and over the blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def places(df: DataFrame, group: list[str], order: str, span: float, out: str) -> DataFrame:
    """df with the place (0, 1, ...) of each row in its group by a numeric order; equal orders are numbered too.

    Rows are ordered inside blocks of `span` order units only; the blocks' counts, one row per block, are summed over
    the group. Rows with a null order come in a block of their own, first.
    """
    block = F.coalesce(F.floor(F.col(order) / span), F.lit(-(2**62)))
    d = df.withColumn("_b", block)
    counts = d.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_u", F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n"))
    names = {g: f"_g{i}" for i, g in enumerate(group)}
    right = before.select(*[F.col(g).alias(n) for g, n in names.items()], F.col("_b").alias("_b2"), "_u")
    same = F.col("_b") == F.col("_b2")
    for g, n in names.items():
        same = same & F.col(g).eqNullSafe(F.col(n))
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(order)) - 1
    return d.withColumn("_i", inside).join(right, same).withColumn(out, (F.col("_u") + F.col("_i")).cast("long")).select(*df.columns, out)
