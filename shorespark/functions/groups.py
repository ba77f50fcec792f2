"""Groups that may be very large: salts, and exact medians without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted(df: DataFrame, keys: list[str], spread: str, limit: int, out: str = "salt") -> DataFrame:
    """Adds a salt that splits every group of more than `limit` rows into pieces of about that size.

    Groups within the limit keep salt 0 and so stay whole. Only the groups beyond it, at most rows/limit of them,
    are joined back; where there is none, there is no join. Null keys form a group of their own.
    """
    group = F.xxhash64(*keys)
    large = df.groupBy(group.alias("_g")).count().where(F.col("count") > limit).select("_g", F.ceil(F.col("count") / limit).alias("_n"))
    if large.isEmpty():
        return df.withColumn(out, F.lit(0))
    joined = df.withColumn("_g", group).join(large, "_g", "left")
    return joined.withColumn(out, F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_n"))).cast("int")).drop("_g", "_n")


def exact_medians(df: DataFrame, keys: list[str], x: Column, out: str, margin: float = 0.001) -> DataFrame:
    """keys and the exact median of x per group, for groups of any size (null and NaN are left out).

    A sketch of bounded size brackets the median's ranks (its rank error is a tenth of the margin); then one
    map-side combined count of the readings below and of each value inside the bracket gives the exact ranks.
    """
    data = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sketch = data.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", [0.5 - margin, 0.5 + margin], 10000).alias("_q"))
    sketch = sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = data.join(sketch, same).where(F.col("_x") <= F.col("_hi"))
    counted = inside.groupBy(*keys, "_n", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    upto = counted.withColumn("_upto", F.sum("_c").over(w))
    below = F.floor((F.col("_n") - 1) / 2)
    above = F.floor(F.col("_n") / 2)
    covers = lambda r: F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r), F.col("_v"))
    return upto.groupBy(*keys).agg(((F.max(covers(below)) + F.max(covers(above))) / 2).alias(out))
