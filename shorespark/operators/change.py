"""Shoreline change rates of transects: net movement, end-point rate and linear regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom, then by upper bound of the degrees.
T_975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
T_BEYOND = ((40, 2.021), (60, 2.000), (120, 1.980), (None, 1.960))


def critical_t(df: Column) -> Column:
    """Two-sided 95 % quantile of Student's t; null for no degrees of freedom."""
    out = F.when(df <= 0, None).when(df <= len(T_975), F.try_element_at(F.array(*[F.lit(t) for t in T_975]), df.cast("int")))
    for bound, t in T_BEYOND:
        out = out.when(df <= bound, t) if bound else out.otherwise(t)
    return out


def whole_year(year: Column) -> Column:
    """The year as INT; an error if it is null, no number or no whole number."""
    number = year.try_cast("double")
    ok = F.abs(number - F.round(number)) < 1e-8
    return F.when(ok, F.round(number).cast("int")).otherwise(F.raise_error(F.lit("years must be whole numbers")).cast("int"))


def yearly(observations: DataFrame, keys: list[str], year: str, position: str) -> DataFrame:
    """Mean position per key and year; null and NaN positions are left out."""
    p = F.nanvl(F.col(position).cast("double"), F.lit(None).cast("double"))
    return observations.select(*keys, F.col(year).alias("year"), p.alias("p")).where("p IS NOT NULL AND year IS NOT NULL").groupBy(*keys, "year").agg(F.avg("p").alias("position_m"))


def net_movement(observations: DataFrame, keys: list[str], year: str, position: str) -> DataFrame:
    """First and last year and position, nsm_m (last minus first) and epr_m_per_year (null within one year)."""
    g = yearly(observations, keys, year, position).groupBy(*keys).agg(
        F.count("*").alias("n_observations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("position_m", "year").alias("first_position_m"), F.max_by("position_m", "year").alias("last_position_m"),
    )
    span = F.col("last_year") - F.col("first_year")
    moved = F.when(span > 0, F.col("last_position_m") - F.col("first_position_m"))
    return g.withColumns({"nsm_m": moved, "epr_m_per_year": F.try_divide(moved, span)})


def rates(observations: DataFrame, keys: list[str], year: str, position: str) -> DataFrame:
    """Least-squares rate per key with its fit, error and 95 % interval, and the status of the analysis.

    Positions are first averaged per year. The residual sum is taken about the fitted line in a second pass over the
    yearly means (a few rows per key), which keeps its digits on long series; the error needs three years. A line
    without variation fits with R2 1. Expected years are the distinct years of all observations, found or not.
    """
    mean = yearly(observations, keys, year, position)
    fit = mean.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("year").alias("my"), F.avg("position_m").alias("mp"), F.regr_slope("position_m", "year").alias("slope"))
    names = [f"_{k}" for k in keys]
    f = fit.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "my", "mp", "slope")
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    r = mean.join(f, same).withColumns({"dx": F.col("year") - F.col("my"), "dy": F.col("position_m") - F.col("mp")})
    e = F.col("dy") - F.coalesce("slope", F.lit(0.0)) * F.col("dx")
    sums = r.groupBy(*keys).agg(
        F.count("*").alias("n_observations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("position_m", "year").alias("first_position_m"), F.max_by("position_m", "year").alias("last_position_m"),
        F.first("slope").alias("slope"), F.first("my").alias("my"), F.first("mp").alias("mp"),
        F.sum(e * e).alias("sse"), F.sum(F.col("dy") * F.col("dy")).alias("sst"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"),
    )
    everyone = observations.select(*keys).distinct()
    expected = observations.select(F.col(year).alias("y")).where("y IS NOT NULL").agg(F.countDistinct("y").alias("n_expected_years"))
    s2 = sums.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in sums.columns if c not in keys])
    j = everyone.join(s2, same, "left").crossJoin(F.broadcast(expected))  # one row on the right
    n = F.coalesce("n_observations", F.lit(0))
    span = F.col("last_year") - F.col("first_year")
    enough = n >= 2
    moved = F.when(span > 0, F.col("last_position_m") - F.col("first_position_m"))
    small = 1e-12
    r2 = F.when(F.col("sst") <= small, F.when(F.col("sse") <= small, 1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(F.col("sse"), F.col("sst")))))
    error = F.when(n >= 3, F.sqrt(F.try_divide(F.greatest(F.lit(0.0), F.try_divide(F.col("sse"), n - 2)), F.col("sxx"))))
    j = j.withColumns({"se": error, "t": critical_t(n - 2)})
    status = F.when(n == 0, "no_intersections").when(n < 2, "insufficient_observations").when(F.coalesce(span <= 0, F.lit(True)), "insufficient_time_span").when(F.col("se").isNull(), "ok_without_lrr_uncertainty").otherwise("ok")
    fitted = enough & (span > 0)
    return j.select(
        *keys, n.alias("n_observations"), "n_expected_years", F.try_divide(100.0 * n, F.col("n_expected_years")).alias("temporal_completeness_pct"),
        "first_year", "last_year", "first_position_m", "last_position_m", moved.alias("nsm_m"), F.try_divide(moved, span).alias("epr_m_per_year"),
        F.when(fitted, F.col("slope")).alias("lrr_m_per_year"), F.when(fitted, r2).alias("lrr_r2"), F.when(fitted, F.col("my")).alias("lrr_reference_year"), F.when(fitted, F.col("mp")).alias("lrr_position_at_reference_m"),
        F.col("se").alias("lrr_standard_error_m_per_year"), (F.col("slope") - F.col("t") * F.col("se")).alias("lrr_ci95_low_m_per_year"), (F.col("slope") + F.col("t") * F.col("se")).alias("lrr_ci95_high_m_per_year"),
        F.when(F.col("se").isNotNull(), "student_t_95").otherwise("not_available").alias("uncertainty_method"), status.alias("analysis_status"),
    )
