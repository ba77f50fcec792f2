"""Scene catalogues: ranking, fallback, missing years and the nested document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_CLOUD = 999.0  #: a null cloud share ranks as this


def deduplicated(scenes: DataFrame, group: list[str], instant: str, coverage: str, cloud: str, ordinal: str) -> DataFrame:
    """One scene per group and instant: the greatest coverage, then the least cloud, then the first in order.
    An aggregate instead of a window, so copies of one instant are combined before they are shuffled."""
    best = F.struct(F.col(coverage), -F.coalesce(F.col(cloud), F.lit(NO_CLOUD)), -F.col(ordinal))
    keys = [*group, instant]
    kept = scenes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in scenes.columns if c not in keys]), best).alias("_s"))
    return kept.select(*keys, "_s.*")


def ranked(scenes: DataFrame, group: list[str], instant: str, coverage: str, cloud: str, ordinal: str, k: int, whole: float = 0.98) -> DataFrame:
    """The k best scenes per group with their rank: those of coverage >= whole only, if the group has any; by cloud,
    greatest coverage, instant, order. The window keeps k rows per group on each side of the shuffle."""
    has = scenes.groupBy(*group).agg(F.max(F.col(coverage) >= whole).alias("_any"))
    s = scenes.join(has, group).where(~F.col("_any") | (F.col(coverage) >= whole))
    w = Window.partitionBy(*group).orderBy(F.coalesce(F.col(cloud), F.lit(NO_CLOUD)), F.col(coverage).desc(), instant, ordinal)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_any")


def first_candidates(scenes: DataFrame, group: list[str], ordinal: str, k: int) -> DataFrame:
    """The first k scenes of each group in catalogue order."""
    w = Window.partitionBy(*group).orderBy(ordinal)
    return scenes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def representative(scenes: DataFrame, group: list[str], instant: str, ordinal: str) -> DataFrame:
    """The scene at place n div 2 (from 0) of each group in order of time.

    Counts per (group, instant) come first, so only the instants, not their copies, are ordered.
    """
    per = scenes.groupBy(*group, instant).agg(F.count("*").alias("c"))
    upto = per.withColumn("u", F.sum("c").over(Window.partitionBy(*group).orderBy(instant)))
    n = per.groupBy(*group).agg(F.sum("c").alias("n"))
    at = upto.join(n, group).withColumn("p", F.floor(F.col("n") / 2)).where("u > p AND u - c <= p").select(*group, instant, (F.col("p") - (F.col("u") - F.col("c"))).alias("p"), "n")
    here = scenes.join(at, [*group, instant])
    w = Window.partitionBy(*group).orderBy(ordinal)
    return here.withColumn("_r", F.row_number().over(w) - 1).where("_r = p").drop("_r", "p")


def passing(cloud: Column, most: float) -> Column:
    """The cloud share is at most `most`, or unknown."""
    return F.coalesce(cloud <= most, F.lit(True))


def with_fallback(scenes: DataFrame, group: list[str], cloud: str, coverage: str, instant: str, ordinal: str, most: float, allowed: Column | None = None) -> DataFrame:
    """Scenes that pass the cloud limit; for an allowed group without any, its best-ranked scene with status
    'fallback_above_limit'."""
    ok = scenes.withColumn("_ok", passing(F.col(cloud), most))
    have = ok.groupBy(*group).agg(F.max("_ok").alias("_any"))
    j = ok.join(have, group)
    good = j.where("_ok").withColumn("status", F.lit("accepted"))
    rest = j.where(~F.col("_any") & (allowed if allowed is not None else F.lit(True)))
    order = F.struct(F.coalesce(F.col(cloud), F.lit(NO_CLOUD)), -F.col(coverage), F.col(instant), F.col(ordinal))
    best = rest.groupBy(*group).agg(F.min_by(F.struct(*[c for c in scenes.columns if c not in group]), order).alias("_s")).select(*group, "_s.*")
    return good.select(*scenes.columns, "status").unionByName(best.withColumn("status", F.lit("fallback_above_limit")))


def missing_years(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    """Years of [first, last] that do not occur."""
    return df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("missing_year")).join(df.select(F.col(year).cast("int").alias("missing_year")).distinct(), "missing_year", "left_anti")


def document(scenes: DataFrame, group: list[str], year: str, sets: dict[str, str], scene: list[str], order: str) -> DataFrame:
    """One row per group: scene_count, the sorted distinct values of `sets` and the scenes as a JSON array in order.
    A group's scenes form one value, as the document demands."""
    aggs = [F.sort_array(F.collect_set(c)).alias(n) for n, c in sets.items()]
    nested = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*scene).alias("s")))), lambda x: x["s"])
    return scenes.groupBy(*group).agg(F.count("*").alias("scene_count"), *aggs, F.to_json(nested).alias("scenes"))


# How items of each known provider are read: assets of green, near infrared, scene classes and product in
# order of preference, the collection where the item names none, level, need of authorisation and status.
PROVIDERS = {
    "earth-search": (("green", "B03"), ("nir", "B08"), ("scl", "SCL"), (), "sentinel-2-l2a", "L2A", False, "public_cog_ready"),
    "earth-search-l1c": (("green", "B03"), ("nir", "B08"), (), (), "sentinel-s2-l1c", "L1C", False, "public_l1c_jp2_ready"),
    "copernicus-data-space": (("B03", "green"), ("B08", "nir"), ("SCL", "scl"), ("Product", "product"), "sentinel-2-l1c", "L1C", True, "catalogued_auth_download_required"),
}
# Object store prefixes of public products and the addresses that serve them.
PUBLIC = {"s3://sentinel-s2-l1c/": "https://sentinel-s2-l1c.s3.eu-central-1.amazonaws.com/"}


def stac_items(items: DataFrame, providers: dict[str, tuple] | None = None) -> DataFrame:
    """item_id, scene_year, acquired_at, provider, collection, level, cloud_cover, tile, href_green, href_nir, href_scl,
    href_product, needs_auth, self_url and status of STAC items (id, collection, properties map, assets map of
    struct(href), links array of struct(rel, href), provider), each read by the rules of its provider.

    An item without a green or near-infrared asset has status 'incomplete', one of an unknown provider
    'unknown_provider' and nothing read by rules.
    """
    rules = providers or PROVIDERS
    p = lambda n: F.col("properties")[n]

    def by(i: int, make) -> Column:
        out = F.lit(None)
        for name, rule in rules.items():
            out = F.when(F.col("provider") == name, make(rule[i])).otherwise(out)
        return out

    asset = lambda names: F.coalesce(*[F.when(F.col("assets")[n]["href"] != "", F.col("assets")[n]["href"]) for n in names]) if names else F.lit(None).cast("string")
    link = F.filter("links", lambda x: x["rel"] == "self")

    def served(c: Column) -> Column:
        out = c
        for at, to in PUBLIC.items():
            out = F.when(c.startswith(at), F.concat(F.lit(to), F.substring(c, len(at) + 1, 2**30))).otherwise(out)
        return out

    df = items.withColumns({"_g": served(by(0, asset)), "_n": served(by(1, asset)), "_s": by(2, asset), "_p": by(3, asset)})
    when = F.coalesce(p("datetime"), p("start_datetime"))
    status = F.when(~F.col("provider").isin(*rules) | F.col("provider").isNull(), "unknown_provider").when(F.col("_g").isNull() | F.col("_n").isNull(), "incomplete").otherwise(by(7, F.lit))
    return df.select(
        F.col("id").alias("item_id"), F.year(when.try_cast("timestamp")).alias("scene_year"), when.alias("acquired_at"), "provider", F.coalesce(F.when(F.col("collection") != "", F.col("collection")), by(4, F.lit)).alias("collection"), by(5, F.lit).alias("level"),
        p("eo:cloud_cover").try_cast("double").alias("cloud_cover"), F.coalesce(p("grid:code"), p("s2:mgrs_tile")).alias("tile"), F.col("_g").alias("href_green"), F.col("_n").alias("href_nir"), F.col("_s").alias("href_scl"), F.col("_p").alias("href_product"),
        by(6, F.lit).alias("needs_auth"), F.get(link, F.lit(0))["href"].alias("self_url"), status.alias("status"),
    )


def month_window(year: int, first: int, last: int) -> tuple[str, str]:
    """ISO bounds of a search from the first day of a month to the last second of another's last day."""
    import calendar

    return f"{year:04d}-{first:02d}-01T00:00:00Z", f"{year:04d}-{last:02d}-{calendar.monthrange(year, last)[1]:02d}T23:59:59Z"


def localised(scenes: DataFrame, assets: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """scenes whose asset paths are replaced by those of a local overlay (key and paths), where it names them; they
    need no authorisation then and have status 'local'."""
    o = assets.select(key, *[F.col(p).alias(f"_{p}") for p in paths], F.lit(True).alias("_l"))
    j = scenes.join(o, key, "left")
    out = j.withColumns({p: F.coalesce(f"_{p}", p) for p in paths} | {"needs_auth": F.when(F.col("_l"), False).otherwise(F.col("needs_auth")), "status": F.when(F.col("_l"), "local").otherwise(F.col("status"))})
    return out.drop("_l", *[f"_{p}" for p in paths])
