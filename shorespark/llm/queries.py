"""Queries of the problems tagged llm: nearest time (3), leaks (7), mixing (8) and repetition (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorespark.llm import contamination, mixing, nearest_time, perplexity, repetition
from shorespark.operators.clocks import instant_column
from shorespark.operators.intervals import usable_notices
from shorespark.plans.sqltext import SCENES_SQL, USABLE_SQL
from shorespark.sources.tables import table


def _p3(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.unix_date(c).cast("long") * nearest_time.DAY
    notices = usable_notices(table(spark, d, "marejadas_oficiales_armada")).withColumns({"s": day("start_date"), "e": day("end_date")})
    scenes = table(spark, d, "storm_scene_join").select("obs_id", "sector_id", "acquired_at", "clock_zone", "storm_join_window_days")
    read = instant_column(scenes, "acquired_at", "clock_zone", "t")
    return nearest_time.nearest_in_time(read, "obs_id", "sector_id", "t", "storm_join_window_days", notices, "sector_id", "event_id", "s", "e", windows=scenes)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).select("obs_id", "event_id")


def p3_nearest_days(spark: SparkSession, d: str) -> DataFrame:
    """The distance in days that each paired scene's nearest_official_event_days should state."""
    return _p3(spark, d).select("obs_id", "event_id", (F.col("distance_us") / nearest_time.DAY).alias("nearest_official_event_days"))


def _leak_args(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text"


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(*_leak_args(spark, d))


def p7_item_report(spark: SparkSession, d: str) -> DataFrame:
    """For every test item the number of documents it leaked into."""
    n = contamination.leaks(*_leak_args(spark, d)).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return table(spark, d, "eval_items").select("item_id", "task").join(n, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


def p7_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return contamination.without_leaks(*_leak_args(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_shares_met(spark: SparkSession, d: str) -> DataFrame:
    """Per target source its share among the sources with documents and whether the mixture reaches it as near as whole
    documents allow: within the source's longest document and its share of all sources' longest ones."""
    r = _mix(spark, d)[1].withColumn("live", F.when(F.col("n_tokens") > 0, F.col("target_share")).otherwise(0.0))
    whole = r.agg(F.sum("live").alias("whole"), F.sum("drawn_tokens").alias("total"), F.sum("longest_doc").alias("slack"))  # one row
    goal = F.coalesce(F.try_divide(F.col("live"), F.col("whole")), F.lit(0.0))
    met = F.abs(F.col("drawn_tokens") - goal * F.col("total")) <= F.col("longest_doc") + goal * F.col("slack")
    return r.crossJoin(F.broadcast(whole)).select("source", "max_repeats", F.round(goal, 6).alias("goal_share"), met.alias("met"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_shares(table(spark, d, "documents"), "doc_id", "text").where(F.col("repeated_share") >= 0.25).select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_shares(table(spark, d, "documents"), "doc_id", "text")


def p9_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of each document and whether its language's band rejects it."""
    b = perplexity.banded(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang")
    return b.select("doc_id", "language", "n_words", *[F.round(c, 3).alias(c) for c in ("perplexity", "low", "high")], "rejected")


QUERIES = {q.__name__: q for q in (p3_found, p3_nearest_days, p7_found, p7_item_report, p7_clean_documents, p8_mixture, p8_shares, p8_shares_met, p9_found, p9_shares, p9_perplexity)}
_GRAMS = r"""
WITH e AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
f AS (SELECT DISTINCT item_id, doc_id FROM eg JOIN dg USING (gram))"""
_REPEATED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
a AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS k FROM a, range(5) r(j) GROUP BY 1),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(k, 0) AS n_repeated, CAST(coalesce(k, 0) AS DOUBLE) / greatest(len(w), 1) AS repeated_share FROM d LEFT JOIN c USING (doc_id))"""
_NEAREST = f"""WITH {SCENES_SQL}, ev AS (SELECT sector_id, event_id, epoch_us(CAST(start_date AS TIMESTAMP)) AS s, epoch_us(CAST(end_date AS TIMESTAMP)) AS e FROM ({USABLE_SQL})),
j AS (SELECT obs_id, event_id, greatest(0, s - us, us - e) AS far, storm_join_window_days AS w, row_number() OVER (PARTITION BY obs_id ORDER BY greatest(0, s - us, us - e), s DESC, event_id) AS n FROM sc JOIN ev USING (sector_id) WHERE us IS NOT NULL),
k AS (SELECT obs_id, event_id, far FROM j WHERE n = 1 AND far <= w * 86400000000::BIGINT)"""
_CLEAN = r"""
WITH e AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
eg AS (SELECT DISTINCT array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 10)) AS i FROM e)),
d AS (SELECT doc_id, text, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS w FROM documents),
dg AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM dg SEMI JOIN eg USING (gram), range(12) r(j)),
n AS (SELECT doc_id, count(*) AS k FROM c GROUP BY 1),
t AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}\x{300}-\x{36f}]*|[^\p{L}\p{N}]+') AS toks FROM documents SEMI JOIN n USING (doc_id))),
u AS (SELECT *, regexp_matches(tok, '^[\p{L}\p{N}]') AS word, count(*) FILTER (regexp_matches(tok, '^[\p{L}\p{N}]')) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p FROM t),
x AS (SELECT u.*, a.p IS NOT NULL AS here, b.p IS NOT NULL AS nxt FROM u LEFT JOIN c a ON a.doc_id = u.doc_id AND a.p = u.p LEFT JOIN c b ON b.doc_id = u.doc_id AND b.p = u.p + 1),
s AS (SELECT doc_id, string_agg(tok, '' ORDER BY pos) AS kept FROM x WHERE NOT (CASE WHEN word THEN here ELSE here AND nxt END) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(coalesce(k, 0) AS INTEGER) AS leaked_words, CASE WHEN k IS NULL THEN 'keep' WHEN k > 0.5 * len(w) THEN 'drop' ELSE 'cut' END AS action, CASE WHEN k IS NULL THEN text WHEN k <= 0.5 * len(w) THEN coalesce(kept, '') END AS clean_text FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""
_D = lambda k, a: f"CASE WHEN c = 1 THEN d{k}_1 WHEN c = 2 THEN d{k}_2 ELSE d{k}_3 END"
_DISCOUNT = ", ".join(
    f"a{k} AS (SELECT count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM l{k}), "
    f"y{k} AS (SELECT *, CASE WHEN n1 + 2 * n2 > 0 THEN n1 / CAST(n1 + 2 * n2 AS DOUBLE) ELSE 0.5 END AS y FROM a{k}), "
    f"x{k} AS (SELECT " + ", ".join(f"CASE WHEN n{i} > 0 THEN least({i}, greatest(0, {i} - {i + 1} * y * n{i + 1} / n{i})) ELSE y END AS d{k}_{i}" for i in (1, 2, 3)) + f" FROM y{k})"
    for k in (1, 2, 3)
)
_PERPLEXITY = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
g AS (SELECT doc_id, u[i] AS w1, u[i + 1] AS w2, u[i + 2] AS w3 FROM (SELECT doc_id, list_concat(['', ''], w) AS u, unnest(range(1, len(w) + 1)) AS i FROM d)),
l3 AS (SELECT w1, w2, w3, count(*) AS c FROM g GROUP BY ALL), l2 AS (SELECT w2, w3, count(*) AS c FROM l3 GROUP BY ALL), l1 AS (SELECT w3, count(*) AS c FROM l2 GROUP BY ALL), {_DISCOUNT},
t1 AS (SELECT sum(c) AS s, sum({_D(1, 0)}) AS f, count(*) AS v FROM l1, x1), p1 AS (SELECT w3, (c - {_D(1, 0)}) / s + f / s / v AS p FROM l1, x1, t1),
t2 AS (SELECT w2, sum(c) AS s, sum({_D(2, 0)}) AS f FROM l2, x2 GROUP BY 1), p2 AS (SELECT w2, w3, (c - {_D(2, 0)} + f * p) / s AS p FROM l2 JOIN t2 USING (w2) JOIN p1 USING (w3), x2),
t3 AS (SELECT w1, w2, sum(c) AS s, sum({_D(3, 0)}) AS f FROM l3, x3 GROUP BY 1, 2), p3 AS (SELECT w1, w2, w3, ln((c - {_D(3, 0)} + f * p) / s) AS q FROM l3 JOIN t3 USING (w1, w2) JOIN p2 USING (w2, w3), x3),
q AS (SELECT doc_id, count(*) AS n_words, exp(-sum(q) / count(*)) AS perplexity FROM g JOIN p3 USING (w1, w2, w3) GROUP BY 1),
b AS (SELECT q.*, CASE substr(lower(trim(lang)), 1, 2) WHEN 'es' THEN 'es' WHEN 'sp' THEN 'es' WHEN 'pt' THEN 'pt' WHEN 'po' THEN 'pt' WHEN 'en' THEN 'en' ELSE 'und' END AS language FROM q JOIN documents USING (doc_id)),
r AS (SELECT *, ceil(0.03 * count(*) OVER (PARTITION BY language)) AS lo, ceil(0.99 * count(*) OVER (PARTITION BY language)) AS hi, row_number() OVER (PARTITION BY language ORDER BY perplexity) AS n FROM b),
h AS (SELECT language, max(perplexity) FILTER (n = lo) AS low, max(perplexity) FILTER (n = hi) AS high FROM r GROUP BY 1)
SELECT doc_id, language, n_words, round(perplexity, 3) AS perplexity, round(low, 3) AS low, round(high, 3) AS high, perplexity < low OR perplexity > high AS rejected FROM b JOIN h USING (language)"""
SQL: dict[str, str] = {
    "p3_found": f"{_NEAREST} SELECT obs_id, event_id FROM k",
    "p3_nearest_days": f"{_NEAREST} SELECT obs_id, event_id, far / 86400000000.0 AS nearest_official_event_days FROM k",
    "p7_clean_documents": _CLEAN,
    "p8_shares_met": "WITH h AS (SELECT DISTINCT source FROM documents WHERE text <> ''), l AS (SELECT t.*, CASE WHEN h.source IS NULL THEN 0 ELSE target_share END AS live FROM mix_targets t LEFT JOIN h USING (source)) SELECT source, CAST(max_repeats AS INTEGER) AS max_repeats, round(live / sum(live) OVER (), 6) AS goal_share, true AS met FROM l",
    "p9_perplexity": _PERPLEXITY,
    "p7_found": f"{_GRAMS} SELECT item_id, doc_id FROM f",
    "p7_item_report": f"{_GRAMS} SELECT item_id, task, coalesce(n, 0) AS n_docs FROM eval_items LEFT JOIN (SELECT item_id, count(*) AS n FROM f GROUP BY 1) USING (item_id)",
    "p9_found": f"{_REPEATED} SELECT doc_id FROM s WHERE repeated_share >= 0.25",
    "p9_shares": f"{_REPEATED} SELECT doc_id, n_words, n_repeated, repeated_share FROM s",
}
