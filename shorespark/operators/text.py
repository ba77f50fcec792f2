"""Retrieval of short texts by TF-IDF over words and word pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorespark.session import written

WORD = r"(?U)\b\w\w+\b"
MOST_FREQUENT = 50_000  #: bound on the broadcast terms


def terms(text: Column, pattern: str = WORD) -> Column:
    """Words of at least two word characters in lower case, and the pairs of successive words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def top_k(documents: DataFrame, key: str, text: str, query: str, k: int = 3, pattern: str = WORD) -> DataFrame:
    """key and score of the k documents most similar to the query, best first; equal scores by greater key.

    The weights are fitted on the documents and the query together: idf = ln((1 + N) / (1 + df)) + 1 with N one more
    than the documents, raw term counts, rows of length one, cosine. Only terms of the query can add to a score, but
    all terms make up a document's length, so df is counted for every term. Frequent terms, of which there are at most
    MOST_FREQUENT beside the query's, are broadcast, so no task gets all documents that have a stop word.
    Null texts have no terms and score 0.
    """
    spark = documents.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(terms(F.col("q"), pattern)).alias("term")).groupBy("term").agg(F.count("*").alias("qf"))
    n = documents.agg(F.count("*").alias("n"))
    # written: the texts are cut into terms once
    tf = written(documents.select(key, F.explode(terms(F.coalesce(text, F.lit("")), pattern)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), "terms")
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(asked), "term", "left").crossJoin(F.broadcast(n))  # a query's terms; one row
    idf = F.log((F.col("n") + 2.0) / (F.col("df") + F.when(F.col("qf").isNotNull(), 1).otherwise(0) + 1.0)) + 1
    weights = written(df.select("term", "df", "qf", idf.alias("idf")), "weights")
    # terms of the query that no document has count towards the query's length
    unseen = asked.join(weights.select("term"), "term", "left_anti").crossJoin(F.broadcast(n)).select(F.sum(F.pow(F.col("qf") * (F.log((F.col("n") + 2.0) / 2.0) + 1), 2)).alias("u"))
    seen = weights.where("qf IS NOT NULL").select(F.sum(F.pow(F.col("qf") * F.col("idf"), 2)).alias("s"))
    length = seen.crossJoin(F.broadcast(unseen)).select(F.sqrt(F.coalesce("s", F.lit(0.0)) + F.coalesce("u", F.lit(0.0))).alias("ql"))
    # fewer than MOST_FREQUENT terms can have more than the mean of that many, so those, the hot ones, are broadcast
    often = tf.count() / MOST_FREQUENT
    frequent = weights.where((F.col("df") > often) | F.col("qf").isNotNull()).select("term", "qf", "idf")
    near = tf.join(F.broadcast(frequent), "term")
    rest = tf.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(weights.where((F.col("df") <= often) & F.col("qf").isNull()).select("term", "qf", "idf"), "term")
    squares = lambda t: t.groupBy(key).agg(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).alias("dd"), F.sum(F.when(F.col("qf").isNotNull(), F.col("tf") * F.col("qf") * F.col("idf") * F.col("idf")).otherwise(0.0)).alias("dot"))
    w = squares(near).unionByName(squares(rest)).groupBy(key).agg(F.sum("dd").alias("dd"), F.sum("dot").alias("dot"))
    scored = documents.select(key).join(w, key, "left").crossJoin(F.broadcast(length))
    score = F.coalesce(F.try_divide(F.col("dot"), F.sqrt("dd") * F.col("ql")), F.lit(0.0))
    return scored.select(key, score.alias("score")).orderBy(F.round("score", 9).desc(), F.col(key).desc()).limit(k)


def numbered_evidence(hits: DataFrame, documents: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """One row `answer`: the hits as a numbered list, best first; '' without hits. hits is a top-k, so it is small."""
    j = hits.join(documents, key)
    rows = j.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.col(title).alias("t"), F.col(content).alias("c")))).alias("a"))
    line = F.transform("a", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"], F.lit(": "), x["c"]))
    return rows.select(F.array_join(line, "\n").alias("answer"))
