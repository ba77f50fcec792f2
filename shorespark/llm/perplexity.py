"""Modified Kneser-Ney n-gram model counted by Spark, and perplexity bands per language.

The model is a table of n-gram hashes in sorted order with their log-probabilities. It is never gathered: the n-grams
that make up much of all texts, a bounded number, are broadcast, the others meet it in a merge join on the sorted hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorespark.llm.words import lower_words, numbered
from shorespark.session import written

ORDER = 3
MOST_FREQUENT = 200_000  #: bound on the n-grams that are broadcast


def _word_hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True)


def document_grams(documents: DataFrame, doc: str, text: str, order: int = ORDER) -> DataFrame:
    """doc_id, w1..wN (word hashes, w1..w(N-1) 0 before the text's start) and n: distinct n-grams of each document.
    Null and wordless texts have none."""
    names = [f"w{i + 1}" for i in range(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                words = [["\x02"] * (order - 1) + w if (w := lower_words(t)) else [] for t in ((t or "") for t in part.column(1).to_pylist())]
                flat, row, ids = numbered(words, {"\x02": 0})
                if len(flat) < order:
                    continue
                hashes = np.array([0, *(_word_hash(w) for w in list(ids)[1:])], np.int64)
                at = np.flatnonzero(row[: len(flat) - order + 1] == row[order - 1 :])
                base = np.int64(len(ids))
                code = flat[at]
                for k in range(1, order):  # exact numbering of the n-grams, step by step
                    code = np.unique(code * base + flat[at + k], return_inverse=True)[1]
                key, first, n = np.unique(code * np.int64(len(words)) + row[at], return_index=True, return_counts=True)
                at = at[first]
                doc_ids = part.column(0).to_numpy(zero_copy_only=False)[row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *[pa.array(hashes[flat[at + k]]) for k in range(order)], pa.array(n.astype(np.int32))], ["doc_id", *names, "n"])

    docs = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{w} long" for w in names) + ", n int")


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts; where a count is missing, the discount is
    that of absolute discounting, at most the count it is taken from."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    of = lambda k, a, b: min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else y
    return of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)


def train(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """h (hash of the n-gram, sorted), logp (natural log of its probability) and c (its count) from the n-grams of all
    documents."""
    names = [f"w{i + 1}" for i in range(order)]
    levels = {order: grams.groupBy(*names).agg(F.sum("n").cast("long").alias("c"))}
    levels[order] = written(levels[order], "ngrams")
    for k in range(order - 1, 0, -1):  # continuation counts: how many different words come before
        level = levels[k + 1].groupBy(*names[order - k :]).agg(F.count("*").alias("c"))
        levels[k] = written(level, f"ngrams-{k}")
    counts = {}
    for k, level in levels.items():
        r = level.where("c <= 4").groupBy("c").count().collect()
        by = {x["c"]: x["count"] for x in r}
        counts[k] = discounts(*(by.get(i, 0) for i in (1, 2, 3, 4)))
    words = levels[1].count()

    def taken(c: Column, d: tuple[float, float, float]) -> Column:
        return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])

    d = counts[1]
    whole = levels[1].agg(F.sum("c").alias("s"), F.sum(taken(F.col("c"), d)).alias("free")).first()
    total, free = float(whole["s"] or 1), float(whole["free"] or 0)
    p = levels[1].select(*names[order - 1 :], *(["c"] if order == 1 else []), ((F.col("c") - taken(F.col("c"), d)) / total + free / total / max(1, words)).alias("p"))
    for k in range(2, order + 1):
        own, shorter, context = names[order - k :], names[order - k + 1 :], names[order - k : order - 1]
        d = counts[k]
        sums = levels[k].groupBy(*context).agg(F.sum("c").alias("s"), F.sum(taken(F.col("c"), d)).alias("free"))
        j = levels[k].join(sums, context).join(p, shorter)
        p = j.select(*own, *(["c"] if k == order else []), ((F.col("c") - taken(F.col("c"), d) + F.col("free") * F.col("p")) / F.col("s")).alias("p"))
    # a discount may reach the whole count of an n-gram; what is left of the mass keeps every probability positive
    model = p.select(F.xxhash64(*names).alias("h"), F.log("p").alias("logp"), "c")
    return written(model.repartitionByRange("h").sortWithinPartitions("h"), "model")


def perplexities(documents: DataFrame, doc: str, text: str, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, perplexity of every document with words, under the model of the whole corpus."""
    grams = written(document_grams(documents, doc, text, order), "document-grams")  # the texts are cut into words once
    model = train(grams, order)
    names = [f"w{i + 1}" for i in range(order)]
    # fewer than MOST_FREQUENT n-grams can occur more often than the mean of that many
    often = (grams.agg(F.sum("n")).first()[0] or 0) / MOST_FREQUENT
    frequent = model.where(F.col("c") > often).select("h", F.col("logp").alias("_p"))
    hashed = grams.select("doc_id", F.xxhash64(*names).alias("h"), "n").join(F.broadcast(frequent), "h", "left")
    sums = lambda d, p: d.groupBy("doc_id").agg(F.sum(F.col("n") * F.col(p)).alias("s"), F.sum("n").alias("n_words"))
    near = sums(hashed.where("_p IS NOT NULL"), "_p")
    rest = sums(hashed.where("_p IS NULL").select("doc_id", "h", "n").join(model.where(F.col("c") <= often).select("h", "logp"), "h"), "logp")
    scored = near.unionByName(rest).groupBy("doc_id").agg(F.sum("s").alias("s"), F.sum("n_words").alias("n_words"))
    return scored.select("doc_id", "n_words", F.exp(-F.col("s") / F.col("n_words")).alias("perplexity"))


def banded(documents: DataFrame, doc: str, text: str, lang: str, lower: float = 0.03, upper: float = 0.99, order: int = ORDER) -> DataFrame:
    """doc_id, language, n_words, perplexity, low, high and rejected for every document with words.

    The bands are the `lower` and `upper` quantiles of the perplexities of each language; documents outside their
    language's band are rejected: below it texts that repeat what is known, above it broken ones. Labels of a language
    are compared by their first two letters in lower case ('spa' is 'es', 'por' is 'pt', 'eng' is 'en'); null and
    other labels are one group, 'und'.
    """
    code = F.substring(F.lower(F.trim(F.col(lang))), 1, 2)
    language = F.when(code.isin("es", "sp"), "es").when(code.isin("pt", "po"), "pt").when(code == "en", "en").otherwise("und")
    labels = documents.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(language, F.lit("und")).alias("language"))
    scored = written(perplexities(documents, doc, text, order).join(labels, "doc_id"), "perplexities")
    q = scored.groupBy("language").agg(F.percentile_approx("perplexity", [lower, upper], 10000).alias("q"))
    bands = q.select("language", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    out = (F.col("perplexity") < F.col("low")) | (F.col("perplexity") > F.col("high"))
    return scored.join(F.broadcast(bands), "language").select("doc_id", "language", "n_words", "perplexity", "low", "high", out.alias("rejected"))
