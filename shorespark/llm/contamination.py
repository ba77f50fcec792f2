"""Evaluation texts inside training texts.

The n-grams of the evaluation items, in normalised words, form a hash set that every task holds; the windows of each
document are looked up in it, and each hit is verified word by word. A hash set too large for one broadcast goes out in
parts of bounded size, one scan of the documents each; only the hits, never the documents' windows, are then joined
with the items' words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorespark.llm.words import PLACED, folded_words
from shorespark.session import written

WORDS = 12
#: Most n-grams that are broadcast with their words (40 MB), and most hashes a part of a larger set has (32 MB).
MOST_BROADCAST, MOST_HASHES = 200_000, 4_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """All n-grams of the items: vocabulary, sorted hashes, the words of each n-gram and the items that hold it."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.vocabulary = n, {}
        rows, owners = [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded_words(text or "")]
            for i in range(len(ids) - n + 1):
                rows.append(ids[i : i + n])
                owners.append(item)
        words = np.array(rows, np.int64).reshape(-1, n)
        self.words, number = np.unique(words, axis=0, return_inverse=True) if len(words) else (words, np.zeros(0, int))
        hashes = self._hash(self.words.T) if len(words) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words = hashes[order], self.words[order]
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[number.ravel()], np.array(owners, np.int64)], 1), axis=0) if len(words) else np.zeros((0, 2), np.int64)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        self.owner = pairs[:, 1]

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h + c.astype(np.uint64)) * _FACTOR
            h ^= h >> np.uint64(29)
        return h

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, word place, n-gram number) of every verified window."""
        get = self.vocabulary.get
        # a zero after each text keeps windows from running over its end; words of no item are zero too
        flat = np.fromiter((x for ws in texts for x in (*(get(w, 0) for w in ws), 0)), np.int64)
        none = np.zeros(0, int)
        if len(flat) < self.n or not len(self.hashes):
            return none, none, none
        zeros = np.concatenate([[0], np.cumsum(flat == 0)])
        at = np.flatnonzero(zeros[self.n :] == zeros[: -self.n])
        h = self._hash([flat[at + i] for i in range(self.n)]) if len(at) else np.zeros(0, np.uint64)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        out_at, out_gram = [], []
        for step in range(int((hi - lo).max()) if len(at) else 0):
            m = lo + step < hi
            g = (lo + step)[m]
            same = np.all(self.words[g] == np.stack([flat[at[m] + i] for i in range(self.n)], 1), axis=1)
            out_at.append(at[m][same])
            out_gram.append(g[same])
        if not out_at:
            return none, none, none
        place, gram = np.concatenate(out_at), np.concatenate(out_gram)
        starts = np.cumsum([0, *(len(ws) + 1 for ws in texts)])
        text = np.searchsorted(starts, place, "right") - 1
        return text, place - starts[text], gram


def _batches(run):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2000):
                got = run(b.slice(i, 2000))
                if got is not None and len(got):
                    yield got

    return over


def _small(spark_grams, keep_spans: bool):
    def find(b: pa.RecordBatch) -> pa.RecordBatch | None:
        grams = spark_grams.value
        texts = [folded_words(t) if t else [] for t in b.column(1).to_pylist()]
        text, place, gram = grams.windows(texts)
        ids = b.column(0).to_numpy(zero_copy_only=False)
        if keep_spans:
            got = np.unique(np.stack([ids[text], place], 1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64())], ["doc_id", "place"])
        count = grams.first[gram + 1] - grams.first[gram]
        row = np.repeat(np.arange(len(gram)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        item = grams.owner[grams.first[gram[row]] + step]
        got = np.unique(np.stack([item, ids[text[row]]], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0], pa.int64()), pa.array(got[:, 1], pa.int64())], ["item_id", "doc_id"])

    return _batches(find)


def _window_hashes(n: int, wanted=None):
    """id, sig, place, hash and words of every window of n words of (id, sig, text), or of those whose hash is in the
    broadcast sorted array `wanted`."""

    def find(b: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = [folded_words(t) if t else [] for t in b.column(2).to_pylist()]
        known: dict[str, int] = {}
        of = lambda w: known.get(w) or known.setdefault(w, int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") or 1)
        flat = np.fromiter((x for ws in texts for x in (*map(of, ws), 0)), np.uint64)
        if len(flat) < n:
            return None
        zeros = np.concatenate([[0], np.cumsum(flat == 0)])
        at = np.flatnonzero(zeros[n:] == zeros[:-n])
        h = Grams._hash([flat[at + i] for i in range(n)]).view(np.int64) if len(at) else np.zeros(0, np.int64)
        if wanted is not None:
            near = np.searchsorted(wanted.value, h)
            hit = wanted.value[np.minimum(near, len(wanted.value) - 1)] == h
            at, h = at[hit], h[hit]
        starts = np.cumsum([0, *(len(ws) + 1 for ws in texts)])
        row = np.searchsorted(starts, at, "right") - 1
        place = at - starts[row]
        words = [" ".join(texts[r][p : p + n]) for r, p in zip(row, place)]
        side = [b.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(side[0], pa.int64()), pa.array(side[1], pa.int64()), pa.array(place, pa.int32()), pa.array(h, pa.int64()), pa.array(words, pa.string())], ["id", "sig", "place", "hash", "words"])

    return _batches(find)


_WINDOW = "id long, sig long, place int, hash long, words string"


def _hits(docs: DataFrame, items: DataFrame, n: int, hashes: int) -> DataFrame:
    """item_id, doc_id, sig, place of every verified window of docs (doc_id, sig, text) that items (id, text) hold; for
    item tables of any size."""
    spark = docs.sparkSession
    grams = items.select("id", F.lit(0).cast("long").alias("sig"), "text").mapInArrow(_window_hashes(n), _WINDOW).select("id", "hash", "words").distinct()
    grams = written(grams, "item-windows")
    parts = max(1, -(-grams.select("hash").distinct().count() // hashes))
    found = None
    for k in range(parts):
        some = grams.where(F.pmod("hash", F.lit(parts)) == k).select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)
        if not len(some):
            continue
        got = docs.select("doc_id", "sig", "text").mapInArrow(_window_hashes(n, spark.sparkContext.broadcast(np.sort(some))), _WINDOW)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "item_id long, doc_id long, sig long, place int")
    return found.withColumnRenamed("id", "doc_id").join(grams.withColumnRenamed("id", "item_id"), ["hash", "words"]).select("item_id", "doc_id", "sig", "place")


def _grams(items: DataFrame, item: str, text: str, n: int, most: int):
    """The broadcast n-grams, or None if there are more of them than may be broadcast."""
    words = items.select(F.sum(F.length(F.col(text))).alias("c")).first()["c"] or 0
    if words > 20 * most:  # more characters than so many n-grams can have, whatever the words
        return None
    rows = [(r[0], r[1]) for r in items.select(F.col(item).cast("long"), F.col(text)).where(F.col(text).isNotNull()).collect()]
    grams = Grams(rows, n)
    return items.sparkSession.sparkContext.broadcast(grams) if len(grams.hashes) <= most else None


def leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = WORDS, most: int = MOST_BROADCAST, hashes: int = MOST_HASHES) -> DataFrame:
    """item_id, doc_id of every document that holds at least n consecutive words of an item, once.

    Words are runs of letters or digits without letter case and accents. Null and empty texts and texts of fewer than
    n words neither hold nor leak anything; copies of a document are found each; an n-gram that several items share
    counts for each of them. Ids must be whole numbers and not null. The item table's size is checked first: within
    `most` n-grams they are broadcast with their words and the documents are read once without a shuffle; beyond it
    their hashes are, in parts of at most `hashes`, and the hits are joined with the items' words.
    """
    docs = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    grams = _grams(items, item, item_text, n, most)
    if grams is not None:
        return docs.mapInArrow(_small(grams, False), "item_id long, doc_id long")
    held = items.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL")
    return _hits(docs.withColumn("sig", F.lit(0).cast("long")), held, n, hashes).select("item_id", "doc_id").distinct()


_CLEAN = "doc_id long, words int, leaked_words int, action string, clean_text string"


def _cleaned(n: int, most_share: float, windows):
    """Cleans the documents of a batch; windows(batch, texts) gives (text number, word place) of their leaked windows."""

    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b.column(1).to_pylist()
        texts = [folded_words(t) if t else [] for t in raw]
        where, place = windows(b, texts)
        out = {"doc_id": b.column(0), "words": [len(t) for t in texts], "leaked_words": [0] * len(raw), "action": ["keep"] * len(raw), "clean_text": list(raw)}
        for i in np.unique(where):
            covered = np.zeros(len(texts[i]), bool)
            for p in place[where == i]:
                covered[p : p + n] = True
            out["leaked_words"][i] = int(covered.sum())
            spans = list(PLACED.finditer(raw[i]))
            if covered.mean() > most_share or len(spans) != len(covered):
                out["action"][i], out["clean_text"][i] = "drop", None
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(int)))
            t, pieces, last = raw[i], [], 0
            for a, z in zip(edge[::2], edge[1::2]):
                pieces.append(t[last : spans[a].start()])
                last = spans[z - 1].end()
            out["action"][i], out["clean_text"][i] = "cut", "".join([*pieces, t[last:]])
        return pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("words", pa.int32()), ("leaked_words", pa.int32()), ("action", pa.string()), ("clean_text", pa.string())]))

    return _batches(clean)


def without_leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, n: int = WORDS, most_share: float = 0.5, most: int = MOST_BROADCAST, hashes: int = MOST_HASHES) -> DataFrame:
    """doc_id, words, leaked_words, action ('keep', 'cut', 'drop') and clean_text of every document.

    Leaked words are those inside a window that an item holds. Documents without any are kept as they are; where at
    most `most_share` of the words leaked, the stretches from the first to the last leaked word are cut out; others
    are dropped (clean_text null). Null texts are kept. The item table may have any size, as in `leaks`; beyond one
    broadcast the places of a document's hits, no more than its words, are joined back to it.
    """
    docs = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    grams = _grams(items, item, item_text, n, most)
    if grams is not None:
        return docs.mapInArrow(_cleaned(n, most_share, lambda b, texts: grams.value.windows(texts)[:2]), _CLEAN)
    held = items.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL")
    signed = docs.withColumn("sig", F.xxhash64("text"))
    places = _hits(signed, held, n, hashes).groupBy("doc_id", "sig").agg(F.collect_set("place").alias("places")).withColumnsRenamed({"doc_id": "_d", "sig": "_s"})
    j = signed.join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sig") == F.col("_s")), "left").select("doc_id", "text", "places")

    def given(b: pa.RecordBatch, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        got = [(i, p) for i, ps in enumerate(b.column(2).to_pylist()) for p in ps or []]
        return np.array([i for i, _ in got], int), np.array([p for _, p in got], int)

    return j.mapInArrow(_cleaned(n, most_share, given), _CLEAN)
