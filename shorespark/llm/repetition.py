"""Repeated content inside single documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorespark.llm.words import lower_words, numbered

WINDOW = 5


def repeated_words(words: list[list[str]], n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of words, and of words inside n consecutive words that already occurred earlier in it."""
    total = np.array([len(w) for w in words])
    flat, text, _ = numbered(words)
    if len(flat) < n:
        return total, np.zeros(len(words), int)
    # windows as single numbers: exact, each step numbers the pairs that occur
    code = flat[: len(flat) - n + 1]
    for i in range(1, n):
        nxt = flat[i : len(flat) - n + 1 + i]
        code = np.unique(code * (flat.max() + 1) + nxt, return_inverse=True)[1]
    at = np.flatnonzero(text[: len(code)] == text[n - 1 :])  # windows within one text
    code = np.unique(code[at] * np.int64(len(words)) + text[at], return_inverse=True)[1]
    first = np.full(code.max() + 1 if len(code) else 0, len(flat))
    np.minimum.at(first, code, at)
    again = at[at > first[code]]
    covered = np.zeros(len(flat) + 1, int)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + n, -1)
    hit = np.cumsum(covered)[:-1] > 0
    return total, np.bincount(text[hit], minlength=len(words))


def repeated_shares(documents: DataFrame, doc: str, text: str, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_repeated and repeated_share of every document.

    A word is repeated if it lies in n consecutive words that already occurred, starting earlier, in the same
    document. Null, empty and wordless texts have no words and share 0; copies of a document are measured each. One
    read of the whole texts, no shuffle.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                total, again = repeated_words([lower_words(t) if t else [] for t in part.column(1).to_pylist()], n)
                share = again / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(again, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "n_words", "n_repeated", "repeated_share"])

    docs = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(measure, "doc_id long, n_words long, n_repeated long, repeated_share double")
