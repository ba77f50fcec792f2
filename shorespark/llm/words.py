"""Words of texts: unbroken runs of letters or digits."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

WORD = re.compile(r"[^\W_]+")
#: A word of the original text together with combining marks, so that words keep their places.
PLACED = re.compile(r"(?:[^\W_][̀-ͯ]*)+")
_MARK = re.compile(r"[̀-ͯ]+")


def folded_words(text: str) -> list[str]:
    """Words without letter case and accents."""
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFD", text))
    return WORD.findall(text.casefold())


def lower_words(text: str) -> list[str]:
    """Words in lower case, accents kept and composed."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.lower())


def numbered(words: list[list[str]], start: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Word numbers of all texts one after another, the text number of each, and the numbering."""
    ids: dict[str, int] = {} if start is None else start
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64)
    return flat, np.repeat(np.arange(len(words)), [len(ws) for ws in words]), ids
