import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shorespark.llm import contamination, mixing, perplexity, repetition


def words(t):
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", t or "") if unicodedata.category(c) != "Mn").lower())


ITEM = "El perfil número 12 de la Playa Grande retrocedió 3,5 metros tras la marejada de otoño según la cota del poste"
ITEMS = [(1, ITEM, "x"), (2, "corto", "x"), (3, None, "x"), (4, "otro texto " + ITEM + " fin", "x"), (5, "", "x")]
W = words(ITEM)
DOCS = [
    (10, "Aviso. " + ITEM.upper() + " Fin.", "c"), (11, "x " + " ".join(W[:12]) + " y", "c"), (12, "x " + " ".join(W[:11]) + " y", "c"), (13, " ".join(W[3:15]).replace("marejada", "maréjada"), "c"),
    (14, None, "c"), (15, "", "c"), (16, "Aviso. " + ITEM.upper() + " Fin.", "c"), (17, "-".join(W[:13]), "c"), (18, " ".join(W[:6]) + " corte " + " ".join(W[6:14]), "c"), (19, "relleno " * 50_000 + " ".join(W[2:16]), "c"),
]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, item_id string"), spark.createDataFrame(ITEMS, "item_id long, text string, task string")


def test_leaks_by_both_ways(spark):
    d, i = frames(spark)
    grams = lambda t: {tuple(w[k : k + 12]) for w in [words(t)] for k in range(len(w) - 11)}
    want = {(a, b) for a, t, _ in ITEMS for b, u, _ in DOCS if grams(t) & grams(u)}
    for most, hashes in ((200_000, 9), (1, 4_000_000), (1, 4)):
        got = [tuple(r) for r in contamination.leaks(d, "doc_id", "text", i, "item_id", "text", most=most, hashes=hashes).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {b for _, b in want} == {10, 11, 13, 16, 17, 19}
    assert contamination.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").collect() == []
    assert contamination.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").collect() == []


def test_cleaning(spark):
    d, i = frames(spark)
    got, *others = ({r.doc_id: r for r in contamination.without_leaks(d, "doc_id", "text", i, "item_id", "text", **kw).collect()} for kw in ({}, {"most": 1}, {"most": 1, "hashes": 4}))
    assert all(o == got for o in others)  # whatever the size of a broadcast
    assert len(got) == len(DOCS)
    assert got[12].action == "keep" and got[12].clean_text == DOCS[2][1] and got[14].clean_text is None and got[14].action == "keep"
    assert got[10].action == "drop" and got[19].action == "cut" and got[19].leaked_words == 14 and got[19].clean_text == "relleno " * 50_000


def brute_share(text):
    w = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text or "").lower())
    seen, hit = set(), [False] * len(w)
    for k in range(len(w) - 4):
        g = tuple(w[k : k + 5])
        if g in seen:
            hit[k : k + 5] = [True] * 5
        seen.add(g)
    return len(w), sum(hit)


def test_repeated_shares_equal_brute_force(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "uno dos", "a a a a a a a a", "Ñandú, ñandú! " * 9, "frase corta que se repite siempre. " * 3000, "...", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_repeated) for r in repetition.repeated_shares(df, "doc_id", "text").collect()}
    assert got == {i: brute_share(t) for i, t in enumerate(texts)}
    assert repetition.repeated_shares(df.limit(0), "doc_id", "text").collect() == []


def test_model_is_a_distribution_and_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["mar", "sol", "ola", "sal", "pez", "red", "luz"][: rnd.randint(2, 7)]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "es") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    order = 2
    grams = perplexity.document_grams(df, "doc_id", "text", order)
    model = {r.h: r.logp for r in perplexity.train(grams, order).collect()}
    hashed = {(r.w1, r.w2): r.h for r in grams.select("w1", "w2", F.xxhash64("w1", "w2").alias("h")).distinct().collect()}
    of = {w: perplexity._word_hash(w) for t in texts for w in t.split()} | {"": 0}
    c2 = Counter((a, b) for t in texts for ws in [["", *t.split()]] for a, b in zip(ws, ws[1:]))
    c1 = Counter(b for _, b in c2)
    disc = lambda c: perplexity.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))
    d1, d2 = disc(c1), disc(c2)
    cut = lambda d, n: d[min(n, 3) - 1]
    total, free = sum(c1.values()), sum(cut(d1, n) for n in c1.values())
    p1 = {w: (n - cut(d1, n)) / total + free / total / len(c1) for w, n in c1.items()}
    assert sum(p1.values()) == pytest.approx(1)
    for (a, b), n in c2.items():
        own = {k: v for k, v in c2.items() if k[0] == a}
        s = sum(own.values())
        p = (n - cut(d2, n) + sum(cut(d2, v) for v in own.values()) * p1[b]) / s
        assert model[hashed[(of[a], of[b])]] == pytest.approx(math.log(p), abs=1e-5)
    got = {r.doc_id: r for r in perplexity.banded(df, "doc_id", "text", "lang", 0.1, 0.9, order).collect()}
    assert len(got) == 40 and 0 < sum(r.rejected for r in got.values()) < 15
    none = spark.createDataFrame([(1, None, None), (2, "", "es")], "doc_id long, text string, lang string")
    assert perplexity.banded(none, "doc_id", "text", "lang").collect() == []


def _mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, copies string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    draw, report = mixing.mixture(d.drop("copies"), "doc_id", "text", "source", t, **kw)
    return draw.collect(), {r.source: r for r in report.collect()}


def test_mixture_reaches_its_shares(spark):
    rnd = random.Random(5)
    docs = [(i, "palabra " * rnd.randint(1, 60), s, "x") for i, s in enumerate(["a"] * 1500 + ["b"] * 300 + ["c"] * 40 + ["other"] * 50)]
    docs += [(9000, None, "a", "x"), (9001, "", "b", "x"), (9002, "hola", None, "x")]
    targets = [("a", 0.3, 1), ("b", 0.45, 3), ("c", 0.15, 5), ("absent", 0.1, 4)]
    draw, report = _mix(spark, docs, targets)
    most = dict((s, m) for s, _, m in targets)
    assert all(1 <= r.copies <= most[r.source] and r.n_tokens > 0 for r in draw) and len({r.doc_id for r in draw}) == len(draw)
    live = 0.9
    for s, share, _ in targets[:3]:
        assert report[s].reached_share == pytest.approx(share / live, abs=0.003)
        assert report[s].drawn_tokens == sum(r.copies * r.n_tokens for r in draw if r.source == s)
    assert report["absent"].drawn_tokens == 0 and sum(r.saturated for r in report.values()) == 1
    again, same = _mix(spark, docs, targets, chunk=1)  # the sources one after another
    assert sorted(map(tuple, again)) == sorted(map(tuple, draw)) and same == report


def test_mixture_of_given_size_and_of_nothing(spark):
    docs = [(i, "una frase de prueba " * (1 + i % 9), "ab"[i % 2], "x") for i in range(400)]
    draw, report = _mix(spark, docs, [("a", 0.5, 4), ("b", 0.5, 4)], total=4000.0)
    assert all(abs(r.drawn_tokens - 2000) < 100 for r in report.values())
    draw, report = _mix(spark, [], [("a", 1.0, 2)])
    assert draw == [] and report["a"].drawn_tokens == 0 and report["a"].reached_share == 0
    _, twice = _mix(spark, docs, [("a", 0.5, 4), ("a", 0.5, 4), ("a", 0.2, 9), ("b", 0.5, 4), ("c", None, 1), (None, 0.1, 1)], total=4000.0)
    assert set(twice) == {"a", "b"} and twice["a"].target_share == 0.5 and abs(twice["a"].drawn_tokens - 2000) < 100


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = mixing.TOKENIZER.replace(".tiktoken", ".json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = ["Hola, ¿qué tal?", "", None, "<|endoftext|> x", "mar " * 20_000, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for file in (mixing.TOKENIZER, path):
        got = {r.i: r.n_tokens for r in mixing.token_counts(df, "i", "t", [], file).collect()}
        assert got == {i: len(tok.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}


def test_wide_numbers_of_words():
    ws = [[str(i) for i in range(3000)] * 2, ["a"], []]
    total, again = repetition.repeated_words(ws)
    assert list(total) == [6000, 1, 0] and list(again) == [3000, 0, 0] and np.asarray(again).sum() == 3000
