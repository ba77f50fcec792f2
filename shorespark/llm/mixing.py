"""Mixtures of sources with target shares of the tokens, by entropy balancing.

Each document gets the rate exp(lambda_s x tokens), at most the source's greatest number of repeats; the lambdas solve
the convex dual of "stay as close as possible to every document once, subject to each source's tokens" by Newton steps
whose sums Spark computes. Rates are then rounded into copies so that the sources' totals stay within a document.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorespark.session import written

#: The vocabulary file unless the session names another one as shorespark.tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 10_000  #: sources whose goals the driver holds at a time
# Fixed value: the pattern by which the byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096


def token_counts(documents: DataFrame, doc: str, text: str, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """doc, the columns `keep` and n_tokens of every document's whole text; null and empty texts have 0.

    tokenizer: a file of ranks (.tiktoken) or of the tokenizers library (.json). It is read once and broadcast (a
    vocabulary is a few megabytes), so executors need no file. Special tokens in a text count as ordinary text.
    """
    tokenizer = tokenizer or documents.sparkSession.conf.get("shorespark.tokenizer", TOKENIZER)
    model = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text("utf-8"))
    schema = documents.select(doc, *keep).schema
    pattern, json_file = PATTERN, tokenizer.endswith(".json")

    def counter():
        if json_file:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(model.value)
            tok.encode_special_tokens = True
            return lambda ts: [len(e) for e in tok.encode_batch(ts, add_special_tokens=False)]
        import tiktoken

        ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in model.value.splitlines() if line)}
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda ts: [len(enc.encode_ordinary(t)) for t in ts]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter()
        for b in batches:
            n: list[int] = []
            for i in range(0, len(b), 500):
                n += lengths([t or "" for t in b.column(b.num_columns - 1).slice(i, 500).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return documents.select(doc, *keep, text).mapInArrow(count, schema.add("n_tokens", "long"))


def _rate(lam: Column, z: Column, cap: Column) -> Column:
    return F.least(cap, F.exp(F.least(F.lit(700.0), lam * z)))


def solve_rates(hist: DataFrame, targets: list[tuple[str, float, int]], whole: float, total: float, tolerance: float = 1e-9, most_steps: int = 80) -> dict[str, dict]:
    """Per source of `targets`: lambda (per mean document length), mean, cap, goal and whether it is saturated.

    hist: (source, n_tokens, count). total: tokens of the mixture, whole: what the shares of all sources with documents
    add up to. A source whose goal needs all documents at the cap is saturated. Newton steps that leave the bracket of
    the root are replaced by its middle.
    """
    spark = hist.sparkSession
    have = {r["source"]: (r["t"], r["n"]) for r in hist.where(F.col("source").isin([s for s, _, _ in targets])).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("count")).alias("t"), F.sum("count").alias("n")).collect()}
    live = [(s, share, cap) for s, share, cap in targets if s in have and share > 0 and cap > 0]
    out: dict[str, dict] = {s: {"lam": None, "mean": 1.0, "cap": cap, "goal": 0.0, "saturated": False} for s, _, cap in targets}
    state = {}
    for s, share, cap in live:
        t, n = have[s]
        goal = total * share / whole
        out[s] |= {"goal": goal, "mean": t / n, "saturated": goal >= cap * t * (1 - 1e-12)}
        if out[s]["saturated"]:
            out[s]["lam"] = 1e6
        else:
            out[s]["lam"] = 0.0
            state[s] = [-1e4, 1e4]  # the bracket of the root
    for _ in range(most_steps):
        if not state:
            break
        now = spark.createDataFrame([(s, float(out[s]["lam"]), float(out[s]["mean"]), float(out[s]["cap"])) for s in state], "source string, lam double, mean double, cap double")
        z = F.col("n_tokens") / F.col("mean")
        w = _rate(F.col("lam"), z, F.col("cap"))
        mass = F.col("n_tokens") * F.col("count") * w
        sums = hist.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(mass).alias("g"), F.sum(F.when(w < F.col("cap"), mass * z).otherwise(0.0)).alias("h")).collect()
        for r in sums:
            s, lam, goal = r["source"], out[r["source"]]["lam"], out[r["source"]]["goal"]
            if abs(r["g"] - goal) <= tolerance * goal:
                del state[s]
                continue
            b = state[s]
            b[0 if r["g"] < goal else 1] = lam
            step = lam - (r["g"] - goal) / r["h"] if r["h"] > 0 else None
            out[s]["lam"] = step if step is not None and b[0] < step < b[1] else (b[0] + b[1]) / 2
    return out


def mixture(documents: DataFrame, doc: str, text: str, source: str, targets: DataFrame, total: float | None = None, tokenizer: str | None = None, seed: int = 17, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(documents to draw, report).

    Draw: doc, source, n_tokens, copies (1 to the source's max_repeats). Report, one row per target source: source,
    target_share, max_repeats, n_docs, n_tokens available, longest_doc, drawn_docs, drawn_tokens, reached_share, saturated.
    Documents without tokens, with a null source or of a source without target are never drawn; a source without
    documents reaches 0, and the others keep their proportions; repeated rows are documents of their own. Of
    several target rows of one source the greatest (share, repeats) counts, rows with a null are left out. total: tokens
    of the mixture; by default the greatest at which every source that has documents can reach its share. The table may
    name any number of sources: the driver holds CHUNK of them at a time. A source that holds a third of all rows is
    only ever summed with map-side combining.
    """
    spark = documents.sparkSession
    one = targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    goals = written(one.select("source", F.col("t.target_share").cast("double").alias("share"), F.col("t.max_repeats").cast("int").alias("cap")), "goals")
    tokens = written(token_counts(documents.select(doc, F.col(source).alias("source"), text), doc, text, ["source"], tokenizer), "tokens")
    # one row per source and length: all that the iterations read
    hist = written(tokens.where("source IS NOT NULL AND n_tokens > 0").groupBy("source", "n_tokens").count(), "token-lengths")
    sizes = hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("count")).alias("t"))
    live = goals.join(sizes, "source").where("share > 0 AND cap > 0")
    whole, most = live.agg(F.sum("share"), F.min(F.col("cap") * F.col("t") / F.col("share"))).first()
    whole = float(whole or 1.0)
    chunks = max(1, -(-goals.count() // chunk))
    plan = None
    for k in range(chunks):
        some = [(r["source"], r["share"], r["cap"]) for r in goals.where(F.pmod(F.xxhash64("source"), F.lit(chunks)) == k).collect()]
        solved = solve_rates(hist, some, whole, float(total if total is not None else (most or 0.0) * whole))
        rows = [(s, share, cap, float(x["lam"] if x["lam"] is not None else -1e6), float(x["mean"]), float(x["goal"]), x["saturated"]) for (s, share, cap) in some for x in [solved[s]]]
        part = written(spark.createDataFrame(rows, "source string, target_share double, max_repeats int, lam double, mean double, goal double, saturated boolean"), "plan")
        plan = part if plan is None else plan.unionByName(part)
    usable = tokens.where("n_tokens > 0").join(plan.where("goal > 0"), "source")
    w = _rate(F.col("lam"), F.col("n_tokens") / F.col("mean"), F.col("max_repeats").cast("double"))
    u = F.pmod(F.xxhash64(F.lit(seed), doc), F.lit(2**40)) / 2.0**40
    rated = usable.withColumn("w", w).withColumns({"base": F.floor("w").cast("int"), "late": u - (F.col("w") - F.floor("w"))})
    open_ = (F.col("base") < F.col("max_repeats")) & (F.col("w") > F.col("base"))
    # documents with late < theta get one copy more; theta is found to a bin of the bins that cross the goal
    by = rated.groupBy("source", "goal").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("floor"))
    lo, width = F.lit(-1.0), 2.0
    bounds = written(by.select("source", (F.col("goal") - F.col("floor")).alias("left_over"), lo.alias("lo")), "bounds")
    for _ in range(2):
        width /= BINS
        inside = rated.where(open_).join(bounds, "source").where((F.col("late") >= F.col("lo")) & (F.col("late") < F.col("lo") + width * BINS))
        bins = inside.groupBy("source", "left_over", "lo", F.floor((F.col("late") - F.col("lo")) / width).alias("bin")).agg(F.sum("n_tokens").alias("t"))
        upto = bins.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("bin")))
        # all bins that fit in what is left are taken; the next one is divided again
        fits = F.col("upto") <= F.col("left_over")
        taken = upto.groupBy("source", "left_over", "lo").agg(F.coalesce(F.sum(F.when(fits, F.col("t"))), F.lit(0)).alias("got"), F.coalesce(F.min(F.when(~fits, F.col("bin"))), F.lit(BINS)).alias("next"))
        found = taken.select("source", (F.col("left_over") - F.col("got")).alias("left_over"), (F.col("lo") + F.col("next") * width).alias("lo"))
        bounds = written(found, "bounds")
    theta = bounds.select("source", F.col("lo").alias("theta"))
    drawn = rated.join(theta, "source", "left").withColumn("copies", F.col("base") + F.when(open_ & (F.col("late") < F.col("theta")), 1).otherwise(0))
    draw = drawn.where("copies > 0").select(doc, "source", "n_tokens", "copies")
    have = tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest_doc"))
    got = draw.groupBy("source").agg(F.sum("copies").alias("drawn_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"))
    report = plan.join(have, "source", "left").join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    sums = report.select("source", "target_share", "max_repeats", "saturated", *[zero(c).alias(c) for c in ("n_docs", "n_tokens", "longest_doc", "drawn_docs", "drawn_tokens")])
    everything = sums.agg(F.sum("drawn_tokens").alias("_all"))  # one row
    return draw, sums.crossJoin(F.broadcast(everything)).withColumn("reached_share", F.coalesce(F.try_divide(F.col("drawn_tokens"), F.col("_all")), F.lit(0.0))).drop("_all")
