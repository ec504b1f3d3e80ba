"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the expected number of its copies, between 0 and `most`.  Of all rates
that meet the word target of each source, those with the least relative entropy to "one copy of
everything" are min(most, exp(lambda * size / mean size of the source)): exponentially tilted, with
one multiplier a source.  The multipliers maximise a convex dual; Newton steps, kept inside a
bracket, solve it.  A step needs two sums a source over (source, size) cells, which are counted
once; the sums are taken in whole numbers, so reruns agree to the last digit.

Rates become copies by cells: a cell of n documents with rate r gets floor(r) copies of each, and
the rest goes to whole documents, carried from cell to cell along the sizes, so that a source ends
within one document of its target.  Which documents of a cell get the extra copy is decided by a
hash of doc_id, text and, for rows equal in both, a running number; no task ranks a whole cell or source.

Defined results: a null text has size 0 and no words are taken of it; null is a source of its own,
the last; a source without words has target 0; rows with equal doc_id, and equal rows, count each on
their own and have copies of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, by_source_rank, carried, even_parts, hex_bucket, renamed, saved, told_apart, unpacked

#: Sums of a Newton step are whole multiples of 1 / GRAIN words.
GRAIN = 1024


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Each source's target: share of all sizes by weight, at most `most` times its own size, the rest reshared."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[k] for k in sorted(open_))
        want = {k: left * weights[k] / weight for k in sorted(open_)}
        over = [k for k in want if want[k] > most * sizes[k]]
        for k in over or want:
            out[k] = float(most * sizes[k]) if over else want[k]
        left -= sum(out[k] for k in over)
        open_ -= set(over or want)
    return out


def word_count(text: Column | str) -> Column:
    """Number of words of the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rate(lam: Column, most: float) -> Column:
    return F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(lam * F.col("size") / F.col("mean"))))


def multipliers(cells: DataFrame, sources: list[dict], most: float, steps: int = 200, near: float = 1e-9) -> list[float]:
    """lambda of each source; cells: source_no, size, n; sources: number, words, docs, target.

    An error if the targets are not met within `steps` steps.
    """
    spark = cells.sparkSession
    state = [{"lam": 0.0, "low": -math.inf, "high": math.inf, "done": s["words"] == 0 or s["target"] >= most * s["words"] or s["target"] == s["words"]} for s in sources]
    for _ in range(steps):
        active = [(k, s["lam"], sources[k]["words"] / sources[k]["docs"]) for k, s in enumerate(state) if not s["done"]]
        if not active:
            break
        now = spark.createDataFrame(active, "source_no long, lam double, mean double")
        rate = F.exp(F.col("lam") * F.col("size") / F.col("mean"))
        whole = lambda x: F.sum(F.round(x * GRAIN).cast("decimal(38,0)"))
        weight = F.col("n") * F.col("size")
        sums = cells.join(F.broadcast(now), "source_no").groupBy("source_no").agg(whole(weight * F.least(F.lit(most), rate)).alias("have"), whole(F.when(rate < most, weight * rate * F.col("size") / F.col("mean")).otherwise(0)).alias("slope"))
        for r in sums.collect():
            s, target = state[r.source_no], sources[r.source_no]["target"]
            gap, slope = float(r.have) / GRAIN - target, float(r.slope) / GRAIN
            s["low" if gap < 0 else "high"] = s["lam"]
            if abs(gap) <= near * target + 1 / GRAIN:
                s["done"] = True
                continue
            step = s["lam"] - gap / slope if slope > 0 else math.nan
            if not s["low"] < step < s["high"]:  # outside the bracket, or flat
                low, high = s["low"], s["high"]
                step = 2 * high - 1 if low == -math.inf else 2 * low + 1 if high == math.inf else (low + high) / 2
            s["done"] = step == s["lam"]
            s["lam"] = step
    if left := [k for k, s in enumerate(state) if not s["done"]]:
        raise RuntimeError(f"the multipliers of {len(left)} sources have not settled in {steps} steps")
    return [round(s["lam"], 12) for s in state]


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 1, most_sources: int = 10_000) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row of docs (doc_id, text, source).

    Sources take the weights in turn, by code point, null last.  Their totals and multipliers are
    kept on the driver, so more than most_sources of them are refused.
    """
    keys = renamed(docs, ["doc_id", "text", "source"]).select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("number"))
    return decided(saved(keys, "mix-keys"), weights, share, most, seed, most_sources).drop("number")


def decided(keys: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 1, most_sources: int = 10_000) -> DataFrame:
    """keys (doc_id, source, size, text_hash and number, see told_apart; written before) with the columns of mixed()."""
    spark = keys.sparkSession
    totals = keys.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    totals = sorted(totals, key=lambda r: (r.source is None, (r.source or "").encode()))
    want = targets([r.words for r in totals], [weights[k % len(weights)] for k in range(len(totals))], share, most)
    sources = [{"words": r.words, "docs": r.docs, "target": t} for r, t in zip(totals, want, strict=True)]
    by_no = spark.createDataFrame([(k, r.source, r.words, t) for k, (r, t) in enumerate(zip(totals, want, strict=True))], "source_no long, _source string, source_size long, target double")
    keys = keys.join(F.broadcast(by_no), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    cells = saved(keys.groupBy("source_no", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    lams = multipliers(cells, sources, float(most))
    solved = [(k, lam, max(s["words"], 1) / s["docs"], s["target"] >= most * s["words"]) for k, (s, lam) in enumerate(zip(sources, lams, strict=True))]
    solved = spark.createDataFrame(solved, "source_no long, lam double, mean double, full boolean")
    cells = cells.join(F.broadcast(solved), "source_no").withColumn("rate", _rate(F.col("lam"), float(most)))
    cells = cells.withColumn("whole", F.floor("rate").cast("long")).withColumn("_more", F.col("n") * (F.col("rate") - F.col("whole")))
    so_far = F.sum("_more").over(W.partitionBy("source_no").orderBy("size").rowsBetween(W.unboundedPreceding, 0))
    cells = cells.withColumn("_up_to", F.floor(so_far + 0.5)).withColumn("extra", F.col("_up_to") - F.lag("_up_to", 1, 0).over(W.partitionBy("source_no").orderBy("size")))
    cells = cells.select(F.col("source_no").alias("_no"), F.col("size").alias("_size"), "rate", "whole", "extra")
    keys = told_apart(keys, ["doc_id", "source", "text_hash"], "number", "nth")
    words = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "text_hash", "nth")]
    keys = keys.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), *words)))
    parts = even_parts(sum(s["docs"] for s in sources))
    keys = by_source_rank(keys, ["source_no", "size"], ["_h"], hex_bucket("_h", parts), "_rank")
    out = keys.join(cells, (F.col("source_no") == F.col("_no")) & (F.col("size") == F.col("_size")))
    copies = (F.col("whole") + (F.col("_rank") < F.col("extra")).cast("long")).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", "text_hash", "number")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix has copies of it.

    Rows are numbered and written first; each finds its own copies by that number, equal rows too.
    """
    own = carried(docs, ["doc_id", "source", "text"])
    own = saved(own.select("row", "doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("number")), "mix-rows")
    places = decided(own.drop("row"), **options).where("copies > 0").select("number", "copies")
    made = own.select("row", "number").join(places, "number").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpacked(made, docs.columns)
