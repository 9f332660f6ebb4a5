"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

A base of fixed rules fails short and repetitive texts. Beyond it, four ratios of two counts are compared with cutoffs, from loose to strict. All
cutoffs of all rules stand in one fixed order, loosest first, rule by rule; a document's rank says how early in that order it is first rejected. So
what a threshold on the rank rejects only grows along the order, and each stratum needs one threshold only, which labelled documents choose.

A threshold may be used if the share of good documents that it rejects is certified to be at most `alpha`: the exact
probability of seeing so few rejections among the stratum's good documents, were the share any larger, is at most the stratum's part of `delta`.
The parts are in proportion to the strata's good documents (a weighted Bonferroni correction). Within a stratum the thresholds are tested in
the fixed order, which needs no further correction. Of the certified thresholds the one is used that rejects the most bad documents less good ones.
With no rejection seen, log(part) / log(1 - alpha) good documents suffice.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .simhash import SPACES, words

SYMBOLS = "#*$%&|<>"
#: Rules: 100 * the first count > cutoff * the second. As many cutoffs each, from the loosest to the strictest.
RULES = {
    "symbols": ("n_symbols", "word_chars", (40, 30, 20, 15, 10, 8, 6, 5, 4, 3, 2, 1)),
    "capitals": ("n_capitals", "word_chars", (95, 90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10)),
    "lines": ("n_dup_lines", "n_lines", (95, 90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20)),
    "repeats": ("n_repeat_words", "n_words", (48, 46, 44, 42, 40, 38, 36, 34, 32, 30, 25, 20)),
}


def features(docs: DataFrame, id: str, text: str, stratum: str) -> DataFrame:
    """id, stratum, the counts, and base_failed of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), F.col(stratum).alias("stratum"), t.alias("_t"))
    without = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    full = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.select(
        "id", "stratum", words(F.col("_t")).alias("_w"), full.alias("_full"), F.size(F.split("_t", "\n")).cast("long").alias("n_lines"),
        (F.length("_t") - without(SPACES)).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
    )
    # Each window of three words as a hash with its place, in the order of hashes, so that equal windows are neighbours.
    three = F.expr("transform(IF(size(_w) > 2, sequence(0, size(_w) - 3), array()), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) AS h, i AS i))")
    rows = rows.select(
        "id", "stratum", F.size("_w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_capitals", "n_lines",
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"), F.sort_array(three).alias("_s"),
    )
    again = "filter(_s, (x, k) -> x.h = get(_s, k - 1).h OR x.h = get(_s, k + 1).h).i"
    covered = f"aggregate(sort_array({again}), struct(-3 AS last, 0L AS n), (s, i) -> struct(i AS last, s.n + least(3, i - s.last) AS n), s -> s.n)"
    rows = rows.select(*(c for c in rows.columns if c != "_s"), F.expr(covered).alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, led back to x; for x >= 1."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - F.log(reduce(Column.__mul__, (x + i for i in range(8))))


def at_most(k: Column, n: Column, p: float) -> Column:
    """The probability that of n trials, each hitting with probability p, at most k hit.

    Terms are summed from that of k downwards, as many as can add to a double: with k below n * p the i-th before it is less than exp(-i**2 / (2 * n * p)) of it.
    """
    log_k = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log(1 - p)
    # Terms relative to that of k: each is the one before times a ratio that falls. k and n are looked up as the columns _k and _n within the fold.
    terms = f"cast(least(_k, ceil(10 * sqrt(_n * {p}D)) + 100) AS bigint)"
    fold = f"aggregate(sequence(0L, {terms}), struct(1D AS t, 0D AS s), (a, i) -> struct(a.t * (_k - i) * {1 - p}D / ((_n - _k + i + 1) * {p}D) AS t, a.s + a.t AS s), a -> a.s)"
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_k) * F.expr(fold)))


def level(rule: str) -> Column:
    """How many of the rule's cutoffs a row is beyond."""
    a, b, cuts = RULES[rule]
    return reduce(Column.__add__, ((100 * F.col(a) > c * F.col(b)).cast("int") for c in cuts))


def rank() -> Column:
    """How early in the order of all cutoffs a row is first rejected: the loosest cutoff of the first rule has the largest number; 0 for none."""
    ranks = (F.when(level(r) > 0, len(RULES) * level(r) - i).otherwise(0) for i, r in enumerate(RULES))
    return F.greatest(*ranks)


def cutoffs(rows: DataFrame, labels: DataFrame, id: str, quality: str, alpha: float, delta: float) -> DataFrame:
    """stratum, n (good documents), k (of them rejected), hits (bad ones rejected), p, part (of delta) and cut, for each stratum.

    A row is rejected if its rank is cut or more; cut is null where no threshold is certified and of use, and so are k, hits and p.
    rows: features(). labels: id and quality (1 good, 0 bad); of several labels of an id the lowest counts, nulls don't. All labelled rows that pass the base count.
    """
    said = labels.where(F.col(id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(quality).alias("good"))
    seen = rows.where("NOT base_failed").join(said, "id").select("stratum", "good", rank().alias("rank")).groupBy("stratum", "rank").agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") != 1).alias("bad"))
    seen = written(seen)  # at most 49 rows a stratum
    strata = seen.groupBy("stratum").agg(F.sum("good").alias("n"))
    total = strata.agg(F.sum("n")).first()[0] or 1
    top = len(RULES) * max(len(cuts) for _, _, cuts in RULES.values())
    grid = strata.select(F.col("stratum").alias("_s"), "n", F.explode(F.sequence(F.lit(1), F.lit(top))).alias("cut"))
    tested = grid.join(seen, F.col("_s").eqNullSafe(F.col("stratum")) & (F.col("rank") >= F.col("cut")), "left")
    tested = tested.groupBy(F.col("_s").alias("stratum"), "n", "cut").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("k"), F.coalesce(F.sum("bad"), F.lit(0)).alias("hits"))
    tested = tested.withColumns({"_k": F.col("k").cast("double"), "_n": F.col("n").cast("double"), "part": delta * F.col("n") / total})
    tested = tested.withColumn("p", at_most(F.col("_k"), F.col("_n"), alpha)).drop("_k", "_n")
    best = F.row_number().over(Window.partitionBy("stratum").orderBy((F.col("hits") - F.col("k")).desc(), F.col("cut").desc()))
    chosen = tested.where("n > 0 AND p <= part AND hits > k").withColumn("_best", best).where("_best = 1").select(F.col("stratum").alias("_s"), "cut", "k", "hits", "p")
    found = strata.join(chosen, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    return written(found.select("stratum", "n", "k", "hits", "p", (delta * F.col("n") / total).alias("part"), "cut"))


def judged(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang", quality: str = "quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """id, the counts, base_failed and kept of each row.

    A null text has no words. Null strata are one stratum; a stratum without enough labels rejects nothing beyond the base.
    Labels without a row, and rows without a label, are fine; repeated rows each count. No rows give no rows.
    """
    rows = written(features(docs, id, text, stratum))
    cuts = cutoffs(rows, labels, id, quality, alpha, delta).select(F.col("stratum").alias("_stratum"), "cut")
    judged = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    rejected = F.coalesce(rank() >= F.col("cut"), F.lit(False))
    return judged.select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
