"""A quality classifier by regularised quadratic discriminant analysis, with DataFrame functions for all that is done by row.

A document is described by whole numbers: floor(GRID * x + 0.5) of the logarithms x of shares and lengths in its text. One aggregate over the labelled rows adds up
the numbers and their products by class, exactly, so that means and covariances don't depend on the order of rows. Each class's covariance is
shrunk towards the pooled one, and that towards its diagonal. The driver factors both (Cholesky) and keeps the inverse factors; a document's score is the logistic function of the
difference of the two log densities, each a squared Mahalanobis distance (a sum of squares of products with the cached factor) and a constant.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .simhash import SPACES, words

#: Steps of a statistic per unit.
GRID = 1024
#: What is counted of the characters of words.
CHARS = {"symbols": "#$%&*<>=", "pipes": "|", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "bangs": "!", "digits": "0123456789"}
#: The statistics, as SQL over the counts of counts(). 0.01 keeps what is rare from counting for much.
STATISTICS = {
    "symbols": "ln(0.01D + n_symbols / (n_chars + 1D))",
    "pipes": "ln(0.01D + n_pipes / (n_words + 1D))",
    "capitals": "ln(0.01D + n_capitals / (n_chars + 1D))",
    "bangs": "ln(0.01D + n_bangs / (n_words + 1D))",
    "digits": "ln(0.01D + n_digits / (n_chars + 1D))",
    "repeats": "ln(0.01D + n_repeats / (n_words + 1D))",
    "distinct": "ln((n_distinct + 1D) / (n_words + 1D))",
    "word_length": "ln((n_chars + 1D) / (n_words + 1D))",
    "line_length": "ln((n_words + 1D) / (n_lines + 1D))",
    "words": "ln(n_words + 1D)",
}


@dataclasses.dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and constants of the classes 0 and 1; without both classes, only the share of class 1."""

    share: float
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None
    constant: np.ndarray | None = None


def counts(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, and the counts that the statistics are made of. n_repeats: words equal to the one before; n_chars: of words; a null text has none."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    without = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    chars = [(F.length("_t") - without(SPACES)).cast("long").alias("n_chars"), *(without(c).alias(f"n_{name}") for name, c in CHARS.items())]
    rows = rows.select(*keep, words(F.col("_t")).alias("_w"), (1 + without("\n")).alias("n_lines"), *chars)
    again = F.expr("size(filter(_w, (x, i) -> x = get(_w, i - 1)))").cast("long")
    return rows.withColumns({"n_words": F.size("_w").cast("long"), "n_distinct": F.size(F.array_distinct("_w")).cast("long"), "n_repeats": again}).drop("_w")


def statistics(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, and the statistics x0, x1, ... as whole numbers."""
    made = [F.expr(f"floor({GRID} * {x} + 0.5D)").alias(f"x{i}") for i, x in enumerate(STATISTICS.values())]
    return counts(docs, keep, text).select(*keep, *made)


def learned(rows: DataFrame, shrink: float, diagonal: float) -> Model:
    """The model of rows x0, x1, ... and good (boolean). shrink: the weight of the pooled covariance; diagonal: of its diagonal in the result."""
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs]
    found = {r.good: r for r in rows.groupBy("good").agg(F.count("*").alias("n"), *sums).collect()}  # two rows
    n = [found[c].n if c in found else 0 for c in (False, True)]
    share = (n[1] + 1) / (sum(n) + 2)
    if min(n) < 2:
        return Model(share)
    mean, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        r = found[bool(c)]
        mean[c] = [r[f"s{i}"] / r.n / GRID for i in range(d)]
        for i, j in pairs:  # whole numbers up to here, so that nothing cancels
            scatter[c, i, j] = scatter[c, j, i] = (r[f"s{i}_{j}"] * r.n - r[f"s{i}"] * r[f"s{j}"]) / r.n / GRID**2
    pooled = scatter.sum(0) / (sum(n) - 2)
    factor, constant = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        cov = (1 - shrink) * scatter[c] / (n[c] - 1) + shrink * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(pooled) + 1 / GRID)
        lower = np.linalg.cholesky(cov)
        factor[c] = np.linalg.inv(lower)
        constant[c] = np.log(n[c] / sum(n)) - np.log(np.diag(lower)).sum()
    return Model(share, mean, factor, constant)


def _log_density(model: Model, c: int) -> str:
    """SQL of the log density (less what both classes share) and the log share of class c."""
    d = len(STATISTICS)
    centred = [f"(x{j} / {GRID}D - {float(model.mean[c, j])!r}D)" for j in range(d)]
    squares = (f"power({' + '.join(f'{float(model.factor[c, i, j])!r}D * {centred[j]}' for j in range(i + 1))}, 2)" for i in range(d))
    return f"({float(model.constant[c])!r}D - 0.5D * ({' + '.join(squares)}))"


def score(model: Model) -> Column:
    """The probability of class 1 of a row of statistics, rounded to 9 places."""
    if model.mean is None:
        return F.lit(model.share)
    return F.round(F.expr(f"1 / (1 + exp(least(700D, greatest(-700D, {_log_density(model, 0)} - {_log_density(model, 1)}))))"), 9)


def held_out(id: str) -> Column:
    """Rows that nothing is learned from; those with a null id are learned from, if they have a label."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality", cutoff: float = 0.3, shrink: float = 0.3, diagonal: float = 0.05) -> DataFrame:
    """id, held_out, score (0 to 1, likelier 1 if higher) and predicted (1 if score >= cutoff, else 0) of each row of docs.

    All labelled rows that aren't held_out() are learned from: of several labels of an id the lowest counts, 1 is good and anything else isn't; null
    ids and labels don't count. A null text is an empty one and is scored as such. Repeated rows each count. With fewer than two rows of either class,
    every score is the share of good ones, plus one in two more. No rows give no rows.
    """
    rows = written(statistics(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), ["id"], "text"))
    said = labels.where(F.col(id).isNotNull() & F.col(quality).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("id")).agg((F.min(quality) == 1).alias("good"))
    model = learned(rows.join(said, "id"), shrink, diagonal)
    return rows.select(F.col("id").alias(id), held_out("id").alias("held_out"), score(model).alias("score")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
