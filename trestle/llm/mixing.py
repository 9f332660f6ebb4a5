"""Mixing sources to target weights.

The words of each source, document after document, are packed into blocks of fixed length. The mix is made of
shards of so many slots; each shard draws how many of its slots each source gets. The draws are multinomial and, taken together, conditioned on
the sources' targets, which are met to the block: halves of the shards get their slots by a multivariate hypergeometric draw from what both
halves get, down to the single shard. So a task can draw any shard by itself, and knows how many slots of each source come before it. The slots
of a source are numbered through all shards, and a pseudorandom permutation of the source's block indices, another one each time
the source starts anew, says which block each slot holds. Slots and blocks meet in a join on that index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, mixed, partitions, slices, utf8, word_spans, written

_SUM = Window.unboundedPreceding, -1
#: Every task holds the list of sources: so many at most.
SOURCES = 100_000
#: Slots among which numpy makes one hypergeometric draw; among more, drawn() makes it.
DRAW = 900_000_000


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0 to n - 1 takes each index: a Feistel network, walked until it falls below n."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mixed(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) & mask)
        x[todo] = left << half | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def word_counts(docs: DataFrame, text: str, keep: list[Column], out: str = "size") -> DataFrame:
    """The columns in keep, and the number of words of each row's text."""
    rows = bounded(docs).select(F.struct(*keep).alias("row"), F.col(text).alias("_text"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, "_text"):
            n = np.bincount(word_spans(*utf8(b.column("_text")))[2], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n.astype(np.int64))], ["row", out])

    return rows.mapInArrow(count, f"row {rows.schema['row'].dataType.simpleString()}, {out} long").select("row.*", out)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """_source, s (its place by code point, null last), source_size, target; sized: _source, size.

    The sources weigh by their place, weights repeating, and share `share` times all sizes. No target is above
    `most` times its source's size; what would be is reshared by weight. One row a source: these tables are as
    small as the list of sources.
    """
    by = Window.orderBy(F.col("_source").asc_nulls_last())
    of = sized.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("s", (F.row_number().over(by) - 1).cast("int"))
    of = of.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("s") % len(weights) + 1)).withColumn("cap", most * F.col("source_size"))
    # In the order of cap per weight, a source is at its cap if its share of what those before it leave would pass it.
    order = Window.orderBy(F.col("cap") / F.col("w"), "s")
    all_ = Window.partitionBy()
    of = of.withColumn("total", share * F.sum("source_size").over(all_))
    before = of.withColumn("taken", F.coalesce(F.sum("cap").over(order.rowsBetween(*_SUM)), F.lit(0.0))).withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    capped = before.withColumn("full", (F.col("total") - F.col("taken")) * F.col("w") >= F.col("cap") * F.col("rest"))
    free = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(all_)
    level = F.try_divide(free, F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(all_))
    return capped.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", level * F.col("w")))).select("_source", "s", "source_size", "target")


def mix(docs: DataFrame, carry: list[str], id: str = "doc_id", source: str = "source", text: str = "text", block: int = 64, shard: int = 8192, seed: int = 7, **targets) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (row, carried: a struct of the columns of carry, size, source_size, target), and for their row numbers what the mix takes.

    The second has row, lo, hi, times, epochs for each part of a document that lies in one block of the mix: its words
    lo to hi, how often they are taken, and a bit for each pass over the source that takes them.

    A null text has no words; a null source is a source. Rows are told apart by a number that is fixed when the first table is
    written, so repeated rows and null ids are documents of their own. Sources without words have the target 0. There may be up to SOURCES sources.
    Draws depend on seed and on places only, so that reruns agree as long as documents do.
    """
    spark = docs.sparkSession
    keep = [F.struct(*(F.col(c) for c in carry)).alias("carried"), F.col(id).alias("_id"), F.col(source).alias("_source")]
    base = written(word_counts(docs, text, keep).withColumn("row", F.monotonically_increasing_id()))
    of = written(source_targets(base, **targets))
    chunks = max(1, math.isqrt(base.count()))
    rows = base.withColumn("_c", F.pmod(F.xxhash64("_id", "size"), F.lit(chunks)))
    rows = rows.join(of.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    # Each document's first word in its source's stream: within its chunk, and the chunks before it.
    own = Window.partitionBy("s", "_c").orderBy("_id", "size", "row").rowsBetween(*_SUM)
    before = Window.partitionBy("s").orderBy("_c").rowsBetween(*_SUM)
    chunk = rows.groupBy("s", "_c").agg(F.sum("size").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    start = (F.col("_base") + F.coalesce(F.sum("size").over(own), F.lit(0))).alias("start")
    placed = rows.select("row", "s", "_c", "_id", "size").join(chunk, ["s", "_c"]).select("row", "s", "size", start).where("size > 0")

    slots = source_slots(of, block, shard, seed).groupBy("s", "b").agg(F.count("*").alias("times"), F.bit_or(F.expr("shiftleft(1, epoch)")).alias("epochs"))
    end = F.col("start") + F.col("size")
    parts = placed.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    lo, hi = F.greatest(F.lit(0), F.col("b") * block - F.col("start")), F.least(F.col("size"), (F.col("b") + 1) * block - F.col("start"))
    taken = parts.select("row", "s", "b", lo.alias("lo"), hi.alias("hi")).join(slots.hint("merge"), ["s", "b"])  # as many slots as blocks: never broadcast
    rows = rows.select("row", "carried", "size", "source_size", "target")
    return rows, taken.select("row", "lo", "hi", "times", "epochs")


def drawn(good: int, bad: int, most: int, chance: np.random.Generator) -> int:
    """Of `most` items drawn from good and bad ones without putting any back, how many are good.

    Beyond numpy's bound the good ones are drawn as a binomial number, which is kept with the probability (relative to the largest) that the
    bad ones make up the rest: two binomial numbers are hypergeometric once their sum is given. At least two of three draws or so are kept.
    """
    if good + bad <= DRAW:
        return int(chance.hypergeometric(good, bad, most))
    if good > bad:
        return most - drawn(bad, good, most, chance)
    if not 0 < most < good + bad:
        return good if most else 0
    p = most / (good + bad)

    def log_chance(b: int) -> float:
        return b * math.log(p) + (bad - b) * math.log1p(-p) - math.lgamma(b + 1) - math.lgamma(bad - b + 1)

    top = log_chance(min(bad, int((bad + 1) * p)))
    while True:
        a = int(chance.binomial(good, p))
        if 0 <= most - a <= bad and math.log(1 - chance.random()) <= log_chance(most - a) - top:
            return a


def halved(counts: np.ndarray, most: int, chance: np.random.Generator) -> np.ndarray:
    """How many of the slots of each source are among the first `most` of all, in a random order."""
    rest = int(counts.sum())
    if rest <= DRAW:
        return chance.multivariate_hypergeometric(counts, most, method="marginals")
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = drawn(c, rest, most, chance)
        most -= int(out[i])
    return out


def shard_draws(counts: np.ndarray, shard: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of shards low to high - 1: its number, how many slots of each source come before it, and how many it has. counts: the slots of each source in all shards."""
    total = int(counts.sum())

    def draw(a: int, b: int, before: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if a >= high or b <= low:
            return
        if b - a == 1:
            yield a, before, own
            return
        m = (a + b) // 2
        left = halved(own, m * shard - a * shard, np.random.default_rng([seed, a, b]))
        yield from draw(a, m, before, left)
        yield from draw(m, b, before + left, own - left)

    if total:
        yield from draw(0, -(-total // shard), np.zeros_like(counts), counts)


def source_slots(of: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """s, b, epoch: the blocks that the slots of all shards hold. of has one row a source, and goes to every task."""
    spark = of.sparkSession
    blocks = F.ceil(F.col("source_size") / block)
    quota = of.where("source_size > 0 AND target > 0").select("s", blocks.alias("blocks"), F.least(F.round(F.col("target") * blocks / F.col("source_size")), 2 * blocks).cast("long").alias("quota"))
    if quota.count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    told = spark.sparkContext.broadcast(np.array(quota.orderBy("s").collect(), np.int64).reshape(-1, 3).T)
    shards = -(-int(told.value[2].sum()) // shard)

    def held(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, blocks, counts = told.value
        made: list[tuple[np.ndarray, ...]] = []
        for p in parts:
            ids = p.column("id").to_numpy()
            for _, before, own in shard_draws(counts, shard, seed, int(ids[0]), int(ids[-1]) + 1):
                for k in np.flatnonzero(own).tolist():
                    slot = np.arange(before[k], before[k] + own[k])
                    for e in (0, 1):  # no source is passed more than twice
                        i = slot[slot // blocks[k] == e] - e * blocks[k]
                        made.append((np.full(len(i), sources[k]), permuted(i, int(blocks[k]), seed * 1_000_003 + int(sources[k]) * 2 + e), np.full(len(i), e, np.int32)))
                if sum(len(x[0]) for x in made) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], ["s", "b", "epoch"])
                    made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], ["s", "b", "epoch"])

    # Each task has a run of neighbouring shards.
    return spark.range(0, shards, 1, max(1, min(shards, 4 * partitions(spark)))).mapInArrow(held, "s long, b long, epoch int")


def mixed_sizes(docs: DataFrame, id: str = "doc_id", **how) -> DataFrame:
    """id, size, source_size, target and taken (the words that the mix takes of it, repeats counted) of each row."""
    rows, parts = mix(docs, [id], id=id, **how)
    taken = parts.groupBy("row").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    return rows.join(taken, "row", "left").select(F.col("carried")[id].alias(id), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


_WORD = re.compile(r"[^ \t-\r]+")


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The mix as rows of docs' columns: a row for each document and pass over its source that takes words of it.

    A document that is taken whole has its own text; else its text is its taken runs of words, as they stand, joined by line feeds.
    A document that the mix leaves out has no row.
    """
    carry = docs.columns
    rows, parts = mix(docs, carry, id=id, text=text, **how)
    lists = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "epochs"))).alias("_parts"))
    rows = rows.join(lists, "row").select(F.struct(*(F.col("carried")[c].alias(c) for c in carry if c != text)).alias("row"), F.col("carried")[text].alias("_text"), "_parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            at, out = [], []
            for j, (t, ps) in enumerate(zip(b.column("_text").to_pylist(), b.column("_parts").to_pylist(), strict=True)):
                spans = [m.span() for m in _WORD.finditer(t or "")]
                for e in (0, 1):
                    runs: list[list[int]] = []
                    for p in ps:
                        if p["epochs"] >> e & 1:
                            if runs and runs[-1][1] == p["lo"]:
                                runs[-1][1] = p["hi"]
                            else:
                                runs.append([p["lo"], p["hi"]])
                    if runs:
                        at.append(j)
                        out.append(t if runs == [[0, len(spans)]] else "\n".join(t[spans[lo][0] : spans[hi - 1][1]] for lo, hi in runs))
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], ["row", "_text"])

    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(cut, f"row {kind}, _text string")
    return made.select(*(F.col("_text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
