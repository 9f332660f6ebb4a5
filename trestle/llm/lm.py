"""Language-model scores by stupid backoff, from counts of the whole corpus.

The score of a word after its context is the share of the context's count, if the n-gram was seen `least` times or more (a text has itself been
counted), else `alpha` times the score after the context without its first word; of a single word, its share of all words.

It is all tables. Texts are exploded into n-grams, each known by the hashes of its context and of its rest, which is the n-gram without its first word;
grouping them gives the count table, partitioned by hash. Joins with the table of shorter n-grams give each n-gram what it adds to a text's score over
backing off: the difference of its own score and of its rest's. What was seen less often adds nothing,
so that the table holds repeated n-grams only. Joined with the exploded n-grams of the texts and summed up by
document, it gives the scores.

An n-gram is no more frequent than its context and its rest. So those of three words or more are counted only where both parts may be in the table of
shorter ones, and only n-grams that may be in a table are joined with it: bitmaps of BITS bits tell, whatever the tables' sizes. What a bitmap lets
through wrongly is counted and found to be too rare, or finds nothing in the join: results are exact whatever the bitmap's load.

N-grams are counted and joined in `passes`, each over those of some hashes, so that the files of a shuffle are gone before the next one's. The
most frequent n-grams, at most HOT of them however many there are, go to every task; their part of a score is summed up where the text
is read, so that none of them is dealt out to one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, dropped, lower_ascii, slices, span_hashes, utf8, word_spans, written

#: Bytes of text whose n-grams a task sums up at once.
SLICE = 4 << 20
#: No more n-grams than this go to every task, each of them one in FEW times as many of all at least; and the rows among which their sums are spread.
HOT, FEW, CARRIERS = 1 << 20, 16, 1024
#: Bits of a bitmap of n-grams, and the parts in which they are made.
BITS, PARTS = 1 << 27, 1 << 10

# The primes of the 64-bit xxHash, which Spark's xxhash64 is.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    turned = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    h = seed + P5 + np.uint64(8) ^ turned(x * P2, 31) * P1
    h = turned(h, 27) * P1 + P4
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def joined_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives two longs."""
    return _hash_long(word, _hash_long(context, np.full(len(context), 42, np.uint64)))


def held_in(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Whether each gram's bit is set."""
    at = gram >> np.uint64(65 - BITS.bit_length())
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def bitmap(table: DataFrame) -> np.ndarray:
    """BITS bits in bytes, of which those of the table's grams are set. Each part is made in one task; the driver gets BITS / 8 bytes."""
    size = BITS // 8 // PARTS

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, np.uint8)
        for b in batches:
            at = b.column("gram").to_numpy().view(np.uint64) >> np.uint64(65 - BITS.bit_length())
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for i in np.flatnonzero(bits.reshape(PARTS, size).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([bits[size * i : size * (i + 1)].tobytes()])], ["part", "bits"])

    dealt = table.select("gram").repartition(F.shiftrightunsigned("gram", 65 - PARTS.bit_length()))
    found = bounded(dealt).mapInArrow(made, "part long, bits binary").toArrow()
    out = np.zeros((PARTS, size), np.uint8)
    for i, x in zip(found.column("part").to_pylist(), found.column("bits"), strict=True):
        out[i] |= np.frombuffer(x.as_buffer(), np.uint8)
    return out.reshape(-1)


def grams(texts: pa.Array, order: int, known: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Each word's row; and for each order from 1 on, of the words at which an n-gram ends: their places, the hashes of its context (0 for no word), of its rest and its own.

    The hash of a single word is the word's, which also is its rest; of a longer n-gram, that of its context and its rest. known: a bitmap of n-grams of order - 1, without which those of that order are left out.
    """
    data, at = utf8(texts)
    data = lower_ascii(data)
    starts, ends, row = word_spans(data, at)
    whole = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)  # by place: the hash of the n-gram that ends there
    there = np.ones(len(whole), bool)  # and whether there is one
    found = [(np.arange(len(whole)), np.zeros(len(whole), np.uint64), whole, whole)]
    for n in range(2, order + 1):
        if known is not None and n == order:
            there[there] = held_in(known, whole[there])
            there[1:] &= there[:-1]
        else:
            there[1:] = there[:-1] & there[1:]
        there[1:] &= row[1:] == row[:-1]
        there[:1] = False
        place = np.flatnonzero(there)
        context, rest = whole[place - 1], whole[place]
        whole = whole.copy()
        whole[place] = joined_hash(context, rest)
        found.append((place, context, rest, whole[place]))
    return row, found


def exploded(docs: DataFrame, text: str, orders: range, passes: int, k: int, known=None) -> DataFrame:
    """context (0 for single words), rest and times: the n-grams of the orders in pass k, summed up over slices. known: a bitmap (broadcast) of those one word shorter than the longest."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, "_text", SLICE):
            _, found = grams(b.column("_text"), orders[-1], known and known.value)
            for n in orders:
                _, context, rest, own = found[n - 1]
                if passes > 1:
                    mine = own.view(np.int64) % passes == k
                    context, rest, own = context[mine], rest[mine], own[mine]
                alike = np.argsort(own)  # as np.unique with return_index, which sorts stably and so takes twice as long
                own = own[alike]
                first = np.flatnonzero(np.append(np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))
                one, times = alike[first], np.diff(first, append=len(own))
                yield pa.RecordBatch.from_arrays([pa.array(context[one].view(np.int64)), pa.array(rest[one].view(np.int64)), pa.array(times)], ["context", "rest", "times"])

    return bounded(docs).select(F.col(text).alias("_text")).mapInArrow(count, "context long, rest long, times long")


def counted(docs: DataFrame, text: str, orders: range, least: int, passes: int, known=None) -> list[DataFrame]:
    """context, rest and times of all n-grams that the texts hold at least `least` times, single words at least twice (or once, if that is enough); a table for each pass."""
    tables = []
    for k in range(passes):
        # Each slice gives an n-gram once. Most are in one slice only, so that summing up slices before the shuffle would cost more than it saves.
        sums = exploded(docs, text, orders, passes, k, known).repartition("context", "rest").groupBy("context", "rest").agg(F.sum("times").alias("times"))
        tables.append(written(sums.where(F.col("times") >= F.when(F.col("context") == 0, min(least, 2)).otherwise(least)), clean=True))
    return tables


def gains(docs: DataFrame, text: str, order: int, total: int, alpha: float, least: int, passes: int) -> list[DataFrame]:
    """gram, times and gain, a table for each order: what an n-gram adds to the logarithm of a text's score over backing off; single words over one seen once."""
    spark = docs.sparkSession
    levels = []
    for n in range(1, order + 1):
        if n == 1:
            parts = counted(docs, text, range(1, min(2, order) + 1), least, passes)
        elif n > 2:
            known = spark.sparkContext.broadcast(bitmap(levels[-1]))
            parts = counted(docs, text, range(n, n + 1), least, passes, known)
            known.destroy()
        own = reduce(DataFrame.unionByName, parts).where(F.col("context") == 0 if n == 1 else F.col("context") != 0)
        if n == 1:
            own = own.select(F.col("rest").alias("gram"), "times", (F.log10("times") - math.log10(max(total, 1))).alias("score"), F.log10("times").alias("gain"))
        else:
            contexts = levels[-1].select(F.col("gram").alias("context"), F.col("times").alias("_of"))
            backing = levels[-1].select(F.col("gram").alias("rest"), F.col("score").alias("_back"))
            own = own.join(contexts.hint("shuffle_hash"), "context").join(backing.hint("shuffle_hash"), "rest")
            score = F.log10("times") - F.log10("_of")
            own = own.select(F.xxhash64("context", "rest").alias("gram"), "times", *[score.alias("score")] * (n < order), (score - math.log10(alpha) - F.col("_back")).alias("gain"))
        levels.append(written(own, clean=True))
        if n > 1 or order == 1:
            dropped(spark, *parts)
    return [x.select("gram", "times", "gain") for x in levels]


def hot_from(table: DataFrame, share: float, hot: int) -> int | None:
    """How many times an n-gram must be there to be among the most frequent ones: more than share, and so that they are `hot` at most. None if none is."""
    found = table.where(F.col("times") > share).groupBy("times").count().toArrow()
    times, n = (found.column(c).to_numpy() for c in ("times", "count"))
    down = np.argsort(-times)
    some = int((np.cumsum(n[down]) <= hot).sum())
    return int(times[down[some - 1]]) if some else None


class Hot:
    """The most frequent n-grams' gains, sorted by gram, with the place of the first one of each 2**22nd of the hashes."""

    def __init__(self, rows: pa.Table):
        gram, gain = (rows.column(c).to_numpy() for c in ("gram", "gain"))
        order = np.argsort(gram.view(np.uint64))
        self.gram, self.gain = gram.view(np.uint64)[order], gain[order]
        self.first = np.zeros((1 << 22) + 1, np.int32)
        np.cumsum(np.bincount((self.gram >> np.uint64(42)).astype(np.int64), minlength=1 << 22), out=self.first[1:])

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in gram of hot ones, and their gains."""
        part = (gram >> np.uint64(42)).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        some = np.flatnonzero(at < end)
        at, end = at[some], end[some]
        found = [(some[:0], at[:0])]
        while len(some):
            hit = self.gram[at] == gram[some]
            found.append((some[hit], at[hit]))
            on = np.flatnonzero(~hit & (at + 1 < end))
            some, at, end = some[on], at[on] + 1, end[on]
        place, at = (np.concatenate(x) for x in zip(*found, strict=True))
        return place, self.gain[at]


def document_grams(rows: DataFrame, order: int, passes: int, k: int, hot, known) -> DataFrame:
    """_id, _t, gram and times: each row's n-grams of pass k that may be in the bitmap `known` and aren't hot; and the sum of the hot ones' gains, as the times of a carrier. rows: _id, _t, _text."""

    def explode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carriers = carrier_grams().view(np.uint64)
        for b in slices(parts, "_text", SLICE // 2):
            row, found = grams(b.column("_text"), order)
            cold, sums = [], np.zeros(b.num_rows)
            for place, _, _, own in found:
                mine = np.flatnonzero(own.view(np.int64) % passes == k)
                own, of = own[mine], row[place[mine]]
                at, gain = hot.value.find(own)
                sums += np.bincount(of[at], gain, minlength=b.num_rows)
                rest = held_in(known.value, own)
                rest[at] = False
                cold.append((own[rest], of[rest]))
            some = np.flatnonzero(sums)
            t = b.column("_t").to_numpy()[some].view(np.uint64)
            own, of = (np.concatenate(x) for x in zip(*cold, (carriers[t % np.uint64(CARRIERS)], some), strict=True))
            times = np.ones(len(own))
            times[len(own) - len(some) :] = sums[some]
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([b.column("_id").take(of), b.column("_t").take(of), pa.array(own.view(np.int64)), pa.array(times)], ["_id", "_t", "gram", "times"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(explode, f"_id {kind}, _t long, gram long, times double")


def carrier_grams() -> np.ndarray:
    """Grams that stand for sums; no text has them (but for a clash of 64-bit hashes)."""
    n = np.arange(CARRIERS, dtype=np.uint64)
    return joined_hash(np.full(CARRIERS, np.uint64(2**64 - 1)), n).view(np.int64)


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = 3, alpha: float = 0.4, least: int = 2, passes: int = 2, hot: int = HOT) -> DataFrame:
    """id, n_words and score of each row: the mean of the logarithms (to 10) of its words' scores, null without words.

    Words are the runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z in lower case. A null text has none. Repeated rows count as often as they
    are there; null ids stay. No rows give no rows. Rows are told apart by their id and a hash of their text, and those that are equal in both share a score.
    """
    from .mixing import word_counts

    spark = docs.sparkSession
    rows = bounded(docs).select(F.col(id).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    alike = written(word_counts(docs, text, [F.col(id).alias("_id"), F.xxhash64(text).alias("_t")], "n_words").groupBy("_id", "_t", "n_words").agg(F.count("*").alias("_alike")), clean=True)
    total = alike.agg(F.sum(F.col("n_words") * F.col("_alike"))).first()[0] or 0
    levels = gains(docs, text, order, total, alpha, least, passes)
    table = reduce(DataFrame.unionByName, levels)
    least_hot = hot_from(table, order * total / (FEW * hot) if hot else math.inf, hot)
    often = F.lit(False) if least_hot is None else F.col("times") >= least_hot
    told = spark.sparkContext.broadcast(Hot(table.where(often).select("gram", "gain").toArrow()))
    carriers = spark.createDataFrame([(g, 1.0) for g in carrier_grams().tolist()], "gram long, gain double")
    sums = []
    for k in range(passes):
        mine = table.where(~often & (F.pmod("gram", F.lit(passes)) == k)).select("gram", "gain")
        known = spark.sparkContext.broadcast(bitmap(mine))
        added = document_grams(rows, order, passes, k, told, known).join(mine.unionByName(carriers).hint("shuffle_hash"), "gram")
        sums.append(written(added.groupBy("_id", "_t").agg(F.sum(F.col("times") * F.col("gain")).alias("_gain")), clean=True))
        known.destroy()
    told.destroy()
    gained = reduce(DataFrame.unionByName, sums).groupBy("_id", "_t").agg(F.sum("_gain").alias("_gain"))
    a, g = alike.alias("a"), gained.alias("g")
    both = a.join(g, F.col("a._id").eqNullSafe(F.col("g._id")) & (F.col("a._t") == F.col("g._t")), "left").select("a._id", "n_words", "_alike", "_gain")
    # Every word starts from a word seen once, after as many steps of backing off as it has words before it, at most order - 1.
    n = F.col("n_words")
    short = F.least(n, F.lit(order - 1))
    steps = short * (short - 1) / 2 + F.greatest(n - (order - 1), F.lit(0)) * (order - 1)
    whole = F.coalesce(F.col("_gain"), F.lit(0.0)) / F.col("_alike") + steps * math.log10(alpha) - n * math.log10(max(total, 1))
    return both.withColumn("_", F.explode(F.expr("sequence(1L, _alike)"))).select(F.col("_id").alias(id), "n_words", F.when(n > 0, whole / n).alias("score"))
