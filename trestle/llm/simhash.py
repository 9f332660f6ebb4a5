"""Document fingerprints by SimHash, with DataFrame functions only.

The terms of a text are its pairs of neighbouring words (the last word with nothing), each weighing as many as its
characters, up to a bound, so that no single run of characters outvotes a text. Every bit of a term's 128-bit hash votes with the term's weight, and a bit of
the fingerprint is set if more than half of all weight votes for it. Two bits' votes share a 64-bit sum, 32 bits each, so 64 sums make a
fingerprint; they are summed up within the task that reads a text before anything is shuffled. A text weighs at most twice its
characters, of which a row holds less than 2**31, so that no sum runs over; each row is summed up by itself.

Near fingerprints are found by block tables: the 128 bits are cut into blocks that may each differ in a few bits, so many that
fingerprints within the radius keep to it in one block at least. Fingerprints have a row for each block; those that ask have one
for each value that the block may differ to, and both are joined on them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

SPACES = " \t\n\x0b\x0c\r"
#: The most that a term weighs.
WEIGHT = 16


def words(text: Column) -> Column:
    """The maximal runs of characters other than 0x20 and 0x09 to 0x0D."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def simhashes(texts: DataFrame, keys: list[str], text: str, out: list[str]) -> DataFrame:
    """keys, and two 64-bit halves of the fingerprint named in out, of each row. keys must tell the rows apart. A text without words has the fingerprint 0."""
    w = texts.select(*keys, words(F.coalesce(text, F.lit(""))).alias("_w"))
    pairs = F.arrays_zip(F.col("_w").alias("a"), F.expr("slice(_w, 2, greatest(size(_w) - 1, 0))").alias("b"))
    mark = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    t = w.select(*keys, F.explode(F.concat(mark, pairs)).alias("_t")).select(*keys, "_t.a", "_t.b")
    weight = F.when(F.col("a").isNull(), 0).otherwise(F.least(F.length("a") + F.coalesce(F.length("b"), F.lit(0)), F.lit(WEIGHT))).cast("long")
    t = t.select(*keys, weight.alias("_v"), F.xxhash64("a", "b").alias("_h0"), F.xxhash64("a", "b", F.lit(1)).alias("_h1"))
    votes = [F.sum(F.expr(f"(shiftrightunsigned(_h{k}, {i}) & 4294967297L) * _v")).alias(f"_s{k}_{i}") for k in (0, 1) for i in range(32)]
    sums = t.groupBy(*keys).agg(F.sum("_v").alias("_all"), *votes)

    def half(k: int) -> Column:
        bits = []
        for i in range(32):
            for shift, votes in ((i, f"(_s{k}_{i} & 4294967295L)"), (i + 32, f"shiftrightunsigned(_s{k}_{i}, 32)")):
                bits.append(f"IF(2 * {votes} > _all, shiftleft(1L, {shift}), 0L)")
        return F.expr(" | ".join(bits))

    return sums.select(*keys, half(0).alias(out[0]), half(1).alias(out[1]))


def text_of(*halves: str) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(h), 16, "0")) for h in halves))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """The share of equal bits."""
    return 1 - reduce(Column.__add__, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True))) / F.lit(64.0 * len(a))


def next_ids(ids: DataFrame) -> DataFrame:
    """id and next_id, the next larger one, of each distinct id that isn't null; after the last comes the first.

    The ids are dealt out by range, so that each range is ordered by itself; the ranges' first ids (a row a range) close the gaps.
    """
    distinct = ids.where("id IS NOT NULL").distinct()
    ranged = written(distinct.repartitionByRange(partitions(ids.sparkSession), "id").withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("id").alias("head"))
    order = Window.orderBy("part")
    wrap = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), wrap).alias("head"))
    after = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return ranged.withColumn("after", after).join(heads, "part").select("id", F.coalesce("after", "head").alias("next_id"))


def edited_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, next_id, row (a number that tells equal rows apart), text, n_chars and edited: the text whose last floor(n_chars / 4) code points are replaced by the first as many (or all) of the next document's.

    A null text counts as empty. Of several rows with the next id, the smallest beginning counts. A row with a null id has
    no next document: the end of its text is cut off. Equal rows of an id are counted through, so that a task that runs again gives the same numbers in whatever order
    its rows come; rows with a null id are numbered where docs is read, which docs that come out of a shuffle should be written for first.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = rows.where("id IS NOT NULL")
    most = rows.groupBy("id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("k"))
    chain = next_ids(rows.select("id")).join(most, "id")
    begins = chain.withColumnRenamed("id", "of").join(named.withColumnRenamed("id", "next_id"), "next_id").select("of", "next_id", F.expr("substring(text, 1, k)").alias("begin"))
    begins = begins.groupBy(F.col("of").alias("id"), "next_id").agg(F.min("begin").alias("begin"))
    same = F.xxhash64("text")
    numbered = named.join(begins, "id", "left").withColumn("row", F.row_number().over(Window.partitionBy("id", same).orderBy(same)).cast("long"))
    both = numbered.unionByName(rows.where("id IS NULL").withColumns({"row": F.monotonically_increasing_id(), "next_id": F.lit(None).cast(rows.schema["id"].dataType), "begin": F.lit("")}))
    n = F.length("text")
    edited = F.expr("concat(substring(text, 1, length(text) - floor(length(text) / 4)), substring(begin, 1, cast(floor(length(text) / 4) AS int)))")
    return both.select("id", "next_id", "row", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))


def block_plan(radius: int) -> list[tuple[int, int, int]]:
    """(first bit, width, bits that may differ) of each block: any two fingerprints within the radius keep to one block's bound at least.

    Fingerprints that exceed every bound differ in the sum of all bounds and one more bit a block, which is made to be more than the radius. Blocks that may
    differ in more bits are wider, as more values are asked for.
    """
    if not 0 <= radius <= 32:
        raise ValueError("block tables serve radii from 0 to 32")
    m = max(4, -(-2 * (radius + 1) // 5))
    least, extra = divmod(max(radius + 1, m), m)
    width, rest = divmod(128 - 3 * extra, m)
    out, at = [], 0
    for i in range(m):
        w = width + 3 * (i < extra) + (i >= m - rest)
        out.append((at, w, least - 1 + (i < extra)))
        at += w
    return out


def _block(at: int, width: int, lo: str, hi: str) -> str:
    """SQL of a block of the bits of two halves."""
    if at >= 64:
        bits = f"shiftrightunsigned({hi}, {at - 64})"
    else:
        bits = f"shiftrightunsigned({lo}, {at})" + (f" | shiftleft({hi}, {64 - at})" if at + width > 64 else "")
    return f"(({bits}) & {(1 << width) - 1}L)"


def near_counts(prints: DataFrame, asks: Callable[[str], Column], radius: int = 3) -> DataFrame:
    """f0, f1 and n_near: how many other rows have a fingerprint within the radius, for each fingerprint of the rows that ask.

    prints: id, f0, f1, a table. Equal fingerprints are one entry with a count. A row of the tables is a block's value and place in one number.
    """
    plan = block_plan(radius)
    m = len(plan)
    keys = [f"{_block(at, w, 'f0', 'f1')} * {m} + {i}" for i, (at, w, _) in enumerate(plan)]
    entries = written(prints.groupBy("f0", "f1").agg(F.count("*").alias("n")))
    tables = entries.select("f0", "f1", "n", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    asking = written(prints.where(asks("id")).select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct())
    around = []
    for i, (at, w, most) in enumerate(plan):
        masks = ", ".join(f"{sum(1 << b for b in bits)}L" for k in range(most + 1) for bits in combinations(range(w), k))
        around.append(f"transform(array({masks}), x -> ({_block(at, w, 'q0', 'q1')} ^ x) * {m} + {i})")
    asking = asking.select("q0", "q1", F.explode(F.expr(f"concat({', '.join(around)})")).alias("key"))
    apart = F.expr("bit_count(f0 ^ q0) + bit_count(f1 ^ q1)")
    # A pair meets once in each block whose bound it keeps to: the first of them counts.
    first = F.coalesce(*(F.expr(f"IF(bit_count({_block(at, w, '(f0 ^ q0)', '(f1 ^ q1)')}) <= {most}, {i}, NULL)") for i, (at, w, most) in enumerate(plan)))
    # Those that ask are a small table before their values are listed: Spark would broadcast it.
    hits = asking.join(tables.hint("merge"), "key").where((apart <= radius) & (first == F.col("key") % m))
    return hits.groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1")).agg((F.sum("n") - 1).alias("n_near"))


def fingerprints(docs: DataFrame, asks: Callable[[str], Column], id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """A row for each row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    near_edited, near_next: the likeness of the fingerprint to that of the edited text (edited_texts()) and to the next document's; of
    several rows with the next id the smallest fingerprint counts, and without a next document near_next is null. n_near, for rows that asks()
    picks: other rows within the radius, else null. Repeated rows each stay; no rows give no rows.
    """
    # Rows of an id are told apart by their text's hash and their number among those that share it.
    whole = edited_texts(docs, id, text).withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "_h": F.xxhash64("text")})
    keys = ["id", "next_id", "n_chars", "edited_sha256", "_h", "row"]
    two = whole.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).alias("_")).select(*keys, "_.e", "_.t")
    made = simhashes(two, [*keys, "e"], "t", ["g0", "g1"])
    pick = [F.max(F.when(F.col("e") == e, F.col(g))).alias(name) for e, f in ((0, "f"), (1, "e")) for g, name in (("g0", f"{f}0"), ("g1", f"{f}1"))]
    prints = written(made.groupBy(*keys).agg(*pick))
    following = prints.groupBy(F.col("id").alias("next_id")).agg(F.min(F.struct("f0", "f1")).alias("_next"))
    near = near_counts(prints, asks, radius)
    rows = prints.join(following, "next_id", "left").join(near, ["f0", "f1"], "left")
    f = [F.col("f0"), F.col("f1")]
    return rows.select(
        F.col("id").alias(id), "n_chars", "edited_sha256", text_of("f0", "f1").alias("fingerprint"), text_of("e0", "e1").alias("edited_fingerprint"),
        likeness(f, [F.col("e0"), F.col("e1")]).alias("near_edited"), likeness(f, [F.col("_next.f0"), F.col("_next.f1")]).alias("near_next"), F.when(asks("id"), F.col("n_near")).alias("n_near"),
    )
