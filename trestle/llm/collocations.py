"""Phrase collocations by relational mining of occurrences (SETM).

The occurrence relation of single words, (piece, position, item) in the order of the texts, is a written table; a row of it is a sorted
block of whole pieces, packed: a dictionary of the block's items, a code for each word, and a bit for each word that begins a piece. The
relation of phrases of k words holds the places where they begin, a bit for each word. It is made from that of k - 1 words in three
steps: a semi-join with the frequent groups of k - 1 words, a merge join with the single words on the piece and the adjacent position
(both sides lie sorted in the same block, so nothing is shuffled), and writing it. Then its groups are counted,
in each block first, and summed up by Spark; those that are frequent enough go on.

The frequent groups reach the tasks as a bitmap of BITS bits of their hashes, so that what is broadcast doesn't grow. What a bitmap lets through wrongly
isn't frequent when it is counted: no group of k words is more frequent than its parts. So results are exact whatever the bitmap's load.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, dropped, given_back, lower_ascii, mixed, slices, span_hashes, utf8, written

#: Bits of a bitmap of frequent groups.
BITS = 1 << 26
#: Bytes of text that a block is made of at most, if no word is longer.
BLOCK = 1 << 20
#: Parts in which a language's phrases are ranked before its last ranking.
DEALS = 64
#: What ends a piece, and what ends a word within a piece.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_ENDS)], _KIND[list(PIECE_ENDS)] = 1, 2

OCCURRENCES = "items array<bigint>, langs array<string>, words array<string>, counts array<bigint>, codes binary, firsts binary, tail int"
RELATION = "items array<bigint>, codes binary, firsts binary, tail int, held binary"


def windows(data: np.ndarray, ahead: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(a, b, c) of a long text: its bytes from a to b are a block's own, those from b to c hold the next words up to `ahead`, if a piece is cut at b."""
    kind, a = _KIND[data], 0
    while a < len(data):
        b = c = min(a + most, len(data))
        if b < len(data):
            ends = np.flatnonzero(kind[a:b] == 2)
            if len(ends):
                b = c = a + int(ends[-1]) + 1
            else:  # a piece longer than a block: it is cut between words
                while b < len(data) and not kind[b]:
                    b += 1
                c, seen = b, 0
                while c < len(data) and kind[c] != 2 and seen < ahead:
                    while c < len(data) and kind[c] == 1:
                        c += 1
                    seen += c < len(data) and kind[c] == 0
                    while c < len(data) and kind[c] == 0:
                        c += 1
        yield a, b, c
        a = b


def block(data: np.ndarray, at: np.ndarray, own: int, langs: list[str], salt: int) -> list | None:
    """A row of the occurrence relation from lower-cased bytes, of which the words from `own` on belong to the next block."""
    kind = _KIND[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = kind == 0
    edge = np.zeros(len(data) + 1, bool)  # where a text begins, a word can't go on
    edge[at] = True
    first = solid[1:-1] & (~solid[:-2] | edge[:-1])
    last = solid[1:-1] & (~solid[2:] | edge[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return None
    row = np.searchsorted(at, starts, "right") - 1
    piece = np.cumsum(kind == 2)[starts] + row
    firsts = np.ones(len(starts), bool)
    firsts[1:] = piece[1:] != piece[:-1]
    of_lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
    h = mixed(span_hashes(data ^ np.uint8(salt), starts, ends) + of_lang[row])
    items, where, codes = np.unique(h, return_index=True, return_inverse=True)
    tail = int(np.count_nonzero(starts >= own))
    counts = np.bincount(codes[: len(codes) - tail], minlength=len(items))
    words = [data[s:e].tobytes().decode() for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    return [items.view(np.int64), [langs[r] for r in row[where].tolist()], words, counts, codes.astype(np.int32).tobytes(), np.packbits(firsts).tobytes(), tail]


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"items": pa.list_(pa.int64()), "langs": pa.list_(pa.string()), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "tail": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.binary())) for i, n in enumerate(names)], names=names)


def occurrences(docs: DataFrame, text: str, lang: str, longest: int, salt: int = 0) -> DataFrame:
    """The occurrence relation of single words. Words of different languages are different items."""
    names = ["items", "langs", "words", "counts", "codes", "firsts", "tail"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", BLOCK):
            data, at = utf8(b.column("_text"))
            langs, data = b.column("_lang").to_pylist(), lower_ascii(data)
            if b.num_rows > 1:
                found = [block(data, at[:-1], len(data), langs, salt)]
            else:
                found = (block(data[a:c], np.zeros(1, np.int64), own - a, langs, salt) for a, own, c in windows(data, longest - 1, BLOCK))
            for row in found:
                if row:
                    yield _batch([row], names)

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang")).where("_text <> ''")
    return bounded(rows).mapInArrow(made, OCCURRENCES)


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of items."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mixed(key ^ c.view(np.uint64))
    return key


def bitmap(groups: DataFrame, k: int) -> np.ndarray:
    """BITS bits, of which those of the groups' hashes are set; the driver gets BITS / 64 numbers at most."""
    names = [f"i{j}" for j in range(k)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 64, np.uint64)
        for b in batches:
            at = keys_of([b.column(n).to_numpy(zero_copy_only=False) for n in names]) % np.uint64(BITS)
            np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        word = np.flatnonzero(bits)
        for i in range(0, len(word), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(word[i : i + (1 << 16)]), pa.array(bits[word[i : i + (1 << 16)]].view(np.int64))], names=["word", "bits"])

    found = groups.select(*names).mapInArrow(made, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def held_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % np.uint64(BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def merge_join(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places of equal numbers in two ascending arrays without repetitions."""
    if not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    j = np.searchsorted(right, left)
    i = np.flatnonzero(right[np.minimum(j, len(right) - 1)] == left)
    return i, j[i]


def _relation(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray | None]:
    """items, codes, place (piece and position in one number), tail and held of a block."""
    items = b.column("items")[i].values.to_numpy(zero_copy_only=False)
    codes = np.frombuffer(b.column("codes")[i].as_py(), np.int32)
    firsts = np.unpackbits(np.frombuffer(b.column("firsts")[i].as_py(), np.uint8), count=len(codes)).astype(bool)
    begins = np.flatnonzero(firsts)
    piece = np.cumsum(firsts) - 1
    place = (piece << 32) + np.arange(len(codes)) - (begins[piece] if len(begins) else 0)
    held = np.unpackbits(np.frombuffer(b.column("held")[i].as_py(), np.uint8), count=len(codes)).astype(bool) if "held" in b.schema.names else None
    return items, codes, place, b.column("tail")[i].as_py(), held


def _groups(codes: np.ndarray, at: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place, the count and, for each place, the number of each group of k codes."""
    g = codes[at].astype(np.int64)
    for t in range(1, k):
        _, g = np.unique(g * n + codes[at + t], return_inverse=True)
    _, one, g, count = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
    return at[one], count, g


def extended(relation: DataFrame, frequent: np.ndarray, k: int) -> DataFrame:
    """The occurrence relation of k words from that of k - 1 words and the bitmap of its frequent groups."""
    known, names = relation.sparkSession.sparkContext.broadcast(frequent), ["items", "codes", "firsts", "tail", "held"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for b in batches:
            for i in range(b.num_rows):
                items, codes, place, tail, held = _relation(b, i)
                at = np.arange(len(codes) - tail) if held is None else np.flatnonzero(held)
                # The semi-join with the frequent groups, once for each group of the block.
                one, _, g = _groups(codes, at, k - 1, len(items))
                at = at[held_in(bits, keys_of([items[codes[one + t]] for t in range(k - 1)]))[g]]
                # What begins in the tail isn't known here; a group's last k - 1 words are frequent, too.
                ends = np.zeros(len(codes) + 1, bool)
                ends[at], ends[len(codes) - tail :] = True, True
                left, _ = merge_join(place[at] + (k - 1), place)
                at = at[left]
                at = at[ends[at + 1]]
                flags = np.zeros(len(codes), bool)
                flags[at] = True
                yield _batch([[items, b.column("codes")[i].as_py(), b.column("firsts")[i].as_py(), tail, np.packbits(flags).tobytes()]], names)
        given_back()

    columns = [c for c in ("items", "codes", "firsts", "tail", "held") if c in relation.columns]
    return bounded(relation.select(*columns)).mapInArrow(made, RELATION)


def counted(relation: DataFrame, k: int, least: int) -> DataFrame:
    """i0, i1, ... and n of the groups of k words that occur so often at least."""
    names = [f"i{j}" for j in range(k)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                items, codes, _, _, held = _relation(b, i)
                one, n, _ = _groups(codes, np.flatnonzero(held), k, len(items))
                yield pa.RecordBatch.from_arrays([*(pa.array(items[codes[one + t]]) for t in range(k)), pa.array(n.astype(np.int64))], names=[*names, "n"])
        given_back()

    found = bounded(relation).mapInArrow(made, ", ".join(f"{n} bigint" for n in [*names, "n"]))
    return found.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def words_of(relation: DataFrame) -> DataFrame:
    """i0, lang, word and n of all words."""
    one = relation.select(F.explode(F.arrays_zip("items", "langs", "words", "counts")).alias("_"))
    return one.select(F.col("_.items").alias("i0"), F.col("_.langs").alias("lang"), F.col("_.words").alias("word"), F.col("_.counts").alias("n")).groupBy("i0", "lang", "word").agg(F.sum("n").alias("n"))


def mined(docs: DataFrame, text: str, lang: str, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """The words of all texts with their counts, and the frequent groups of 1, 2, ... words, as written tables."""
    for salt in range(256):
        relation = written(occurrences(docs, text, lang, longest, salt))
        words = written(words_of(relation))
        if words.groupBy("i0").count().where("count > 1").isEmpty():  # else two words share a hash
            break
        dropped(docs.sparkSession, relation, words)
    else:
        raise ValueError("no hash tells all words apart")
    levels = [words.where(F.col("n") >= least).select("i0", "n")]
    for k in range(2, longest + 1):
        longer = written(extended(relation, bitmap(levels[-1], k - 1), k))
        dropped(docs.sparkSession, relation)
        relation = longer
        levels.append(written(counted(relation, k, least)))
    dropped(docs.sparkSession, relation)
    return words, levels


def _score(a: str, l: str, r: str) -> Column:
    return F.expr(f"(1000000BD * CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0))) div (CAST({l} AS DECIMAL(15,0)) * CAST({r} AS DECIMAL(15,0)))")


def _looked_up(rows: DataFrame, table: DataFrame, on: list[str], columns: dict[str, str]) -> DataFrame:
    """rows with columns of the table whose i0, i1, ... are the rows' columns `on`."""
    side = table.select(*(F.col(f"i{j}").alias(f"_k{j}") for j in range(len(on))), *(F.col(c).alias(name) for c, name in columns.items()))
    match = [F.col(c) == F.col(f"_k{j}") for j, c in enumerate(on)]
    return rows.join(side, match).drop(*(f"_k{j}" for j in range(len(on))))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """Each language's best phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n and score.

    Words are lower-cased (A-Z) runs without space, tab or what ends a piece; phrases don't pass a piece's end. a: how often a phrase occurs, `least`
    times at least, overlaps included; n: all words of the language; score: floor(1000000 a a / (l r)) of the cut into a first part (l times) and a rest (r times)
    that scores lowest, of equal ones the one after fewer words. Phrases that lie within a longer candidate with `inside` percent of their occurrences or more are
    dropped. Ties of score go to the larger a, then to the smaller phrase. Null languages are `und`; null and empty texts have no words; repeated rows each count; other
    columns are ignored. No rows, or nothing frequent enough, give no rows.
    """
    words, levels = mined(docs, text, lang, longest, least)
    frequent = written(words.where(F.col("n") >= least))
    found = []
    for k in range(2, longest + 1):
        names = [f"i{j}" for j in range(k)]
        rows = levels[k - 1].withColumnRenamed("n", "a")
        longer = [levels[m - 1].select(*(F.col(f"i{s + j}").alias(f"i{j}") for j in range(k)), "n") for m in range(k + 1, longest + 1) for s in range(m - k + 1)]
        if longer:
            most = longer[0]
            for x in longer[1:]:
                most = most.unionByName(x)
            most = most.groupBy(*names).agg(F.max("n").alias("_most"))
            rows = rows.join(most, names, "left").where(F.col("_most").isNull() | (100 * F.col("_most") < inside * F.col("a"))).drop("_most")
        for cut in range(1, k):
            rows = _looked_up(rows, levels[cut - 1], names[:cut], {"n": f"_l{cut}"})
            rows = _looked_up(rows, levels[k - cut - 1], names[cut:], {"n": f"_r{cut}"})
        cuts = [F.struct(_score("a", f"_l{c}", f"_r{c}").alias("score"), F.lit(c).alias("cut"), F.col(f"_l{c}").alias("l"), F.col(f"_r{c}").alias("r")) for c in range(1, k)]
        rows = rows.select(*names, "a", (F.array_min(F.array(*cuts)) if k > 2 else cuts[0]).alias("_"))
        for j in range(k):
            rows = _looked_up(rows, frequent, [f"i{j}"], {"word": f"_w{j}"} | ({"lang": "lang"} if j == 0 else {}))
        found.append(rows.select("lang", F.concat_ws(" ", *(f"_w{j}" for j in range(k))).alias("phrase"), "a", "_.l", "_.r", "_.score"))
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    # A language's phrases are ranked in DEALS parts first, so that the last ranking has that many times `top` rows at most.
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    parts = rows.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy(*order))).where(F.col("rank") <= top)
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))  # a row a language
    return best.join(total, F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
