"""Best-fit packing by exact-complement hashing.

Only the histogram of piece lengths decides which lengths go together, and it has at most `capacity` entries
whatever the corpus. The plan is made on it. For every length, the gap it leaves is looked up in an index of the single lengths, the sums of
two and the sums of three that are still available, and the combination is taken as often as its scarcest length allows.
A combination of two or three uses up short pieces, which are what other gaps need; so where one single piece
fills the gap but for a few tokens (a near complement), it goes first, and its sequence stays open. What then is left is packed best-fit
decreasing, into open sequences and new ones. The plan gives each length's ranks to places in sequences, and the pieces, ranked within their length, read
theirs off it.
"""

from __future__ import annotations

import base64
import functools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, slices, written
from .tokens import PATTERN

#: A single piece that leaves at most the capacity divided by this goes before exact pairs and triples.
NEAR = 64


class Sums:
    """The available lengths' sums of two and three, by sum. left: how many pieces of each length there are; it only ever falls, so what is dead is dropped."""

    def __init__(self, left: np.ndarray):
        self.left, self.lengths = left, np.flatnonzero(left).tolist()
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a in reversed(self.lengths):  # of a sum the most even pair stands last, where it is looked up first
            for b in self.lengths:
                if b > a or a + b >= len(left):
                    break
                self.pairs[a + b].append((a, b))
        self.thirds: dict[int, list[int]] = {}

    def _there(self, whole: tuple[int, ...]) -> bool:
        return all(self.left[x] >= whole.count(x) for x in whole)

    def pair(self, long: int, gap: int) -> tuple[int, ...] | None:
        """The most even pair that fills the gap beside a piece of length long."""
        found = self.pairs.get(gap, [])
        while found and not self._there(found[-1]):
            found.pop()
        return next((p for p in reversed(found) if p[0] <= long and self._there((long, *p))), None)

    def triple(self, long: int, gap: int) -> tuple[int, ...] | None:
        """Three lengths that fill the gap beside a piece of length long; the smallest is as large as can be."""
        thirds = self.thirds.setdefault(gap, [c for c in self.lengths if 3 * c <= gap])
        for i in range(len(thirds) - 1, -1, -1):
            c = thirds[i]
            found = self.pairs.get(gap - c, [])
            while found and not self._there(found[-1]):
                found.pop()
            if not self.left[c] or not found or found[-1][1] < c:
                del thirds[i]
                continue
            for p in reversed(found):
                if p[1] < c:
                    break
                if p[0] <= long and self._there((long, *p, c)):
                    return (*p, c)
        return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences have each. counts: of the lengths 0 to capacity."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    full: list[tuple[tuple[int, ...], int]] = []
    open_: list[tuple[tuple[int, ...], int]] = []

    def take(whole: tuple[int, ...], to: list) -> None:
        times = min(int(left[x]) // whole.count(x) for x in whole)
        if times:
            to.append((whole, times))
            for x in whole:
                left[x] -= times

    take((capacity,), full)
    for long in range(capacity - 1, capacity // 2 - 1, -1):
        take((long, capacity - long), full)
    sums, near = Sums(left), capacity // NEAR
    for long in range(capacity - 1, 0, -1):
        gap = capacity - long
        while left[long]:
            left[long] -= 1
            there = np.flatnonzero(left[: min(gap, long) + 1])
            left[long] += 1
            if not len(there):
                break
            single = int(there[-1])
            if gap - single <= near:
                take((long, single), open_)
            elif found := sums.pair(long, gap) or sums.triple(long, gap):
                take((long, *found), full)
            else:
                break
    return full + best_fit(left, capacity, open_)


def best_fit(left: np.ndarray, capacity: int, open_: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of what is left, all pieces of a length at once, into open sequences and new ones."""
    by: dict[int, list[list]] = {}  # by gap: [pattern, how many]
    for pattern, times in open_:
        by.setdefault(capacity - sum(pattern), []).append([pattern, times])
    for long in range(capacity - 1, 0, -1):
        n = int(left[long])
        while n:
            gap = min((g for g in by if g >= long and by[g]), default=0)
            pattern, times = by[gap].pop() if gap else [(), n]
            gap = gap or capacity
            each = gap // long
            full, rest = min(times, n // each), n % each
            if full:
                by.setdefault(gap - each * long, []).append([pattern + (long,) * each, full])
                n -= full * each
            if n and full < times:  # fewer than one sequence can take
                by.setdefault(gap - rest * long, []).append([pattern + (long,) * rest, 1])
                n, full = n - rest, full + 1
            if pattern and full < times:
                by.setdefault(gap, []).append([pattern, times - full])
    return [(p, t) for groups in by.values() for p, t in groups]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For ranges of ranks within a length: the first sequence and the offset; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def packed(pieces: DataFrame, order: list[str], capacity: int = 1024, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset: sequences hold at most capacity tokens, without gaps.

    pieces must be stable (a table). length: 1 to capacity. order: columns that tell the pieces apart; pieces that are
    equal in all of them are interchangeable. Ranks within a length are counted in chunks of about the
    square root of all pieces, so that neither a frequent length nor a chunk gathers in a task.
    """
    spark = pieces.sparkSession
    found = pieces.groupBy(length).count().collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in found:
        counts[x] = n
    told = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    chunks = max(1, math.isqrt(int(counts.sum())))
    chunked = pieces.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = Window.partitionBy(length).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunked.groupBy(length, "_chunk").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(length, "_chunk").orderBy(*order)) - 1
    ranked = chunked.withColumn("_own", own).join(bases, [length, "_chunk"]).withColumn("_rank", (F.col("_base") + F.col("_own")).cast("long"))
    rows = ranked.select(F.struct(*(F.col(c) for c in pieces.columns)).alias("row"), F.col(length).cast("long").alias("_length"), "_rank")

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = told.value
        at = p["length"] << 44 | p["rank"]
        for b in parts:
            x, r = (b.column(c).to_numpy() for c in ("_length", "_rank"))
            k = np.searchsorted(at, x << 44 | r, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p["sequence"][k] + r - p["rank"][k]), pa.array(p["offset"][k])], ["row", "sequence_id", "offset"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(placed, f"row {kind}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")


class Ids:
    """The ids of whole texts, as little-endian 32-bit integers: a byte-level BPE from a .tiktoken file; its ids are those of the .json file of the same vocabulary.

    The splitting pattern backtracks over white space, and its engine gives up on a very long run. Such runs are cut out first: a run is a
    pre-token, but for its last character if something that is no special string follows.
    """

    RUN = regex.compile(r"\p{White_Space}{5000,}")

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end, self.special = len(ranks), "<|endoftext|>"
        self.encoding, self.whole = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={self.special: self.end}) for p in (PATTERN, r"(?s:.+)"))

    def of(self, text: str | None) -> bytes:
        text = text or ""
        if not self.RUN.search(text):
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        whole = []
        for k, part in enumerate(text.split(self.special)):
            at = 0
            whole += [self.end] * (k > 0)
            for run in self.RUN.finditer(part):
                last = run.end() - (run.end() < len(part))
                whole += self.encoding.encode(part[at : run.start()])
                whole += self.whole.encode(part[run.start() : last])
                at = last
            whole += self.encoding.encode(part[at:])
        return np.array(whole, "<u4").tobytes()


@functools.lru_cache(2)
def ids(path: str) -> Ids:
    return Ids(path)


def token_pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int = 2, capacity: int = 1024) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32. path: of a .tiktoken file.

    A document is its tokens and then the id `end`; a null text has no tokens. Documents of more than capacity
    ids are cut from the back into pieces of capacity, so that only the first may be shorter.
    Rows are independent: repeated rows and null ids stay.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], "<u4").tobytes()
        for b in slices(batches, "_text"):
            rows = []
            for j, text in enumerate(b.column("_text").to_pylist()):
                made = ids(path).of(text) + last
                n = len(made) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (s, f) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((j, k, s, f - s, zlib.crc32(made[4 * s : 4 * f])))
            j, *rest = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(j)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], ["_id", "piece", "start", "length", "ids_crc32"])

    rows = bounded(docs).select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", id)


def packed_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int = 2, capacity: int = 1024) -> DataFrame:
    """token_pieces() with sequence_id and offset. No documents give no rows."""
    pieces = written(token_pieces(docs, path, id, text, end, capacity))
    return packed(pieces, [id, "piece", "start", "ids_crc32"], capacity)
