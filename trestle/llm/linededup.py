"""Line dedup over levelled sorted runs of line hashes.

The documents' lines come in batches. A run holds keys that no earlier run has, sorted and in as many buckets as every other run; keys
stand in the order and the bucket that their hash gives them. Each batch is merge-anti-joined with the runs: the keys that are new become a run of their
own, and the others leave a tally, which has their number of documents. Two runs of a level are merged into one
of the next level, and tallies likewise. Batches are dealt out as the runs are; the runs themselves are never shuffled again, neither for the
joins nor for the merging.

A line's key is the line without the bytes 0x20 and 0x09 to 0x0D at its ends, with A-Z in lower case.
Keys stand as 128-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, removed, shared_dir, slices, written

#: So many frequent keys (16 bytes and an id each) go to the executors as one broadcast; beyond, they are joined.
BROADCAST_KEYS = 200_000
#: There are as many buckets as leave each of them about so many of all batches' keys.
BUCKET = 4_000_000

STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    return [x.strip(STRIP).lower() for x in (text or "").encode().split(b"\n")]


def digests(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit integers of each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").astype(np.int64).reshape(-1, 2)


class LineRuns:
    """Runs and tallies (h1, h2, n, first) as bucketed tables in the shared folder; n: documents, first: their smallest id. close() removes them."""

    def __init__(self, spark: SparkSession, id_type: str = "bigint", buckets: int = 8):
        self.spark, self.buckets = spark, buckets
        self.dir, self.name, self.made = shared_dir(spark), f"line_runs_{uuid.uuid4().hex}", []
        self.schema = f"h1 long, h2 long, n long, first {id_type}"
        self.runs: list[DataFrame | None] = []  # by level: none, or one that is made of 2 ** level batches
        self.tallies: list[DataFrame | None] = []
        self.none = self._table(spark.createDataFrame([], self.schema))

    def _table(self, rows: DataFrame) -> DataFrame:
        """rows, which lie in their buckets' tasks already, as a table."""
        name = f"{self.name}_{len(self.made)}"
        self.made.append(name)
        rows.select("h1", "h2", "n", "first").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.dir}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of lines whose key is in no run: one merge anti-join a run."""
        runs = [r for r in self.runs if r is not None] or [self.none]
        return reduce(lambda left, run: left.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), runs, lines)

    def add(self, lines: DataFrame) -> None:
        """A batch: one row (h1, h2, n, first) a key. Its new keys become a run; the others, which are not in that run, a tally."""
        new = self._table(self.unseen(lines))
        if any(r is not None for r in self.runs):
            self._put(self.tallies, self._table(lines.join(new.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")))
        self._put(self.runs, new)

    def _put(self, levels: list[DataFrame | None], table: DataFrame) -> None:
        for k in range(len(levels)):
            if levels[k] is None:
                levels[k] = table
                return
            table, levels[k] = self._table(_merged(levels[k], table)), None
        levels.append(table)

    def seen(self) -> DataFrame:
        """All keys of all runs with their totals."""
        tables = [t for t in (*self.tallies, *self.runs) if t is not None]
        while len(tables) > 2:
            tables = [self._table(_merged(*tables[:2])), *tables[2:]]
        return _merged(*tables) if len(tables) == 2 else (tables or [self.none])[0]

    def close(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, self.dir)


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The keys of both tables with their totals: bucket by bucket, in the order that both have."""
    both = a.join(b.withColumnsRenamed({"n": "m", "first": "second"}).hint("merge"), ["h1", "h2"], "full_outer")
    return both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.least("first", "second").alias("first"))


def document_lines(docs: DataFrame, id: str, text: str, batches: int) -> DataFrame:
    """batch, h1, h2, n, first: the distinct non-empty keys of each document, summed up over slices of a task."""
    rows = bounded(docs).select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.pmod(F.xxhash64(id), F.lit(batches)).cast("int").alias("batch"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, "_text"):
            found: dict[tuple[int, bytes], list] = {}
            for i, t, g in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), b.column("batch").to_pylist(), strict=True):
                for k in set(line_keys(t)):
                    if k and (x := found.get((g, k))):
                        x[0] += 1
                        x[1] = min((v for v in (x[1], i) if v is not None), default=None)
                    elif k:
                        found[g, k] = [1, i]
            h = digests([k for _, k in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], b.schema.field("_id").type)],
                ["batch", "h1", "h2", "n", "first"],
            )

    return rows.mapInArrow(hashed, f"batch int, h1 long, h2 long, n long, first {id_type}")


def frequent_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = 10, batches: int = 8) -> DataFrame:
    """h1, h2, first of the keys that at least min_docs rows of docs hold, as a table.

    All rows are hashed in one pass; the batches of that table are then added to the runs one by one.
    """
    spark = docs.sparkSession
    lines = document_lines(docs, id, text, batches)
    summed = lines.groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    path = shared_dir(spark)
    summed.write.partitionBy("batch").parquet(path)
    kind = lines.schema["first"].dataType.simpleString()
    stored = spark.read.schema(f"h1 long, h2 long, n long, first {kind}, batch int").parquet(path)
    runs = LineRuns(spark, kind, max(8, math.ceil(stored.count() / BUCKET)))
    for g in range(batches):
        runs.add(stored.where(F.col("batch") == g).drop("batch"))
    found = written(runs.seen().where(F.col("n") >= min_docs).select("h1", "h2", "first"))
    runs.close()
    removed(spark, path)
    return found


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] | None = None, min_docs: int = 10, keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS, batches: int = 8) -> DataFrame:
    """Drops from every document the lines whose key at least min_docs documents hold.

    Returns row (a struct of the columns named in carry: all but the text by default), n_lines (before
    dropping), n_dropped and kept (the other lines, joined by line feeds). keep_first: such a line stays
    in the document with the smallest id of those that hold it.

    A null or empty text is one empty line; empty keys are never dropped. Documents are rows: repeated
    rows each count, rows with a null id too (they are never the first). No rows give no rows.
    """
    spark = docs.sparkSession
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    frequent = frequent_lines(docs, id, text, min_docs, batches)
    rows = bounded(docs).select(F.struct(*(F.col(c) for c in carry)).alias("row"), F.col(id).alias("_id"), F.col(text).alias("_text"))
    out = f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"

    def cut(b: pa.RecordBatch, stops) -> pa.RecordBatch:
        """stops(row's number): the map from the digests of frequent keys to the id that keeps them."""
        counts, dropped, kept = [], [], []
        for j, (i, t) in enumerate(zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True)):
            of = stops(j)
            lines = (t or "").split("\n")
            if of:
                stay = [x for x, k in zip(lines, line_keys(t), strict=True) if not k or (d := xxhash.xxh3_128_digest(k)) not in of or (keep_first and of[d] is not None and of[d] == i)]
            else:
                stay = lines
            counts.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        return pa.RecordBatch.from_arrays([b.column("row"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_dropped", "kept"])

    def as_map(triples) -> dict:
        return {np.array([a, b], ">i8").tobytes(): f for a, b, f in triples}

    if frequent.count() <= broadcast_keys:
        known = spark.sparkContext.broadcast(as_map(frequent.collect()))

        def with_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = known.value
            for b in slices(parts, "_text"):
                yield cut(b, lambda _: of)

        return rows.mapInArrow(with_all, out)

    # Rows of one null id, or of one repeated id, are told apart by their texts.
    lines = rows.select("_id", F.xxhash64("_text").alias("_t"), "_text").mapInArrow(_row_lines, f"_id {rows.schema['_id'].dataType.simpleString()}, _t long, h1 long, h2 long")
    hits = lines.join(frequent, ["h1", "h2"]).groupBy("_id", "_t").agg(F.collect_set(F.struct("h1", "h2", "first")).alias("_stops"))
    keyed = rows.withColumn("_t", F.xxhash64("_text")).alias("d")
    joined = keyed.join(hits.alias("h"), F.col("d._id").eqNullSafe(F.col("h._id")) & (F.col("d._t") == F.col("h._t")), "left").select("d.row", "d._id", "d._text", "h._stops")

    def with_own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, "_text"):
            own = [as_map((x["h1"], x["h2"], x["first"]) for x in v or ()) for v in b.column("_stops").to_pylist()]
            yield cut(b, own.__getitem__)

    return joined.mapInArrow(with_own, out)


def _row_lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(parts, "_text"):
        keys = [list({k for k in line_keys(t) if k}) for t in b.column("_text").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
        h = digests([k for ks in keys for k in ks])
        yield pa.RecordBatch.from_arrays([b.column("_id").take(at), b.column("_t").take(at), pa.array(h[:, 0]), pa.array(h[:, 1])], ["_id", "_t", "h1", "h2"])
