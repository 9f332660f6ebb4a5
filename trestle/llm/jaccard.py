"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

A document is the set of its word n-grams (64-bit hashes). Equal sets are one node. Nodes are compared in
tiles: each holds nodes of one candidate group and one band of sizes, and two tiles meet only if their sizes let
a pair reach the threshold. In a tile, hashed bitmaps bound the overlap of each pair from above by bit counts;
pairs that the bound lets through and that are not yet connected are settled by intersecting the sorted arrays.

Candidate groups lose no pair. Two sets over the threshold differ in at most H elements, H following from the
largest size in their band. Each set is cut by hash into H + 1 + S parts, S of them spare, so that at least S + 1
parts are equal. Empty parts say nothing and give no key. Only where two
sets have nothing but empty parts in common are at least S + 1 parts of both empty: sets that have so
many empty parts also get a key for each combination of S + 1 of them.

Linked sets share not one key but several, so many at least as a set's size tells. Of its keys, the rarest first, a set may then leave out the most
frequent ones, one less than it must share: what it is linked with has one of the others, too. So a passage that very many documents hold ties
only those together that hold little else; the texts of the groups that the other keys make are fetched.

Groups are never compared pair by pair. Each tile has the smallest node of its group as a guest; what the tiles leave apart from
it, and only that, then meets what has one of its keys: groups chain, so that most of a large one has none of them.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import bounded, dropped, lower_ascii, mixed, partitions, slices, span_hashes, utf8, word_spans, written

#: Sizes of one band reach from one of these to below the next.
BANDS = np.unique(np.floor(1.4 ** np.arange(0, 120)).astype(np.int64))
#: A tile holds so many n-grams, and at least so many in a small corpus, or one document.
TILE, LEAST_TILE = 400_000, 20_000
#: And so many documents at least.
LEAST_ROOM = 50
#: The most documents of a tile of those that share a key.
ROOM = 2_000
#: Bytes of texts whose sets are made at once: arrays over them take some fifty times as much.
SLICE = 1 << 18
#: The most bits of the bitmap of wanted ids.
FILTER = 1 << 26


def gram_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of its n-grams; with fewer words, of the whole sequence; without words, nothing."""
    data, at = utf8(texts)
    data = lower_ascii(data)
    starts, ends, row = word_spans(data, at)
    n = len(at) - 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    h = span_hashes(data, starts, ends)
    first = np.searchsorted(row, np.arange(n + 1))  # each text's first word
    gram = np.full(len(h), np.uint64(words))
    for k in range(words):  # an order-dependent mix of up to so many words, never beyond the text
        there = np.arange(len(h)) + k < first[row + 1]
        gram[there] = mixed(gram[there] * np.uint64(0x9E3779B97F4A7C15) + h[np.flatnonzero(there) + k] + np.uint64(k + 1))
    return [np.unique(gram[a : max(a + 1, b - words + 1)]) if a < b else gram[:0] for a, b in itertools.pairwise(first.tolist())]


def set_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    x = mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    with np.errstate(over="ignore"):
        return int(mixed(np.array([x.sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


@functools.lru_cache(None)
def band_parts(b: int, percent: int) -> tuple[int, int, int]:
    """Of a band of sizes: the number of parts, how many of them are spare, and the largest size that is linked with one of its sizes.

    Enough are spare that the smallest sets of the band are expected to have less than one combination of so many empty parts.
    """
    least, largest = int(BANDS[b]), int(BANDS[b + 1]) - 1
    most = largest * 100 // percent
    differ = (largest + most) * (100 - percent) // (100 + percent)
    spare = 0
    while differ:
        spare += 1
        parts = differ + 1 + spare
        ways = math.lgamma(parts + 1) - math.lgamma(spare + 2) - math.lgamma(parts - spare)
        if spare > 1 and ways + least * math.log(1 - (spare + 1) / parts) <= 0:
            break
    return differ + 1 + spare, spare, most


def band_of(n: int) -> int:
    return int(np.searchsorted(BANDS, n, "right")) - 1


def part_keys(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray, int]]:
    """A set's keys by band: the band, the keys, and how many of them it shares at least with each set that it is linked with under this band.

    Two sets of a Jaccard similarity of at least percent / 100 share so many keys under the band of the smaller one, unless they are equal.
    """
    n = len(s)
    band = band_of(n)
    found = []
    # A pair meets under the band of the smaller set; sets that can be the larger one of such a pair use that band, too.
    for b in range(band, -1, -1):
        parts, spare, most = band_parts(b, percent)
        if n > most:
            break
        part = (mixed(s + np.uint64(b)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, mixed(s))
        full = np.bincount(part, minlength=parts) > 0
        where = np.uint64(b) * np.uint64(1 << 32) + np.arange(parts, dtype=np.uint64)
        keys = mixed(sums[full] + mixed(where[full]))
        empty = np.flatnonzero(~full)
        # Both sets' sizes at most: as the larger one under a lower band, or as the smaller one under its own.
        both = int(BANDS[b + 1]) - 1 + n if b < band else n + n * 100 // percent
        need = parts - len(empty) - both * (100 - percent) // (100 + percent)
        if parts > 1 and len(empty) > spare:
            some = np.array(list(itertools.combinations(empty.tolist(), spare + 1)), np.uint64)
            code = np.full(len(some), np.uint64(b) * np.uint64(1 << 32) + np.uint64(1 << 31))
            for column in some.T:
                code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
            keys = np.concatenate([keys, code])
        found.append((b, keys.view(np.int64), max(1, need)))
    return found


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set; at least 8 bits for each element of the largest."""
    bits = max(64, 1 << (8 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        np.bitwise_or.at(row, (s % np.uint64(bits) >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
    return out


def tile_links(left: list[np.ndarray], right: list[np.ndarray], known: list, percent: int) -> list[tuple[int, int]]:
    """Links, by place, that connect all that the pairs within left (right empty), or between left and right, connect.

    known: what each of left and right is already connected with has the same value.
    """
    sets = left + right
    size = np.array([len(s) for s in sets])
    bits = bitmaps(sets)
    root = np.unique(np.array(known), return_inverse=True)[1]
    links = []
    for i in range(len(left)):
        j = np.arange(len(left) if right else i + 1, len(sets))
        least = -(-percent * (size[i] + size[j]) // (100 + percent))  # the overlap that a link needs
        j, least = (x[(np.minimum(size[i], size[j]) >= least) & (root[j] != root[i])] for x in (j, least))
        if not len(j):
            continue
        over = np.minimum(size[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1), size[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1))
        for k, need in zip(j[over >= least].tolist(), least[over >= least].tolist(), strict=True):
            if root[k] != root[i] and len(np.intersect1d(sets[i], sets[k], assume_unique=True)) >= need:
                links.append((i, k))
                root[root == root[k]] = root[i]
    return links


def few(rows: DataFrame, n: int) -> DataFrame:
    """rows in no more partitions than n of them need, however many partitions there are for the large tables."""
    return rows.coalesce(max(8, n // 100_000))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of an edge (a, b) is connected with; a table.

    Large stars and small stars in turn: every node is tied to the smallest node around, until nothing changes; rounds grow as the
    logarithm of the longest path. Minima are summed up before they are dealt out, and joined back, so that a hot node's rows can be split.
    """
    spark, seen = edges.sparkSession, Observation()
    # Rounds have at most as many rows as there are edges: they need no more files.
    now, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().observe(seen, F.count("*").alias("n")), clean=True), None
    most = seen.get["n"]
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        # Large star: a node's larger neighbours are tied to the smallest of its neighbours and itself.
        large = written(few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), most), clean=True)
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        low = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = low.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("_")).select("_.*")
        seen = Observation()
        then = written(few(small.where("a <> b").distinct(), most).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), clean=True)
        dropped(spark, now, large)
        now, state = then, seen.get
        if state == before:
            break
        before = state
    found = written(few(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), most), clean=True)
    dropped(spark, now)
    return found


def dealt(tiles: DataFrame) -> DataFrame:
    """tiles with deal: groups of about a hundred members, so that small tiles share one."""
    deals = max(partitions(tiles.sparkSession), tiles.count() // 100)
    return tiles.withColumn("deal", F.pmod(F.xxhash64("tile"), F.lit(deals)))


def compared(tiles: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b: nodes) that the tiles' pairs give. tiles: tile, side (whether right), node, known, a table; texts: node, _text."""
    rows = dealt(tiles).join(texts, "node").select("deal", "tile", "side", "node", "known", "_text")

    def joined(table: pa.Table) -> pa.Table:
        columns = zip(*(table.column(c).to_pylist() for c in ("tile", "side", "node", "known")), strict=True)
        sets = (s for c in table.column("_text").chunks for b in slices(iter([pa.RecordBatch.from_arrays([c], ["t"])]), "t") for s in gram_sets(b.column("t"), words))
        by: dict[int, tuple[dict, dict]] = {}
        for (t, side, node, known), s in zip(columns, sets, strict=True):
            by.setdefault(t, ({}, {}))[side][node] = (s, known, node)
        found = []
        for sides in by.values():
            one, two = (sorted(x.values(), key=lambda y: len(y[0])) for x in sides)
            both = one + two
            for i, k in tile_links([x[0] for x in one], [x[0] for x in two], [x[1] for x in both], percent) if one and len(both) > 1 else ():
                found.append((both[i][2], both[k][2]))
        return _edges(found)

    return rows.groupBy("deal").applyInArrow(joined, "a long, b long")


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def with_group(rows: DataFrame, of: DataFrame, salts: int = 16) -> DataFrame:
    """rows (root, node) joined with of (root: one row a group). A group's rows are dealt out to as many tasks as there are salts."""
    salted = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(salted, ["root", "_salt"]).drop("_salt")


def tiled(members: DataFrame, grams: int, room: int, count: int) -> DataFrame:
    """members (root, node, n) with tile: of a group and a band of sizes, and wide: whether the group has several. Tiles hold about so many n-grams, and so many members, at most."""
    banded = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / np.log(1.2)).cast("int"))
    sums = banded.groupBy("root", "band").agg(F.ceil(F.greatest(F.sum("n") / grams, F.count("*") / room)).cast("int").alias("tiles"))
    sums = sums.groupBy("root").agg((F.sum("tiles") > 1).alias("wide"), F.map_from_entries(F.collect_list(F.struct("band", "tiles"))).alias("tiles"))  # a group has at most a few dozen bands
    tile = F.xxhash64("root", "band", F.pmod(F.xxhash64("node"), F.element_at("tiles", F.col("band"))))
    return written(few(with_group(banded, sums).select("root", "node", "n", "wide", tile.alias("tile")), count), clean=True)


def meetings(held: DataFrame, tile: int) -> DataFrame:
    """root, tiles: the keys whose nodes are yet to meet, and in how many tiles. held: root (a key), node, n, known, apart.

    These are the keys that a node apart has and whose nodes aren't all connected; of keys with the same nodes, one.
    """
    nodes = F.count("*").alias("nodes"), F.bit_xor(F.xxhash64("node")).alias("same"), F.sum("n").alias("grams"), F.count_if("apart").alias("apart")
    by = held.groupBy("root").agg(*nodes, F.min("known").alias("low"), F.max("known").alias("high")).where("apart > 0 AND low < high")
    return by.groupBy("nodes", "same", "grams").agg(F.min("root").alias("root")).select("root", F.ceil(F.greatest(F.col("grams") / tile, F.col("nodes") / ROOM)).cast("int").alias("tiles"))


def connected(tiles: DataFrame, texts: DataFrame, rare: DataFrame, words: int, percent: int, count: int, tile: int = TILE) -> DataFrame:
    """node, root: what the links of the groups connect; a table. tiles: tiled(), of so many members; rare: node and key, the keys that nodes keep.

    First each tile by itself, with its group's smallest node as a guest; then what isn't connected with that node, against what shares a kept key with it.
    """
    spark = tiles.sparkSession

    def links(rows: DataFrame) -> DataFrame:
        laid = written(few(rows, 4 * count), clean=True)
        made = written(compared(laid, texts, words, percent), clean=True)
        dropped(spark, laid)
        return made

    own = F.lit(0).alias("side"), "node", F.col("node").alias("known")
    heads = tiles.where("wide AND node = root").select("root", F.col("tile").alias("own"))
    guests = tiles.where("wide").select("root", "tile").distinct().join(heads, "root").where("tile <> own").withColumnRenamed("root", "node")
    edges = links(tiles.select("tile", *own).unionByName(guests.select("tile", *own)))
    found = components(edges)
    state = tiles.where("wide").join(found.select("node", F.col("root").alias("known")), "node", "left").withColumn("known", F.coalesce("known", "node"))
    state = written(few(state, count), clean=True)
    head = state.where("node = root").select("root", F.col("known").alias("head"))
    told = with_group(state, head).select("node", "n", "known", (F.col("known") != F.col("head")).alias("apart"))
    held = written(few(rare.join(told, "node").select(F.col("key").alias("root"), "node", "n", "known", "apart"), 4 * count), clean=True)
    meet = written(few(meetings(held, tile), count), clean=True)
    if not meet.isEmpty():
        mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        of = with_group(held, meet).withColumn("_own", mine).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        # What is apart in a tile meets all that are in another one; a tile by itself is on one side, where what is connected already isn't compared.
        left = of.where("apart OR _own = _tile").select(F.xxhash64("root", "_own", "_tile").alias("tile"), F.lit(0).alias("side"), "node", "known")
        right = of.where("_own <> _tile").select(F.xxhash64("root", "_tile", "_own").alias("tile"), F.lit(1).alias("side"), "node", "known")
        more = links(left.unionByName(right))
        again = components(edges.unionByName(more))
        dropped(spark, more, found)
        found = again
    dropped(spark, edges, state, held, meet)
    return found


def maybe(rows: DataFrame, id: str, wanted: DataFrame, count: int) -> DataFrame:
    """The rows whose id may be among the wanted ones (one column, so many rows), so that a join needn't deal out the others.

    A bitmap of at most FILTER bits, however many are wanted: beyond, it lets more rows through that the join drops.
    """
    bits = min(FILTER, max(1 << 16, 1 << (16 * count).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = wanted.select(place(wanted.columns[0]).alias("k")).select((F.col("k") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(k % 64 AS int))").alias("b"))
    words = np.zeros(bits // 64, np.int64)
    for w, b in at.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most FILTER / 64 rows
        words[w] = b
    told = rows.sparkSession.sparkContext.broadcast(words.view(np.uint64))
    columns = rows.columns

    def passed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            k = b.column("_k").to_numpy()
            hit = told.value[k >> 6] >> (k & 63).astype(np.uint64) & np.uint64(1)
            yield b.filter(pa.array(hit.astype(bool))).select(columns)

    return rows.where(F.col(id).isNotNull()).withColumn("_k", place(id)).mapInArrow(passed, rows.schema)


def linked(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85, tile: int = TILE) -> DataFrame:
    """id, n_shingles, component_id of each row: the smallest id reachable by links of similarity >= percent / 100, its own included.

    A null text, or one without words, has the empty set and is linked with nothing. Equal texts are linked; so are repeated rows.
    Null ids are never the smallest, but their rows link others; rows that are only linked with null ids have a null component_id.
    """
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col(id).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def sized(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, "_text", SLICE):
            sets = gram_sets(b.column("_text"), words)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_t"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())], ["_id", "_t", "n", "node"])

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """For each slice: its sets' node, band, keys and need; all their keys; and which set each is of."""
        told: set[int] = set()  # a task gives the keys of equal sets once
        for b in slices(parts, "_text", SLICE):
            sets = {set_hash(s): s for s in gram_sets(b.column("_text"), words) if len(s)}
            new = [k for k in sets if k not in told]
            if len(told) > 200_000:
                told.clear()
            told.update(new)
            made = [(k, *x) for k in new for x in part_keys(sets[k], percent)]
            yield made, np.concatenate([np.zeros(0, np.int64), *(x[2] for x in made)]), np.repeat(np.arange(len(made)), [len(x[2]) for x in made])

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice's distinct keys, with their smallest and largest node and how often they are there."""
        for made, key, at in keyed(parts):
            if not len(key):
                continue
            node = np.array([x[0] for x in made], np.int64)[at]
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            last = np.r_[first[1:], len(key)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[first], node[first], node[last], last - first + 1)], ["key", "least", "most", "times"])

    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, key, at in keyed(parts):
            of = (np.array([x[i] for x in made], t)[at] for i, t in ((0, np.int64), (1, np.int32), (3, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *of)], ["key", "node", "band", "need"])

    def of_node(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row can have the hash of another text; the one whose set is the node's is meant."""
        for b in slices(parts, "_text", SLICE):
            right = [set_hash(s) == k for s, k in zip(gram_sets(b.column("_text"), words), b.column("node").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("_text")], ["node", "_text"]).filter(pa.array(right, pa.bool_()))

    of = written(rows.mapInArrow(sized, f"_id {kind}, _t long, n long, node long"), clean=True)
    rep = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_t")).alias("rep")
    nodes = written(of.where("n > 0").groupBy("node").agg(rep, F.first("n").alias("n")), clean=True)
    # Keys that several nodes have, with how often they are given.
    # Most are in one slice only, so that summing up slices before the shuffle would cost more than it saves.
    often = rows.mapInArrow(counted, "key long, least long, most long, times long").repartition("key").groupBy("key").agg(F.min("least").alias("_a"), F.max("most").alias("_b"), F.sum("times").alias("times"))
    often = written(often.where("_a < _b").select("key", "times"), clean=True)
    keys = rows.mapInArrow(listed, "key long, node long, band int, need int")
    # By node and band; what shares fewer keys with all others together than with one that it is linked with, has no link.
    lists = keys.join(often, "key").groupBy("node", "band").agg(F.sort_array(F.collect_set(F.struct("times", "key"))).alias("keys"), F.max("need").alias("need")).where("size(keys) >= need")
    rare = written(lists.select("node", F.explode(F.expr("slice(keys.key, 1, size(keys) - need + 1)")).alias("key")), clean=True)
    # As star edges: each node with the smallest node that keeps one of its rarer keys.
    stars = rare.join(rare.groupBy("key").agg(F.min("node").alias("b")), "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    groups = components(stars)
    members = written(nodes.join(groups, "node"), clean=True)
    dropped(spark, often, groups)
    count, total = members.agg(F.count("*"), F.sum("n")).first()
    if not count:
        dropped(spark, rare)
        return _labelled(of, nodes.select("node", F.col("rep._id").alias("component_id")), id)
    wanted = members.select(F.col("rep._id").alias("_rep"), F.col("rep._t").alias("_of"), "node")
    some = maybe(rows, "_t", wanted.select("_of"), count)
    texts = written(wanted.join(some, F.col("_rep").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_t"))).select("node", "_text").mapInArrow(of_node, "node long, _text string").dropDuplicates(["node"]), clean=True)
    # Several tiles for each partition, so that large groups spread.
    spread = 8 * partitions(spark)
    tiles = tiled(members.select("root", "node", "n"), max(LEAST_TILE, min(tile, 2 * total // spread)), max(LEAST_ROOM, count // spread), count)
    done = connected(tiles, texts, rare, words, percent, count, tile)
    # The smallest id of each component: what is in none is by itself.
    labels = nodes.join(done, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("rep._id").alias("_rep"))
    least = labels.groupBy("root").agg(F.min("_rep").alias("component_id"))
    labels = written(labels.join(least, "root").select("node", "component_id"), clean=True)
    dropped(spark, members, texts, tiles, done, nodes, rare)
    return _labelled(of, labels, id)


def _labelled(of: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    some = of.where("n > 0").join(labels, "node").select(F.col("_id").alias(id), F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(of.where("n = 0").select(F.col("_id").alias(id), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id")))
