"""Walks over dependency graphs: level by level, for all roots at once."""

from __future__ import annotations

import math
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far an authority is trusted, and the kinds of edges that stand for causes.
AUTHORITY = {"HCM": 1.0, "AASHTO": 0.95, "MUTCD": 0.95, "FHWA": 0.9, "state_DOT": 0.7, "county": 0.5, "derived": 0.5}
UNKNOWN_AUTHORITY = 0.5
CAUSAL = ("AFFECTS", "DETERMINES", "CONSTRAINS")
#: Rules of one tile of disjoint_pairs(), and pairs of rules that a task compares, about.
TILE, TASK_PAIRS = 2000, 4_000_000
#: Pairs of edges that lead away from the roots of one pass of within_hops(), where it keeps sets of edges and where masks are enough: for trails of up to SHORT edges.
PASS_PAIRS, MASK_PAIRS, SHORT = 500_000, 4_000_000, 4
#: Roots of one mask of balls(): the bits of a long. Roots of one pass of ball_sizes().
BLOCK, PASS_ROOTS = 64, 100_000


def weight(source: Column) -> Column:
    out = F.lit(UNKNOWN_AUTHORITY)
    for name, w in AUTHORITY.items():
        out = F.when(source == name, w).otherwise(out)
    return out


def chain(edges: DataFrame, roots: DataFrame, depth: int = 10, types: tuple[str, ...] = ("AFFECTS",), backward: bool = False, weighted: bool = True, keep: int = 1) -> DataFrame:
    """root, node, depth, ords, path, confidence: what each root reaches, each node once, on the path that a breadth-first walk in the edges' order takes.

    edges: src, dst, type, source, ord; roots: root. Of the paths that reach a new node on a level, the one whose edges come first (their ords compared one by
    one) wins. A level is one join with the edges and one grouping; the levels are written, so that a plan never holds more than one.
    """
    from trestle.sources.tables import written

    step = edges.where(F.col("type").isin(*types)).select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.concat_ws(" -> ", "src", "dst").alias("_hop"), (weight(F.col("source")) if weighted else F.lit(1.0)).alias("_w"), F.col("ord").alias("_ord"))
    if backward:
        step = step.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_hop", "_w", "_ord")
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("ords"), F.array().cast("array<string>").alias("path"), F.lit(1.0).alias("confidence"))
    front = seen
    for level in range(1, depth + 1):
        hop = F.concat(F.array("_hop"), "path") if backward else F.concat("path", F.array("_hop"))
        tried = front.join(step, front["node"] == step["_a"]).select("root", F.col("_b").alias("node"), F.concat("ords", F.array("_ord")).alias("ords"), hop.alias("path"), (F.col("confidence") * F.col("_w")).alias("confidence"))
        best = tried.groupBy("root", "node").agg(F.min(F.struct("ords", "path", "confidence")).alias("_")).select("root", "node", F.lit(level).alias("depth"), "_.*")
        front = written(best.join(seen, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def reach(chained: DataFrame, roots: DataFrame) -> DataFrame:
    """root, downstream, max_depth: how many nodes a chain has reached from each root, and how far away the last of them is; 0 and 0 where it led nowhere."""
    some = chained.groupBy("root").agg(F.count("*").alias("downstream"), F.max("depth").alias("max_depth"))
    return roots.select("root").distinct().join(some, "root", "left").select("root", F.coalesce("downstream", F.lit(0)).cast("bigint").alias("downstream"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"))


def within_hops(edges: DataFrame, roots: DataFrame, hops: int, types: tuple[str, ...] | None = None, pass_pairs: int | None = None) -> DataFrame:
    """root, node, type, description: what trails of up to so many undirected edges reach, no edge twice, with the kinds of all edges on such trails; roots don't relate to themselves.

    edges: src, dst, type, description, ord (whole numbers, one an edge). Trails aren't listed. Null kinds are kinds; edges without an end or a number, and null
    roots, lead nowhere; repeated rows count once. Up to SHORT edges it is enough that no edge comes twice in a row, as _by_masks() tells; longer trails, loops and numbers that
    several edges have want the sets of edges of _by_sets(). Roots are walked from in passes, each of about pass_pairs pairs of edges, whose shuffles and tables are gone before the next.
    """
    from trestle.sources.tables import dropped, written

    some = (edges if types is None else edges.where(F.col("type").isin(*types))).where("src IS NOT NULL AND dst IS NOT NULL AND ord IS NOT NULL")
    ways = some.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.struct("type", "description").alias("_k"), F.col("ord").cast("bigint").alias("_o"))
    both = written(ways.unionByName(ways.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_k", "_o")).distinct(), clean=True)
    start = roots.where("root IS NOT NULL").select("root").distinct()
    # An edge that is no loop and has a number of its own has it twice, once in each direction.
    plain = hops <= SHORT and both.groupBy("_o").agg(F.count("*").alias("_n")).where("_n <> 2").isEmpty()
    degree = both.groupBy("_a").agg(F.count("*").alias("_n"))
    # How many pairs of edges lead away from the roots tells how many passes over them there are.
    pairs = start.join(both, F.col("root") == F.col("_a")).groupBy("_b").agg(F.count("*").alias("_m")).join(degree.withColumnRenamed("_a", "_b"), "_b").agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 0
    passes = max(1, -(-int(pairs) // (pass_pairs or (MASK_PAIRS if plain else PASS_PAIRS))))
    found = (_by_masks if plain else _by_sets)(both, start, hops, passes)
    dropped(both.sparkSession, both)
    return found


def _by_masks(both: DataFrame, start: DataFrame, hops: int, passes: int) -> DataFrame:
    """What within_hops() returns, of edges in both directions (_a, _b, _k, _o) without loops whose numbers are their own, and up to SHORT of them.

    A walk in which no edge comes twice in a row need not be a trail, but between its ends, if they differ, each of its edges is on a trail that is no longer: of four edges one can
    come again as e f e, where f lies beside e and can take its place, or as e f g e, where g and f lead from end to end without e. So walks are told apart by
    their last edge and one kind that they have told, or none, and BLOCK roots share a mask, as in balls().

    The edges at a node are numbered, and a node has two masks for each binary digit of these numbers: of walks whose last edge has 0 there, and 1. A walk may go
    on by an edge if its last one differs in some digit, so that as many rows leave a node as it has edges, not pairs of edges.
    """
    from trestle.sources.tables import dropped, written

    kinds = written(both.select("_k").distinct().select("_k.*", F.monotonically_increasing_id().alias("kind")), clean=True)
    told = both.join(kinds, F.col("_k.type").eqNullSafe(kinds["type"]) & F.col("_k.description").eqNullSafe(kinds["description"])).select("_a", "_b", "_o", F.col("kind").alias("_kind"))
    arcs = written(told.withColumn("_from", F.row_number().over(Window.partitionBy("_a").orderBy("_o")) - 1), clean=True)
    digits = max(1, int(arcs.agg(F.max("_from")).first()[0] or 0).bit_length())
    # By an edge a walk goes on as it is, or tells the edge's kind; what was told before stays, by a way from each node to itself.
    back = arcs.select(F.col("_a").alias("_b"), F.col("_b").alias("_a"), "_o", F.col("_from").alias("_to"))
    steps = arcs.join(back, ["_a", "_b", "_o"]).select("_a", "_b", "_from", "_to", "_kind", F.explode(F.array(F.lit(False), F.lit(True))).alias("_tells"))
    stays = arcs.select("_a").distinct().selectExpr("_a", "_a AS _b", "-1 AS _from", "0 AS _to", "-1L AS _kind", "false AS _tells")
    ways = written(steps.unionByName(stays), clean=True)
    numbered, blocks = _blocks(both.select("_a", "_b").distinct(), start)
    at = lambda c, j: F.col(c).bitwiseAND(F.lit(1 << j)) != 0
    found = []
    for k in range(passes):
        own = F.expr("shiftleft(1L, _bit)")
        front = numbered.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == k).select(F.col("root").alias("node"), "block", F.lit(-1).cast("bigint").alias("kind"), F.lit(0).cast("bigint").alias("mask"), *(own.alias(f"_{d}{j}") for j in range(digits) for d in (0, 1)))
        for level in range(1, hops + 1):
            met = front.join(ways, front["node"] == ways["_a"]).where("CASE WHEN kind < 0 THEN _from >= 0 ELSE NOT _tells AND kind <> _kind END")
            open_ = reduce(Column.bitwiseOR, (F.when(at("_from", j), F.col(f"_0{j}")).otherwise(F.col(f"_1{j}")) for j in range(digits)))
            gone = met.select(F.col("_b").alias("node"), "block", F.when(F.col("_tells"), F.col("_kind")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("_from") >= 0, open_).otherwise(0).alias("_m"), F.when(F.col("_from") < 0, F.col("mask")).otherwise(0).alias("mask"), "_to")
            gone = gone.where("_m <> 0 OR mask <> 0")
            told = F.bit_or(F.when(F.col("kind") >= 0, F.col("mask").bitwiseOR(F.col("_m"))).otherwise(0)).alias("mask")
            if level == hops:
                front = gone.where("kind >= 0").groupBy("node", "block", "kind").agg(told)
            else:
                last = [F.bit_or(F.when(at("_to", j) == bool(d), F.col("_m")).otherwise(0)).alias(f"_{d}{j}") for j in range(digits) for d in (0, 1)]
                front = gone.groupBy("node", "block", "kind").agg(told, *last)
        found.append(written(front, clean=True))
    dropped(both.sparkSession, arcs, ways)
    masks = reduce(DataFrame.unionByName, found).join(kinds, "kind")
    return _told(masks, blocks, "node", "type", "description").where("root <> node")


def _by_sets(both: DataFrame, start: DataFrame, hops: int, passes: int) -> DataFrame:
    """What within_hops() returns, of any edges in both directions (_a, _b, _k, _o).

    A state is a root, a node and one kind that the trail has told already, or none. Of a state's trails of one length so many stay that each way to go on is open to one of
    them if it is open to any; by Bollobas' theorem these are C(hops, length) at most, 10 for five hops, however many trails meet at a hub.
    """
    from trestle.sources.tables import dropped, written

    told = both.schema["_k"].dataType
    found = []
    for k in range(passes):
        mine = start.where(F.pmod(F.xxhash64("root"), F.lit(passes)) == k)
        front = mine.select("root", F.col("root").alias("node"), F.lit(None).cast(told).alias("kind"), F.array(F.array().cast("array<bigint>")).alias("sets"))
        hits, tables = [], []
        for level in range(1, hops + 1):
            last = level == hops
            tells = F.when(F.col("kind").isNull(), F.array(F.col("_k")) if last else F.array(F.col("kind"), F.col("_k"))).otherwise(F.array("kind"))
            open_ = F.filter("sets", lambda s: ~F.array_contains(s, F.col("_o")))
            grown = front.join(both, front["node"] == both["_a"]).select("root", F.col("_b").alias("node"), tells.alias("_tells"), open_.alias("sets"), "_o").where("size(sets) > 0")
            grown = grown.select("root", "node", F.explode("_tells").alias("kind"), "sets", "_o")
            if last:
                front = grown.select("root", "node", "kind")
            else:
                one = grown.select("root", "node", "kind", F.explode(F.transform("sets", lambda s: F.array_sort(F.concat(s, F.array("_o"))))).alias("used"))
                front = _thinned(one.distinct(), level, hops - level)
                tables.append(front)
            hits.append(front.where("kind IS NOT NULL AND root <> node").select("root", "node", "kind"))
        found.append(written(reduce(DataFrame.unionByName, hits).distinct(), clean=True))
        dropped(both.sparkSession, *tables)
    return reduce(DataFrame.unionByName, found).select("root", "node", "kind.type", "kind.description")


def _thinned(trails: DataFrame, level: int, room: int) -> DataFrame:
    """root, node, kind, sets: of the trails (root, node, kind, used: level edges each) those that further room edges may need. Groups too large for a task are thinned in parts first: what stands for the parts' rest stands for the whole's."""
    from trestle.sources.tables import dropped, written

    keys, most = ["root", "node", "kind"], 100 * comb(level + room, level)
    thin = lambda df, *by: df.groupBy(*keys, *by).agg(_standing(F.array_sort(F.collect_set("used")), room).alias("sets")).select(*keys, "sets")
    trails = written(trails, clean=True)
    while (largest := trails.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > most:
        fewer = written(thin(trails, F.pmod(F.xxhash64("used"), F.lit(-(-largest // most))).alias("_part")).select(*keys, F.explode("sets").alias("used")), clean=True)
        dropped(trails.sparkSession, trails)
        trails = fewer
    kept = written(thin(trails), clean=True)
    dropped(trails.sparkSession, trails)
    return kept


def _standing(sets: Column, room: int) -> Column:
    """Those of equally large sets that stand for all: whatever up to room elements are taken, a set without them is among these if there is any.

    One by one, a set stays if some such elements lie outside it and hit all that stayed before; that is searched element by element of the sets not hit yet.
    """
    none = F.array().cast("array<bigint>")

    def needed(kept: Column, one: Column) -> Column:
        def hit(ways: Column, other: Column) -> Column:
            longer = lambda way: F.transform(F.array_except(other, one), lambda e: F.concat(way, F.array(e)))
            return F.flatten(F.transform(ways, lambda way: F.when(F.arrays_overlap(way, other), F.array(way)).when(F.size(way) < room, longer(way)).otherwise(F.array().cast("array<array<bigint>>"))))

        return F.size(F.aggregate(kept, F.array(none), hit)) > 0

    return F.aggregate(sets, F.array().cast("array<array<bigint>>"), lambda kept, one: F.when(needed(kept, one), F.concat(kept, F.array(one))).otherwise(kept))


def subgraph(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """root, src, dst, type, ord: the edges among the nodes within so many undirected edges of each root, itself among them. A root without edges has no row."""
    near, blocks = balls(edges, roots, hops)
    return _told(_inner(edges.select("src", "dst", "type", "ord"), near), blocks, "src", "dst", "type", "ord")


def ball_sizes(edges: DataFrame, roots: DataFrame, hops: int, pass_roots: int | None = None) -> DataFrame:
    """root, nodes, edges: how many nodes lie within so many undirected edges of each root, itself among them, and how many edges among these. Edges are told apart by src, dst and ord; null roots have no row.

    Balls are counted in passes of about pass_roots roots, whose shuffles and balls are gone before the next: what is left of a pass is a row for each block.
    """
    from trestle.sources.tables import dropped, written

    both, ways, numbered, blocks = _started(edges, roots)
    # The bits of a mask are counted two at once, one in each half of a number.
    pairs = lambda of: [F.sum(F.shiftright("mask", i).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"{of}_{i}") for i in range(BLOCK // 2)]
    counts = lambda of: F.array(*(F.coalesce(F.col(f"{of}_{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)) for i in range(BLOCK // 2)), *(F.coalesce(F.shiftright(f"{of}_{i}", 32), F.lit(0)) for i in range(BLOCK // 2)))
    told = written(edges.select("src", "dst", "ord").distinct(), clean=True)
    passes = max(1, math.ceil(numbered.count() / (pass_roots or PASS_ROOTS)))
    found = []
    for k in range(passes):
        near = written(_near(numbered.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == k), ways, hops), clean=True)
        found.append(written(near.groupBy("block").agg(*pairs("n")).join(_inner(told, near).groupBy("block").agg(*pairs("e")), "block", "left"), clean=True))
        dropped(both.sparkSession, near)
    dropped(both.sparkSession, both, told)
    one = blocks.join(reduce(DataFrame.unionByName, found), "block").select(F.posexplode("roots").alias("_i", "root"), counts("n").alias("_n"), counts("e").alias("_e"))
    return one.select("root", F.get("_n", F.col("_i")).cast("bigint").alias("nodes"), F.get("_e", F.col("_i")).cast("bigint").alias("edges"))


def balls(edges: DataFrame, roots: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """near (node, block, mask) and blocks (block, roots): the nodes within so many undirected edges of each root, itself among them; bit i of a mask stands for the i-th of the block's roots.

    BLOCK roots walk together, so that a step is a join of nodes by blocks, and one grouping that puts masks together. Those of a block share hubs (of the nodes
    within two edges the one with most edges, then that within one) as far as they can, for their balls are much the same then. Null roots are in no block.
    """
    _, ways, numbered, blocks = _started(edges, roots)
    return _near(numbered, ways, hops), blocks


def _started(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """both (_a, _b), a table of the edges in both directions; ways, these and one from every node to itself, which keeps what is there already; numbered and blocks as in _blocks()."""
    from trestle.sources.tables import written

    some = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    both = written(some.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).unionByName(some.select(F.col("dst").alias("_a"), F.col("src").alias("_b"))).distinct(), clean=True)
    start = roots.where("root IS NOT NULL").select("root").distinct()
    ways = both.unionByName(both.select("_a", F.col("_a").alias("_b")).unionByName(start.select(F.col("root").alias("_a"), F.col("root").alias("_b"))).distinct())
    return both, ways, *_blocks(both, start)


def _near(numbered: DataFrame, ways: DataFrame, hops: int) -> DataFrame:
    """node, block, mask: what numbered roots reach by so many ways."""
    near = numbered.select(F.col("root").alias("node"), "block", F.expr("shiftleft(1L, _bit)").alias("mask")).groupBy("node", "block").agg(F.bit_or("mask").alias("mask"))
    for _ in range(hops):
        near = near.join(ways, near["node"] == ways["_a"]).groupBy(F.col("_b").alias("node"), "block").agg(F.bit_or("mask").alias("mask"))
    return near


def _blocks(both: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """numbered (root, block, _bit) and blocks (block, roots): BLOCK roots a block, such as share hubs."""
    from trestle.sources.tables import written

    hubs = both.groupBy("_a").agg(F.struct(F.count("*").alias("n"), F.col("_a").alias("hub")).alias("_h"))
    around = lambda h: both.join(h.select(F.col("_a").alias("_b"), "_h"), "_b").groupBy("_a").agg(F.max("_h").alias("_h"))
    one = around(hubs)
    ranked = start.join(one.select(F.col("_a").alias("root"), F.col("_h.hub").alias("_one")), "root", "left").join(around(one).select(F.col("_a").alias("root"), F.col("_h.hub").alias("_two")), "root", "left")
    # The number of a row is its place in its range, so that ranges needn't know of one another; it is written before it is used.
    numbered = written(ranked.repartitionByRange("_two", "_one", "root").sortWithinPartitions("_two", "_one", "root").select("root", F.monotonically_increasing_id().alias("_n")), clean=True)
    numbered = numbered.select("root", F.shiftright("_n", 6).alias("block"), F.pmod("_n", F.lit(BLOCK)).cast("int").alias("_bit"))
    blocks = numbered.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_bit", "root"))), lambda x: x["root"]).alias("roots"))
    return numbered, blocks


def _inner(edges: DataFrame, near: DataFrame) -> DataFrame:
    """edges with block and mask: which roots have both ends near."""
    side = lambda end, m: near.select(F.col("node").alias(end), "block", F.col("mask").alias(m))
    both = edges.join(side("src", "_s"), "src").join(side("dst", "_d"), ["dst", "block"])
    return both.withColumn("mask", F.col("_s").bitwiseAND(F.col("_d"))).where("mask <> 0").drop("_s", "_d")


def _told(masks: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """root and the columns, a row for each bit of each mask."""
    return masks.join(blocks, "block").select(*columns, "mask", F.posexplode("roots").alias("_i", "root")).where(F.expr("shiftright(mask, _i) & 1 = 1")).select("root", *columns)


def impact(edges: DataFrame, roots: DataFrame, validates: DataFrame, cited: DataFrame, types: tuple[str, ...] = ("AFFECTS", "RELATED_TO")) -> DataFrame:
    """root, kind, item, n: what a change of each root touches: its rules with how many references each has, what is related within two hops, and the references.

    validates: rule, param; cited: rule, ref. Items are texts; n is null but for rules. A rule that is given twice for a root counts once. References are counted by rule before they meet the roots.
    """
    text = lambda c: F.col(c).cast("string").alias("item")
    rules = validates.where("rule IS NOT NULL").select("rule", F.col("param").alias("root")).distinct().join(roots.distinct(), "root", "left_semi")
    refs = cited.where("ref IS NOT NULL").distinct()
    counted = rules.join(refs.groupBy("rule").agg(F.count("*").alias("_n")), "rule", "left").select("root", F.lit("rule").alias("kind"), text("rule"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))
    empty = F.lit(None).cast("bigint").alias("n")
    related = neighbours(edges.where(F.col("type").isin(*types)), roots.distinct(), 2).select("root", F.lit("related").alias("kind"), text("node"), empty)
    given = rules.join(refs, "rule").select("root", F.lit("reference").alias("kind"), text("ref"), empty).distinct()
    return counted.unionByName(related).unionByName(given)


def neighbours(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """root, node: the nodes within so many undirected edges of each root, itself left out."""
    return _told(*balls(edges, roots, hops), "node").where("root <> node")


def exogenous(chained: DataFrame, edges: DataFrame, bounds: DataFrame, site: DataFrame, most: int = 3) -> DataFrame:
    """root, node: the first so many ancestors of each root that have bounds, aren't given by the site and are caused by nothing."""
    caused = edges.where(F.col("type").isin(*CAUSAL)).select(F.col("dst").alias("node")).distinct()
    free = chained.join(bounds.select(F.col("param").alias("node")), "node", "left_semi").join(site, "node", "left_anti").join(caused, "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("root").orderBy("depth", "ords"))
    return free.withColumn("place", rank).where(F.col("place") <= most).select("root", "node", "depth", "place")


def disjoint_pairs(rules: DataFrame) -> DataFrame:
    """a, b, param: pairs of range rules on a parameter that no value can keep. rules: rule_id, param, lo, hi.

    The join is on the parameter, and on tiles of its rules: a parameter's pairs are as many as the square of its rules, so that each task gets those of two tiles of
    about TILE rules. Two tiles meet once: every rule goes to as many pairs of tiles as its parameter has tiles. Pairs of tiles are dealt out by how many pairs of
    rules they have, not by their bytes, which are few: a task compares about TASK_PAIRS.
    """
    from trestle.sources.tables import written

    rules = rules.where("rule_id IS NOT NULL AND param IS NOT NULL").select("rule_id", "param", "lo", "hi")
    size = written(rules.groupBy("param").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / TILE).cast("int").alias("_tiles")))
    pairs = size.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0
    parts = max(1, math.ceil(pairs / TASK_PAIRS))
    one = rules.join(size, "param").withColumn("_own", F.pmod(F.xxhash64("rule_id"), F.col("_tiles")).cast("int"))

    def side(k: str, own: str, other: str, first: Column, last: Column) -> DataFrame:
        met = one.withColumn("_other", F.explode(F.sequence(first, last)))
        return met.select("param", F.col(own).alias("_x"), F.col(other).alias("_y"), *(F.col(c).alias(f"{k}_{c}") for c in ("rule_id", "lo", "hi"))).repartition(parts, "param", "_x", "_y")

    both = side("a", "_own", "_other", F.col("_own"), F.col("_tiles") - 1).join(side("b", "_other", "_own", F.lit(0), F.col("_own")).hint("merge"), ["param", "_x", "_y"])
    apart = both.where("(_x < _y OR a_rule_id < b_rule_id) AND (a_hi < b_lo OR b_hi < a_lo)")
    return apart.select(F.least("a_rule_id", "b_rule_id").alias("a"), F.greatest("a_rule_id", "b_rule_id").alias("b"), "param")


def suggestions(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """node: the distinct neighbours of the chosen nodes that aren't chosen."""
    out = edges.join(chosen.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    into = edges.join(chosen.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return out.unionByName(into).join(chosen, "node", "left_anti").distinct()


def linked_edges(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """The candidate edges (src, dst, type) whose ends both exist, each once."""
    return candidates.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").dropDuplicates(["src", "dst", "type"])
