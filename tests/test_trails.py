"""Trails without listing them, against listing them; impact and subgraphs in rows."""

import random
from itertools import combinations
from math import comb

from pyspark.sql import functions as F

from trestle.operators import graph

EDGES = "src int, dst int, type string, description string, ord bigint"


def listed(edges, roots, hops):
    """Brute force: every trail, edge by edge."""
    found = set()

    def go(root, node, used):
        for e in edges:
            if e[4] not in used and node in e[:2] and len(used) < hops:
                to = e[1] if e[0] == node else e[0]
                now = {**used, e[4]: e[2:4]}
                if to != root:
                    found.update((root, to, *k) for k in now.values())
                go(root, to, now)

    for r in roots:
        go(r, r, {})
    return found


def walked(spark, edges, roots, hops):
    out = graph.within_hops(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(r,) for r in roots], "root int"), hops).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_trails_equal_their_list(spark):
    for seed, hops in ((1, 3), (2, 4), (3, 5)):
        r = random.Random(seed)
        edges = [(r.randrange(6), r.randrange(6), r.choice(["A", "B", None]), r.choice(["x", None]), i) for i in range(9)]
        assert walked(spark, edges, range(3), hops) == listed(edges, range(3), hops)


def test_a_tail_can_only_be_told_where_it_is_not_used_up(spark):
    """1-2-3: a walk 1, 2, 3, 2 would end at 2 by the second edge, a trail can't; with a second edge between 2 and 3 it can."""
    line = [(1, 2, "A", "", 1), (2, 3, "B", "", 2)]
    assert (1, 2, "B", "") not in walked(spark, line, [1], 3)
    assert (1, 2, "B", "") in walked(spark, [*line, (3, 2, "C", "", 3)], [1], 3)


def test_hubs_keep_few_trails(spark):
    """Two nodes with 3,000 ways between them: 9 million trails of three edges and more, a few of which stand for all."""
    n = 3000
    edges = spark.range(n).select(F.lit(-1).alias("src"), F.col("id").cast("int").alias("dst"), F.lit("A").alias("type"), F.lit("").alias("description"), F.col("id").alias("ord"))
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.lit(-2).alias("dst"), F.lit("B").alias("type"), "description", (F.col("ord") + n).alias("ord")))
    out = graph.within_hops(edges, spark.createDataFrame([(-1,)], "root int"), 3)
    counts = {(r.type, r.node < 0): r.n for r in out.groupBy("type", F.when(F.col("node") < 0, -1).otherwise(0).alias("node")).agg(F.count("*").alias("n")).collect()}
    assert counts == {("A", True): 1, ("B", True): 1, ("A", False): n, ("B", False): n}
    trails = spark.range(2000).select(F.lit(1).alias("root"), F.lit(2).alias("node"), F.lit("k").alias("kind"), F.array("id", F.col("id") + 2000).alias("used"))
    assert graph._thinned(trails, 2, 3).count() <= comb(5, 2)


def test_what_stands_for_all_sets(spark):
    r = random.Random(4)
    for room in (0, 1, 2):
        sets = sorted({tuple(sorted(r.sample(range(7), 3))) for _ in range(25)})
        kept = spark.createDataFrame([([list(s) for s in sets],)], "s array<array<bigint>>").select(graph._standing(F.col("s"), room)).first()[0]
        assert 0 < len(kept) <= comb(3 + room, 3)
        for taken in combinations(range(7), room):
            assert any(not set(s) & set(taken) for s in sets) == any(not set(s) & set(taken) for s in kept)


def test_trails_of_nothing(spark):
    none = spark.createDataFrame([], EDGES)
    assert walked(spark, [(None, 1, "A", "", 1), (1, None, "A", "", 2), (1, 2, "A", "", None)], [1, None], 2) == set()
    assert graph.within_hops(none, spark.createDataFrame([(1,)], "root int"), 2).count() == 0
    assert walked(spark, [(1, 2, "A", "", 1)] * 3 + [(1, 1, "A", "", 2)], [1, 1], 3) == {(1, 2, "A", "")}


def test_impact_and_subgraph(spark):
    e = spark.createDataFrame([(1, 2, "AFFECTS", "", 1), (2, 3, "RELATED_TO", "", 2), (3, 4, "AFFECTS", "", 3), (1, 5, "DETERMINES", "", 4)], EDGES)
    one = spark.createDataFrame([(1,), (1,)], "root int")
    rules = spark.createDataFrame([("r", 1), ("r", 1), ("s", 1), ("t", 2), (None, 1)], "rule string, param int")
    cited = spark.createDataFrame([("r", "HCM"), ("r", "HCM"), ("r", "MUTCD"), ("t", "x"), ("s", None)], "rule string, ref string")
    got = {tuple(r) for r in graph.impact(e, one, rules, cited).collect()}
    assert got == {(1, "rule", "r", 2), (1, "rule", "s", 0), (1, "related", "2", None), (1, "related", "3", None), (1, "reference", "HCM", None), (1, "reference", "MUTCD", None)}
    assert {r.ord for r in graph.subgraph(e, one.distinct(), 1).collect()} == {1, 4}


def test_passes_change_nothing(spark):
    r = random.Random(7)
    edges = [(r.randrange(9), r.randrange(9), r.choice("ab"), "", i) for i in range(14)]
    df, roots = spark.createDataFrame(edges, EDGES), spark.range(9).selectExpr("cast(id AS int) AS root")
    many = graph.within_hops(df, roots, 3, pass_pairs=60).collect()
    assert len(many) == len(set(many)) and {tuple(x) for x in many} == listed(edges, range(9), 3)


def test_conflicts_of_one_parameter_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 4)
    r = random.Random(3)
    rules = [(i, r.choice("ab"), float(lo := r.randrange(40)), float(lo + r.randrange(9))) for i in range(30)]
    out = graph.disjoint_pairs(spark.createDataFrame(rules, "rule_id int, param string, lo double, hi double"))
    assert "_x" in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == len(set(got)) and {(x.a, x.b) for x in got} == {(a[0], b[0]) for a in rules for b in rules if a[1] == b[1] and a[0] < b[0] and (a[3] < b[2] or b[3] < a[2])}


def test_short_trails_need_no_sets(spark, monkeypatch):
    """Up to four edges, masks of roots are enough, whatever edges lie beside each other and however many passes there are; loops and shared numbers are left to sets."""
    sets = graph._by_sets
    monkeypatch.setattr(graph, "_by_sets", None)
    for seed, hops in ((4, 1), (5, 2), (6, 3), (7, 4)):
        r = random.Random(seed)
        edges = [(a, b, r.choice(["A", "B", None]), r.choice(["x", None]), i) for i in range(11) for a, b in [r.sample(range(5), 2)]]
        out = graph.within_hops(spark.createDataFrame([*edges, edges[0], (None, 1, "A", "x", 50)], EDGES), spark.createDataFrame([(i,) for i in (0, 1, 3, 8, None)], "root int"), hops, pass_pairs=9).collect()
        assert len(out) == len({tuple(x) for x in out}) and {tuple(x) for x in out} == listed(edges, (0, 1, 3, 8), hops)
    monkeypatch.setattr(graph, "_by_sets", sets)
    monkeypatch.setattr(graph, "_by_masks", None)
    # 2 has a loop: 1, 2, 2, 1, 3 is no trail, though no edge comes twice in a row. Numbers that two edges have are one edge's.
    loop = [(1, 2, "A", "", 1), (2, 2, "B", "", 2), (1, 3, "C", "", 3)]
    assert walked(spark, loop, [1], 4) == listed(loop, [1], 4)
    shared = [(1, 2, "A", "", 1), (2, 3, "B", "", 2), (3, 4, "A", "", 1)]
    assert walked(spark, shared, [1], 3) == listed(shared, [1], 3)
