"""Steps whose tasks must not grow with the tables."""

import random

from pyspark.sql import functions as F

from trestle.operators import checks, graph, records, search
from trestle.plans import engine
from trestle.sources import roadxml
from trestle.sources.rules import rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_are_no_reason_to_sort_parameters(spark, tmp_path):
    spark.createDataFrame([("lane_width", 8.0), ("spl", 30.0)], "param string, value double").write.parquet(f"{tmp_path}/p")
    out = checks.checked(spark.read.parquet(f"{tmp_path}/p"), rules(spark))
    assert "SortMergeJoin" not in plan(out)
    assert sorted((r.rule_id, r.broken) for r in out.collect()) == [(1, "below"), (4, None), (9, None)]


def test_repairs_are_neither_sorted_nor_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, 20.0, 5.0), (2, 1.0, 1.0), (3, 30.0, 12.0)], "k int, a double, b double").write.parquet(f"{tmp_path}/d")
    how = (spark.read.parquet(f"{tmp_path}/d"), ["k"], {"a": (0.0, 30.0), "b": (0.0, 12.0)}, search.linear({"a": 2.0, "b": 1.0}), F.col("y") <= 40)
    singles, pairs = search.single_repairs(*how), search.pair_repairs(*how)
    assert "SortAggregate" not in plan(singles) and "Broadcast" not in plan(pairs)
    assert sorted((r.k, r.lever, r.trial, r["rank"]) for r in singles.collect()) == [(1, "a", 15.0, 1), (1, "b", 0.0, 5), (3, "a", 10.0, 4)]


def test_balls_of_many_roots_share_rows(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200) if i % 3 else r.randrange(4), "A", i) for i in range(300)] + [(None, 1, "A", 998), (2, None, "A", 999)]
    df, roots = spark.createDataFrame(edges, "src int, dst int, type string, ord int"), spark.range(210).selectExpr("cast(id AS int) AS root").unionByName(spark.createDataFrame([(None,), (3,)], "root int"))
    beside = {n: {n} for n in range(210)}
    for a, b, _, _ in edges[:300]:
        beside[a].add(b), beside[b].add(a)
    balls = {n: {n} for n in range(210)}
    for _ in range(3):
        balls = {n: set().union(*(beside[m] for m in ball)) for n, ball in balls.items()}
    inner = {(n, e) for n, ball in balls.items() for e in edges[:300] if e[0] in ball and e[1] in ball}
    assert sorted(map(tuple, graph.ball_sizes(df, roots, 3).collect())) == [(n, len(balls[n]), sum(e[0] in balls[n] and e[1] in balls[n] for e in edges[:300])) for n in range(210)]
    assert sorted(map(tuple, graph.neighbours(df, roots, 3).collect())) == [(n, m) for n in range(210) for m in sorted(balls[n] - {n})]
    assert sorted((x.root, (x.src, x.dst, x.type, x.ord)) for x in graph.subgraph(df, roots.distinct(), 3).collect()) == sorted(inner)
    # Four hubs tie nearly all together: a node's row stands for 64 roots.
    assert graph.balls(df, roots, 3)[0].count() * 10 < sum(map(len, balls.values()))


def test_tasks_of_conflicts_are_as_many_as_their_pairs_want(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 16)
    monkeypatch.setattr(graph, "TASK_PAIRS", 400)
    r = random.Random(4)
    rules = [(i, "ab"[i % 9 == 0], float(lo := r.randrange(40)), float(lo + r.randrange(-3, 9))) for i in range(120)] + [(None, "a", 0.0, 0.0), (7, "a", 90.0, 95.0), (500, None, 0.0, 0.0), (501, "a", None, 0.0)]
    out = graph.disjoint_pairs(spark.createDataFrame(rules, "rule_id int, param string, lo double, hi double"))
    got = out.collect()
    # Adaptive execution would put a few kB into one task.
    assert out.rdd.getNumPartitions() >= 12
    full, below = [x for x in rules if None not in x[:2]], lambda x, y: y[2] is not None and x[3] < y[2]
    assert sorted(map(tuple, got)) == sorted((a[0], b[0], a[1]) for a in full for b in full if a[1] == b[1] and a[0] < b[0] and (below(a, b) or below(b, a)))


def test_a_road_is_read_once_for_all_its_parameters(spark, tmp_path):
    lanes = '<laneSection s="0"><left><lane id="1" type="driving"><width a="3"/></lane></left></laneSection><laneSection s="5"><right><lane id="x" type="driving"><width a="4"/></lane><lane id="-1" type="driving"/><lane id="-2" type="none"><width a="1"/></lane></right></laneSection>'
    road = f'<road id="1"><planView><geometry><arc curvature="bent"/></geometry><geometry><line/></geometry><geometry><arc curvature="-0.5"/></geometry><geometry><arc curvature="0"/></geometry></planView><elevationProfile><elevation b="x"/><elevation b="0.5"/></elevationProfile><lateralProfile><superelevation a="0"/></lateralProfile><lanes>{lanes}</lanes></road>'
    spark.createDataFrame([(1, road), (2, "<road"), (3, None), (4, '<road id="4"/>')], "k int, xml string").write.parquet(f"{tmp_path}/r")
    out = roadxml.parameter_rows(roadxml.road_strings(spark.read.parquet(f"{tmp_path}/r"), "xml", ["k"]), ["k"])
    got = sorted((r.k, r.name, r.param, round(r.value, 4)) for r in out.collect())
    assert got == [(1, "elev_1_grade", "grade", 50.0), (1, "geom_2_radius_ft", "design_rad", 6.5617), (1, "section_0_lane_1_lane_width", "lane_width", 9.8425), (1, "section_1_lane_null_lane_width", "lane_width", 13.1234), (1, "super_0", "superelevation", 0.0)]
    assert "Union" not in plan(out)


def test_records_are_told_apart_once(spark, tmp_path):
    spark.createDataFrame([(1, '{"lane_width": 11}', None), (2, "x", None), (3, '{"grade": 1}', "struct"), (4, None, "xml")], "k int, raw string, given string").write.parquet(f"{tmp_path}/r")
    params, contexts, errors = records.extracted(spark.read.parquet(f"{tmp_path}/r"), ["k"], "raw", "given")
    # What reads a record is known before its readers start: contexts and errors parse nothing.
    assert "parseJson" in plan(params) and "parseJson" not in plan(contexts) + plan(errors)
    assert [(r.k, r.param) for r in params.collect()] == [(1, "lane_width")]
    assert sorted((r.k, r.source) for r in contexts.collect()) == [(1, "json"), (3, "struct")]
    assert sorted((r.k, r.error) for r in errors.collect()) == [(2, "no reader knows the record"), (3, "a struct of no known facility"), (4, "there is no such reader")]


def test_parameters_are_read_once_for_all_questions(spark, tmp_path):
    rows = [(1, "a-b", 2.0, None, 0), (1, "b", None, "x", 1), (2, "b", 1.0, None, 0), (2, "b", 9.0, None, 1), (None, "b", 3.0, None, 0)]
    spark.createDataFrame(rows, "record int, param string, value_num double, value_str string, ord int").write.parquet(f"{tmp_path}/p")
    keys = spark.createDataFrame([("a-b", "f"), ("b", "g")], "key string, field string")
    contexts = spark.createDataFrame([(2, {"t": "p"})], "record int, context map<string,string>")
    columns = "field string, rule_id int, rule_type string, severity string, lo double, hi double, lo_open boolean, hi_open boolean, allowed array<string>, citation string, conditions array<struct<type:string,value:string>>, formula string"
    corpus = [("f", 1, "formula", "error", None, None, None, None, None, "M", [], "a_b < g"), ("g", 2, "formula", "error", None, None, None, None, None, "M", [], "b > 5"), ("g", 3, "min", "error", 0.0, None, False, False, None, "M", [{"type": "t", "value": "p"}], None)]
    verdicts, asks = engine.validate(spark.read.parquet(f"{tmp_path}/p"), contexts, keys, spark.createDataFrame(corpus, columns))
    assert plan(asks).count("FileScan parquet") == 1
    got = {(r.record, r.kind, r.parameter, *r.related) for r in asks.collect()}
    inputs, asked = {(1, "missing_parameter", "g", "g"), (1, "missing_parameter", "b", "b"), (None, "missing_parameter", "b", "b")}, {(1, "ambiguous_context", "t", "g"), (None, "ambiguous_context", "t", "g")}
    assert got == inputs | asked
    assert {r.record: r.errors for r in verdicts.collect()}[2] == 2


def test_balls_are_counted_in_passes(spark, monkeypatch):
    from trestle.sources import tables

    r, kept, gone = random.Random(8), [], []
    edges = spark.createDataFrame([(r.randrange(400), r.randrange(400), i) for i in range(500)], "src int, dst int, ord int")
    roots = spark.range(400).selectExpr("cast(id AS int) AS root")
    write, drop = tables.written, tables.dropped
    whole = sorted(map(tuple, graph.ball_sizes(edges, roots, 2).collect()))
    monkeypatch.setattr(tables, "written", lambda df, clean=False: kept.append((clean, df.columns)) or write(df, clean))
    monkeypatch.setattr(tables, "dropped", lambda s, *t: gone.extend(x.columns for x in t) or drop(s, *t))
    assert sorted(map(tuple, graph.ball_sizes(edges, roots, 2, pass_roots=70).collect())) == whole and len(whole) == 400
    # No shuffle stays, nor do balls: each pass has its own, and leaves sums of blocks.
    assert all(clean for clean, _ in kept) and [c for _, c in kept].count(["node", "block", "mask"]) == gone.count(["node", "block", "mask"]) == 6
