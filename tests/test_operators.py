import json

import pytest
from pyspark.sql import functions as F

from trestle.operators import acquire, checks, clarify, closure, context, extract, freeway, graph, metrics, reconcile, search
from trestle.sources import roadxml, rules

EDGES = "src string, dst string, type string, source string, ord long, description string"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "AFFECTS", "HCM", 0, ""), ("a", "c", "AFFECTS", "state_DOT", 1, ""), ("b", "d", "AFFECTS", None, 2, ""), ("c", "d", "AFFECTS", "HCM", 3, ""), ("d", "a", "AFFECTS", "HCM", 4, ""), ("d", "e", "DETERMINES", "AASHTO", 5, "")]
    return spark.createDataFrame(rows, EDGES)


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def test_chains(spark, edges):
    got = {r.node: (r.depth, r.path, round(r.confidence, 6)) for r in graph.chain(edges, roots(spark, "a")).collect()}
    assert got == {"b": (1, ["a -> b"], 1.0), "c": (1, ["a -> c"], 0.7), "d": (2, ["a -> b", "b -> d"], 0.5)}
    back = {r.node: (r.depth, r.path) for r in graph.chain(edges, roots(spark, "e"), types=graph.CAUSAL, backward=True).collect()}
    assert back["d"] == (1, ["d -> e"]) and back["b"] == (2, ["b -> d", "d -> e"]) and back["a"] == (3, ["a -> b", "b -> d", "d -> e"])
    assert graph.chain(edges, roots(spark, "zz")).count() == 0
    assert {r.confidence for r in graph.chain(edges, roots(spark, "a"), weighted=False).collect()} == {1.0}
    assert graph.chain(edges, roots(spark, "a"), depth=1).count() == 2


def test_neighbourhoods(spark, edges):
    assert {r.node for r in graph.neighbours(edges, roots(spark, "e"), 2).collect()} == {"d", "a", "b", "c"}
    one = graph.within_hops(edges, roots(spark, "e"), 1).collect()
    assert [(r.node, r.type) for r in one] == [("d", "DETERMINES")]
    chosen = spark.createDataFrame([("a",), ("d",)], "node string")
    assert {r.node for r in graph.suggestions(edges, chosen).collect()} == {"b", "c", "e"}
    bounds, site = spark.createDataFrame([("a", 1)], "param string, x int"), spark.createDataFrame([], "node string")
    chained = graph.chain(edges.where("dst <> 'a'"), roots(spark, "e"), types=graph.CAUSAL, backward=True)
    assert [r.node for r in graph.exogenous(chained, edges.where("dst <> 'a'"), bounds, site).collect()] == ["a"]


def test_bounds_and_nan(spark):
    rows = [("lane_width", v) for v in (8.9, 9.0, 12.0, 12.1, float("nan"), None)] + [("spl", 25.0), ("spl", 25.1), ("grade", 9.0), ("hor_class", 6.0), ("unknown", 1.0)]
    got = checks.checked(spark.createDataFrame(rows, "param string, value double"), rules.rules(spark)).where("rule_type <> 'relationship'").collect()
    assert {(r.param, str(r.value), r.broken) for r in got if r.broken} == {("lane_width", "8.9", "below"), ("lane_width", "12.1", "above"), ("spl", "25.0", "below"), ("grade", "9.0", "above"), ("hor_class", "6.0", "not allowed")}


def test_least_radius(spark):
    speeds = [14.9, 15.0, 17.5, 20.0, 52.0, 80.0, 80.1, None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in speeds], "s double").select(checks.least_radius(F.col("s"))).collect()]
    assert got == [None, 50.0, 70.0, 90.0, 760.0, 1810.0, None, None]


def test_coverage(spark):
    d = spark.createDataFrame([(11.0, 3.0), (None, 3.0), (None, None)], "lane_width double, apd double")
    n = d.select(checks.coverage(F.size(checks.semantic({"lane_width"})), checks.supplied(d.columns)))
    assert [r[0] for r in n.collect()] == ["partial", "none", "none"]


def test_contexts(spark):
    rows = [({"terrain": "Level"}, [("terrain", "level")]), ({"terrain": "rolling"}, [("terrain", "level"), ("city", "x")]), ({}, [("terrain", "level")]), ({}, [])]
    d = spark.createDataFrame(rows, "c map<string,string>, k array<struct<type:string,value:string>>")
    got = d.select(context.tri_state(F.col("c"), F.col("k")), context.strict_match(F.col("c"), F.col("k")), context.lenient_match(F.col("c"), F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("applicable", True, True), ("mismatched", False, False), ("undecidable", False, True), ("applicable", True, True)]


def test_unit_conflicts(spark):
    d = spark.createDataFrame([(3.5, "ft"), (11.0, "ft"), (1.0, "ft"), (3.5, "kg")], "v double, u string")
    assert [r[0] for r in d.select(clarify.unit_conflict(F.col("v"), F.col("u"), F.lit(9.0), F.lit(12.0))).collect()] == [True, False, False, False]


CLAIM = "k string, ord long, lo double, hi double, allowed array<string>, ok boolean, jurisdiction string, priority int, specificity int, authority string"


def test_reconciliation(spark):
    rows = [
        ("jurisdiction", 0, 10.0, None, None, True, "federal", None, 0, "AASHTO"), ("jurisdiction", 1, 12.0, None, None, False, "state", None, 0, "state_DOT"),
        ("specificity", 0, None, 5.0, None, False, "federal", None, 0, "HCM"), ("specificity", 1, None, 8.0, None, True, "federal", None, 1, "HCM"),
        ("provenance", 0, 60.0, None, None, True, None, None, 0, "HCM"), ("provenance", 1, 65.0, None, None, False, None, None, 0, "county"),
        ("tie", 0, 10.0, None, None, True, None, None, 0, "HCM"), ("tie", 1, 12.0, None, None, False, None, None, 0, "HCM"),
        # the middle claim is defeated by the first, so the last one, which it would defeat, is reinstated
        ("reinstated", 0, 1.0, None, None, True, "project", None, 0, "HCM"), ("reinstated", 1, 2.0, 9.0, None, True, "state", None, 0, "HCM"), ("reinstated", 2, None, 7.0, None, True, "federal", None, 0, "HCM"),
    ]
    claims = spark.createDataFrame(rows, CLAIM)
    got = {r.k: (r.survivors, r.lo, r.hi, r.verdict, r.unresolved) for r in reconcile.reconciled(claims, ["k"]).collect()}
    assert got == {"jurisdiction": (1, 12.0, None, False, False), "specificity": (1, None, 8.0, True, False), "provenance": (1, 60.0, None, True, False), "tie": (2, 12.0, None, False, True), "reinstated": (2, 1.0, 7.0, True, False)}
    won = {(r.k, r.winner, r.loser, r.principle) for r in reconcile.defeats(claims, ["k"]).collect()}
    assert won == {("jurisdiction", 1, 0, "jurisdiction"), ("specificity", 1, 0, "specificity"), ("provenance", 0, 1, "provenance"), ("reinstated", 0, 1, "jurisdiction")}


def test_closure(spark):
    d = closure.closed(spark.createDataFrame([(0,), (5,), (9,)], "hor_class int"), ["speed_limit", "bffs", "lane_width", "x"], closure.table_proposers()).collect()
    assert [(r.speed_limit, r.bffs, r.lane_width, r.lane_width_state, r.x_state) for r in d] == [(70.0, 75.0, None, "rejected", "no_proposal"), (45.0, 50.0, None, "rejected", "no_proposal"), (None, None, None, "rejected", "no_proposal")]


def test_repairs(spark):
    d = spark.createDataFrame([(1, 4.0, 6.0), (2, 1.0, 1.0)], "id int, a double, b double")
    run, goal, levers = search.linear({"a": 2.0, "b": 1.0}), F.col("y") <= 10, {"a": (0.0, 5.0), "b": (0.0, 8.0)}
    got = {r.lever: (r.trial, r["rank"]) for r in search.single_repairs(d, ["id"], levers, run, goal, steps=6).collect()}
    assert got == {"a": (2.0, 3), "b": (1.6, 5)}
    assert search.single_repairs(d, ["id"], levers, run, goal, steps=6, budget=2).count() == 0
    assert search.pair_repairs(d, ["id"], levers, run, F.col("y") <= 0.5, steps=2).count() == 2
    designs = search.inverse_designs(spark.createDataFrame([(1, 3.0)], "id int, s double"), ["id"], {"a": (0.0, 1.0), "apd": (0.0, 2.0)}, search.linear({"a": 1.0, "apd": 1.0, "s": 1.0}), F.col("y") >= 5, steps=3, most=8).collect()
    assert [(r.a, r.apd, r.cost, r.place, r.truncated) for r in designs] == [(0.0, 2.0, 0.0, 1, True), (0.5, 2.0, 0.5, 2, True), (1.0, 1.0, 1.5, 3, True)]


def test_freeway(spark):
    d = spark.createDataFrame([(70.0, 10.0, 4.0, 1.0, 2.0, 3500.0, 0.95, 0.107, "level")], "bffs double, lw double, lc_r double, trd double, lane_count double, demand_flow_i double, phf double, p_t double, terrain string")
    r = freeway.evaluated(d).first()
    assert r.ffs == pytest.approx(70 - 6.6 - 1.2 - 3.22) and r.capacity == pytest.approx(2200 + 10 * (r.ffs - 50)) and 35 < r.density < 45 and r.los == "E"
    assert search.los_at_most("D") is not None


def test_text(spark):
    t = "Lane width: 11 ft, 4 ft shoulders, posted speed: 55 mph, 3.0% grade, radius: 1200 ft, superelevation 4%, volume: 1,850 veh/h on rolling terrain"
    d = spark.createDataFrame([(1, t), (2, "lane"), (3, None), (4, "nothing of the kind is said here")], "id int, t string")
    got = {r.param: r.value for r in extract.text_parameters(d, ["id"], "t").collect()}
    assert {k: got[k] for k in ("lane_width", "shoulder_width", "speed_limit", "grade", "design_radius", "volume")} == {"lane_width": 11.0, "shoulder_width": 4.0, "speed_limit": 55.0, "grade": 3.0, "design_radius": 1200.0, "volume": 1850.0}
    assert d.select(*(c.alias(k) for k, c in extract.text_context(F.col("t")).items())).first().terrain_type == "rolling"


def test_road_xml(spark):
    bad = '<road id="9" length="1"><planView><geometry s="0" length="x"><arc curvature="0.01"/></geometry><geometry length="2"><line/></geometry></planView></road>'
    d = spark.createDataFrame([(1, bad), (2, "<road"), (3, None)], "id int, xml string")
    g = roadxml.geometries(roadxml.road_strings(d, "xml", ["id"]), ["id"]).collect()
    assert [(r.kind, r.error, None if r.radius_ft is None else round(r.radius_ft, 2)) for r in g] == [("arc", True, 328.08), ("line", False, None)]


def test_road_files(spark, tmp_path):
    xml = spark.range(3).select(roadxml.road_xml(F.col("id"), F.lit(100), F.lit(0.001), [F.lit(11.0)], F.lit(0.02)).alias("x")).collect()
    (tmp_path / "map.xml").write_text("<OpenDRIVE>" + "".join(r.x for r in xml) + "</OpenDRIVE>")
    rows = roadxml.parameter_rows(roadxml.road_files(spark, str(tmp_path)), ["_id"]).collect()
    assert len(rows) == 9 and {r.param: round(r.value, 3) for r in rows} == {"design_rad": 1000.0, "lane_width": 11.0, "grade": 2.0}


def test_code(spark):
    code = "impl X { fn a(&mut self) -> f64 { self.ffs = self.spl + self.h(); if x { } 1.0 } fn h(&self) { self.lw } }"
    f = acquire.functions_of(spark.createDataFrame([(1, code), (2, None)], "id int, c string"), ["id"], "c")
    flow = {r.name: (r.reads, r.writes) for r in acquire.dataflow(f, ["id"], ["ffs", "spl", "lw"]).collect()}
    assert flow == {"a": (["lw", "spl"], ["ffs"]), "h": (["lw"], [])}
    assert {(r.src, r.dst) for r in acquire.induced_edges(acquire.dataflow(f, ["id"], ["ffs", "spl", "lw"])).collect()} == {("spl", "ffs"), ("lw", "ffs")}


def test_windows_of_text(spark):
    d = spark.createDataFrame([(1, "x" * 25), (2, "  ab "), (3, None)], "id int, t string")
    assert [(r.id, r.place, len(r.piece)) for r in acquire.windows(d, ["id"], "t", 10, 2).collect()] == [(1, 0, 10), (1, 1, 10), (1, 2, 9), (1, 3, 1), (2, 0, 2)]


def test_order_statistics_with_extremes_and_ties(spark):
    values = [1e18, -1e18, *[7.0] * 500, *(i / 7 for i in range(1000)), 0.0]
    got = metrics.order_statistics(spark.createDataFrame([("a", v) for v in values] + [("a", None), ("none", None)], "k string, v double"), ["k"], "v").collect()
    v = sorted(values)
    n = len(v)
    assert [(r.k, r.n, r.median, r.p95) for r in got] == [("a", n, round((v[(n - 1) // 2] + v[n // 2]) / 2, 6), round(v[min(n - 1, int(n * 0.95))], 6))]


def test_order_statistics(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 5.0), ("c", None)], "k string, v double")
    assert {r.k: (r.n, r.mean, r.median, r.p95) for r in metrics.order_statistics(d, ["k"], "v").collect()} == {"a": (100, 49.5, 49.5, 95.0), "b": (1, 5.0, 5.0, 5.0)}


def test_corpora(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"facility_type": "F", "parameters": [{"name": "Width", "rust_field": "lw", "typical_min": 9, "typical_max": 12, "aliases": ["lane"]}, {"name": "lane", "rust_field": "other"}]}))
    (tmp_path / "c.json").write_text("[1, 2")
    p = rules.parameter_corpus(spark, str(tmp_path))
    assert {r.key: r.rust_field for r in rules.parameter_keys(p).collect()} == {"lw": "lw", "width": "lw", "lane": "lw", "other": "other"}
    assert [tuple(r) for r in rules.parameter_bounds(p, "F").collect()] == [("lw", 9.0, 12.0)]
    r = tmp_path / "r"
    r.mkdir()
    (r / "a.json").write_text(json.dumps({"source_doc": {"abbreviation": "M"}, "rules": [{"name": "x", "rule_type": "range", "allowed_values": " a, b ,", "source_ref": {"chapter": "3"}}, {"name": "y"}]}))
    got = rules.rule_corpus(spark, str(r)).collect()
    assert [(x.rule_id, x.name, x.citation, x.allowed) for x in got] == [(1, "x", "M, Chapter 3", ["a", "b"]), (2, "y", "M", [])]
    e = tmp_path / "e"
    e.mkdir()
    (e / "e.json").write_text(json.dumps({"relationships": [{"from_field": "a", "to_field": "b", "type": "AFFECTS"}]}))
    assert [(x.ord, x.from_field) for x in rules.edge_corpus(spark, str(e)).collect()] == [(0, "a")]
    (e / "e.json").write_text(json.dumps({"claims": [{"name": "n", "min_value": 1}], "default_context": {"k": "v"}}))
    assert [(x.scenario, x.claims[0].min_value) for x in rules.conflict_scenarios(spark, str(e)).collect()] == [("e", 1.0)]
    assert rules.conflict_scenarios(spark, str(tmp_path / "nowhere")).count() == 0


def test_stream_of_bursts(spark, tmp_path):
    from trestle.streaming.debounce import sessions

    rows = [("m", f"2024-01-01 00:00:{s:02d}") for s in (0, 4, 9, 20)] + [("m", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "model string, ts string").select("model", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("model string, ts timestamp").parquet(str(tmp_path / "in"))
    q = sessions(stream, ["model"], late="1 second").writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.changes for r in spark.table("bursts").collect()) == [1, 3]
