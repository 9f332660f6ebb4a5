from pyspark.sql import functions as F

from trestle.plans import engine

RULES = "field string, rule_id int, rule_type string, severity string, lo double, hi double, lo_open boolean, hi_open boolean, allowed array<string>, citation string, conditions array<struct<type:string,value:string>>"


def test_validation(spark):
    params = spark.createDataFrame(
        [(1, "Lane Width", 8.0, None), (1, "grade", 7.0, None), (1, "segment_0_grade", 99.0, None), (2, "lane", 11.0, None), (2, "odd", 1.0, None), (2, "grade", 7.0, None), (3, "grade", 7.0, None), (4, "lane", 3.5, None), (5, "kind", None, "C")],
        "record int, param string, value_num double, value_str string",
    )
    keys = spark.createDataFrame([("lane width", "lw"), ("lane", "lw"), ("grade", "grade"), ("kind", "kind")], "key string, field string")
    rules = spark.createDataFrame(
        [
            ("lw", 1, "range", "error", 9.0, 12.0, False, False, None, "M", []), ("grade", 2, "max", "warning", None, 6.0, False, False, None, "M", [("terrain", "level")]),
            ("grade", 3, "max", "error", None, 6.5, False, False, None, "N", [("terrain", "level"), ("city", "urban")]), ("kind", 4, "enum", "error", None, None, False, False, ["A", "B"], None, None),
        ], RULES,
    )
    contexts = spark.createDataFrame([(1, {"terrain": "Level", "city": "urban"}), (2, {"terrain": "rolling"})], "record int, context map<string,string>")
    units = spark.createDataFrame([("lw", "ft", 9.0, 12.0)], "field string, unit string, typical_min double, typical_max double")
    verdicts, asks = engine.validate(params, contexts, keys, rules, units)
    got = {r.record: (r.errors, r.warnings, r.unknown, r.is_valid, [v.rule_id for v in r.violations]) for r in verdicts.collect()}
    assert got == {1: (2, 1, 0, False, [1, 2, 3]), 2: (0, 0, 1, True, []), 3: (0, 0, 0, True, []), 4: (1, 0, 0, False, [1]), 5: (1, 0, 0, False, [4])}
    assert {(r.record, r.kind, r.parameter, ",".join(r.options), *r.related) for r in asks.collect()} == {(3, "ambiguous_context", "terrain", "level", "grade"), (3, "ambiguous_context", "city", "urban", "grade"), (4, "unit_conflict", "lw", "")}
    strict, _ = engine.validate(params.where("param = 'grade'"), contexts, keys, rules.where("rule_id = 2"), strict=True)
    assert {r.record: r.is_valid for r in strict.collect()} == {1: False, 2: True, 3: True}


def test_formula_rules(spark):
    params = spark.createDataFrame([(1, "radius", 500.0), (1, "Speed", 60.0), (2, "radius", 2000.0), (2, "Speed", 60.0), (3, "radius", 100.0), (4, "radius", -1.0), (4, "Speed", 50.0)], "record int, param string, value_num double").selectExpr("*", "CAST(NULL AS STRING) AS value_str")
    keys = spark.createDataFrame([("radius", "design_rad"), ("speed", "spl")], "key string, field string")
    rows = [("design_rad", 1, "design_rad >= spl ** 2 / 3", None), ("design_rad", 2, "sqrt(design_rad) > 0", None), ("design_rad", 3, "this is (no formula", None), ("design_rad", 4, "design_rad < 0 implies spl < 10", [("terrain", "level")])]
    rules = spark.createDataFrame([(f, i, "formula", "error", None, None, None, None, None, None, c, t) for f, i, t, c in rows], RULES + ", formula string")
    contexts = spark.createDataFrame([(i, {"terrain": "level"}) for i in (1, 3, 4)], "record int, context map<string,string>")
    verdicts, asks = engine.validate(params, contexts, keys, rules)
    assert {r.record: [v.rule_id for v in r.violations] for r in verdicts.collect()} == {1: [1], 2: [], 3: [], 4: [1, 4]}
    assert {(r.record, r.kind, r.parameter) for r in asks.collect()} == {(2, "ambiguous_context", "terrain"), (3, "missing_parameter", "spl")}


def test_priorities(spark):
    rules = spark.createDataFrame([(1, [("federal", 100)]), (2, [("state", 50), ("federal", 100)]), (3, [("Local", 60)]), (4, [])], "rule_id int, sources array<struct<jurisdiction:string,priority:int>>")
    assert [(r.rule_id, r.prio) for r in engine.prioritized(rules).collect()] == [(2, 50), (3, 60), (1, 100), (4, 100)]
    assert [(r.rule_id, r.prio) for r in engine.prioritized(rules, F.lit("local")).collect()] == [(3, 10), (2, 50), (1, 100), (4, 100)]


def test_detections_and_sinks(spark):
    d = spark.createDataFrame([(0.9, "solid", 0.0, 60.0), (0.2, "zigzag", 0.01, 60.0)], "confidence double, marking string, curvature_per_ft double, speed double")
    assert [r.problems for r in engine.detections(d, ["solid", "dashed"]).collect()] == [[], ["low confidence", "unknown marking", "too tight"]]
    nodes, edges = spark.createDataFrame([("a", "P")], "id string, label string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [tuple(r) for r in engine.graph_json(nodes, edges).collect()] == [("node", '{"id":"a","label":"P"}'), ("edge", '{"src":"a","dst":"b"}')]
    m = spark.createDataFrame([(0.41, 0.7, 0.2), (0.4, 0.4, 0.5)], "f1 double, numeric_recall double, definitional_recall double")
    assert tuple(engine.robustness(m).first()) == (2, 0.4, 0.41, 1)
