import json

import pytest
from pyspark.sql import functions as F

from trestle.operators import clarify, records
from trestle.plans import engine


def told(rows, *columns):
    return {tuple(r[c] for c in columns) for r in rows.collect()}


RECORD = {
    "lane_width": 11, "grade": "7", "phf": True, "apd": None, "lw": [1], "odd": 1, "terrain_type": "level", "city_type": {"x": 1},
    "segments": [{"grade": 3, "spl": "55", "odd": 2, "shoulder_width": False}, 7, {"length": 0.5, "ffs": None, "volume": [1], "subsegments": [{"length": 1}]}, "x", None],
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(1, json.dumps(RECORD)), (2, '{"lane_width": '), (3, None), (4, "[1]"), (5, '"lane_width"'), (6, '{"grade": 1, "grade": 2}'), (7, "{}"), (8, '{"segments": {"grade": 1}, "grade": -0.5}'), (9, '{"segments": []}')]
    return spark.createDataFrame(rows, "id int, j string")


def test_generic_records(raw):
    got = told(records.json_parameters(raw, ["id"], "j"), "id", "param", "name", "value_num", "value_str", "unit")
    assert got == {
        (1, "lane_width", "Lane Width", 11.0, None, "ft"), (1, "grade", "Grade", None, "7", None), (1, "phf", "Peak Hour Factor", 1.0, "True", None), (1, "terrain_type", "Terrain Type", None, "level", None),
        (1, "segment_0_grade", "Grade", 3.0, None, "%"), (1, "segment_0_spl", "Speed Limit", None, "55", "mph"), (1, "segment_0_shoulder_width", "Shoulder Width", 0.0, "False", "ft"),
        (1, "segment_2_length", "Length", 0.5, None, "mi"), (8, "grade", "Grade", -0.5, None, "%"),
    }
    assert ("odd", 1.0) in told(records.json_parameters(raw, ["id"], "j", known=None), "param", "value_num")
    assert records.json_parameters(raw.limit(0), ["id"], "j").collect() == []


def test_extraction_is_one_pass(raw):
    plan = records.json_parameters(raw, ["id"], "j")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


FREEWAY = {"bffs": 70.5, "lc_r": 6, "lc_l": 4, "trd": 1, "los": "C", "city_type": {"Urban": {}, "Rural": {}}, "terrain_type": "level", "apd": None, "lane_width": 12}
TWO_LANE = {
    "lane_width": 12, "bffs": 1, "city_type": "rural", "segments": [
        {"passing_type": 2, "hor_class": 3, "is_hc": True, "length": 1.5, "subsegments": [{"length": 100, "design_rad": 900.5, "grade": 1}, {}, 5, {"sup_ele": "x"}]}, {"grade": 2, "passing_type": None},
    ],
}


def test_structs(spark):
    d = spark.createDataFrame([(1, json.dumps(FREEWAY)), (2, json.dumps(TWO_LANE)), (3, '{"segments": [{"grade": 1}]}'), (4, '{"bffs": 1, "lc_r": 1, "lc_l": 1, "trd": null}'), (5, None)], "id int, j string")
    got = told(records.struct_parameters(d, ["id"], "j"), "id", "param", "name", "value_num", "value_str", "unit")
    assert {x for x in got if x[0] == 1} == {
        (1, "bffs", "Base Free Flow Speed", 70.5, None, "mph"), (1, "lc_r", "Right Lateral Clearance", 6.0, None, "ft"), (1, "lc_l", "Left Lateral Clearance", 4.0, None, "ft"), (1, "trd", "Total Ramp Density", 1.0, None, "ramps/mi"),
        (1, "los", "Level of Service", None, "C", None), (1, "terrain_type", "Terrain Type", None, "level", None), (1, "city_type", "City Type", None, '{"Rural":{},"Urban":{}}', None),
    }
    assert {x[1:] for x in got if x[0] == 2} == {
        ("lane_width", "Lane Width", 12.0, None, "ft"), ("segment_0_passing_type", "Passing Type", 2.0, None, None), ("segment_0_hor_class", "Horizontal Class", 3.0, None, None), ("segment_0_is_hc", "Has Horizontal Class", 1.0, "True", None),
        ("segment_0_length", "Segment Length", 1.5, None, "mi"), ("segment_0_subsegments_0_length", "Subsegment Length", 100.0, None, "ft"), ("segment_0_subsegments_0_design_rad", "Design Radius", 900.5, None, "ft"),
        ("segment_0_subsegments_3_sup_ele", "Superelevation", None, "x", "%"), ("segment_1_grade", "Grade", 2.0, None, "%"),
    }
    assert {x[1] for x in got if x[0] == 4} == {"bffs", "lc_r", "lc_l"} and not {x for x in got if x[0] in (3, 5)}
    v = d.select("id", records.parsed("j").alias("v")).select("id", records.struct_like("v").alias("like"), records.facility("v").alias("f"), records.struct_context("v").alias("c"))
    assert {r.id: (r.like, r.f, r.c) for r in v.collect()} == {
        1: (True, "BasicFreeway", {"facility_type": "BasicFreeway", "city_type": "Rural", "terrain_type": "level"}), 2: (True, "TwoLaneHighway", {"facility_type": "TwoLaneHighway", "city_type": "rural", "passing_type": "2", "horizontal_class": "3"}),
        3: (False, None, {}), 4: (True, "BasicFreeway", {"facility_type": "BasicFreeway"}), 5: (False, None, {}),
    }


def test_any_record(spark):
    text = "Lane width: 11 ft in a rural area, and so on"
    rows = [(1, json.dumps(FREEWAY), None), (2, json.dumps(FREEWAY), "json"), (3, text, None), (4, '{"x": 1}', None), (5, "short", None), (6, None, None), (7, text, "xml"), (8, '{"grade": 1}', "struct"), (9, '{"grade": 1, "jurisdiction": "state"}', None)]
    d = spark.createDataFrame(rows, "id int, raw string, given string")
    params, contexts, errors = records.extracted(d, ["id"], "raw", "given")
    assert {r.id: r.source for r in contexts.collect()} == {1: "struct", 2: "json", 3: "text", 4: "json", 8: "struct", 9: "json"}
    assert told(errors, "id", "error") == {(5, "no reader knows the record"), (6, "no reader knows the record"), (7, "there is no such reader"), (8, "a struct of no known facility")}
    assert {x for x in told(params, "id", "param") if x[0] > 2} == {(3, "lane_width"), (9, "grade"), (9, "jurisdiction")}
    assert {r.id: r.context for r in contexts.collect()}[9] == {"jurisdiction": "state"}
    own = {"xml": (lambda rows, keys, raw: rows.selectExpr(*keys, "'p' AS param", "'P' AS name", "1D AS value_num", "CAST(NULL AS STRING) AS value_str", "CAST(NULL AS STRING) AS unit"), lambda raw, v: records._map({}))}
    params, _, errors = records.extracted(d, ["id"], "raw", "given", records.READERS | own)
    assert (7, "p") in told(params, "id", "param") and 7 not in {r.id for r in errors.collect()}


def test_records_are_validated(spark):
    """From raw records to verdicts: the readers' rows are the validation's."""
    d = spark.createDataFrame([(1, json.dumps({"lane_width": 8, "grade": 3, "terrain_type": "level"})), (2, json.dumps(TWO_LANE | {"lane_width": 11}))], "record int, raw string")
    params, contexts, _ = records.extracted(d, ["record"], "raw")
    keys = spark.createDataFrame([("lane_width", "lane_width"), ("grade", "grade")], "key string, field string")
    rules = spark.createDataFrame([("lane_width", 1, "range", "error", 9.0, 12.0, False, False, None, "M", [("terrain_type", "level")])], "field string, rule_id int, rule_type string, severity string, lo double, hi double, lo_open boolean, hi_open boolean, allowed array<string>, citation string, conditions array<struct<type:string,value:string>>")
    verdicts, asks = engine.validate(params, contexts, keys, rules)
    assert told(verdicts, "record", "errors", "is_valid") == {(1, 1, False), (2, 0, True)}
    assert {(r.record, r.parameter, *r.options) for r in asks.collect()} == {(2, "terrain_type", "level")}


def test_questions_are_folded(spark):
    """Three rules that lack inputs, two of them several: one question for the single one, one for all others, as the earliest asks it."""
    u = spark.createDataFrame([(1, "a", 0, 7, "seven", ["z", "y"]), (1, "a", 0, 3, "three", ["x"]), (1, "b", 1, 2, "two", ["w", "y"]), (1, "b", 1, 9, "nine", ["x"]), (2, "b", 1, 9, "nine", [])], "r int, field string, place int, rule_id int, rule string, missing array<string>")
    c = spark.createDataFrame(
        [(1, "b", 1, 5, "five", [("t", "p"), ("u", "k")]), (1, "a", 0, 6, "six", [("t", "q")]), (1, "a", 0, 4, "four", [("t", "p")]), (3, "a", 0, 4, "four", [])], "r int, field string, place int, rule_id int, rule string, open array<struct<type:string,value:string>>"
    )
    got = clarify.questions(clarify.input_asks(u, ["r"]).unionByName(clarify.context_asks(c, ["r"])), ["r"]).collect()
    assert {(r.r, r.kind, r.parameter): (r.options, r.related) for r in got} == {
        (1, "missing_parameter", None): ([], ["w", "y", "z"]), (1, "missing_parameter", "x"): ([], ["x"]),
        (1, "ambiguous_context", "t"): (["p", "q"], ["a", "b"]), (1, "ambiguous_context", "u"): (["k"], ["b"]),
    }
    said = {(r.kind, r.parameter): r.message for r in got}
    assert said["missing_parameter", None].startswith("What is y, z? seven on a") and "four, six" in said["ambiguous_context", "t"]


def test_metric_values_are_asked_about(spark):
    d = spark.createDataFrame([(1, "lw", 3.5, "ft", 9.0, 12.0, 0), (1, "sw", 11.0, "ft", 9.0, 12.0, 1), (2, "lw", 8.0, "ft", 9.0, 12.0, 0), (3, "lw", None, "ft", 9.0, 12.0, 0), (4, "v", 88.5139, "mph", 25.0, 80.0, 0)], "r int, field string, value_num double, unit string, typical_min double, typical_max double, place int")
    assert told(clarify.unit_asks(d, ["r"]), "r", "parameter", "message") == {(1, "lw", "lw = 3.5 ft is outside of 9 to 12; are these meters (11.48 ft)?"), (4, "v", "v = 88.5139 mph is outside of 25 to 80; are these km/h (55.00 mph)?")}


def test_plain_numbers(spark):
    x = [0.0, 1.0, -2.5, 123456.0, 0.1, 1 / 3, 99999.96, 1e7, 2e-7, 100.0, 0.00125, None]
    got = spark.createDataFrame([(v,) for v in x], "v double").select(clarify.plain(F.col("v"))).collect()
    assert [r[0] for r in got] == ["0", "1", "-2.5", "123456", "0.1", "0.333333", "100000", "1e+07", "2e-07", "100", "0.00125", None]


def test_fixed_checks_by_number(spark):
    """The numbers of checks say what their texts say, on bounds, nulls and NaN; the code that counts them stays small enough to be compiled."""
    import re

    from trestle.operators import checks
    from trestle.sources.rules import RADIUS

    nan, inf = float("nan"), float("inf")
    values = [None, nan, inf, -inf, -0.5, 0.0, 0.5, 0.51, 1.0, 1.01, 3.0, 5.0, 8.0, 9.0, 12.0, 12.1, 15.0, 15.9, 47.3, 80.0, 80.9, 81.0, 100.0, 712.0, 2e9]
    names = ["lane_width", "shoulder_width", "hor_class", "passing_type", "grade", "phf", "phv", "spl", "vertical_class", "design_rad"]
    rows = [tuple(values[(7 * i + 3 * k * (i // 5 + 1)) % len(values)] for k in range(len(names))) for i in range(500)]
    d = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    found = checks.fixed_checks(names)
    wrong = [F.count_if(c.end != F.when(~c.there, 0).when(c.broken.isNull(), 1).when(c.broken == "above", 3).otherwise(2)) for c in found]
    assert len(found) == 10 and sum(d.agg(*(w.alias(f"w{i}") for i, w in enumerate(wrong))).first()) == 0
    whole = spark.range(0, 100).select(F.col("id").cast("double").alias("s"))
    assert whole.where(~checks.least_radius_whole(F.col("s")).eqNullSafe(checks.least_radius(F.col("s")))).count() == 0 and RADIUS[0][0] == 15
    tally = {(r.rule, r.broken): r.n for r in checks.semantic_tally(d, names).collect()}
    by_row = d.select(F.explode(checks.semantic(names)).alias("c")).groupBy("c.rule", "c.broken").count().collect()
    assert tally == {(r.rule, r.broken): r["count"] for r in by_row}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the code is made as the query runs
    try:
        text = checks.semantic_tally(d, names)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000
