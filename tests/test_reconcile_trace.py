import pytest

from trestle.operators import reconcile

CLAIM = "k string, ord int, parameter string, rule_type string, lo double, hi double, allowed string, jurisdiction string, priority int, authority string, citation string, conditions array<struct<type:string,value:string>>"
CASE = "k string, parameter string, context map<string,string>, value double"


def result(spark, claims, cases=()):
    c = spark.createDataFrame([("k", i, *x) for i, x in enumerate(claims)], CLAIM)
    found = reconcile.adjudicated(c, spark.createDataFrame([("k", *x) for x in cases], CASE), ["k"])
    return found.first(), [r.text for r in reconcile.trace(found, ["k"]).orderBy("place").collect()]


def pairs(array):
    return [(x.a, x.b, x.principle) for x in array]


def test_a_state_rule_overrides_a_federal_one(spark):
    claims = [("lane_width", "range", 12.0, 12.0, None, "Federal", None, "AASHTO", "GB", None), ("lane_width", "min", 11.0, None, None, "state", None, "state_DOT", "DM", [("terrain", "Rolling")]), ("grade", "max", None, 7.0, None, None, None, None, None, None)]
    r, lines = result(spark, claims, [(None, {"terrain": "rolling"}, 11.5)])
    assert r.parameter == "lane_width" and [a.id for a in r.args] == ["A1", "A2"]
    assert pairs(r.defeats) == [("A2", "A1", "jurisdiction")] and r.unresolved == [] and [a.id for a in r.governing] == ["A2"]
    assert (r.lo, r.hi, r.verdict) == (11.0, None, True)
    assert lines == [
        "terrain=rolling", "A1 (federal 100, AASHTO 0.95): lane_width in [12, 12] [GB]", "A2 (state 50, state_DOT 0.7): lane_width >= 11 [DM]; applies: terrain=Rolling", "A1 and A2 differ in their lower bound", "A2 defeats A1 by jurisdiction",
        "A2 (lane_width >= 11)", "lane_width in [11, +inf]", "lane_width = 11.5 complies; overridden: A1",
    ]
    r, lines = result(spark, claims)
    assert [a.applicable for a in r.args] == [True, False] and (r.lo, r.hi, r.verdict) == (12.0, 12.0, None)
    assert lines[2].endswith("doesn't apply: terrain=Rolling isn't established") and "nothing conflicts" in lines


def test_who_is_defeated_defeats_nobody(spark):
    """The first beats the second, which would have beaten the third: the third is reinstated."""
    claims = [("p", "range", 1.0, None, None, "project", None, None, None, None), ("p", "range", 2.0, 9.0, None, "state", None, None, None, None), ("p", "range", None, 7.0, None, None, None, None, None, None)]
    r, _ = result(spark, claims)
    assert pairs(r.conflicts) == [("A1", "A2", "jurisdiction"), ("A2", "A3", "jurisdiction")] and pairs(r.defeats) == [("A1", "A2", "jurisdiction")] and [a.id for a in r.governing] == ["A1", "A3"] and (r.lo, r.hi) == (1.0, 7.0)


def test_principles_in_order_and_ties(spark):
    on = [("t", "v")]
    claims = [("p", "max", None, 5.0, None, "state", 100, "county", "", None), ("p", "max", None, 6.0, None, None, None, "HCM", "", None), ("p", "max", None, 7.0, None, None, None, "HCM", "", None), ("p", "max", None, 8.0, None, None, None, "derived", "", on)]
    r, lines = result(spark, claims, [("p", {"t": "V"}, None)])
    assert pairs(r.defeats) == [("A4", "A1", "specificity"), ("A4", "A2", "specificity"), ("A4", "A3", "specificity")] and pairs(r.unresolved) == [("A2", "A3", None)] and r.hi == 8.0
    r, lines = result(spark, claims)
    assert pairs(r.defeats) == [("A2", "A1", "provenance"), ("A3", "A1", "provenance")] and [a.id for a in r.governing] == ["A2", "A3"] and r.hi == 6.0
    assert "A2 and A3 can't be told apart; both hold" in lines


def test_sets_of_values(spark):
    claims = [("p", "enum", None, None, "a, b,", None, None, None, None, None), ("p", "enum", None, None, "b,a,a", "state", None, None, None, None), ("p", "enum", None, None, "3.0", "local", None, None, None, None), ("p", "range", None, None, "z", None, None, None, None, None)]
    r, lines = result(spark, claims, [("p", None, 3.0)])
    assert pairs(r.defeats) == [("A3", "A1", "jurisdiction"), ("A3", "A2", "jurisdiction")] and r.verdict and {x.aspect for x in r.conflicts} == {"allowed values", "verdict"}
    assert "p in {a, b}" in lines[1] and lines[-1] == "p = 3 complies; overridden: A1, A2"


@pytest.mark.parametrize("conditions", [[("t", "v")], [("u", "w"), ("t", "v")]])
def test_nothing_applies(spark, conditions):
    r, lines = result(spark, [(None, "min", 1.0, None, None, None, None, None, None, conditions)], [(None, {"t": "other"}, 2.0)])
    assert r.governing == [] and r.verdict is None and r.lo is None and lines[-1] == "none" and r.parameter == ""


def test_arrays_of_values_and_no_claims(spark):
    array = CLAIM.replace("allowed string", "allowed array<string>")
    c = spark.createDataFrame([("k", 0, "p", "enum", None, None, ["x", "y"], None, None, None, None, None)], array)
    cases = spark.createDataFrame([], CASE)
    assert reconcile.adjudicated(c, cases, ["k"]).first().args[0].allowed == ["x", "y"]
    assert reconcile.trace(reconcile.adjudicated(c.limit(0), cases, ["k"]), ["k"]).collect() == []
