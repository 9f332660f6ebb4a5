"""Gold edges by labels, agreement by tier, and what basis is claimed."""

import json

from trestle.operators import acquire
from trestle.sources import rules

RELATED = "from_field string, to_field string, type string, facility_type string, description string, ord long"
LABELS = "src string, dst string, tier string, out_of_corpus boolean"


def test_labels_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tiers": {"a->b": "numeric", "b -> c": "odd"}, "out_of_corpus": {"a->b": "elsewhere", "x->y": "nowhere"}}))
    (tmp_path / "b.json").write_text(json.dumps({"description": "none"}))
    got = {tuple(r) for r in rules.tier_labels(spark, str(tmp_path)).collect()}
    assert got == {("a", "b", "numeric", True), ("b", "c", "odd", False), ("x", "y", None, True)}


def test_gold(spark):
    rel = [
        ("a", "b", "AFFECTS", "F", "in Eq. 1", 0), ("a", "b", "AFFECTS", "F", "in prose", 1), ("b", "c", "DETERMINES", "F", "threshold", 2), ("c", "d", "RELATED_TO", "F", "", 3),
        ("x", "y", "AFFECTS", "F", "", 4), ("p", "q", "CONSTRAINS", "G", None, 5), ("r", "s", "AFFECTS", None, "", 6),
    ]
    e = spark.createDataFrame(rel, RELATED)
    labels = spark.createDataFrame([("x", "y", "numeric", True), ("b", "c", "definitional", False), ("p", "q", "odd", None)], LABELS)
    assert {tuple(r) for r in acquire.gold_edges(e, labels, "F").collect()} == {("a", "b", "definitional"), ("b", "c", "definitional")}
    assert {(r.src, r.tier) for r in acquire.gold_edges(e, labels).collect()} == {("a", "definitional"), ("b", "definitional"), ("p", "definitional"), ("r", "definitional")}


def test_agreement_and_basis(spark):
    gold = spark.createDataFrame([("a", "b", "numeric"), ("b", "c", "definitional"), ("c", "d", "numeric")], "src string, dst string, tier string")
    found = spark.createDataFrame([("a", "b", "numeric", 1), ("a", "b", "", 2), ("b", "c", "numeric", 3), ("z", "z", None, 4)], "src string, dst string, basis string, ord int")
    rows = {r.tier: tuple(r)[1:] for r in acquire.tier_agreement(found, gold).collect()}
    assert rows["all"] == (3, 3, 2, 2 / 3, 2 / 3, 2 / 3)
    assert rows["definitional"] == (None, 1, 1, None, 1.0, None) and rows["numeric"] == (None, 2, 1, None, 0.5, None)
    assert {tuple(r) for r in acquire.basis_confusion(found, gold).collect()} == {("numeric", "unstated", 1), ("definitional", "numeric", 1)}
    none, empty = found.where("false"), gold.where("false")
    assert {r.tier: (r.found, r.gold, r.precision, r.recall, r.f1) for r in acquire.tier_agreement(none, gold).collect()}["all"] == (0, 3, None, 0.0, 0.0)
    assert {r.tier: (r.gold, r.recall, r.f1) for r in acquire.tier_agreement(found, empty).collect()} == {"all": (0, None, None), "definitional": (0, None, None), "numeric": (0, None, None)}
    assert acquire.basis_confusion(none, gold).count() == 0
