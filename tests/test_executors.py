import numpy as np
import pytest
from pyspark.sql import functions as F

from trestle.operators import executors, search


def evaluate(x):
    """2 a + b where a is at most 3; an error where b is 13, and nothing below zero."""
    if (x["b"] == 13).any():
        raise ValueError("thirteen")
    y = np.where(x["a"] <= 3, 2 * x["a"] + x["b"], np.nan)
    return {"y": y, "grade": np.where(y < 5, "low", "high")}


MODEL = executors.Model(evaluate, ("a", "b"), ("y", "grade"), texts=("grade",))


def columns(df):
    ok = (F.col("a") <= 3) & (F.col("b") != 13) & ~F.isnan("b")
    y = F.when(ok, 2 * F.col("a") + F.col("b"))
    return df.withColumns({"y": y, "grade": F.when(y < 5, "low").when(y.isNotNull(), "high")})


@pytest.fixture(scope="module")
def designs(spark):
    rows = [(i, float(i % 7), float(i % 17), "x") for i in range(300)] + [(300, None, 1.0, "x"), (301, 1.0, None, "x"), (302, 1.0, float("nan"), "x")]
    return spark.createDataFrame(rows, "id int, a double, b double, y string").drop("y").repartition(3)


def test_what_is_off_the_domain_is_a_value(designs):
    got = {r.id: (r.y, r.grade, r.off_domain) for r in executors.batched(MODEL)(designs).collect()}
    want = {r.id: (r.y, r.grade) for r in columns(designs).collect()}
    assert {k: v[:2] for k, v in got.items()} == want
    assert got[300][2] == got[301][2] == got[302][2] == "an input is missing" and got[13] == (None, None, "ValueError: thirteen") and got[4] == (None, None, "no result") and got[1] == (3.0, "low", None)
    assert executors.batched(MODEL)(designs.limit(0)).collect() == []


def test_optional_inputs(spark):
    d = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 5.0)], "id int, v double, w double")
    m = executors.Model(lambda x: {"z": x["v"] + 10 * x["w"] + 100 * x["u"]}, ("v",), ("z",), {"w": "v", "u": 1.0})
    assert {r.id: r.z for r in executors.batched(m)(d).collect()} == {1: 122.0, 2: 153.0}


def test_repairs_by_a_model_are_those_by_columns(designs):
    goal, levers = F.col("y") <= 6, {"a": (0.0, 6.0), "b": (0.0, 16.0)}
    shown = lambda df: sorted(map(str, df.collect()))
    some = designs.where("id < 120")
    for budget in (None, 4):
        one, two = (search.single_repairs(some, ["id"], levers, run, goal, steps=5, budget=budget) for run in (executors.batched(MODEL), columns))
        assert shown(one) == shown(two) and one.count() > 10
    one, two = (search.pair_repairs(some, ["id"], levers, run, F.col("y") <= 0, steps=4) for run in (executors.batched(MODEL), columns))
    assert shown(one) == shown(two)


def test_inverse_designs_by_a_model_are_those_by_columns(spark):
    sites = spark.createDataFrame([(1,), (2,)], "id int")
    one, two = (search.inverse_designs(sites, ["id"], {"a": (0.0, 6.0), "b": (0.0, 13.0)}, run, F.col("y") >= 4, steps=5) for run in (executors.batched(MODEL), columns))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() > 4


def test_facilities(spark):
    d = spark.createDataFrame([(1, "m", 1.0, 1.0), (2, "m", 9.0, 1.0), (3, "c", 1.0, 1.0), (4, "other", 1.0, 1.0), (5, None, 1.0, 1.0), (6, "c", 9.0, None)], "id int, facility string, a double, b double")
    run = executors.by_facility({"m": executors.batched(MODEL), "c": search.linear({"a": 1.0, "b": 10.0})}, {"y": "double", "grade": "string"})
    got = {r.id: (r.y, r.grade, r.off_domain) for r in run(d).collect()}
    assert got == {1: (3.0, "low", None), 2: (None, None, "no result"), 3: (11.0, None, None), 4: (None, None, "no executor"), 5: (None, None, "no executor"), 6: (None, None, "no result")}
