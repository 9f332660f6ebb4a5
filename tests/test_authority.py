"""Jurisdictions, reach of chains, chunks put together again."""

from pyspark.sql import functions as F

from trestle.operators import acquire, authority, graph
from trestle.plans import engine

RULES = "rule_id int, param string, sources array<struct<jurisdiction:string,priority:int>>"
ROWS = [
    (1, "a", [("Federal", 100), ("State", 60)]), (2, "a", [("county", 10)]), (3, "a", [("STATE", 30), (None, 70)]), (4, "b", None), (5, "b", []), (6, None, [("federal", None)]), (7, None, [("federal", 5)]),
]


def test_most_specific(spark):
    r = spark.createDataFrame(ROWS, RULES)
    best = lambda *who: {(x.rule_id, x.prio) for x in authority.most_specific(r, "param", *who).collect()}
    assert best() == {(2, 10), (4, 100), (5, 100), (7, 5)}
    assert best(F.lit("state")) == {(3, 1), (4, 100), (5, 100), (7, 5)}
    assert best(F.lit("FEDERAL")) == {(2, 10), (4, 100), (5, 100), (7, 1)}
    assert authority.most_specific(r.where("false"), "param").count() == 0


def test_filter_and_authority(spark):
    r = spark.createDataFrame(ROWS, RULES)
    assert {x.rule_id for x in r.where(authority.is_of(F.col("sources"), F.lit("state"))).collect()} == {1, 3}
    assert [x.a for x in r.orderBy("rule_id").select(authority.authority(F.col("sources")).alias("a")).collect()] == [100, 10, 70, 0, 0, 0, 5]
    assert [x.rule_id for x in engine.prioritized(r, F.lit("state")).limit(3).collect()] == [3, 7, 1]


def test_reach(spark):
    e = spark.createDataFrame([(1, 2, "AFFECTS", "HCM", 1), (2, 3, "AFFECTS", "HCM", 2), (3, 1, "AFFECTS", "HCM", 3), (2, 4, "DETERMINES", "HCM", 4)], "src int, dst int, type string, source string, ord long")
    roots = spark.createDataFrame([(1,), (4,), (4,)], "root int")
    assert {tuple(r) for r in graph.reach(graph.chain(e, roots), roots).collect()} == {(1, 2, 2), (4, 0, 0)}


def test_chunks(spark):
    rows = [(1, 2, "b", "15.2"), (1, 1, "a", "Ch. 15"), (1, 3, None, "15"), (1, 4, "x", "14"), (2, 1, "y", None), (3, 1, "d", "15"), (3, 1, "c", "215")]
    out = acquire.rejoined(spark.createDataFrame(rows, "id int, at int, t string, ch string"), ["id"], "at", "t", "ch", "15").collect()
    assert {tuple(r) for r in out} == {(1, "a b"), (3, "c d")}
