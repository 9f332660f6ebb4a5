import duckdb

from trestle.queries import QUERIES, SQL

DDL = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"


def test_every_item_is_a_claim(spark, tmp_path):
    """Small items, items that are repeated whole and items that share an ordinal all count."""
    rows = [(1, 3, 3, 2, 40.0, 9.0)] * 2 + [(1, 3, 3, 2, 20.0, 9.0), (2, 4, 4, 1, 5.0, 9.0), (2, 7, 1, 4, 3.0, 1.0), (3, 5, 2, 2, 30.0, 2.0), (3, 5, 2, 2, 30.0, 2.0)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, DDL).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{path}/*.parquet'")
    for name in ("reconcile_verdict_all", "reconcile_unresolved_all"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(SQL[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert {r.l_orderkey: r.claims for r in QUERIES["reconcile_verdict_all"](spark, str(tmp_path)).collect()} == {1: 3, 2: 2, 3: 2}
    # Each of the two equal claims of order 1 contradicts the third, which has their ordinal.
    assert {r.l_orderkey: r.pairs for r in QUERIES["reconcile_unresolved_all"](spark, str(tmp_path)).collect()} == {1: 2}
