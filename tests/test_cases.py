"""Test cases out of numbers: shares, labels, domains, and no dependence on partitions."""

from collections import Counter

from pyspark.sql import functions as F

from trestle.operators import cases

KNOWN = len(cases.boundaries())


def made(spark, total, parts=8, **how):
    return cases.cases(spark.range(0, max(total, KNOWN), 1, parts).withColumnRenamed("id", "number"), total, **how)


def test_shares_and_labels(spark):
    total = KNOWN + 4000
    rows = made(spark, total).collect()
    n = Counter(r.category.split("_sf")[0] for r in rows)
    assert n == {"boundary": KNOWN, "valid_only": 800, "invalid_only": 800, "combinatorial": 1000, "random": 1400}
    for r in rows:
        assert r.expected_valid == (not r.expected_violations)
        if r.category == "valid_only":
            assert r.expected_valid
        if r.category == "invalid_only":
            assert len(r.expected_violations) == 1
        given = sum(r[p] is not None for p in cases.FIELDS)
        assert given == {"valid_only": 6, "invalid_only": 6, "random": 6}.get(r.category, given)
    broken = Counter(r.expected_violations[0] for r in rows if r.category == "invalid_only")
    assert set(broken) == {f"SF-00{i}" for i in range(1, 6)} and min(broken.values()) > 100
    both = {(r.lane_width, r.shoulder_width) for r in rows if r.category == "combinatorial"}
    assert len(both) == len(cases.LANE_WIDTHS) * len(cases.SHOULDER_WIDTHS)
    assert all(r.hor_class is not None for r in rows if r.passing_type is not None and r.category == "random")


def test_a_case_depends_on_its_number(spark):
    one, two = (made(spark, 500, parts).collect() for parts in (1, 7))
    assert {tuple(map(str, r)) for r in one} == {tuple(map(str, r)) for r in two}
    assert {tuple(map(str, r)) for r in made(spark, 500, seed=7).collect()} != {tuple(map(str, r)) for r in one}


def test_few_and_odd_numbers(spark):
    assert made(spark, 0).count() == KNOWN and made(spark, 0).where("category NOT LIKE 'boundary%'").isEmpty()
    odd = spark.createDataFrame([(None,), (-1,), (0,), (0,), (10**12,)], "number bigint")
    assert sorted(r.category for r in cases.cases(odd, 500).collect()) == ["boundary_sf001", "boundary_sf001", "random"]
    assert made(spark, 0).where("category = 'boundary_sf005'").groupBy((F.size("expected_violations") > 0).alias("bad")).count().count() == 2


def test_digits_stay_within_a_draw():
    at = cases.digits([2**20, 2**20, 2, 3])
    assert at[1] == f"(_d0 div {2**20}L) % {2**20}L" and at[2] == "(_d1 div 1L) % 2L" and at[3] == "(_d1 div 2L) % 3L"
