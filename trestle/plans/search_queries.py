"""Queries over reconciliation, closure, repair, inverse design, extraction, road XML, acquisition and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.operators import acquire, closure, executors, extract, freeway, metrics, reconcile, records, search
from trestle.plans.check_queries import WHOLE
from trestle.plans.registry import SQL, query
from trestle.sources import roadxml
from trestle.sources.designs import KEY, designs, designs_sql, table
from trestle.streaming.debounce import sessions

K = ", ".join(KEY)

# --- Reconciliation: an order's items as claims on one value -------------------------------------------------------


_ORDINAL = "l_partkey * 100000 + l_suppkey * 100 + l_linenumber"


#: Allowed values: sets, so that order and repeats say nothing.
_ALLOWED = "CASE l_suppkey % 4 WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('b', 'a', 'b') WHEN 2 THEN array('c') END"


def _as_claims(l: DataFrame, ordinal: str) -> DataFrame:
    lo = F.when(F.col("l_linenumber") % 3 != 0, F.floor(F.col("l_quantity") / 10))
    hi = F.when(F.col("l_linenumber") % 2 == 0, F.floor(F.col("l_quantity") / 5) + 3)
    return l.select(
        "l_orderkey", F.expr(ordinal).alias("ord"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), F.expr(_ALLOWED).alias("allowed"),
        (F.lit(4.0) >= F.coalesce(lo, F.lit(0))).alias("ok"), F.element_at(F.array(*map(F.lit, ["federal", "state", "local"])), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("jurisdiction"), F.when(F.col("l_suppkey") % 7 == 0, 30).alias("priority"),
        (F.col("l_partkey") % 3).alias("specificity"), F.element_at(F.array(*map(F.lit, ["HCM", "AASHTO", "county"])), (F.col("l_partkey") % 3 + 1).cast("int")).alias("authority"),
    )


#: Every item's place in its order: items that are equal in all of KEY make equal claims, and each has a place of its own.
_PLACE = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDINAL}, l_quantity, l_extendedprice)"
_CLAIMS = f"""claims AS (SELECT l_orderkey, {_PLACE} AS ord, CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_quantity / 10) END AS lo, CASE WHEN l_linenumber % 2 = 0 THEN floor(l_quantity / 5) + 3 END AS hi,
    CASE l_suppkey % 4 WHEN 0 THEN 'ab' WHEN 1 THEN 'ab' WHEN 2 THEN 'c' END AS allowed, 4.0 >= coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_quantity / 10) END, 0) AS ok, CASE WHEN l_suppkey % 7 = 0 THEN 30 ELSE [100, 50, 25][l_suppkey % 3 + 1] END AS prio, l_partkey % 3 AS spec, [1.0, 0.95, 0.5][l_partkey % 3 + 1] AS trust FROM lineitem),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY prio, spec DESC, trust DESC, ord) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM claims),
    fold AS (SELECT l_orderkey, 0::BIGINT AS i, n, []::STRUCT(ord BIGINT, lo DOUBLE, hi DOUBLE, allowed VARCHAR, ok BOOLEAN, prio INTEGER, spec BIGINT, trust DOUBLE)[] AS kept FROM (SELECT DISTINCT l_orderkey, n FROM ranked) UNION ALL
        SELECT f.l_orderkey, f.i + 1, f.n, CASE WHEN len(list_filter(kept, lambda k: (coalesce(k.lo <> r.lo, false) OR coalesce(k.hi <> r.hi, false) OR coalesce(k.allowed <> r.allowed, false) OR k.ok <> r.ok) AND (k.prio < r.prio OR (k.prio = r.prio AND (k.spec > r.spec OR (k.spec = r.spec AND k.trust > r.trust)))))) > 0 THEN kept
            ELSE list_append(kept, {{'ord': r.ord, 'lo': r.lo, 'hi': r.hi, 'allowed': r.allowed, 'ok': r.ok, 'prio': r.prio::INTEGER, 'spec': r.spec, 'trust': r.trust::DOUBLE}}) END
        FROM fold f JOIN ranked r ON f.l_orderkey = r.l_orderkey AND r.i = f.i + 1)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_claims(table(spark, sf_dir, "lineitem"), f"CAST({_PLACE} AS BIGINT)")


@query(f"WITH RECURSIVE {_CLAIMS} SELECT l_orderkey, n::INT AS claims, len(kept)::INT AS survivors, list_max([k.lo FOR k IN kept]) AS lo, list_min([k.hi FOR k IN kept]) AS hi, coalesce(list_bool_and([k.ok FOR k IN kept]), true) AS verdict FROM fold WHERE i = n")
def reconcile_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconciled(_claims(spark, sf_dir), ["l_orderkey"]).drop("unresolved")


@query(f"""WITH RECURSIVE {_CLAIMS}, s AS (SELECT l_orderkey, unnest(kept) AS k FROM fold WHERE i = n) SELECT a.l_orderkey, count(*) AS pairs FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.k.ord < b.k.ord WHERE coalesce(a.k.lo <> b.k.lo, false) OR coalesce(a.k.hi <> b.k.hi, false) OR coalesce(a.k.allowed <> b.k.allowed, false) OR a.k.ok <> b.k.ok GROUP BY 1""")
def reconcile_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in which survivors still contradict each other, being equally strong."""
    args = reconcile.arguments(_claims(spark, sf_dir)).groupBy("l_orderkey").agg(F.collect_list("arg").alias("args")).withColumn("kept", reconcile.surviving(F.col("args")))
    ties = F.aggregate("kept", F.lit(0).cast("bigint"), lambda n, a: n + F.size(F.filter("kept", lambda b: (a["ord"] < b["ord"]) & reconcile.aspect(a, b).isNotNull())))
    return args.select("l_orderkey", ties.alias("pairs")).where("pairs > 0")


@query(SQL["reconcile_verdict"])
def reconcile_verdict_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that reconcile_verdict over all items had while it left some out."""
    return reconcile_verdict(spark, sf_dir)


@query(SQL["reconcile_unresolved"])
def reconcile_unresolved_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that reconcile_unresolved over all items had while it left some out."""
    return reconcile_unresolved(spark, sf_dir)


#: Items as claims as they are stated: with defaults, lists as texts, conditions, some on another parameter. Their orders are the cases.
_STATED = {
    "parameter": "CASE WHEN l_linenumber = 5 THEN 'other' WHEN l_linenumber <> 6 THEN 'lane_width' END",
    "rule_type": "CASE WHEN l_linenumber % 4 = 0 THEN 'enum' ELSE 'range' END",
    "lo": "CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_quantity / 10) END",
    "hi": "CASE WHEN l_linenumber % 2 = 0 THEN floor(l_quantity / 5) + 3 END",
    "allowed": "CASE l_suppkey % 4 WHEN 0 THEN '4.0, 5.0' WHEN 1 THEN ' 5.0,4.0,,' WHEN 2 THEN '6.0' END",
    "jurisdiction": "CASE l_suppkey % 4 WHEN 0 THEN 'Federal' WHEN 1 THEN 'state' WHEN 2 THEN 'local' END",
    "priority": "CASE WHEN l_suppkey % 7 = 0 THEN 30 END",
    "authority": "CASE l_partkey % 4 WHEN 0 THEN 'HCM' WHEN 1 THEN 'AASHTO' WHEN 2 THEN 'county' END",
    "citation": "CASE WHEN l_partkey % 2 = 0 THEN 'M' END",
}


def _stated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem")
    conditions = "CASE l_partkey % 3 WHEN 1 THEN array(named_struct('type', 'terrain', 'value', 'level')) WHEN 2 THEN array(named_struct('type', 'terrain', 'value', 'level'), named_struct('type', 'city', 'value', 'Urban')) END AS conditions"
    claims = l.selectExpr("l_orderkey", f"{_PLACE} - 1 AS ord", *(f"{x} AS {name}" for name, x in _STATED.items()), conditions)
    context = "CASE l_orderkey % 3 WHEN 0 THEN map('terrain', 'Level', 'city', 'urban') WHEN 1 THEN map('terrain', 'rolling') END AS context"
    cases = l.select("l_orderkey").distinct().where("l_orderkey % 11 <> 0").selectExpr("l_orderkey", "CASE WHEN l_orderkey % 2 = 0 THEN 'lane_width' END AS parameter", context, "CASE WHEN l_orderkey % 4 <> 0 THEN 4.0D END AS value")
    return claims, cases


_TRACE = f"""raw AS (SELECT l_orderkey, {_PLACE} - 1 AS ord, {", ".join(f"{x} AS {name}" for name, x in _STATED.items())}, l_partkey % 3 AS conds FROM lineitem),
    cases AS (SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 11 <> 0 AND l_orderkey % 3 < 2 THEN l_orderkey % 3 ELSE 2 END AS c, CASE WHEN l_orderkey % 4 <> 0 AND l_orderkey % 11 <> 0 THEN 4.0 END AS value, CASE WHEN l_orderkey % 11 <> 0 AND l_orderkey % 2 = 0 THEN 'lane_width' END AS asked FROM lineitem),
    firsts AS (SELECT l_orderkey, coalesce(asked, parameter, '') AS p, c, value FROM cases JOIN raw USING (l_orderkey) WHERE ord = 0),
    args AS (SELECT r.* EXCLUDE (allowed, parameter, jurisdiction, authority), p, c, value, lower(coalesce(jurisdiction, 'federal')) AS tier, coalesce(priority, CASE lower(coalesce(jurisdiction, 'federal')) WHEN 'state' THEN 50 WHEN 'local' THEN 25 ELSE 100 END) AS prio,
            coalesce(authority, 'unknown') AS authority, CASE authority WHEN 'HCM' THEN 1.0 WHEN 'AASHTO' THEN 0.95 ELSE 0.5 END AS trust, list_filter([trim(x) FOR x IN string_split(coalesce(allowed, ''), ',')], lambda x: x <> '') AS vals,
            conds = 0 OR c = 0 AS applicable, CASE WHEN conds = 0 OR c = 0 THEN conds ELSE 0 END AS spec,
            CASE WHEN conds = 0 THEN 'unconditional' WHEN c = 0 THEN CASE WHEN conds = 1 THEN 'terrain=level' ELSE 'terrain=level, city=Urban' END WHEN c = 1 THEN 'terrain=level isn''t met: rolling' ELSE 'terrain=level isn''t established' END AS reason
        FROM raw r JOIN firsts USING (l_orderkey) WHERE p = '' OR coalesce(parameter, p) = p),
    told AS (SELECT *, CASE WHEN rule_type = 'enum' THEN list_sort(list_distinct(vals))::VARCHAR END AS allowed, CASE WHEN applicable AND value IS NOT NULL THEN CASE WHEN rule_type = 'enum' AND len(vals) > 0 THEN list_contains(vals, '4.0') ELSE coalesce(value >= lo, true) AND coalesce(value <= hi, true) END END AS ok,
            'A' || (ord + 1) AS id, p || CASE WHEN rule_type = 'enum' AND len(vals) > 0 THEN ' in {{' || array_to_string(vals, ', ') || '}}' WHEN lo IS NOT NULL AND hi IS NOT NULL THEN ' in [' || lo::BIGINT || ', ' || hi::BIGINT || ']' WHEN lo IS NOT NULL THEN ' >= ' || lo::BIGINT WHEN hi IS NOT NULL THEN ' <= ' || hi::BIGINT ELSE ': no bound' END AS claim FROM args),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY prio, spec DESC, trust DESC, ord) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM told WHERE applicable),
    fold AS (SELECT l_orderkey, 0::BIGINT AS i, n, []::STRUCT(ord BIGINT, lo DOUBLE, hi DOUBLE, allowed VARCHAR, ok BOOLEAN, prio INTEGER, spec BIGINT, trust DOUBLE)[] AS kept FROM (SELECT DISTINCT l_orderkey, n FROM ranked) UNION ALL
        SELECT f.l_orderkey, f.i + 1, f.n, CASE WHEN len(list_filter(kept, lambda k: (coalesce(k.lo <> r.lo, false) OR coalesce(k.hi <> r.hi, false) OR coalesce(k.allowed <> r.allowed, false) OR coalesce(k.ok <> r.ok, false)) AND (k.prio < r.prio OR (k.prio = r.prio AND (k.spec > r.spec OR (k.spec = r.spec AND k.trust > r.trust)))))) > 0 THEN kept
            ELSE list_append(kept, {{'ord': r.ord, 'lo': r.lo, 'hi': r.hi, 'allowed': r.allowed, 'ok': r.ok, 'prio': r.prio::INTEGER, 'spec': r.spec, 'trust': r.trust::DOUBLE}}) END
        FROM fold f JOIN ranked r ON f.l_orderkey = r.l_orderkey AND r.i = f.i + 1),
    kept AS (SELECT l_orderkey, unnest(kept).ord AS ord FROM fold WHERE i = n), governing AS (SELECT told.* FROM told JOIN kept USING (l_orderkey, ord)),
    pairs AS (SELECT a.l_orderkey, a.ord AS ao, b.ord AS bo, a.id AS a, b.id AS b, CASE WHEN a.lo <> b.lo THEN 'lower bound' WHEN a.hi <> b.hi THEN 'upper bound' WHEN a.allowed <> b.allowed THEN 'allowed values' WHEN a.ok <> b.ok THEN 'verdict' END AS aspect,
            CASE WHEN a.prio <> b.prio THEN 'jurisdiction' WHEN a.spec <> b.spec THEN 'specificity' WHEN a.trust <> b.trust THEN 'provenance' END AS principle, (a.prio, -a.spec, -a.trust) <= (b.prio, -b.spec, -b.trust) AS first, a.i AS ai, b.i AS bi, (least(a.prio, b.prio)) AS x,
            CASE WHEN (a.prio, -a.spec, -a.trust) <= (b.prio, -b.spec, -b.trust) THEN (a.prio, -a.spec, -a.trust) ELSE (b.prio, -b.spec, -b.trust) END AS strength
        FROM ranked a JOIN ranked b ON a.l_orderkey = b.l_orderkey AND a.ord < b.ord),
    conflicts AS (SELECT * FROM pairs WHERE aspect IS NOT NULL),
    won AS (SELECT c.*, CASE WHEN first THEN a ELSE b END AS winner, CASE WHEN first THEN b ELSE a END AS loser FROM conflicts c JOIN kept k ON k.l_orderkey = c.l_orderkey AND k.ord = CASE WHEN first THEN ao ELSE bo END WHERE principle IS NOT NULL),
    effective AS (SELECT l_orderkey, any_value(p) AS p, any_value(value) AS value, max(lo) AS lo, min(hi) AS hi, bool_and(ok) AS verdict, string_agg(id || ' (' || claim || ')', ', ' ORDER BY ord) AS text FROM governing GROUP BY 1),
    over AS (SELECT t.l_orderkey, string_agg(t.id, ', ' ORDER BY ord) AS ids FROM told t JOIN effective e ON e.l_orderkey = t.l_orderkey WHERE t.applicable AND t.ok <> e.verdict AND (t.l_orderkey, t.ord) NOT IN (SELECT (l_orderkey, ord) FROM kept) GROUP BY 1),
    lines AS (
        SELECT l_orderkey, 0 AS s, NULL AS strength, 0 AS o, 0 AS o2, 'context' AS kind, ['city=urban, terrain=Level', 'terrain=rolling', 'none'][c + 1] AS text FROM firsts
        UNION ALL SELECT l_orderkey, 1, NULL, ord, 0, 'argument', id || ' (' || tier || ' ' || prio || ', ' || authority || ' ' || CASE trust WHEN 1 THEN '1' ELSE trust::DOUBLE::VARCHAR END || '): ' || claim || CASE WHEN citation IS NOT NULL THEN ' [' || citation || ']' ELSE '' END || CASE WHEN NOT applicable THEN '; doesn''t apply: ' || reason WHEN conds > 0 THEN '; applies: ' || reason ELSE '' END FROM told
        UNION ALL SELECT l_orderkey, 2, NULL, 0, 0, 'agreement', 'nothing conflicts' FROM firsts WHERE l_orderkey NOT IN (SELECT l_orderkey FROM conflicts)
        UNION ALL SELECT l_orderkey, 3, NULL, ao, bo, 'conflict', a || ' and ' || b || ' differ in their ' || aspect FROM conflicts
        UNION ALL SELECT l_orderkey, 4, strength, ao, bo, 'defeat', winner || ' defeats ' || loser || ' by ' || principle FROM won
        UNION ALL SELECT l_orderkey, 5, NULL, ao, bo, 'unresolved', a || ' and ' || b || ' can''t be told apart; both hold' FROM conflicts WHERE principle IS NULL
        UNION ALL SELECT l_orderkey, 6, NULL, 0, 0, 'governing', coalesce(text, 'none') FROM firsts LEFT JOIN effective USING (l_orderkey)
        UNION ALL SELECT l_orderkey, 7, NULL, 0, 0, 'effective', p || ' in [' || coalesce(lo::BIGINT::VARCHAR, '-inf') || ', ' || coalesce(hi::BIGINT::VARCHAR, '+inf') || ']' FROM effective
        UNION ALL SELECT l_orderkey, 8, NULL, 0, 0, 'verdict', p || ' = 4' || CASE WHEN verdict THEN ' complies' ELSE ' doesn''t comply' END || coalesce('; overridden: ' || ids, '') FROM effective LEFT JOIN over USING (l_orderkey) WHERE value IS NOT NULL)"""


@query(f"WITH RECURSIVE {_TRACE} SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY s, strength, o, o2) - 1)::INT AS place, kind, text FROM lines")
def reconcile_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the claims of every order come to a result: who applies, who conflicts with whom, who defeats whom by what, and what is left."""
    claims, cases = _stated(spark, sf_dir)
    return reconcile.trace(reconcile.adjudicated(claims, cases, ["l_orderkey"]), ["l_orderkey"])


# --- Closure ------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT CASE c_nationkey % 8 WHEN 0 THEN 70.0 WHEN 1 THEN 70 WHEN 2 THEN 65 WHEN 3 THEN 60 WHEN 4 THEN 50 WHEN 5 THEN 45 END AS speed FROM customer), s AS (
    SELECT 'speed_limit' AS param, CASE WHEN speed IS NULL THEN 'no_proposal' ELSE 'accepted' END AS state FROM r UNION ALL SELECT 'bffs', CASE WHEN speed IS NULL THEN 'no_proposal' ELSE 'accepted' END FROM r UNION ALL SELECT 'lane_width', 'rejected' FROM r UNION ALL SELECT 'ffs', 'no_proposal' FROM r)
    SELECT param, count(*) FILTER (WHERE state = 'accepted') AS accepted, count(*) FILTER (WHERE state = 'rejected') AS rejected, count(*) FILTER (WHERE state = 'no_proposal') AS no_proposal FROM s GROUP BY 1""")
def derivation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = ["speed_limit", "bffs", "lane_width", "ffs"]
    roots = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 8).alias("hor_class"))
    return closure.counters(closure.closed(roots, chain, closure.table_proposers()), chain)


@query(f"""WITH d AS (SELECT l_extendedprice / 40.0 AS design_rad, (25 + 5 * (l_partkey % 12) + (l_suppkey % 5) / 4.0)::DOUBLE AS spl FROM lineitem), {WHOLE}, s AS (SELECT 'spl' AS param, 'accepted' AS state FROM d UNION ALL SELECT 'design_rad', CASE WHEN design_rad < least THEN 'rejected' ELSE 'accepted' END FROM rad)
    SELECT param, count(*) FILTER (WHERE state = 'accepted') AS accepted, count(*) FILTER (WHERE state = 'rejected') AS rejected, count(*) FILTER (WHERE state = 'no_proposal') AS no_proposal FROM s GROUP BY 1""")
def closure_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radius is proposed after a speed, and held against it."""
    roots = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 40.0).alias("radius"), (25 + 5 * (F.col("l_partkey") % 12) + (F.col("l_suppkey") % 5) / F.lit(4.0)).alias("speed"))
    chain = ["spl", "design_rad"]
    return closure.counters(closure.closed(roots, chain, {"spl": lambda: F.col("speed"), "design_rad": lambda: F.col("radius")}), chain)


# --- Repair and inverse design with a linear executor ---------------------------------------------------------------

LEVERS = {"a": (0.0, 30.0), "b": (0.0, 12.0), "c": (1.0, 5.0)}
_LINEAR = search.linear({"a": 2.0, "b": 1.0, "c": 3.0})


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 12).cast("double").alias("b"), (F.col("p_partkey") % 4 + 1).cast("double").alias("c"))


_PARTS = "p AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 12)::DOUBLE AS b, (p_partkey % 4 + 1)::DOUBLE AS c FROM part)"
_SINGLE = f"""{_PARTS}, open AS (SELECT * FROM p WHERE NOT (2 * a + b + 3 * c <= 40)), l AS (SELECT * FROM (VALUES ('a', 0, 0.0::DOUBLE, 30.0::DOUBLE), ('b', 1, 0.0, 12.0), ('c', 2, 1.0, 5.0)) AS l(lever, place, lo, hi)),
    t AS (SELECT *, CASE lever WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END AS old, lo + (hi - lo) * i / 6 AS trial FROM open, l, unnest(range(0, 7)) AS g(i)),
    o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lever ORDER BY abs(trial - old), trial) AS rank, count(*) OVER (PARTITION BY p_partkey, lever) AS size FROM t WHERE abs(trial - old) > 1e-9),
    h AS (SELECT p_partkey, lever, place, any_value(old) AS old, any_value(size) AS size, min(rank) FILTER (WHERE ok) AS first, arg_min(trial, rank) FILTER (WHERE ok) AS trial
        FROM (SELECT *, CASE lever WHEN 'a' THEN 2 * trial + b + 3 * c WHEN 'b' THEN 2 * a + trial + 3 * c ELSE 2 * a + b + 3 * trial END <= 40 AS ok FROM o) GROUP BY ALL)"""
_DELTA = "round(CASE WHEN old = 0 THEN abs(trial - old) ELSE abs((trial - old) / old) END, 6)"


def _goal():
    return F.col("y") <= 40


@query(f"WITH {_SINGLE} SELECT p_partkey, lever, old, trial, first AS rank, {_DELTA} AS delta FROM h WHERE first IS NOT NULL")
def repair_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.single_repairs(_parts(spark, sf_dir), ["p_partkey"], LEVERS, _LINEAR, _goal()).withColumn("delta", F.round("delta", 6)).withColumn("rank", F.col("rank").cast("bigint"))


#: The linear executor as a model that evaluates batches and has no result where a is above 27.
_MODEL = executors.Model(lambda x: {"y": np.where(x["a"] <= 27, 2 * x["a"] + x["b"] + 3 * x["c"], np.nan)}, ("a", "b", "c"), ("y",))
_SINGLE_WITHIN = _SINGLE.replace("NOT (2 * a + b + 3 * c <= 40)", "NOT (a <= 27 AND 2 * a + b + 3 * c <= 40)").replace("<= 40 AS ok", "<= 40 AND CASE lever WHEN 'a' THEN trial ELSE a END <= 27 AS ok")


@query(f"WITH {_SINGLE_WITHIN} SELECT p_partkey, lever, old, trial, first AS rank, {_DELTA} AS delta FROM h WHERE first IS NOT NULL")
def repair_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single repairs by a model in Python; trials off its domain count as tried."""
    return search.single_repairs(_parts(spark, sf_dir), ["p_partkey"], LEVERS, executors.batched(_MODEL), _goal()).withColumn("delta", F.round("delta", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {_PARTS} SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN a <= 27 THEN 2 * a + b + 3 * c END WHEN 1 THEN 5 * a + b END AS y, CASE WHEN p_partkey % 3 = 2 THEN 'no executor' WHEN p_partkey % 3 = 0 AND a > 27 THEN 'no result' END AS off_domain FROM p""")
def executor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of three facilities, of which two have an executor: one a model in Python, one columns."""
    run = executors.by_facility({"f0": executors.batched(_MODEL), "f1": search.linear({"a": 5.0, "b": 1.0})}, {"y": "double"})
    return run(_parts(spark, sf_dir).withColumn("facility", F.concat(F.lit("f"), F.col("p_partkey") % 3))).select("p_partkey", "y", "off_domain")


@query(f"""WITH {_SINGLE}, b AS (SELECT *, 1 + coalesce(sum(coalesce(first, size)) OVER (PARTITION BY p_partkey ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) SELECT p_partkey, lever, trial FROM b WHERE before + first <= 10""")
def repair_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.single_repairs(_parts(spark, sf_dir), ["p_partkey"], LEVERS, _LINEAR, _goal(), budget=10).select("p_partkey", "lever", "trial")


@query(f"""WITH {_SINGLE}, left_ AS (SELECT * FROM open WHERE p_partkey NOT IN (SELECT p_partkey FROM h WHERE first IS NOT NULL)),
    x AS (SELECT p.*, l1.lever AS lever_a, l2.lever AS lever_b, l1.lo + (l1.hi - l1.lo) * i / 3 AS trial_a, l2.lo + (l2.hi - l2.lo) * j / 3 AS trial_b FROM left_ p, l l1 JOIN l l2 ON l1.place < l2.place, unnest(range(0, 4)) AS g(i), unnest(range(0, 4)) AS k(j)),
    v AS (SELECT *, CASE lever_a WHEN 'a' THEN a ELSE b END AS o1, CASE lever_b WHEN 'b' THEN b ELSE c END AS o2 FROM x),
    w AS (SELECT *, CASE WHEN lever_a = 'a' THEN trial_a ELSE a END AS na, CASE WHEN lever_a = 'b' THEN trial_a WHEN lever_b = 'b' THEN trial_b ELSE b END AS nb, CASE WHEN lever_b = 'c' THEN trial_b ELSE c END AS nc,
        (CASE WHEN o1 = 0 THEN abs(trial_a - o1) ELSE abs((trial_a - o1) / o1) END) + (CASE WHEN o2 = 0 THEN abs(trial_b - o2) ELSE abs((trial_b - o2) / o2) END) AS delta FROM v WHERE abs(trial_a - o1) > 1e-9 AND abs(trial_b - o2) > 1e-9)
    SELECT p_partkey, lever_a, lever_b, round(delta, 6) AS delta, trial_a, trial_b FROM w WHERE 2 * na + nb + 3 * nc <= 40 QUALIFY row_number() OVER (PARTITION BY p_partkey, lever_a, lever_b ORDER BY round(delta, 9), trial_a, trial_b) = 1""".replace("open AS (SELECT * FROM p WHERE NOT (2 * a + b + 3 * c <= 40))", "open AS (SELECT * FROM p WHERE NOT (2 * a + b + 3 * c <= 16))").replace("<= 40", "<= 16"))
def repair_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pair_repairs(_parts(spark, sf_dir), ["p_partkey"], LEVERS, _LINEAR, F.col("y") <= 16).withColumn("delta", F.round("delta", 6))


_PAIR = SQL["repair_pair"]


def _ranked_sql() -> str:
    pair = _PAIR.replace("<= 16", "<= 20")
    at = pair.index("SELECT p_partkey, lever_a, lever_b, round(delta, 6)")
    trust = "CASE {} WHEN 'a' THEN 0.9 WHEN 'b' THEN 0.95 ELSE 1.0 END"
    return f"""{pair[:at].rstrip()}, pairs AS ({pair[at:]}), every AS (SELECT p_partkey, lever AS levers, 1 AS cardinality, CASE WHEN old = 0 THEN abs(trial - old) ELSE abs((trial - old) / old) END AS delta, {trust.format("lever")} AS confidence FROM h WHERE first IS NOT NULL
        UNION ALL SELECT p_partkey, lever_a || ',' || lever_b, 2, delta, least({trust.format("lever_a")}, {trust.format("lever_b")}) FROM pairs)
        SELECT p_partkey, levers, cardinality, round(delta, 6) AS delta, confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY p_partkey ORDER BY cardinality, round(delta, 9), confidence DESC, levers)::INT AS place FROM every"""


@query(_ranked_sql())
def repair_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single repairs, and where there are none pairs, in the order in which they are proposed."""
    how = (_parts(spark, sf_dir), ["p_partkey"], LEVERS, _LINEAR, F.col("y") <= 20)
    found = search.ranked(search.single_repairs(*how), search.pair_repairs(*how), ["p_partkey"], {"a": 0.9, "b": 0.95})
    return found.select("p_partkey", F.array_join("levers", ",").alias("levers"), "cardinality", F.round("delta", 6).alias("delta"), "confidence", "place")


FREE = {"lane_width": (9.0, 12.0), "shoulder_width": (0.0, 8.0), "apd": (0.0, 20.0)}
_SITES = """s AS (SELECT c_custkey, c_nationkey * 4.0 AS volume FROM customer), g AS (SELECT *, 9 + 3 * i / 4.0 AS lane_width, 8 * j / 4.0 AS shoulder_width, 20 * k / 4.0 AS apd, (i * 5 + j) * 5 + k AS ordinal FROM s, unnest(range(0, 5)) AS a(i), unnest(range(0, 5)) AS b(j), unnest(range(0, 5)) AS c(k)),
    f AS (SELECT *, round((lane_width - 9) / 3 + shoulder_width / 8 + (1 - apd / 20), 6) AS cost FROM g WHERE 10 * lane_width + 4 * shoulder_width - apd - volume >= 40)"""


def _inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 4.0).alias("volume"))
    return search.inverse_designs(sites, ["c_custkey"], FREE, search.linear({"lane_width": 10.0, "shoulder_width": 4.0, "apd": -1.0, "volume": -1.0}), F.col("y") >= 40)


@query(f"WITH {_SITES} SELECT c_custkey, lane_width::DOUBLE AS lane_width, shoulder_width::DOUBLE AS shoulder_width, apd::DOUBLE AS apd, cost::DOUBLE AS cost, row_number() OVER (PARTITION BY c_custkey ORDER BY cost, apd, lane_width, shoulder_width)::INT AS place, false AS truncated FROM f")
def inverse_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inverse(spark, sf_dir)


@query(f"WITH {_SITES} SELECT c_custkey, count(*) AS feasible, min(lane_width)::DOUBLE AS min_lane_width, max(lane_width)::DOUBLE AS max_lane_width, min(shoulder_width)::DOUBLE AS min_shoulder_width, max(shoulder_width)::DOUBLE AS max_shoulder_width, min(apd)::DOUBLE AS min_apd, max(apd)::DOUBLE AS max_apd, min(cost)::DOUBLE AS least_cost FROM f GROUP BY 1")
def inverse_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.envelope(_inverse(spark, sf_dir), ["c_custkey"], list(FREE))


_FREEWAY = """d AS (SELECT 65.0 + l_linenumber AS bffs, 10.0 + (l_linenumber % 5) * 0.5 AS lw, (l_linenumber % 7)::DOUBLE AS lc_r, (l_suppkey % 4)::DOUBLE AS trd, 2 + l_linenumber % 3 AS lanes, l_extendedprice / 12 AS demand, 0.9 + l_discount AS phf, l_tax AS p_t, l_linestatus = 'O' AS level FROM lineitem),
    f AS (SELECT *, bffs - CASE WHEN lw >= 12 THEN 0 WHEN lw >= 11 THEN 1.9 * (12 - lw) ELSE 1.9 + 4.7 * (11 - lw) END - CASE lanes WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 ELSE 0.2 END * (6 - least(lc_r, 6)) - 3.22 * pow(trd, 0.84) AS ffs FROM d),
    c AS (SELECT *, least(2200 + 10 * (least(ffs, 70) - 50), 2400) AS cap, demand * (1 + p_t * (CASE WHEN level THEN 2.0 ELSE 3.0 END - 1)) / (phf * lanes) AS vp, 1000 + 40 * (75 - ffs) AS bp FROM f),
    s AS (SELECT *, CASE WHEN vp <= cap THEN CASE WHEN vp <= bp THEN ffs ELSE ffs - (ffs - cap / 45) * pow(vp - bp, 2) / pow(cap - bp, 2) END END AS speed FROM c)"""


@query(f"""WITH {_FREEWAY} SELECT CASE WHEN vp / cap > 1 THEN 'F' WHEN vp / speed <= 11 THEN 'A' WHEN vp / speed <= 18 THEN 'B' WHEN vp / speed <= 26 THEN 'C' WHEN vp / speed <= 35 THEN 'D' WHEN vp / speed <= 45 THEN 'E' ELSE 'F' END AS los, lanes, count(*) AS n, round(min(ffs), 4) AS least_ffs, round(max(vp / speed), 4) AS densest FROM s GROUP BY ALL""")
def freeway_los(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    d = l.select(
        (65.0 + F.col("l_linenumber")).alias("bffs"), (10.0 + (F.col("l_linenumber") % 5) * 0.5).alias("lw"), (F.col("l_linenumber") % 7).cast("double").alias("lc_r"), (F.col("l_suppkey") % 4).cast("double").alias("trd"), (2 + F.col("l_linenumber") % 3).alias("lane_count"),
        (F.col("l_extendedprice") / 12).alias("demand_flow_i"), (0.9 + F.col("l_discount")).alias("phf"), F.col("l_tax").alias("p_t"), F.when(F.col("l_linestatus") == "O", "level").otherwise("rolling").alias("terrain"),
    )
    return freeway.evaluated(d).groupBy("los", F.col("lane_count").alias("lanes")).agg(F.count("*").alias("n"), F.round(F.min("ffs"), 4).alias("least_ffs"), F.round(F.max("density"), 4).alias("densest"))


# --- Extraction -----------------------------------------------------------------------------------------------------


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that state parameters, from line items, and all documents."""
    l = table(spark, sf_dir, "lineitem")
    made = l.select(F.concat(F.lit("n"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.concat(F.lit("The lane width: "), F.col("l_linenumber") + 8, F.lit(" ft on rolling terrain, "), F.col("l_quantity").cast("int"), F.lit(" mph speed limit, volume: 1,"), F.col("l_suppkey") % 900 + 100, F.lit(" veh/h in a rural area of a two-lane highway")).alias("text"))
    return made.unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))


_NOTES = """notes AS (SELECT 'n' || l_orderkey || '-' || l_linenumber AS id, 'The lane width: ' || (l_linenumber + 8) || ' ft on rolling terrain, ' || l_quantity::INT || ' mph speed limit, volume: 1,' || (l_suppkey % 900 + 100) || ' veh/h in a rural area of a two-lane highway' AS text FROM lineitem
    UNION ALL SELECT 'd' || doc_id, text FROM documents), low AS (SELECT id, lower(text) AS t FROM notes WHERE length(text) >= 20 AND regexp_matches(lower(text), '""" + "|".join(extract.KEYWORDS) + "'))"


def _text_sql() -> str:
    parts = []
    for p, ps in extract.TEXT.items():
        tries = ", ".join(f"nullif(regexp_extract(t, '{x}', 1), '')" for x in ps)
        parts.append(f"SELECT '{p}' AS param, try_cast(replace(coalesce({tries}), ',', '') AS DOUBLE) AS value FROM low")
    return f"WITH {_NOTES} SELECT param, value, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL GROUP BY ALL"


@query(_text_sql())
def text_param_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.text_parameters(_notes(spark, sf_dir), ["id"], "text").groupBy("param", "value").agg(F.count("*").alias("n"))


@query(f"""WITH {_NOTES}, c AS (SELECT """ + ", ".join(f"""regexp_replace(coalesce({", ".join(f"nullif(regexp_extract(lower(text), '{x}', 1), '')" for x in ps)}), '[\\s-]', '', 'g') AS {k}""" for k, ps in extract.CONTEXT.items()) + """ FROM notes) SELECT facility_type, terrain_type, city_type, count(*) AS n FROM c GROUP BY ALL""")
def text_context_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _notes(spark, sf_dir)
    return n.select(*(c.alias(k) for k, c in extract.text_context(F.col("text")).items())).groupBy("facility_type", "terrain_type", "city_type").agg(F.count("*").alias("n"))


@query("""SELECT key AS param, upper(key[1]) || lower(key[2:]) AS name, try_cast(value AS DOUBLE) AS value_num, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events) GROUP BY ALL""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.json_parameters(table(spark, sf_dir, "events"), ["event_id"], "props", known=None).groupBy("param", "name", "value_num").agg(F.count("*").alias("n"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    some = F.array(*(F.when(c, F.lit(n)) for n, c in (("bffs", F.col("l_linenumber") % 3 == 0), ("lc_r", F.col("l_linenumber") % 3 == 0), ("lc_l", F.col("l_linenumber") % 6 == 0), ("trd", F.col("l_linenumber") % 2 == 0), ("lane_width", F.col("l_linenumber") % 5 == 0), ("apd", F.col("l_linenumber") == 1))))
    return l.select(F.filter(some, lambda x: x.isNotNull()).alias("names"), "l_linenumber", F.when(F.col("l_returnflag") == "R", "given").alias("given"), F.when(F.col("l_linenumber") == 7, F.lit("a text on lane widths, as long as needed")).alias("text"))


@query("""SELECT l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'given' WHEN l_linenumber % 3 = 0 OR l_linenumber % 2 = 0 OR l_linenumber = 1 THEN 'BasicFreeway' WHEN l_linenumber % 5 = 0 THEN 'TwoLaneHighway' END AS facility, count(*) AS n FROM lineitem GROUP BY ALL""")
def facility_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).groupBy("l_linenumber", extract.facility_of(F.col("names"), F.col("given")).alias("facility")).agg(F.count("*").alias("n"))


@query("""SELECT l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'given' WHEN l_linenumber % 6 = 0 THEN 'struct' WHEN l_linenumber <> 7 THEN 'json' ELSE 'text' END AS extractor, count(*) AS n FROM lineitem GROUP BY ALL""")
def extractor_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).groupBy("l_linenumber", extract.source_type(F.col("given"), F.col("names"), F.col("text")).alias("extractor")).agg(F.count("*").alias("n"))


@query(f"""WITH d AS ({designs_sql("grade", "design_rad", "passing_type")}), s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(KEY[1:])}) - 1 AS i, * EXCLUDE (l_orderkey) FROM d), f AS (SELECT l_orderkey, arg_min(passing_type, i)::INT AS first_passing FROM s GROUP BY 1)
    SELECT l_orderkey, 'segment_' || i || '_grade' AS param, round(grade, 6) AS value, first_passing FROM s JOIN f USING (l_orderkey) UNION ALL SELECT l_orderkey, 'segment_' || i || '_design_rad', round(design_rad, 6), first_passing FROM s JOIN f USING (l_orderkey)""")
def struct_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records flattened to names with the segment's place; the first segment gives the context."""
    d = designs(spark, sf_dir, "grade", "design_rad", "passing_type")
    nested = d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*KEY[1:], "grade", "design_rad", "passing_type"))).alias("segments"))
    flat = nested.select("l_orderkey", F.get(F.col("segments"), 0)["passing_type"].cast("int").alias("first_passing"), F.posexplode("segments").alias("i", "s"))
    pairs = F.explode(F.array(*(F.struct(F.concat(F.lit("segment_"), "i", F.lit(f"_{p}")).alias("param"), F.round(F.col(f"s.{p}"), 6).alias("value")) for p in ("grade", "design_rad"))))
    return flat.select("l_orderkey", pairs.alias("_"), "first_passing").select("l_orderkey", "_.*", "first_passing")


# --- Road XML -------------------------------------------------------------------------------------------------------


def _roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    xml = roadxml.road_xml(F.col("o_orderkey"), F.col("o_orderkey") % 500 + 1, F.when(F.col("o_custkey") % 3 == 0, 0.0).otherwise(1.0 / (F.col("o_custkey") % 800 + 100)), [F.lit(9.0) + F.col("o_custkey") % 6, F.lit(12.0)], (F.col("o_orderkey") % 20 - 10) / 100.0)
    return roadxml.road_strings(o.select("o_orderkey", xml.alias("xml")), "xml", ["o_orderkey"])


@query("""SELECT CASE WHEN o_custkey % 3 = 0 THEN 'line' ELSE 'arc' END AS kind, count(*) AS geometries, round(sum((o_orderkey % 500 + 1) * 3.28084::DOUBLE), 2) AS length_ft, round(min(CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 800 + 100)::DOUBLE END), 4) AS least_radius, count(*) FILTER (WHERE false) AS errors FROM orders GROUP BY 1""")
def road_xml_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = roadxml.geometries(_roads(spark, sf_dir), ["o_orderkey"])
    return g.groupBy("kind").agg(F.count("*").alias("geometries"), F.round(F.sum("length_ft"), 2).alias("length_ft"), F.round(F.min("radius_ft"), 4).alias("least_radius"), F.count_if("error").alias("errors"))


@query("""SELECT param, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most FROM (SELECT 'lane_width' AS param, 9.0::DOUBLE + o_custkey % 6 AS value FROM orders UNION ALL SELECT 'lane_width', 12.0 FROM orders UNION ALL SELECT 'design_rad', o_custkey % 800 + 100 FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT 'grade', o_orderkey % 20 - 10 FROM orders) GROUP BY 1""")
def road_param_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roadxml.parameter_rows(_roads(spark, sf_dir), ["o_orderkey"])
    return rows.groupBy("param").agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))


@query("""SELECT n_regionkey::VARCHAR AS region, n_nationkey::VARCHAR AS nation, count(*) AS checked, count(*) FILTER (WHERE o_totalprice > 50000) AS valid, grouping(n_regionkey, n_nationkey)::INT AS level, round(count(*) FILTER (WHERE o_totalprice > 50000) / count(*), 6) AS rate
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def road_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates by region, nation and in all. Orders are summed by customer's nation before they meet the nations."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation")
    rows = o.select("o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").cast("string").alias("nation"), (F.col("o_totalprice") > 50000).alias("ok"))
    return metrics.pass_rates(rows, ["region", "nation"], F.col("ok"))


# --- Metrics --------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT lang, quality = 0 AS expected, length(text) < 500 AS found FROM labels JOIN documents USING (doc_id)), n AS (SELECT lang, count(*) FILTER (WHERE expected AND found) AS tp, count(*) FILTER (WHERE NOT expected AND NOT found) AS tn, count(*) FILTER (WHERE NOT expected AND found) AS fp, count(*) FILTER (WHERE expected AND NOT found) AS fn FROM r GROUP BY 1),
    p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n) SELECT lang, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") < 500).alias("found")), "doc_id")
    return metrics.confusion(r, F.col("quality") == 0, F.col("found"), ("lang",))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95))::BIGINT + 1], 6) AS p95 FROM events GROUP BY 1")
def latency_order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS opened, floor(epoch(max(ts)))::BIGINT AS last_change, count(*) AS changes FROM s GROUP BY user_id, k""")
def debounce_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(table(spark, sf_dir, "events"), ["user_id"], delay="1 day")
    return s.select("user_id", F.unix_seconds(F.col("opened").cast("timestamp")).alias("opened"), F.unix_seconds(F.col("last_change").cast("timestamp")).alias("last_change"), "changes")


# --- Acquisition ----------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey, lower(trim('The ' || p_type || ' (old)')) AS raw, p_type FROM part), n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(raw, '^(the|a|an)\\s+', ''), '\\s*\\([^)]*\\)$', '')) AS term FROM t)
    SELECT term, f.field, count(*) AS n FROM n LEFT JOIN (SELECT lower(p_type) AS alias, min(p_brand) AS field FROM part WHERE p_size < 10 AND p_partkey % 2 = 0 GROUP BY 1) f ON term = alias GROUP BY ALL""".replace("\\\\", "\\"))
def term_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    aliases = p.where("p_size < 10 AND p_partkey % 2 = 0").groupBy(F.lower("p_type").alias("alias")).agg(F.min("p_brand").alias("field"))
    t = p.select(F.concat(F.lit("The "), "p_type", F.lit(" (old)")).alias("term"))
    return acquire.known_terms(t, "term", aliases).groupBy(acquire.normal_term(F.col("term")).alias("term"), "field").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1400 THEN [1] ELSE range(1, length(text) + 1, 1250) END) AS start FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, ((start - 1) // 1250)::INT AS place, md5(trim(substr(text, start, 1400), E' \\t\\n\\r')) AS piece FROM s""".replace("\\\\", "\\"))
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = acquire.windows(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", 1400, 150)
    return w.select("doc_id", "place", F.md5(F.col("piece").cast("binary")).alias("piece"))


@query("""SELECT l_orderkey, string_agg(part, ' ' ORDER BY l_linenumber, part) AS source FROM (SELECT l_orderkey, l_linenumber, l_partkey || ':' || l_suppkey AS part, 'Chapter ' || l_suppkey AS chapter FROM lineitem) WHERE contains(chapter, '15') GROUP BY 1""")
def chunks_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as chunks of their orders, those whose chapter contains 15 joined in their order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(":", "l_partkey", "l_suppkey").alias("part"), F.concat(F.lit("Chapter "), "l_suppkey").alias("chapter"))
    return acquire.rejoined(l, ["l_orderkey"], "l_linenumber", "part", "chapter", "15")


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber", "l_quantity")
    found = l.where("l_linenumber < 4").select("src", "dst").distinct()
    told = F.element_at(F.array(*map(F.lit, ["see Equation 12-3", "the sum of both", "f = a + b", "by definition", "an eq. of old", "EXHIBIT 3", "threshold"])), F.col("l_linenumber").cast("int"))
    gold = l.where("l_quantity > 25").groupBy("src", "dst").agg(F.min_by(told, "l_linenumber").alias("description"), F.min("l_linenumber").alias("first"))
    audited = F.when(F.col("dst") % 5 == 0, "definitional").when(F.col("dst") % 5 == 1, "unknown")
    gold = gold.select("src", "dst", acquire.tier(F.when(F.col("dst") % 7 != 0, F.col("description")), audited).alias("tier"))
    return found, gold


_EDGES = """found AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber < 4), gold AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_suppkey % 5 = 0 THEN 'definitional' WHEN l_suppkey % 7 <> 0 AND min(l_linenumber) IN (1, 3, 5, 6, 7) THEN 'numeric' ELSE 'definitional' END AS tier FROM lineitem WHERE l_quantity > 25 GROUP BY l_partkey, l_suppkey)"""


@query(f"""WITH {_EDGES}, n AS (SELECT (SELECT count(*) FROM found) AS found, (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM found JOIN gold USING (src, dst)) AS confirmed) SELECT found, gold, confirmed, round(confirmed / found, 6) AS precision, round(confirmed / gold, 6) AS recall, round(2 * (confirmed / found) * (confirmed / gold) / (confirmed / found + confirmed / gold), 6) AS f1 FROM n""")
def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.scores(*_edges(spark, sf_dir)).select("found", "gold", "confirmed", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_EDGES} SELECT tier, count(*) AS gold, count(f.src) AS confirmed FROM gold g LEFT JOIN found f ON g.src = f.src AND g.dst = f.dst GROUP BY 1")
def tiered_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.tier_recall(*_edges(spark, sf_dir))


@query(f"""WITH {_EDGES}, b AS (SELECT f.src IS NOT NULL AS f, g.src IS NOT NULL AS g, tier FROM found f FULL JOIN gold g ON g.src = f.src AND g.dst = f.dst), n AS (SELECT 'all' AS tier, count(*) FILTER (f) AS found, count(*) FILTER (g) AS gold, count(*) FILTER (f AND g) AS confirmed FROM b
    UNION ALL SELECT tier, NULL, count(*), count(*) FILTER (f) FROM b WHERE g GROUP BY 1) SELECT tier, found, gold, confirmed, round(confirmed / found, 9) AS precision, round(confirmed / gold, 9) AS recall, CASE WHEN tier = 'all' THEN round(2 * confirmed / (found + gold), 9) END AS f1 FROM n""")
def tier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.tier_agreement(*_edges(spark, sf_dir)).select("tier", "found", "gold", "confirmed", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {_EDGES}, l AS (SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey * 10 + l_linenumber AS ord, CASE l_returnflag WHEN 'A' THEN 'definitional' WHEN 'N' THEN 'numeric' ELSE 'unstated' END AS said FROM lineitem),
    u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ord DESC, said DESC) = 1) SELECT tier, said, count(*) AS n FROM u JOIN gold USING (src, dst) GROUP BY ALL""")
def basis_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as extracted edges that claim a basis by their flag, the last of each pair, against the tiers of the curated ones."""
    basis = F.when(F.col("l_returnflag") == "A", "definitional").when(F.col("l_returnflag") == "N", "numeric").otherwise("")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), basis.alias("basis"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return acquire.basis_confusion(found, _edges(spark, sf_dir)[1])


@query(f"WITH {_EDGES} SELECT CASE WHEN g.src IS NULL THEN 'found only' WHEN f.src IS NULL THEN 'curated only' ELSE 'confirmed' END AS bucket, count(*) AS n FROM found f FULL JOIN gold g ON g.src = f.src AND g.dst = f.dst GROUP BY 1")
def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquire.agreement(*_edges(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""SELECT src, dst, 'f' || k AS evidence FROM (SELECT p_partkey AS k, 'in_' || p_size AS src, 'out_' || (p_size % 7) AS dst FROM part UNION SELECT p_partkey, 'in_' || ((p_size % 50) + 1), 'out_' || (p_size % 7) FROM part) WHERE src <> dst""")
def dataflow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges induced from code, a function for each part: what it reads against what it writes."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")  # a small file gives long texts
    code = parts.select("p_partkey", F.format_string("impl S { fn f%d(&self) { if true { self.out_%d = self.in_%d + self.in_%d; } } }", "p_partkey", F.col("p_size") % 7, "p_size", F.col("p_size") % 50 + 1).alias("code"))
    known = [f"in_{i}" for i in range(1, 52)] + [f"out_{i}" for i in range(7)]
    flow = acquire.dataflow(acquire.functions_of(code, ["p_partkey"], "code"), ["p_partkey"], known)
    return acquire.induced_pairs(flow).select("src", "dst", F.col("name").alias("evidence"))


_CODE = """impl S {{
pub fn new(lw: f64) -> S {{ self.out_0 = lw; self }}
fn get_in(&self) -> f64 {{ self.in_1 }}
pub fn step{k}(&mut self, fd: f64, i: usize) {{ if i == 0 {{ self.out_{d} += seg.get_in_{a}() * self.help{k}(2.0); }} }}
fn help{k}(&self, lw: f64) -> f64 {{ if self.in_{b} == 1.0 {{ lw }} else {{ self.unheard }} }}
pub fn find{k}_los(&self, s_pl: f64) -> char {{ 'A' }}
pub fn store{k}(&mut self, cap: f64) {{ s.set_capacity(cap); s.set_out_{d}(self.ffs_adj); }}
}}"""


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS a, p_size % 50 + 1 AS b, 'out_' || (p_size % 7) AS d FROM part), e AS (SELECT k, 'in_' || a AS src, d AS dst, 'step' AS f, 4 AS line FROM p UNION SELECT k, 'in_' || b, d, 'step', 4 FROM p UNION ALL SELECT k, unnest(['followers_density', 'lw']), d, 'step', 4 FROM p
    UNION ALL SELECT k, 'avg_speed', 'los', 'find', 6 FROM p UNION ALL SELECT k, 'ffs', unnest([d, 'capacity']), 'store', 7 FROM p)
    SELECT k AS p_partkey, src, dst, f || k || CASE f WHEN 'find' THEN '_los' ELSE '' END AS name, line FROM e""")
def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a source text for each part: getters, arguments, aliases (a known name stands for itself), helpers, setters, and outputs told by a name; what is set isn't read (cap, of the last function)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")  # a small file gives long texts
    text = F.lit(_CODE.replace("{{", "{ ").replace("}}", " }"))
    for at, c in (("{k}", F.col("p_partkey")), ("{a}", F.col("p_size")), ("{b}", F.col("p_size") % 50 + 1), ("{d}", F.col("p_size") % 7)):
        text = F.replace(text, F.lit(at), c.cast("string"))
    known = [f"in_{i}" for i in range(1, 52)] + [f"out_{i}" for i in range(7)] + ["followers_density", "lw", "lane_width", "avg_speed", "los", "capacity", "ffs"]
    return acquire.code_edges(p.select("p_partkey", text.alias("code")), ["p_partkey"], "code", known).select("p_partkey", "src", "dst", "name", "line")
