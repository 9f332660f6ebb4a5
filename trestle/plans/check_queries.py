"""Queries over rule checks: designs against rules, formulas, semantic constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.functions.formula import compiled, floor_mod, references
from trestle.operators import cases, checks, clarify
from trestle.plans.registry import query
from trestle.sources.designs import KEY, designs, designs_sql, long_format, table, values_of
from trestle.sources.rules import RADIUS, SEMANTIC, rules, rules_sql
from trestle.sources.tables import literal

K = ", ".join(KEY)


def _long_sql(*ps: str) -> str:
    return " UNION ALL ".join(f"SELECT {K}, '{p}' AS param, {p} AS value FROM d" for p in ps)


def _broken_sql(v: str = "value") -> str:
    return f"""CASE WHEN rule_type IN ('range', 'min') AND ({v} < lo OR (lo_open AND {v} = lo)) THEN 'below' WHEN rule_type IN ('range', 'max') AND ({v} > hi OR (hi_open AND {v} = hi)) THEN 'above'
        WHEN rule_type = 'enum' AND NOT list_contains(allowed, ({v})::VARCHAR) THEN 'not allowed' END"""


RULED = ["lane_width", "shoulder_width", "design_rad", "spl", "grade", "phf", "hor_class", "passing_type"]
CHECKED = f"""WITH d AS ({designs_sql(*RULED)}), long AS ({_long_sql(*RULED)}), rules AS ({rules_sql()}), checked AS (SELECT *, {_broken_sql()} AS broken FROM long JOIN rules USING (param))"""


def _checked(spark: SparkSession, sf_dir: str, kinds: str | None = None) -> DataFrame:
    params = long_format(designs(spark, sf_dir, *RULED), KEY, RULED)
    some = rules(spark) if kinds is None else rules(spark).where(kinds)
    return checks.checked(params, some)


@query(f"{CHECKED} SELECT rule_id, severity, citation, count(*) AS violations, round(min(value), 6) AS least, round(max(value), 6) AS most FROM checked WHERE broken IS NOT NULL GROUP BY ALL")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.rollup_severity(_checked(spark, sf_dir))


def _bounds(kind: str) -> tuple[str, str]:
    where = f"rule_type IN {kind}"
    return where, f"{CHECKED} SELECT rule_id, param, broken, count(*) AS n FROM checked WHERE {where} AND broken IS NOT NULL GROUP BY ALL"


@query(_bounds("('range')")[1])
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, _bounds("('range')")[0]).where("broken IS NOT NULL").groupBy("rule_id", "param", "broken").agg(F.count("*").alias("n"))


@query(_bounds("('min', 'max')")[1])
def min_max_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, _bounds("('min', 'max')")[0]).where("broken IS NOT NULL").groupBy("rule_id", "param", "broken").agg(F.count("*").alias("n"))


@query(f"{CHECKED} SELECT {K}, param, value FROM checked WHERE rule_type = 'enum' AND broken IS NOT NULL")
def enum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "rule_type = 'enum'").where("broken IS NOT NULL").select(*KEY, "param", "value")


@query(f"{CHECKED} SELECT rule_type, severity, count(*) AS checks, count(broken) AS violations FROM checked GROUP BY ALL")
def rule_dispatch_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).groupBy("rule_type", "severity").agg(F.count("*").alias("checks"), F.count("broken").alias("violations"))


def _verdict_sql(strict: bool) -> str:
    more = " AND count(*) FILTER (WHERE broken IS NOT NULL AND severity <> 'error') = 0" if strict else ""
    return f"""{CHECKED} SELECT {K}, count(*) FILTER (WHERE broken IS NOT NULL AND severity = 'error') AS errors, count(*) FILTER (WHERE broken IS NOT NULL AND severity <> 'error') AS warnings,
        count(*) FILTER (WHERE broken IS NOT NULL AND severity = 'error') = 0{more} AS is_valid FROM checked GROUP BY {K}"""


@query(_verdict_sql(False))
def engine_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.row_verdicts(designs(spark, sf_dir, *RULED), KEY, RULED, rules(spark))


@query(_verdict_sql(True))
def strict_mode_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.row_verdicts(designs(spark, sf_dir, *RULED), KEY, RULED, rules(spark), strict=True)


@query(f"{CHECKED} SELECT rule_id, count(*) AS n FROM checked WHERE broken IS NOT NULL AND severity = 'error' GROUP BY 1")
def violation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).where("broken IS NOT NULL AND severity = 'error'").groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"WITH d AS ({designs_sql(*RULED)}), long AS ({_long_sql(*RULED)}), rules AS ({rules_sql()}) SELECT param, rule_type, count(*) AS records FROM long JOIN rules USING (param) GROUP BY ALL")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).groupBy("param", "rule_type").agg(F.count("*").alias("records"))


FORMULAS = {
    "sight": "design_rad >= 1.47 * spl * 2.5 + spl ** 2 / (30 * (0.35 + grade / 100))",
    "total_width": "18 <= 2 * lane_width + shoulder_width <= 30",
    "steep_implies_slow": "abs(grade) > 8 implies spl < 60 and lane_width >= 9",
    "flow": "min(phf, 0.95) * max(lane_width, shoulder_width) > sqrt(spl) or hor_class in [0, 1, 2]",
    "undefined": "spl / (lane_width - 10) > 20",
    "rounded": "round(shoulder_width) % 3 == 1 and not passing_type == 2",
}
_SQL_FORMULAS = {
    "sight": "design_rad >= 1.47 * spl * 2.5 + spl ** 2 / (30 * (0.35 + grade / 100))",
    "total_width": "18 <= 2 * lane_width + shoulder_width AND 2 * lane_width + shoulder_width <= 30",
    "steep_implies_slow": "NOT (abs(grade) > 8) OR (spl < 60 AND lane_width >= 9)",
    "flow": "least(phf, 0.95) * greatest(lane_width, shoulder_width) > sqrt(spl) OR hor_class IN (0, 1, 2)",
    "undefined": "CASE WHEN lane_width = 10 THEN NULL ELSE spl / (lane_width - 10) > 20 END",
    "rounded": "round_even(shoulder_width, 0) - 3 * floor(round_even(shoulder_width, 0) / 3) = 1 AND NOT passing_type = 2",
}


def _formulas(wide: DataFrame) -> DataFrame:
    one = F.array(*(F.struct(F.lit(n).alias("formula"), compiled(f, F.col).alias("kept")) for n, f in FORMULAS.items()))
    return wide.select(F.explode(one).alias("_")).select("_.*")


@query(f"WITH d AS ({designs_sql()}), f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS formula, {f} AS kept FROM d" for n, f in _SQL_FORMULAS.items()) + ") SELECT formula, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS broken, count(*) FILTER (WHERE kept IS NULL) AS skipped FROM f GROUP BY 1")
def formula_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("kept")
    return _formulas(designs(spark, sf_dir)).groupBy("formula").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("broken"), F.count_if(kept.isNull()).alias("skipped"))


@query(f"""WITH d AS ({designs_sql("spl", "grade", "design_rad")}), m AS (SELECT {K}, list_filter(['design_rad', 'spl', 'grade'], lambda p: NOT list_contains(list_filter([CASE WHEN spl <> 30 THEN 'spl' END, CASE WHEN grade > 0 THEN 'grade' END, 'design_rad'], lambda x: x IS NOT NULL), p)) AS missing FROM d)
    SELECT {K}, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0""")
def formula_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir, "spl", "grade", "design_rad").withColumn("spl", F.when(F.col("spl") != 30, F.col("spl"))).withColumn("grade", F.when(F.col("grade") > 0, F.col("grade")))
    needed = F.array(*map(F.lit, references(FORMULAS["sight"])))
    missing = clarify.missing_inputs(needed, F.map_keys(values_of(d, ["spl", "grade", "design_rad"])))
    return d.select(*KEY, missing.alias("_m")).where(F.size("_m") > 0).select(*KEY, F.array_join("_m", ",").alias("missing"))


@query("SELECT a % 7 AS k, round(sum((a - 25) - (b - 5) * floor((a - 25) / nullif(b - 5, 0)::DOUBLE)), 6) AS total, count(*) AS n FROM (SELECT l_quantity::BIGINT AS a, l_linenumber::BIGINT AS b FROM lineitem) GROUP BY 1")
def mod_floor_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("bigint").alias("a"), F.col("l_linenumber").cast("bigint").alias("b"))
    m = floor_mod((F.col("a") - 25).cast("double"), (F.col("b") - 5).cast("double"))
    return q.groupBy((F.col("a") % 7).alias("k")).agg(F.round(F.sum(m), 6).alias("total"), F.count("*").alias("n"))


def _radius_sql() -> str:
    rows = ", ".join(f"({a}, {ra}, {b}, {rb})" for (a, ra), (b, rb) in zip(RADIUS, RADIUS[1:], strict=False))
    return f"SELECT * FROM (VALUES {rows}) AS r(s0, r0, s1, r1)"


def _semantic_sql() -> str:
    parts = []
    for rule, p, lo, hi, allowed, severity, _ in SEMANTIC:
        broken = f"CASE WHEN {p} < {lo} THEN 'below' WHEN {p} > {hi} THEN 'above' END" if allowed is None else f"CASE WHEN {p} NOT IN ({', '.join(map(str, allowed))}) THEN 'not allowed' END"
        parts.append(f"SELECT {K}, '{rule}' AS rule, '{p}' AS param, {broken} AS broken, '{severity}' AS severity FROM d WHERE {p} IS NOT NULL")
    parts.append(f"SELECT {K}, 'SV-005', 'design_rad', CASE WHEN design_rad < least THEN 'below' END, 'error' FROM rad WHERE least IS NOT NULL AND design_rad IS NOT NULL")
    return " UNION ALL ".join(parts)


RAD = f"""rad AS (SELECT d.*, CASE WHEN spl = 15 THEN 50 ELSE trunc(r0 + (spl - s0) * ((r1 - r0)::DOUBLE / (s1 - s0))) END AS least FROM d LEFT JOIN ({_radius_sql()}) ON spl > s0 AND spl <= s1)"""
#: The same for the speed cut to a whole number.
WHOLE = RAD.replace("spl", "trunc(spl)")
_FRACTIONS = designs_sql().replace(" FROM lineitem", "").replace("cast(25 + 5 * (l_partkey % 12) AS double) AS spl", "cast(25 + 5 * (l_partkey % 12) + (l_suppkey % 5) / 4.0 AS double) AS spl") + " FROM lineitem"


@query(f"WITH d AS ({_FRACTIONS}), {WHOLE}, c AS ({_semantic_sql()}) SELECT rule, param, broken, severity, count(*) AS n FROM c GROUP BY ALL")
def semantic_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixed checks of all designs, whose speeds have fractions."""
    d = designs(spark, sf_dir).withColumn("spl", F.col("spl") + (F.col("l_suppkey") % 5) / F.lit(4.0))
    return checks.semantic_tally(d, d.columns)


@query("WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice, (l_partkey % 1000) / 12.0 AS spl FROM lineitem), " + RAD + " SELECT spl, least, count(*) AS n FROM rad GROUP BY ALL")
def speed_radius_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") % 1000) / F.lit(12.0)).alias("spl"))
    return d.withColumn("least", checks.least_radius(F.col("spl"))).groupBy("spl", "least").agg(F.count("*").alias("n"))


_NESTED = ["design_rad", "grade", "passing_type", "hor_class", "vertical_class", "phf", "phv", "spl"]


def _nested_sql() -> str:
    own = [f"SELECT o_orderkey AS l_orderkey, '{r}' AS rule, '{p}' AS param, {p} AS value, '{s}' AS severity FROM w WHERE {p} < {lo} OR {p} > {hi}" for r, p, lo, hi, _, s, _ in SEMANTIC if p in checks.HIGHWAY]
    for r, p, lo, hi, allowed, s, _ in SEMANTIC:
        if p in checks.SEGMENT:
            own.append(f"SELECT l_orderkey, '{r}', 'segments[' || i || '].{p}', {p}, '{s}' FROM s WHERE " + (f"{p} NOT IN {allowed}" if allowed else f"{p} < {lo} OR {p} > {hi}"))
    own.append("SELECT l_orderkey, 'SV-005', 'segments[' || i || '].subsegments[0].design_rad', design_rad, 'error' FROM rad WHERE design_rad < least")
    return f"""WITH w AS (SELECT o_orderkey, (8 + o_custkey % 6)::DOUBLE AS lane_width, (o_custkey % 11)::DOUBLE AS shoulder_width FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
        s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(KEY[1:])}) - 1 AS i, * EXCLUDE (l_orderkey) FROM ({designs_sql(*_NESTED)})), {RAD.replace("FROM d ", "FROM s AS d ")} {" UNION ALL ".join(own)}"""


@query(_nested_sql())
def nested_highway_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as highways: each item is a segment with one curve, held against the segment's speed."""
    d = designs(spark, sf_dir, *_NESTED)
    segment = F.struct(*KEY[1:], *_NESTED[1:], F.array(F.struct("design_rad")).alias("subsegments"))
    nested = d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (8 + F.col("o_custkey") % 6).cast("double").alias("lane_width"), (F.col("o_custkey") % 11).cast("double").alias("shoulder_width"))
    return checks.nested_violations(o.join(nested, "l_orderkey"), ["l_orderkey"])


@query(f"""WITH d AS (SELECT {K}, nullif(8.0 + (l_linenumber % 6), 9.0) AS lane_width, nullif(l_linenumber % 4, 0) AS passing_type, CASE WHEN l_quantity > 5 THEN l_quantity END AS apd FROM lineitem),
    n AS (SELECT (lane_width IS NOT NULL)::INT + (passing_type IS NOT NULL)::INT AS checked, (lane_width IS NOT NULL)::INT + (passing_type IS NOT NULL)::INT + (apd IS NOT NULL)::INT AS supplied FROM d)
    SELECT checked, supplied, CASE WHEN checked = 0 THEN 'none' WHEN checked < supplied THEN 'partial' ELSE 'covered' END AS coverage, checked = 0 AS abstained, count(*) AS n FROM n GROUP BY ALL""")
def coverage_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.expr("nullif(cast(8.0 + (l_linenumber % 6) AS double), 9.0D) AS lane_width"), F.expr("nullif(l_linenumber % 4, 0) AS passing_type"), F.expr("CASE WHEN l_quantity > 5 THEN l_quantity END AS apd"))
    n = d.select(F.size(checks.semantic({"lane_width", "passing_type"})).alias("checked"), checks.supplied(d.columns).alias("supplied"))
    return n.withColumn("coverage", checks.coverage(F.col("checked"), F.col("supplied"))).withColumn("abstained", F.col("checked") == 0).groupBy("checked", "supplied", "coverage", "abstained").agg(F.count("*").alias("n"))


_GATE = "lane_width IS NULL AND design_rad IS NULL AND spl IS NULL"


@query(f"""WITH d AS (SELECT nullif(8.0 + (l_linenumber % 6), 9.0) AS lane_width, CASE WHEN l_quantity > 10 THEN l_extendedprice / 40.0 END AS design_rad, CASE WHEN l_quantity < 40 THEN 25 + 5 * (l_partkey % 12) END::DOUBLE AS spl FROM lineitem), {RAD},
    g AS (SELECT *, (coalesce(lane_width < 9 OR lane_width > 12, false))::INT + (coalesce(design_rad < least, false))::INT AS errors FROM rad)
    SELECT CASE WHEN {_GATE} THEN 'empty' WHEN errors > 0 THEN 'rejected' WHEN (design_rad IS NULL) <> (spl IS NULL) THEN 'incomplete' ELSE 'accepted' END AS outcome, errors, count(*) AS n FROM g GROUP BY ALL""")
def firewall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are empty, break a rule, give half of a pair, or pass; warnings don't count."""
    d = table(spark, sf_dir, "lineitem").select(F.expr("nullif(cast(8.0 + (l_linenumber % 6) AS double), 9.0D) AS lane_width"), F.expr("CASE WHEN l_quantity > 10 THEN l_extendedprice / 40.0 END AS design_rad"), F.expr("cast(CASE WHEN l_quantity < 40 THEN 25 + 5 * (l_partkey % 12) END AS double) AS spl"))
    outcome = F.when(F.expr(_GATE), 0).when(F.col("errors") > 0, 1).when(F.col("design_rad").isNull() != F.col("spl").isNull(), 2).otherwise(3)
    counts = d.withColumn("errors", checks.semantic_errors(d.columns)).groupBy(outcome.alias("_o"), "errors").agg(F.count("*").alias("n"))  # numbers as keys; names come after
    return counts.select(F.get(F.array(*map(F.lit, ["empty", "rejected", "incomplete", "accepted"])), F.col("_o")).alias("outcome"), "errors", "n")


@query("""WITH p AS (SELECT p_partkey, p_size / 10.0 AS value, CASE p_partkey % 4 WHEN 0 THEN 'ft' WHEN 1 THEN 'mph' WHEN 2 THEN 'in' ELSE 'kg' END AS unit, 9.0 AS lo, 12.0 AS hi FROM part), u AS (SELECT * FROM (VALUES ('ft', 3.28084), ('in', 0.393701), ('mi', 0.621371), ('mph', 0.621371)) AS u(unit, factor))
    SELECT p_partkey, value, unit FROM p JOIN u USING (unit) WHERE (value < lo OR value > hi) AND value * factor >= lo * (1 - 0.15) AND value * factor <= hi * (1 + 0.15)""")
def unit_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(10.0)).alias("value"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'ft' WHEN 1 THEN 'mph' WHEN 2 THEN 'in' ELSE 'kg' END AS unit"))
    return p.where(clarify.unit_conflict(F.col("value"), F.col("unit"), F.lit(9.0), F.lit(12.0)))


@query("""WITH b AS (SELECT * FROM (VALUES (8.9::DOUBLE), (9.0), (9.1), (11.9), (12.0), (12.1)) AS b(v)) SELECT l_linenumber, v AS lane_width, v >= 9 AND v <= 12 AS expected_valid, count(*) AS n FROM lineitem, b GROUP BY ALL""")
def boundary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases around the bounds of a rule, on every record; labelled by the check itself."""
    v = F.explode(F.array(*(F.lit(x) for x in (8.9, 9.0, 9.1, 11.9, 12.0, 12.1))))
    d = table(spark, sf_dir, "lineitem").select("l_linenumber", v.alias("lane_width"))
    ok = F.get(checks.semantic({"lane_width"}), 0)["broken"].isNull()
    return d.groupBy("l_linenumber", "lane_width", ok.alias("expected_valid")).agg(F.count("*").alias("n"))


def _cases_sql() -> str:
    """The cases by their statement: digits of hashes, values by category, and labels by the bounds themselves."""
    listed = lambda values: "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"
    def digit(sizes: list[int], draw: int = 0) -> list[str]:
        out, below = [], 1
        for size in sizes:
            if below * size > 2**40:
                draw, below = draw + 1, 1
            out.append(f"((d{draw} // {below}) % {size})")
            below *= size
        return out
    speeds, least = listed(cases.SPEEDS), "[50, 90, 170, 230, 340, 430, 560, 710, 835, 1000, 1150, 1310, 1560]"
    pick = lambda values, d: f"{listed(values)}[{d} + 1]"
    l, s, h, t, v, o = digit([301, 601, 6, 3, 13, 501])
    which, side, low, al, ash, wc, wt, share = digit([5, 2, 391, 791, 491, 6, 4, 451], 1)
    m, c1, c2, c3, ml, ms, mh, mt, mv, fair, up, down = digit([4, 2, 2, 10, 14, 11, 9, 6, 13, 2, 501, 151])
    fl, fs, fh, ft, fv, fr = digit([1501, 1701, 12, 7, 13, 19501])
    road = f"({m} = 3 OR {c3} >= 4)"
    rows = ", ".join(f"({i}, '{k}', " + ", ".join("NULL" if x.get(p) is None else f"{x[p]!r}" for p in cases.FIELDS) + ")" for i, (k, x) in enumerate(cases.boundaries()))
    fields = ", ".join(cases.FIELDS)
    return f"""WITH t AS (SELECT count(*) AS total FROM lineitem), k AS (SELECT * FROM (VALUES {rows}) AS k(number, category, {fields})), b AS (SELECT count(*) AS known, greatest(0, any_value(total) - count(*)) AS rest FROM k, t),
    n AS (SELECT unnest(range((SELECT greatest(total, known) FROM t, b))) AS number), d AS (SELECT number, known, rest, {", ".join(f"('0x' || substr(md5(number || ':42:{i}'), 1, 15))::BIGINT AS d{i}" for i in range(3))} FROM n, b WHERE number >= known),
    c AS (SELECT *, CASE WHEN number < known + rest // 5 THEN 'valid_only' WHEN number < known + 2 * (rest // 5) THEN 'invalid_only' WHEN number < known + 2 * (rest // 5) + rest // 4 THEN 'combinatorial' ELSE 'random' END AS category FROM d),
    v AS (SELECT number, category, CASE category WHEN 'combinatorial' THEN {pick(cases.LANE_WIDTHS, ml)} WHEN 'random' THEN (500 + {fl}) / 100.0::DOUBLE WHEN 'valid_only' THEN (900 + {l}) / 100.0::DOUBLE ELSE CASE WHEN {which} <> 0 THEN (900 + {l}) / 100.0::DOUBLE WHEN {side} = 0 THEN (500 + {low}) / 100.0::DOUBLE ELSE (1210 + {al}) / 100.0::DOUBLE END END AS lane_width,
        CASE category WHEN 'combinatorial' THEN {pick(cases.SHOULDER_WIDTHS, ms)} WHEN 'random' THEN ({fs} - 200) / 100.0::DOUBLE WHEN 'valid_only' THEN (400 + {s}) / 100.0::DOUBLE ELSE CASE WHEN {which} <> 1 THEN (400 + {s}) / 100.0::DOUBLE WHEN {side} = 0 THEN {low} / 100.0::DOUBLE ELSE (1010 + {ash}) / 100.0::DOUBLE END END AS shoulder_width,
        CASE category WHEN 'combinatorial' THEN CASE WHEN {m} >= 1 OR {c1} = 0 THEN {pick(cases.HOR_CLASSES, mh)} END WHEN 'random' THEN {fh} - 1 WHEN 'valid_only' THEN {h} ELSE CASE WHEN {which} <> 2 THEN {h} ELSE {pick(cases.WRONG_CLASSES, wc)} END END AS hor_class,
        CASE category WHEN 'combinatorial' THEN CASE WHEN {m} >= 2 OR {c2} = 0 THEN {pick(cases.PASSING_TYPES, mt)} END WHEN 'random' THEN {ft} - 1 WHEN 'valid_only' THEN {t} ELSE CASE WHEN {which} <> 3 THEN {t} ELSE {pick(cases.WRONG_TYPES, wt)} END END AS passing_type,
        CASE category WHEN 'combinatorial' THEN CASE WHEN {road} THEN CASE WHEN {fair} = 0 THEN {least}[{mv} + 1] + {up} ELSE greatest(50, {least}[{mv} + 1] - 50 - {down}) END END WHEN 'random' THEN (500 + {fr}) / 10.0::DOUBLE WHEN 'valid_only' THEN {least}[{v} + 1] + {o}
            ELSE CASE WHEN {which} <> 4 THEN {least}[{v} + 1] + {o} ELSE greatest(10.0::DOUBLE, floor({least}[{v} + 1] * (500 + {share}) / 100.0::DOUBLE) / 10.0::DOUBLE) END END AS design_rad,
        CASE category WHEN 'combinatorial' THEN CASE WHEN {road} THEN {speeds}[{mv} + 1] END WHEN 'random' THEN {speeds}[{fv} + 1] ELSE {speeds}[{v} + 1] END AS spl FROM c UNION ALL SELECT * FROM k),
    r AS (SELECT v.*, concat_ws(',', CASE WHEN lane_width NOT BETWEEN 9 AND 12 THEN 'SF-001' END, CASE WHEN shoulder_width NOT BETWEEN 4 AND 10 THEN 'SF-002' END, CASE WHEN hor_class NOT BETWEEN 0 AND 5 THEN 'SF-003' END, CASE WHEN passing_type NOT BETWEEN 0 AND 2 THEN 'SF-004' END,
        CASE WHEN design_rad < {least}[list_position({speeds}, spl)] THEN 'SF-005' END) AS expected_violations FROM v)
    SELECT number, category, {", ".join(f"{f}::DOUBLE AS {f}" for f in cases.FIELDS)}, expected_violations, expected_violations = '' AS expected_valid FROM r"""


@query(_cases_sql())
def adversarial_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many test cases as there are items: at bounds, valid, invalid in one way, in combination, and random."""
    total = table(spark, sf_dir, "lineitem").count()
    numbers = spark.range(max(total, len(cases.boundaries()))).withColumnRenamed("id", "number")
    return cases.cases(numbers, total).withColumn("expected_violations", F.array_join("expected_violations", ","))


# --- The whole validation: orders as records of three parameters ---------------------------------------------------

_WHOLE = """o AS (SELECT o_orderkey AS record, (8 + o_custkey % 6)::DOUBLE AS lw, CASE WHEN o_orderkey % 3 <> 0 THEN (25 + 5 * (o_custkey % 12))::DOUBLE END AS spl, o_totalprice / 100 AS design_rad, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 2 = 0 END AS level FROM orders),
    v AS (SELECT *, CASE WHEN lw < 9 OR lw > 12 THEN 1 END AS one, CASE WHEN level AND design_rad < spl ** 2 / 3 THEN 2 END AS two, CASE WHEN spl > 70 THEN 3 END AS three FROM o)"""


def _whole(spark: SparkSession, sf_dir: str, asking: bool = False) -> tuple[DataFrame, DataFrame]:
    """asking: with rules that depend on contexts or lack inputs in several ways, none of which is ever broken, and a parameter that may be metric."""
    from trestle.plans import engine

    o = table(spark, sf_dir, "orders")
    given = F.array(
        F.struct(F.lit("Lane-Width").alias("param"), (8 + F.col("o_custkey") % 6).cast("double").alias("value_num")),
        F.struct(F.lit("speed").alias("param"), F.when(F.col("o_orderkey") % 3 != 0, 25 + 5 * (F.col("o_custkey") % 12)).cast("double").alias("value_num")),
        F.struct(F.lit("Radius").alias("param"), (F.col("o_totalprice") / 100).alias("value_num")), F.struct(F.lit("odd").alias("param"), F.lit(1.0).alias("value_num")),
        *([F.struct(F.lit("shoulder").alias("param"), F.when(F.col("o_orderkey") % 7 == 0, 1.8).otherwise(6.0).alias("value_num"))] if asking else []),
    )
    params = o.select(F.col("o_orderkey").alias("record"), F.posexplode(given).alias("ord", "_")).select("record", "ord", "_.*", F.lit(None).cast("string").alias("value_str")).where("value_num IS NOT NULL")
    terrain = F.when(F.col("o_custkey") % 2 == 0, "level").otherwise("rolling")
    contexts = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("record"), F.create_map(F.lit("terrain"), terrain).alias("context"))
    keys = literal(spark, [("lane-width", "lw"), ("speed", "spl"), ("radius", "design_rad"), ("shoulder", "sw")], "key string, field string")
    columns = "field string, rule_id int, rule_type string, severity string, lo double, hi double, lo_open boolean, hi_open boolean, allowed array<string>, citation string, conditions array<struct<type:string,value:string>>, formula string"
    corpus = [("lw", 1, "range", "error", 9.0, 12.0, False, False, None, "M", [], None), ("design_rad", 2, "formula", "error", None, None, None, None, None, "M", [("terrain", "level")], "design_rad >= spl ** 2 / 3"), ("spl", 3, "max", "warning", None, 70.0, False, False, None, "M", None, None)]
    if asking:
        corpus += [
            ("design_rad", 4, "formula", "error", None, None, None, None, None, "M", [], "design_rad > 100 * superelevation + grade"), ("design_rad", 5, "min", "error", -1.0, None, False, False, None, "M", [("terrain", "rolling")], None),
            ("lw", 6, "min", "error", -1.0, None, False, False, None, "M", [("terrain", "mountainous"), ("city", "urban")], None), ("lw", 7, "min", "error", -1.0, None, False, False, None, "M", [("terrain", "level")], None),
            ("design_rad", 8, "formula", "error", None, None, None, None, None, "M", [], "phf * design_rad > superelevation"),
        ]
    units = literal(spark, [("sw", "ft", 4.0, 8.0)], "field string, unit string, typical_min double, typical_max double") if asking else None
    corpus = [(*r[:10], None if r[10] is None else [{"type": t, "value": v} for t, v in r[10]], r[11]) for r in corpus]
    return engine.validate(params, contexts, keys, literal(spark, corpus, columns), units)


@query(f"""WITH {_WHOLE} SELECT record, (one IS NOT NULL)::BIGINT + (two IS NOT NULL)::BIGINT AS errors, (three IS NOT NULL)::BIGINT AS warnings, 1::BIGINT AS unknown, one IS NULL AND two IS NULL AS is_valid, concat_ws(',', one, two, three) AS violated FROM v""")
def whole_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved, contexts gated, values and formulas checked, for all records at once."""
    verdicts, _ = _whole(spark, sf_dir)
    return verdicts.select("record", "errors", "warnings", "unknown", "is_valid", F.array_join(F.transform("violations", lambda x: x["rule_id"].cast("string")), ",").alias("violated"))


@query(f"""WITH {_WHOLE}
    SELECT record, 'ambiguous_context' AS kind, 'terrain' AS parameter, 'level,mountainous' AS options, 'design_rad,lw' AS related, 'Which terrain (level, mountainous)? lw has rules that depend on it: rule 6, rule 7' AS message FROM o WHERE level IS NULL
    UNION ALL SELECT record, 'ambiguous_context', 'city', 'urban', 'lw', 'Which city (urban)? lw has rules that depend on it: rule 6' FROM o WHERE level IS NULL
    UNION ALL SELECT record, 'missing_parameter', 'spl', '', 'spl', 'What is spl? rule 2 on design_rad can''t be checked without' FROM o WHERE level AND spl IS NULL
    UNION ALL SELECT record, 'missing_parameter', NULL, '', 'grade,phf,superelevation', 'What is grade, superelevation? rule 4 on design_rad can''t be checked without' FROM o
    UNION ALL SELECT record, 'unit_conflict', 'sw', '', '', 'sw = 1.8 ft is outside of 4 to 8; are these meters (5.91 ft)?' FROM o WHERE record % 7 = 0""")
def whole_validation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validation has to ask: contexts that decide rules, with what they may be; inputs that formulas need, once a rule; values that look metric."""
    _, asks = _whole(spark, sf_dir, asking=True)
    return asks.select("record", "kind", "parameter", F.array_join("options", ",").alias("options"), F.array_join("related", ",").alias("related"), "message")
