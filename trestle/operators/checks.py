"""Checks of long-format parameters against rules, as joins with the rules and one conditional expression."""

from __future__ import annotations

import math
from collections.abc import Callable, Collection
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.sources.rules import RADIUS, SEMANTIC


def below(v: Column, lo: Column, open_: Column) -> Column:
    """Whether v breaks a lower bound; NaN and null break nothing, an open bound is broken by itself."""
    return ~F.isnan(v) & ((v < lo) | (open_ & (v == lo)))


def above(v: Column, hi: Column, open_: Column) -> Column:
    return ~F.isnan(v) & ((v > hi) | (open_ & (v == hi)))


def violation(v: Column, text: Column) -> Column:
    """`below`, `above` or `not allowed`, by the kind of the rule in rule_type; null if v keeps it, or the kind isn't evaluated."""
    kind = F.col("rule_type")
    low = F.when(kind.isin("range", "min") & below(v, F.col("lo"), F.col("lo_open")), "below")
    high = F.when(kind.isin("range", "max") & above(v, F.col("hi"), F.col("hi_open")), "above")
    enum = F.when((kind == "enum") & (F.size("allowed") > 0) & ~F.array_contains("allowed", text), "not allowed")
    return F.coalesce(low, high, enum)


def checked(params: DataFrame, rules: DataFrame, value: str = "value") -> DataFrame:
    """params with a rule's columns and `broken` for each rule on its parameter.

    params: param and value. The rules are a corpus, not data: they stay far below any broadcast bound, and the join needs no shuffle; a corpus too
    large for that is joined as Spark sees fit, as no hint is given.
    """
    return params.join(rules, "param").withColumn("broken", violation(F.col(value), F.col(value).cast("string")))


def verdicts(results: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """keys, errors, warnings, is_valid: only errors fail a record, with strict warnings too. results: checked()."""
    bad = F.col("broken").isNotNull()
    out = results.groupBy(*keys).agg(F.count_if(bad & (F.col("severity") == "error")).alias("errors"), F.count_if(bad & (F.col("severity") != "error")).alias("warnings"))
    valid = F.col("errors") == 0
    return out.withColumn("is_valid", valid & (F.col("warnings") == 0) if strict else valid)


def least_radius(speed: Column) -> Column:
    """The smallest curve radius for a speed, between the table's rows by straight lines, cut to whole feet; null outside the table."""
    pieces = [F.when((speed > s0) & (speed <= s1), F.floor(r0 + (speed - s0) * ((r1 - r0) / (s1 - s0)))) for (s0, r0), (s1, r1) in zip(RADIUS, RADIUS[1:], strict=False)]
    return F.coalesce(F.when(speed == RADIUS[0][0], RADIUS[0][1]), *pieces).cast("double")


def whole_speed(speed: Column) -> Column:
    """A speed cut to a whole number, towards zero; null for NaN."""
    v = speed.cast("double")
    return F.when(~F.isnan(v), F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))).cast("double")


def _radii() -> list[float]:
    """The least radius of every whole speed of the table, from its first on."""
    out = [float(RADIUS[0][1])]
    for (s0, r0), (s1, r1) in zip(RADIUS, RADIUS[1:], strict=False):
        out += [float(math.floor(r0 + (s - s0) * ((r1 - r0) / (s1 - s0)))) for s in range(s0 + 1, s1 + 1)]
    return out


def least_radius_whole(speed: Column) -> Column:
    """least_radius() of whole speeds, looked up: a tenth of the code."""
    place = F.when(speed.between(RADIUS[0][0], RADIUS[-1][0]), speed - RADIUS[0][0]).cast("int")
    return F.get(F.array(*map(F.lit, _radii())), place)


class Check(NamedTuple):
    """A fixed check of a row: its rule, the parameter that it names, its severity, whether the row has what it needs, how it is broken (null if kept), and all that as a number.

    end: 0 if the row hasn't what it needs, 1 if the check is kept, 2 if it is broken (of two ways the first, below), 3 if it is broken above.
    """

    rule: str
    param: str
    severity: str
    there: Column
    broken: Column
    end: Column


def fixed_checks(columns: Collection[str], constraints: list = SEMANTIC, at: Callable[[str], Column] = F.col) -> list[Check]:
    """All fixed checks that the columns allow, as plain columns. at: where a parameter is."""
    found = []
    for rule, p, lo, hi, allowed, severity, _ in constraints:
        if p in columns:
            v = at(p).cast("double")
            if allowed is None:
                low, high = below(v, F.lit(lo), F.lit(False)), above(v, F.lit(hi), F.lit(False))
                broken, end = F.when(low, "below").when(high, "above"), F.when(v < lo, 2).when((v > hi) & ~F.isnan(v), 3)
            else:
                other = ~v.isin([float(a) for a in allowed])
                broken, end = F.when(other, "not allowed"), F.when(other, 2)
            found.append(Check(rule, p, severity, v.isNotNull(), broken, F.when(v.isNull(), 0).otherwise(end.otherwise(1))))
    if {"design_rad", "spl"} <= set(columns):
        radius, least = at("design_rad").cast("double"), least_radius_whole(whole_speed(at("spl")))
        there = least.isNotNull() & radius.isNotNull()
        found.append(Check("SV-005", "design_rad", "error", there, F.when(~F.isnan(radius) & (radius < least), "below"), F.when(radius < least, 2).when(there, 1).otherwise(0)))
    return found


def semantic(columns: Collection[str], constraints: list = SEMANTIC, at: Callable[[str], Column] = F.col) -> Column:
    """An array of (rule, param, broken, severity) of all fixed checks that the columns allow; broken is null where one is kept.

    It is one expression over the row: no join, no shuffle. Rules whose parameter is null aren't in it.
    """
    one = lambda c: F.struct(F.lit(c.rule).alias("rule"), F.lit(c.param).alias("param"), c.broken.alias("broken"), F.lit(c.severity).alias("severity"))
    found = [F.when(c.there, one(c)) for c in fixed_checks(columns, constraints, at)]
    kind = "array<struct<rule:string,param:string,broken:string,severity:string>>"
    return F.filter(F.array(*found).cast(kind), lambda x: x.isNotNull())


def semantic_errors(columns: Collection[str]) -> Column:
    """How many fixed checks of the level `error` a row breaks."""
    broken = [F.when(c.end > 1, 1).otherwise(0) for c in fixed_checks(columns) if c.severity == "error"]
    return reduce(Column.__add__, broken, F.lit(0))


def semantic_tally(wide: DataFrame, columns: Collection[str]) -> DataFrame:
    """rule, param, broken (null: kept), severity, n: how often each fixed check ends how.

    How all checks of a row end is one number, two bits a check; rows are counted by it, and the numbers, of which there are few, are taken apart afterwards.
    """
    checks = fixed_checks(columns)
    ends = [("kept", 1), ("below", 2), ("not allowed", 2), ("above", 3)]
    packed = reduce(Column.__add__, (F.shiftleft(c.end.cast("long"), 2 * i) for i, c in enumerate(checks)), F.lit(0).cast("long"))
    counts = wide.select(packed.alias("_code")).groupBy("_code").agg(F.count("*").alias("_n"))
    one = lambda i, c: F.struct(F.lit(i).alias("i"), F.shiftright("_code", 2 * i).bitwiseAND(3).cast("int").alias("end"))
    found = counts.select(F.explode(F.array(*(one(i, c) for i, c in enumerate(checks)))).alias("_"), "_n").where("_.end > 0").groupBy("_.i", "_.end").agg(F.sum("_n").alias("n"))
    kinds = {p: "not allowed" if allowed is not None else "below" for _, p, _, _, allowed, _, _ in SEMANTIC}
    shown = [(i, end, c.rule, c.param, None if name == "kept" else name, c.severity) for i, c in enumerate(checks) for name, end in ends if end != 2 or name == ("below" if c.rule == "SV-005" else kinds[c.param])]
    known = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(e).alias("end"), F.lit(r).alias("rule"), F.lit(p).alias("param"), F.lit(b).cast("string").alias("broken"), F.lit(v).alias("severity")) for i, e, r, p, b, v in shown))
    told = found.withColumn("_", F.get(F.filter(known, lambda x: (x["i"] == F.col("i")) & (x["end"] == F.col("end"))), F.lit(0)))
    return told.select("_.rule", "_.param", "_.broken", "_.severity", "n")


#: What nested highways are checked for: themselves, their segments, and the curves within these against the segment's speed.
HIGHWAY, SEGMENT = ("lane_width", "shoulder_width"), ("passing_type", "hor_class", "vertical_class", "grade", "phf", "phv", "spl")


def nested_violations(highways: DataFrame, keys: list[str], segments: str = "segments", subsegments: str = "subsegments") -> DataFrame:
    """keys, rule, param (with its place: segments[i].subsegments[j].name), value, severity: the fixed checks that nested highways break.

    Fields that the structs don't have aren't checked; null segments and values break nothing. Rows only get longer within themselves: no shuffle.
    """
    struct = highways.schema[segments].dataType.elementType
    inner = struct[subsegments].dataType.elementType.names if subsegments in struct.names else []

    def broken(rows: DataFrame, checks: list[Check], name: Callable[[str], Column], at: Callable[[str], Column]) -> DataFrame:
        one = [F.when(c.there & c.broken.isNotNull(), F.struct(F.lit(c.rule).alias("rule"), name(c.param).alias("param"), at(c.param).cast("double").alias("value"), F.lit(c.severity).alias("severity"))) for c in checks]
        if not one:
            return rows.select(*keys, F.lit("").alias("rule"), F.lit("").alias("param"), F.lit(0.0).alias("value"), F.lit("").alias("severity")).where("false")
        return rows.select(*keys, F.explode(F.array(*one)).alias("_")).where("_ IS NOT NULL").select(*keys, "_.*")

    own = broken(highways, fixed_checks([c for c in HIGHWAY if c in highways.columns]), F.lit, F.col)
    parts = highways.select(*keys, F.posexplode(segments).alias("_i", "_s")).where("_s IS NOT NULL")
    of_segment = lambda p: F.col("_s")[p]
    found = own.unionByName(broken(parts, fixed_checks([c for c in SEGMENT if c in struct.names], at=of_segment), lambda p: F.concat(F.lit("segments["), "_i", F.lit(f"].{p}")), of_segment))
    if "design_rad" in inner and "spl" in struct.names:
        curves = parts.select(*keys, "_i", F.col("_s")["spl"].alias("spl"), F.posexplode(F.col("_s")[subsegments]).alias("_j", "_u")).where("_u IS NOT NULL").withColumn("design_rad", F.col("_u")["design_rad"])
        place = lambda p: F.concat(F.lit("segments["), "_i", F.lit("].subsegments["), "_j", F.lit(f"].{p}"))
        found = found.unionByName(broken(curves, [c for c in fixed_checks(["design_rad", "spl"]) if c.rule == "SV-005"], place, F.col))
    return found


#: Rules that are compiled into columns: a corpus of so many at most, others are joined.
COMPILED = 2000


def row_verdicts(wide: DataFrame, keys: list[str], params: list[str], rules: DataFrame, strict: bool = False) -> DataFrame:
    """verdicts() of wide records: the rules, if they are few enough, become columns, so that no record is taken apart and put together again.

    Records that are equal in keys count as one.
    """
    told = rules.where(F.col("param").isin(params)).limit(COMPILED + 1).collect()
    if len(told) > COMPILED:
        pairs = F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params))
        return verdicts(checked(wide.select(*keys, F.explode(pairs).alias("_")).select(*keys, "_.*").where("value IS NOT NULL"), rules), keys, strict)

    def breaks(r) -> Column:
        v = F.col(r["param"]).cast("double")
        low = below(v, F.lit(r["lo"]), F.lit(bool(r["lo_open"]))) if r["rule_type"] in ("range", "min") and r["lo"] is not None else F.lit(False)
        high = above(v, F.lit(r["hi"]), F.lit(bool(r["hi_open"]))) if r["rule_type"] in ("range", "max") and r["hi"] is not None else F.lit(False)
        enum = ~v.cast("string").isin(list(r["allowed"])) if r["rule_type"] == "enum" and r["allowed"] else F.lit(False)
        return F.coalesce(low | high | enum, F.lit(False)).cast("bigint")

    count = lambda level: reduce(Column.__add__, (breaks(r) for r in told if (r["severity"] == "error") == level), F.lit(0).cast("bigint"))
    some = reduce(Column.__or__, (F.col(p).isNotNull() for p in {r["param"] for r in told}), F.lit(False))
    out = wide.where(some).select(*keys, count(True).alias("errors"), count(False).alias("warnings")).groupBy(*keys).agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))
    valid = F.col("errors") == 0
    return out.withColumn("is_valid", valid & (F.col("warnings") == 0) if strict else valid)


def coverage(checked: Column, supplied: Column) -> Column:
    """none if nothing was checked, partial if less than was supplied, else covered."""
    return F.when(checked == 0, "none").when(checked < supplied, "partial").otherwise("covered")


def supplied(columns: list[str]) -> Column:
    return reduce(Column.__add__, (F.col(c).isNotNull().cast("int") for c in columns))


def rollup_severity(results: DataFrame) -> DataFrame:
    """rule_id, severity, citation, violations, and the extreme values that broke it."""
    return results.where("broken IS NOT NULL").groupBy("rule_id", "severity", "citation").agg(F.count("*").alias("violations"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
