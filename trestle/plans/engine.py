"""A whole validation: records' parameters to verdicts and questions, for all records at once.

Names are resolved against the corpus, rules joined, contexts gate them, values are checked, and each record's results are put
together. Two joins with the corpus, one with the contexts, and one grouping by record; where there are formula rules, one more before, which gives each record's
parameters together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.functions import formula
from trestle.operators import clarify, context
from trestle.operators.checks import COMPILED, violation

Results = tuple[DataFrame, DataFrame]


def resolved(params: DataFrame, keys: DataFrame) -> DataFrame:
    """params with field: what the corpus calls the parameter; null for unknown ones. keys: key, field."""
    return params.join(keys.select(F.col("key").alias("_key"), "field"), F.lower("param") == F.col("_key"), "left").drop("_key")


def validate(params: DataFrame, contexts: DataFrame, keys: DataFrame, rules: DataFrame, units: DataFrame | None = None, strict: bool = False) -> Results:
    """Verdicts (record, errors, warnings, unknown, is_valid, violations) and questions (record, kind, parameter, message, options, related).

    params: record, param, value_num, value_str, and ord, their place in the record, if they have one (else they come by name): the earliest of like questions counts. contexts: record, context (a map). rules: field, rule_id, name (optional), rule_type, severity, lo, hi, lo_open, hi_open, allowed,
    citation, conditions. units: field, unit, typical_min, typical_max. Parameters of segments are taken along but never checked; unknown ones are valid.
    A rule whose conditions can't be decided isn't applied, and its parameter asks for the context, with all values that such rules want. A formula rule (rules have a column `formula` then) reads the record's other
    values, by field or by name, and asks once for all that aren't there; what can't be worked out, or isn't a formula, breaks nothing.
    """
    place = F.col("ord") if "ord" in params.columns else F.col("param")
    named = resolved(params.where(~F.col("param").startswith("segment_")).withColumn("place", place), keys)
    rules = rules.withColumn("rule", F.coalesce(F.col("name") if "name" in rules.columns else F.lit(None), F.concat(F.lit("rule "), F.col("rule_id").cast("string"))))
    formulas = _formulas(rules)
    # Where formulas read a record's other values, its parameters are put together once, for its values, its context and its rules.
    whole = _together(named).join(contexts, "record", "left").select("record", "_values", "context", F.explode("_given").alias("_")).select("record", "_values", "context", "_.*") if formulas else named.join(contexts, "record", "left")
    ruled = whole.join(rules, "field", "left")
    none = F.create_map().cast("map<string,string>")
    ctx, conditions = F.coalesce("context", none), F.coalesce("conditions", F.array().cast("array<struct<type:string,value:string>>"))
    state = context.tri_state(ctx, conditions)
    broken = F.when(state == "applicable", violation(F.col("value_num"), F.coalesce("value_str", F.col("value_num").cast("string"))))
    results = ruled.withColumns({"state": state, "broken": broken, "open": context.pending(ctx, conditions)})
    if formulas:
        kept, missing = (reduce(lambda out, r: F.when(F.col("rule_id") == r, formulas[r][i]).otherwise(out), formulas, F.lit(None).cast(kind)) for i, kind in ((0, "boolean"), (1, "array<string>")))
        asked = (F.col("rule_type") == "formula") & (F.col("state") == "applicable")
        results = results.withColumn("_missing", F.when(asked, missing))
        results = results.withColumn("broken", F.when(asked & (F.size("_missing") == 0) & ~kept, "formula").otherwise(F.col("broken")))
    bad = F.col("broken").isNotNull()
    found = F.struct("rule_id", "severity", "param", "broken", "citation")
    verdicts = results.groupBy("record").agg(
        F.count_if(bad & (F.col("severity") == "error")).alias("errors"), F.count_if(bad & (F.col("severity") != "error")).alias("warnings"), F.count_if(F.col("field").isNull()).alias("unknown"),
        F.array_sort(F.collect_list(F.when(bad, found))).alias("violations"),
    )
    valid = F.col("errors") == 0
    verdicts = verdicts.withColumn("is_valid", valid & (F.col("warnings") == 0) if strict else valid)
    told = ["record", "field", "place", "rule_id", "rule"]
    lacking = F.col("_missing") if formulas else F.lit(None).cast("array<string>")
    asks = clarify.rule_asks(results.select(*told, F.when(F.col("state") == "undecidable", F.col("open")).alias("open"), lacking.alias("missing")), ["record"])
    if units is not None:
        asks = asks.unionByName(clarify.unit_asks(named.join(units, "field"), ["record"]))
    return verdicts, clarify.questions(asks, ["record"])


def _formulas(rules: DataFrame) -> dict[int, tuple[Column, Column]]:
    """By rule: whether its formula holds, and which of its parameters aren't there, over the map `_values`. Rules are a corpus: so many as can be compiled."""
    found: dict[int, tuple[Column, Column]] = {}
    told = rules.where("rule_type = 'formula' AND formula IS NOT NULL").select("rule_id", "formula").distinct().limit(COMPILED + 1).collect() if "formula" in rules.columns else []
    if len(told) > COMPILED:
        raise ValueError(f"more than {COMPILED} formula rules")
    for r in told:
        try:
            names = formula.references(r["formula"])
            needed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
            found[r["rule_id"]] = formula.compiled(r["formula"], lambda p: F.try_element_at("_values", F.lit(p))), clarify.missing_inputs(needed, F.coalesce(F.map_keys("_values"), F.array().cast("array<string>")))
        except formula.FormulaError:
            continue
    return found


def _together(named: DataFrame) -> DataFrame:
    """record, _given (its parameters) and _values: the numbers that it gives, by field and by name; of several the first by name. Null without any, or without a record."""
    given = named.groupBy("record").agg(F.collect_list(F.struct("field", "param", "value_num", "value_str", "place")).alias("_given"))
    numbers = F.filter("_given", lambda x: x["value_num"].isNotNull())
    entries = F.flatten(F.transform(numbers, lambda x: F.transform(F.array_distinct(F.array_compact(F.array(x["field"], F.replace(x["param"], F.lit("-"), F.lit("_"))))), lambda k: F.struct(k.alias("k"), x["param"].alias("param"), x["value_num"].alias("v")))))
    told = given.withColumn("_all", F.array_sort(entries))
    first = F.filter("_all", lambda x, i: (i == 0) | (F.get(F.col("_all"), i - 1)["k"] != x["k"]))
    values = F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))))
    return told.select("record", "_given", F.when(F.col("record").isNotNull() & (F.size("_all") > 0), values).alias("_values"))


def prioritized(rules: DataFrame, jurisdiction: Column | None = None) -> DataFrame:
    """rules with prio, ordered: the best priority of a rule's sources (the smaller first), 50 better, but at least 1, for sources of the jurisdiction asked for."""
    from trestle.operators.authority import priority

    return rules.withColumn("prio", priority(F.col("sources"), jurisdiction)).orderBy("prio", "rule_id")


def detections(found: DataFrame, markings: list[str], least: float = 0.5) -> DataFrame:
    """found (confidence, marking, curvature_per_ft, speed) with problems: low confidence, an unknown marking, a curve too tight for the speed."""
    from trestle.operators.checks import least_radius

    radius = F.when(F.abs("curvature_per_ft") >= 1e-9, 1 / F.abs("curvature_per_ft"))
    tests = [F.when(F.col("confidence") < least, "low confidence"), F.when(~F.col("marking").isin(markings), "unknown marking"), F.when(radius < least_radius(F.col("speed")), "too tight")]
    return found.withColumn("problems", F.filter(F.array(*tests), lambda x: x.isNotNull()))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind and json: a row for each node and each edge, to write as text for drawing."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


def robustness(by_model: DataFrame) -> DataFrame:
    """One row over models' scores (f1, numeric_recall, definitional_recall): the least and largest f1, and how many models do better on numbers than on definitions."""
    return by_model.agg(F.count("*").alias("models"), F.min("f1").alias("least_f1"), F.max("f1").alias("most_f1"), F.count_if(F.col("numeric_recall") > F.col("definitional_recall")).alias("better_on_numbers"))
