"""Questions back: implausible units, missing inputs, open contexts; and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.sources.rules import METRIC, TOLERANCE

#: What a question is made of before it is merged with its like: the order is a struct, the smaller the earlier.
ASK = ["kind", "parameter", "message", "options", "related", "order"]


def metric_factor(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for u, _, factor in METRIC:
        out = F.when(unit == u, factor).otherwise(out)
    return out


def unit_conflict(value: Column, unit: Column, lo: Column, hi: Column) -> Column:
    """Whether a value outside its typical range would lie in it, give or take the tolerance, were it metric."""
    read = value * metric_factor(unit)
    slack_lo, slack_hi = lo * (1 - TOLERANCE), hi * (1 + TOLERANCE)
    outside = (value < lo) | (value > hi)
    return F.coalesce(outside & (read >= slack_lo) & (read <= slack_hi), F.lit(False))


def missing_inputs(referenced: Column, provided: Column) -> Column:
    return F.array_except(referenced, provided)


def deduplicated(asks: DataFrame, keys: list[str]) -> DataFrame:
    """One question for each kind and parameter: the first message (by ord), and all related parameters, sorted. asks: kind, parameter, message, related, ord."""
    related = F.array_sort(F.array_distinct(F.flatten(F.collect_set("related"))))
    return asks.groupBy(*keys, "kind", "parameter").agg(F.min_by("message", "ord").alias("message"), related.alias("related"))


def plain(x: Column) -> Column:
    """A number with up to six digits that count, without zeros at its end."""
    short = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    shown = short
    for e in range(5, -5, -1):
        digits = F.format_string(f"%.{5 - e}f", x)
        shown = F.when(F.abs(x) < 10.0 ** (e + 1), F.regexp_replace(digits, r"\.?0+$", "") if e < 5 else digits).otherwise(shown)
    return F.when(x == 0, "0").when(F.abs(x) < 1e-4, short).when(x.isNotNull(), shown)


def _texts(*found: Column) -> Column:
    return F.array(*found) if found else F.array().cast("array<string>")


def unit_asks(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ASK for each value that looks metric. values: keys, field, value_num, unit, typical_min, typical_max, place."""
    of = F.lit(None).cast("string")
    for u, name, _ in METRIC:
        of = F.when(F.col("unit") == u, name).otherwise(of)
    read = F.format_string("%.2f", F.col("value_num") * metric_factor(F.col("unit")))
    message = F.concat("field", F.lit(" = "), plain(F.col("value_num")), F.lit(" "), "unit", F.lit(" is outside of "), plain(F.col("typical_min")), F.lit(" to "), plain(F.col("typical_max")), F.lit("; are these "), of, F.lit(" ("), read, F.lit(" "), "unit", F.lit(")?"))
    odd = values.where(unit_conflict(F.col("value_num"), F.col("unit"), F.col("typical_min"), F.col("typical_max")))
    return odd.select(*keys, F.lit("unit_conflict").alias("kind"), F.col("field").alias("parameter"), message.alias("message"), _texts().alias("options"), _texts().alias("related"), _order(0))


def _order(stage: int, within: Column | None = None) -> Column:
    """Questions come by the parameter's place, then units, contexts and inputs, then by rule."""
    return F.struct(F.col("place").alias("place"), F.lit(stage).alias("stage"), (F.lit(0).cast("long") if within is None else within).alias("within")).alias("order")


def context_asks(open_rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ASK: one question for each parameter and kind of condition that decides some of its rules, with all values that those rules want.

    open_rules: keys, field, place, rule_id, rule (its name) and open, the conditions (type, value) that have no value to go by, of rules that nothing contradicts.
    """
    one = open_rules.select(*keys, "field", "place", "rule_id", "rule", F.explode("open").alias("_c"))
    found = one.groupBy(*keys, "field", F.col("_c.type").alias("parameter")).agg(
        F.min("place").alias("place"), F.min(F.col("rule_id").cast("long")).alias("_first"), F.array_sort(F.collect_set("_c.value")).alias("options"), F.array_sort(F.collect_set("rule")).alias("_rules"),
    )
    message = F.concat(F.lit("Which "), F.replace("parameter", F.lit("_"), F.lit(" ")), F.lit(" ("), F.array_join("options", ", "), F.lit(")? "), "field", F.lit(" has rules that depend on it: "), F.array_join(F.slice("_rules", 1, 3), ", "))
    return found.select(*keys, F.lit("ambiguous_context").alias("kind"), "parameter", message.alias("message"), "options", _texts(F.col("field")).alias("related"), _order(1, F.col("_first")))


def input_asks(unchecked: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ASK: one question for each formula rule that lacks inputs; it names the parameter only if a single one is missing, and all of them as related.

    unchecked: keys, field, place, rule_id, rule and missing.
    """
    missing = F.array_sort(F.array_distinct("missing"))
    message = F.concat(F.lit("What is "), F.array_join("_missing", ", "), F.lit("? "), "rule", F.lit(" on "), "field", F.lit(" can't be checked without"))
    found = unchecked.withColumn("_missing", missing).where(F.size("_missing") > 0)
    return found.select(*keys, F.lit("missing_parameter").alias("kind"), F.when(F.size("_missing") == 1, F.get("_missing", F.lit(0))).alias("parameter"), message.alias("message"), _texts().alias("options"), F.col("_missing").alias("related"), _order(2, F.col("rule_id").cast("long")))


def rule_asks(pending: DataFrame, keys: list[str]) -> DataFrame:
    """What context_asks() and input_asks() give together, in one pass over the rules and one grouping.

    pending: keys, field, place, rule_id, rule, open (of rules that a context decides, else null or empty) and missing (of formulas that lack inputs, else null or empty).
    """
    kind = "array<struct<kind:string,type:string,value:string,missing:array<string>>>"
    null = F.lit(None).cast("string")
    conditions = F.transform("open", lambda c: F.struct(F.lit("ambiguous_context").alias("kind"), c["type"].alias("type"), c["value"].alias("value"), F.lit(None).cast("array<string>").alias("missing")))
    inputs = F.when(F.size("missing") > 0, F.array(F.struct(F.lit("missing_parameter").alias("kind"), null.alias("type"), null.alias("value"), F.array_sort(F.array_distinct("missing")).alias("missing"))))
    none = F.array().cast(kind)
    one = pending.select(*keys, "field", "place", "rule_id", "rule", F.explode(F.concat(F.coalesce(conditions.cast(kind), none), F.coalesce(inputs.cast(kind), none))).alias("_a"))
    of_input = F.col("_a.kind") == "missing_parameter"
    found = one.groupBy(*keys, "field", F.col("_a.kind").alias("kind"), F.col("_a.type").alias("type"), F.col("_a.missing").alias("missing"), F.when(of_input, F.struct("rule_id", "rule")).alias("_rule")).agg(
        F.min("place").alias("place"), F.min(F.col("rule_id").cast("long")).alias("_first"), F.array_sort(F.collect_set("_a.value")).alias("options"), F.array_sort(F.collect_set("rule")).alias("_rules"),
    )
    which = F.concat(F.lit("Which "), F.replace("type", F.lit("_"), F.lit(" ")), F.lit(" ("), F.array_join("options", ", "), F.lit(")? "), "field", F.lit(" has rules that depend on it: "), F.array_join(F.slice("_rules", 1, 3), ", "))
    what = F.concat(F.lit("What is "), F.array_join("missing", ", "), F.lit("? "), F.col("_rule.rule"), F.lit(" on "), "field", F.lit(" can't be checked without"))
    asks_input = F.col("kind") == "missing_parameter"
    parameter = F.when(asks_input, F.when(F.size("missing") == 1, F.get("missing", F.lit(0)))).otherwise(F.col("type"))
    order = F.struct(F.col("place").alias("place"), F.when(asks_input, 2).otherwise(1).alias("stage"), F.col("_first").alias("within")).alias("order")
    return found.select(*keys, "kind", parameter.alias("parameter"), F.when(asks_input, what).otherwise(which).alias("message"), "options", F.when(asks_input, F.col("missing")).otherwise(_texts(F.col("field"))).alias("related"), order)


def questions(asks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, parameter, message, options, related: one question for each kind and parameter (those without one are one, too): message and options of the earliest, everybody's related."""
    first = F.min_by(F.struct("message", "options"), "order").alias("_")
    found = asks.groupBy(*keys, "kind", "parameter").agg(first, F.array_sort(F.array_distinct(F.flatten(F.collect_list("related")))).alias("related"))
    return found.select(*keys, "kind", "parameter", "_.message", "_.options", "related")
