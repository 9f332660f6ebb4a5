"""Reconciling competing rules: claims on one parameter defeat each other, and what survives decides.

Each record's claims are one array; a fold over them, the strongest first, keeps a claim unless one that is already kept conflicts with it
and is strictly stronger. This is linear in the plan: one grouping, no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.operators.clarify import plain
from trestle.operators.graph import weight

# The priority of a jurisdiction that gives none; the smaller wins.
PRIORITY = {"federal": 100, "state": 50, "local": 25, "project": 10}


def priority(jurisdiction: Column, given: Column) -> Column:
    out = F.lit(100)
    for tier, p in PRIORITY.items():
        out = F.when(F.lower(jurisdiction) == tier, p).otherwise(out)
    return F.coalesce(given, out)


def aspect(a: Column, b: Column) -> Column:
    """On what two claims (lo, hi, allowed, ok) conflict: their lower bounds, upper bounds, allowed values or verdicts; null if on nothing."""
    differ = lambda k: a[k].isNotNull() & b[k].isNotNull() & (a[k] != b[k])
    return F.when(differ("lo"), "lower bound").when(differ("hi"), "upper bound").when(differ("allowed"), "allowed values").when(differ("ok"), "verdict")


def stronger(a: Column, b: Column) -> Column:
    """Why a claim is strictly stronger: its jurisdiction's priority, its specificity, its authority; null if it isn't."""
    return (
        F.when(a["prio"] < b["prio"], "jurisdiction").when(a["prio"] > b["prio"], None)
        .when(a["specificity"] > b["specificity"], "specificity").when(a["specificity"] < b["specificity"], None)
        .when(a["trust"] > b["trust"], "provenance")
    )


def arguments(claims: DataFrame) -> DataFrame:
    """claims with arg: the struct that the fold works on; allowed values are sets. claims: ord, lo, hi, allowed, ok, jurisdiction, priority, specificity, authority."""
    arg = F.struct(priority(F.col("jurisdiction"), F.col("priority")).alias("prio"), (-F.col("specificity")).alias("_s"), (-weight(F.col("authority"))).alias("_t"), F.col("ord").alias("ord"),
                   "lo", "hi", F.array_sort(F.array_distinct("allowed")).alias("allowed"), "ok", "specificity", weight(F.col("authority")).alias("trust"))
    return claims.withColumn("arg", arg)


def surviving(args: Column) -> Column:
    """The claims that stay, the strongest first. args: structs that sort by strength."""
    empty = F.filter(args, lambda x: F.lit(False))
    return F.aggregate(F.array_sort(args), empty, lambda kept, x: F.when(F.exists(kept, lambda k: F.coalesce(aspect(k, x).isNotNull() & stronger(k, x).isNotNull(), F.lit(False))), kept).otherwise(F.concat(kept, F.array(x))))


def reconciled(claims: DataFrame, keys: list[str]) -> DataFrame:
    """keys, claims, survivors, lo, hi (the interval that the survivors leave), verdict (all of them are met), unresolved (two survivors conflict)."""
    args = arguments(claims).groupBy(*keys).agg(F.collect_list("arg").alias("args")).withColumn("kept", surviving(F.col("args")))
    clash = F.exists("kept", lambda a: F.exists("kept", lambda b: (a["ord"] < b["ord"]) & aspect(a, b).isNotNull()))
    return args.select(
        *keys, F.size("args").alias("claims"), F.size("kept").alias("survivors"), F.array_max(F.transform("kept", lambda a: a["lo"])).alias("lo"), F.array_min(F.transform("kept", lambda a: a["hi"])).alias("hi"),
        F.forall("kept", lambda a: F.coalesce(a["ok"], F.lit(True))).alias("verdict"), clash.alias("unresolved"),
    )


def defeats(claims: DataFrame, keys: list[str]) -> DataFrame:
    """keys, winner, loser, aspect, principle: the conflicts whose winner survived. Claims meet within their record only."""
    args = arguments(claims).groupBy(*keys).agg(F.collect_list("arg").alias("args")).withColumn("kept", surviving(F.col("args")))
    pairs = args.select(*keys, F.explode("kept").alias("w"), "args").select(*keys, "w", F.explode("args").alias("l"))
    return pairs.select(*keys, F.col("w.ord").alias("winner"), F.col("l.ord").alias("loser"), aspect(F.col("w"), F.col("l")).alias("aspect"), stronger(F.col("w"), F.col("l")).alias("principle")).where("aspect IS NOT NULL AND principle IS NOT NULL")


# --- Claims as they are stated: normalised, gated by the context, and reconciled with a trace ----------------------------------------


def listed(values: Column) -> Column:
    """The values of a comma-separated text, trimmed, without empty ones; null has none."""
    return F.coalesce(F.filter(F.transform(F.split(values, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def gate(conditions: Column, context: Column) -> tuple[Column, Column]:
    """Whether all conditions (type, value) are met by the context (a map), and why: of those that aren't, the first says why not."""
    actual = lambda c: F.try_element_at(context, c["type"])
    why = F.transform(
        conditions, lambda c: F.when(actual(c).isNull(), F.concat(c["type"], F.lit("="), c["value"], F.lit(" isn't established"))).when(F.lower(actual(c)) != F.lower(c["value"]), F.concat(c["type"], F.lit("="), c["value"], F.lit(" isn't met: "), actual(c)))
    )
    first = F.get(F.filter(why, lambda x: x.isNotNull()), F.lit(0))
    met = F.array_join(F.transform(conditions, lambda c: F.concat(c["type"], F.lit("="), c["value"])), ", ")
    return first.isNull(), F.coalesce(first, F.when(F.size(conditions) == 0, "unconditional").otherwise(met))


def claim_text(parameter: Column, a: Column) -> Column:
    """What a claim says of the parameter."""
    lo, hi = plain(a["lo"]), plain(a["hi"])
    return (
        F.when(F.size(a["allowed"]) > 0, F.concat(parameter, F.lit(" in {"), F.array_join(a["values"], ", "), F.lit("}"))).when(a["lo"].isNotNull() & a["hi"].isNotNull(), F.concat(parameter, F.lit(" in ["), lo, F.lit(", "), hi, F.lit("]")))
        .when(a["lo"].isNotNull(), F.concat(parameter, F.lit(" >= "), lo)).when(a["hi"].isNotNull(), F.concat(parameter, F.lit(" <= "), hi)).otherwise(F.concat(parameter, F.lit(": no bound")))
    )


def normalised(claims: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, parameter, context, value and args, the claims on the parameter in their order, each with its id, strength, applicability and verdict.

    claims: keys, ord (places from 0; ids are A1, A2, ... by them), parameter, rule_type, lo, hi, allowed (an array or a comma-separated text), jurisdiction (null: federal), priority (null: its tier's), authority, citation, conditions
    (array of type and value). cases: keys, and parameter (null: that of the first claim), context (a map) and value, each of which may be null; a record without a case has neither. A claim
    without a parameter is on the one asked for. One join and one grouping by record; a record holds as many claims as there are rules on a parameter.
    """
    said = cases.select(*keys, F.col("parameter").alias("_asked"), F.col("context").alias("_context"), F.col("value").cast("double").alias("_value"))
    rows = claims.join(said, keys, "left")
    context = F.coalesce("_context", F.create_map().cast("map<string,string>"))
    values = listed(F.col("allowed")) if claims.schema["allowed"].dataType.simpleString() == "string" else F.coalesce("allowed", F.array().cast("array<string>"))
    enum = F.col("rule_type") == "enum"
    jurisdiction = F.lower(F.coalesce("jurisdiction", F.lit("federal")))
    conditions = F.coalesce("conditions", F.array().cast("array<struct<type:string,value:string>>"))
    rows = rows.withColumns({"_values": values, "_tier": jurisdiction, "_conditions": conditions, "_map": context})
    met, why = gate(F.col("_conditions"), F.col("_map"))
    v = F.col("_value")
    within = F.coalesce(v >= F.col("lo"), F.lit(True)) & F.coalesce(v <= F.col("hi"), F.lit(True))
    ok = F.when(met & v.isNotNull(), F.when(enum & (F.size("_values") > 0), F.array_contains("_values", v.cast("string"))).otherwise(within))
    trust = weight(F.col("authority"))
    arg = F.struct(
        F.col("ord").cast("long").alias("ord"), F.concat(F.lit("A"), (F.col("ord") + 1).cast("string")).alias("id"), F.col("parameter").alias("parameter"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"),
        F.when(enum, F.array_sort(F.array_distinct("_values"))).alias("allowed"), F.col("_values").alias("values"), F.col("_tier").alias("jurisdiction"), priority(F.col("_tier"), F.col("priority")).alias("prio"),
        F.coalesce("authority", F.lit("unknown")).alias("authority"), trust.alias("trust"), F.coalesce("citation", F.lit("")).alias("citation"), (F.size("_conditions") > 0).alias("conditional"), met.alias("applicable"), why.alias("reason"),
        F.when(met, F.size("_conditions")).otherwise(0).alias("specificity"), ok.alias("ok"),
    )
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(arg)).alias("args"), F.first("_asked").alias("_asked"), F.first("_map").alias("context"), F.first("_value").alias("value"))
    found = found.withColumn("parameter", F.coalesce("_asked", F.get("args", F.lit(0))["parameter"], F.lit("")))
    on = lambda a: (F.col("parameter") == "") | F.coalesce(a["parameter"] == F.col("parameter"), F.lit(True))
    return found.select(*keys, "parameter", "context", "value", F.filter("args", on).alias("args"))


def adjudicated(claims: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, parameter, context, value, args, conflicts, defeats, unresolved, governing, lo, hi and verdict: what normalised() claims come to.

    Claims that apply conflict on an aspect(); the stronger() defeats the other if it isn't defeated itself, the strongest first. conflicts, defeats and unresolved are arrays of the two claims (winner first, in defeats),
    with aspect and principle; unresolved ones are those that no principle decides. governing: the claims that apply and stay. lo, hi: the interval that they leave; verdict: whether the value
    meets all of them, null without a value or a claim.
    """
    rows = normalised(claims, cases, keys).withColumn("_arena", F.filter("args", lambda a: a["applicable"]))
    ranked = F.array_sort(F.transform("_arena", lambda a: F.struct(a["prio"].alias("prio"), (-a["specificity"]).alias("_s"), (-a["trust"]).alias("_t"), a["ord"].alias("ord"), a["lo"].alias("lo"), a["hi"].alias("hi"), a["allowed"].alias("allowed"), a["ok"].alias("ok"),
                                                                       a["specificity"].alias("specificity"), a["trust"].alias("trust"))))
    rows = rows.withColumn("_kept", F.transform(surviving(ranked), lambda a: a["ord"]))

    def met(a: Column, b: Column) -> Column:
        one, two = stronger(a, b), stronger(b, a)
        w, l = (F.when(two.isNotNull(), x).otherwise(y) for x, y in ((b, a), (a, b)))
        return F.struct(w["prio"].alias("_p"), (-w["specificity"]).alias("_s"), (-w["trust"]).alias("_t"), a["ord"].alias("a"), b["ord"].alias("b"), w["id"].alias("winner"), l["id"].alias("loser"), w["ord"].alias("_w"),
                        a["id"].alias("one"), b["id"].alias("two"), aspect(a, b).alias("aspect"), F.coalesce(one, two).alias("principle"))

    pairs = F.flatten(F.transform("_arena", lambda a: F.transform(F.filter("_arena", lambda b: (a["ord"] < b["ord"]) & aspect(a, b).isNotNull()), lambda b: met(a, b))))
    rows = rows.withColumn("_pairs", pairs)
    shown = lambda p: F.struct(p["one"].alias("a"), p["two"].alias("b"), p["aspect"].alias("aspect"), p["principle"].alias("principle"))
    won = F.array_sort(F.filter("_pairs", lambda p: p["principle"].isNotNull() & F.array_contains("_kept", p["_w"])))
    rows = rows.withColumns({
        "conflicts": F.transform("_pairs", shown), "unresolved": F.transform(F.filter("_pairs", lambda p: p["principle"].isNull()), shown),
        "defeats": F.transform(won, lambda p: F.struct(p["winner"].alias("a"), p["loser"].alias("b"), p["aspect"].alias("aspect"), p["principle"].alias("principle"))),
        "governing": F.filter("_arena", lambda a: F.array_contains("_kept", a["ord"])),
    })
    return rows.select(
        *keys, "parameter", "context", "value", "args", "conflicts", "defeats", "unresolved", "governing", F.array_max(F.transform("governing", lambda a: a["lo"])).alias("lo"), F.array_min(F.transform("governing", lambda a: a["hi"])).alias("hi"),
        F.when(F.col("value").isNotNull() & (F.size("governing") > 0), F.forall("governing", lambda a: a["ok"])).alias("verdict"),
    )


def trace(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, kind and text: how each record of adjudicated() came to its result, line by line from 0."""
    p = F.col("parameter")
    line = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    ctx = F.coalesce(F.nullif(F.array_join(F.array_sort(F.transform(F.map_entries("context"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ", "), F.lit("")), F.lit("none"))
    cited = lambda a: F.when(a["citation"] != "", F.concat(F.lit(" ["), a["citation"], F.lit("]"))).otherwise("")
    applies = lambda a: F.when(~a["applicable"], F.concat(F.lit("; doesn't apply: "), a["reason"])).when(a["conditional"], F.concat(F.lit("; applies: "), a["reason"])).otherwise("")
    arguments_ = F.transform("args", lambda a: line("argument", F.concat(a["id"], F.lit(" ("), a["jurisdiction"], F.lit(" "), a["prio"].cast("string"), F.lit(", "), a["authority"], F.lit(" "), plain(a["trust"]), F.lit("): "), claim_text(p, a), cited(a), applies(a))))
    conflicts = F.transform("conflicts", lambda c: line("conflict", F.concat(c["a"], F.lit(" and "), c["b"], F.lit(" differ in their "), c["aspect"])))
    defeats_ = F.transform("defeats", lambda c: line("defeat", F.concat(c["a"], F.lit(" defeats "), c["b"], F.lit(" by "), c["principle"])))
    ties = F.transform("unresolved", lambda c: line("unresolved", F.concat(c["a"], F.lit(" and "), c["b"], F.lit(" can't be told apart; both hold"))))
    out = lambda kind, text: F.array(line(kind, text))
    none = F.filter(out("", F.lit("")), lambda x: F.lit(False))
    govern = F.array_join(F.transform("governing", lambda a: F.concat(a["id"], F.lit(" ("), claim_text(p, a), F.lit(")"))), ", ")
    result = F.when(F.size("governing") > 0, F.concat(out("governing", govern), out("effective", F.concat(p, F.lit(" in ["), F.coalesce(plain(F.col("lo")), F.lit("-inf")), F.lit(", "), F.coalesce(plain(F.col("hi")), F.lit("+inf")), F.lit("]"))))).otherwise(out("governing", F.lit("none")))
    ids = F.transform("governing", lambda a: a["id"])
    against = F.array_join(F.transform(F.filter("args", lambda a: a["applicable"] & ~F.array_contains(ids, a["id"]) & (a["ok"] != F.col("verdict"))), lambda a: a["id"]), ", ")
    verdict = F.concat(p, F.lit(" = "), plain(F.col("value")), F.when(F.col("verdict"), " complies").otherwise(" doesn't comply"), F.when(against != "", F.concat(F.lit("; overridden: "), against)).otherwise(""))
    lines = F.concat(
        out("context", ctx), arguments_, F.when(F.size("conflicts") == 0, out("agreement", F.lit("nothing conflicts"))).otherwise(none), conflicts, defeats_, ties, result, F.when(F.col("verdict").isNotNull(), out("verdict", verdict)).otherwise(none),
    )
    return found.select(*keys, F.posexplode(lines).alias("place", "_")).select(*keys, "place", "_.kind", "_.text")
