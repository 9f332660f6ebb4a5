"""Knowledge edges out of text and code, and their scores against curated ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_term(term: Column) -> Column:
    """A term in lower case, without an article before it and a parenthesis behind it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(term)), r"^(the|a|an)\s+", ""), r"\s*\([^)]*\)$", ""))


def known_terms(terms: DataFrame, term: str, aliases: DataFrame) -> DataFrame:
    """terms with field: of the alias (alias, field) that is the term, else the normalised term; null for neither."""
    low = terms.withColumn("_raw", F.lower(F.trim(term))).withColumn("_term", normal_term(F.col(term)))
    one, two = aliases.select(F.col("alias").alias("_raw"), F.col("field").alias("_f1")), aliases.select(F.col("alias").alias("_term"), F.col("field").alias("_f2"))
    return low.join(one, "_raw", "left").join(two, "_term", "left").withColumn("field", F.coalesce("_f1", "_f2")).drop("_raw", "_term", "_f1", "_f2")


def windows(texts: DataFrame, keys: list[str], text: str, size: int = 14000, overlap: int = 1500) -> DataFrame:
    """keys, place, piece: overlapping windows of each whole text, stripped; a text that fits is one window."""
    step = size - overlap
    starts = F.when(F.length(text) <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length(text), F.lit(step)))
    return texts.where(F.col(text).isNotNull()).select(*keys, text, F.posexplode(starts).alias("place", "_at")).select(*keys, "place", F.btrim(F.substring(F.col(text), F.col("_at"), F.lit(size)), F.lit(" \t\n\r")).alias("piece"))


def rejoined(chunks: DataFrame, keys: list[str], place: str, text: str, chapter: str, part: str) -> DataFrame:
    """keys, source: the chunks of each document whose chapter contains a text, joined by spaces in their order; a document without such chunks has no row.

    Null texts are left out, chunks of one place are ordered by their text. A document is a row, so it is as large as a row may be.
    """
    some = chunks.where(F.contains(F.coalesce(F.col(chapter).cast("string"), F.lit("")), F.lit(part)) & F.col(text).isNotNull())
    return some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.col(text).alias("is")))).alias("_")).select(*keys, F.array_join(F.col("_.is"), " ").alias("source"))


def first_edges(edges: DataFrame) -> DataFrame:
    """The first (by ord) of equal edges between different known fields."""
    fit = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return fit.groupBy("src", "dst").agg(F.min("ord").alias("ord"), F.min_by("basis", "ord").alias("basis"))


def agreement(found: DataFrame, curated: DataFrame) -> DataFrame:
    """src, dst, bucket: confirmed, only found or only curated."""
    a, b = found.select("src", "dst", F.lit(True).alias("_f")), curated.select("src", "dst", F.lit(True).alias("_c"))
    bucket = F.when(F.col("_f") & F.col("_c"), "confirmed").when(F.col("_f"), "found only").otherwise("curated only")
    return a.join(b, ["src", "dst"], "full").select("src", "dst", bucket.alias("bucket"))


def scores(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: found, gold, confirmed, precision, recall, f1; a ratio with nothing below is 0. gold: src, dst, tier."""
    both = found.select("src", "dst", F.lit(1).alias("_f")).join(gold.select("src", "dst", "tier", F.lit(1).alias("_g")), ["src", "dst"], "full")
    n = both.agg(F.count("_f").alias("found"), F.count("_g").alias("gold"), F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("confirmed"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumn("precision", share(F.col("confirmed"), F.col("found"))).withColumn("recall", share(F.col("confirmed"), F.col("gold")))
    return n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def tier_recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """tier, gold, confirmed."""
    hit = gold.join(found.select("src", "dst", F.lit(True).alias("_f")).distinct(), ["src", "dst"], "left")
    return hit.groupBy("tier").agg(F.count("*").alias("gold"), F.count("_f").alias("confirmed"))


# What in a description tells a numeric relation.
NUMERIC = r"\bEq\b|\bEqs\b|Equation|Exhibit|coefficient|threshold|=\s*\S"


def tier(description: Column, audited: Column) -> Column:
    """An audited tier (of the two there are), else numeric where the description names an equation, an exhibit, a coefficient or a threshold, else definitional."""
    told = F.when(F.coalesce(description, F.lit("")).rlike(f"(?i){NUMERIC}"), "numeric").otherwise("definitional")
    return F.when(audited.isin("definitional", "numeric"), audited).otherwise(told)


# The kinds of edges that have a direction.
DIRECTED = ("AFFECTS", "DETERMINES", "CONSTRAINS")
TIERS = ("definitional", "numeric")


def gold_edges(relations: DataFrame, labels: DataFrame, facility: str | None = None) -> DataFrame:
    """src, dst, tier: the curated edges that texts of the corpus can tell: directed ones, of a facility if one is given, without those that are labelled as out of corpus.

    relations: from_field, to_field, type, facility_type, description, ord; of equal edges the last description counts. labels: tier_labels().
    """
    some = relations.where(F.col("type").isin(*DIRECTED) & (F.lit(facility is None) | F.col("facility_type").eqNullSafe(F.lit(facility))))
    one = some.groupBy(F.col("from_field").alias("src"), F.col("to_field").alias("dst")).agg(F.max_by("description", "ord").alias("description"))
    told = one.join(labels.select("src", "dst", F.col("tier").alias("_tier"), F.col("out_of_corpus").alias("_out")), ["src", "dst"], "left").where(~F.coalesce("_out", F.lit(False)))
    return told.select("src", "dst", tier(F.col("description"), F.col("_tier")).alias("tier"))


def tier_agreement(found: DataFrame, gold: DataFrame) -> DataFrame:
    """tier, found, gold, confirmed, precision, recall, f1: a row for all edges and one for each tier, where found and precision say nothing.

    A ratio is null where there is nothing to divide by; f1 is 0 where gold edges aren't found, null without any. Equal found edges count once.
    """
    both = found.select("src", "dst").distinct().withColumn("_f", F.lit(True)).join(gold.select("src", "dst", "tier", F.lit(True).alias("_g")), ["src", "dst"], "full")
    hit = F.col("_f").isNotNull() & F.col("_g").isNotNull()
    counts = [F.count("_f").alias("found"), F.count("_g").alias("gold"), F.count_if(hit).alias("confirmed")]
    counts += [F.count_if(cond & (F.col("tier") == t)).alias(f"{k}_{t}") for t in TIERS for k, cond in (("gold", F.col("_g")), ("confirmed", hit))]
    none = F.lit(None).cast("bigint")
    row = lambda t, f, g, c: F.struct(F.lit(t).alias("tier"), f.alias("found"), F.col(g).alias("gold"), F.col(c).alias("confirmed"))
    rows = both.agg(*counts).select(F.inline(F.array(row("all", F.col("found"), "gold", "confirmed"), *(row(t, none, f"gold_{t}", f"confirmed_{t}") for t in TIERS))))
    rows = rows.withColumn("precision", F.try_divide("confirmed", "found")).withColumn("recall", F.try_divide("confirmed", "gold"))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).when((F.col("tier") == "all") & (F.col("gold") > 0), 0.0))


def basis_confusion(found: DataFrame, gold: DataFrame) -> DataFrame:
    """tier, said, n: what basis confirmed edges are claimed to have, by the tier that they are of. found: src, dst, basis, ord; of equal edges the last counts (of equally numbered ones the greatest basis). No basis, or an empty one, is `unstated`."""
    said = F.coalesce(F.nullif(F.col("basis"), F.lit("")), F.lit("unstated"))
    last = found.select("src", "dst", "ord", said.alias("said")).groupBy("src", "dst").agg(F.max(F.struct("ord", "said")).alias("_"))
    return last.select("src", "dst", "_.said").join(gold.select("src", "dst", "tier"), ["src", "dst"]).groupBy("tier", "said").agg(F.count("*").alias("n"))


# How code spells fields otherwise, what a function's name says that it gives, arguments that are no quantities, and functions that are no steps.
CODE_ALIASES = {"ffs_adj": "ffs", "capacity_adj": "capacity", "fd": "followers_density", "s_pl": "avg_speed", "cap": "capacity", "vd": "flow_rate", "pf": "percent_followers", "lw": "lane_width"}
OUTPUT_SUFFIXES = {"_los": "los"}
COUNTERS = ("seg_num", "i", "index")
NO_STEP_PREFIXES = ("get_", "set_", "with_", "new")
NO_STEPS = (
    "new", "default", "apply_defaults", "set_segments", "run_operational_analysis", "get_analysis_summary",
    "urban_freeway", "rural_freeway", "urban_multilane", "rural_multilane", "suburban_multilane_high_density",
)


def functions_of(code: DataFrame, keys: list[str], source: str) -> DataFrame:
    """keys, name, args, body, line: the functions in source texts, by matching braces; of those with one name in a text the last counts.

    Nesting is no regular language, so this runs in Python, a batch of texts at a time. A null text has no functions, and what is never closed is none.
    """
    head = re.compile(r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\s*\(")
    given = re.compile(r"(?:^|,)\s*(?:mut\s+)?(\w+)\s*:(?!:)")
    brace = re.compile(r"[{}]")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for rec in p.to_dict("records"):
                text, last = rec[source] or "", {}
                for m in head.finditer(text):
                    depth, stop = 0, text.find(")", m.end())
                    start = text.find("{", max(stop, m.end()))
                    for b in brace.finditer(text, start) if start >= 0 else ():
                        depth += 1 if b[0] == "{" else -1
                        if not depth:
                            last[m[1]] = [m[1], given.findall(text[m.end() : stop]), text[start + 1 : b.start()], text.count("\n", 0, m.start()) + 1]
                            break
                rows += [[*(rec[k] for k in keys), *f] for f in last.values()]
            yield pd.DataFrame(rows, columns=[*keys, "name", "args", "body", "line"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in code.select(*keys).schema)
    return code.select(*keys, source).mapInPandas(parse, f"{kinds}, name string, args array<string>, body string, line int")


def dataflow(functions: DataFrame, keys: list[str], known: list[str] | Column, aliases: dict[str, str] | None = None, suffixes: dict[str, str] | None = None) -> DataFrame:
    """functions (of functions_of) with the known fields that each reads and writes, itself or in functions it calls on its own object, one level deep.

    Reads are getters, fields and arguments, writes are setters and assignments, compound ones too; a field that is assigned isn't read. A name that is known stands
    for itself, any other for its alias; what is known by neither is no field. A function that writes nothing may give what its name ends with. known: a
    list, or a column of the fields of each function's facility.
    """
    aliases, suffixes = CODE_ALIASES if aliases is None else aliases, OUTPUT_SUFFIXES if suffixes is None else suffixes
    names = known if isinstance(known, Column) else F.array(*map(F.lit, known)).cast("array<string>")
    meant = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)).cast("map<string,string>")
    found = lambda *patterns: F.array_distinct(F.concat(*(F.regexp_extract_all("body", F.lit(p), F.lit(1)) for p in patterns)))
    field = lambda raw: F.array_intersect(F.transform(raw, lambda x: F.when(F.array_contains(names, x), x).otherwise(F.coalesce(meant[x], x))), names)

    args = F.array_except("args", F.array(*map(F.lit, COUNTERS))) if "args" in functions.columns else F.array().cast("array<string>")
    raw = functions.withColumn("_set", found(r"\.set_(\w+)\s*\(", r"\bself\.(\w+)\s*[+\-*/]?=[^=]")).withColumn("_got", F.concat(found(r"\.get_(\w+)\s*\(", r"\bself\.(\w+)\b(?!\s*\()"), args))
    implied = F.array_intersect(F.array_compact(F.array(*(F.when(F.endswith("name", F.lit(end)), F.lit(out)) for end, out in suffixes.items()))).cast("array<string>"), names)
    line = ["line"] if "line" in functions.columns else []
    called = F.filter(found(r"\bself\.(\w+)\s*\("), lambda c: ~(F.startswith(c, F.lit("get_")) | F.startswith(c, F.lit("set_"))))
    flow = raw.select(*keys, "name", *line, F.array_except(field(F.col("_got")), "_set").alias("reads"), field(F.col("_set")).alias("_w"), implied.alias("_i"), called.alias("calls"))
    flow = flow.select(*keys, "name", *line, "reads", F.when(F.size("_w") > 0, F.col("_w")).otherwise(F.col("_i")).alias("writes"), "calls")
    # As many callees as functions: never broadcast, though a small file of sources looks as if they could be.
    callee = flow.select(*keys, F.col("name").alias("_name"), F.col("reads").alias("_r"), F.col("writes").alias("_w")).hint("merge")
    out = flow.select(*keys, "name", *line, "reads", "writes", F.explode_outer("calls").alias("_name")).join(callee, [*keys, "_name"], "left")
    merge = lambda own, more: F.array_sort(F.array_distinct(F.flatten(F.array(F.first(own), F.flatten(F.collect_list(more))))))
    return out.groupBy(*keys, "name", *line).agg(merge("reads", "_r").alias("reads"), merge("writes", "_w").alias("writes"))


def is_step(name: Column) -> Column:
    """Whether a function is a step of a method: no constructor, accessor or driver of others."""
    prefixed = reduce(Column.__or__, (F.startswith(name, F.lit(p)) for p in NO_STEP_PREFIXES))
    return ~(name.isin(*NO_STEPS) | prefixed)


def induced_pairs(flow: DataFrame) -> DataFrame:
    """src, dst, name: each field that a function reads with each that it writes."""
    return flow.select("name", F.explode("reads").alias("src"), "writes").select("name", "src", F.explode("writes").alias("dst")).where("src <> dst").distinct()


def code_edges(code: DataFrame, keys: list[str], source: str, known: list[str] | Column, aliases: dict[str, str] | None = None, suffixes: dict[str, str] | None = None) -> DataFrame:
    """src, dst, type, keys, name, line, origin, status: candidate edges that the steps in source texts induce, with the function that is the evidence of each."""
    flow = dataflow(functions_of(code, keys, source), keys, known, aliases, suffixes).where(is_step(F.col("name")))
    pairs = flow.select(*keys, "name", "line", F.explode("reads").alias("src"), "writes").withColumn("dst", F.explode("writes")).where("src <> dst")
    return pairs.select("src", "dst", F.lit("AFFECTS").alias("type"), *keys, "name", "line", F.lit("code_derived").alias("origin"), F.lit("candidate_unaudited").alias("status"))


def induced_edges(flow: DataFrame) -> DataFrame:
    """src, dst, evidence: the functions, by name, that tie two fields together; their list is as long as there are such functions."""
    return induced_pairs(flow).groupBy("src", "dst").agg(F.array_sort(F.collect_set("name")).alias("evidence"))
