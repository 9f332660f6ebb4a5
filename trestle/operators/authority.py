"""Whose rules come first: by the jurisdictions and priorities of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much better sources of the jurisdiction asked for are, the best priority there is, and that of rules without sources.
BOOST, BEST, UNKNOWN = 50, 1, 100


def priority(sources: Column, jurisdiction: Column | None = None) -> Column:
    """The best (smallest) priority of a rule's sources (jurisdiction, priority), in which those of the jurisdiction asked for are better; that of unknown ones where there are none. A source without a priority has no say."""
    asked = F.lit(None).cast("string") if jurisdiction is None else F.lower(jurisdiction)
    best = F.array_min(F.transform(sources, lambda s: F.when((F.lower(s["jurisdiction"]) == asked) & s["priority"].isNotNull(), F.greatest(F.lit(BEST), s["priority"] - BOOST)).otherwise(s["priority"])))
    return F.coalesce(best, F.lit(UNKNOWN))


def is_of(sources: Column, jurisdiction: Column) -> Column:
    """Whether any source of a rule is of a jurisdiction, in whatever case; false without sources."""
    return F.coalesce(F.exists(sources, lambda s: F.coalesce(F.lower(s["jurisdiction"]) == F.lower(jurisdiction), F.lit(False))), F.lit(False))


def authority(sources: Column) -> Column:
    """The greatest priority of a rule's sources, 0 without any: in corpora where more is better, rules are ordered by it, descending, and by their place."""
    return F.coalesce(F.greatest(F.lit(0), F.array_max(F.transform(sources, lambda s: s["priority"]))), F.lit(0))


def most_specific(rules: DataFrame, param: str, jurisdiction: Column | None = None, sources: str = "sources") -> DataFrame:
    """rules with prio: for each parameter the rules of the best priority, ties and all. Null is a parameter. The best are found by an aggregate in parts; a parameter with most rules isn't gathered."""
    known = rules.withColumn("prio", priority(F.col(sources), jurisdiction))
    best = known.groupBy(F.col(param).alias("_p")).agg(F.min("prio").alias("_best"))
    return known.join(best, F.col(param).eqNullSafe(F.col("_p")) & (F.col("prio") == F.col("_best"))).drop("_p", "_best")
