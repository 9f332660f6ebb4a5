"""Repair and inverse design: grids of trial values, evaluated as columns and ranked by windows.

An executor is a function from a table of designs to the same table with what it computes; a goal is a column over that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Executor = Callable[[DataFrame], DataFrame]
NEAR = 1e-9


def grid(lo: Column, hi: Column, steps: int) -> Column:
    """So many evenly spaced values from lo to hi; none for an empty range."""
    return F.when((hi > lo) & (F.lit(steps) >= 2), F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: lo + (hi - lo) * i / (steps - 1))).otherwise(F.array().cast("array<double>"))


def _nearest(p: str, place: int, lo: float, hi: float, steps: int) -> Column:
    """A lever's trial values as (lever, place, trial, rank), the nearest first."""
    near = _others(p, lo, hi, steps)
    ordered = F.array_sort(F.transform(near, lambda v: F.struct(F.abs(v - F.col(p)).alias("far"), v.alias("trial"))))
    return F.transform(ordered, lambda x, i: F.struct(F.lit(p).alias("lever"), F.lit(place).alias("place"), x["trial"].alias("trial"), (i + 1).alias("rank")))


def _others(p: str, lo: float, hi: float, steps: int) -> Column:
    """The grid without the current value."""
    return F.filter(grid(F.lit(float(lo)), F.lit(float(hi)), steps), lambda v: F.abs(v - F.col(p)) > NEAR)


def trials(designs: DataFrame, levers: dict[str, tuple[float, float]], steps: int) -> DataFrame:
    """designs with lever, place (of the lever), trial, rank: all trial values of each lever, the nearest first, without the current one."""
    options = [_nearest(p, place, lo, hi, steps) for place, (p, (lo, hi)) in enumerate(levers.items())]
    return designs.withColumn("_", F.explode(F.flatten(F.array(*options)))).select(*designs.columns, "_.*")


def changed(design: dict[str, Column], lever: Column, trial: Column) -> list[Column]:
    return [F.when(lever == p, trial).otherwise(c).alias(p) for p, c in design.items()]


def relative(old: Column, new: Column) -> Column:
    """The size of a change, relative to the old value unless that is 0."""
    return F.when(old == 0, F.abs(new - old)).otherwise(F.abs((new - old) / old))


def single_repairs(designs: DataFrame, keys: list[str], levers: dict[str, tuple[float, float]], executor: Executor, goal: Column, steps: int = 7, budget: int | None = None) -> DataFrame:
    """keys, lever, old, trial, rank, delta: for each design and lever the nearest value that meets the goal.

    Designs that meet it already have no row. With a budget a design's evaluations are counted as a one-by-one search would make them: the design itself,
    then each lever's trials up to its first hit; hits that lie beyond it don't count.
    """
    parameters = list(levers)
    # Designs are dealt out before they are multiplied; grids and groups are then of one task, and their least ranks are plain numbers, which need no sort.
    base = executor(designs.repartition(*keys)).where(~F.coalesce(goal, F.lit(False))).select(*designs.columns)
    tried = trials(base, levers, steps)
    now = tried.select(*keys, *changed({p: F.col(p) for p in parameters}, F.col("lever"), F.col("trial")), *(F.col(p).alias(f"_old_{p}") for p in parameters), "lever", "place", "trial", "rank")
    done = executor(now).withColumn("hit", F.coalesce(goal, F.lit(False)))
    old = F.coalesce(*(F.when(F.col("lever") == p, F.col(f"_old_{p}")) for p in parameters))
    per = done.groupBy(*keys, "lever", "place").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.min_by("trial", F.when(F.col("hit"), F.col("rank"))).alias("trial"), F.count("*").alias("size"), F.first(old).alias("old"))
    if budget is not None:
        used = F.coalesce("first", "size").cast("long")
        before = F.coalesce(F.sum(used).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
        per = per.withColumn("before", before).where(F.col("before") + F.col("first") <= budget)
    found = per.where("first IS NOT NULL").select(*keys, "lever", "old", "trial", F.col("first").alias("rank"))
    return found.withColumn("delta", relative(F.col("old"), F.col("trial")))


def pair_repairs(designs: DataFrame, keys: list[str], levers: dict[str, tuple[float, float]], executor: Executor, goal: Column, steps: int = 7, most: int = 5) -> DataFrame:
    """keys, lever_a, lever_b, trial_a, trial_b, delta: for each pair of the first levers the smallest change of both that meets the goal; for designs that neither meet it nor have a single repair."""
    coarse, parameters = max(3, steps // 2 + 1), list(levers)
    singles = single_repairs(designs, keys, levers, executor, goal, steps).select(*keys).distinct()
    base = executor(designs.repartition(*keys)).where(~F.coalesce(goal, F.lit(False))).select(*designs.columns).join(singles.hint("merge"), keys, "left_anti")
    first = parameters[:most]
    lists = {p: _others(p, *levers[p], coarse) for p in first}
    both_of = lambda a, b: F.transform(lists[a], lambda v: F.struct(F.lit(a).alias("lever_a"), F.lit(b).alias("lever_b"), v.alias("trial_a")))
    options = [both_of(a, b) for i, a in enumerate(first) for b in first[i + 1 :]]
    half = base.withColumn("_a", F.explode(F.flatten(F.array(*options))))
    second = F.coalesce(*(F.when(F.col("_a.lever_b") == p, lists[p]) for p in first))
    both = half.withColumn("trial_b", F.explode(second)).select(*base.columns, "_a.*", "trial_b")
    value = lambda p: F.when(F.col("lever_a") == p, F.col("trial_a")).when(F.col("lever_b") == p, F.col("trial_b")).otherwise(F.col(p))
    delta = sum((F.when((F.col("lever_a") == p) | (F.col("lever_b") == p), relative(F.col(p), value(p))).otherwise(0.0) for p in parameters), F.lit(0.0))
    now = both.select(*keys, *(value(p).alias(p) for p in parameters), delta.alias("delta"), "lever_a", "lever_b", "trial_a", "trial_b")
    hits = executor(now).where(goal)
    best = hits.groupBy(*keys, "lever_a", "lever_b").agg(F.min(F.struct(F.round("delta", 9).alias("delta"), "trial_a", "trial_b")).alias("_"))
    return best.select(*keys, "lever_a", "lever_b", "_.*")


def ranked(singles: DataFrame, pairs: DataFrame, keys: list[str], confidence: dict[str, float] | None = None) -> DataFrame:
    """keys, levers, cardinality, delta, confidence, place: all repairs of a design in order: the fewest changes, the smallest change in all, the most trusted levers.

    singles, pairs: of single_repairs() and pair_repairs(); all of them meet the goal. confidence: of each lever's path, 1 where it isn't given; a pair has the lower one. Ties go by the levers' names.
    """
    trust = lambda c: reduce(lambda out, kv: F.when(F.col(c) == kv[0], kv[1]).otherwise(out), (confidence or {}).items(), F.lit(1.0))
    one = singles.select(*keys, F.array("lever").alias("levers"), F.lit(1).alias("cardinality"), "delta", trust("lever").alias("confidence"))
    two = pairs.select(*keys, F.array("lever_a", "lever_b").alias("levers"), F.lit(2).alias("cardinality"), "delta", F.least(trust("lever_a"), trust("lever_b")).alias("confidence"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("cardinality", F.round("delta", 9), F.col("confidence").desc(), "levers"))
    return one.unionByName(two).withColumn("place", place)


def inverse_designs(sites: DataFrame, keys: list[str], free: dict[str, tuple[float, float]], executor: Executor, goal: Column, steps: int = 5, most: int = 500, cheap_high: tuple[str, ...] = ("apd",)) -> DataFrame:
    """keys, the free parameters, cost, place, truncated: the designs of the grid that meet the goal at each site, of its first `most` points in row-major order.

    place: by cost, then by the values. The grid is a bounded list, the same for all sites, and is exploded within the row.
    """
    out, size = sites.withColumn("ordinal", F.lit(0)), 1
    for p, (lo, hi) in free.items():
        points = [lo] if steps < 2 or lo == hi else [round(lo + (hi - lo) * i / (steps - 1), 6) for i in range(steps)]
        size *= len(points)
        out = out.withColumn("_", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(points)))))
        out = out.withColumn(p, F.col("_.v")).withColumn("ordinal", F.col("ordinal") * len(points) + F.col("_.i")).drop("_")
    share = lambda p, lo, hi: (F.col(p) - lo) / (hi - lo) if hi != lo else F.lit(0.0)
    cost = sum(((1 - share(p, *b) if p in cheap_high else share(p, *b)) for p, b in free.items()), F.lit(0.0))
    done = executor(out.where(F.col("ordinal") < most)).where(goal).withColumn("cost", F.round(cost, 6))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("cost", *sorted(free)))
    return done.withColumn("place", place).withColumn("truncated", F.lit(size > most)).select(*keys, *free, "cost", "place", "truncated")


def envelope(feasible: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """keys, feasible (their number), each parameter's least and largest feasible value, and the least cost."""
    return feasible.groupBy(*keys).agg(F.count("*").alias("feasible"), *(f(p).alias(f"{n}_{p}") for p in parameters for f, n in ((F.min, "min"), (F.max, "max"))), F.min("cost").alias("least_cost"))


def linear(weights: dict[str, float], out: str = "y") -> Executor:
    """An executor that sums up weighted parameters."""
    return lambda df: df.withColumn(out, sum((F.col(p) * w for p, w in weights.items()), F.lit(0.0)))


def los_at_most(letter: str, los: str = "los") -> Column:
    """Whether a level of service is this letter or a better one; without one it is F."""
    return F.upper(F.trim(F.coalesce(F.col(los), F.lit("F")))) <= letter.upper()
