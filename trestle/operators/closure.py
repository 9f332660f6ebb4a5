"""Closing a chain of dependent parameters: each gets a proposed value, and keeps it only if no error names it.

Proposers are columns over what is known so far. The chain is short and the same for all records, so that the whole closure is one
projection: each step's columns are built on those before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.operators.checks import fixed_checks

Proposer = Callable[[], Column]

# The speed limit that a small rule table proposes for a horizontal class of a freeway, and what is added for the base free-flow speed.
SPEED_OF_CLASS = {0: 70, 1: 70, 2: 65, 3: 60, 4: 50, 5: 45}
BASE_ABOVE_LIMIT = 5.0
#: A width beyond all rules, so that rejections can be seen.
BAD_WIDTH = 14.0


def table_proposers() -> dict[str, Proposer]:
    """Proposals of the rule table: a value, or null to decline."""
    speed = F.element_at(F.create_map(*(F.lit(x) for k, v in SPEED_OF_CLASS.items() for x in (k, float(v)))), F.col("hor_class").cast("int"))
    return {"speed_limit": lambda: speed, "bffs": lambda: F.col("speed_limit") + BASE_ABOVE_LIMIT, "lane_width": lambda: F.lit(BAD_WIDTH)}


def accepted(param: str, known: list[str]) -> Column:
    """Whether no error-level check of all that is known names the parameter: what breaks a check that names another one isn't its fault."""
    own = [c.there & c.broken.isNotNull() for c in fixed_checks({*known, param}) if c.param == param and c.severity == "error"]
    return ~reduce(Column.__or__, own, F.lit(False))


def closed(roots: DataFrame, chain: list[str], proposers: dict[str, Proposer]) -> DataFrame:
    """roots with a column for each parameter of the chain (null if rejected or not proposed), and its `_state`: accepted, rejected or no_proposal."""
    out = roots
    for k, p in enumerate(chain):
        known = [c for c in (*roots.columns, *chain[:k]) if c in out.columns]
        proposed = proposers[p]() if p in proposers else F.lit(None).cast("double")
        out = out.withColumn(p, proposed.cast("double"))
        state = F.when(F.col(p).isNull(), "no_proposal").when(accepted(p, known), "accepted").otherwise("rejected")
        out = out.withColumn(f"{p}_state", state).withColumn(p, F.when(F.col(f"{p}_state") == "accepted", F.col(p)))
    return out


def counters(closed_: DataFrame, chain: list[str]) -> DataFrame:
    """param, accepted, rejected, no_proposal."""
    long = closed_.select(F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(f"{p}_state").alias("state")) for p in chain))).alias("_")).select("_.*")
    return long.groupBy("param").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "rejected", "no_proposal")))
