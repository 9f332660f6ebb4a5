"""Basic freeway segments by the published speed-flow relations, as columns.

Free-flow speed, capacity, flow rate, speed, density and level of service. The lane-width, clearance and heavy-vehicle adjustments come from public tables; what
lies between their rows is interpolated, which the tables themselves don't promise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Passenger-car equivalents, and density limits; the numbers of the adjustments below are published ones, too.
EQUIVALENT = {"level": 2.0, "rolling": 3.0}
DENSITY = [(11, "A"), (18, "B"), (26, "C"), (35, "D"), (45, "E")]


def lane_width_loss(lw: Column) -> Column:
    return F.when(lw >= 12, 0.0).when(lw >= 11, 1.9 * (12 - lw)).when(lw >= 10, 1.9 + 4.7 * (11 - lw))


def clearance_loss(lc: Column, lanes: Column) -> Column:
    rate = F.when(lanes >= 5, 0.1).when(lanes == 4, 0.2).when(lanes == 3, 0.4).when(lanes == 2, 0.6)
    return rate * (6 - F.least(lc, F.lit(6.0)))


def evaluated(designs: DataFrame) -> DataFrame:
    """designs (bffs, lw, lc_r, trd, lane_count, demand_flow_i, phf, p_t, terrain) with ffs, capacity, v_p, speed, density, vc_ratio and los; null where a value lies outside the tables."""
    ffs = F.col("bffs") - lane_width_loss(F.col("lw")) - clearance_loss(F.col("lc_r"), F.col("lane_count")) - 3.22 * F.pow("trd", F.lit(0.84))
    out = designs.withColumn("ffs", ffs).withColumn("capacity", F.least(2200 + 10 * (F.least("ffs", F.lit(70.0)) - 50), F.lit(2400.0)))
    pce = F.coalesce(*(F.when(F.col("terrain") == t, e) for t, e in EQUIVALENT.items()), F.lit(EQUIVALENT["level"]))
    out = out.withColumn("v_p", F.col("demand_flow_i") * (1 + F.col("p_t") * (pce - 1)) / (F.col("phf") * F.col("lane_count")))
    bp = 1000 + 40 * (75 - F.col("ffs"))
    bent = F.col("ffs") - (F.col("ffs") - F.col("capacity") / 45) * F.pow(F.col("v_p") - bp, F.lit(2.0)) / F.pow(F.col("capacity") - bp, F.lit(2.0))
    out = out.withColumn("vc_ratio", F.col("v_p") / F.col("capacity"))
    out = out.withColumn("speed", F.when(F.col("v_p") <= F.col("capacity"), F.when(F.col("v_p") <= bp, F.col("ffs")).otherwise(bent)))
    out = out.withColumn("density", F.col("v_p") / F.col("speed"))
    los = F.when(F.col("vc_ratio") > 1, "F")
    for limit, letter in DENSITY:
        los = los.when(F.col("density") <= limit, letter)
    return out.withColumn("los", F.when(F.col("ffs").isNotNull() & F.col("v_p").isNotNull(), los.otherwise("F")))
