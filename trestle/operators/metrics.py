"""Counts and ratios over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Ranges of values into which each key is cut.
RANGES = 256


def ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(none))


def confusion(rows: DataFrame, expected: Column, found: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, tp, tn, fp, fn, accuracy, precision, recall, f1; positive means rejected."""
    n = rows.groupBy(*keys).agg(F.count_if(expected & found).alias("tp"), F.count_if(~expected & ~found).alias("tn"), F.count_if(~expected & found).alias("fp"), F.count_if(expected & ~found).alias("fn"))
    n = n.withColumn("accuracy", F.round(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6))
    n = n.withColumn("_p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("_r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("precision", F.round("_p", 6)).withColumn("recall", F.round("_r", 6)).withColumn("f1", F.round(ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), 6)).drop("_p", "_r")


def order_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, median, p95: the value at place int(0.95 n) of the sorted ones.

    Distinct values are counted first, so that a frequent one is one row; then they are ranked in ranges of each key, cut at approximate quantiles, so that neither
    a key with most rows nor one with extreme values is gathered: a coarse pass counts by range, and the ranges that hold a place are looked into.
    """
    from pyspark.sql import Window

    rows = rows.where(F.col(value).isNotNull())
    cuts = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000)
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.array_distinct(cuts).alias("_cuts"))
    at = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    binned = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).withColumnRenamed("_v", value).join(n, keys).select(*keys, value, "_c", "n", at.alias("_bin"))
    counts = binned.groupBy(*keys, "_bin", "n").agg(F.sum("_c").alias("_in"))
    counts = counts.withColumn("_before", F.sum("_in").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_in"))
    places = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95)))
    wanted = counts.select(*keys, "_bin", "_before", "_in", F.posexplode(places).alias("_k", "_place")).where("_place >= _before AND _place < _before + _in")
    inside = binned.join(wanted.select(*keys, "_bin", "_k", "_before", "_place"), [*keys, "_bin"])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy(value)) + F.col("_before")
    ranked = inside.withColumn("_upto", upto).where("_place < _upto AND _place >= _upto - _c")
    found = ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("_k") == k, F.col(value))).alias(f"_v{k}") for k in range(3)))
    return n.join(found, keys).select(*keys, "n", F.round("mean", 6).alias("mean"), F.round((F.col("_v0") + F.col("_v1")) / 2, 6).alias("median"), F.round("_v2", 6).alias("p95"))


def pass_rates(rows: DataFrame, levels: list[str], ok: Column) -> DataFrame:
    """levels (null where rolled up), checked, valid, rate: for each prefix of the levels."""
    return rows.rollup(*levels).agg(F.count("*").alias("checked"), F.count_if(ok).alias("valid"), F.grouping_id().cast("int").alias("level")).withColumn("rate", F.round(ratio(F.col("valid"), F.col("checked")), 6))
