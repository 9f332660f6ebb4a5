"""Designs: records of engineering parameters, taken from line items by fixed arithmetic, wide, long and nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells line items apart.
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]

#: A design's parameters as SQL over a line item, in either dialect.
PARAMETERS = {
    "lane_width": "8.0 + (l_linenumber % 6)",
    "shoulder_width": "l_quantity / 5.0",
    "hor_class": "cast(l_quantity AS int) % 8",
    "passing_type": "l_linenumber % 4",
    "vertical_class": "l_linenumber % 7",
    "design_rad": "l_extendedprice / 40.0",
    "spl": "25 + 5 * (l_partkey % 12)",
    "phf": "0.45 + l_discount * 6",
    "phv": "l_quantity * 2.5 - 4",
    "grade": "(l_tax - 0.04) * 300",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def designs(spark: SparkSession, sf_dir: str, *parameters: str) -> DataFrame:
    """The key columns and the parameters (all, if none is named) as doubles."""
    names = parameters or tuple(PARAMETERS)
    return table(spark, sf_dir, "lineitem").select(*KEY, *(F.expr(f"cast({PARAMETERS[p]} AS double)").alias(p) for p in names))


def designs_sql(*parameters: str) -> str:
    names = parameters or tuple(PARAMETERS)
    return "SELECT " + ", ".join([*KEY, *(f"cast({PARAMETERS[p]} AS double) AS {p}" for p in names)]) + " FROM lineitem"


def long_format(wide: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """keys, param, value: a row for each parameter that is there. One pass, no shuffle."""
    pairs = F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in parameters))
    return wide.select(*keys, F.explode(pairs).alias("_")).select(*keys, "_.param", "_.value").where("value IS NOT NULL")


def values_of(wide: DataFrame, parameters: list[str]) -> Column:
    """A map of the parameters that are there."""
    pairs = F.array(*(F.struct(F.lit(p).alias("k"), F.col(p).cast("double").alias("v")) for p in parameters))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))
