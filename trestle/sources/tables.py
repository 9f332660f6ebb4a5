"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset: under the warehouse on a cluster, else under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _unset(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir"))
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@functools.lru_cache(None)
def _unset(master: str, warehouse: str) -> str:
    local = master.startswith("local") and "cluster" not in master
    return tempfile.mkdtemp(prefix="spark-") if local else f"{warehouse.rstrip('/')}/_work"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a relation whose size the planner knows, so that a join with them needs no shuffle. (Rows of an RDD count as endless: both sides would be sorted by key.)"""
    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
    told = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, told, strict=True)], schema=told), schema=kind)


#: Whether Spark removes the files of a query's shuffles when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, clean: bool = False) -> DataFrame:
    """df as a table in the shared folder: computed once, and its lineage cut. clean: the files of its shuffles go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean and before is not None:
            spark.conf.set(CLEANUP, before)
        elif clean:
            spark.conf.unset(CLEANUP)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def removed(spark: SparkSession, *paths: str) -> None:
    """Removes folders that shared_dir() gave; nothing may read them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that written() gave; nothing may read them any more."""
    removed(spark, *(t.stored_at.removesuffix("/table") for t in tables))
