"""Graphs kept in step with the tables that they come from: only what differs is written, batch by batch.

A graph is two tables, nodes (id, label, scope, props) and edges (src, dst, type, scope, props), each kept as a log: a folder for each batch with what it added, changed and
deleted. The state before a batch follows from the logs before it, so a batch that is given again writes what it wrote before, and one that broke off is made whole. Every so
many batches the state is written down, so that a reader meets a bounded number of logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.streaming.debounce import sessions

KEYS = {"nodes": ["id"], "edges": ["src", "dst", "type"]}
COLUMNS = {"nodes": "id string, label string, scope string, props string", "edges": "src string, dst string, type string, scope string, props string"}
#: Batches from one state that is written down to the next.
SNAPSHOT = 16

Graph = tuple[DataFrame, DataFrame]


def changes(held: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of held and op: add and change with the wanted values, delete with the held ones. Rows that are equal aren't in it; of several wanted rows with equal keys the smallest holds. Keys aren't null."""
    rest = [c for c in held.columns if c not in keys]
    one = wanted.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_w"))
    both = held.select(*keys, F.struct(*rest).alias("_h")).join(one, keys, "full")
    op = F.when(F.col("_h").isNull(), "add").when(F.col("_w").isNull(), "delete").when(~F.col("_h").eqNullSafe(F.col("_w")), "change")
    differ = both.withColumn("op", op).where("op IS NOT NULL").select(*keys, F.coalesce("_w", "_h").alias("_"), "op")
    return differ.select(*keys, *(F.col(f"_.{c}").alias(c) for c in rest), "op")


def _batches(spark: SparkSession, path: str, kind: str, name: str) -> list[int]:
    """The numbers of the whole folders of that name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{name}")
    fs = at.getFileSystem(conf)
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def log(spark: SparkSession, path: str, kind: str, after: int = -1, before: int | None = None) -> DataFrame:
    """What the batches in between (all, if no bounds are given) did: the table's columns, op and batch."""
    logs = [b for b in _batches(spark, path, kind, "log") if b > after and (before is None or b < before)]
    out = spark.createDataFrame([], f"{COLUMNS[kind]}, op string, batch long")
    if not logs:
        return out
    return spark.read.schema(f"{COLUMNS[kind]}, op string, batch long").parquet(*(f"{path}/{kind}/log/{b}" for b in logs))


def state(spark: SparkSession, path: str, kind: str, before: int | None = None) -> DataFrame:
    """The table as it is after all batches, or as it was before one: the last state written down, and for each key the last thing that was done to it since."""
    taken = [b for b in _batches(spark, path, kind, "state") if before is None or b < before]
    base = spark.read.schema(COLUMNS[kind]).parquet(f"{path}/{kind}/state/{taken[-1]}") if taken else spark.createDataFrame([], COLUMNS[kind])
    done = base.withColumns({"op": F.lit("add"), "batch": F.lit(-1).cast("long")}).unionByName(log(spark, path, kind, taken[-1] if taken else -1, before))
    rest = [c for c in base.columns if c not in KEYS[kind]]
    last = done.groupBy(*KEYS[kind]).agg(F.max_by(F.struct(*rest, "op"), "batch").alias("_"))
    return last.where("_.op <> 'delete'").select(*KEYS[kind], *(F.col(f"_.{c}").alias(c) for c in rest))


def synced(spark: SparkSession, path: str, batch: int, wanted: Graph, scopes: DataFrame | None = None) -> None:
    """Brings the graph under path to what is wanted, as that batch. scopes (a column scope): only what is, or ought to be, in one of them is looked at; the rest stays.

    Batches come in the order of their numbers; the last one may come again. Nodes come before edges: a batch that broke off in between has both written when it comes again.
    """
    for (kind, keys), want in zip(KEYS.items(), wanted, strict=True):
        held = state(spark, path, kind, batch)
        if scopes is not None:
            some = scopes.select("scope").distinct()
            held, want = held.join(some, "scope", "left_semi"), want.join(some, "scope", "left_semi")
        columns = held.select(*(c.split()[0] for c in COLUMNS[kind].split(", "))).columns
        diff = changes(held.select(*columns), want.select(*columns), keys)
        diff.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/{kind}/log/{batch}")
        if batch % SNAPSHOT == SNAPSHOT - 1:
            state(spark, path, kind, batch + 1).write.mode("overwrite").parquet(f"{path}/{kind}/state/{batch}")


def follow(events: DataFrame, path: str, wanted: Callable[[DataFrame], Graph], checkpoint: str, delay: str = "5 seconds", late: str = "1 minute"):
    """Starts the stream: events (scope, ts) mark scopes as changed; once a scope has been quiet for the delay, its part of the graph is brought up to what wanted(scopes) gives."""

    def on_batch(closed: DataFrame, batch: int) -> None:
        synced(closed.sparkSession, path, batch, wanted(closed.select("scope").distinct()), closed)

    bursts = sessions(events, ["scope"], delay=delay, late=late)
    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()


def graph_of(store) -> Graph:
    """The graph of a corpus in keyed tables: documents and references, condition types and values, parameters and rules, and what ties them."""
    none = F.lit(None).cast("string")
    node = lambda df, label, id, *props: df.select(F.concat(F.lit(f"{label.lower()}_"), F.col(id).cast("string")).alias("id"), F.lit(label).alias("label"), none.alias("scope"), F.to_json(F.struct(*props)).alias("props"))
    edge = lambda df, type, a, src, b, dst: df.select(F.concat(F.lit(f"{a}_"), F.col(src).cast("string")).alias("src"), F.concat(F.lit(f"{b}_"), F.col(dst).cast("string")).alias("dst"), F.lit(type).alias("type"), none.alias("scope"), none.alias("props"))
    cited = store.rules.where("chapter IS NOT NULL OR section IS NOT NULL OR exhibit IS NOT NULL")
    nodes = [
        node(store.docs, "Doc", "doc_id", "title", "abbreviation", "jurisdiction", "priority"), node(cited, "Ref", "rule_id", "chapter", "section", "exhibit"), node(store.types, "Type", "type_id", "type"),
        node(store.values, "Value", "value_id", "value", "display_name"), node(store.parameters, "Parameter", "param_id", "name", "rust_field", "facility_type", "unit", "data_type", "typical_min", "typical_max"),
        node(store.rules, "Rule", "rule_id", "name", "rule_type", "severity", "min_value", "max_value", "allowed_values", "formula"),
    ]
    edges = [
        edge(cited.where("doc_id IS NOT NULL"), "IN_DOCUMENT", "ref", "rule_id", "doc", "doc_id"), edge(cited, "CITED_IN", "rule", "rule_id", "ref", "rule_id"), edge(store.values, "OF_TYPE", "value", "value_id", "type", "type_id"),
        edge(store.rules, "VALIDATES", "rule", "rule_id", "parameter", "param_id"), edge(store.conditions, "REQUIRES", "rule", "rule_id", "value", "value_id"),
    ]
    out = []
    for parts in (nodes, edges):
        whole = parts[0]
        for x in parts[1:]:
            whole = whole.unionByName(x)
        out.append(whole)
    return out[0], out[1]
