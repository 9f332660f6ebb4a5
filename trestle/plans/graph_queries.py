"""Queries over contexts, questions, name resolution, citations and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.operators import authority, clarify, context, graph
from trestle.plans.registry import query
from trestle.sources.designs import table
from trestle.sources.rules import upserted
from trestle.sources.tables import written

# --- Contexts: customers' segments and nations as contexts of a few conditioned rules -----------------------------

CONDITIONED = [
    (1, "only building", [("segment", "BUILDING")]),
    (2, "building in nation 3", [("segment", "BUILDING"), ("nation", "3")]),
    (3, "automobile, low balance", [("segment", "automobile"), ("balance", "low")]),
    (4, "unconditional", []),
]


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    entries = F.array(
        F.when(F.col("c_custkey") % 3 != 0, F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v"))),
        F.when(F.col("c_custkey") % 2 != 0, F.struct(F.lit("nation").alias("k"), F.col("c_nationkey").cast("string").alias("v"))),
        F.when(F.col("c_acctbal") < 0, F.struct(F.lit("balance").alias("k"), F.lit("low").alias("v"))),
    )
    return c.select("c_custkey", F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("context"))


def _conditioned() -> Column:
    """The rules with their conditions, as a literal array: as small whatever is checked."""
    kind = "array<struct<type:string,value:string>>"
    rules = [F.struct(F.lit(i).alias("rule_id"), (F.array(*(F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in cs)) if cs else F.array()).cast(kind).alias("conditions")) for i, _, cs in CONDITIONED]
    return F.array(*rules)


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).withColumn("_", F.explode(_conditioned())).select("c_custkey", "context", "_.*")


_CONTEXT_SQL = """ctx AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 2 <> 0 THEN c_nationkey::VARCHAR END AS nation, CASE WHEN c_acctbal < 0 THEN 'low' END AS balance FROM customer),
    conds AS (SELECT * FROM (VALUES (1, 'segment', 'building'), (2, 'segment', 'building'), (2, 'nation', '3'), (3, 'segment', 'automobile'), (3, 'balance', 'low')) AS c(rule_id, type, value)),
    r AS (SELECT unnest([1, 2, 3, 4]) AS rule_id), met AS (SELECT c_custkey, rule_id, type, value, CASE type WHEN 'segment' THEN lower(segment) WHEN 'nation' THEN nation ELSE balance END AS has FROM ctx, conds),
    m AS (SELECT c_custkey, r.rule_id, count(type) AS n, count(*) FILTER (WHERE has = value) AS same, count(*) FILTER (WHERE has <> value) AS other, count(*) FILTER (WHERE type IS NOT NULL AND has IS NULL) AS open FROM ctx CROSS JOIN r LEFT JOIN met USING (c_custkey, rule_id) GROUP BY ALL)"""


@query(f"WITH {_CONTEXT_SQL} SELECT rule_id, CASE WHEN other > 0 THEN 'mismatched' WHEN open > 0 THEN 'undecidable' ELSE 'applicable' END AS state, count(*) AS n FROM m GROUP BY ALL")
def context_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).groupBy("rule_id", context.tri_state(F.col("context"), F.col("conditions")).alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {_CONTEXT_SQL} SELECT c_custkey, rule_id FROM m WHERE same = n")
def context_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).where(context.strict_match(F.col("context"), F.col("conditions"))).select("c_custkey", "rule_id")


@query(f"WITH {_CONTEXT_SQL} SELECT c_custkey, rule_id FROM m WHERE other = 0")
def context_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).where(context.lenient_match(F.col("context"), F.col("conditions"))).select("c_custkey", "rule_id")


@query("SELECT regexp_replace(lower(p_type), '[ _-]', '', 'g') AS value, count(*) AS n FROM part GROUP BY 1")
def context_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(context.norm(F.col("p_type")).alias("value")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'provided' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN 'rolling' END AS terrain, c_nationkey::VARCHAR AS nation FROM customer""")
def context_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    extracted = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    provided = F.map_from_entries(F.filter(F.array(F.when(F.col("c_custkey") % 4 == 0, F.struct(F.lit("segment").alias("k"), F.lit("provided").alias("v"))), F.when(F.col("c_custkey") % 5 == 0, F.struct(F.lit("terrain").alias("k"), F.lit("rolling").alias("v")))), lambda x: x.isNotNull()))
    m = context.merged(extracted, provided)
    return c.select("c_custkey", *(F.try_element_at(m, F.lit(k)).alias(k) for k in ("segment", "terrain", "nation")))


# --- Questions ----------------------------------------------------------------------------------------------------


@query(f"WITH {_CONTEXT_SQL} SELECT c_custkey, type AS parameter, array_to_string(list_sort(list(DISTINCT value)), ',') AS options, count(DISTINCT rule_id) AS rules FROM met JOIN m USING (c_custkey, rule_id) WHERE other = 0 AND has IS NULL GROUP BY ALL")
def ambiguous_context_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must be asked before it is clear which rules apply: the open condition types, with the values that matter."""
    open_ = _gated(spark, sf_dir).where(context.tri_state(F.col("context"), F.col("conditions")) == "undecidable")
    one = open_.select("c_custkey", "rule_id", F.explode(context.pending(F.col("context"), F.col("conditions"))).alias("c"))
    return one.groupBy("c_custkey", F.col("c.type").alias("parameter")).agg(F.array_join(F.array_sort(F.collect_set(F.lower("c.value"))), ",").alias("options"), F.count_distinct("rule_id").alias("rules"))


@query("""WITH a AS (SELECT o_custkey, 'missing' AS kind, CASE WHEN o_orderstatus = 'O' THEN 'status' END AS parameter, o_orderpriority AS message, o_orderkey AS ord, o_orderpriority AS r1, o_orderstatus AS r2 FROM orders)
    SELECT o_custkey, kind, parameter, arg_min(message, ord) AS message, array_to_string(list_sort(list_distinct(flatten(list([r1, r2])))), '|') AS related FROM a GROUP BY ALL""")
def clarification_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = table(spark, sf_dir, "orders").select("o_custkey", F.lit("missing").alias("kind"), F.when(F.col("o_orderstatus") == "O", "status").alias("parameter"), F.col("o_orderpriority").alias("message"), F.array("o_orderpriority", "o_orderstatus").alias("related"), F.col("o_orderkey").alias("ord"))
    return clarify.deduplicated(asks, ["o_custkey"]).withColumn("related", F.array_join("related", "|"))


# --- Names --------------------------------------------------------------------------------------------------------


@query("""WITH keys AS (SELECT lower(p_brand) AS key, 1 AS prio, p_partkey FROM part UNION ALL SELECT lower(p_name), 2, p_partkey FROM part UNION ALL SELECT lower(p_type), 3, p_partkey FROM part),
    best AS (SELECT key, prio, p_partkey FROM keys QUALIFY row_number() OVER (PARTITION BY key ORDER BY prio, p_partkey) = 1),
    asked AS (SELECT p_partkey AS asker, lower(CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE p_type END) AS key FROM part)
    SELECT asker, key, prio, best.p_partkey AS resolved FROM asked JOIN best USING (key)""")
def param_resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved by field, then name, then alias; of several the first. One grouping makes the index, one join uses it."""
    p = table(spark, sf_dir, "part")
    keys = p.select("p_partkey", F.posexplode(F.array(*(F.lower(c) for c in ("p_brand", "p_name", "p_type")))).alias("k", "key"))
    best = keys.groupBy("key").agg(F.min(F.struct((F.col("k") + 1).alias("prio"), F.col("p_partkey").alias("resolved"))).alias("_")).select("key", "_.*")
    asked = p.select(F.col("p_partkey").alias("asker"), F.lower(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.col("p_type"))).alias("key"))
    return asked.join(best, "key").select("asker", "key", "prio", "resolved")


@query("SELECT lower(p_type) AS key, p_size AS facility, arg_min(p_name, p_partkey) AS first_name, min(p_partkey) AS ord FROM part GROUP BY ALL")
def alias_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("key"), F.col("p_size").alias("facility")).agg(F.min_by("p_name", "p_partkey").alias("first_name"), F.min("p_partkey").alias("ord"))


@query("""WITH c AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN r_name || ', ' || n_name END AS citation, s_suppkey % 2 = 0 AS is_primary FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT p_partkey, count(citation) AS citations, coalesce(min(citation) FILTER (WHERE is_primary), min(citation)) AS picked FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON p_partkey = l_partkey LEFT JOIN c ON l_suppkey = s_suppkey GROUP BY 1""")
def rule_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's citations over its suppliers, nations and regions; a primary one is picked before others."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    c = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.concat_ws(", ", "r_name", "n_name")).alias("citation"), (F.col("s_suppkey") % 2 == 0).alias("is_primary"))
    links = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    cited = links.join(c, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.count("citation").alias("citations"), F.coalesce(F.min(F.when(F.col("is_primary"), F.col("citation"))), F.min("citation")).alias("picked"))
    return table(spark, sf_dir, "part").join(cited, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("citations", F.lit(0)).alias("citations"), "picked")


# --- Rules against rules ------------------------------------------------------------------------------------------

_RANGES = "SELECT p_partkey AS rule_id, p_brand || p_size AS param, p_retailprice AS lo, p_retailprice + p_size * 4 AS hi FROM part"


@query(f"WITH r AS ({_RANGES}) SELECT a.rule_id AS a, b.rule_id AS b, a.param FROM r a JOIN r b ON a.param = b.param AND a.rule_id < b.rule_id AND (a.hi < b.lo OR b.hi < a.lo)")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.concat("p_brand", "p_size").alias("param"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size") * 4).alias("hi"))
    return graph.disjoint_pairs(p)


@query("SELECT s_suppkey, s_nationkey, floor(s_acctbal / 1000)::INT AS priority FROM supplier QUALIFY rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) = 1")
def most_specific_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).cast("int").alias("priority"))
    best = s.groupBy("s_nationkey").agg(F.min("priority").alias("priority"))
    return s.join(best, ["s_nationkey", "priority"]).select("s_suppkey", "s_nationkey", "priority")


_SOURCES = """src AS (SELECT s_suppkey, s_nationkey, unnest([0, 1, 2]) AS k FROM supplier), one AS (SELECT s_suppkey, s_nationkey, ['federal', 'State', 'county', 'city'][(s_suppkey + k) % 4 + 1] AS jurisdiction, (s_suppkey * (k + 7)) % 90 + 10 AS priority FROM src WHERE k < s_suppkey % 3)"""


@query(f"""WITH {_SOURCES}, p AS (SELECT s.s_suppkey, s.s_nationkey, coalesce(min(CASE WHEN lower(jurisdiction) = 'state' THEN greatest(1, priority - 50) ELSE priority END), 100) AS prio, coalesce(bool_or(lower(jurisdiction) = 'state'), false) AS own, coalesce(max(priority), 0) AS authority FROM supplier s LEFT JOIN one USING (s_suppkey) GROUP BY ALL)
    SELECT * FROM p QUALIFY prio = min(prio) OVER (PARTITION BY s_nationkey)""")
def jurisdiction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rules of their nations, with up to two sources: the most specific ones if a state asks, whether they are the state's, and their authority."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    names = F.array(*map(F.lit, ["federal", "State", "county", "city"]))
    one = lambda k: F.when(F.col("s_suppkey") % 3 > k, F.struct(F.get(names, ((F.col("s_suppkey") + k) % 4).cast("int")).alias("jurisdiction"), (F.col("s_suppkey") * (k + 7) % 90 + 10).alias("priority")))
    rules = s.withColumn("sources", F.array_compact(F.array(one(0), one(1))))
    found = authority.most_specific(rules, "s_nationkey", F.lit("STATE"))
    return found.select("s_suppkey", "s_nationkey", "prio", authority.is_of(F.col("sources"), F.lit("state")).alias("own"), authority.authority(F.col("sources")).alias("authority"))


# --- Graphs -------------------------------------------------------------------------------------------------------


@query("""WITH chosen AS (SELECT p_partkey FROM part WHERE p_size = 7), e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), s1 AS (SELECT DISTINCT s FROM e JOIN chosen ON p = p_partkey)
    SELECT s_suppkey AS node FROM supplier JOIN s1 ON s = s_suppkey ORDER BY 1 LIMIT 10""")
def suggest_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten suppliers that are next to the chosen parts: the limit is what the operator is for."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    chosen = table(spark, sf_dir, "part").where("p_size = 7").select((F.col("p_partkey") * 2).alias("node"))
    return graph.suggestions(e, chosen).select(((F.col("node") - 1) / 2).cast("bigint").alias("node")).orderBy("node").limit(10)


@query("""SELECT p_partkey, count(l_suppkey) AS items, count(DISTINCT l_suppkey) AS related, count(DISTINCT s_nationkey) AS sources FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def impact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    own = l.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    impact = own.groupBy("l_partkey").agg(F.sum("n").alias("items"), F.count("l_suppkey").alias("related"), F.count_distinct("s_nationkey").alias("sources"))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("items", "related", "sources")]
    return table(spark, sf_dir, "part").join(impact, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", *counts)


@query("""SELECT 'node' AS kind, 'part' AS label, count(*) AS n FROM part UNION ALL SELECT 'node', 'supplier', count(*) FROM supplier UNION ALL SELECT 'node', 'nation', count(*) FROM nation UNION ALL SELECT 'edge', 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
    UNION ALL SELECT 'edge', 'IN_NATION', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def graph_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph that the tables are: nodes, and edges between nodes that exist."""
    tag = lambda c, k: F.concat(F.lit(k), F.col(c))
    nodes = reduce(DataFrame.unionByName, (table(spark, sf_dir, t).select(tag(c, t).alias("node"), F.lit(t).alias("label")) for t, c in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))))
    edges = table(spark, sf_dir, "lineitem").select(tag("l_partkey", "part").alias("src"), tag("l_suppkey", "supplier").alias("dst"), F.lit("SUPPLIED_BY").alias("type"))
    edges = edges.unionByName(table(spark, sf_dir, "supplier").select(tag("s_suppkey", "supplier").alias("src"), tag("s_nationkey", "nation").alias("dst"), F.lit("IN_NATION").alias("type")))
    linked = graph.linked_edges(edges, nodes)
    return nodes.groupBy(F.lit("node").alias("kind"), "label").agg(F.count("*").alias("n")).unionByName(linked.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("label")).agg(F.count("*").alias("n")))


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts that a supplier's smallest and largest items tie together: src, dst, type, source, ord, description."""
    l = table(spark, sf_dir, "lineitem")
    by = l.groupBy("l_suppkey", "l_linenumber").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("a <> b")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "DETERMINES").otherwise("AFFECTS")
    source = F.element_at(F.array(*map(F.lit, ["HCM", "AASHTO", "FHWA", "county"])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return by.select(F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("type"), source.alias("source"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ord"), F.lit("").alias("description"))


_FLOW = """flow AS (SELECT a AS src, b AS dst, CASE WHEN l_linenumber % 3 = 0 THEN 'DETERMINES' ELSE 'AFFECTS' END AS type, ['HCM', 'AASHTO', 'FHWA', 'county'][l_suppkey % 4 + 1] AS source, l_suppkey * 10 + l_linenumber AS ord
    FROM (SELECT l_suppkey, l_linenumber, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY ALL) WHERE a <> b), w AS (SELECT *, CASE source WHEN 'HCM' THEN 1.0 WHEN 'AASHTO' THEN 0.95 WHEN 'FHWA' THEN 0.9 ELSE 0.5 END AS weight FROM flow)"""


def _chain_sql(start: str, a: str, b: str, types: str) -> str:
    return f"""WITH RECURSIVE {_FLOW}, roots AS ({start}), walk AS (
        SELECT root, root AS node, 0 AS depth, []::BIGINT[] AS ords, 1.0::DOUBLE AS confidence FROM roots UNION ALL
        SELECT root, {b}, depth + 1, list_append(ords, ord), confidence * weight FROM walk JOIN w ON node = {a} WHERE depth < 10 AND type IN ({types})),
        best AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY depth, ords) = 1)
        SELECT root, node, depth, array_to_string(ords, '>') AS via, round(confidence, 6) AS confidence FROM best WHERE depth > 0"""


_ROOTS = "SELECT DISTINCT src AS root FROM flow"


@query(_chain_sql(_ROOTS, "src", "dst", "'AFFECTS'"))
def forward_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _flow(spark, sf_dir)
    roots = e.select(F.col("src").alias("root")).distinct()
    return graph.chain(e, roots).select("root", "node", "depth", F.array_join(F.col("ords").cast("array<string>"), ">").alias("via"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH c AS ({_chain_sql(_ROOTS, 'src', 'dst', chr(39) + 'AFFECTS' + chr(39))}), r AS (WITH {_FLOW} SELECT src AS root FROM flow UNION SELECT dst FROM flow) SELECT r.root, count(c.root) AS downstream, coalesce(max(depth), 0) AS max_depth FROM r LEFT JOIN c ON r.root = c.root GROUP BY 1")
def chain_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts every part affects, and over how many steps at most."""
    e = _flow(spark, sf_dir)
    roots = e.select(F.explode(F.array("src", "dst")).alias("root")).distinct()
    return graph.reach(graph.chain(e, roots), roots)


@query(_chain_sql("SELECT DISTINCT dst AS root FROM flow", "dst", "src", "'AFFECTS', 'DETERMINES', 'CONSTRAINS'"))
def backward_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _flow(spark, sf_dir)
    roots = e.select(F.col("dst").alias("root")).distinct()
    return graph.chain(e, roots, types=graph.CAUSAL, backward=True).select("root", "node", "depth", F.array_join(F.col("ords").cast("array<string>"), ">").alias("via"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_FLOW}, u AS (SELECT src AS a, dst AS b, ord, type FROM flow UNION ALL SELECT dst, src, ord, type FROM flow), one AS (SELECT a AS root, b AS node, [ord] AS used FROM u),
    two AS (SELECT root, b AS node, list_append(used, ord) AS used FROM one JOIN u ON node = a WHERE NOT list_contains(used, ord)), hit AS (SELECT DISTINCT root, node, unnest(used) AS ord FROM (SELECT * FROM one UNION ALL SELECT * FROM two))
    SELECT DISTINCT root, node, type FROM hit JOIN flow USING (ord) WHERE root <> node""")
def related_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops in any direction around every part. Edges have no description, so that types are told once."""
    e = written(_flow(spark, sf_dir))
    roots = e.select(F.explode(F.array("src", "dst")).alias("root")).distinct()
    return graph.within_hops(e, roots, 2).select("root", "node", "type")


@query(f"""WITH RECURSIVE {_FLOW}, u AS (SELECT src AS a, dst AS b, ord, type FROM flow UNION ALL SELECT dst, src, ord, type FROM flow), trail AS (SELECT a AS root, b AS node, [ord] AS used, type = 'AFFECTS' AS one, type = 'DETERMINES' AS two FROM u
    UNION SELECT root, b, list_sort(list_append(used, ord)), one OR type = 'AFFECTS', two OR type = 'DETERMINES' FROM trail JOIN u ON node = a WHERE len(used) < 4 AND NOT list_contains(used, ord))
    SELECT DISTINCT root, node, 'AFFECTS' AS type FROM trail WHERE one AND root <> node UNION ALL SELECT DISTINCT root, node, 'DETERMINES' FROM trail WHERE two AND root <> node""")
def related_four_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hops in any direction around every part; the SQL lists the trails, the operator doesn't."""
    e = written(_flow(spark, sf_dir))
    roots = e.select(F.explode(F.array("src", "dst")).alias("root")).distinct()
    return graph.within_hops(e, roots, 4).select("root", "node", "type")


@query(f"""WITH {_FLOW}, u AS (SELECT src AS a, dst AS b FROM flow WHERE type = 'AFFECTS' UNION SELECT dst, src FROM flow WHERE type = 'AFFECTS'), v AS (SELECT DISTINCT l_suppkey AS rule, l_partkey AS root FROM lineitem), c AS (SELECT DISTINCT l_suppkey AS rule, l_returnflag || l_linestatus AS ref FROM lineitem WHERE l_quantity > 45)
    SELECT root, 'rule' AS kind, rule::VARCHAR AS item, count(ref) AS n FROM v LEFT JOIN c USING (rule) GROUP BY ALL UNION ALL SELECT DISTINCT root, 'reference', ref, NULL::BIGINT FROM v JOIN c USING (rule)
    UNION ALL SELECT root, 'related', node::VARCHAR, NULL FROM (SELECT a AS root, b AS node FROM u UNION SELECT x.a, y.b FROM u x JOIN u y ON x.b = y.a) WHERE root <> node AND root IN (SELECT p_partkey FROM part)""")
def impact_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part: its suppliers as rules with the states of their large items as references, and the parts within two hops."""
    l = table(spark, sf_dir, "lineitem")
    validates = l.select(F.col("l_suppkey").alias("rule"), F.col("l_partkey").alias("param"))
    cited = l.where("l_quantity > 45").select(F.col("l_suppkey").alias("rule"), F.concat("l_returnflag", "l_linestatus").alias("ref"))
    return graph.impact(_flow(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root")), validates, cited)


@query(f"""WITH {_FLOW}, u AS (SELECT src AS a, dst AS b FROM flow UNION SELECT dst, src FROM flow), seen AS (SELECT a AS root, b AS node FROM u UNION SELECT x.a, y.b FROM u x JOIN u y ON x.b = y.a UNION SELECT a, a FROM u)
    SELECT s.root, src, dst, type, ord FROM flow JOIN seen s ON src = s.node JOIN seen t ON dst = t.node AND s.root = t.root""")
def centered_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph within two hops of each centre, edge by edge."""
    e = written(_flow(spark, sf_dir))
    return graph.subgraph(e, e.select(F.explode(F.array("src", "dst")).alias("root")).distinct(), 2)


@query(f"""WITH {_FLOW}, u AS (SELECT src AS a, dst AS b FROM flow UNION SELECT dst, src FROM flow), one AS (SELECT DISTINCT a AS root, b AS node FROM u), two AS (SELECT * FROM one UNION SELECT root, b FROM one JOIN u ON node = a), three AS (SELECT * FROM two UNION SELECT root, b FROM two JOIN u ON node = a),
    seen AS (SELECT root, node FROM three UNION SELECT root, root FROM one) SELECT root, count(DISTINCT node) AS nodes, count(DISTINCT ord) AS edges FROM seen s LEFT JOIN (SELECT s1.root AS r, f.ord FROM flow f JOIN seen s1 ON f.src = s1.node JOIN seen s2 ON f.dst = s2.node AND s1.root = s2.root) x ON s.root = x.r GROUP BY 1""")
def centered_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large the graph within three hops of each centre is, with the edges among its nodes."""
    e = written(_flow(spark, sf_dir))
    roots = e.select(F.explode(F.array("src", "dst")).alias("root")).distinct()
    return graph.ball_sizes(e, roots, 3)


@query(_chain_sql("SELECT DISTINCT dst AS root FROM flow", "dst", "src", "'AFFECTS', 'DETERMINES', 'CONSTRAINS'").replace("SELECT root, node, depth, array_to_string(ords, '>') AS via, round(confidence, 6) AS confidence FROM best WHERE depth > 0", """
    SELECT root, node, depth, row_number() OVER (PARTITION BY root ORDER BY depth, ords)::INT AS place FROM best WHERE depth > 0 AND node IN (SELECT p_partkey FROM part WHERE p_size > 5) AND node NOT IN (SELECT p_partkey FROM part WHERE p_size > 45) AND node NOT IN (SELECT dst FROM flow)
    QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, ords) <= 3"""))
def exogenous_levers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = _flow(spark, sf_dir), table(spark, sf_dir, "part")
    roots = e.select(F.col("dst").alias("root")).distinct()
    chained = graph.chain(e, roots, types=graph.CAUSAL, backward=True)
    return graph.exogenous(chained, e, p.where("p_size > 5").select(F.col("p_partkey").alias("param")), p.where("p_size > 45").select(F.col("p_partkey").alias("node")))


@query("SELECT p_brand, p_size, count(*) * (count(*) - 1) // 2 AS edges FROM part GROUP BY ALL HAVING count(*) > 1")
def facility_clique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges the cliques of equal facilities have: counted, as a clique's edges follow from its members."""
    n = F.count("*")
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.floor(n * (n - 1) / 2).cast("bigint").alias("edges")).where("edges > 0")


# --- Upserts and listings -----------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, count(DISTINCT c_mktsegment || c_nationkey) AS keys FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)")
def upsert_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys inserted where they are missing, twice: the second time changes nothing."""
    new = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    keys = ["c_mktsegment", "c_nationkey"]
    held = new.where("c_nationkey < 5").distinct()
    twice = upserted(upserted(held, new, keys), new, keys)
    return twice.agg(F.count("*").alias("rows"), F.count_distinct(F.concat("c_mktsegment", "c_nationkey")).alias("keys"))


@query("SELECT CASE WHEN p_size > 10 AND p_retailprice > 1000 THEN 'RANGE' WHEN p_size % 2 = 0 THEN 'ENUM' WHEN p_size % 3 = 0 THEN 'TABLE' END AS rule_type, count(*) AS n FROM part GROUP BY 1")
def rule_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trestle.sources.rules import inferred_rule_type

    has = lambda c: F.when(c, F.lit(1))
    kind = inferred_rule_type(has(F.col("p_size") > 10), has(F.col("p_retailprice") > 1000), has(F.col("p_size") % 2 == 0), has(F.col("p_size") % 3 == 0))
    return table(spark, sf_dir, "part").groupBy(kind.alias("rule_type")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY p_name, p_partkey LIMIT 100 OFFSET 20")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a listing, in a total order: the limit is what the operator is for."""
    p = table(spark, sf_dir, "part")
    kind = p.agg(F.min("p_type").alias("p_type"))
    return p.join(F.broadcast(kind), "p_type", "left_semi").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(20).limit(100)


