"""Queries over records as JSON and text: nested extraction, contexts, dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.operators import records
from trestle.plans.registry import query
from trestle.sources.designs import KEY, designs, designs_sql, table

# --- Events as generic records: numbers, digit texts, booleans, nulls, lists, objects, segments; some broken, some lists -----------


def _event_json() -> F.Column:
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"lane_width": '), F.col("value").cast("string"), F.lit(', "grade": "'), k, F.lit('", "phf": '), (F.col("user_id") % 2 == 0).cast("string"), F.lit(', "apd": null, "lw": [1, 2], "odd": 5, "terrain_type": "level", "segments": [{"grade": '), k,
        F.lit(', "spl": "55", "odd": 1, "passing_type": true}, 7, {"length": '), F.col("value").cast("string"), F.lit(', "ffs": null, "volume": {"a": 1}, "subsegments": [{"length": 1}]}]}'),
    )
    return F.when(F.col("event_id") % 11 == 0, F.lit('{"lane_width": 1')).when(F.col("event_id") % 13 == 0, F.lit("[1, 2]")).otherwise(body)


_EVENTS = "e AS (SELECT event_id, value, json_extract_string(props, '$.k') AS k, user_id % 2 = 0 AS even FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)"


@query(f"""WITH {_EVENTS}
    SELECT event_id, 'lane_width' AS param, 'Lane Width' AS name, value AS value_num, NULL AS value_str, 'ft' AS unit FROM e
    UNION ALL SELECT event_id, 'grade', 'Grade', NULL, k, NULL FROM e
    UNION ALL SELECT event_id, 'phf', 'Peak Hour Factor', even::INT::DOUBLE, CASE WHEN even THEN 'True' ELSE 'False' END, NULL FROM e
    UNION ALL SELECT event_id, 'terrain_type', 'Terrain Type', NULL, 'level', NULL FROM e
    UNION ALL SELECT event_id, 'segment_0_grade', 'Grade', k::DOUBLE, NULL, '%' FROM e
    UNION ALL SELECT event_id, 'segment_0_spl', 'Speed Limit', NULL, '55', 'mph' FROM e
    UNION ALL SELECT event_id, 'segment_0_passing_type', 'Passing Type', 1, 'True', NULL FROM e
    UNION ALL SELECT event_id, 'segment_2_length', 'Length', value, NULL, 'mi' FROM e""")
def nested_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic records with segments: kinds told apart, what is unknown, null or nested left out."""
    rows = table(spark, sf_dir, "events").select("event_id", _event_json().alias("json"))
    return records.json_parameters(rows, ["event_id"], "json")


# --- Orders as structs: two-lane highways of their items, each with a curve; every fourth a freeway --------------------------------

_ITEMS = ["passing_type", "grade", "spl", "design_rad", "vertical_class"]


def _struct_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = designs(spark, sf_dir, *_ITEMS)
    whole = lambda c: F.col(c).cast("int").alias(c)
    segment = F.struct(*KEY[1:], whole("passing_type"), "grade", F.when(F.col("l_linenumber") != 3, F.col("spl")).alias("spl"), whole("vertical_class"), F.lit(2).alias("odd"), F.array(F.struct("design_rad", F.lit("x").alias("odd"))).alias("subsegments"))
    nested = d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lane = (8 + F.col("o_custkey") % 6).cast("double")
    two_lane = F.to_json(F.struct(lane.alias("lane_width"), F.lit(None).cast("double").alias("shoulder_width"), F.lit(4).alias("apd"), F.lit("rolling").alias("terrain_type"), F.lit("rural").alias("city_type"), "segments"))
    freeway = F.to_json(F.struct(F.lit(65.5).alias("bffs"), F.lit(6).alias("lc_r"), F.lit(4).alias("lc_l"), F.lit(1.25).alias("trd"), (F.col("o_custkey") % 3).alias("lane_count"), F.lit("C").alias("los"), F.struct(F.lit(1).alias("Urban")).alias("city_type"), F.lit(1).alias("odd"), lane.alias("lane_width")))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, freeway).otherwise(two_lane).alias("json"))


_STRUCTS = f"""s AS (SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(KEY[1:])}) - 1 AS i, passing_type, grade, CASE WHEN l_linenumber <> 3 THEN spl END AS spl, design_rad, vertical_class FROM ({designs_sql(*_ITEMS)}) WHERE l_orderkey % 4 <> 0),
    t AS (SELECT o_orderkey, (8 + o_custkey % 6)::DOUBLE AS lane, o_custkey % 3 AS lanes, o_orderkey % 4 = 0 AS freeway FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


@query(f"""WITH {_STRUCTS}
    SELECT o_orderkey, 'lane_width' AS param, 'Lane Width' AS name, lane AS value_num, NULL AS value_str, 'ft' AS unit FROM t WHERE NOT freeway
    UNION ALL SELECT o_orderkey, 'apd', 'Access Point Density', 4, NULL, 'pts/mi' FROM t WHERE NOT freeway
    UNION ALL SELECT o_orderkey, 'bffs', 'Base Free Flow Speed', 65.5, NULL, 'mph' FROM t WHERE freeway
    UNION ALL SELECT o_orderkey, 'lc_r', 'Right Lateral Clearance', 6, NULL, 'ft' FROM t WHERE freeway
    UNION ALL SELECT o_orderkey, 'lc_l', 'Left Lateral Clearance', 4, NULL, 'ft' FROM t WHERE freeway
    UNION ALL SELECT o_orderkey, 'trd', 'Total Ramp Density', 1.25, NULL, 'ramps/mi' FROM t WHERE freeway
    UNION ALL SELECT o_orderkey, 'lane_count', 'Lane Count', lanes, NULL, NULL FROM t WHERE freeway
    UNION ALL SELECT o_orderkey, 'los', 'Level of Service', NULL, 'C', NULL FROM t WHERE freeway
    UNION ALL SELECT o_orderkey, 'city_type', 'City Type', NULL, '{{"Urban":1}}', NULL FROM t WHERE freeway
    UNION ALL SELECT o_orderkey, 'segment_' || i || '_passing_type', 'Passing Type', passing_type, NULL, NULL FROM s
    UNION ALL SELECT o_orderkey, 'segment_' || i || '_grade', 'Grade', grade, NULL, '%' FROM s
    UNION ALL SELECT o_orderkey, 'segment_' || i || '_spl', 'Speed Limit', spl, NULL, 'mph' FROM s WHERE spl IS NOT NULL
    UNION ALL SELECT o_orderkey, 'segment_' || i || '_vertical_class', 'Vertical Class', vertical_class, NULL, NULL FROM s
    UNION ALL SELECT o_orderkey, 'segment_' || i || '_subsegments_0_design_rad', 'Design Radius', design_rad, NULL, 'ft' FROM s""")
def struct_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freeway and two-lane structs with segments and subsegments, each field with the name and unit of its level."""
    return records.struct_parameters(_struct_json(spark, sf_dir), ["o_orderkey"], "json")


@query(f"""WITH {_STRUCTS}, f AS (SELECT * FROM s WHERE i = 0), c AS (
        SELECT o_orderkey, 'facility_type' AS key, CASE WHEN freeway THEN 'BasicFreeway' ELSE 'TwoLaneHighway' END AS value FROM t UNION ALL SELECT o_orderkey, 'city_type', CASE WHEN freeway THEN 'Urban' ELSE 'rural' END FROM t
        UNION ALL SELECT o_orderkey, 'terrain_type', 'rolling' FROM t WHERE NOT freeway UNION ALL SELECT o_orderkey, 'passing_type', passing_type::INT::VARCHAR FROM f UNION ALL SELECT o_orderkey, 'vertical_class', vertical_class::INT::VARCHAR FROM f)
    SELECT * FROM c""")
def struct_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of structs, of the first segment too, as rows."""
    rows = _struct_json(spark, sf_dir).select("o_orderkey", records.parsed("json").alias("v")).where(records.struct_like("v"))
    return rows.select("o_orderkey", F.explode(records.struct_context("v")).alias("key", "value"))


# --- Records of any kind in one column: line items as structs, JSON, texts, and what nobody reads ---------------------------------

_MIXED = [
    ("struct", '{"bffs": 70, "lc_r": 6, "lc_l": 4, "trd": 2, "terrain_type": "level"}'),
    ("json", '{"lane_width": 11.5, "city_type": "rural", "x": 1}'),
    ("text", "The lane width: 12 ft on rolling terrain in a rural area"),
    ("unknown object", '{"x": 1}'),
    ("short text", "lane width"),
    ("list", "[1, 2]"),
    ("asked for", '{"lane_width": 9}'),
]


@query("""WITH l AS (SELECT l_linenumber AS n, l_returnflag = 'R' AS given FROM lineitem),
    r AS (SELECT CASE WHEN given THEN 'json' ELSE [ 'struct', 'json', 'text', 'json', NULL, NULL, 'json'][n] END AS source, n FROM l),
    x AS (SELECT n, source, CASE WHEN source IS NULL THEN 'no reader knows the record' END AS error,
        CASE WHEN n = 1 AND source = 'struct' THEN 'bffs=70.0 lc_l=4.0 lc_r=6.0 terrain_type=level trd=2.0' WHEN n = 1 THEN 'bffs=70.0 lc_l=4.0 lc_r=6.0 terrain_type=level trd=2.0' WHEN n = 2 THEN 'city_type=rural lane_width=11.5' WHEN n = 3 AND source = 'text' THEN 'lane_width=12.0' WHEN n = 7 THEN 'lane_width=9.0' END AS params,
        CASE WHEN n = 1 AND source = 'struct' THEN 'facility_type=BasicFreeway terrain_type=level' WHEN n = 1 THEN 'terrain_type=level' WHEN n = 2 THEN 'city_type=rural' WHEN n = 3 AND source = 'text' THEN 'city_type=rural terrain_type=rolling' WHEN source IS NOT NULL THEN '' END AS context FROM r)
    SELECT n, source, error, params, context, count(*) AS records FROM x GROUP BY ALL""")
def mixed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as a record of one of seven kinds, some of which ask for a reader: its reader, parameters, context and error."""
    kinds = F.array(*(F.lit(raw) for _, raw in _MIXED))
    rows = table(spark, sf_dir, "lineitem").select(*KEY, F.element_at(kinds, F.col("l_linenumber").cast("int")).alias("raw"), F.when(F.col("l_returnflag") == "R", "json").alias("given"))
    rows = rows.groupBy(*KEY, "raw", "given").agg(F.count("*").alias("copies"))  # equal items are one record
    keys = [*KEY, "given", "copies"]
    params, contexts, errors = records.extracted(rows, keys, "raw", "given")
    shown = F.concat("param", F.lit("="), F.coalesce("value_str", F.col("value_num").cast("string")))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("context"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), " ")
    # Every record has a context or an error, so that putting its rows together takes one grouping and no join.
    every = params.select(*keys, shown.alias("shown")).unionByName(contexts.select(*keys, "source", told.alias("context")), allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)
    out = every.groupBy(*keys).agg(F.array_sort(F.collect_list("shown")).alias("_shown"), *(F.max(c).alias(c) for c in ("source", "context", "error")))
    return out.groupBy(F.col("l_linenumber").alias("n"), "source", "error", F.nullif(F.array_join("_shown", " "), F.lit("")).alias("params"), "context").agg(F.sum("copies").alias("records"))
