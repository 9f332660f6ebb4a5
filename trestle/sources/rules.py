"""Rules, constraints and vocabularies: as data, from JSON corpora or as defined here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import literal

RULE = "rule_id INT, param STRING, rule_type STRING, severity STRING, lo DOUBLE, hi DOUBLE, lo_open BOOLEAN, hi_open BOOLEAN, allowed ARRAY<STRING>, citation STRING"

# The constraints of the semantic checks, with the names, bounds and sources that published manuals give them.
SEMANTIC = [
    ("SV-001", "lane_width", 9.0, 12.0, None, "error", "HCM 7th Edition, Exhibit 15-8"),
    ("SV-002", "shoulder_width", 0.0, 8.0, None, "error", "HCM 7th Edition, Exhibit 15-8"),
    ("SV-003", "hor_class", None, None, (0, 1, 2, 3, 4, 5), "error", "HCM 7th Edition, Exhibit 15-22"),
    ("SV-004", "passing_type", None, None, (0, 1, 2), "error", "HCM 7th Edition, Chapter 15.3"),
    ("SV-006", "grade", -10.0, 10.0, None, "warning", "AASHTO Green Book, Chapter 3"),
    ("SV-007", "phf", 0.5, 1.0, None, "error", "HCM 7th Edition, Chapter 15"),
    ("SV-008", "phv", 0.0, 100.0, None, "error", "HCM 7th Edition, Chapter 15"),
    ("SV-009", "spl", 15.0, 80.0, None, "warning", "AASHTO Green Book, Chapter 2"),
    ("SV-010", "vertical_class", None, None, (1, 2, 3, 4, 5), "error", "HCM 7th Edition, Exhibit 15-11"),
]
# The smallest curve radius (ft) for a speed (mph).
RADIUS = [(15, 50), (20, 90), (25, 170), (30, 230), (35, 340), (40, 430), (45, 560), (50, 710), (55, 835), (60, 1000), (65, 1150), (70, 1310), (75, 1560), (80, 1810)]
RADIUS_SOURCE = "AASHTO Green Book, Table 3-7"
# Readings of imperial units as metric ones, and the tolerance of typical ranges.
METRIC = [("ft", "meters", 3.28084), ("in", "centimeters", 0.393701), ("mi", "kilometers", 0.621371), ("mph", "km/h", 0.621371)]
TOLERANCE = 0.15


def rules(spark: SparkSession) -> DataFrame:
    """A small corpus of all simple kinds of rules. It is a literal: as small whatever is checked."""
    rows = [
        (1, "lane_width", "range", "error", 9.0, 12.0, False, False, None, "Manual A, Ch. 15"),
        (2, "shoulder_width", "range", "warning", 1.0, 8.0, False, True, None, "Manual A, Ch. 15"),
        (3, "design_rad", "min", "error", 50.0, None, False, False, None, "Manual B, Table 3"),
        (4, "spl", "min", "error", 25.0, None, True, False, None, "Manual B, Ch. 2"),
        (5, "grade", "max", "warning", None, 9.0, False, True, None, "Manual B, Ch. 3"),
        (6, "phf", "max", "error", None, 1.0, False, False, None, None),
        (7, "hor_class", "enum", "error", None, None, False, False, ["0.0", "1.0", "2.0", "3.0", "4.0", "5.0"], "Manual A, Ex. 22"),
        (8, "passing_type", "enum", "info", None, None, False, False, ["0.0", "1.0", "2.0"], "Manual A, 15.3"),
        (9, "lane_width", "relationship", "error", None, None, False, False, None, "Manual A"),
    ]
    return literal(spark, rows, RULE)


def rules_sql() -> str:
    return """SELECT * FROM (VALUES
        (1, 'lane_width', 'range', 'error', 9.0::DOUBLE, 12.0::DOUBLE, false, false, NULL::VARCHAR[], 'Manual A, Ch. 15'), (2, 'shoulder_width', 'range', 'warning', 1.0, 8.0, false, true, NULL, 'Manual A, Ch. 15'),
        (3, 'design_rad', 'min', 'error', 50.0, NULL, false, false, NULL, 'Manual B, Table 3'), (4, 'spl', 'min', 'error', 25.0, NULL, true, false, NULL, 'Manual B, Ch. 2'),
        (5, 'grade', 'max', 'warning', NULL, 9.0, false, true, NULL, 'Manual B, Ch. 3'), (6, 'phf', 'max', 'error', NULL, 1.0, false, false, NULL, NULL),
        (7, 'hor_class', 'enum', 'error', NULL, NULL, false, false, ['0.0', '1.0', '2.0', '3.0', '4.0', '5.0'], 'Manual A, Ex. 22'), (8, 'passing_type', 'enum', 'info', NULL, NULL, false, false, ['0.0', '1.0', '2.0'], 'Manual A, 15.3'),
        (9, 'lane_width', 'relationship', 'error', NULL, NULL, false, false, NULL, 'Manual A')
        ) AS r(rule_id, param, rule_type, severity, lo, hi, lo_open, hi_open, allowed, citation)"""


# --- JSON corpora -------------------------------------------------------------------------------------------------

PARAMETER_FILE = """facility_type STRING, parameters ARRAY<STRUCT<name STRING, rust_field STRING, unit STRING, data_type STRING, facility_type STRING,
    typical_min DOUBLE, typical_max DOUBLE, allowed_values STRING, description STRING, aliases ARRAY<STRING>>>"""
RULE_FILE = """source_doc STRUCT<title STRING, abbreviation STRING, edition STRING, publisher STRING, publication_year INT, jurisdiction STRING, priority INT>,
    parameters ARRAY<STRUCT<name STRING, rust_field STRING, facility_type STRING, unit STRING, data_type STRING, typical_min DOUBLE, typical_max DOUBLE>>,
    rules ARRAY<STRUCT<parameter_rust_field STRING, facility_type STRING, name STRING, rule_type STRING, severity STRING, min_value DOUBLE, max_value DOUBLE,
    min_inclusive BOOLEAN, max_inclusive BOOLEAN, allowed_values STRING, formula STRING, conditions ARRAY<STRUCT<type STRING, value STRING, is_required BOOLEAN>>,
    description STRING, error_message STRING, source_ref STRUCT<chapter STRING, section STRING, exhibit STRING, equation STRING>>>"""
EDGE_FILE = "relationships ARRAY<STRUCT<from_field STRING, to_field STRING, type STRING, facility_type STRING, description STRING, source STRING>>"
CLAIM = "name STRING, parameter STRING, rule_type STRING, min_value DOUBLE, max_value DOUBLE, allowed_values ARRAY<STRING>, jurisdiction STRING, priority INT, authority STRING, citation STRING, severity STRING, conditions ARRAY<STRUCT<type STRING, value STRING>>"
TIER_FILE = "tiers map<string,string>, out_of_corpus map<string,string>"
SCENARIO_FILE = f"scenario STRING, parameter STRING, default_context MAP<STRING,STRING>, example_value DOUBLE, claims ARRAY<STRUCT<{CLAIM}>>"
ARTIFACT_FILE = "meta MAP<STRING,STRING>, edges ARRAY<STRUCT<from_param STRING, to_param STRING, basis STRING, evidence STRING>>"


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each JSON file under path, with its name; files that are no objects of this schema are left out. A missing folder has no files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{schema}, _file STRING")
    found = spark.read.schema(f"{schema}, _corrupt_record STRING").option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return found.withColumn("_file", F.col("_metadata.file_path")).where("_corrupt_record IS NULL").drop("_corrupt_record")


def allowed_list(csv: str) -> Column:
    """A comma-separated text as a list of trimmed values; null or empty gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(csv), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def parameter_corpus(spark: SparkSession, path: str) -> DataFrame:
    """ord, facility_type (the row's own or its file's), and the columns of each parameter, in the order of files and places."""
    rows = json_files(spark, path, PARAMETER_FILE).select("_file", F.col("facility_type").alias("_of"), F.posexplode("parameters").alias("pos", "p"))
    rows = rows.select("_file", "pos", F.coalesce("p.facility_type", "_of").alias("facility_type"), *(f"p.{c}" for c in ("name", "rust_field", "unit", "data_type", "typical_min", "typical_max", "allowed_values", "description", "aliases")))
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("_file", "pos"))).drop("_file", "pos")


def parameter_keys(parameters: DataFrame) -> DataFrame:
    """facility_type, key, rust_field: the lower-case field, name and aliases of each parameter; of equal keys the first holds."""
    names = F.concat(F.array("rust_field", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = parameters.select("facility_type", "rust_field", "ord", F.posexplode(names).alias("k", "key")).where("key IS NOT NULL").withColumn("key", F.lower("key"))
    return keys.groupBy("facility_type", "key").agg(F.min_by("rust_field", F.struct("ord", "k")).alias("rust_field"), F.min("ord").alias("ord"))


def rule_corpus(spark: SparkSession, path: str) -> DataFrame:
    """rule_id (by file and place), the rules' columns, source_doc and citation."""
    rows = json_files(spark, path, RULE_FILE).select("_file", "source_doc", F.posexplode("rules").alias("pos", "r")).select("_file", "pos", "source_doc", "r.*")
    place = [F.when(F.col(f"source_ref.{k}").isNotNull(), F.concat(F.lit(f"{k.capitalize()} "), F.col(f"source_ref.{k}"))) for k in ("chapter", "section", "exhibit", "equation")]
    rows = rows.withColumn("citation", F.concat_ws(", ", "source_doc.abbreviation", *place)).withColumn("allowed", allowed_list("allowed_values"))
    return rows.withColumn("rule_id", F.row_number().over(Window.orderBy("_file", "pos"))).drop("_file", "pos")


def edge_corpus(spark: SparkSession, path: str) -> DataFrame:
    """ord and the columns of each edge, in the order of the file."""
    return json_files(spark, path, EDGE_FILE).select(F.posexplode("relationships").alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e.*")


def tier_labels(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, tier, out_of_corpus: what auditors say of edges, which their files name as src->dst. An edge may have a tier, be out of corpus, or both; of several files the alphabetically last tier counts."""
    tiers, out = (F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in ("tiers", "out_of_corpus"))
    rows = json_files(spark, path, TIER_FILE).select(tiers.alias("_t"), out.alias("_o")).select("_t", "_o", F.explode(F.array_union(F.map_keys("_t"), F.map_keys("_o"))).alias("_edge"))
    ends = F.split("_edge", "->", 2)
    rows = rows.select(F.trim(F.get(ends, 0)).alias("src"), F.trim(F.get(ends, 1)).alias("dst"), F.col("_t")[F.col("_edge")].alias("tier"), F.map_contains_key(F.col("_o"), F.col("_edge")).alias("out_of_corpus"))
    return rows.groupBy("src", "dst").agg(F.max("tier").alias("tier"), F.bool_or("out_of_corpus").alias("out_of_corpus"))


def conflict_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """A row for each scenario; one without a name has its file's."""
    stem = F.regexp_extract("_file", r"([^/]+)\.json$", 1)
    return json_files(spark, path, SCENARIO_FILE).withColumn("scenario", F.coalesce("scenario", stem)).drop("_file")


def parameter_bounds(parameters: DataFrame, facility: str) -> DataFrame:
    """param, lo, hi of a facility's parameters that have both typical bounds."""
    return parameters.where((F.col("facility_type") == facility) & F.col("typical_min").isNotNull() & F.col("typical_max").isNotNull()).select(F.col("rust_field").alias("param"), F.col("typical_min").alias("lo"), F.col("typical_max").alias("hi"))


def artifact_edges(spark: SparkSession, path: str) -> DataFrame:
    """ord, from_param, to_param, basis, evidence of an extraction's edges."""
    return json_files(spark, path, ARTIFACT_FILE).select("_file", F.posexplode("edges").alias("ord", "e")).select("_file", "ord", "e.*")


def inferred_rule_type(lo: Column, hi: Column, values: Column, table: Column) -> Column:
    """The kind of a library constraint, from what it has."""
    return F.when(lo.isNotNull() & hi.isNotNull(), "RANGE").when(values.isNotNull(), "ENUM").when(table.isNotNull(), "TABLE")


def upserted(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held, and the rows of new whose keys it doesn't hold: doing it twice changes nothing."""
    return held.unionByName(new.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti"))
