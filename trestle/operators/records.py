"""Records given as JSON of any depth or as text: which reader a record wants, and its parameters and context in the long format.

JSON is read once, as a variant, and its entries, those of its segments and of their subsegments are listed in one pass without a shuffle.
Numbers, texts and booleans are told apart by what the JSON says: the text "11" isn't a number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.operators import extract

# The keys of generic records, and the names and units that keys have there; other names are made from the key.
KNOWN = [
    "lane_width", "lw", "bffs", "ffs", "grade", "speed_limit", "phf", "p_t", "truck_percentage", "apd", "trd", "lc_r", "lc_l", "lateral_clearance", "capacity", "density", "lane_count",
    "shoulder_width", "length", "spl", "volume", "phv", "design_rad", "sup_ele", "superelevation", "passing_type", "vertical_class", "horizontal_class", "hor_class",
    "h_radius", "design_speed", "facility_type", "city_type", "terrain_type", "highway_type", "median_type", "jurisdiction",
]
NAMES = {
    "lw": "Lane Width", "bffs": "Base Free Flow Speed", "ffs": "Free Flow Speed", "phf": "Peak Hour Factor", "p_t": "Truck Percentage", "apd": "Access Point Density", "trd": "Total Ramp Density",
    "lc_r": "Right Lateral Clearance", "lc_l": "Left Lateral Clearance", "spl": "Speed Limit", "phv": "Heavy Vehicle Percentage", "sup_ele": "Superelevation", "hor_class": "Horizontal Class",
}
UNITS = {
    "lane_width": "ft", "lw": "ft", "shoulder_width": "ft", "lateral_clearance": "ft", "lc_r": "ft", "lc_l": "ft", "design_rad": "ft", "length": "mi", "grade": "%", "sup_ele": "%", "superelevation": "%",
    "speed_limit": "mph", "spl": "mph", "bffs": "mph", "ffs": "mph", "volume": "veh/hr", "capacity": "veh/hr", "density": "pc/mi/ln", "apd": "pts/mi", "trd": "ramps/mi", "p_t": "decimal", "phv": "%", "truck_percentage": "%",
}
# The fields of structs by level, with their names and units.
FREEWAY = {
    "apd": ("Access Point Density", "pts/mi"), "trd": ("Total Ramp Density", "ramps/mi"), "bffs": ("Base Free Flow Speed", "mph"), "ffs": ("Free Flow Speed", "mph"), "ffs_adj": ("Adjusted Free Flow Speed", "mph"),
    "capacity": ("Capacity", "veh/hr"), "lane_count": ("Lane Count", None), "density": ("Density", "pc/mi/ln"), "length": ("Segment Length", "mi"), "lw": ("Lane Width", "ft"), "lc_r": ("Right Lateral Clearance", "ft"),
    "lc_l": ("Left Lateral Clearance", "ft"), "p_t": ("Truck Percentage", "decimal"), "e_t": ("Heavy Vehicle PCE", None), "demand_flow_i": ("Demand Flow Rate", "veh/hr"), "v_p": ("Adjusted Demand Volume", "veh/hr"),
    "phf": ("Peak Hour Factor", None), "grade": ("Grade", "%"), "terrain_type": ("Terrain Type", None), "sut_percentage": ("SUT Percentage", "%"), "city_type": ("City Type", None), "highway_type": ("Highway Type", None),
    "median_type": ("Median Type", None), "speed_limit": ("Speed Limit", "mph"), "phv": ("Heavy Vehicle Adjustment", None), "los": ("Level of Service", None),
}
HIGHWAY = {
    "lane_width": ("Lane Width", "ft"), "shoulder_width": ("Shoulder Width", "ft"), "apd": ("Access Point Density", "pts/mi"), "pmhvfl": ("Heavy Vehicle Percentage in Passing Lane", "%"),
    "l_de": ("Effective Distance to Passing Lane", "mi"),
}
SEGMENT = {
    "passing_type": ("Passing Type", None), "length": ("Segment Length", "mi"), "grade": ("Grade", "%"), "spl": ("Speed Limit", "mph"), "is_hc": ("Has Horizontal Class", None), "volume": ("Volume", "veh/hr"),
    "volume_op": ("Opposing Volume", "veh/hr"), "flow_rate": ("Flow Rate", "veh/hr"), "flow_rate_o": ("Opposing Flow Rate", "veh/hr"), "capacity": ("Capacity", "veh/hr"), "ffs": ("Free Flow Speed", "mph"),
    "avg_speed": ("Average Speed", "mph"), "vertical_class": ("Vertical Class", None), "phf": ("Peak Hour Factor", None), "phv": ("Heavy Vehicle Percentage", "%"), "pf": ("Percent Followers", "%"),
    "fd": ("Follower Density", "followers/mi"), "hor_class": ("Horizontal Class", None),
}
SUBSEGMENT = {
    "length": ("Subsegment Length", "ft"), "avg_speed": ("Average Speed", "mph"), "design_rad": ("Design Radius", "ft"), "central_angle": ("Central Angle", "deg"), "hor_class": ("Horizontal Class", None),
    "sup_ele": ("Superelevation", "%"),
}
# The keys of a record's context.
CONTEXT = ["facility_type", "city_type", "terrain_type", "highway_type", "median_type", "passing_type", "vertical_class", "horizontal_class", "jurisdiction"]

#: What every reader gives for a parameter.
PARAMETER = ["param", "name", "value_num", "value_str", "unit"]

_object = "try_variant_get({}, '$', 'map<string,variant>')"
_list = "try_variant_get({}, '$', 'array<variant>')"


def parsed(json: str | Column) -> Column:
    """A JSON text as a variant; null if it isn't JSON, or if an object in it has a key twice."""
    return F.try_parse_json(json)


def kind(v: str) -> Column:
    """number, boolean, text or other (lists and objects) of the variant column; null for null."""
    t = F.expr(f"schema_of_variant({v})")
    return F.when(t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(t == "BOOLEAN", "boolean").when(t == "STRING", "text").when(t != "VOID", "other")


def number(v: str, k: Column) -> Column:
    """A number, a boolean as 1 or 0; null for what is neither."""
    return F.when(k.isin("number", "boolean"), F.expr(f"try_variant_get({v}, '$', 'double')"))


def text(v: str, k: Column) -> Column:
    """A text; True or False; lists and objects as JSON; null for numbers."""
    plain = F.expr(f"try_variant_get({v}, '$', 'string')")
    return F.when(k == "boolean", F.initcap(plain)).when(k != "number", plain)


def names_of(v: str) -> Column:
    """The keys of a record's JSON object; empty for anything else."""
    return F.coalesce(F.map_keys(F.expr(_object.format(v))), F.array().cast("array<string>"))


def first_segment(v: str) -> Column:
    """The first of a record's segments, as a variant."""
    return F.expr(f"try_variant_get({v}, '$.segments[0]', 'variant')")


def _of_first(v: str, field: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$.segments[0].{field}', 'variant')")


def _passing(v: str) -> Column:
    """Whether the first segment has a passing type, be it null."""
    return F.coalesce(F.array_contains(F.map_keys(F.expr(f"try_variant_get({v}, '$.segments[0]', 'map<string,variant>')")), "passing_type"), F.lit(False))


def struct_like(v: str) -> Column:
    """Whether a record is a struct of the library: a freeway's keys, or segments of which the first has a passing type."""
    return extract.struct_like(names_of(v)) | _passing(v)


def facility(v: str) -> Column:
    """The facility that a struct describes; null if it is neither."""
    freeway = F.size(F.array_except(F.array(*map(F.lit, ["bffs", "lc_r", "lc_l"])), names_of(v))) == 0
    return F.when(freeway, "BasicFreeway").when(_passing(v), "TwoLaneHighway")


def entries(rows: DataFrame, keep: list[str], v: str) -> DataFrame:
    """keep, seg, sub, field and x (a variant): a row for each entry of the record (seg null), of its segments (sub null) and of their subsegments.

    Segments and subsegments that aren't objects have no entries; their places count. Rows that hold no object have none.
    """
    out = rows.select(*keep, F.explode(F.expr(_object.format(v))).alias("_k", "_x"))
    out = out.select(*keep, "_k", "_x", F.posexplode_outer(F.when(F.col("_k") == "segments", F.expr(_list.format("_x")))).alias("seg", "_s"))
    out = out.select(*keep, "_k", "_x", "seg", F.explode_outer(F.expr(_object.format("_s"))).alias("_sk", "_sx"))
    out = out.select(*keep, "_k", "_x", "seg", "_sk", "_sx", F.posexplode_outer(F.when(F.col("_sk") == "subsegments", F.expr(_list.format("_sx")))).alias("sub", "_b"))
    out = out.select(*keep, "_k", "_x", "seg", "_sk", "_sx", "sub", F.explode_outer(F.expr(_object.format("_b"))).alias("_bk", "_bx"))
    pick = lambda c: F.when(F.col("sub").isNotNull(), F.col(f"_b{c}")).when(F.col("seg").isNotNull(), F.col(f"_s{c}")).otherwise(F.col(f"_{c}"))
    return out.select(*keep, "seg", "sub", pick("k").alias("field"), pick("x").alias("x")).where("field IS NOT NULL")


def _of(field: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), field)


def json_parameters(rows: DataFrame, keys: list[str], json: str, known: list[str] | None = KNOWN) -> DataFrame:
    """keys and PARAMETER: the known entries (all, if known is None) of generic records and of their segments, these named `segment_<place>_<key>`.

    Numbers and booleans have a unit, texts of the record itself haven't, all of a segment have; nulls, lists and objects are left out. What isn't a JSON
    object has no row.
    """
    out = entries(rows.select(*keys, parsed(json).alias("_v")), keys, "_v").where("sub IS NULL")
    out = out if known is None else out.where(F.col("field").isin(known))
    out = out.withColumn("_kind", kind("x")).where("_kind <> 'other'")
    param = F.when(F.col("seg").isNotNull(), F.concat(F.lit("segment_"), "seg", F.lit("_"), "field")).otherwise(F.col("field"))
    name = F.coalesce(_of(F.col("field"), NAMES), F.initcap(F.replace("field", F.lit("_"), F.lit(" "))))
    unit = F.when((F.col("_kind") != "text") | F.col("seg").isNotNull(), _of(F.col("field"), UNITS))
    return out.select(*keys, param.alias("param"), name.alias("name"), number("x", F.col("_kind")).alias("value_num"), text("x", F.col("_kind")).alias("value_str"), unit.alias("unit"))


def struct_parameters(rows: DataFrame, keys: list[str], json: str) -> DataFrame:
    """keys and PARAMETER: the fields of freeway and two-lane structs that aren't null, with the names and units of their level.

    A two-lane struct's segments give `segment_<place>_<field>`, their subsegments `segment_<place>_subsegments_<place>_<field>`. Lists and objects
    are JSON texts. A struct of neither kind has no row.
    """
    of = rows.select(*keys, parsed(json).alias("_v")).withColumn("_facility", facility("_v")).where("_facility IS NOT NULL")
    out = entries(of, [*keys, "_facility"], "_v").withColumn("_kind", kind("x")).where("_kind IS NOT NULL")
    level = F.when(F.col("_facility") == "BasicFreeway", F.when(F.col("seg").isNull(), "f")).when(F.col("seg").isNull(), "h").when(F.col("sub").isNull(), "s").otherwise("b")
    levels = {"f": FREEWAY, "h": HIGHWAY, "s": SEGMENT, "b": SUBSEGMENT}
    meta = F.create_map(*(x for at, fields in levels.items() for f, (name, unit) in fields.items() for x in (F.lit(f"{at} {f}"), F.struct(F.lit(name).alias("name"), F.lit(unit).cast("string").alias("unit")))))
    out = out.withColumn("_meta", F.try_element_at(meta, F.concat_ws(" ", level, "field"))).where("_meta IS NOT NULL")
    place = F.concat_ws("_", F.when(F.col("seg").isNotNull(), F.concat(F.lit("segment_"), "seg")), F.when(F.col("sub").isNotNull(), F.concat(F.lit("subsegments_"), "sub")), "field")
    return out.select(*keys, place.alias("param"), "_meta.name", number("x", F.col("_kind")).alias("value_num"), text("x", F.col("_kind")).alias("value_str"), "_meta.unit")


def _as_text(v: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$', 'string')")


def _entry(v: str, field: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$.{field}', 'string')")


def _map(pairs: dict[str, Column]) -> Column:
    """A map of what isn't null."""
    if not pairs:
        return F.create_map().cast("map<string,string>")
    some = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in pairs.items())), lambda x: x["value"].isNotNull())
    return F.map_from_entries(some)


def struct_context(v: str) -> Column:
    """The context of a struct: its facility, its own city (of an object the first key in their order), terrain, highway and median types, and its first segment's classes."""
    city = F.coalesce(F.get(F.array_sort(F.map_keys(F.expr(f"try_variant_get({v}, '$.city_type', 'map<string,variant>')"))), F.lit(0)), _entry(v, "city_type"))
    first = lambda f: F.expr(f"try_variant_get({v}, '$.segments[0].{f}', 'string')")
    return _map({"facility_type": facility(v), "city_type": city, **{k: _entry(v, k) for k in ("terrain_type", "highway_type", "median_type")},
                 "passing_type": first("passing_type"), "vertical_class": first("vertical_class"), "horizontal_class": first("hor_class")})


def json_context(v: str) -> Column:
    """The context of a generic record: those of its entries that are of a context. Lists and objects are JSON texts."""
    return _map({k: _entry(v, k) for k in CONTEXT})


def text_context(raw: str) -> Column:
    """The context that a text states."""
    return _map({k: F.nullif(c, F.lit("")) for k, c in extract.text_context(F.col(raw)).items()})


def source(raw: str, v: str, given: Column | None = None) -> Column:
    """The reader of a record: the one asked for, else the first of struct, json and text that knows it, else json for any object; null if none does."""
    found = (
        F.when(struct_like(v), "struct").when(F.arrays_overlap(names_of(v), F.array(*map(F.lit, KNOWN))), "json")
        .when(F.expr(_object.format(v)).isNull() & extract.applicable(F.col(raw)), "text").when(F.expr(_object.format(v)).isNotNull(), "json")
    )
    return found if given is None else F.coalesce(given, found)


def _text_parameters(rows: DataFrame, keys: list[str], raw: str) -> DataFrame:
    found = extract.text_parameters(rows, keys, raw)
    return found.select(*keys, "param", F.initcap(F.replace("param", F.lit("_"), F.lit(" "))).alias("name"), F.col("value").alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.lit(None).cast("string").alias("unit"))


Reader = tuple[Callable[[DataFrame, list[str], str], DataFrame], Callable[[str, str], Column]]
#: The readers by name: (rows, keys, column) to parameters, and (column, variant) to the context. A reader of one's own is added here or given to extracted().
READERS: dict[str, Reader] = {
    "struct": (struct_parameters, lambda raw, v: struct_context(v)),
    "json": (json_parameters, lambda raw, v: json_context(v)),
    "text": (_text_parameters, lambda raw, v: text_context(raw)),
}


def extracted(rows: DataFrame, keys: list[str], raw: str, given: str | None = None, readers: dict[str, Reader] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of any kind to (parameters, contexts, errors): keys and PARAMETER; keys, source and context; keys and error.

    given: a column that names the reader of a record, or is null. A record that no reader knows, or that asks for one that isn't there, and a struct of neither facility,
    is an error and has no parameters; so have null records. Readers, contexts and errors are worked out in one pass and written; a reader then parses its own records only.
    """
    from trestle.sources.tables import written

    known = readers or READERS
    read = rows.select(*keys, F.col(raw).alias("_raw"), parsed(raw).alias("_v"), (F.col(given) if given else F.lit(None).cast("string")).alias("_given"))
    read = read.withColumn("source", source("_raw", "_v", F.col("_given")))
    ctx = F.lit(None).cast("map<string,string>")
    for name, (_, of) in known.items():
        ctx = F.when(F.col("source") == name, of("_raw", "_v")).otherwise(ctx)
    error = F.when(F.col("source").isNull(), "no reader knows the record").when(~F.col("source").isin(list(known)), "there is no such reader").when((F.col("source") == "struct") & facility("_v").isNull(), "a struct of no known facility")
    told = written(read.select(*keys, "_raw", "source", ctx.alias("context"), error.alias("error")))
    parts = [of(told.where(F.col("source") == name).select(*keys, "_raw"), keys, "_raw") for name, (of, _) in known.items()]
    params = parts[0]
    for p in parts[1:]:
        params = params.unionByName(p)
    return params, told.select(*keys, "source", "context").where("context IS NOT NULL"), told.select(*keys, "error").where("error IS NOT NULL")
