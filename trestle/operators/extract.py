"""Parameters out of texts in the long format, and what tells records apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a text must name to be read at all, the patterns of its parameters (the first that matches holds) and of its context.
KEYWORDS = ["lane", "shoulder", "speed", "grade", "radius", "terrain", "freeway", "highway", "mph", "volume", "superelevation"]
TEXT = {
    "lane_width": [r"lane\s*width[:\s]+(\d+(?:\.\d+)?)\s*(?:ft|feet)?", r"(\d+(?:\.\d+)?)\s*(?:ft|foot|feet)\s*(?:wide)?\s*lanes?", r"lanes?\s*(?:are|is)?\s*(\d+(?:\.\d+)?)\s*(?:ft|feet)\s*wide"],
    "shoulder_width": [r"shoulder\s*width[:\s]+(\d+(?:\.\d+)?)\s*(?:ft|feet)?", r"(\d+(?:\.\d+)?)\s*(?:ft|foot|feet)\s*shoulders?", r"shoulders?\s*(?:are|is)?\s*(\d+(?:\.\d+)?)\s*(?:ft|feet)"],
    "grade": [r"grade[:\s]+([+-]?\d+(?:\.\d+)?)\s*%?", r"([+-]?\d+(?:\.\d+)?)\s*%\s*grade", r"([+-]?\d+(?:\.\d+)?)\s*percent\s*grade"],
    "speed_limit": [r"speed\s*limit[:\s]+(\d+)\s*(?:mph)?", r"(\d+)\s*mph\s*speed\s*limit", r"posted\s*speed[:\s]+(\d+)\s*(?:mph)?"],
    "design_speed": [r"design\s*speed[:\s]+(\d+)\s*(?:mph)?", r"(\d+)\s*mph\s*design\s*speed"],
    "volume": [r"volume[:\s]+(\d+(?:,\d+)?)\s*(?:veh(?:icles)?/h(?:r|our)?)?", r"(\d+(?:,\d+)?)\s*veh(?:icles)?(?:/h(?:r|our)?|\s*per\s*hour)", r"aadt[:\s]+(\d+(?:,\d+)?)"],
    "phf": [r"(?:peak\s*hour\s*factor|phf)[:\s]+(\d+(?:\.\d+)?)", r"phf\s*(?:of|=|is)\s*(\d+(?:\.\d+)?)"],
    "truck_percentage": [r"(?:truck|heavy\s*vehicle)\s*(?:percentage|%)[:\s]+(\d+(?:\.\d+)?)\s*%?", r"(\d+(?:\.\d+)?)\s*%?\s*trucks?", r"(\d+(?:\.\d+)?)\s*%?\s*heavy\s*vehicles?"],
    "design_radius": [r"(?:design\s*)?radius[:\s]+(\d+(?:\.\d+)?)\s*(?:ft|feet)?", r"(\d+(?:\.\d+)?)\s*(?:ft|feet)\s*radius", r"curve\s*(?:with|of)\s*(\d+(?:\.\d+)?)\s*(?:ft|feet)?\s*radius"],
    "superelevation": [r"superelevation[:\s]+(\d+(?:\.\d+)?)\s*%?", r"(\d+(?:\.\d+)?)\s*%?\s*superelevation", r"super(?:elevation)?[:\s]+(\d+(?:\.\d+)?)\s*%?"],
    "length": [r"(?:segment\s*)?length[:\s]+(\d+(?:\.\d+)?)\s*(?:mi(?:les?)?|ft|feet)?", r"(\d+(?:\.\d+)?)\s*(?:mi(?:le)?|miles)\s*(?:long|segment)"],
    "lateral_clearance": [r"lateral\s*clearance[:\s]+(\d+(?:\.\d+)?)\s*(?:ft|feet)?", r"(\d+(?:\.\d+)?)\s*(?:ft|feet)\s*(?:lateral\s*)?clearance"],
    "access_point_density": [r"access\s*(?:point\s*)?density[:\s]+(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*access\s*points?\s*per\s*mile"],
    "ramp_density": [r"ramp\s*density[:\s]+(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*ramps?\s*per\s*mile"],
}
CONTEXT = {
    "facility_type": [r"(basic\s*freeway|two[\s-]*lane\s*highway|multilane\s*highway|urban\s*street)"],
    "terrain_type": [r"(level|rolling|mountainous)\s*terrain", r"terrain[:\s]+(level|rolling|mountainous)"],
    "city_type": [r"(urban|rural)\s*(?:area|setting|context)?"],
}
SHORTEST = 20
FREEWAY, TWO_LANE = ["bffs", "lc_r", "lc_l", "trd", "apd"], ["lane_width", "shoulder_width", "passing_type", "design_rad"]


def applicable(text: Column) -> Column:
    """Whether a text is long enough and names something of the field."""
    return F.coalesce((F.length(text) >= SHORTEST) & F.lower(text).rlike("|".join(KEYWORDS)), F.lit(False))


#: What a text must hold, one of each list, for any of the parameter's patterns to match.
HINTS = {
    "lane_width": ["lane"], "shoulder_width": ["shoulder"], "grade": ["grade"], "speed_limit": ["speed"], "design_speed": ["design"], "volume": ["volume", "veh", "aadt"], "phf": ["phf", "peak"], "truck_percentage": ["truck", "heavy"],
    "design_radius": ["radius"], "superelevation": ["super"], "length": ["length", "long", "segment"], "lateral_clearance": ["clearance"], "access_point_density": ["access"], "ramp_density": ["ramp"],
}


def first_match(text: Column, patterns: list[str]) -> Column:
    """The group of the first pattern that matches. Each text is searched once; the group is read off the short match."""
    return F.coalesce(*(F.regexp_extract(F.regexp_substr(text, F.lit(p)), p, 1) for p in patterns))


def text_parameters(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, param, value: what applicable texts state. One pass over the texts, without a shuffle."""
    low = texts.where(applicable(F.col(text))).withColumn("_low", F.lower(text))
    hinted = lambda p: reduce(Column.__or__, (F.contains("_low", F.lit(h)) for h in HINTS[p]))
    value = lambda p, ps: F.when(hinted(p), F.replace(first_match(F.col("_low"), ps), F.lit(","), F.lit("")).try_cast("double"))
    pairs = F.array(*(F.struct(F.lit(p).alias("param"), value(p, ps).alias("value")) for p, ps in TEXT.items()))
    return low.select(*keys, F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("_")).select(*keys, "_.*")


def text_context(text: Column) -> dict[str, Column]:
    """The facility, terrain and city type that a text names, without spaces and hyphens."""
    return {k: F.regexp_replace(first_match(F.lower(text), ps), r"[\s-]", "") for k, ps in CONTEXT.items()}


def facility_of_text(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("basic\\s*freeway"), "BasicFreeway").when(low.rlike("two[\\s-]*lane"), "TwoLaneHighway").when(low.contains("passing") & (low.contains("zone") | low.contains("lane")), "TwoLaneHighway")


def facility_of(names: Column, given: Column | None = None) -> Column:
    """The facility of a record from the names of its parameters: a freeway's own decide first."""
    found = F.when(F.arrays_overlap(names, F.array(*map(F.lit, FREEWAY))), "BasicFreeway").when(F.arrays_overlap(names, F.array(*map(F.lit, TWO_LANE))), "TwoLaneHighway")
    return found if given is None else F.coalesce(given, found)


def struct_like(names: Column) -> Column:
    """Whether a record's names are those of a freeway struct."""
    return F.size(F.array_except(F.array(*map(F.lit, ["bffs", "lc_r", "lc_l", "trd"])), names)) == 0


def source_type(explicit: Column, names: Column, text: Column) -> Column:
    """Which extractor reads a record: the one asked for, else a struct's, JSON's (any names), or text's."""
    return F.coalesce(explicit, F.when(struct_like(names), "struct").when(F.size(names) > 0, "json").when(applicable(text), "text"))
