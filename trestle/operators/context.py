"""Which rules a context lets apply. Conditions and contexts are nested columns; all of this is one expression over the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(c: Column) -> Column:
    """A context value without spaces, hyphens and underscores, in lower case."""
    return F.regexp_replace(F.lower(c), "[ _-]", "")


def _same(context: Column, c: Column) -> Column:
    return F.lower(F.try_element_at(context, c["type"])) == F.lower(c["value"])


def strict_match(context: Column, conditions: Column) -> Column:
    """All conditions are met; a missing key meets none."""
    return F.forall(conditions, lambda c: F.coalesce(_same(context, c), F.lit(False)))


def lenient_match(context: Column, conditions: Column) -> Column:
    """No condition is contradicted; a missing key contradicts none."""
    return F.forall(conditions, lambda c: F.coalesce(_same(context, c), F.lit(True)))


def tri_state(context: Column, conditions: Column) -> Column:
    """`mismatched` if a condition is contradicted, else `undecidable` if one has no value to go by, else `applicable`."""
    contradicted = F.exists(conditions, lambda c: F.coalesce(~_same(context, c), F.lit(False)))
    open_ = F.exists(conditions, lambda c: F.try_element_at(context, c["type"]).isNull())
    return F.when(contradicted, "mismatched").when(open_, "undecidable").otherwise("applicable")


def pending(context: Column, conditions: Column) -> Column:
    """The conditions that have no value to go by."""
    return F.filter(conditions, lambda c: F.try_element_at(context, c["type"]).isNull())


def merged(extracted: Column, provided: Column) -> Column:
    """Both contexts; what is provided overrides what was extracted."""
    return F.map_zip_with(extracted, provided, lambda k, e, p: F.coalesce(p, e))
