"""Conditions of packs, compiled to boolean Columns over a map of fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.regex import search


def field(fields: Column, name: str) -> Column:
    """A field's text; null if it is missing."""
    return F.try_element_at(fields, F.lit(name))


def condition(doc: dict | None, fields: Column) -> Column:
    """``all``, ``any``, ``not``, ``exists``, ``equals``, ``in``, ``contains``, ``startswith`` or ``regex``; none is true.

    A missing field compares as the empty text. All but ``regex`` ignore case.
    """
    if not doc:
        return F.lit(True)
    if "all" in doc:
        return reduce(lambda a, b: a & b, [condition(d, fields) for d in doc["all"]], F.lit(True))
    if "any" in doc:
        return reduce(lambda a, b: a | b, [condition(d, fields) for d in doc["any"]], F.lit(False))
    if "not" in doc:
        return ~condition(doc["not"], fields)
    value = F.coalesce(field(fields, doc.get("field", "")), F.lit(""))
    low = F.lower(value)
    if "exists" in doc:
        return (value != "") == F.lit(bool(doc["exists"]))
    if "equals" in doc:
        return low == str(doc["equals"]).lower()
    if "in" in doc:
        return low.isin([str(x).lower() for x in doc["in"]])
    if "contains" in doc:
        return low.contains(doc["contains"].lower())
    if "startswith" in doc:
        return low.startswith(doc["startswith"].lower())
    return search(value, doc["regex"]) if "regex" in doc else F.lit(True)
