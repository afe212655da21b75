"""Texts to the types of event attributes. A result is the display text of the typed value; null means that it can't be one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.network import canonical_ip
from emberlog.functions.timestamps import epoch_ms

YES, NO = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")
# Attribute names by their type in the event schema.
INTEGERS = frozenset("bytes bytes_in bytes_out packets packets_in packets_out code length pid protocol_num duration tcp_flags".split())
ARRAYS = frozenset("types categories classification_ids answers".split())
TIMES = frozenset("time start_time end_time logged_time processed_time".split())


def attribute_type(path: str) -> str:
    """The type of an attribute, by its path: its last name decides."""
    name = re.sub(r"\[\d+\]", "", path).rsplit(".", 1)[-1]
    if name in TIMES:
        return "timestamp"
    if name == "ip":
        return "ip"
    if name == "port" or name in INTEGERS or name.endswith(("_id", "_ids")):
        return "integer"
    return "boolean" if name.startswith("is_") else "string"


def is_array(path: str) -> bool:
    """Whether the attribute holds a list."""
    return path.rsplit(".", 1)[-1] in ARRAYS


def to_integer(value: Column) -> Column:
    """A whole number: a fraction is cut off, ``0x`` starts a hexadecimal number, true and false are 1 and 0."""
    s = F.trim(value)
    low = F.lower(s)
    return F.when(low.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(s, 3, 20), 16, 10).try_cast("bigint")).when(s.contains("."), s.try_cast("double").try_cast("bigint")).when(low == "true", F.lit(1)).when(low == "false", F.lit(0)).otherwise(F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint")))


def to_boolean(value: Column) -> Column:
    """true or false by the usual words."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*YES), F.lit(True)).when(low.isin(*NO), F.lit(False))


def coerce(value: Column, kind: str, tz: str | None = None, now: Column | None = None) -> Column:
    """The value as text of the given type; see the module."""
    if kind == "integer":
        return to_integer(value).cast("string")
    if kind == "float":
        return value.try_cast("double").cast("string")
    if kind == "boolean":
        return to_boolean(value).cast("string")
    if kind == "timestamp":
        return epoch_ms(value, tz=tz, now=now).cast("string")
    if kind == "ip":
        return canonical_ip(value)
    return value
