"""Small text functions of events and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake(name: Column) -> Column:
    """A field name in snake case; ``field`` if nothing is left of it."""
    s = F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    s = F.lower(F.regexp_replace(F.regexp_replace(s, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", "field").otherwise(s)


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def extension(path: Column) -> Column:
    """The ending of a file name with its dot, in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def plain_name(name: Column) -> Column:
    """A field name without case and separators, for lookups."""
    return F.regexp_replace(F.lower(name), "[^0-9a-z@]", "")


def sha256(text: Column) -> Column:
    """Hexadecimal digest of the text in UTF-8."""
    return F.sha2(text, 256)


def empty_to_null(text: Column, *also: str) -> Column:
    """Null for the empty text and for the others named."""
    return F.when(~text.isin("", *also), text)
