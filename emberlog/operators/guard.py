"""Input guards: what is too long, too deep or too wide goes to the dead letters with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.extract import MAX_DEPTH, MAX_FIELDS, json_depth

MAX_BYTES = 65_536


def decoded(raw: Column) -> Column:
    """A line as text: invalid UTF-8 becomes U+FFFD, NUL the four characters ``\\x00``."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\x00"), F.lit("\\x00"))


def rejection(raw: Column, format_: Column | None = None, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> Column:
    """Why a line is rejected; null if it isn't. The depth is looked at only where the format is JSON."""
    long = F.when(F.octet_length(raw) > max_bytes, F.concat(F.lit("line of "), F.octet_length(raw).cast("string"), F.lit(f" bytes exceeds {max_bytes}")))
    if format_ is None:
        return long
    return F.coalesce(long, F.when((format_ == "json") & (json_depth(raw) > max_depth), F.lit(f"JSON nested deeper than {max_depth}")))


def too_wide(fields: Column, most: int = MAX_FIELDS) -> Column:
    """Why fields are rejected; null if they aren't."""
    return F.when(F.size(fields) > most, F.lit(f"more than {most} fields"))


def not_blank(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines with something in them."""
    return lines.filter(F.trim(F.col(raw)) != "")


def dead_letters(lines: DataFrame, reason: str = "rejected", raw: str = "raw") -> DataFrame:
    """The rejected lines: error, preview and what came with them. Lines without a reason stay out."""
    more = [c for c in ("source", "received_ms") if c in lines.columns]
    return lines.filter(F.col(reason).isNotNull()).select(F.substring(reason, 1, 500).alias("error"), F.substring(raw, 1, 512).alias("raw_preview"), *more)


def latest_dead_letters(dead: DataFrame, most: int = 1000) -> DataFrame:
    """The last rejected lines, newest first: a report."""
    return dead.orderBy(F.desc("received_ms")).limit(most)
