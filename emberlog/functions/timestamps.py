"""Vendor timestamps to epoch milliseconds. Nothing depends on the session's time zone or on the wall clock."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that are tried in turn, in strptime's notation.
FORMATS = ["%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%d/%b/%Y:%H:%M:%S %z", "%b %d %Y %H:%M:%S", "%b %d %H:%M:%S", "%Y-%m-%d %H:%M:%S%z", "%d-%b-%Y %H:%M:%S"]
LETTERS = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "b": "MMM", "B": "MMMM", "z": "xx", "y": "yy", "j": "D", "I": "h", "p": "a"}
DAY_MS = 86_400_000


def java_format(fmt: str) -> tuple[str, bool, bool]:
    """A strptime format in Java's letters, whether it has a zone, and whether it has a year. A fraction is optional digits."""
    fmt, out, i = fmt.replace(".%f", "%f"), "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            out += "[.SSSSSSSSS]" if fmt[i + 1] == "f" else LETTERS[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out, "%z" in fmt, bool(re.search("%[Yy]", fmt))


def offset(tz: str | None) -> str:
    """A zone offset in the form +hhmm; none is UTC."""
    if not tz or tz in ("Z", "UTC"):
        return "+0000"
    digits = tz.lstrip("+-").replace(":", "").ljust(4, "0")
    return ("-" if tz.startswith("-") else "+") + digits[:4]


def number_ms(text: Column) -> Column:
    """Epoch nanoseconds, microseconds, milliseconds or seconds, told apart by size; null if the text is no plain number."""
    v = F.when(text.rlike(r"^[0-9]*\.?[0-9]*$") & text.rlike("[0-9]"), text.try_cast("double"))
    return F.when(v > 1e17, v / 1e6).when(v > 1e14, v / 1e3).when(v > 1e11, v).otherwise(v * 1000).try_cast("bigint")


def parsed_ms(text: Column, fmt: str, tz: str | None, now: Column | None) -> Column:
    """Milliseconds of a text in one format; null if it has another. Without a year, it is the last one that isn't over two days ahead of ``now``."""
    java, zoned, dated = java_format(fmt)
    if not zoned:
        text, java = F.concat(text, F.lit(offset(tz))), java + "xx"
    if dated:
        return F.unix_millis(F.try_to_timestamp(text, F.lit(java)))
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    year = F.date_format(F.timestamp_millis(now), "yyyy").cast("int")
    at = lambda y: F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", y.cast("string"), text), F.lit(f"yyyy {java}")))
    return F.when(at(year) > now + 2 * DAY_MS, at(year - 1)).otherwise(at(year))


def epoch_ms(value: Column, fmt: str | None = None, tz: str | None = None, now: Column | None = None) -> Column:
    """Epoch milliseconds of a number or of a text in ``fmt`` or one of ``FORMATS``; null if it is neither."""
    s = F.regexp_replace(F.trim(value), r"\s+", " ")
    plain = F.regexp_replace(F.regexp_replace(s, "Z$", "+0000"), r"(:\d{2}(?:\.\d+)?\s?[+-]\d{2}):(\d{2})$", "$1$2")
    out = number_ms(F.trim(value))
    if fmt:
        return F.coalesce(out, parsed_ms(plain, fmt, tz, now))
    tried = [f for f in FORMATS if ".%f" in f or f.replace("%S", "%S.%f", 1) not in FORMATS]  # a fraction is optional anyway
    hopeful = lambda p, f: F.when(F.lower(p).contains("t"), p) if "dT" in f else F.when(p.contains("/"), p) if "/" in f else p
    # the text is made plain once for all formats; formats whose marks it lacks aren't tried, for a failure costs more than a parse
    return F.coalesce(out, F.get(F.transform(F.array(plain), lambda p: F.coalesce(*[parsed_ms(hopeful(p, f), f, tz, now) for f in tried])), F.lit(0)))
