"""Detection: values of single-event rules as boolean Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.network import in_network
from emberlog.functions.regex import search


def parts(value: str) -> list[str | None]:
    """A value's literal texts, with None for ``*`` and an empty text for ``?``; a backslash takes their meaning away."""
    out: list[str | None] = []
    for escaped, star, one, other in re.findall(r"\\([*?\\])|(\*)|(\?)|(.)", value, re.S):
        if star or one:
            out.append(None if star else "")
        elif out and out[-1]:
            out[-1] += escaped or other
        else:
            out.append(escaped or other)
    return out


def wildcard(value: str) -> str:
    """A Java pattern for a value with ``*`` and ``?``."""
    return rf"(?is)\A{''.join('.*' if p is None else re.escape(p) or '.' for p in parts(value))}\z"


def fits(low: Column, value: str) -> Column:
    """Whether a text in lower case fits a value with ``*`` and ``?``; a pattern is needed only for ``?`` and stars in the middle."""
    found = parts(value)
    words = [p for p in found if p is not None]
    if "" in words or len(words) > 1:
        return low.rlike(wildcard(value))
    word, first, last = (words[0].lower() if words else ""), found[:1] == [None], found[-1:] == [None]
    if first and last:
        return low.contains(word)
    return low.endswith(word) if first else low.startswith(word) if last else low == word


def whole_number(value: str) -> int | None:
    """The integer that a value spells (also in hexadecimal, octal or binary digits), or None."""
    try:
        return int(value, 0)
    except ValueError:
        return None


def value(field: Column, wanted: object, modifier: str = "", integer: bool = False) -> Column:
    """Whether a field fits a rule's value. Case doesn't matter, but in ``re``; null fits nothing but null. A field that is an
    ``integer`` also fits a value that spells its number in another way, such as 0x1f."""
    if wanted is None:
        return F.coalesce(field, F.lit("")) == ""
    text, low = str(wanted), F.lower(F.coalesce(field, F.lit("")))
    number, spelt = field.try_cast("double"), whole_number(text)
    tests = {
        "contains": lambda: low.contains(text.lower()), "startswith": lambda: low.startswith(text.lower()), "endswith": lambda: low.endswith(text.lower()),
        "re": lambda: search(field, text), "cidr": lambda: in_network(field, text), "gt": lambda: number > float(text), "gte": lambda: number >= float(text),
        "lt": lambda: number < float(text), "lte": lambda: number <= float(text), "": lambda: fits(low, text) | (field.try_cast("bigint") == spelt if integer and spelt is not None else F.lit(False)),
    }
    if modifier not in tests:
        raise ValueError(f"unknown modifier {modifier!r}")
    return F.coalesce(tests[modifier](), F.lit(False))


def selection(fields: dict[str, Column], doc: dict) -> Column:
    """All entries ``field|modifier: value or values`` of a selection; one of several values is enough, with ``all`` each is needed."""
    out = F.lit(True)
    for name, wanted in doc.items():
        field, *modifiers = name.split("|")
        every = "all" in modifiers
        kind = next((m for m in modifiers if m != "all"), "")
        hit = F.lit(every)
        for w in wanted if isinstance(wanted, list) else [wanted]:
            hit = hit & value(fields[field], w, kind) if every else hit | value(fields[field], w, kind)
        out = out & hit
    return out
