"""Patterns written for a linear-time regex dialect, made ready for Java's engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 1000
MARK = "\x01"
NESTED = re.compile(r"\((?:[^()\\]|\\.)*(?<!\\)[+*](?:[^()\\]|\\.)*\)[+*]")


class PatternError(ValueError):
    """A pattern that is too long, can't be compiled or could backtrack without bound."""


def to_java(pattern: str) -> tuple[str, list[str | None]]:
    """The pattern in Java's syntax, and the names of its capturing groups in order (None where unnamed).

    ``(?P<n>`` becomes a plain group, ``$`` the very end of the text, and ``.`` matches all but a line feed.
    """
    if len(pattern) > LONGEST:
        raise PatternError(f"pattern longer than {LONGEST} characters")
    if NESTED.search(pattern):
        raise PatternError(f"nested unbounded repetition in {pattern!r}")
    out, names, i, bracket = [], [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if bracket:
            bracket = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            bracket = True
            step = 2 if pattern[i + 1 : i + 2] == "^" else 1
            out.append(pattern[i : i + step])
            i += step
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        elif c == "$":
            out.append("\\z")
        elif c == "(":
            named = re.match(r"\(\?P<(\w+)>", pattern[i:])
            if named:
                names.append(named[1])
                out.append("(")
                i += len(named[0])
                continue
            if pattern[i + 1 : i + 2] != "?":
                names.append(None)
            out.append(c)
        else:
            out.append(c)
        i += 1
    return "(?d)" + "".join(out), names


def search(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs; null counts as empty."""
    return F.coalesce(text, F.lit("")).rlike(to_java(pattern)[0])


def groups(text: Column, pattern: str) -> tuple[Column, list[str | None]]:
    """All groups of the first match as an array, by one evaluation of the pattern; null if there is none. An unmatched group is empty."""
    java, names = to_java(pattern)
    body = java.removeprefix("(?d)")
    found = F.regexp_replace(text, F.lit(f"(?ds)^.*?(?-s:{body}).*\\z"), F.lit(MARK + "".join(f"${i + 1}{MARK}" for i in range(len(names)))))
    return F.when(found.startswith(MARK) & search(text, pattern) if not names else found.startswith(MARK), F.slice(F.split(found, MARK), 2, max(len(names), 1))), names


def first(text: Column, pattern: str) -> Column:
    """The group called ``v``, else group 1, else the whole match; null without a match."""
    java, names = to_java(pattern)
    group = names.index("v") + 1 if "v" in names else 1 if names else 0
    return F.when(text.rlike(java), F.regexp_extract(text, java, group))
