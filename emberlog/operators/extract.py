"""Extractors: a text Column to a map of fields (name to text). Null means that the text hasn't the extractor's form."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.regex import groups

MAX_FIELDS, MAX_DEPTH = 1024, 32
NO_FIELDS = "cast(map() as map<string,string>)"


def prepare(spark: SparkSession) -> None:
    """The settings that extractors need: the last of repeated keys wins, as in most parsers."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def none() -> Column:
    """No fields."""
    return F.expr(NO_FIELDS)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it: a Column that is used twice is its whole tree twice."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def named(pairs: list[tuple[str, Column]]) -> Column:
    """A map of the pairs whose value isn't null."""
    flat = [x for name, value in pairs for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull()) if flat else none()


def quoted(chars: str) -> str:
    """The characters, each safe inside a pattern."""
    return "".join("\\" + c for c in chars)


def kv(text: Column, options: dict) -> Column:
    """Pairs such as ``a=1 b="x y"``: the separators and the quote are options; an empty value stays empty."""
    sep, eq, q = options.get("pair_sep", " "), quoted(options.get("kv_sep", "=")), quoted(options.get("quote", '"'))
    blank = sep in (" ", "\\s")
    stop = "\\s" if blank else quoted(sep)
    pattern = rf"([A-Za-z_][\w.\-:/\[\]@]*)\s*{eq}{'' if blank else '[ ]*'}({q}(?:[^{q}\\]|\\.)*{q}|[^{stop}]*)"
    mark = options.get("quote", '"')
    plain = lambda v: F.when((F.length(v) >= 2) & v.startswith(mark) & v.endswith(mark), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("\\" + mark), F.lit(mark))).otherwise(v)
    cut = options.get("kv_sep", "=")
    pairs = F.regexp_extract_all(text, F.lit(pattern), 0)  # one pass: a key has no separator, so the first one ends it
    key = lambda p: F.rtrim(F.substring_index(p, cut, 1), F.lit(" \t\r\n\x0b\f"))
    value = lambda p: plain(F.ltrim(F.substring(p, F.instr(p, cut) + len(cut), F.length(p))) if not blank else F.substring(p, F.instr(p, cut) + len(cut), F.length(p)))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(key(p).alias("key"), value(p).alias("value"))))


def csv(text: Column, options: dict) -> Column:
    """One row by position. ``columns`` names them, or ``columns_by`` picks the names by the value at an index; ``_skip`` drops a value, more values are ``_col<N>``."""
    sep, q = quoted(options.get("delimiter", ",")), quoted(options.get("quote", '"'))
    mark = options.get("quote", '"')
    raw = F.regexp_extract_all(F.concat(F.trim(text), F.lit(options.get("delimiter", ","))), F.lit(f"({q}(?:[^{q}]|{q}{q})*{q}|[^{sep}]*){sep}"), 1)
    plain = F.transform(raw, lambda v: F.when((F.length(v) >= 2) & v.startswith(mark) & v.endswith(mark), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit(mark * 2), F.lit(mark))).otherwise(v))
    names = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")

    def columns(key: Column) -> Column:
        by, fixed = options["columns_by"], names(options.get("columns", []))
        chosen = fixed
        for value, xs in [*by["map"].items()][::-1]:
            if value != "default":
                chosen = F.when(key == value, names(xs)).otherwise(chosen)
        if "default" in by["map"]:
            chosen = F.when(key.isin([k for k in by["map"] if k != "default"]), chosen).otherwise(names(by["map"]["default"]))
        return F.concat(fixed, chosen) if by.get("append") else chosen

    def fields(row: Column, columns: Column) -> Column:
        cells = F.transform(row, lambda v, i: F.struct(F.coalesce(F.get(columns, i), F.concat(F.lit("_col"), i.cast("string"))).alias("k"), v.alias("v")))
        return F.map_from_entries(F.filter(cells, lambda c: (c["k"] != "_skip") & (F.lit(bool(options.get("keep_empty"))) | (c["v"] != ""))))

    if by := options.get("columns_by"):  # the row and its columns are bound: inside the function of a cell they would be worked out again for each cell
        key = lambda row: F.coalesce(F.try_element_at(row, F.lit(by["index"] + 1)), F.lit(""))
        return bound(plain, lambda row: bound(bound(key(row), columns), lambda chosen: fields(row, chosen)))
    return fields(plain, names(options.get("columns", [])))


CEF_HEADER = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity"]


def cef(text: Column, options: dict) -> Column:
    """CEF: seven header fields with ``\\`` escapes, then ``key=value`` up to the next key; what stands before it is ``cef_prefix``."""
    at = F.instr(text, "CEF:")
    head = r"((?:\\.|[^|\\])*)\|" * 7
    body = F.substring(text, at + 4, F.length(text))
    fields = [(name, F.regexp_replace(F.regexp_extract(body, "^" + head, i + 1), r"\\(.)", "$1")) for i, name in enumerate(CEF_HEADER)]
    rest = F.replace(F.regexp_replace(body, "(?s)^" + head, ""), F.lit("\\="), F.lit("\x01"))
    pairs = F.filter(F.split(rest, r"(?:^|\s)(?=[A-Za-z0-9_.\[\]\-]+=)"), lambda p: p.rlike(r"^[A-Za-z0-9_.\[\]\-]+="))
    value = lambda p: F.replace(F.replace(F.replace(F.trim(F.regexp_replace(p, r"(?s)^[^=]*=", "")), F.lit("\x01"), F.lit("=")), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    extension = F.map_from_arrays(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)), F.transform(pairs, value))
    prefix = F.trim(F.substring(text, F.lit(1), at - 1))
    return F.when((at > 0) & body.rlike("^" + head), F.map_concat(named([*fields, ("cef_prefix", F.when(prefix != "", prefix))]), extension))


def leef(text: Column, options: dict) -> Column:
    """LEEF 1.0 and 2.0: five header fields, then pairs set apart by a tab or by the character that 2.0 names (itself or ``x09``)."""
    at = F.instr(text, "LEEF:")
    parts = F.split(F.substring(text, at + 5, F.length(text)), r"\|")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    second = part(1).startswith("2") & (F.size(parts) > 6)
    named_by = F.lower(part(6))
    code = F.conv(F.regexp_replace(named_by, "^0?x", ""), 16, 10).try_cast("int")
    delimiter = F.when(second & named_by.rlike("^0?x[0-9a-f]+$"), F.chr(code)).when(second & (part(6) != ""), part(6)).otherwise("\t")
    attributes = F.array_join(F.slice(parts, F.when(second, F.lit(7)).otherwise(F.lit(6)), F.greatest(F.size(parts), F.lit(1))), "|")
    pairs = F.filter(F.split(attributes, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))), lambda p: F.trim(F.substring_index(p, "=", 1)).isNotNull() & p.contains("=") & (F.trim(F.substring_index(p, "=", 1)) != ""))
    body = F.map_from_arrays(F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1))), F.transform(pairs, lambda p: F.trim(F.regexp_replace(p, "(?s)^[^=]*=", ""))))
    header = named([("leef_version", part(1)), ("device_vendor", part(2)), ("device_product", part(3)), ("device_version", part(4)), ("event_id", part(5))])
    return F.when((at > 0) & (F.size(parts) >= 5), F.map_concat(header, body))


RFC5424 = r"^1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (.*))?$"
STAMP = r"^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d{1,2}(?: \d{4})? \d{2}:\d{2}:\d{2}(?:\.\d+)?|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)(?= |:|$)"
HOST = r"^([A-Za-z0-9][A-Za-z0-9.\-_]*) "
TAG = r"^([A-Za-z0-9_\-./%]+?)(?:\[(\d+)\])?: ?"


def syslog(text: Column, options: dict) -> Column:
    """The syslog header (RFC 5424, RFC 3164 and vendors' variants of it) with the rest as ``message``.

    ``sd_prefix`` false names structured data by its parameters alone; ``no_host`` and ``no_tag`` leave those in the message.
    Host and tag are looked for only after a timestamp, the tag also without.
    """
    s = F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), "[\r\n]+$", "")
    pri = F.regexp_extract(s, r"^<(\d{1,3})>", 1).try_cast("int")
    headless = lambda h: _modern_or_old(h["s"], h["pri"], options)
    return F.when(text.isNotNull(), bound(F.struct(F.regexp_replace(s, r"^<\d{1,3}>", "").alias("s"), pri.alias("pri")), headless))


def _modern_or_old(s: Column, pri: Column, options: dict) -> Column:
    common = [("syslog_pri", pri), ("syslog_facility", F.shiftright(pri, 3)), ("syslog_severity", pri.bitwiseAND(7))]
    flat = options.get("sd_prefix", True) is False

    def modern(g: Column) -> Column:
        field = lambda i: F.when(F.get(g, F.lit(i)) != "-", F.get(g, F.lit(i)))
        name = lambda e: F.regexp_extract(e, r"^\[([^\s\]]+)", 1)
        parameter = r'([^=\s\[]+)="((?:[^"\\]|\\.)*)"'
        keys = lambda e: F.transform(F.regexp_extract_all(e, F.lit(parameter), 1), lambda k: k if flat else F.concat(F.lit("sd."), name(e), F.lit("."), k))
        new = [("syslog_timestamp", field(0)), ("syslog_host", field(1)), ("syslog_app", field(2)), ("syslog_procid", field(3)), ("syslog_msgid", field(4))]
        tail = [("message", F.regexp_replace(F.get(g, F.lit(6)), "^﻿+", "")), ("syslog_format", F.lit("rfc5424"))]

        def with_data(elements: Column) -> Column:
            entries = F.flatten(F.transform(elements, lambda e: F.arrays_zip(keys(e).alias("k"), F.transform(F.regexp_extract_all(e, F.lit(parameter), 2), lambda v: F.replace(v, F.lit('\\"'), F.lit('"'))).alias("v"))))
            data = F.map_from_entries(F.transform(entries, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))
            first = [("sd_id", F.when(F.size(elements) > 0, name(F.get(elements, F.lit(0)))))] if flat else []
            return F.map_concat(named(common + new + first), F.coalesce(data, none()), named(tail))

        return bound(F.regexp_extract_all(F.get(g, F.lit(5)), F.lit(r'(\[[^\s\]]+(?:\s+[^=\s]+="(?:[^"\\]|\\.)*")*\])'), 1), with_data)

    def hosted(stamp: Column, rest: Column) -> Column:
        host = F.when((stamp != "") & ~rest.rlike("^(?:%|:|CEF:|LEEF:)") & F.lit(not options.get("no_host")), F.regexp_extract(rest, HOST, 1))
        return bound(F.when(host != "", host), lambda host: bound(F.regexp_replace(F.when(host.isNotNull(), F.substring(rest, F.length(host) + 2, F.length(rest))).otherwise(rest), "^[: ]+", ""), lambda rest: tagged(stamp, host, rest)))

    def tagged(stamp: Column, host: Column, rest: Column) -> Column:
        yes = F.lit(not options.get("no_tag")) & ~rest.rlike(r"^(?:CEF:|LEEF:|\{)") & rest.rlike(TAG)
        parts = F.when(yes, F.struct(F.regexp_extract(rest, TAG, 1).alias("app"), F.regexp_extract(rest, TAG, 2).alias("proc"), F.regexp_replace(rest, TAG, "").alias("rest")))
        parts = parts.otherwise(F.struct(F.lit(None).cast("string").alias("app"), F.lit(None).cast("string").alias("proc"), rest.alias("rest")))
        return bound(parts, lambda p: named([*common, ("syslog_timestamp", F.when(stamp != "", stamp)), ("syslog_host", host), ("syslog_app", p["app"]), ("syslog_procid", F.when(p["proc"] != "", p["proc"])), ("message", p["rest"]), ("syslog_format", F.lit("rfc3164"))]))

    def old() -> Column:
        after = lambda stamp: F.when(stamp == "", s).otherwise(F.ltrim(F.substring(s, F.length(stamp) + 1, F.length(s))))
        return bound(F.regexp_extract(s, STAMP, 1), lambda stamp: bound(after(stamp), lambda rest: hosted(stamp, rest)))

    return bound(F.when(s.startswith("1 "), groups(s, RFC5424)[0]), lambda g: F.when(g.isNotNull(), modern(g)).otherwise(old()))


# The base patterns that %{NAME} stands for.
GROK = {
    "INT": r"[+-]?\d+", "POSINT": r"\d+", "NUMBER": r"[+-]?\d+(?:\.\d+)?", "WORD": r"\w+", "NOTSPACE": r"\S+", "SPACE": r"\s*",
    "DATA": r".*?", "GREEDYDATA": r".*", "QS": r'"(?:[^"\\]|\\.)*"', "IPV4": r"(?:\d{1,3}\.){3}\d{1,3}",
    "IPV6": r"[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+", "IP": r"(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+)",
    "HOSTNAME": r"[A-Za-z0-9][A-Za-z0-9.\-_]*", "IPORHOST": r"(?:(?:\d{1,3}\.){3}\d{1,3}|[A-Za-z0-9][A-Za-z0-9.\-_]*)",
    "USERNAME": r"[A-Za-z0-9._@\\\-]+", "MAC": r"(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}", "URIPATH": r"/[^\s?#]*",
    "URI": r"[A-Za-z][A-Za-z0-9+.\-]*://\S+", "MONTH": r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*",
    "SYSLOGTIMESTAMP": r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d{1,2} \d{2}:\d{2}:\d{2}",
    "TIMESTAMP_ISO8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "HTTPDATE": r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}",
}


def grok_pattern(pattern: str) -> tuple[str, list[str]]:
    """A pattern with ``%{NAME:field}`` spelt out as groups, and the fields in order."""
    fields: list[str] = []

    def spelt(m: re.Match) -> str:
        if m[1] not in GROK:
            raise ValueError(f"no grok pattern {m[1]}")
        if m[2]:
            fields.append(m[2])
        return f"(?P<g{len(fields)}>{GROK[m[1]]})" if m[2] else f"(?:{GROK[m[1]]})"

    return re.sub(r"%\{([A-Z0-9_]+)(?::([\w.@\-]+))?\}", spelt, pattern), fields


def first_match(text: Column, patterns: list[tuple[str, list[str] | None]]) -> Column:
    """Fields of the first pattern that matches; null if none does. Groups that match nothing give no field."""
    found = []
    for pattern, fields in patterns:
        values, names = groups(text, pattern)
        unnamed = fields is not None
        labels = [n for n in names if n]
        place = [i for i, n in enumerate(names) if n]
        keys = fields if unnamed else labels
        found.append(F.when(values.isNotNull(), named([(k, F.when(F.get(values, F.lit(i)) != "", F.get(values, F.lit(i)))) for k, i in zip(keys, place, strict=True)])))
    return F.coalesce(*found)


def grok(text: Column, options: dict) -> Column:
    """Patterns of named base patterns; the first that occurs gives the fields."""
    return first_match(text, [grok_pattern(p) for p in options.get("patterns") or [options["pattern"]]])


def regex(text: Column, options: dict) -> Column:
    """Patterns with named groups; the first that occurs gives the fields."""
    return first_match(text, [(p, None) for p in options.get("patterns") or [options["pattern"]]])


def json(text: Column, options: dict) -> Column:
    """Fields of an object, nested ones by dotted names, as deep as MAX_DEPTH lets a line through; lists stay whole, as JSON.

    A value that is no object is the field ``value``. Null values are left out. Repeated keys: the last counts.
    """
    top = F.try_parse_json(F.trim(text))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT<") & (F.schema_of_variant(v) != "OBJECT<>")
    entries_of = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))

    def spread(e: Column) -> Column:
        inner = F.transform(entries_of(e["value"]), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(is_object(e["value"]), inner).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    entries = entries_of(top)
    if options.get("flatten", True):  # as many rounds as the text has inner brackets, at most
        rounds = F.array_repeat(F.lit(0), F.least(F.lit(MAX_DEPTH), F.regexp_count(text, F.lit(r"\{")) - 1))
        entries = F.aggregate(rounds, entries, lambda acc, _: F.when(F.exists(acc, lambda e: is_object(e["value"])), F.flatten(F.transform(acc, spread))).otherwise(acc))
    shown = F.transform(entries, lambda e: F.struct(e["key"], F.try_variant_get(e["value"], "$", "string").alias("value")))
    whole = F.when(top.isNotNull() & ~F.schema_of_variant(top).startswith("OBJECT<"), F.create_map(F.lit("value"), F.try_variant_get(top, "$", "string")))
    return F.coalesce(F.map_from_entries(F.filter(shown, lambda e: e["value"].isNotNull())), whole)


def json_depth(text: Column) -> Column:
    """How deep brackets nest outside of strings."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    step = lambda acc, c: F.struct((acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("d"), F.greatest(acc["m"], acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("m"))
    return F.aggregate(F.split(marks, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)), lambda acc: acc["m"])


def xml_fields(text: str, windows: bool, strip_root: bool) -> dict[str, str] | None:
    """Fields of one document: dotted paths of elements and attributes, repeats as a JSON-like list, ``<Data Name=x>`` by its name; None if it is malformed or has a DOCTYPE."""
    if "<!DOCTYPE" in text:
        return None
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return None
    out: dict[str, list[str]] = {}
    local = lambda name: name.rsplit("}", 1)[-1]

    def visit(node: ElementTree.Element, path: str) -> None:
        tag, body = local(node.tag), (node.text or "").strip()
        if windows and tag == "Data" and node.get("Name"):
            out.setdefault(node.get("Name"), []).append(body)
            return
        here = f"{path}.{tag}" if path else tag
        for k, v in node.attrib.items():
            out.setdefault(f"{here}.{local(k)}", []).append(v)
        if body:
            out.setdefault(f"{here}._text" if len(node) else here, []).append(body)
        for child in node:
            visit(child, here)

    if strip_root:
        for k, v in root.attrib.items():
            out.setdefault(local(k), []).append(v)
        for child in root:
            visit(child, "")
    else:
        visit(root, "")
    return {k: v[0] if len(v) == 1 else "[" + ",".join(f'"{x}"' for x in v) + "]" for k, v in out.items()}


def xml(text: Column, options: dict) -> Column:
    """XML to fields. No built-in walks a document of unknown names, so this one is an Arrow function."""
    windows, strip = options.get("windows_eventdata", True), options.get("strip_root", True)

    @F.pandas_udf("map<string,string>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: xml_fields(t, windows, strip) if t else None)

    return walk(text)


EXTRACTORS = {"json": json, "xml": xml, "csv": csv, "kv": kv, "grok": grok, "regex": regex, "cef": cef, "leef": leef, "syslog": syslog}
