"""Whole single-event rules: selections, keywords and their condition as one boolean Column."""

from __future__ import annotations

import base64
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators import detect

# The events of Windows that a rule's category means.
CATEGORY_EVENTS = {
    "process_creation": ["1", "4688"], "network_connection": ["3"], "image_load": ["7"], "file_event": ["11"], "file_change": ["2"],
    "file_delete": ["23", "26"], "registry_set": ["13"], "registry_add": ["12"], "registry_delete": ["12"], "registry_rename": ["14"],
    "registry_event": ["12", "13", "14"], "process_access": ["10"], "create_remote_thread": ["8"], "driver_load": ["6"],
    "dns_query": ["22"], "ps_script": ["4104"], "ps_module": ["4103"], "pipe_created": ["17", "18"], "wmi_event": ["19", "20", "21"],
    "process_termination": ["5"], "raw_access_thread": ["9"], "create_stream_hash": ["15"],
}
DASHES = ("-", "/", "–", "—", "―")


def dashed(text: str) -> list[str]:
    """The forms of an option with another leading dash."""
    return [d + text[1:] for d in DASHES] if text[:1] in ("-", "/") else [text]


def shifted(text: str) -> list[str]:
    """What base64 makes of the text at each of the three offsets, without characters that depend on the neighbours."""
    raw = text.encode()
    out = []
    for k in range(3):
        bits = 8 * (k + len(raw))
        coded = base64.b64encode(bytes(k) + raw + bytes(-(k + len(raw)) % 3)).decode()
        out.append(coded[-(-8 * k // 6) : bits // 6])
    return out


def entry(field: Column, modifiers: list[str], wanted: object, integer: bool = False) -> Column:
    """One ``field|modifiers: value or values``; unknown modifiers are an error."""
    if "exists" in modifiers:
        return (F.coalesce(field, F.lit("")) != "") == F.lit(bool(wanted))
    every = "all" in modifiers
    kind = next((m for m in modifiers if m not in ("all", "windash", "base64", "base64offset")), "")
    tests = []
    for w in wanted if isinstance(wanted, list) else [wanted]:
        if w is not None and "base64offset" in modifiers:
            tests.append(reduce(Column.__or__, [F.coalesce(field.contains(x), F.lit(False)) for x in shifted(str(w))]))
            continue
        if w is not None and "base64" in modifiers:
            w = base64.b64encode(str(w).encode()).decode()
        forms = dashed(str(w)) if w is not None and "windash" in modifiers else [w]
        tests.append(reduce(Column.__or__, [detect.value(field, x, kind, integer) for x in forms]))
    return reduce(Column.__and__ if every else Column.__or__, tests, F.lit(every)) if tests else F.lit(every)


def gate(rule: dict, event_code: Column | None) -> Column:
    """Whether a row's event code is one that the rule's ``logsource`` category means; rows without a code and other categories pass."""
    wanted = CATEGORY_EVENTS.get(str((rule.get("logsource") or {}).get("category") or "").lower())
    if event_code is None or not wanted:
        return F.lit(True)
    code = F.coalesce(event_code.cast("string"), F.lit(""))
    return (code == "") | code.isin(wanted)


def selection(fields: dict[str, Column], doc: object, integers: frozenset[str] = frozenset()) -> Column:
    """A map is an AND of its entries, a list of maps an OR; texts are keywords, looked for in every field. A field that the table lacks is null."""
    if isinstance(doc, dict):
        tests = [entry(fields.get(name.split("|")[0], F.lit(None).cast("string")), name.split("|")[1:], w, name.split("|")[0] in integers) for name, w in doc.items()]
        return reduce(Column.__and__, tests, F.lit(True))
    if isinstance(doc, list):
        return reduce(Column.__or__, [selection(fields, d, integers) for d in doc], F.lit(False))
    return reduce(Column.__or__, [detect.value(c, f"*{doc}*") for c in fields.values()], F.lit(False))


def condition(text: str, names: list[str]) -> str:
    """A rule's condition as SQL over the columns ``sel_<name>``: ``and``, ``or``, ``not`` and brackets mean the same there."""

    def quantified(m: re.Match) -> str:
        shape = "[^_].*" if m[2] == "them" else re.escape(m[2]).replace(r"\*", ".*")
        some = [f"`sel_{n}`" for n in names if re.fullmatch(shape, n)]
        if not some:
            raise ValueError(f"{m[0]!r} names no selection")
        return "(" + (" AND " if m[1].lower() == "all" else " OR ").join(some) + ")"

    out = re.sub(r"\b(1|any|all) of ([\w*]+)", quantified, text, flags=re.I)
    words = {n: f"`sel_{n}`" for n in names}
    out = re.sub(r"`[^`]*`|[\w]+", lambda m: words.get(m[0], m[0]), out)
    left = set(re.findall(r"[\w]+", re.sub(r"`[^`]*`", "", out).lower())) - {"and", "or", "not"}
    if left:
        raise ValueError(f"unknown names in condition: {sorted(left)}")
    return out


def matched(df: DataFrame, rules: dict[str, dict], fields: dict[str, Column], integers: frozenset[str] = frozenset(), event_code: Column | None = None) -> DataFrame:
    """``df`` with ``alerts``, the sorted names of the rules that fit each row. Several conditions of a rule are alternatives.

    ``integers`` names fields whose numbers may be spelt otherwise; with ``event_code``, rules see rows of their log source only.
    All rules run in one pass over the table; nothing is joined or shuffled.
    """
    flags, made = [], {}
    for n, (name, rule) in enumerate(sorted(rules.items())):
        sels = {k: v for k, v in rule["detection"].items() if k not in ("condition", "timeframe")}
        made |= {f"sel_{n}_{k}": F.coalesce(selection(fields, v, integers), F.lit(False)) for k, v in sels.items()}
        texts = rule["detection"]["condition"]
        tests = [condition(t, list(sels)).replace("`sel_", f"`sel_{n}_") for t in (texts if isinstance(texts, list) else [texts])]
        flags.append(F.when(gate(rule, event_code) & F.expr(" OR ".join(f"({t})" for t in tests)), F.lit(name)))
    return df.withColumns(made).withColumn("alerts", F.array_compact(F.array(*flags)) if flags else F.expr("cast(array() as array<string>)")).drop(*made)
