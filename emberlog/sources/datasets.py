"""Labelled detection datasets and rule documents from files."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.views import Dictionary

CASES = ("true_positive_1", "true_positive_2", "benign_1", "benign_2")
PLACE = r"([^/]+/[^/]+)/([^/]+)\.[A-Za-z]+$"


def case_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, case, raw) of all ``<group>/<name>/<case>.jsonl`` under a folder; blank lines stay out."""
    rows = spark.read.text(f"{folder}/*/*/*.jsonl").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return rows.filter(F.trim("raw") != "").select(F.regexp_extract("path", PLACE, 1).alias("dataset"), F.regexp_extract("path", PLACE, 2).alias("case"), "raw")


def expected(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, event_source, rule_type, case, expected_alerts) of the ``expected.json`` of each dataset."""
    kind = "event_source string, rule_type string, " + ", ".join(f"{c} struct<expected_alerts:int>" for c in CASES)
    rows = spark.read.text(f"{folder}/*/*/expected.json", wholetext=True).select(F.regexp_extract("_metadata.file_path", PLACE, 1).alias("dataset"), F.from_json("value", kind).alias("e"))
    each = F.array(*[F.struct(F.lit(c).alias("case"), F.col(f"e.{c}.expected_alerts").alias("expected_alerts")) for c in CASES])
    return rows.select("dataset", "e.event_source", "e.rule_type", F.explode(each).alias("x")).select("dataset", "event_source", "rule_type", "x.*").filter("expected_alerts is not null")


def rule_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> list[str]:
    """The texts of all rule files under a folder. A rule is a document that a person wrote; there are few."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return [r["value"] for r in rows.collect()]


def rule_blocks(markdown: str) -> list[dict]:
    """The rules in the YAML blocks of a Markdown text. A block that isn't YAML, or no rule, is passed over."""
    import yaml

    out = []
    for block in re.findall(r"^```ya?ml[^\n]*\n(.*?)^```", markdown, re.S | re.M):
        try:
            out += [doc for doc in yaml.safe_load_all(block) if isinstance(doc, dict) and "detection" in doc]
        except yaml.YAMLError:
            continue
    return out


def paired(rules: Iterable[dict]) -> list[tuple[dict, dict]]:
    """Rules for a source's own fields with their twin of the same id for typed events (``logsource.product`` is ocsf)."""
    own: dict[str, dict] = {}
    twin: dict[str, dict] = {}
    for rule in rules:
        if ident := str(rule.get("id") or "").strip():
            (twin if str((rule.get("logsource") or {}).get("product", "")).lower() == "ocsf" else own)[ident] = rule
    return [(own[i], twin[i]) for i in sorted(own.keys() & twin.keys())]


def learnt(pairs: list[tuple[dict, dict]], base: Dictionary | None = None) -> Dictionary:
    """A dictionary from pairs of rules: selections of one name and as many fields say, place by place, which path a field becomes.

    Each pair has a vote; the path with the most votes wins, for the twin's class and over all, then the one that comes first by name.
    """
    votes: dict[str, Counter] = {}
    for rule, twin in pairs:
        kind = str((twin.get("logsource") or {}).get("class", "unknown"))
        for name, doc in rule["detection"].items():
            mine, theirs = ([*places(d["detection"].get(name))] for d in (rule, twin))
            if name not in ("condition", "timeframe") and mine and len(mine) == len(theirs):
                for pair in zip(mine, theirs, strict=True):
                    votes.setdefault(kind, Counter())[pair] += 1
                    votes.setdefault("", Counter())[pair] += 1

    def table(count: Counter) -> dict[str, str]:
        return {field: min(paths)[1] for field, paths in grouped(count).items()}

    def grouped(count: Counter) -> dict[str, list[tuple[int, str]]]:
        out: dict[str, list[tuple[int, str]]] = {}
        for (field, path), n in count.items():
            out.setdefault(field, []).append((-n, path))
        return out

    base = base or Dictionary()
    return Dictionary(base.raw, base.event, {k: table(c) for k, c in votes.items() if k}, table(votes.get("", Counter())), base.colliding, base.not_subject)


def places(doc: object) -> Iterable[str]:
    """The fields of a selection in order, without modifiers."""
    for part in doc if isinstance(doc, list) else [doc]:
        if isinstance(part, dict):
            yield from (name.split("|")[0].strip() for name in part)


def aliases(rule: dict, twin: dict) -> dict[str, str]:
    """The rule's field for each field of its twin, by place, in selections of one name and as many fields."""
    out: dict[str, str] = {}
    for name, doc in twin["detection"].items():
        mine, theirs = [*places(rule["detection"].get(name))], [*places(doc)]
        if name not in ("condition", "timeframe") and len(mine) == len(theirs):
            out |= {t: m for m, t in zip(mine, theirs, strict=True) if m != t}
    return out


def drift(spark: SparkSession, twins: Iterable[dict], known: dict[str, Iterable[str]]) -> DataFrame:
    """(class_name, field, rules): fields of twins that their class doesn't have. ``known`` has the paths of each class."""
    rows = [(str((t.get("logsource") or {}).get("class", "unknown")), f) for t in twins for name, doc in t["detection"].items() if name not in ("condition", "timeframe") for f in sorted(set(places(doc)))]
    rows = [(c, f) for c, f in rows if not f.startswith("unmapped.") and f not in set(known.get(c, ()))]
    return spark.createDataFrame(rows, "class_name string, field string").groupBy("class_name", "field").agg(F.count("*").alias("rules"))
