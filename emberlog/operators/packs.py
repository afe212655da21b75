"""Packs: declarative parsers, checked and put in order. ``mapping`` runs them."""

from __future__ import annotations

import hashlib
import json as jsonlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, cached_property, reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.regex import search, to_java
from emberlog.operators import envelope
from emberlog.operators.extract import EXTRACTORS
from emberlog.operators.mapping import PYTHON, Compiled

KEYS = {"id", "version", "vendor", "product", "category", "description", "priority", "match", "parse", "mapping", "severity_id", "classes", "tz", "sources", "trust", "provenance", "tests"}
SPEC_KEYS = {"field", "const", "template", "join", "split", "regex", "map", "map_default_passthrough", "default", "cast", "format", "tz", "scale", "when"}
CASTS = {"int", "float", "str", "bool", "ip", "timestamp", "lower", "upper", "auto"}


class PackError(ValueError):
    """A pack document that isn't valid."""


def check_spec(where: str, doc: Any) -> None:
    if isinstance(doc, list):
        for d in doc:
            check_spec(where, d)
    elif isinstance(doc, dict):
        if extra := set(doc) - SPEC_KEYS:
            raise PackError(f"{where}: unknown {sorted(extra)}")
        if doc.get("cast") and doc["cast"] not in CASTS:
            raise PackError(f"{where}: unknown cast {doc['cast']}")
        if doc.get("regex"):
            to_java(doc["regex"])
    elif not isinstance(doc, str):
        raise PackError(f"{where}: a spec is a text, a list or a mapping")


def check_pack(doc: dict) -> None:
    """Raises PackError unless the document is a valid pack: known keys, stages, casts, patterns and classes."""
    if extra := set(doc) - KEYS:
        raise PackError(f"unknown keys {sorted(extra)}")
    if missing := {"id", "parse", "classes"} - set(doc):
        raise PackError(f"missing keys {sorted(missing)}")
    if not doc["parse"] or not doc["classes"]:
        raise PackError("a pack needs a stage and a class rule")
    for stage in doc["parse"]:
        if stage.get("type") not in EXTRACTORS:
            raise PackError(f"unknown stage {stage.get('type')}")
    for c in doc["classes"]:
        if c["class"] not in envelope.CLASSES:
            raise PackError(f"unknown class {c['class']}")
        for path, d in (c.get("mapping") or {}).items():
            check_spec(path, d)
    for path, d in (doc.get("mapping") or {}).items():
        check_spec(path, d)


@dataclass
class Pack:
    """A checked pack. ``trust`` is the confidence of its events; it is lower for packs that nobody has approved."""

    doc: dict
    trust: float = 1.0
    signed: bool = False
    ref: str = field(init=False)

    def __post_init__(self):
        check_pack(self.doc)
        self.ref = f"{self.doc['id']}@{self.doc.get('version', '1.0')}"

    @property
    def priority(self) -> int:
        return self.doc.get("priority", 0)

    def matches(self, raw: Column, tags: Column, hint: Column) -> Column:
        """Whether the pack takes a line: by its source, or by formats, then texts, then the pattern."""
        m = self.doc.get("match") or {}
        tests = []
        if m.get("formats"):
            tests.append(F.arrays_overlap(tags, F.array(*map(F.lit, m["formats"]))))
        tests += [raw.contains(s) for s in m.get("contains", [])]
        if m.get("any_contains"):
            tests.append(reduce(lambda a, b: a | b, [raw.contains(s) for s in m["any_contains"]]))
        if m.get("regex"):
            tests.append(search(raw, m["regex"]))
        sources = m.get("sources") or self.doc.get("sources")
        by_look = reduce(lambda a, b: a & b, tests) if tests else F.lit(not sources)
        return F.coalesce(hint.isin(list(sources)), F.lit(False)) | by_look if sources else by_look


def digest(doc: dict) -> str:
    """A pack's digest, which its signature signs."""
    return hashlib.sha256(jsonlib.dumps(doc, sort_keys=True).encode()).hexdigest()


class Registry:
    """The packs in use, the highest priority first; equal ones in the order of their ids.

    With ``verify`` (of a digest and a signature, such as ``ledger.Signer.verify``), packs whose signature in ``signatures`` holds
    are signed; others are used with less trust, or not at all where signatures are ``required``.
    """

    def __init__(self, docs: list[dict], approved: bool = True, signatures: dict[str, bytes] | None = None, verify: Callable[[str, bytes], bool] | None = None, required: bool = False):
        self.packs, self.refused = [], []
        for doc in docs:
            given = (signatures or {}).get(doc.get("id"))
            signed = bool(verify and given and verify(digest(doc), given))
            if required and not signed:
                self.refused.append(doc.get("id"))
            else:
                self.packs.append(Pack(doc, 1.0 if signed or approved and not verify else 0.7, signed))
        self.packs.sort(key=lambda p: (-p.priority, p.doc["id"]))

    @cached_property
    def compiled(self) -> tuple[Compiled, Compiled, Compiled]:
        """All packs, those that parse by built-in functions alone, and those that need Python workers."""
        all_of = dict(enumerate(self.packs))
        slow = {i for i, p in all_of.items() if any(s["type"] in PYTHON for s in p.doc["parse"])}
        return Compiled(all_of), Compiled({i: p for i, p in all_of.items() if i not in slow}), Compiled({i: p for i, p in all_of.items() if i in slow})

    @staticmethod
    @cache
    def of(docs: Callable[[], list[dict]]) -> Registry:
        """The registry of the packs that a function returns, compiled once."""
        return Registry(docs())

    @cached_property
    def routes(self) -> Column:
        """The candidates of a line (raw, sniffed, source)."""
        return self.candidates(F.col("raw"), F.col("sniffed.tags"), F.try_element_at("source", F.lit("source_hint")))

    @staticmethod
    def from_folder(path: str) -> Registry:
        """Packs from YAML or JSON files of a folder on the driver; a file of over 1 MB is refused."""
        import yaml

        docs = []
        for file in sorted(Path(path).rglob("*")):
            if file.suffix in (".yaml", ".yml", ".json"):
                if file.stat().st_size > 1_000_000:
                    raise PackError(f"{file} is too large")
                docs.append(jsonlib.loads(file.read_text()) if file.suffix == ".json" else yaml.safe_load(file.read_text()))
        return Registry(docs)

    def listed(self) -> list[dict]:
        """What is in use: id, version, vendor, product, priority, trust and a digest of each pack."""
        return [{"id": p.doc["id"], "version": p.doc.get("version"), "vendor": p.doc.get("vendor"), "product": p.doc.get("product"), "priority": p.priority, "trust": p.trust, "signed": p.signed, "sha256": digest(p.doc)} for p in self.packs]

    def candidates(self, raw: Column, tags: Column, hint: Column) -> Column:
        """Numbers of the packs that take a line, in the order in which they are tried. A line that a source pins goes to its packs alone."""
        found = F.filter(F.array(*[F.when(p.matches(raw, tags, hint), F.lit(i)) for i, p in enumerate(self.packs)]), lambda x: x.isNotNull())
        pinned = [i for i, p in enumerate(self.packs) if (p.doc.get("match") or {}).get("sources") or p.doc.get("sources")]
        if not pinned:
            return found
        mine = F.filter(F.array(*[F.when(hint.isin(list((self.packs[i].doc.get("match") or {}).get("sources") or self.packs[i].doc["sources"])), F.lit(i)) for i in pinned]), lambda x: x.isNotNull())
        return F.when(F.size(mine) > 0, mine).otherwise(found)
