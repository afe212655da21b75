"""Packs at work: all packs parse in one projection, and all class rules map by one expression over a small table of their specs.

A line knows the number of its pack. Stages that several packs share are one branch of a projection; a line takes the branch of its pack. What a class rule
says of an attribute is data: a row of the rules' table has its specs and the attributes that they make, and the rows of all packs go through the same
higher-order functions. So a plan's size, and the time that it takes to build, doesn't grow with rules.

A spec is where a value comes from: a text names a field, a list takes the first value that is there. A dict goes through ``when``, then ``const``,
``template`` or ``field`` with ``join``, then ``split``, ``regex``, ``map``, ``default``, ``cast`` and ``scale``; a default is neither cast nor scaled.
"""

from __future__ import annotations

import json as jsonlib
import re
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.coerce import attribute_type, coerce, to_boolean, to_integer
from emberlog.functions.network import canonical_ip
from emberlog.functions.regex import to_java
from emberlog.functions.timestamps import epoch_ms
from emberlog.operators.conditions import condition
from emberlog.operators.conditions import field as value_of
from emberlog.operators.extract import EXTRACTORS, none
from emberlog.operators.guard import too_wide

if TYPE_CHECKING:
    from emberlog.operators.packs import Pack

#: The rule number of lines with too many fields.
TOO_WIDE = -3
#: Extractors that run in Python workers: their packs' lines are parsed apart.
PYTHON = frozenset(["xml"])
VARIABLE = re.compile(r"\{([^{}]+)\}")
SPEC = "names array<string>, glue string, constant string, parts array<string>, sep string, pos int, pattern string, grp int, codes map<string,string>, pass boolean, kind string, stamp int, factor double, fallback string, cond int"
ENTRY = "path string, kind string, timed boolean, stamp int, lo int, n int"
RULES = f"pack_no int, rule_no int, class_name string, class_rule string, pack string, trust double, vendor string, product string, specs array<struct<{', '.join(c.replace(' ', ':', 1) for c in SPEC.split(', '))}>>, entries array<struct<{', '.join(c.replace(' ', ':', 1) for c in ENTRY.split(', '))}>>, activity_at int, activity_n int, severity_at int, severity_n int"
TEXTS = "cast(array() as array<string>)"


def shown(value: Any) -> str | None:
    """A constant as text."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return ",".join(map(str, value)) if isinstance(value, list) else str(value)


def alternatives(doc: Any) -> list[Any]:
    """A spec's alternatives, in order."""
    return [x for d in doc for x in alternatives(d)] if isinstance(doc, list) else [doc]


def reads_time(doc: Any) -> bool:
    """Whether a spec's values are epoch milliseconds already."""
    return all(isinstance(d, dict) and d.get("cast") == "timestamp" for d in alternatives(doc))


class Rulebook:
    """The specs of packs as data. ``stamps`` are the ways to read a time, and ``conds`` the conditions of each pack's specs, which specs name by number."""

    def __init__(self, packs: dict[int, Pack]):
        self.stamps: list[tuple[str | None, str | None]] = []
        self.conds: dict[int, list[dict]] = {i: [] for i in packs}
        self.rows = [self.rule(i, p, n) for i, p in packs.items() for n in range(len(p.doc["classes"]))]

    def stamp(self, fmt: str | None, tz: str | None) -> int:
        if (fmt, tz) not in self.stamps:
            self.stamps.append((fmt, tz))
        return self.stamps.index((fmt, tz))

    def spec(self, number: int, doc: Any, tz: str | None) -> tuple:
        doc = {"field": doc} if isinstance(doc, str) else doc
        names = doc.get("field") or []
        java, groups = to_java(doc["regex"]) if doc.get("regex") else (None, [])
        codes = {str(k).lower(): shown(v) for k, v in doc["map"].items()} if doc.get("map") else None
        split, cond = doc.get("split"), None
        if doc.get("when"):
            self.conds[number].append(doc["when"])
            cond = len(self.conds[number]) - 1
        return (
            [names] if isinstance(names, str) else names, doc.get("join", " "), shown(doc.get("const")), VARIABLE.split(doc["template"]) if "template" in doc and "const" not in doc else None,
            f"\\Q{split['sep']}\\E" if split else None, (split["index"] + 1 if split["index"] >= 0 else split["index"]) if split else None,
            java, groups.index("v") + 1 if "v" in groups else 1 if groups else 0, codes, bool(doc.get("map_default_passthrough")), doc.get("cast"),
            self.stamp(doc.get("format"), doc.get("tz", tz)) if doc.get("cast") == "timestamp" else None, float(doc["scale"]) if "scale" in doc else None, shown(doc.get("default")), cond,
        )

    def rule(self, number: int, pack: Pack, rule_no: int) -> tuple:
        doc, rule = pack.doc, pack.doc["classes"][rule_no]
        tz, specs, entries = doc.get("tz"), [], []

        def add(d: Any) -> tuple[int, int]:
            at = len(specs)
            specs.extend(self.spec(number, x, tz) for x in alternatives(d))
            return at, len(specs) - at

        for path, d in {**(doc.get("mapping") or {}), **(rule.get("mapping") or {})}.items():
            kind = attribute_type(path)
            entries.append((path, kind, kind == "timestamp" and reads_time(d), self.stamp(None, tz) if kind == "timestamp" else None, *add(d)))
        coded = [add(d) if d is not None else (0, 0) for d in (rule.get("activity_id"), rule.get("severity_id") or doc.get("severity_id"))]
        return (number, rule_no, rule["class"], rule["name"], pack.ref, float(pack.trust), doc.get("vendor"), doc.get("product"), specs, entries, *coded[0], *coded[1])


class Compiled:
    """Packs, by their numbers, as Columns that are made once and used for every batch."""

    def __init__(self, packs: dict[int, Pack]):
        self.packs, self.book = packs, Rulebook(packs)
        self._rules: tuple[SparkSession, DataFrame] | None = None
        self._made: dict[str, Any] = {}

    def once(self, name: str, make: Any) -> Any:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def by_pack(self, values: dict[int, Column], otherwise: Column) -> Column:
        out = None
        for i, c in values.items():
            out = F.when(F.col("pack_no") == i, c) if out is None else out.when(F.col("pack_no") == i, c)
        return otherwise if out is None else out.otherwise(otherwise)

    def stages(self, level: int) -> list[tuple[Column, dict]]:
        """The different stages at a place, with the test for the lines that go through them."""
        found: dict[str, list[int]] = {}
        for i, p in self.packs.items():
            if level < len(p.doc["parse"]):
                found.setdefault(jsonlib.dumps(p.doc["parse"][level], sort_keys=True), []).append(i)
        return [(F.col("pack_no").isin(numbers), jsonlib.loads(stage)) for stage, numbers in found.items()]

    def _level(self, level: int) -> list[dict[str, Column]]:
        given, got, out, used, failed = F.lit(False), F.lit(None), F.col("_got"), F.expr(TEXTS), F.lit(None).cast("string")
        chain = lambda pairs, otherwise: reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), otherwise)
        stages = self.stages(level)
        source = lambda s: value_of(F.col("fields"), s["source"]) if s.get("source") else F.col("raw")
        given = chain([(mine, F.coalesce(source(s) != "", F.lit(False)) & condition(s.get("when"), F.col("fields"))) for mine, s in stages], given)
        mine_given = lambda mine: F.col("_given") & mine
        got = F.coalesce(*[F.when(mine_given(mine), EXTRACTORS[s["type"]](F.when(mine_given(mine), source(s)) if s["type"] in PYTHON else source(s), s)) for mine, s in stages], got)
        out = chain([(mine, F.transform_keys(F.col("_got"), lambda k, v, p=s["prefix"]: F.concat(F.lit(p), k))) for mine, s in stages if s.get("prefix")], out)
        used = chain([(mine, F.array(F.lit(s["source"]))) for mine, s in stages if s.get("source")], used)
        failed = chain([(mine, F.lit(f"stage {level + 1} ({s['type']}) doesn't apply")) for mine, s in stages if s.get("required", True)], failed)
        found = F.col("_given") & F.col("_got").isNotNull()
        return [
            {"_given": given},
            {"_got": got},
            {"fields": F.map_concat("fields", F.coalesce(out, none())), "used": F.array_union("used", F.when(found, used).otherwise(F.expr(TEXTS))), "failure": F.coalesce("failure", F.when(F.col("_given") & F.col("_got").isNull(), failed))},
        ]

    def _chosen(self) -> Column:
        return self.by_pack({i: F.coalesce(*[F.when(condition(c.get("when"), F.col("fields")), F.lit(n)) for n, c in enumerate(p.doc["classes"])]) for i, p in self.packs.items()}, F.lit(None).cast("int"))

    def parsed(self, lines: DataFrame) -> DataFrame:
        """Lines (raw, pack_no) with ``fields``, ``used`` (fields that fed a stage), ``failure`` and ``rule_no``, the number of their class rule; -1 where the pack
        fails, TOO_WIDE where it finds more fields than an event may have."""
        lines = lines.withColumns({"fields": none(), "used": F.expr(TEXTS), "failure": F.lit(None).cast("string")})
        for level in range(max((len(p.doc["parse"]) for p in self.packs.values()), default=0)):
            for columns in self.once(f"level {level}", lambda level=level: self._level(level)):
                lines = lines.withColumns(columns)
        lines = lines.drop("_given", "_got").withColumn("rule_no", F.when(F.col("failure").isNull(), self.once("rule", self._chosen)))
        wide = self.once("wide", lambda: too_wide(F.col("fields")).isNotNull())
        return lines.withColumns({"failure": F.when(F.col("rule_no").isNull(), F.coalesce("failure", F.lit("no class rule matched"))), "rule_no": F.when(wide, F.lit(TOO_WIDE)).otherwise(F.coalesce("rule_no", F.lit(-1)))})

    def rules(self, spark: SparkSession) -> DataFrame:
        """The rules' table: a row for each class rule."""
        if self._rules is None or self._rules[0] is not spark:
            self._rules = spark, spark.createDataFrame(self.book.rows, RULES)
        return self._rules[1]

    def _times(self, number: Column, v: Column) -> Column:
        out = F.lit(None).cast("string")
        for i, (fmt, tz) in enumerate(self.book.stamps):
            out = F.when(number == i, epoch_ms(v, fmt, tz, F.col("_now")).cast("string")).otherwise(out)
        return out

    def _cast(self, s: Column, v: Column) -> Column:
        """A spec's value after ``cast``."""
        kind = s["kind"]
        done = F.when(kind.isNull(), v).when(kind == "int", to_integer(v).cast("string")).when(kind == "float", v.try_cast("double").cast("string")).when(kind == "bool", to_boolean(v).cast("string"))
        return done.when(kind == "ip", canonical_ip(v)).when(kind == "timestamp", self._times(s["stamp"], v)).when(kind == "lower", F.lower(v)).when(kind == "upper", F.upper(v)).otherwise(v)

    def _typed(self, x: Column) -> Column:
        """struct(p, r, v, t): an attribute's value in its type."""
        v, kind = x["r"]["v"], x["e"]["kind"]
        out = F.when(x["e"]["timed"], v).when(kind == "timestamp", self._times(x["e"]["stamp"], v))
        for k in ("integer", "boolean", "ip"):
            out = out.when(kind == k, coerce(v, k))
        return F.struct(x["e"]["path"].alias("p"), kind.alias("k"), x["r"].alias("r"), out.otherwise(v).alias("v"), (kind == "timestamp").alias("t"))

    def _values(self) -> list[dict[str, Column]]:
        """Columns worked out one after the other: the results of all specs of a row, then its attributes.

        Most specs of a rule find nothing in a line. Only values go from step to step, each beside its spec, and what isn't there is left out at once:
        such functions are interpreted and copy what they make, so a spec that went along would cost more than all its steps.
        """
        look = "try_element_at(fields_{}, {})".format
        conds = {i: F.array(*[condition(c, F.col("fields")) for c in found]) for i, found in self.book.conds.items() if found}
        first = f"""CASE WHEN s.constant IS NOT NULL THEN s.constant
               WHEN s.parts IS NOT NULL THEN IF(size(filter(s.parts, (p, i) -> i % 2 = 1 AND {look('filled', 'p')} IS NULL)) > 0, NULL, array_join(transform(s.parts, (p, i) -> IF(i % 2 = 1, {look('filled', 'p')}, p)), ''))
               WHEN size(s.names) = 1 THEN {look('present', 's.names[0]')}
               WHEN size(s.names) > 1 AND NOT exists(s.names, n -> {look('present', 'n')} IS NULL) THEN array_join(transform(s.names, n -> {look('present', 'n')}), s.glue) END"""
        source = f"""CASE WHEN s.constant IS NOT NULL THEN {TEXTS}
                 WHEN s.parts IS NOT NULL THEN filter(s.parts, (p, i) -> i % 2 = 1 AND {look('filled', 'p')} IS NOT NULL)
                 WHEN exists(s.names, n -> {look('present', 'n')} IS NULL) THEN {TEXTS} ELSE s.names END"""
        cut = "IF(s.sep IS NULL, v, try_element_at(split(v, s.sep), s.pos))"
        found = f"CASE WHEN s.pattern IS NULL THEN {cut} WHEN {cut} RLIKE s.pattern THEN regexp_extract({cut}, s.pattern, s.grp) END"
        coded = f"CASE WHEN s.codes IS NULL THEN {found} WHEN {found} IS NOT NULL AND map_contains_key(s.codes, coalesce(lower({found}), '')) THEN try_element_at(s.codes, lower({found})) WHEN s.pass THEN {found} END"
        scaled = "try_cast(try_cast(get(_d, i) AS double) * s.factor AS bigint)"
        finished = f"""transform(specs, (s, i) -> CASE WHEN s.cond IS NOT NULL AND NOT coalesce(get(_conds, s.cond), false) THEN NULL
          WHEN get(_v, i) <> '' THEN named_struct('v', IF(s.factor IS NULL, get(_d, i), cast({scaled} AS string)), 'src', IF(s.constant IS NOT NULL, array('const'), {source}),
            'e', coalesce(IF(s.kind IS NOT NULL AND get(_d, i) IS NULL, concat('not a valid ', s.kind, ': ', get(_v, i)), NULL), IF(s.factor IS NOT NULL AND {scaled} IS NULL, concat('not a number: ', get(_v, i)), NULL)))
          WHEN s.fallback IS NOT NULL THEN named_struct('v', s.fallback, 'src', IF(size({source}) > 0, {source}, array('default')), 'e', cast(NULL AS string)) END)"""
        # slice() reads the whole array
        pick = lambda at, n: f"CASE WHEN {n} = 1 THEN get(_r, {at}) WHEN {n} > 1 THEN get(filter(transform(sequence({at}, {at} + {n} - 1), k -> get(_r, k)), r -> coalesce(r.v <> '', false) OR r.e IS NOT NULL), 0) END"
        return [
            {"_conds": self.by_pack(conds, F.expr("cast(array() as array<boolean>)")), "_v": F.expr(f"zip_with(specs, transform(specs, s -> {first}), (s, v) -> IF(v IS NULL, NULL, {coded}))")},
            {"_d": F.zip_with("specs", "_v", lambda s, v: F.when(v != "", self._cast(s, v)))},
            {"_r": F.expr(finished)},
            {"_e": F.expr(f"filter(transform(entries, e -> IF(e.n = 1 AND get(_r, e.lo) IS NULL, NULL, named_struct('e', e, 'r', {pick('e.lo', 'e.n')}))), x -> x.r IS NOT NULL)"), "_activity": F.expr(pick("activity_at", "activity_n")), "_severity": F.expr(pick("severity_at", "severity_n"))},
            {"_e": F.transform("_e", self._typed)},
            {"_e": F.expr("filter(transform(_e, x -> named_struct('p', x.p, 'v', x.v, 'src', x.r.src, 'e', coalesce(x.r.e, IF(x.r.v IS NOT NULL AND x.v IS NULL, concat('cannot be ', x.k, ': ', x.r.v), NULL)), 't', x.t)), x -> x.v IS NOT NULL OR x.e IS NOT NULL)")},
            {"_good": F.expr("filter(_e, x -> x.e IS NULL)")},
            {
                "attrs": F.expr("map_from_entries(transform(_good, x -> struct(x.p, x.v)))"),
                "lineage": F.expr("map_concat(map_from_entries(transform(_good, x -> struct(x.p, x.src))), map_filter(map('activity_id', _activity.src, 'severity_id', _severity.src), (k, v) -> v IS NOT NULL))"),
                "consumed": F.expr("array_union(used, transform(filter(_good, x -> size(x.src) = 1 AND (x.t OR coalesce(lower(trim(try_element_at(fields, get(x.src, 0)))) = lower(trim(x.v)), false))), x -> get(x.src, 0)))"),
                "errors": F.expr("transform(filter(_e, x -> x.e IS NOT NULL), x -> concat(x.p, ': ', x.e))"),
                "activity_id": F.expr("coalesce(try_cast(try_cast(_activity.v AS double) AS int), 0)"), "severity_id": F.expr("coalesce(try_cast(try_cast(_severity.v AS double) AS int), 1)"),
            },
        ]

    def mapped(self, rows: DataFrame, now: Column) -> DataFrame:
        """Events of parsed rows (pack_no, rule_no, fields, used). ``now`` is the clock for stamps without a year. The rules' table is as large as the packs: it is broadcast."""
        rows = rows.join(F.broadcast(self.rules(rows.sparkSession)), ["pack_no", "rule_no"])
        filled = F.map_filter("fields", lambda k, v: v.isNotNull() & (v != ""))
        rows = rows.withColumns({"_now": now, "fields_filled": filled}).withColumn("fields_present", F.map_filter("fields_filled", lambda k, v: v != "-"))
        for columns in self.once("values", self._values):
            rows = rows.withColumns(columns)
        return rows.drop("_v", "_d", "_r", "_e", "_good", "_conds", "_now", "_activity", "_severity", "fields_filled", "fields_present", "specs", "entries", "activity_at", "activity_n", "severity_at", "severity_n", "used", "failure", "rule_no", "pack_no")
