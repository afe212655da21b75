"""Views of an event that rules read: the source's own fields, and the typed event, where each lookup says how it was answered.

``native``: the name is a path of the event. ``alias``: a dictionary translates it to one. ``unmapped`` and ``lineage``, for the
whole envelope only: the value was kept aside, or the lineage knows where it went. ``lost``: only the source's fields have it.
``absent``: nobody has. For each name the candidates are known before the data, so that a lookup is one Column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import snake
from emberlog.functions.timestamps import epoch_ms
from emberlog.operators import correlate, rules, stage_rules
from emberlog.sources.shared import staged

KINDS = ("native", "alias", "unmapped", "lineage", "lost", "absent")
TEXTS = "cast(array() as array<string>)"


@dataclass(frozen=True)
class Candidate:
    """Where a value may be: a path, what is done with it, and the table of a ``map``."""

    path: str
    change: str = ""
    table: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Dictionary:
    """Translations of rule fields. ``raw`` and ``event`` have candidates for the two views; ``by_class`` and ``everywhere`` one path
    for a name, of one class or of all; ``colliding`` names mean something else as paths; ``not_subject`` are path prefixes that a
    class doesn't use for its own subject."""

    raw: dict[str, list[Candidate]] = field(default_factory=dict)
    event: dict[str, list[Candidate]] = field(default_factory=dict)
    by_class: dict[str, dict[str, str]] = field(default_factory=dict)
    everywhere: dict[str, str] = field(default_factory=dict)
    colliding: frozenset[str] = frozenset()
    not_subject: dict[str, str] = field(default_factory=dict)

    def of(self, name: str, class_name: str | None) -> list[Candidate]:
        """The candidates of a name for events of a class (None: any other)."""
        out = list(self.event.get(name, []))
        path = self.by_class.get(class_name or "", {}).get(name) or self.everywhere.get(name)
        if path and path != name and not path.startswith("unmapped."):
            out += [Candidate(path), *self.event.get(path, [])]
        prefix = self.not_subject.get(class_name or "")
        return [c for c in out if not (prefix and c.path.startswith(prefix))]


def changed(values: Column, candidate: Candidate) -> Column:
    """The values after a candidate's change: last part of a path, file extension, hexadecimal form, or a table's entry."""
    if candidate.change == "basename":
        return F.transform(values, lambda v: F.regexp_extract(F.regexp_replace(v, r"[\\/]+$", ""), r"([^\\/]*)$", 1))
    if candidate.change == "ext":
        return F.filter(F.transform(values, lambda v: F.regexp_extract(v, r"\.([^.\\/]*)$", 1)), lambda v: v != "")
    if candidate.change == "hex":
        return F.array_compact(F.transform(values, lambda v: F.concat(F.lit("0x"), F.hex(v.try_cast("bigint")))))
    if candidate.change == "map":
        table = F.create_map(*[F.lit(x) for pair in candidate.table for x in pair])
        return F.array_compact(F.transform(values, lambda v: F.try_element_at(table, v)))
    if candidate.change:
        raise ValueError(f"unknown change {candidate.change!r}")
    return values


def listed(value: Column) -> Column:
    """A map's value as a list of none or one."""
    return F.filter(F.array(value), lambda v: v != "")


def first_of(found: list[Column], otherwise: Column) -> Column:
    """The first list that isn't empty; ``found`` are structs of kind and values, each worked out once and only if those before it are empty."""
    return F.coalesce(*[F.get(F.filter(F.array(one), lambda x: F.size(x["values"]) > 0), F.lit(0)) for one in found], otherwise)


def answer(kind: str, values: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), values.alias("values"))


class RawView:
    """The source's fields: names fit without regard to case and underscores, then by the dictionary.

    ``keys`` is a column that holds ``spelt_alike``, for who looks up many names.
    """

    def __init__(self, fields: str = "fields", dictionary: Dictionary | None = None, keys: str | None = None):
        self.fields, self.dictionary, self.keys = fields, dictionary or Dictionary(), keys

    def spelt_alike(self) -> Column:
        """The fields' names without case and underscores."""
        return F.transform(F.map_keys(self.fields), lambda k: F.replace(F.lower(k), F.lit("_"), F.lit("")))

    def direct(self, name: str) -> Column:
        at = F.array_position(F.col(self.keys) if self.keys else self.spelt_alike(), name.lower().replace("_", ""))
        return listed(F.coalesce(F.try_element_at(self.fields, F.lit(name)), F.get(F.map_values(self.fields), at.cast("int") - 1)))

    def get(self, name: str) -> Column:
        """All values of a name."""
        found = [answer("raw", self.direct(name)), *[answer("raw", changed(self.direct(c.path), c)) for c in self.dictionary.raw.get(name, [])]]
        return first_of(found, answer("raw", F.expr(TEXTS)))["values"]


class EventView:
    """The typed event: its attributes by path, and with ``whole`` also what the envelope kept aside.

    Columns: attrs, unmapped and fields (maps of text), lineage (path to the names of its source fields) and class_name.
    ``classes`` are those for which the dictionary has paths of their own.
    """

    def __init__(self, dictionary: Dictionary, whole: bool = True, raw: RawView | None = None):
        self.dictionary, self.whole, self.raw = dictionary, whole, raw or RawView(dictionary=dictionary)

    def path(self, path: str) -> Column:
        return listed(F.try_element_at("attrs", F.lit(path)))

    def translated(self, name: str) -> Column:
        """The first value that the dictionary finds, for the event's class."""
        none = answer("alias", F.expr(TEXTS))
        of = lambda c: first_of([answer("alias", changed(self.path(x.path), x)) for x in self.dictionary.of(name, c)], none)
        out = of(None)
        for c in sorted({*self.dictionary.by_class, *self.dictionary.not_subject}):
            if self.dictionary.of(name, c) != self.dictionary.of(name, None):
                out = F.when(F.col("class_name") == c, of(c)).otherwise(out)
        return out

    def found(self, name: str) -> list[Column]:
        """struct(kind, values) of a name from each place that may hold it, in turn."""
        aside = name.startswith("unmapped.")
        plain = name.removeprefix("unmapped.")
        found = []
        if not aside and name not in self.dictionary.colliding:
            found.append(answer("native", self.path(name)))
        found += [self.translated(n) for n in dict.fromkeys([name, plain])]
        if self.whole:
            keys = [F.lit(plain), snake(F.lit(plain))] if aside else [snake(F.lit(plain)), F.lit(plain)]
            found += [answer("unmapped", listed(F.try_element_at("unmapped", k))) for k in keys]
            forms = F.array(F.lit(plain.lower()), F.lit(plain.replace("_", "").lower()))
            known = F.map_keys(F.map_filter("lineage", lambda path, of: F.exists(of, lambda f: F.array_contains(forms, F.lower(f)))))
            values = F.array_compact(F.transform(known, lambda p: F.try_element_at("attrs", p)))
            longest = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
            found.append(answer("lineage", F.slice(longest, 1, 1)))
        return found

    def values(self, name: str) -> Column:
        """All values of a name."""
        return first_of(self.found(name), answer("absent", F.expr(TEXTS)))["values"]

    def lookup(self, name: str) -> Column:
        """struct(kind, values) of a name."""
        lost = F.size(self.raw.get(name.removeprefix("unmapped."))) > 0
        return first_of(self.found(name), F.struct(F.when(lost, F.lit("lost")).otherwise(F.lit("absent")).alias("kind"), F.expr(TEXTS).alias("values")))


def attribution(events: DataFrame, names: list[str], view: EventView) -> DataFrame:
    """(name, kind, n): how the lookups of each name were answered, over all events. One pass, one small shuffle."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), view.lookup(n)["kind"].alias("kind")) for n in names])
    return events.select(F.explode(each).alias("x")).groupBy("x.name", "x.kind").agg(F.count("*").alias("n"))


def fields_of(rule: dict) -> list[str]:
    """The fields that a rule's selections name."""
    out: list[str] = []

    def walk(doc: object) -> None:
        if isinstance(doc, dict):
            out.extend(name.split("|")[0] for name in doc)
        elif isinstance(doc, list):
            for d in doc:
                walk(d)

    for key, doc in rule["detection"].items():
        if key not in ("condition", "timeframe"):
            walk(doc)
    return sorted(set(out))


def verdicts(events: DataFrame, docs: dict[str, dict], dictionary: Dictionary, case: str = "case_id") -> DataFrame:
    """(case, rule, raw, native, whole): whether any event of a case sets off a rule, as each view sees it.

    ``events`` has the columns that ``EventView`` reads. All rules and views are flags of one pass; a case's flags are
    combined before the shuffle. A field of several values counts by its first.
    """
    names = sorted({n for doc in docs.values() for n in fields_of(doc)})
    raw = RawView(dictionary=dictionary)
    views = {"raw": raw.get, "native": EventView(dictionary, False, raw).values, "whole": EventView(dictionary, True, raw).values}
    for v, get in views.items():
        events = events.withColumn(f"_{v}", F.struct(*[F.get(get(n), F.lit(0)).alias(n) for n in names]) if names else F.lit(None))
        events = rules.matched(events, docs, {n: F.col(f"_{v}")[n] for n in names}).withColumnRenamed("alerts", f"_hits_{v}")
    each = F.array(*[F.struct(F.lit(r).alias("rule"), *[F.array_contains(f"_hits_{v}", r).alias(v) for v in views]) for r in sorted(docs)])
    flags = events.select(case, F.explode(each).alias("x")).select(case, "x.*")
    return flags.groupBy(case, "rule").agg(*[F.bool_or(v).alias(v) for v in views])


# Fields that name a source's host, in turn, and those that hold its time.
HOSTS = ["hostname", "System.Computer", "agent_ip"]
TIMES = ["timestamp", "time", "System.TimeCreated.SystemTime", "UtcTime", "@timestamp", "ts"]


def lanes_and_time(events: DataFrame, raw: RawView, time_col: str = "time") -> DataFrame:
    """Adds lane_raw and lane_event, the host as the source's fields and as the typed event name it (in lower case; "_" if neither does), and
    at_ms: the first of the source's times that can be read, else the event's."""
    first = lambda names: F.array_compact(F.array(*[F.nullif(F.get(raw.get(n), F.lit(0)), F.lit("")) for n in names]))
    hosts = [F.nullif(F.try_element_at("attrs", F.lit(p)), F.lit("")) for p in ("device.hostname", "device.ip")]
    return events.withColumns(
        {
            "lane_raw": F.lower(F.coalesce(F.get(first(HOSTS), F.lit(0)), F.lit("_"))),
            "lane_event": F.lower(F.coalesce(*hosts, F.lit("_"))),
            "at_ms": F.coalesce(F.get(F.array_compact(F.transform(first(TIMES), lambda v: epoch_ms(v))), F.lit(0)), F.col(time_col).cast("long"), F.lit(0)),
        }
    )


def stage_verdicts(events: DataFrame, docs: dict[str, dict], dictionary: Dictionary, case: str = "case_id", time_col: str = "time", source: Column | None = None, kinds: dict[str, str] | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """(case, rule, raw, native, whole) of stage rules: whether a case's events set off a rule, as each view sees them, where any does.

    ``events`` has the columns that ``EventView`` reads, and the event's time. The source's view has lanes of its own; all views go by one time.
    Hits of all rules and views are folded in one pass, by case, lane and rule; ``order`` settles equal times. ``kinds`` are types that datasets state for rules.
    """
    raw = RawView(dictionary=dictionary, keys="_keys")
    events = events.withColumn("_keys", raw.spelt_alike())
    looks = {"raw": raw.get, "native": EventView(dictionary, False, raw).values, "whole": EventView(dictionary, True, raw).values}
    asking = stage_rules.Looked()
    for doc in docs.values():
        stage_rules.compiled(doc, asking)
    names = {name: f"f{i}" for i, name in enumerate(sorted(asking.asked))}
    events = lanes_and_time(events, raw, time_col)
    # each name is looked up once for a view, whatever many conditions ask for it: a column for each, as the optimizer would look up a struct's fields anew for every use
    events = events.withColumns({f"_{view}_{at}": stage_rules.low(get(name)) for view, get in looks.items() for name, at in names.items()})
    seen_by = lambda view: stage_rules.Looked(lambda name: F.col(f"_{view}_{names[name]}"), ready=True)
    rules = {f"{view}:{name}": stage_rules.compiled(doc, seen_by(view), source, (kinds or {}).get(name)) for view in looks for name, doc in docs.items()}
    keys = {"_case": F.col(case), "lane": lambda name: F.col("lane_raw" if name.startswith("raw:") else "lane_event")}
    found = staged(stage_rules.hits(events, rules, keys, "at_ms", order))  # what is read twice is looked up once
    alerts = correlate.folded(found, {name: r.automaton for name, r in rules.items()}, ("_case", "lane"), order)
    seen = alerts.select("_case", F.regexp_extract("rule", "^[a-z]+:(.*)$", 1).alias("rule"), F.substring_index("rule", ":", 1).alias("view"))
    flags = seen.groupBy("_case", "rule").agg(*[F.bool_or(F.col("view") == v).alias(v) for v in looks])
    return flags.select(F.col("_case").cast(events.schema[case].dataType).alias(case), "rule", *looks)


def report(found: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """One row for each view (native, whole): cases, kept (verdict as on the source's fields), correct, detected and silent of those
    expected so, lost and false alerts. ``cases`` has case, rule and expected."""
    rows = cases.join(found, [case, "rule"], "left").select("expected", *[F.coalesce(v, F.lit(False)).alias(v) for v in ("raw", "native", "whole")])
    each = F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("verdict")) for v in ("native", "whole")])
    rows = rows.select("expected", "raw", F.explode(each).alias("x")).select("expected", "raw", "x.view", "x.verdict")
    verdict, count = F.col("verdict"), lambda c: F.count_if(c)
    return rows.groupBy("view").agg(
        F.count("*").alias("cases"), count(verdict == F.col("raw")).alias("kept"), count(F.col("raw") == F.col("expected")).alias("oracle_correct"), count(verdict == F.col("expected")).alias("correct"),
        count(verdict & F.col("expected")).alias("detected"), count(~verdict & ~F.col("expected")).alias("silent"), count(F.col("raw") & ~verdict).alias("lost"), count(~F.col("raw") & verdict).alias("false_alerts"),
    )
