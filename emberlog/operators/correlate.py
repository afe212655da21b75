"""Correlation over lanes: thresholds and stage sequences, folded in time order with a state of bounded size.

Hits of a lane that are further apart than the rule's window can't belong to one alert. Lanes are cut there into runs, the runs are dealt
out and sorted by Spark, and each task folds its rows one after another, so neither a hot lane nor a long run is ever held whole. A run, however
long, is one task's: a lane that never rests for the length of a window is not divided. Many rules are folded in one pass: a hit names its rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.automata import Automaton, Combined, Flag, Hit, Same, Sequence, Step, Threshold

NO_VALUES = "cast(array() as array<array<string>>)"


def runs(hits: DataFrame, window_ms: int | Column, keys: tuple[str, ...] = ("lane",)) -> DataFrame:
    """``hits`` with ``run``, which rises within the keys wherever two hits in a row are further apart than the window; without one (null), there is one run.

    Hits of one stretch of the window's length never are, so only the stretches' first and last hits, one row for each
    lane and stretch, are put in order; a hot lane's rows are not.
    """
    window = F.lit(window_ms) if isinstance(window_ms, int) else window_ms
    hits = hits.withColumn("_window", window.cast("long")).withColumn("stretch", F.coalesce(F.floor(F.col("at_ms") / F.col("_window")), F.lit(0)))
    ends = hits.groupBy(*keys, "stretch", "_window").agg(F.min("at_ms").alias("low"), F.max("at_ms").alias("high"))
    in_time = Window.partitionBy(*keys).orderBy("stretch")
    ends = ends.withColumn("apart", F.coalesce((F.col("low") - F.lag("high").over(in_time) > F.col("_window")).cast("int"), F.lit(0)))
    ends = ends.withColumn("run", F.sum("apart").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    return hits.join(ends.select(*keys, "stretch", "run"), [*keys, "stretch"]).drop("stretch", "_window")


def folded(hits: DataFrame, automata: dict[str, Automaton], keys: tuple[str, ...] = ("lane",), order: tuple[str, ...] = ()) -> DataFrame:
    """Alerts (keys, rule, at_ms) of hits (keys as text, rule, at_ms, flags, values, and ``order``, which settles equal times).

    Hits of rules that aren't in ``automata`` are left out.
    """
    windows = {name: a.window_ms for name, a in automata.items()}
    table = F.create_map(*[x for name, w in windows.items() for x in (F.lit(name), F.lit(w).cast("long"))]) if windows else F.expr("map('', 0L)")
    by = [*keys, "rule"]
    rows = runs(hits.filter(F.col("rule").isin(list(automata))), F.try_element_at(table, F.col("rule")), tuple(by))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            named = zip(*(pdf[c].tolist() for c in (*by, "run")), strict=True)
            for key, at_ms, flags, values in zip(named, pdf["at_ms"].tolist(), pdf["flags"], pdf["values"], strict=True):
                if key != now:
                    now, state = key, None
                state, fires = automata[key[-2]].step(state, Hit(at_ms, flags, values))
                if fires:
                    out.append((*key[:-1], at_ms))
            yield pd.DataFrame(out, columns=[*by, "at_ms"]).astype({"at_ms": "int64"})

    rows = rows.repartition(*by, "run").sortWithinPartitions(*by, "run", "at_ms", *order)
    return rows.select(*by, "run", "at_ms", "flags", "values").mapInPandas(fold, ", ".join(f"{k} string" for k in by) + ", at_ms long")


def texts(value: Column, many: bool) -> Column:
    """A field's values as texts, without nulls."""
    return F.array_compact(F.coalesce(value.cast("array<string>") if many else F.array(value.cast("string")), F.expr("cast(array() as array<string>)")))


def _values(df: DataFrame, name: str) -> Column:
    return texts(F.col(name), df.schema[name].dataType.typeName() == "array")


@dataclass(frozen=True)
class Stage:
    """One step: how many hits it takes, the longest wait for it, and fields that must share a value with those of an earlier step's last hit."""

    least: int = 1
    within_ms: int | None = None
    same: tuple[tuple[str, int, str], ...] = field(default_factory=tuple)


def _one(hits: DataFrame, automaton: Automaton, order: tuple[str, ...]) -> DataFrame:
    return folded(hits.withColumn("rule", F.lit("")), {"": automaton}, order=order).select("lane", "at_ms")


def threshold(hits: DataFrame, lane: str, at_ms: str, least: int, window_ms: int | None, value: str | None = None, distinct: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """Alerts (lane, at_ms) of a threshold over the rows that a rule's predicate let through. Rows without a lane or time are no hits.

    ``value`` is a text or an array of texts, of which an alert needs ``distinct`` different ones; ``order`` settles equal times.
    """
    values = F.array(_values(hits, value)) if value else F.expr(NO_VALUES)
    rows = hits.select(F.col(lane).cast("string").alias("lane"), F.col(at_ms).cast("long").alias("at_ms"), F.array(F.lit(True)).alias("flags"), values.alias("values"), *order)
    return _one(rows.dropna(subset=["lane", "at_ms"]), Threshold(max(least, 1), window_ms, distinct if value else 0), (*order, "values"))


def sequence(events: DataFrame, lane: str, at_ms: str, fits: list, stages: list[Stage], window_ms: int | None = None, gap_ms: int | None = None, fields: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Alerts (lane, at_ms) of a sequence. ``fits`` has a boolean Column for each stage; rows that fit none are left out before
    the shuffle. ``fields`` are the columns that stages compare; ``order`` the columns that settle equal times."""
    flags = F.array(*[F.coalesce(c, F.lit(False)) for c in fits])
    values = F.array(*[_values(events, f) for f in fields]) if fields else F.expr(NO_VALUES)
    rows = events.select(F.col(lane).cast("string").alias("lane"), F.col(at_ms).cast("long").alias("at_ms"), flags.alias("flags"), values.alias("values"), *order)
    rows = rows.filter(F.exists("flags", lambda x: x)).dropna(subset=["lane", "at_ms"])
    at = {f: i for i, f in enumerate(fields)}
    steps = tuple(Step(Combined((Flag(i), *[Same(at[mine], n, at[theirs]) for mine, n, theirs in s.same])), s.least, s.within_ms) for i, s in enumerate(stages))
    return _one(rows, Sequence(steps, window_ms, gap_ms), order)
