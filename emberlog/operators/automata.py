"""What thresholds and sequences do with one hit: pure steps from a state to the next, shared by batches and streams.

A state is None (nothing is open) or a tuple of plain values. ``until`` is the last moment at which a state can still lead to an alert;
whoever keeps states may forget one after it. No state outgrows its rule: a sequence holds a mark for each finished step, a threshold
as many times and values as it wants.
"""

from __future__ import annotations

from collections.abc import Sequence as Items
from dataclasses import dataclass
from typing import NamedTuple


class Hit(NamedTuple):
    """An event that may matter to a rule: the outcomes of the tests that need no other event, and the fields that are compared."""

    at_ms: int
    flags: Items[bool]
    values: Items[Items[str]]


class Mark(NamedTuple):
    """The hit that finished a step."""

    at_ms: int
    values: Items[Items[str]]


@dataclass(frozen=True)
class Flag:
    """A test whose outcome came with the hit."""

    at: int

    def holds(self, hit: Hit, done: Items[Mark]) -> bool:
        return bool(hit.flags[self.at])


@dataclass(frozen=True)
class Same:
    """Whether a field shares a value with a field of the hit that finished an earlier step; false while that is open."""

    mine: int
    step: int
    theirs: int

    def holds(self, hit: Hit, done: Items[Mark]) -> bool:
        return 0 <= self.step < len(done) and not set(hit.values[self.mine]).isdisjoint(done[self.step][1][self.theirs])


@dataclass(frozen=True)
class Combined:
    """Tests under AND or OR."""

    parts: tuple[Flag | Same | Combined, ...]
    every: bool = True

    def holds(self, hit: Hit, done: Items[Mark]) -> bool:
        return (all if self.every else any)(p.holds(hit, done) for p in self.parts)


@dataclass(frozen=True)
class Step:
    """One step of a sequence: its test, how many hits it takes, and the longest wait for it since the step before."""

    test: Flag | Same | Combined
    least: int = 1
    within_ms: int | None = None


@dataclass(frozen=True)
class Sequence:
    """Steps in order, one open match at a time. State: (time of its first hit, marks of finished steps, hits of the open one)."""

    steps: tuple[Step, ...]
    window_ms: int | None = None
    gap_ms: int | None = None

    def until(self, state: tuple | None) -> int | None:
        """The open match's last moment: of the window from its first hit, and of the wait from the last finished step."""
        if state is None:
            return None
        began, done, _ = state
        wait = self.steps[len(done)].within_ms or self.gap_ms
        ends = ([began + self.window_ms] if self.window_ms else []) + ([done[-1][0] + wait] if wait and done else [])
        return min(ends, default=None)

    def step(self, state: tuple | None, hit: Hit) -> tuple[tuple | None, bool]:
        """The next state, and whether the hit completes the sequence. A hit after the last moment finds nothing open."""
        end = self.until(state)
        began, done, count = state if state is not None and (end is None or hit.at_ms <= end) else (hit.at_ms, (), 0)
        wanted = self.steps[len(done)]
        if not wanted.test.holds(hit, done):
            return ((began, done, count) if done or count else None), False
        if count + 1 < wanted.least:
            return (began, done, count + 1), False
        if len(done) + 1 == len(self.steps):
            return None, True
        return (began, (*done, (hit.at_ms, hit.values)), 0), False


@dataclass(frozen=True)
class Threshold:
    """``least`` hits within the window, both ends included, of ``distinct`` different values at least; an alert forgets the hits before it.

    State: (times of the latest hits, latest times of the latest values), each in rising order and no more than are wanted.
    """

    least: int = 1
    window_ms: int | None = None
    distinct: int = 0
    test: Flag | Same | Combined | None = None

    def until(self, state: tuple | None) -> int | None:
        return state[0][-1] + self.window_ms if state and self.window_ms else None

    def step(self, state: tuple | None, hit: Hit) -> tuple[tuple | None, bool]:
        if self.test is not None and not self.test.holds(hit, ()):
            return state, False
        times, seen = state or ((), ())
        times = (*times, hit.at_ms)[-self.least :]
        if self.distinct > 1:
            latest = dict(seen)
            for value in hit.values[0]:
                latest.pop(value, None)
                latest[value] = hit.at_ms
            seen = tuple(latest.items())[-self.distinct :]
        oldest = [times[0], *[t for _, t in seen[:1]]]
        enough = len(times) == self.least and (self.distinct <= 1 or len(seen) == self.distinct)
        if enough and (not self.window_ms or hit.at_ms - min(oldest) <= self.window_ms):
            return None, True
        return (times, seen), False


Automaton = Sequence | Threshold


def run(automaton: Automaton, state: tuple | None, hits: Items[Hit]) -> tuple[tuple | None, list[int]]:
    """The state after all hits, which are in time order, and the times of the alerts."""
    alerts = []
    for hit in hits:
        state, fires = automaton.step(state, hit)
        if fires:
            alerts.append(hit.at_ms)
    return state, alerts
