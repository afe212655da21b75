"""Streaming twins: rate limits, thresholds and sequences with state, live counts, and normalization in micro-batches."""

from __future__ import annotations

import json
import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.operators import stage_rules
from emberlog.operators.automata import Automaton, Hit, run
from emberlog.plans.normalize import discard, folder, normalize
from emberlog.plans.sealing import Ledger

Deliver = Callable[[DataFrame, int], object]


def passed(times: list[int], tokens: float, last: int | None, rate: float) -> tuple[list[bool], float, int | None]:
    """Which arrivals of one sender a bucket of ``rate`` tokens lets through; it refills by the time that went by, up to ``rate``."""
    out = []
    for t in times:
        tokens = rate if last is None else min(rate, tokens + max(0, t - last) * rate / 1000)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def limited(lines: DataFrame, rate: float, peer: str = "peer", at_ms: str = "received_ms", idle: str = "10 minutes") -> DataFrame:
    """(peer, at_ms, raw, allowed) of a stream; each sender has a bucket, forgotten after ``idle`` without lines."""
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def spend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (rate, None)
        for pdf in batches:
            pdf = pdf.sort_values(at_ms, kind="stable")
            ok, tokens, last = passed([int(t) for t in pdf[at_ms]], tokens, last, rate)
            yield pd.DataFrame({peer: key[0], at_ms: pdf[at_ms].to_numpy(), "raw": pdf["raw"].to_numpy(), "allowed": ok})
        state.update((tokens, last))
        state.setTimeoutDuration(millis)

    rows = lines.select(F.coalesce(F.col(peer).cast("string"), F.lit("")).alias(peer), F.col(at_ms).cast("long"), "raw").dropna(subset=[at_ms])
    return rows.groupBy(peer).applyInPandasWithState(spend, f"{peer} string, {at_ms} long, raw string, allowed boolean", "tokens double, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Lanes:
    """The open matches of the lanes and rules of one slot, and their hits that the watermark hasn't passed.

    Hits wait until no earlier one can come, so they are folded in the order of a batch. A lane's moment is the first that matters to it: of the
    earliest hit that waits, or the last of the open match, after which it goes; a slot's timeout stands at the earliest. A call of Python costs
    more than the work on a lane, and asking the store for each part of a state costs more still, so a slot's lanes share a call and a state.
    """

    def __init__(self, automata: dict[str, Automaton], names: list[str], order: list[str]):
        self.automata, self.names, self.order = automata, names, order
        self.known: dict[str, list[bool]] = {}

    def advance(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        lanes: dict[tuple, tuple] = pickle.loads(state.get[0]) if state.exists else {}
        due = {lane for lane, (_, _, moment) in lanes.items() if moment is not None and moment < passed}
        for pdf in [] if state.hasTimedOut else rows:
            named = zip(*(pdf[c].tolist() for c in self.names), strict=True)
            ties = pdf[self.order].itertuples(index=False, name=None) if self.order else [()] * len(pdf)
            for lane, at_ms, tie, flags, values in zip(named, pdf["at_ms"].tolist(), ties, pdf["flags"].tolist(), pdf["values"].tolist(), strict=True):
                lanes.setdefault(lane, (None, [], None))[1].append((at_ms, tuple(tie), flags, json.loads(values)))
                due.add(lane)
        alerts = []
        for lane in due:
            match, waiting, moment, fired = self.settled(self.automata[lane[-1]], *lanes.pop(lane)[:2], passed)
            alerts += [(*lane, t) for t in fired]
            if match is not None or waiting:
                lanes[lane] = (match, waiting, moment)
        if lanes:
            state.update((pickle.dumps(lanes),))
            moments = [moment for _, _, moment in lanes.values() if moment is not None]
            if moments:
                state.setTimeoutTimestamp(max(min(moments), passed, 1))
        elif state.exists:
            state.remove()
        if alerts:
            yield pd.DataFrame(alerts, columns=[*self.names, "at_ms"])

    def settled(self, automaton: Automaton, match: tuple | None, waiting: list[tuple], passed: int) -> tuple[tuple | None, list[tuple], int | None, list[int]]:
        """A lane's match after the hits that the watermark has passed, the hits that still wait, the moment that the watermark must pass next, and the alerts."""
        waiting.sort(key=lambda h: h[:2] + h[3:])
        ready = bisect_right(waiting, passed, key=lambda h: h[0])
        match, alerts = run(automaton, match, [Hit(at_ms, self.outcomes(flags), values) for at_ms, _, flags, values in waiting[:ready]])
        rest, end = waiting[ready:], automaton.until(match)
        if end is not None and end < passed:
            match = end = None
        moments = [h[0] - 1 for h in rest[:1]] + ([end] if end is not None else [])  # passed means above it
        return match, rest, min(moments, default=None), alerts

    def outcomes(self, flags: str) -> list[bool]:
        """A hit's tests, written as a digit each."""
        if flags not in self.known:
            self.known[flags] = [f == "1" for f in flags]
        return self.known[flags]


def keep_state_on_disk(spark: SparkSession) -> None:
    """The state store that streams of ``correlated`` need; its folder is the stream's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def correlated(events: DataFrame, rules: dict[str, stage_rules.StageRule], keys: dict[str, Column], at_ms: str, late: str = "10 minutes", order: tuple[str, ...] = (), slots: int = 1024) -> DataFrame:
    """Alerts (keys, rule, at_ms) of a stream of events: those that ``stage_rules.hits`` and ``correlate.folded`` give for the same rows at once.

    Events may come late and out of order by ``late``; later ones are left out, as the watermark says. An alert comes out when the watermark has passed its
    time. A lane holds its hits of the last ``late``, and a match of bounded size, until it can't go on; a rule without a window holds its match for good.
    Lanes are dealt by hash to ``slots``, each of which has one state, written anew when any of its lanes has a hit: more of them suit more open lanes. A stream's checkpoint holds to their number.
    """
    keep_state_on_disk(events.sparkSession)
    timed = events.withColumn("_at", F.timestamp_millis(F.col(at_ms).cast("long"))).withWatermark("_at", late)
    found = stage_rules.hits(timed, rules, keys, at_ms, (*order, "_at"))
    plain = {"flags": F.concat_ws("", F.transform("flags", lambda f: f.cast("int").cast("string"))), "values": F.to_json("values")}  # nested columns are slow to cut into lanes
    by = [*keys, "rule"]
    lanes = Lanes({name: r.automaton for name, r in rules.items()}, by, list(order))
    dealt = found.withColumns(plain).withColumn("_slot", F.pmod(F.xxhash64(*by), F.lit(slots)))
    return dealt.groupBy("_slot").applyInPandasWithState(lanes.advance, ", ".join(f"{k} string" for k in by) + ", at_ms long", "lanes binary", "append", GroupStateTimeout.EventTimeTimeout)


def live_counts(events: DataFrame, at: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by window, class and pack, of a stream; state older than the watermark goes."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), "class_name", F.coalesce("pack", F.lit("fallback")).alias("pack")).agg(F.count("*").alias("n"))


def sealed(leaves: DataFrame, kept: Ledger, order: tuple[str, ...], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends each micro-batch of (shard, leaf and ``order``) to a ledger; the batch's number is the append's, so a batch that is repeated changes nothing."""
    return leaves.writeStream.foreachBatch(lambda df, number: None if df.isEmpty() else kept.append(df, number, order)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def normalized(lines: DataFrame, deliver: Deliver, checkpoint: str, dead: Deliver | None = None, trigger: dict | None = None, **options) -> StreamingQuery:
    """Normalizes each micro-batch and delivers its events. A batch that is repeated after a failure has the same number, so a sink
    that overwrites by it writes each batch once. A batch's staging goes when it has been delivered."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        staging = f"{options.get('staging') or folder(df.sparkSession)}/batch-{batch_id}"
        events, rejected = normalize(df, **{**options, "staging": staging})
        deliver(events, batch_id)
        if dead:
            dead(rejected, batch_id)
        discard(df.sparkSession, staging)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
