"""Automata, back references, streams and replay of stage rules against plain Python and against batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import correlate, stage_rules
from emberlog.operators.automata import Combined, Flag, Hit, Same, Sequence, Step, Threshold, run
from emberlog.streaming import streams

PATH = {
    "ruleId": "path", "window": {"durationSeconds": 0.03}, "maxGapSeconds": 0.018,
    "stages": [
        {"match": {"conditions": [{"field": "kind", "value": "a"}]}},
        {"minOccurrences": 2, "match": {"conditions": [{"field": "kind", "operator": "in", "values": ["b", "c"]}], "groups": [{"operator": "OR", "conditions": [{"field": "user", "operator": "equals_field:stage0.user"}, {"field": "kind", "value": "c"}]}]}},
    ],
}
BUSY = {"ruleId": "busy", "windowMinutes": 0.0004, "stages": [{"match": {"conditions": [{"field": "kind", "operator": "not_equals", "value": "d"}]}, "minOccurrences": 3, "requireDistinctField": "kind", "minDistinctCount": 2}]}


def fields():
    return stage_rules.Fields(kind=F.col("kind"), user=F.col("user"))


def rules():
    return {"path": stage_rules.compiled(PATH, fields()), "busy": stage_rules.compiled(BUSY, fields())}


def events(n=400, seed=7):
    draw = random.Random(seed)
    return [(i, draw.choice("xyz"), t, draw.choice("abcd"), draw.choice("uv")) for i, t in enumerate(sorted(draw.randrange(4000) for _ in range(n)))]


SCHEMA = "id long, lane string, t long, kind string, user string"


def brute(rows):
    """Alerts by lists of whole matches, lane by lane."""
    out = []
    for lane in sorted({r[1] for r in rows}):
        mine = sorted((t, i, k, u) for i, ln, t, k, u in rows if ln == lane)
        first, seconds = None, []
        for t, _, k, u in mine:
            if first and (t - first[0] > 30 or t - first[0] > 18):
                first, seconds = None, []
            if first is None:
                first = (t, u) if k == "a" else None
            elif k == "c" or (k == "b" and u == first[1]):
                seconds.append(t)
                if len(seconds) == 2:
                    out.append((lane, "path", t))
                    first, seconds = None, []
        held = []
        for t, _, k, _ in mine:
            if k != "d":
                held = [h for h in held if t - h[0] <= 24] + [(t, k)]
                if len(held) >= 3 and len({h[1] for h in held}) >= 2:
                    out.append((lane, "busy", t))
                    held = []
    return sorted(out)


def test_both_kinds_in_one_pass_equal_brute_force(spark):
    rows = events()
    df = spark.createDataFrame([*rows, (900, None, 5, "a", "u"), (901, "x", None, "a", "u"), (902, "x", 3, None, None)], SCHEMA).repartition(5)
    found = correlate.folded(stage_rules.hits(df, rules(), {"lane": F.col("lane")}, "t", ("id",)), {n: r.automaton for n, r in rules().items()}, order=("id",))
    got = sorted(map(tuple, found.collect()))
    assert got == brute([*rows, (902, "x", 3, "", "")]) and {r[1] for r in got} == {"path", "busy"}


def test_states_are_bounded_and_steps_pure():
    draw = random.Random(2)
    hits = [Hit(i, [True], [[str(draw.randrange(50))]]) for i in range(500)]
    state = None
    counter = Threshold(5, 40, 99)
    for h in hits:
        state, fires = counter.step(state, h)
        assert not fires and len(state[0]) <= 5 and len(state[1]) <= 99
    two = Sequence((Step(Flag(0)), Step(Combined((Flag(1), Same(0, 0, 0)), every=False), 2)), 10)
    state, _ = two.step(None, Hit(0, [True, False], [["a"]]))
    assert two.until(state) == 10
    later = two.step(state, Hit(4, [False, False], [["a"]]))[0]
    assert later != state and two.step(state, Hit(4, [False, False], [["b"]])) == (state, False)
    assert two.step(later, Hit(10, [False, True], [["z"]])) == (None, True) and two.step(later, Hit(11, [False, True], [["z"]])) == (None, False)


def test_threshold_of_values_equals_whole_window():
    draw = random.Random(4)
    for least, distinct, window in itertools.product((1, 3), (0, 2, 4), (None, 6)):
        hits = [Hit(t, [True], [[draw.choice("pqrst")] * draw.randrange(2)]) for t in sorted(draw.randrange(200) for _ in range(150))]
        held, want = [], []
        for h in hits:
            held = [x for x in held if not window or h.at_ms - x.at_ms <= window] + [h]
            if len(held) >= least and (distinct <= 1 or len({v for x in held for v in x.values[0]}) >= distinct):
                want.append(h.at_ms)
                held = []
        assert run(Threshold(least, window, distinct), None, hits)[1] == want


@pytest.mark.parametrize("doc", [{"operator": "OR", "conditions": [{"field": "user", "operator": "equals_field:stage0.user"}, {"field": "kind", "value": "z"}]}, {"operator": "OR", "groups": [{"conditions": [{"field": "user", "operator": "equals_field:stage0.user"}]}, {"conditions": [{"field": "kind", "value": "z"}, {"field": "user", "value": "w"}]}]}])
def test_back_references_in_or_groups(spark, doc):
    df = spark.createDataFrame([("l", 0, "a", "u"), ("l", 1, "y", "w"), ("l", 2, "z", "w"), ("m", 0, "a", "u"), ("m", 1, "y", "u"), ("n", 0, "a", None), ("n", 1, "y", None)], "lane string, t long, kind string, user string")
    rule = {"stages": [{"match": {"conditions": [{"field": "kind", "value": "a"}]}}, {"match": doc}]}
    assert sorted(map(tuple, stage_rules.alerts(df, rule, fields(), "lane", "t").collect())) == [("l", 2), ("m", 1)]


def streamed(spark, tmp_path, files, late="20 milliseconds"):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / f"f{i}"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for i in range(len(files)):
        part = next((tmp_path / f"f{i}").glob("part-*"))
        part.rename(tmp_path / "in" / f"{i:03}.json")
        (tmp_path / "in" / f"{i:03}.json").touch()
        query = streams.correlated(stream, rules(), {"lane": F.col("lane")}, "t", late, ("id",)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("lane", "rule", "at_ms").collect()))


def test_stream_gives_the_alerts_of_a_batch(spark, tmp_path):
    rows = events(240)
    draw = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[2] + draw.randrange(15))  # out of order, within what may be late
    third = len(mixed) // 3
    end = [(999, "end", 10_000, "d", "u")]  # the watermark passes all else
    got = streamed(spark, tmp_path, [mixed[:third], mixed[third : 2 * third], mixed[2 * third :], end, end])
    assert got == brute(rows) and len(got) > 5


def test_stream_leaves_out_what_is_too_late(spark, tmp_path):
    files = [[(1, "x", 100, "a", "u"), (2, "x", 5000, "d", "u")], [(3, "x", 110, "c", "u"), (4, "x", 111, "c", "u"), (5, "x", 6000, "a", "u")], [(6, "x", 5990, "a", "u"), (7, "x", 6001, "c", "u"), (8, "x", 6002, "c", "u")], [(9, "x", 9000, "d", "u")], [(10, "x", 9001, "d", "u")]]
    assert streamed(spark, tmp_path, files) == [("x", "busy", 6001), ("x", "path", 6002)]


def test_lanes_of_a_stream_share_states(spark, tmp_path):
    rows = [(i, f"lane{i // 4}", 100 + i % 4, "abcc"[i % 4], "u") for i in range(1200)] + [(5000, "end", 10_000, "d", "u")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    query = streams.correlated(stream, rules(), {"lane": F.col("lane")}, "t", "20 milliseconds", ("id",), slots=8).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(held) <= 8
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("lane", "rule", "at_ms").collect())) == brute(rows)
