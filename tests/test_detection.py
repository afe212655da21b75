"""Correlation, rules, ledger, mining, sinks, store and streams against plain Python."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions.timestamps import epoch_ms
from emberlog.operators import correlate, ledger, mining, rules, views
from emberlog.operators.lineage import GENESIS
from emberlog.plans import store
from emberlog.sources import readers, sinks
from emberlog.streaming import streams


def brute_sequence(events, window, gap):
    """Alerts of a-b-c, one lane at a time; (lane, t) pairs."""
    out = []
    for lane in sorted({e[0] for e in events}):
        at, began, last = 0, None, None
        for _, t, kind in sorted(e for e in events if e[0] == lane):
            if began is not None and (t - began > window or t - last > gap):
                at, began, last = 0, None, None
            if kind == "abc"[at]:
                began, last, at = (t if began is None else began), t, at + 1
                if at == 3:
                    out.append((lane, t))
                    at, began, last = 0, None, None
    return out


def test_sequence_equals_brute_force(spark):
    draw = random.Random(5)
    events = sorted({(draw.choice("xy"), draw.randrange(3000)): draw.choice("abcd") for _ in range(900)}.items())
    events = [(lane, t, kind) for (lane, t), kind in events]
    df = spark.createDataFrame([*events, (None, 1, "a"), ("x", None, "a"), ("x", 5, None)], "lane string, t long, kind string")
    got = correlate.sequence(df, "lane", "t", [F.col("kind") == k for k in "abc"], [correlate.Stage()] * 3, window_ms=30, gap_ms=18)
    assert sorted(map(tuple, got.collect())) == brute_sequence(events, 30, 18)


def test_sequence_stage_options(spark):
    rows = [("l", 0, "a", "u"), ("l", 1, "b", "v"), ("l", 2, "b", "u"), ("l", 3, "a", None), ("l", 4, "b", None)]
    df = spark.createDataFrame(rows, "lane string, t long, kind string, user string")
    fits = [F.col("kind") == "a", F.col("kind") == "b"]
    same = [correlate.Stage(), correlate.Stage(same=(("user", 0, "user"),))]
    assert [tuple(r) for r in correlate.sequence(df, "lane", "t", fits, same, fields=("user",)).collect()] == [("l", 2)]
    twice = [correlate.Stage(), correlate.Stage(least=2)]
    assert [tuple(r) for r in correlate.sequence(df, "lane", "t", fits, twice).collect()] == [("l", 2)]


def test_threshold_of_distinct_values(spark):
    df = spark.createDataFrame([("l", 0, "p"), ("l", 1, "p"), ("l", 2, "q"), ("l", 50, "p"), ("l", 51, None), ("l", 52, "p")], "lane string, t long, v string")
    assert [tuple(r) for r in correlate.threshold(df, "lane", "t", 2, 10, "v", 2).collect()] == [("l", 2)]
    assert correlate.threshold(df.limit(0), "lane", "t", 2, 10).collect() == []


def test_rule_conditions(spark):
    df = spark.createDataFrame([(1, "a.exe -enc", "10.1.2.3"), (2, "B.EXE /enc", None), (3, None, "x")], "id int, cmd string, ip string")
    fields = {"cmd": F.col("cmd"), "ip": F.col("ip")}
    rule = {"detection": {"run": {"cmd|contains|windash": "-enc"}, "enc": {"cmd|windash|endswith": "/enc"}, "net": {"ip|cidr": "10.0.0.0/8"}, "condition": "enc and not net"}}
    other = {"detection": {"_skip": {"cmd": "*"}, "sel_1": {"ip": None}, "sel_2": {"nowhere": "x"}, "condition": "1 of sel_* or (all of them and run)", "run": ["exe"]}}
    got = {r["id"]: r["alerts"] for r in rules.matched(df, {"r": rule, "o": other}, fields).collect()}
    assert got == {1: [], 2: ["o", "r"], 3: []}
    with pytest.raises(ValueError, match="unknown names"):
        rules.condition("a and missing", ["a"])
    with pytest.raises(ValueError, match="unknown modifier"):
        rules.selection(fields, {"cmd|fuzzy": "x"})


def test_base64_offsets():
    for pad in ("", "x", "xy"):
        coded = base64.b64encode((pad + "needle" + "tail").encode()).decode()
        assert any(x in coded for x in rules.shifted("needle"))


def test_ledger_finds_what_was_changed(spark):
    leaves = spark.range(600).select(F.lit("s").alias("shard"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    chain = ledger.chained(ledger.batches(leaves)).orderBy("batch_id").collect()
    assert [r["count"] for r in chain] == [256, 256, 88]
    assert chain[0]["prev_chain"] == GENESIS
    assert chain[2]["prev_chain"] == chain[1]["chain_hash"]
    stored = spark.createDataFrame(chain)
    assert ledger.broken(stored).collect() == []
    assert [(r["batch_id"], r["reason"]) for r in ledger.broken(stored.withColumn("count", F.when(F.col("batch_id") == 1, 9).otherwise(F.col("count")))).collect()] == [(1, "hash")]
    assert [(r["batch_id"], r["reason"]) for r in ledger.broken(stored.filter("batch_id <> 1")).collect()] == [(2, "gap")]
    now = leaves.withColumn("leaf", F.when(F.col("seq") == 599, F.lit("00" * 32)).otherwise(F.col("leaf"))).unionByName(leaves.limit(1).withColumn("seq", F.lit(700).cast("long")))
    bad = ledger.verified(now, ledger.proofs(leaves), stored).filter("not verified").orderBy("seq").collect()
    assert [(r["seq"], r["known"], r["proof_match"], r["link_match"]) for r in bad] == [(599, True, False, True), (700, False, False, False)]


def test_signatures(spark):
    signer = ledger.Signer(spark)
    signed = signer.sign("ab" * 32)
    assert signer.verify("ab" * 32, signed)
    assert not signer.verify("ac" * 32, signed)


def test_templates_and_their_patterns(spark):
    lines = [f"link up on port {i} from 10.0.0.{i}" for i in range(9)] + ["session of alice closed", "session of bob closed", None, ""]
    got = {r["template"]: r["count"] for r in mining.templates(spark.createDataFrame([(x,) for x in lines], "raw string")).collect()}
    assert got == {"link up on port <NUM> from <IP>": 9, "session of <*> closed": 2}
    found = re.match(mining.pattern("link up on port <NUM> from <IP>"), "link up on port 7 from 10.0.0.7")
    assert found.groupdict() == {"port": "7", "from": "10.0.0.7"}


def test_store(spark):
    df = spark.createDataFrame([(1, "u", 5, None, True, 0.5), (2, "u", 2, "p", False, 1.0), (3, "w", 4, "p", None, 1.0)], "seq long, uid string, severity_id int, pack string, valid boolean, confidence double")
    assert [r["seq"] for r in store.newest(store.found(df, severity_min=4), 1).collect()] == [3]
    assert [r["seq"] for r in store.found(df, fallback=True).collect()] == [1]
    assert {(r["uid"], r["seq"]) for r in store.latest(df).collect()} == {("u", 2), ("w", 3)}
    with pytest.raises(ValueError, match="unknown filter"):
        store.found(df, colour=1)


def test_sinks_are_isolated(spark):
    got = []

    def fail(df):
        raise OSError("down")

    errors = sinks.deliver({"bad": fail, "good": lambda df: got.append(df.count())})(spark.range(3), 0)
    assert got == [3]
    assert errors == {"bad": "OSError: down"}
    with pytest.raises(OSError, match="down"):
        sinks.deliver({}, lambda df, n: fail(df))(spark.range(3), 0)


def test_frames_and_files(spark, tmp_path):
    assert readers.frames(b"5 a b\nc7 seven  plain\n\nlast") == ["a b\nc", "seven  ", "plain", "last"]
    (tmp_path / "a.log").write_bytes(b"one\r\n\n  \ntwo")
    assert sorted(r["raw"] for r in readers.files(spark, str(tmp_path), "pack").collect()) == ["one", "two"]


def test_token_bucket():
    ok, tokens, last = streams.passed([0, 0, 0, 600, 700], 2, None, 2)
    assert (ok, last) == ([True, True, False, True, False], 700)


def test_rate_limit_stream(spark, tmp_path):
    spark.createDataFrame([("p", 0, "a"), ("p", 0, "b"), ("p", 0, "c"), ("q", 0, "d"), (None, 0, "e")], "peer string, received_ms long, raw string").coalesce(1).write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a stream with time-outs never runs out of empty batches
    stream = spark.readStream.schema("peer string, received_ms long, raw string").json(str(tmp_path / "in"))
    streams.limited(stream, 2.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted((r["peer"], r["allowed"]) for r in spark.table("limited").collect()) == [("", True), ("p", False), ("p", True), ("p", True), ("q", True)]


def test_normalized_stream_to_the_lake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('<189>date=2024-01-01 time=00:00:01 devname="fw" devid="FG1" logid="0000000013" type="traffic" subtype="forward" level="notice" srcip=10.0.0.1 srcport=99 dstip=192.0.2.1 dstport=443 proto=6 action="accept"\n')
    query = streams.normalized(readers.follow(spark, str(tmp_path / "in")), sinks.deliver({"lake": lambda e: sinks.write_lake(e, str(tmp_path / "lake"))}), str(tmp_path / "cp"), now_ms=1_704_153_600_000, staging=str(tmp_path / "staging"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "lake")).collect()
    assert [(r["src_ip"], r["dst_port"], r["class_uid"], str(r["dt"])) for r in rows] == [("10.0.0.1", 443, 4001, "2024-01-01")]


def test_fingerprints_and_clusters(spark):
    rows = [("<3>Jan  2 03:04:05 h app[1]: did 12 error", {"message": "did 12 error", "syslog_app": "app"}, "syslog", 1), ("<3>Jan  2 03:04:06 h app[2]: did 7 error", {"message": "did 7 error", "syslog_app": "app"}, "syslog", 2), ("b=1 a=2", None, "kv", 3)]
    df = spark.createDataFrame(rows, "raw string, fields map<string,string>, format string, received_ms long")
    prints = df.select("raw", "received_ms", mining.fingerprint(F.col("raw"), F.col("format"), F.col("fields")).alias("print"))
    got = {r["fingerprint"]: (r["label"], r["count"], r["samples"]) for r in mining.clusters(prints, 1).collect()}
    name = lambda key: hashlib.sha256(key.encode()).hexdigest()[:12]
    assert got == {name("syslog:app:did # error"): ("syslog:app", 2, [rows[1][0]]), name("kv:a,b"): ("kv kv(2 keys)", 1, ["b=1 a=2"])}


def test_names_are_looked_up_once_and_hits_worked_out_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(views, "staged", lambda hits: kept.append(hits) or hits)
    rule = {"stages": [{"conditions": [{"field": "user_name", "value": v} for v in "abcdef"]}]}
    e = spark.createDataFrame([(1, 1, 0, "x", {}, {}, {}, {"UserName": "a"})], "event_id long, case_id long, time long, class_name string, attrs map<string,string>, unmapped map<string,string>, lineage map<string,array<string>>, fields map<string,string>")
    views.stage_verdicts(e, {"r": rule}, views.Dictionary(), order=("event_id",))
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("username") == 2  # among the source's fields, and in the lineage, for six conditions and three views


def test_fields_of_any_spelling_and_times_of_any_format(spark):
    e = spark.sql("select map('USER_name', 'a', 'Empty', '') as fields union all select map('username', 'b', 'user_name', 'c') union all select map('x', 'y')")
    raw = views.RawView()
    got = e.select(raw.get("user_name").alias("u"), raw.get("empty").alias("e"), raw.get("UserName").alias("n")).collect()
    assert [tuple(r) for r in got] == [(["a"], [], ["a"]), (["c"], [], ["b"]), ([], [], [])]
    times = ["2024-01-02T03:04:05Z", "2024-01-02t03:04:05.5+0100", "2024-01-02 03:04:05", "2024/01/02 03:04:05", "02/Jan/2024:03:04:05 +0000", "Jan 2 2024 03:04:05", "02-Jan-2024 03:04:05", "1704164645", "soon", ""]
    base = 1_704_164_645_000
    found = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(epoch_ms(F.col("t"))).collect()]
    assert found == [base, base - 3_600_000 + 500, base, base, base, base, base, base, None, None]
