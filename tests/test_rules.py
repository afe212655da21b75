"""Stage rules, views, signatures, sniffing and datasets on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import correlate, detect, guard, rules, stage_rules, views
from emberlog.operators.ledger import Signer
from emberlog.operators.packs import Registry
from emberlog.operators.sniff import sniffed
from emberlog.plans.normalize import normalize
from emberlog.sources import datasets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("doc", "value", "fits"),
    [
        ({"value": "AbC"}, " abc ", True), ({"operator": "in", "values": ["x", "abc"]}, "ABC", True), ({"operator": "not_in", "values": ["x"]}, "abc", True), ({"operator": "contains", "value": "B"}, "abc", True),
        ({"operator": "startswith", "value": "b"}, "abc", False), ({"operator": "endswith", "value": "C"}, "abc", True), ({"operator": "regex", "value": "^a.c$"}, "ABC", True), ({"operator": "gte", "value": 3}, "3.0", True),
        ({"operator": "lt", "value": 3}, "x", False), ({"operator": "not_lt", "value": 3}, "x", True), ({"operator": "exists"}, None, False), ({"operator": "not_exists"}, None, True), ({"operator": "not_equals", "value": "a"}, None, True), ({"value": True}, "true", True), ({"value": 3.0}, "3", True),
    ],
)
def test_stage_conditions(spark, doc, value, fits):
    fields = stage_rules.Fields(f=F.lit(value).cast("string"))
    assert one(spark, stage_rules.condition(fields, {"field": "f", **doc})) is fits


def test_stage_groups_and_older_signatures(spark):
    fields = stage_rules.Fields(a=F.lit("x"), signature_name=F.lit("Loud Scan"), tactic=F.lit("ta1"), technique=F.lit("t1059.001"), many=stage_rules.many(F.array(F.lit("p"), F.lit("q"))))
    yes = {"field": "a", "value": "x"}
    no = {"field": "a", "value": "y"}
    assert one(spark, stage_rules.group(fields, {"operator": "OR", "conditions": [no], "groups": [{"conditions": [yes]}]}))
    assert one(spark, stage_rules.group(fields, {})) and not one(spark, stage_rules.group(fields, {"conditions": [yes, no]}))
    assert one(spark, stage_rules.condition(fields, {"field": "many", "value": "Q"}))
    for stage, fits in (({"signatureContains": ["scan"]}, True), ({"signatureContains": ["scan"], "excludeSignatureContains": ["loud"]}, False), ({"techniques": ["T1059"]}, True), ({"tactics": ["TA2"], "techniques": ["T1"]}, False), ({"tactics": ["TA1"], "conditions": [no]}, False), ({}, True)):
        assert one(spark, stage_rules.signatures(fields, stage)) is fits
    with pytest.raises(ValueError, match="unknown operator"):
        stage_rules.condition(fields, {"field": "a", "operator": "near", "value": 1})


def test_stage_rules_are_typed(spark):
    fields = stage_rules.Fields(a=F.lit("x"))
    rule = stage_rules.compiled({"id": "r", "windowMinutes": 2, "stages": [{"minOccurrences": 2, "aggregate": {"threshold": 5}, "withinSeconds": 3, "eventSources": ["EDR"]}, {"optional": True}]}, fields, F.lit("Windows"))
    assert (rule.kind, rule.form, rule.window_ms, rule.steps[0].least, rule.steps[0].within_ms, rule.steps[1].optional) == ("SEQUENCE", "legacy", 120_000, 5, 3000, True)
    assert one(spark, rule.steps[0].fits)
    assert not one(spark, stage_rules.compiled({"stages": [{"eventSources": ["zeek"]}]}, fields, F.lit("sysmon")).steps[0].fits)


def test_runs_are_cut_exactly_at_rests(spark):
    draw = random.Random(5)
    rows = [(str(draw.randrange(4)), draw.randrange(4000)) for _ in range(300)]
    got = correlate.runs(spark.createDataFrame(rows, "lane string, at_ms long"), 25).collect()
    by = {}
    for r in got:
        by.setdefault(r["lane"], []).append((r["at_ms"], r["run"]))
    assert len(got) == len(rows)
    for hits in by.values():
        hits.sort()
        assert all((b[1] > a[1]) == (b[0] - a[0] > 25) for a, b in zip(hits, hits[1:], strict=False))


def test_back_references_between_lists(spark):
    rows = [("h", 0, "open", ["a", "b"]), ("h", 5, "use", ["c"]), ("h", 9, "use", ["B"]), ("i", 0, "open", ["a"]), ("i", 1, "use", None)]
    df = spark.createDataFrame(rows, "lane string, t long, kind string, user array<string>")
    doc = {"ruleFormat": "IR_v1", "stages": [{"match": {"conditions": [{"field": "kind", "value": "open"}]}}, {"match": {"conditions": [{"field": "kind", "value": "use"}, {"field": "user", "operator": "equals_field:stage0.user"}]}}]}
    fields = stage_rules.Fields(kind=F.col("kind"), user=stage_rules.many(F.col("user")))
    assert [tuple(r) for r in stage_rules.alerts(df, doc, fields, "lane", "t").collect()] == [("h", 9)]


def test_values_with_and_without_patterns(spark):
    for text, wanted, fits in (("abc", "A*", True), ("abc", "*C", True), ("abc", "*B*", True), ("abc", "a?c", True), ("a*c", "a\\*c", True), ("abc", "a\\*c", False), ("x", "*", True), ("a.c", "a.c", True), ("abc", "a.c", False), ("a\nb", "a*b", True)):
        assert one(spark, detect.value(F.lit(text), wanted)) is fits, (text, wanted)
    assert one(spark, detect.value(F.lit("31"), "0x1F", integer=True)) and not one(spark, detect.value(F.lit("31"), "0x1F"))


def test_rules_see_their_log_source_only(spark):
    df = spark.createDataFrame([("1", "a"), ("3", "a"), (None, "a")], "code string, x string")
    rule = {"r": {"logsource": {"category": "network_connection"}, "detection": {"s": {"x": "a"}, "condition": "s"}}}
    assert [r["alerts"] for r in rules.matched(df, rule, {"x": F.col("x")}, event_code=F.col("code")).collect()] == [[], ["r"], ["r"]]


LINES = [
    ("", "text", None), ('{"a":1}', "json", None), ("<e/>", "xml", None), ("CEF:0|a|b|1|2|n|5|x=1", "cef", None), ("LEEF:1.0|a|b|1|2|x=1", "leef", None), ("a=1 b=2 c=3", "kv", None), ("1,2,3,4,5,6", "csv", None), ("1\t2\t3\t4\t5", "csv", None), ("plain words", "text", None),
    ("<13>Jan  2 03:04:05 host app[1]: a=1 b=2 c=3", "kv", "syslog"), ("<13>Jan  2 03:04:05 host app[1]: hello", "syslog", None), ('<13>Jan  2 03:04:05 host {"a":1}', "json", "syslog"), ("<13>Jan  2 03:04:05 host CEF:0|a|b|1|2|n|5|x=1", "cef", "syslog"),
    ('<13>1 2024-01-02T03:04:05Z host app 1 id [x a="1"] a=1 b=2 c=3', "kv", "syslog"), ("<13>1 2024-01-02T03:04:05Z host app - - -", "syslog", None), ("2024-01-02T03:04:05Z host app: 1,2,3,4,5,6", "csv", "syslog"), ("\ufeff<13>hello: there", "syslog", None), ("<13>{\"a\":1}", "json", "syslog"),
]


def test_sniffing(spark):
    df = sniffed(spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i int, raw string"))
    got = {r["i"]: r["sniffed"] for r in df.collect()}
    assert [(got[i]["format"], got[i]["envelope"]) for i in range(len(LINES))] == [x[1:] for x in LINES]
    assert df.columns == ["i", "raw", "sniffed"]


def test_json_is_flattened_to_any_depth_that_is_let_through(spark):
    from emberlog.operators import extract

    extract.prepare(spark)
    text = json.dumps({"z": 1})
    for _ in range(30):
        text = '{"a":' + text + ',"b":"{"}'
    got = one(spark, extract.json(F.lit(text), {}))
    assert got["a." * 30 + "z"] == "1" and len(got) == 31 and got["b"] == "{"


def test_too_many_fields_are_dead_letters(spark):
    wide = "k0=1 src=10.0.0.1 " + " ".join(f"f{i}=1" for i in range(1030))
    pack = {"id": "a", "version": "1.0", "match": {"contains": ["k0="]}, "parse": [{"type": "kv"}], "classes": [{"name": "all", "class": "network_activity"}]}
    events, dead = normalize(spark.createDataFrame([(wide,), ("k0=1 src=10.0.0.2",)], "raw string"), [pack], now_ms=0)
    assert events.count() == 1 and [r["error"] for r in dead.collect()] == [one(spark, guard.too_wide(F.lit(None).cast("map<string,string>"))) or "more than 1024 fields"]


def test_signed_packs(spark):
    signer = Signer(spark)
    pack = {"id": "a", "version": "1.0", "match": {"contains": ["k="]}, "parse": [{"type": "kv"}], "classes": [{"name": "all", "class": "network_activity"}]}
    from emberlog.operators.packs import digest

    good = {"a": signer.sign(digest(pack))}
    assert [(p.signed, p.trust) for p in Registry([pack], signatures=good, verify=signer.verify).packs] == [(True, 1.0)]
    changed = pack | {"priority": 9}
    assert [(p.signed, p.trust) for p in Registry([changed], signatures=good, verify=signer.verify).packs] == [(False, 0.7)]
    assert Registry([changed], signatures=good, verify=signer.verify, required=True).refused == ["a"]


def test_views_answer_in_order(spark):
    words = views.Dictionary(raw={"Old": [views.Candidate("Image", "basename")]}, event={"Image": [views.Candidate("file.path")], "Ext": [views.Candidate("file.path", "ext")], "Code": [views.Candidate("n", "hex")], "Say": [views.Candidate("n", "map", (("31", "yes"),))]}, not_subject={"c": "file."})
    df = spark.createDataFrame([("c",), ("d",)], "class_name string").select("class_name", F.expr("map('file.path', 'C:\\\\x\\\\a.exe', 'n', '31') as attrs"), F.expr("map('odd_name', 'v') as unmapped"), F.expr("map('n', array('Num')) as lineage"), F.expr("map('image', 'C:\\\\x\\\\a.exe', 'gone', '1') as fields"))
    view, part = views.EventView(words), views.EventView(words, whole=False)
    names = ["n", "Image", "Ext", "Code", "Say", "OddName", "num", "gone", "none"]
    rows = {r["class_name"]: r for r in df.select("class_name", *[view.lookup(n).alias(n) for n in names], part.lookup("OddName").alias("part"), views.RawView(dictionary=words).get("Old").alias("old")).collect()}
    assert [rows["d"][n]["kind"] for n in names] == ["native", "alias", "alias", "alias", "alias", "unmapped", "lineage", "lost", "absent"]
    assert [rows["d"][n]["values"] for n in ("Ext", "Code", "Say", "num")] == [["exe"], ["0x1F"], ["yes"], ["31"]]
    assert rows["c"]["Image"]["kind"] == "lost" and rows["d"]["part"]["kind"] == "absent" and rows["d"]["old"] == ["a.exe"]


def test_datasets_and_rule_pairs(spark, tmp_path):
    place = tmp_path / "g" / "n"
    place.mkdir(parents=True)
    (place / "expected.json").write_text(json.dumps({"event_source": "zeek", "rule_type": "sigma", "benign_1": {"expected_alerts": 0}, "true_positive_1": {"expected_alerts": 2}}, indent=1))
    (place / "benign_1.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert sorted(map(tuple, datasets.case_lines(spark, str(tmp_path)).collect())) == [("g/n", "benign_1", '{"a":1}'), ("g/n", "benign_1", '{"a":2}')]
    assert sorted((r["case"], r["expected_alerts"]) for r in datasets.expected(spark, str(tmp_path)).collect()) == [("benign_1", 0), ("true_positive_1", 2)]
    (tmp_path / "rules.md").write_text("# a\n```yaml\nid: 1\ndetection:\n  s:\n    Image|endswith: x\n    User: y\n  condition: s\n```\ntext\n```yml\nid: 1\nlogsource: {product: ocsf, class: process_activity}\ndetection:\n  s:\n    process.file.path: x\n    actor.user.name: y\n  condition: s\n---\n- no rule\n```\n```yaml\n: bad: [\n```\n")
    found = [d for t in datasets.rule_texts(spark, str(tmp_path)) for d in datasets.rule_blocks(t)]
    learnt = datasets.learnt(datasets.paired(found))
    assert learnt.everywhere == {"Image": "process.file.path", "User": "actor.user.name"} and learnt.by_class["process_activity"] == learnt.everywhere


def test_names_that_resemble(spark):
    from emberlog.operators import mapper

    rows = spark.createDataFrame([(1, {"sourceadress": "10.0.0.1", "dst": "10.0.0.2", "destinatonport": "443", "zzzz": "1"})], "row long, fields map<string,string>")
    got = {r["raw"]: (r["path"], r["score"]) for r in mapper.matched(rows).collect()}
    assert got["dst"] == ("dst_endpoint.ip", 1.0) and got["sourceadress"][0] == "src_endpoint.ip" and got["destinatonport"][0] == "dst_endpoint.port" and 0.6 < got["sourceadress"][1] < 0.8 and "zzzz" not in got


def test_messages_and_their_dead_letters(spark):
    from emberlog.sources import readers

    rows = spark.createDataFrame([('{"raw":"a=1","source":{"peer":"p"},"received_ms":5}',), ("{broken",), ('{"x":1}',), (None,)], "value string")
    assert [tuple(r) for r in readers.messages(rows).collect()] == [("a=1", {"peer": "p"}, 5)]
    assert [r["raw_preview"] for r in readers.faulty(rows).collect()] == ["{broken", '{"x":1}', ""]


def test_store_answers(spark):
    from emberlog.plans import store

    took = spark.range(1, 101).select(F.col("id").alias("took_ms"))
    assert tuple(store.latency(took).first()) == (50, 99)
    counts = spark.createDataFrame([("processed", "", 3), ("by_pack", 'a"b', 2)], "name string, label string, value long")
    assert [r["line"] for r in store.prometheus(counts).collect()] == ["emberlog_processed_total 3", 'emberlog_by_pack_total{label="a\\"b"} 2']
    events = spark.createDataFrame([("u", 1), ("v", 2)], "uid string, seq int")
    assert store.found(events, uid="v").first()["seq"] == 2


def test_aliases_and_drift(spark):
    rule = {"detection": {"s": {"Image|endswith": "x", "User": "y"}, "condition": "s"}}
    twin = {"logsource": {"class": "c"}, "detection": {"s": {"process.path": "x", "user.name": "y"}, "condition": "s"}}
    assert datasets.aliases(rule, twin) == {"process.path": "Image", "user.name": "User"}
    assert [tuple(r) for r in datasets.drift(spark, [twin, twin], {"c": ["user.name"]}).collect()] == [("c", "process.path", 2)]
