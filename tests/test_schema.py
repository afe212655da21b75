"""The schema compiler on definition files, and checks of events against a walk in plain Python."""

import json
import random

from emberlog.operators import schema
from emberlog.plans import schemas

FILES = {
    "version.json": {"version": "9"},
    "categories.json": {"attributes": {"system": {"uid": 1}, "network": {"uid": 4}}},
    "dictionary.json": {"attributes": {"state_id": {"type": "integer_t", "enum": {"0": {"caption": "Unknown"}, "1": {"caption": "Up"}}}, "host": {"type": "host"}, "tags": {"type": "string_t", "is_array": True}, "on": {"type": "boolean_t"}}},
    "includes/inner.json": {"attributes": {"on": {"requirement": "required"}, "deep": {"requirement": "required", "type": "long_t"}}},
    "includes/outer.json": {"attributes": {"$include": ["includes/inner.json", "includes/absent.json"], "deep": {"requirement": "recommended"}}},
    "profiles/p.json": {"attributes": {"$include": ["includes/inner.json"], "tags": {"requirement": "required"}}},
    "events/base.json": {"name": "base", "category": "other", "attributes": {"$include": ["includes/outer.json"], "msg": {"requirement": "required"}}},
    "events/sys/one.json": {"name": "one", "extends": "base", "category": "system", "uid": 7, "caption": "One", "attributes": {"$include": ["profiles/p.json"], "host": {"requirement": "required"}, "state_id": {"enum": {"1": {"caption": "Ready"}, "2": {"caption": "Gone"}}}}},
    "events/sys/two.json": {"name": "two", "extends": "one", "uid": 8, "attributes": {"msg": {"type": "json_t", "profile": "p"}, "on": {"requirement": "required"}}},
    "events/stray.json": {"name": "stray", "extends": "nobody", "uid": 3, "attributes": {}},
    "objects/host.json": {"name": "host", "attributes": {"name": {"requirement": "required"}, "parent": {"type": "host"}}},
    "objects/free.json": {"name": "free", "attributes": {}},
    "extensions/win/extension.json": {"name": "win", "uid": 2},
    "extensions/win/dictionary.json": {"attributes": {"on": {"type": "string_t"}, "key": {"type": "free"}}},
    "extensions/win/objects/host.json": {"extends": "host", "attributes": {"sid": {"type": "long_t"}, "name": {"requirement": "optional"}}},
    "extensions/win/events/key.json": {"name": "key_event", "extends": "one", "uid": 9, "attributes": {"key": {}}},
}


def made(spark, tmp_path):
    for path, d in FILES.items():
        (tmp_path / "s p" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "s p" / path).write_text(json.dumps(d, indent=1))
    return schema.compiled(schema.definition_files(spark, f"{tmp_path}/s p")).kept(f"{tmp_path}/kept")


def test_compiled_and_checked(spark, tmp_path):
    s = made(spark, tmp_path)
    assert {(r["class_name"], r["class_uid"], r["caption"], r["category"]) for r in s.classes.collect()} == {("one", 1007, "One", "system"), ("two", 1008, "two", "system"), ("key_event", 201009, "key_event", "system")}
    table = {(r["owner"], r["attribute"]): r for r in s.attributes.collect()}
    get = lambda o, a: (table[o, a]["type"], table[o, a]["requirement"])
    assert get("class:1007", "deep") == ("long_t", "optional") and get("class:1007", "on") == ("boolean_t", "optional")  # a profile makes optional what was inherited
    assert get("class:1008", "on") == ("boolean_t", "required") and get("class:1008", "msg") == ("json_t", "required") and get("class:1007", "msg") == ("string_t", "required")
    assert table["class:1007", "state_id"]["enum"] == {"0": "Unknown", "1": "Ready", "2": "Gone"} and table["class:1007", "tags"]["is_array"] and not table["class:1007", "msg"]["is_array"]
    assert table["class:1007", "host"]["object"] == "host" and table["class:201009", "key"]["object"] == "free" and table["class:1007", "msg"]["object"] is None
    assert get("object:host", "sid") == ("long_t", "optional") and get("object:host", "name") == ("string_t", "optional")
    assert {o for o, _ in table} == {"class:1007", "class:1008", "class:201009", "object:host"}  # no class without a category
    paths = spark.createDataFrame([(1007, "host.parent.sid"), (1007, "host.none"), (1007, "tags"), (1007, "tags[0]"), (1007, "msg.x"), (5, "msg")], "class_uid int, path string")
    assert {(r["path"], r["type"], r["is_array"]) for r in schema.known_path(s, paths).collect()} == {("host.parent.sid", "long_t", False), ("host.none", None, None), ("tags", "string_t", True), ("tags[0]", "string_t", False), ("msg.x", None, None), ("msg", None, None)}

    kinds = {r["class_uid"] for r in s.classes.collect()}
    of = {}
    for (owner, a), r in table.items():
        of.setdefault(owner, {})[a] = r

    def walk(owner, data, prefix, depth):
        attrs = of.get(owner, {})
        yield from (("missing", prefix + a, r["type"]) for a, r in attrs.items() if r["requirement"] == "required" and a not in data and depth <= 2)
        for name, value in data.items():
            if depth == 0 and name in schema.ENVELOPE:
                continue
            r = attrs.get(name)
            if r is None:
                if attrs:
                    yield ("unknown", prefix + name, None)
            elif isinstance(value, dict) and r["object"]:
                yield from walk("object:" + r["object"], value, f"{prefix}{name}.", depth + 1)
            elif (r["type"] in schema.WHOLE and not isinstance(value, int)) or (r["type"] == "boolean_t" and not isinstance(value, bool)):
                yield ("type", prefix + name, r["type"])

    draw = random.Random(5)
    values = [1, 1.5, -3, 10**20, True, None, "x", "7", [], [{"name": 1}], {}, {"name": "n"}]

    def host(n):
        return {k: v for k, v in {"name": "h", "sid": draw.choice(values), "parent": host(n - 1) if n else draw.choice(values), "odd": 1}.items() if draw.random() < 0.7}

    events, want = [], []
    for i in range(400):
        names = ["class_uid", "msg", "deep", "on", "host", "state_id", "tags", "key", "unmapped", "raw_data", "strange"]
        e = {n: draw.choice(values) for n in names if draw.random() < 0.6} | {"class_uid": draw.choice([1007, 1008, 201009, 0, 77])}
        if draw.random() < 0.7:
            e["host"] = host(draw.randrange(6))
        if draw.random() < 0.1:
            del e["class_uid"]
        events.append((i, json.dumps(e)))
        uid = e.get("class_uid", 0)
        want += [(i, "class", "class_uid", None)] if uid and uid not in kinds else [(i, *f) for f in walk(f"class:{uid}", e, "", 0)] if uid else []
    events += [(i, t) for i, t in enumerate([None, "", "[1]", "{", '{"a": 1, "a": 2}', "7"], 1000)]
    want += [(i, "json", "", "object") for i in range(1000, 1006)]
    df = spark.createDataFrame(events, "uid long, event string").repartition(3)
    order = lambda x: sorted(x, key=str)
    want = [w for w in want if w[2] != "class_uid" or w[1] != "unknown"]
    got = [tuple(r) for r in schema.faults(df, s).collect() if (r["kind"], r["path"]) != ("unknown", "class_uid")]
    assert order(got) == order(want) and {w[1] for w in want} == {"missing", "type", "unknown", "class", "json"} and max(w[2].count(".") for w in want) >= 4
    verdict = {r["uid"]: r for r in schema.verdicts(df, s).collect()}
    assert len(verdict) == len(events) and all(verdict[i]["valid"] == all(w[0] != i or w[1] == "unknown" for w in want) for i, _ in events)
    assert verdict[1003]["errors"] == ["unknown json"] and schema.faults(df.filter("uid < 0"), s).count() == 0


def test_repeated_keys_keep_their_faults(spark, tmp_path):
    s = schema.compiled(schemas.definitions(spark)).kept(f"{tmp_path}/k")
    df = spark.createDataFrame([(None, '{"class_uid": 4001}'), (None, '{"class_uid": "4001"}'), (1, '{"class_uid": 0}')], "uid long, event string")
    got = [(r["kind"], r["path"]) for r in schema.faults(df, s).collect()]
    assert sorted(got) == sorted(2 * [("missing", n) for n in ("category_uid", "activity_id", "type_uid", "severity_id", "time", "metadata", "dst_endpoint")] + [("type", "class_uid")])


def test_repeated_names_are_faults_in_any_session(spark, tmp_path):
    s = schema.compiled(schemas.definitions(spark)).kept(f"{tmp_path}/k")
    texts = ['{"class_uid": 0, "a": 1, "a": 2}', '{"class_uid": 0, "a": {"b": [{"c": 1, "c": 1}]}}', '{"class_uid": 0, "\\u0061": 1, "a": 1}', '{"class_uid": 0, "a": "\\": 1, \\"a\\": ", "b" : {"a": "x:"}, "c": ["a", ":", {"a": "\\\\"}]}', '{"class_uid": 0, "": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "uid long, event string")
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    try:
        for allowed in ("true", "false"):  # extractors allow them
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
            assert sorted((r["uid"], r["kind"]) for r in schema.faults(df, s).collect()) == [(0, "json"), (1, "json"), (2, "json")]
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)
