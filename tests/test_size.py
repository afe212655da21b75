"""Work that must stay small: plans don't grow with how often a value is used."""

import hashlib

from pyspark.sql import functions as F

from emberlog.operators import extract, ledger
from emberlog.operators.packs import Registry
from emberlog.plans.library import library
from emberlog.plans.normalize import normalize


def nodes(column, spark):
    plan = spark.range(1).select(F.lit("x").alias("raw")).select(column.alias("f"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().numberedTreeString().count("\n")


def test_a_header_is_worked_out_once(spark):
    extract.prepare(spark)
    assert nodes(extract.syslog(F.col("raw"), {}), spark) < 600
    lines = spark.createDataFrame([("<14>1 - h - - - [a b=\"c\"] m",), ("<13>Jan  2 03:04:05 h app[7]: did it",), ("app: x",), (None,)], "raw string")
    got = [r["f"] for r in lines.select(extract.syslog(F.col("raw"), {}).alias("f")).collect()]
    assert got[0] == {"syslog_pri": "14", "syslog_facility": "1", "syslog_severity": "6", "syslog_host": "h", "sd.a.b": "c", "message": "m", "syslog_format": "rfc5424"}
    assert got[1] == {"syslog_pri": "13", "syslog_facility": "1", "syslog_severity": "5", "syslog_timestamp": "Jan  2 03:04:05", "syslog_host": "h", "syslog_app": "app", "syslog_procid": "7", "message": "did it", "syslog_format": "rfc3164"}
    assert got[2:] == [{"syslog_app": "app", "message": "x", "syslog_format": "rfc3164"}, None]


def test_a_csv_row_is_worked_out_once(spark):
    """What picks a row's columns isn't worked out again for each cell."""
    extract.prepare(spark)
    options = {"columns": ["n", "kind"], "columns_by": {"index": 1, "append": True, "map": {"A": ["a", "_skip"], "B": ["b"], "default": ["d"]}}}
    column = extract.csv(F.col("raw"), options)
    plan = spark.range(1).select(F.lit("x").alias("raw")).select(column.alias("f"))._jdf.queryExecution().analyzed()
    assert plan.expressions().head().toString().count("regexp_extract_all") == 1
    lines = spark.createDataFrame([('1,A,"x,""y""",z,w',), ("2,B,x,,w",), ("3,C,x",), ("4",), (None,)], "raw string")
    got = [r["f"] for r in lines.select(column.alias("f")).collect()]
    assert got == [{"n": "1", "kind": "A", "a": 'x,"y"', "_col4": "w"}, {"n": "2", "kind": "B", "b": "x", "_col4": "w"}, {"n": "3", "kind": "C", "d": "x"}, {"n": "4"}, None]


def test_a_batch_builds_its_tree_once(spark):
    """Paths come from the tree of their batch, also of batches that aren't full: no hash stands above the row of each leaf."""
    leaves = spark.createDataFrame([("a", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(256 + 11)], "shard string, seq long, leaf string")
    proofs = ledger.proofs(leaves)
    above, generate, below = proofs._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")
    assert generate and "sha2" not in above and "sha2" in below

    def parent(a, b):
        return hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()

    levels = [[r["leaf"] for r in leaves.orderBy("seq").collect()[256:]]]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([parent(*last[i : i + 2]) if i + 1 < len(last) else last[i] for i in range(0, len(last), 2)])
    for r in proofs.filter("batch_id = 1").collect():
        i, want = r["seq"] - 256, []
        for level in levels[:-1]:
            if (i ^ 1) < len(level):
                want.append((bool(i % 2), level[i ^ 1]))
            i //= 2
        assert [(p["left"], p["digest"]) for p in r["path"]] == want and r["leaf"] == levels[0][r["seq"] - 256]


def test_specs_stay_where_they_are(spark):
    """Between the steps of a mapping only values go along, one text or result for each spec: no step copies the specs."""
    made = Registry.of(library).compiled[0]
    rows = spark.createDataFrame([], "pack_no int, rule_no int, fields map<string,string>, used array<string>, failure string")
    held = rows.join(made.rules(spark), ["pack_no", "rule_no"]).withColumns({"_now": F.lit(0), "fields_filled": F.col("fields"), "fields_present": F.col("fields")})
    for columns in made._values():
        held = held.withColumns(columns)
        for name in columns:
            assert "pattern" not in held.schema[name].dataType.simpleString() and "slice(" not in str(columns[name])


def test_events_by_field_names_are_worked_out_once(spark):
    """The matching of names is staged with its result: what reads the events doesn't join again."""
    lines = spark.createDataFrame([("ts=2024-01-01T00:00:00Z fw=f1 src_ip=10.0.0.1 src_port=5 rule=1",)], "raw string")
    events = normalize(lines, Registry.of(library), now_ms=0)[0].select("src_ip", "src_port", "pack")
    assert "Join" not in events._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in events.collect()] == [("10.0.0.1", 5, None)]
