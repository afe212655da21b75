"""Engine pieces against plain Python."""

import hashlib

from pyspark.sql import functions as F

from emberlog.functions.network import canonical_ip, in_network
from emberlog.functions.text import snake
from emberlog.operators import correlate, detect, extract, lineage
from emberlog.plans.normalize import normalize


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_kv_keeps_empty_values_and_the_last_of_repeats(spark):
    extract.prepare(spark)
    assert one(spark, extract.kv(F.lit('a= b=1 c="x y" b=2'), {})) == {"a": "", "b": "2", "c": "x y"}


def test_json_flattens_objects_and_keeps_lists(spark):
    extract.prepare(spark)
    assert one(spark, extract.json(F.lit('{"a":{"b":1},"l":[1,2],"n":null}'), {})) == {"a.b": "1", "l": "[1,2]"}
    assert one(spark, extract.json(F.lit("not json"), {})) is None


def test_ip_forms(spark):
    assert one(spark, canonical_ip(F.lit("[2001:DB8:0:0:0:0:0:1]"))) == "2001:db8::1"
    assert one(spark, canonical_ip(F.lit("1.2.3.400"))) is None
    assert one(spark, in_network(F.lit("10.0.70.1"), "10.0.64.0/18"))


def test_snake(spark):
    assert one(spark, snake(F.lit("fooBar Id"))) == "foo_bar_id"


def test_wildcards_and_null(spark):
    assert one(spark, detect.value(F.lit("C:\\a*b"), "c:\\\\a\\*?"))
    assert not one(spark, detect.value(F.lit(None).cast("string"), "*x"))
    assert one(spark, detect.value(F.lit(""), None))


def test_merkle_roots_of_odd_and_single_batches(spark):
    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]

    def fold(level):
        while len(level) > 1:
            level = [hashlib.sha256(b"\x01" + bytes.fromhex(level[i]) + bytes.fromhex(level[i + 1])).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    df = spark.createDataFrame(list(enumerate(leaves)), "seq long, leaf string")
    got = {r["batch_id"]: r["merkle_root"] for r in lineage.batches(df, "seq", "leaf", 4).collect()}
    assert got == {0: fold(leaves[:4]), 1: leaves[4]}


def test_threshold_is_inclusive_and_forgets(spark):
    hits = spark.createDataFrame([("a", t) for t in (0, 5, 10, 11, 12, 13)] + [("b", 0), ("b", 11), ("b", 22)], "lane string, t long")
    assert sorted(map(tuple, correlate.threshold(hits, "lane", "t", 3, 10).collect())) == [("a", 10), ("a", 13)]


def test_all_candidates_are_tried(spark):
    packs = [{"id": i, "version": "1.0", "match": {"contains": ["k="]}, "parse": [{"type": kind}], "classes": [{"name": "all", "class": "network_activity"}]} for i, kind in (("a", "json"), ("b", "json"), ("c", "json"), ("d", "kv"))]
    lines = spark.createDataFrame([("k=1 src=10.0.0.1",)], "raw string")
    assert [r["pack"] for r in normalize(lines, packs, now_ms=0)[0].select("pack").collect()] == ["d@1.0"]
