"""Common tokens and votes of clusters against plain Python."""

import random
import re

from pyspark.sql import functions as F

from emberlog.operators import drafts, mapper


def test_common_tokens(spark):
    rows = [("a", "kv", "alpha=1 be=2 x=3"), ("a", "kv", "be=5 alpha=2 y=1"), ("b", "json", '{"host": 1, "user":2}'), ("b", "json", '{"user": 3, "hosts":2}'), ("c", "cef", "x CEF:0|Acme|Gate|1"), ("c", "cef", "no mark"), ("d", "cef", "CEF:0|A|B|1"), ("d", "cef", "CEF:0|A|C|1"),
            ("e", "text", "<13>Jan session opened 10:20 by root"), ("e", "text", "Jan, session closed opened x"), ("f", "text", "word"), ("f", "text", ""), ("g", "kv", None), (None, None, "some words here"), (None, None, "words some")]
    got = {}
    for r in drafts.common_tokens(spark.createDataFrame(rows, "cluster string, format string, raw string")).orderBy("rank").collect():
        got.setdefault(r["cluster"], []).append(r["token"])
    assert got == {"a": ["alpha=", "be="], "b": ['"user"'], "c": ["CEF:0|Acme|Gate"], "e": ["session", "opened"]} | ({None: ["words", "some"]} if None in got else {})


def test_votes(spark):
    draw = random.Random(3)
    names = ["src", "dst", "dport", "user", "msg", "status", "act", "noise"]
    values = {"src": "10.0.0.1", "dst": "10.0.0.2", "dport": "443", "user": "bob", "msg": "hello", "status": "200", "act": "deny", "noise": "zz"}
    rows = [(i, "pq"[i % 2], {n: values[n] for n in names if draw.random() < (0.7 if i % 2 else 0.45)}) for i in range(80)]
    df = spark.createDataFrame(rows, "row long, cluster string, fields map<string,string>")
    matches = {}
    for r in mapper.matched(df).collect():
        matches.setdefault(r["row"], {})[r["path"]] = r["raw"]
    want = {}
    for c in "pq":
        mine = [i for i, k, _ in rows if k == c]
        counts = {}
        for i in mine:
            for path, raw in matches.get(i, {}).items():
                counts.setdefault(path, {}).setdefault(raw, 0)
                counts[path][raw] += 1
        best = sorted((-max(v.values()), path, min(raw for raw, n in v.items() if n == max(v.values()))) for path, v in counts.items())
        used = set()
        for n, path, raw in best:  # the attribute with the most lines chooses first
            if -n / len(mine) >= 0.5 and raw not in used:
                used.add(raw)
                want[c, path] = (raw, -n)
    got = drafts.votes(df).collect()
    assert {(r["cluster"], r["path"]): (r["raw"], r["support"]) for r in got if r["path"]} == want and len(want) >= 4
    assert {r["cluster"]: r["class_name"] for r in got}.keys() == {"p", "q"} and all(re.fullmatch("[a-z_]+", r["class_name"]) for r in got)
    assert drafts.votes(df.limit(0)).collect() == [] == drafts.common_tokens(df.limit(0).select("cluster", F.lit("kv").alias("format"), F.lit("x").alias("raw"))).collect()
