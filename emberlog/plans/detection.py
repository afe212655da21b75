"""Queries of the detection part over the test tables, with their SQL: whole rules, stage rules, sequences and field views."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import correlate, rules, stage_rules, views
from emberlog.operators.extract import prepare
from emberlog.operators.views import Candidate, Dictionary
from emberlog.sources.shared import shared_dir
from emberlog.streaming import streams

AT_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at_ms", F.expr(AT_MS))


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three errors of a user within a day."""
    return correlate.threshold(rows(spark, sf_dir).filter("event_type = 'error'"), "user_id", "at_ms", 3, 86_400_000)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view, then a purchase of the same user within six hours, and an error within another six, all within half a day."""
    fits = [F.col("event_type") == t for t in ("view", "purchase", "error")]
    return correlate.sequence(rows(spark, sf_dir), "user_id", "at_ms", fits, [correlate.Stage()] * 3, window_ms=43_200_000, gap_ms=21_600_000, order=("event_id",))


THRESHOLD_RULE = {
    "ruleId": "busy", "windowMinutes": 2880,
    "stages": [{"conditions": [{"field": "type", "operator": "in", "values": ["ERROR", "click", "signup"]}, {"field": "amount", "operator": "not_lt", "value": 1}], "minOccurrences": 4, "requireDistinctField": "kind", "minDistinctCount": 3}],
}
SEQUENCE_RULE = {
    "ruleId": "path", "ruleFormat": "IR_v1", "window": {"durationSeconds": 86_400}, "maxGapSeconds": 43_200,
    "stages": [
        {"match": {"operator": "OR", "conditions": [{"field": "type", "value": "view"}], "groups": [{"conditions": [{"field": "type", "operator": "startswith", "value": "CL"}, {"field": "amount", "operator": "gte", "value": 2}]}]}},
        {"optional": True, "match": {"conditions": [{"field": "type", "value": "never"}]}},
        {"match": {"conditions": [{"field": "type", "operator": "regex", "value": "^pur.*e$"}, {"field": "third", "operator": "equals_field:stage0.third"}]}},
    ],
}


def stage_fields() -> stage_rules.Fields:
    return stage_rules.Fields(type=F.col("event_type"), amount=F.col("value").cast("string"), kind=F.col("event_type"), third=(F.col("event_id") % 3).cast("string"))


def stage_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_rules.alerts(rows(spark, sf_dir), THRESHOLD_RULE, stage_fields(), "user_id", "at_ms", order=("event_id",))


def stage_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_rules.alerts(rows(spark, sf_dir), SEQUENCE_RULE, stage_fields(), "user_id", "at_ms", order=("event_id",))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a log source see its events only; numbers may be spelt in another way."""
    e = rows(spark, sf_dir)
    fields = {"n": (F.col("event_id") % 300).cast("string"), "type": F.col("event_type")}
    made = {
        "hex": {"detection": {"a": {"n": "0x1F"}, "condition": "a"}},
        "text_only": {"detection": {"a": {"type": "error"}, "condition": "a"}, "logsource": {"category": "process_creation"}},
        "dns": {"detection": {"a": {"type|startswith": "pur"}, "condition": "a"}, "logsource": {"category": "dns_query"}},
    }
    hits = rules.matched(e, made, fields, frozenset(["n"]), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 30))
    return hits.select("event_id", F.explode("alerts").alias("rule"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as typed events that keep their source's fields."""
    e = rows(spark, sf_dir)
    some = lambda name, value, when: F.map_filter(F.create_map(F.lit(name), F.when(when, value)), lambda k, v: v.isNotNull())
    image = F.concat(F.lit("C:\\Apps\\"), "event_type", F.lit(".exe"))
    even, third, fifth = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0
    return e.select(
        "event_id", (F.col("event_id") % 97).alias("case_id"), F.when(fifth, "process_activity").otherwise("file_activity").alias("class_name"),
        F.map_concat(F.create_map(F.lit("src_endpoint.ip"), F.concat(F.lit("10.0.0."), F.col("event_id") % 250)), some("process.file.path", image, even)).alias("attrs"),
        some("custom_key", F.col("event_type"), third).alias("unmapped"), F.create_map(F.lit("src_endpoint.ip"), F.array(F.lit("SrcIp"))).alias("lineage"),
        F.map_concat(F.create_map(F.lit("srcip"), F.concat(F.lit("10.0.0."), F.col("event_id") % 250), F.lit("Image"), image, F.lit("CustomKey"), F.col("event_type")), some("gone", F.lit("x"), fifth)).alias("fields"),
    )


WORDS = Dictionary(event={"Image": [Candidate("process.file.path")], "ImageName": [Candidate("process.file.path", "basename")]}, by_class={"process_activity": {"Address": "src_endpoint.ip"}})
NAMES = ["src_endpoint.ip", "Image", "ImageName", "Address", "CustomKey", "srcip", "gone", "never"]
WATCHED = {
    "errors": {"detection": {"a": {"Image|endswith": "\\error.exe"}, "condition": "a"}},
    "bought": {"detection": {"a": {"CustomKey": "purchase"}, "b": {"srcip|cidr": "10.0.0.0/25"}, "condition": "a and b"}},
}


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.attribution(typed(spark, sf_dir), NAMES, views.EventView(WORDS))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = typed(spark, sf_dir)
    cases = e.select("case_id", F.explode(F.array(*map(F.lit, sorted(WATCHED)))).alias("rule")).distinct().withColumn("expected", expected(F.col("case_id")))
    return views.report(views.verdicts(e, WATCHED, WORDS), cases)


def expected(case: Column) -> Column:
    return case % 2 == 0


PLACES = Dictionary(raw={"src_endpoint.ip": [Candidate("srcip")], "activity_name": [Candidate("CustomKey")]})
REPLAYED = {
    "path": {
        "ruleFormat": "IR_v1", "window": {"durationSeconds": 1_728_000}, "maxGapSeconds": 864_000,
        "stages": [
            {"match": {"conditions": [{"field": "activity_name", "value": "view"}]}},
            {"match": {"operator": "OR", "conditions": [{"field": "src_endpoint.ip", "operator": "equals_field:stage0.src_endpoint.ip"}], "groups": [{"conditions": [{"field": "activity_name", "value": "Purchase"}]}]}},
        ],
    },
    "busy": {"windowMinutes": 14_400, "stages": [{"conditions": [{"field": "activity_name", "operator": "in", "values": ["error", "click", "signup"]}], "minOccurrences": 3, "requireDistinctField": "activity_name", "minDistinctCount": 2}]},
}


def replayed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage rules over both views: a part of the activities and half of the times are only in the source's fields, and some sources name no host."""
    e = rows(spark, sf_dir)
    some = lambda name, value, when: F.map_filter(F.create_map(F.lit(name), F.when(when, value)), lambda k, v: v.isNotNull())
    ip, host = F.concat(F.lit("10.0.0."), F.col("event_id") % 5), F.col("user_id") % 3
    typed_rows = e.select(
        "event_id", (F.col("event_id") % 701).alias("case_id"), F.col("at_ms").alias("time"), F.lit("file_activity").alias("class_name"),
        F.map_concat(F.create_map(F.lit("src_endpoint.ip"), ip, F.lit("device.hostname"), F.concat(F.lit("h"), host)), some("activity_name", F.col("event_type"), F.col("event_id") % 2 == 0)).alias("attrs"),
        some("activity_name", F.col("event_type"), F.col("event_id") % 3 == 0).alias("unmapped"), F.expr("cast(map() as map<string,array<string>>)").alias("lineage"),
        F.map_concat(F.create_map(F.lit("srcip"), ip, F.lit("CustomKey"), F.col("event_type")), some("hostname", F.concat(F.lit("H"), host), F.col("event_id") % 4 != 0), some("UtcTime", F.date_format(F.expr("ts + interval 1 hour"), "yyyy-MM-dd HH:mm:ss"), F.col("event_id") % 2 == 1)).alias("fields"),
    )
    return views.stage_verdicts(typed_rows, REPLAYED, PLACES, order=("event_id",))


def streamed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold and a sequence over the events table read as a stream, to its end; alerts of the last ten minutes are still open.

    The table may be one file, which a stream reads only by a pattern.
    """
    path = f"{sf_dir}/events.parquet"
    prepare(spark)
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("at_ms", F.expr(AT_MS))
    made = {doc["ruleId"]: stage_rules.compiled(doc, stage_fields()) for doc in (THRESHOLD_RULE, SEQUENCE_RULE)}
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = streams.correlated(events, made, {"lane": F.col("user_id")}, "at_ms", "10 minutes", ("event_id",)).writeStream.format("parquet").option("path", f"{folder}/alerts").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("lane string, rule string, at_ms long").parquet(f"{folder}/alerts")


QUERIES = {"replay_stages": replayed_stages, "stream_alerts": streamed_alerts, "corr_threshold": thresholds, "corr_sequence": sequences, "stage_threshold": stage_threshold, "stage_sequence": stage_sequence, "sigma_gated": gated, "view_attribution": attributed, "replay_report": replayed}


def walk(hits: str, start: str, step: str) -> str:
    """SQL that folds each lane's hits (lane, at_ms, rn from 1, ...) with a state: its first value, and the next of ``w`` and ``h``."""
    return f"WITH RECURSIVE h AS ({hits}), walk AS (SELECT DISTINCT lane, CAST(0 AS BIGINT) AS at_ms, CAST(0 AS BIGINT) AS rn, {start}, false AS alert FROM h UNION ALL {step}) SELECT lane, at_ms FROM walk WHERE alert"


def numbered(columns: str, where: str) -> str:
    return f"SELECT CAST(user_id AS VARCHAR) AS lane, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn{columns} FROM events WHERE {where}"


NEXT = "FROM walk w JOIN h ON h.lane = w.lane AND h.rn = w.rn + 1"
ORDERED = "SELECT lane, at_ms, rn, CASE WHEN hit AND s = {last} THEN 0 WHEN hit THEN s + 1 ELSE s END AS stage, CASE WHEN hit AND s = {last} THEN NULL WHEN hit THEN coalesce(b, at_ms) ELSE b END AS began, CASE WHEN hit AND s = {last} THEN NULL WHEN hit THEN at_ms ELSE l END AS late{state}, hit AND s = {last} AS alert FROM (SELECT *, {hit} AS hit FROM (SELECT h.*, CASE WHEN again THEN 0 ELSE w.stage END AS s, CASE WHEN again THEN NULL ELSE w.began END AS b, CASE WHEN again THEN NULL ELSE w.late END AS l{kept} FROM (SELECT w.*, coalesce(h.at_ms - w.began > {window} OR h.at_ms - w.late > {gap}, false) AS again " + NEXT + ") w JOIN h ON h.lane = w.lane AND h.rn = w.rn + 1))"
IMAGE = "'C:\\Apps\\' || event_type || '.exe'"
KIND = {
    "src_endpoint.ip": "'native'", "Image": "CASE WHEN event_id % 2 = 0 THEN 'alias' ELSE 'lost' END", "ImageName": "CASE WHEN event_id % 2 = 0 THEN 'alias' ELSE 'absent' END", "Address": "CASE WHEN event_id % 5 = 0 THEN 'alias' ELSE 'absent' END",
    "CustomKey": "CASE WHEN event_id % 3 = 0 THEN 'unmapped' ELSE 'lost' END", "srcip": "'lineage'", "gone": "CASE WHEN event_id % 5 = 0 THEN 'lost' ELSE 'absent' END", "never": "'absent'",
}
SQL = {
    "corr_threshold": walk(numbered("", "event_type = 'error'"), "CAST([] AS BIGINT[]) AS times", f"SELECT lane, at_ms, rn, CASE WHEN len(t) >= 3 THEN CAST([] AS BIGINT[]) ELSE t END, len(t) >= 3 FROM (SELECT h.lane, h.at_ms, h.rn, list_append(list_filter(w.times, lambda x: h.at_ms - x <= 86400000), h.at_ms) AS t {NEXT})"),
    "corr_sequence": walk(numbered(", CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS fit", "event_type IN ('view', 'purchase', 'error')"), "0 AS stage, CAST(NULL AS BIGINT) AS began, CAST(NULL AS BIGINT) AS late", ORDERED.format(last=2, state="", kept="", hit="fit = s", window=43_200_000, gap=21_600_000)),
    "stage_threshold": walk(numbered(", event_type AS kind", "event_type IN ('error', 'click', 'signup') AND value >= 1"), "CAST([] AS STRUCT(t BIGINT, v VARCHAR)[]) AS held", f"SELECT lane, at_ms, rn, CASE WHEN enough THEN CAST([] AS STRUCT(t BIGINT, v VARCHAR)[]) ELSE held END, enough FROM (SELECT *, len(held) >= 4 AND len(list_distinct(list_transform(held, lambda x: x.v))) >= 3 AS enough FROM (SELECT h.lane, h.at_ms, h.rn, list_append(list_filter(w.held, lambda x: h.at_ms - x.t <= 172800000), {{'t': h.at_ms, 'v': h.kind}}) AS held {NEXT}))"),
    "stage_sequence": walk(numbered(", event_type = 'view' OR event_type LIKE 'cl%' AND value >= 2 AS opens, event_type = 'purchase' AS buys, event_id % 3 AS third", "event_type = 'view' OR event_type LIKE 'cl%' AND value >= 2 OR event_type = 'purchase'"), "0 AS stage, CAST(NULL AS BIGINT) AS began, CAST(NULL AS BIGINT) AS late, CAST(NULL AS BIGINT) AS first", ORDERED.format(last=1, state=", CASE WHEN hit AND s = 0 THEN third WHEN hit THEN NULL ELSE f END AS first", kept=", CASE WHEN again THEN NULL ELSE w.first END AS f", hit="CASE WHEN s = 0 THEN opens ELSE coalesce(buys AND third = f, false) END", window=86_400_000, gap=43_200_000)),
    "sigma_gated": "SELECT event_id, 'hex' AS rule FROM events WHERE event_id % 300 = 31 UNION ALL SELECT event_id, 'text_only' FROM events WHERE event_type = 'error' AND (event_id % 4 = 0 OR event_id % 30 = 1) UNION ALL SELECT event_id, 'dns' FROM events WHERE event_type LIKE 'pur%' AND (event_id % 4 = 0 OR event_id % 30 = 22)",
    "view_attribution": "SELECT name, kind, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, {kind} AS kind FROM events" for name, kind in KIND.items()) + ") GROUP BY ALL",
    "replay_report": "WITH e AS (SELECT event_id % 97 AS case_id, event_id % 2 = 0 AS even, event_id % 3 = 0 AS third, event_type = 'error' AS err, event_type = 'purchase' AND event_id % 250 < 128 AS buy FROM events), f AS (SELECT case_id, case_id % 2 = 0 AS expected, bool_or(err) AS raw, bool_or(err AND even) AS native, bool_or(err AND even) AS whole FROM e GROUP BY 1, 2 UNION ALL SELECT case_id, case_id % 2 = 0, bool_or(buy), false, bool_or(buy AND third) FROM e GROUP BY 1, 2), v AS (SELECT 'native' AS view, expected, raw, native AS verdict FROM f UNION ALL SELECT 'whole', expected, raw, whole FROM f) SELECT view, count(*) AS cases, CAST(count_if(verdict = raw) AS BIGINT) AS kept, CAST(count_if(raw = expected) AS BIGINT) AS oracle_correct, CAST(count_if(verdict = expected) AS BIGINT) AS correct, CAST(count_if(verdict AND expected) AS BIGINT) AS detected, CAST(count_if(NOT verdict AND NOT expected) AS BIGINT) AS silent, CAST(count_if(raw AND NOT verdict) AS BIGINT) AS lost, CAST(count_if(NOT raw AND verdict) AS BIGINT) AS false_alerts FROM v GROUP BY view",
}
CUT = "WHERE at_ms <= (SELECT max(epoch_us(ts) // 1000) FROM events) - 600000"
SQL["stream_alerts"] = f"SELECT lane, 'busy' AS rule, at_ms FROM ({SQL['stage_threshold']}) {CUT} UNION ALL SELECT lane, 'path' AS rule, at_ms FROM ({SQL['stage_sequence']}) {CUT}"
SQL["replay_stages"] = """
WITH RECURSIVE e AS (
  SELECT event_id, event_id % 701 AS case_id, event_type, event_id % 5 AS ip, user_id % 3 AS host,
    CASE WHEN event_id % 2 = 1 THEN epoch_us(date_trunc('second', ts)) // 1000 + 3600000 ELSE epoch_us(ts) // 1000 END AS t FROM events),
h AS (
  SELECT 'raw' AS view, case_id, CASE WHEN event_id % 4 <> 0 THEN 'h' || host ELSE '_' END AS lane, t, event_id, event_type AS kind, ip FROM e
  UNION ALL SELECT 'native', case_id, 'h' || host, t, event_id, CASE WHEN event_id % 2 = 0 THEN event_type END, ip FROM e
  UNION ALL SELECT 'whole', case_id, 'h' || host, t, event_id, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN event_type END, ip FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY view, case_id, lane ORDER BY t, event_id) AS rn FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY view, case_id, lane ORDER BY t, event_id) AS rn FROM h WHERE kind IN ('error', 'click', 'signup')),
path AS (
  SELECT DISTINCT view, case_id, lane, CAST(0 AS BIGINT) AS rn, false AS open, CAST(0 AS BIGINT) AS began, CAST(NULL AS BIGINT) AS first, false AS alert FROM p
  UNION ALL
  SELECT view, case_id, lane, rn, CASE WHEN still THEN NOT passes ELSE opens END, CASE WHEN still THEN began ELSE t END, CASE WHEN still THEN first ELSE ip END, still AND passes FROM (
    SELECT p.view, p.case_id, p.lane, p.rn, w.began, w.first, p.t, p.ip, coalesce(p.kind = 'view', false) AS opens, w.open AND p.t - w.began <= 864000000 AS still, p.ip = w.first OR coalesce(p.kind = 'purchase', false) AS passes
    FROM path w JOIN p ON p.view = w.view AND p.case_id = w.case_id AND p.lane = w.lane AND p.rn = w.rn + 1)),
busy AS (
  SELECT DISTINCT view, case_id, lane, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(t BIGINT, v VARCHAR)[]) AS held, false AS alert FROM b
  UNION ALL
  SELECT view, case_id, lane, rn, CASE WHEN enough THEN [] ELSE held END, enough FROM (SELECT *, len(held) >= 3 AND len(list_distinct(list_transform(held, lambda x: x.v))) >= 2 AS enough FROM (
    SELECT b.view, b.case_id, b.lane, b.rn, list_append(list_filter(w.held, lambda x: b.t - x.t <= 864000000), {'t': b.t, 'v': b.kind}) AS held
    FROM busy w JOIN b ON b.view = w.view AND b.case_id = w.case_id AND b.lane = w.lane AND b.rn = w.rn + 1))),
alerts AS (SELECT case_id, 'path' AS rule, view FROM path WHERE alert UNION ALL SELECT case_id, 'busy', view FROM busy WHERE alert)
SELECT case_id, rule, bool_or(view = 'raw') AS raw, bool_or(view = 'native') AS native, bool_or(view = 'whole') AS whole FROM alerts GROUP BY case_id, rule
"""
