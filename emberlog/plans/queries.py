"""Queries over the test tables: lines are rendered from columns, the engine reads them back, and the SQL takes the columns as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.coerce import to_boolean, to_integer
from emberlog.functions.text import snake
from emberlog.functions.timestamps import epoch_ms
from emberlog.operators import detect, drafts, extract, guard, ledger, lineage, mining, rules
from emberlog.operators.sniff import sniffed
from emberlog.plans import detection, schemas, store, vendors
from emberlog.plans.normalize import normalize
from emberlog.plans.sealing import Ledger
from emberlog.sources import sinks
from emberlog.sources.shared import shared_dir

KV = "concat('<189>date=2024-01-01 time=00:00:01 devname=\"fw 1\" devid=\"FG1\" logid=\"0000000013\" type=\"traffic\" subtype=\"forward\" level=\"notice\" srcip=10.0.', event_id % 200, '.', user_id % 200, ' srcport=', 1024 + event_id % 5000, ' dstip=192.0.2.', event_id % 9, ' dstport=443 proto=6 action=\"', CASE WHEN event_type = 'error' THEN 'deny' ELSE 'accept' END, '\" user=\"u ', user_id, '\" sentbyte=', event_id, ' empty= note=\"', event_type, '\"')"
CEF = "concat('CEF:0|Acme|Gate \\\\| One|1.0|', event_id % 7, '|', event_type, '|5|src=10.1.0.', user_id % 250, ' spt=', 1000 + event_id % 100, ' msg=it was ', event_type, ' here act=', event_type)"
LEEF = "concat('LEEF:1.0|Acme|Gate|1.0|', event_type, '|', concat_ws('\t', concat('src=10.2.0.', user_id % 250), concat('usrName=u', user_id), concat('sev=', event_id % 10)))"
SYSLOG = "concat('<', event_id % 190, '>Jan  2 03:04:05 host', user_id % 20, ' app[', event_id, ']: did ', event_type)"


def rows(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    extract.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """event_id and the line rendered from each event."""
    return rows(spark, sf_dir).select("event_id", F.expr(expression).alias("raw"))


def got(fields: str, name: str, alias: str | None = None) -> Column:
    return F.try_element_at(fields, F.lit(name)).alias(alias or name)


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: raw firewall lines to events, and what they come to by pack, class, source net and activity."""
    events, _ = normalize(lines(spark, sf_dir, KV), now_ms=1_704_153_600_000)
    return events.groupBy("pack", "class_name", F.regexp_extract("src_ip", r"^(\d+\.\d+\.\d+)\.", 1).alias("net")).agg(F.count("*").alias("n"), F.min("src_port").alias("min_port"), F.max("dst_port").alias("max_dst_port"), F.count_if("valid").alias("n_valid"))


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lines(spark, sf_dir, KV).withColumn("f", extract.kv(F.col("raw"), {}))
    return f.select("event_id", got("f", "devname"), got("f", "srcip"), got("f", "user", "user_name"), got("f", "empty"), got("f", "note"), got("f", "sentbyte"))


def cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lines(spark, sf_dir, CEF).withColumn("f", extract.cef(F.col("raw"), {}))
    return f.select("event_id", got("f", "src"), got("f", "spt"), got("f", "msg"), got("f", "act"))


def leef(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lines(spark, sf_dir, LEEF).withColumn("f", extract.leef(F.col("raw"), {}))
    return f.select("event_id", got("f", "src"), got("f", "usrName", "usr_name"), got("f", "sev"))


def syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lines(spark, sf_dir, SYSLOG).withColumn("f", extract.syslog(F.col("raw"), {}))
    return f.select("event_id", got("f", "message"), got("f", "syslog_facility", "facility"), got("f", "syslog_severity", "severity"))


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).withColumn("f", extract.json(F.col("props"), {})).select("event_id", got("f", "k"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"CASE event_id % 4 WHEN 0 THEN {KV} WHEN 1 THEN {LEEF} WHEN 2 THEN props ELSE {SYSLOG} END"
    return sniffed(lines(spark, sf_dir, line)).select("event_id", F.col("sniffed.format").alias("format"))


def oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, "documents")
    return d.groupBy(guard.rejection(F.col("text"), max_bytes=4096).isNotNull().alias("rejected")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rows(spark, sf_dir).withColumn("s", F.expr("CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 1 THEN date_format(ts, \"dd/MMM/yyyy:HH:mm:ss '+0000'\") ELSE cast(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS string) END"))
    return e.select("event_id", epoch_ms(F.col("s")).alias("ms"))


def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rows(spark, sf_dir)
    hexed = to_integer(F.concat(F.lit("0x"), F.hex("event_id")))
    return e.select("event_id", hexed.alias("n"), to_integer(F.col("value").cast("string")).alias("whole"), to_boolean(F.when(F.col("event_type") == "error", F.lit("No")).otherwise("yes")).alias("flag"))


def snakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", snake(F.concat(F.lit("Src"), F.initcap("event_type"), F.lit(" Id"))).alias("name"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rows(spark, sf_dir)
    return e.select("event_id", lineage.leaf(F.sha2("event_type", 256), F.sha2("props", 256)).alias("leaf"))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.batches(leaves(spark, sf_dir), "event_id", "leaf")


def sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One count for each kind of value test."""
    e = rows(spark, sf_dir).withColumn("ip", F.concat(F.lit("10.0."), F.col("event_id") % 256, F.lit("."), F.col("user_id") % 256))
    f = {"type": F.col("event_type"), "ip": F.col("ip"), "value": F.col("value").cast("string"), "props": F.col("props")}
    rules = {"wild": {"type": "?I*W"}, "cidr": {"ip|cidr": "10.0.64.0/18"}, "all_of": {"type|contains|all": ["R", "o"]}, "pattern": {"props|re": '"k": 1[0-9]}'}, "number": {"value|gte": 10}, "either": {"type|endswith": ["CK", "se"]}}
    return e.agg(*[F.count_if(detect.selection(f, doc)).alias(name) for name, doc in rules.items()])


def by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_class(stored(spark, sf_dir))


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the newest hundred of a filter."""
    return store.newest(store.found(stored(spark, sf_dir), pack="purchase", severity_min=2), 100).select("seq", "uid")


FAILURES = "concat('user ', user_id, ' ', event_type, ' from 10.1.', event_id % 250, '.7 port ', event_id)"


def rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each whole rule fits."""
    e = rows(spark, sf_dir)
    fields = {"type": F.col("event_type"), "value": F.col("value").cast("string"), "props": F.col("props")}
    made = {
        "loud_errors": {"detection": {"sel_a": {"type": "error"}, "sel_b": {"value|gte": 10}, "skip": {"props|contains": '"k": 1'}, "condition": "all of sel_* and not skip"}},
        "either": {"detection": {"a": {"type|startswith": "pur"}, "b": [{"value|lt": 1}, {"type": "cl?ck"}], "condition": "1 of them"}},
        "words": {"detection": {"keywords": ["SIGN", "err*r"], "condition": ["keywords and not keywords", "keywords"]}},
    }
    return rules.matched(e, made, fields).select(F.explode("alerts").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def chain_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rows(spark, sf_dir)
    return e.select((F.col("event_id") % 4).cast("string").alias("shard"), F.expr("event_id div 4").alias("seq"), lineage.leaf(F.sha2("event_type", 256), F.sha2("props", 256)).alias("leaf"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.chained(ledger.batches(chain_leaves(spark, sf_dir)))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of a kept ledger after three appends, of which the second is repeated, with batches that wait from one to the next."""
    kept = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    leaves = chain_leaves(spark, sf_dir)
    third = (F.col("seq") % 3000 >= 1000).cast("int") + (F.col("seq") % 3000 >= 2000).cast("int")
    cut = leaves.withColumn("third", third)
    for number in (0, 1, 1, 2):
        kept.append(cut.filter(F.col("third") == number), number, ("seq",), close=number == 2)
    return kept.chain()


def full_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of events: altered texts, altered fields, altered leaves, and a shard whose head isn't signed."""
    made = rows(spark, sf_dir).select((F.col("event_id") % 4).cast("string").alias("shard"), F.expr("event_id div 4").alias("seq"), F.sha2("event_type", 256).alias("raw_sha256"), F.sha2("props", 256).alias("norm_sha256"))
    stored_rows = made.withColumn("leaf", lineage.leaf(F.col("raw_sha256"), F.col("norm_sha256")))
    chain_ = ledger.chained(ledger.batches(stored_rows))
    now = made.withColumns({"raw_sha256": F.when(F.col("seq") % 50 == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("raw_sha256")), "norm_sha256": F.when(F.col("seq") % 70 == 5, F.sha2(F.lit("y"), 256)).otherwise(F.col("norm_sha256"))})
    now = now.withColumn("leaf", lineage.leaf(F.col("raw_sha256"), F.col("norm_sha256")))
    signer, signed = ledger.Signer(spark), []
    for head in ledger.heads(chain_).collect():  # one row a shard
        signature = signer.sign(head["head"])
        signed.append((head["shard"], signer.verify(head["head"] if head["shard"] != "2" else "00" * 32, signature)))
    return ledger.verified(now, ledger.proofs(stored_rows), chain_, stored_rows, spark.createDataFrame(signed, "shard string, signed boolean"))


def chain_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's leaf against its proof, its batch and the chain; every hundredth event is altered first."""
    leaves = chain_leaves(spark, sf_dir)
    tampered = leaves.withColumn("leaf", F.when(F.col("seq") % 100 == 7, F.sha2("leaf", 256)).otherwise(F.col("leaf")))
    return ledger.verified(tampered, ledger.proofs(leaves), ledger.chained(ledger.batches(leaves)))


def mined_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of lines of 75 buckets: 25 units, and messages of three lengths."""
    e = rows(spark, sf_dir)
    unit = F.concat(F.lit("unit "), F.chr(97 + F.col("event_id") % 25))
    tail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" took "), "event_id", F.lit(" ms on 10.1.2."), F.col("user_id") % 250, F.lit(" for "), "event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" closed by "), F.lit("00:1b:44:11:3a:b"), F.col("user_id") % 10)).otherwise(F.lit(" is up and running now"))
    return mining.templates(e.select(F.concat(unit, tail).alias("raw")))


def shared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of each user have in common: names of pairs, of which some are left out of some lines."""
    e = rows(spark, sf_dir)
    raw = F.concat(F.lit("stamp="), "event_id", F.when(F.col("event_id") % 7 < 6 - F.col("user_id") % 7, F.lit(" longest_name=x")).otherwise(""), F.lit(" kind="), "event_type", F.when(F.col("user_id") % 3 > 0, F.lit(" weight=1")).otherwise(""))
    return drafts.common_tokens(e.select(F.col("user_id").alias("cluster"), F.lit("kv").alias("format"), raw.alias("raw")))


def agreed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that the lines of a group of users agree on: a third of the lines have no address, most have no target."""
    e = rows(spark, sf_dir)
    some = lambda name, value, when: F.map_filter(F.create_map(F.lit(name), F.when(when, value)), lambda k, v: v.isNotNull())
    fields = F.map_concat(F.create_map(F.lit("message"), F.concat(F.lit("it was "), "event_type"), F.lit("zz_other"), F.lit("1")), some("src_ip", F.lit("10.0.0.1"), F.col("event_id") % 3 > 0), some("dst_port", F.lit("443"), F.col("event_id") % 5 == 0))
    return drafts.votes(e.select((F.col("user_id") % 10).alias("cluster"), F.col("event_id").alias("row"), fields.alias("fields"))).drop("score")


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.templates(lines(spark, sf_dir, FAILURES))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the columns of stored events."""
    e = rows(spark, sf_dir)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("uid"), F.expr("event_id % 7").alias("severity_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("pack"), F.expr("round(value, 2)").alias("confidence"), (F.col("event_id") % 3 > 0).alias("valid"), F.col("event_id").alias("time"), F.concat(F.lit("class|"), "event_type").alias("type_name"), F.col("event_type").alias("class_name"), (F.col("event_id") % 5).alias("type_uid"), F.concat(F.lit("10.0.0."), F.col("event_id") % 250).alias("src_ip"), F.create_map(F.lit("message"), F.concat(F.lit("a=b "), "props")).alias("attrs"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.found(stored(spark, sf_dir), severity_min=3, valid=True, since=100, fallback=False).select("seq", "pack", "severity_id")


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(stored(spark, sf_dir)).select("uid", "seq", "class_name", "src_ip")


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_pack(stored(spark, sf_dir)).select("pack", "n", F.round("avg_confidence", 3).alias("avg_confidence"), F.round("valid_ratio", 4).alias("valid_ratio"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counters(stored(spark, sf_dir), rows(spark, sf_dir, "documents").filter(guard.rejection(F.col("text"), max_bytes=4096).isNotNull()))


def cef_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(spark, sf_dir)
    return e.select(F.col("seq").alias("event_id"), sinks.cef_line(e).alias("line"))


QUERIES = {
    "normalize_traffic": traffic, "extract_kv": kv, "extract_cef": cef, "extract_leef": leef, "extract_syslog": syslog, "extract_json": json, "sniff_formats": formats, "guard_oversize": oversize,
    "cast_timestamps": stamps, "cast_values": casts, "snake_names": snakes, "leaf_hash": leaves, "merkle_root": roots, "sigma_values": sigma, "summary_by_class": by_class, "events_newest": newest,
    "sigma_rules": rule_alerts, "ledger_chain": chain, "ledger_verify": chain_checks, "ledger_append": appended, "ledger_verify_all": full_checks, "mine_templates": mined, "store_filter": found, "store_latest": latest, "store_by_pack": packs, "store_counters": counts, "sink_cef": cef_out,
}
LEVEL = "l{k} AS (SELECT batch_id, pos // 2 AS pos, CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(min_by(leaf, pos)) || unhex(max_by(leaf, pos))) ELSE min(leaf) END AS leaf FROM l{j} GROUP BY ALL)"
LEAF = "SELECT event_id, sha256(unhex('00') || unhex(sha256(event_type)) || unhex(sha256(props))) AS leaf FROM events"
CHAIN_ROOTS = "l0 AS (SELECT CAST(event_id % 4 AS VARCHAR) AS shard, event_id // 4 // 256 AS batch_id, event_id // 4 % 256 AS pos, leaf FROM (" + LEAF + ")), " + ", ".join(LEVEL.format(k=k + 1, j=k).replace("SELECT batch_id", "SELECT shard, batch_id") for k in range(8)) + ", roots AS (SELECT l8.shard, l8.batch_id, n.count, leaf AS merkle_root FROM l8 JOIN (SELECT shard, batch_id, count(*) AS count FROM l0 GROUP BY ALL) n ON l8.shard = n.shard AND l8.batch_id = n.batch_id)"
SQL = {
    "normalize_traffic": "SELECT 'fortinet.fortigate@1.0' AS pack, 'network_activity' AS class_name, '10.0.' || (event_id % 200) AS net, count(*) AS n, min(1024 + event_id % 5000) AS min_port, CAST(443 AS BIGINT) AS max_dst_port, count(*) AS n_valid FROM events GROUP BY ALL",
    "extract_kv": "SELECT event_id, 'fw 1' AS devname, '10.0.' || event_id % 200 || '.' || user_id % 200 AS srcip, 'u ' || user_id AS user_name, '' AS empty, event_type AS note, CAST(event_id AS VARCHAR) AS sentbyte FROM events",
    "extract_cef": "SELECT event_id, '10.1.0.' || user_id % 250 AS src, CAST(1000 + event_id % 100 AS VARCHAR) AS spt, 'it was ' || event_type || ' here' AS msg, event_type AS act FROM events",
    "extract_leef": "SELECT event_id, '10.2.0.' || user_id % 250 AS src, 'u' || user_id AS usr_name, CAST(event_id % 10 AS VARCHAR) AS sev FROM events",
    "extract_syslog": "SELECT event_id, 'did ' || event_type AS message, CAST(event_id % 190 // 8 AS VARCHAR) AS facility, CAST(event_id % 190 % 8 AS VARCHAR) AS severity FROM events",
    "extract_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "sniff_formats": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'kv' WHEN 1 THEN 'leef' WHEN 2 THEN 'json' ELSE 'syslog' END AS format FROM events",
    "guard_oversize": "SELECT coalesce(strlen(text) > 4096, false) AS rejected, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "cast_timestamps": "SELECT event_id, CAST(epoch_us(ts) // 1000000 * 1000 AS BIGINT) AS ms FROM events",
    "cast_values": "SELECT event_id, event_id AS n, CAST(trunc(value) AS BIGINT) AS whole, event_type <> 'error' AS flag FROM events",
    "snake_names": "SELECT event_id, 'src_' || event_type || '_id' AS name FROM events",
    "leaf_hash": LEAF,
    "merkle_root": f"WITH l0 AS (SELECT event_id // 256 AS batch_id, event_id % 256 AS pos, leaf FROM ({LEAF})), " + ", ".join(LEVEL.format(k=k + 1, j=k) for k in range(8)) + ", n AS (SELECT batch_id, count(*) AS count FROM l0 GROUP BY 1) SELECT batch_id, count, leaf AS merkle_root FROM l8 JOIN n USING (batch_id)",
    "sigma_values": "SELECT count_if(event_type ILIKE '_i%w') AS wild, count_if(event_id % 256 BETWEEN 64 AND 127) AS cidr, count_if(event_type LIKE '%r%' AND event_type LIKE '%o%') AS all_of, count_if(regexp_matches(props, '\"k\": 1[0-9]}')) AS pattern, count_if(value >= 10) AS number, count_if(event_type LIKE '%ck' OR event_type LIKE '%se') AS either FROM events",
    "summary_by_class": "SELECT event_type AS class_name, count(*) AS n FROM events GROUP BY 1",
    "events_newest": "SELECT event_id AS seq, user_id AS uid FROM events WHERE event_type = 'purchase' AND event_id % 7 >= 2 ORDER BY event_id DESC LIMIT 100",
    "sigma_rules": "SELECT 'loud_errors' AS rule, count(*) AS n FROM events WHERE event_type = 'error' AND value >= 10 AND NOT contains(props, '\"k\": 1') HAVING count(*) > 0 UNION ALL SELECT 'either', count(*) FROM events WHERE event_type LIKE 'pur%' OR value < 1 OR event_type = 'click' HAVING count(*) > 0 UNION ALL SELECT 'words', count(*) FROM events WHERE contains(event_type, 'sign') OR contains(event_type, 'error') HAVING count(*) > 0",
    "ledger_chain": f"WITH RECURSIVE {CHAIN_ROOTS}, walk AS (SELECT shard, batch_id, count, merkle_root, repeat('0', 64) AS prev_chain, sha256(concat_ws('|', repeat('0', 64), merkle_root, batch_id, count)) AS chain_hash FROM roots WHERE batch_id = 0 UNION ALL SELECT r.shard, r.batch_id, r.count, r.merkle_root, w.chain_hash, sha256(concat_ws('|', w.chain_hash, r.merkle_root, r.batch_id, r.count)) FROM walk w JOIN roots r ON r.shard = w.shard AND r.batch_id = w.batch_id + 1) SELECT * FROM walk",
    "ledger_verify": "SELECT CAST(event_id % 4 AS VARCHAR) AS shard, event_id // 4 AS seq, true AS known, event_id // 4 % 100 <> 7 AS leaf_match, event_id // 4 % 100 <> 7 AS proof_match, true AS link_match, event_id // 4 % 100 <> 7 AS verified FROM events",
    "mine_templates": "SELECT CASE WHEN count(DISTINCT event_type) = 1 THEN 'user <NUM> ' || min(event_type) || ' from <IP> port <NUM>' ELSE 'user <NUM> <*> from <IP> port <NUM>' END AS template, count(*) AS count FROM events",
    "store_filter": "SELECT event_id AS seq, event_type AS pack, event_id % 7 AS severity_id FROM events WHERE event_id % 7 >= 3 AND event_id % 3 > 0 AND event_id >= 100 AND event_type <> 'error'",
    "store_latest": "SELECT user_id AS uid, max(event_id) AS seq, max_by(event_type, event_id) AS class_name, '10.0.0.' || max(event_id) % 250 AS src_ip FROM events GROUP BY user_id",
    "store_by_pack": "SELECT CASE WHEN event_type = 'error' THEN 'fallback' ELSE event_type END AS pack, count(*) AS n, round(avg(round(value, 2)), 3) AS avg_confidence, round(avg(CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END), 4) AS valid_ratio FROM events GROUP BY 1",
    "store_counters": "SELECT 'processed' AS name, '' AS label, count(*) AS value FROM events UNION ALL SELECT 'validation_errors', '', count(*) FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'fallback', '', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'by_pack', CASE WHEN event_type = 'error' THEN 'fallback' ELSE event_type END, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'by_class', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'dead_letter', '', count(*) FROM documents WHERE strlen(text) > 4096",
    "sink_cef": "SELECT event_id, concat('CEF:0|Unknown||emberlog|', event_id % 5, '|class\\|', event_type, '|', CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 9 ELSE 10 END, '|rt=', event_id, ' src=10.0.0.', event_id % 250, ' msg=a\\=b ', props, ' cs1Label=ocsf_class cs1=', event_type, ' cs2Label=event_uid cs2=', user_id, ' cs3Label=raw_sha256') AS line FROM events",
}
SHUFFLED = CHAIN_ROOTS.replace("event_id // 4 // 256 AS batch_id, event_id // 4 % 256 AS pos", "(rn - 1) // 256 AS batch_id, (rn - 1) % 256 AS pos").replace("FROM (" + LEAF + ")", "FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 4 ORDER BY (event_id // 4 % 3000 >= 1000)::INT + (event_id // 4 % 3000 >= 2000)::INT, event_id) AS rn FROM (" + LEAF + "))")
SQL["ledger_append"] = SQL["ledger_chain"].replace(CHAIN_ROOTS, SHUFFLED)
SQL["ledger_verify_all"] = "SELECT *, known AND leaf_match AND proof_match AND link_match AND raw_match AND norm_match AND signature_match AS verified FROM (SELECT CAST(event_id % 4 AS VARCHAR) AS shard, event_id // 4 AS seq, true AS known, raw AND norm AS leaf_match, raw AND norm AS proof_match, true AS link_match, raw AS raw_match, norm AS norm_match, event_id % 4 <> 2 AS signature_match FROM (SELECT event_id, event_id // 4 % 50 <> 3 AS raw, event_id // 4 % 70 <> 5 AS norm FROM events))"
QUERIES["normalize_vendors"], SQL["normalize_vendors"] = vendors.vendors, vendors.SQL
QUERIES["mine_templates_many"] = mined_many
SQL["mine_templates_many"] = "SELECT 'unit ' || chr(CAST(97 + event_id % 25 AS INTEGER)) || CASE event_id % 3 WHEN 0 THEN ' took <NUM> ms on <IP> for ' || CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE '<*>' END WHEN 1 THEN ' closed by <MAC>' ELSE ' is up and running now' END AS template, count(*) AS count FROM events GROUP BY event_id % 25, event_id % 3"
QUERIES |= {"draft_tokens": shared_tokens, "draft_votes": agreed_fields}
SQL["draft_tokens"] = "WITH t AS (SELECT user_id AS cluster, unnest(list_filter(['stamp=', CASE WHEN event_id % 7 < 6 - user_id % 7 THEN 'longest_name=' END, 'kind=', CASE WHEN user_id % 3 > 0 THEN 'weight=' END], lambda x: x IS NOT NULL)) AS token FROM events), n AS (SELECT cluster, token, count(*) AS n FROM t GROUP BY ALL), o AS (SELECT user_id AS cluster, count(*) AS o FROM events GROUP BY 1) SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY length(token) DESC, token) AS INTEGER) AS rank, token FROM n JOIN o USING (cluster) WHERE n = o QUALIFY rank <= 2"
SQL["draft_votes"] = "WITH c AS (SELECT user_id % 10 AS cluster, count(*) AS o, count_if(event_id % 3 > 0) AS a, count_if(event_id % 5 = 0) AS p FROM events GROUP BY 1), f AS (SELECT cluster, 'message' AS path, 'message' AS raw, o AS support FROM c UNION ALL SELECT cluster, 'src_endpoint.ip', 'src_ip', a FROM c WHERE a >= 0.5 * o UNION ALL SELECT cluster, 'dst_endpoint.port', 'dst_port', p FROM c WHERE p >= 0.5 * o) SELECT cluster, CASE WHEN a > o - a THEN 'network_activity' ELSE 'base_event' END AS class_name, path, raw, CAST(support AS BIGINT) AS support FROM f JOIN c USING (cluster)"
QUERIES["schema_faults"], SQL["schema_faults"] = schemas.validated, schemas.SQL
QUERIES |= detection.QUERIES
SQL |= detection.SQL
