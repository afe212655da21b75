"""Lines of every pack's source, mixed, and the query that normalizes them together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.plans.normalize import normalize

HEAD = "Jan  2 03:04:05 h1"
#: A line with {S}, {D}, {P} and {U} for source and target address, source port and user, the pack, class and activity that it becomes, and which
#: of D, P and U it has.
LINES: list[tuple[str, str, str, int, str]] = [
    ("<14>" + HEAD + " 1,2024/01/01 00:00:01,S1,TRAFFIC,end,1,2024/01/01 00:00:01,{S},{D},0.0.0.0,0.0.0.0,r1,{U},,web,vsys1,in,out,e1,e2,log,x,77,1,{P},443,0,0,0x0,tcp,allow,100,50,50,2,2024/01/01 00:00:00,1,any,0,1,0x0,US,DE,0,1,1,aged-out", "paloalto.panos@1.0", "network_activity", 2, "DPU"),
    ("<166>Jan  2 2024 03:04:05 h1 : %ASA-4-106023: Deny tcp src outside:{S}/{P} dst inside:{D}/443 by access-group \"acl1\" [0x0, 0x0]", "cisco.asa@1.0", "network_activity", 5, "DP"),
    ("CEF:0|Check Point|VPN-1 & FireWall-1|Check Point|Log|Accept|5|act=Accept rt=1704067201000 src={S} spt={P} dst={D} dpt=443 proto=6 suser={U}", "checkpoint.cef@1.0", "network_activity", 6, "DPU"),
    ("CEF:0|Acme|Gate|1.0|7|thing|5|src={S} spt={P} dst={D} dpt=443 act=block suser={U}", "generic.cef@1.0", "network_activity", 6, "DPU"),
    ("LEEF:1.0|Acme|Gate|1.0|ev|src={S}\tdst={D}\tsrcPort={P}\tdstPort=443\tusrName={U}\taction=allow", "generic.leef@1.0", "network_activity", 6, "DPU"),
    ("<14>1 2024-01-02T03:04:05.000+05:30 h1 RT_FLOW - RT_FLOW_SESSION_CREATE [junos@2636.1.1.1.2.40 source-address=\"{S}\" source-port=\"{P}\" destination-address=\"{D}\" destination-port=\"443\" protocol-id=\"6\" username=\"{U}\"] session created", "juniper.srx@1.0", "network_activity", 1, "DPU"),
    ("<134>" + HEAD + " filterlog[123]: 5,,,1000,em0,match,block,in,4,0x0,,64,0,0,none,6,tcp,60,{S},{D},{P},443,0,S,1,0,64,,", "pfsense.filterlog@1.0", "network_activity", 5, "DP"),
    ("<38>" + HEAD + " sshd[99]: Failed password for {U} from {S} port {P} ssh2", "openssh.sshd@1.0", "authentication", 1, "PU"),
    ("1704067201.123    45 {S} TCP_MISS/200 512 GET http://x.example/a {U} DIRECT/{D} text/html", "squid.access@1.0", "http_activity", 3, "DU"),
    ("{S} - {U} [02/Jan/2024:03:04:05 +0000] \"POST /a?b=1 HTTP/1.1\" 200 12 \"-\" \"curl\"", "nginx.access@1.0", "http_activity", 6, "U"),
    ("{{\"timestamp\":\"2024-01-02T03:04:05.000000+0000\",\"flow_id\":1,\"event_type\":\"dns\",\"src_ip\":\"{S}\",\"src_port\":{P},\"dest_ip\":\"{D}\",\"dest_port\":53,\"proto\":\"UDP\",\"dns\":{{\"type\":\"query\",\"id\":1,\"rrname\":\"x.example\"}}}}", "suricata.eve@1.0", "dns_activity", 1, "DP"),
    ("{{\"_path\":\"conn\",\"ts\":1704067201.5,\"uid\":\"C1\",\"id.orig_h\":\"{S}\",\"id.orig_p\":{P},\"id.resp_h\":\"{D}\",\"id.resp_p\":443,\"proto\":\"tcp\",\"conn_state\":\"SF\"}}", "zeek.json@1.0", "network_activity", 2, "DP"),
    ("{{\"event_uid\":\"e1\",\"severity_id\":4,\"timestamp\":\"2024-01-02T03:04:05Z\",\"hostname\":\"h\",\"signature_name\":\"sig\",\"src_ip\":\"{S}\",\"src_port\":{P},\"dst_ip\":\"{D}\",\"dst_port\":443,\"proto\":\"tcp\"}}", "sensors.canonical_alert@1.0", "detection_finding", 1, "DP"),
    ("{{\"ts\":\"2024-01-02T03:04:05Z\",\"agentId\":\"a\",\"agentIp\":\"10.9.9.9\",\"computer\":\"c\",\"eventId\":4624,\"xml\":\"<Event><System><EventID>4624</EventID><Computer>c</Computer></System><EventData><Data Name='TargetUserName'>{U}</Data><Data Name='IpAddress'>{S}</Data></EventData></Event>\"}}", "microsoft.windows_eventlog@1.0", "authentication", 1, "U"),
    ("ts=2024-01-01T00:00:00Z fw=f1 action=deny proto=tcp src_ip={S} src_port={P} dst_ip={D} dst_port=443 user={U} rule=1", "fallback", "network_activity", 0, "DPU"),
]


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, of one of all sources, to events: what each pack made of its lines."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    shapes = F.array(*[F.lit(line.format(S="@S@", D="@D@", P="@P@", U="@U@")) for line, *_ in LINES])
    raw = F.get(shapes, (F.col("event_id") % len(LINES)).cast("int"))
    values = {"@S@": F.concat(F.lit("10.1."), F.col("user_id") % 200, F.lit(".2")), "@D@": F.lit("192.0.2.7"), "@P@": (1024 + F.col("event_id") % 5000).cast("string"), "@U@": F.concat(F.lit("u"), F.col("user_id") % 50)}
    for mark, value in values.items():
        raw = F.replace(raw, F.lit(mark), value)
    events, _ = normalize(e.select(raw.alias("raw")), now_ms=1_704_153_600_000)
    return events.groupBy(F.coalesce("pack", F.lit("fallback")).alias("pack"), "class_name", "activity_id").agg(
        F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"), F.count_distinct("user_name").alias("users"), F.min("src_port").alias("low_port"), F.max("dst_ip").alias("target"), F.count_if("valid").alias("valid"),
    )


SQL = "SELECT pack, class_name, CAST(activity_id AS INTEGER) AS activity_id, count(*) AS n, count(DISTINCT user_id % 200) AS sources, CASE WHEN has LIKE '%U%' THEN count(DISTINCT user_id % 50) ELSE 0 END AS users, CASE WHEN has LIKE '%P%' THEN min(1024 + event_id % 5000) END AS low_port, CASE WHEN has LIKE '%D%' THEN '192.0.2.7' END AS target, count(*) AS valid FROM events JOIN (VALUES " + ", ".join(f"({i}, '{ref}', '{kind}', {activity}, '{has}')" for i, (_, ref, kind, activity, has) in enumerate(LINES)) + f") v(i, pack, class_name, activity_id, has) ON event_id % {len(LINES)} = i GROUP BY pack, class_name, activity_id, has"
