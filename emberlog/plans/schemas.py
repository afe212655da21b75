"""Events checked against a schema that is compiled from its definition files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import extract, schema
from emberlog.sources.shared import shared_dir

_one = lambda names, **spec: {n: spec for n in names.split()}
# A few definitions of the public event schema, by path.
DEFINITIONS = {
    "version.json": {"version": "1.3.0"},
    "categories.json": {"attributes": {"network": {"uid": 4, "caption": "Network Activity"}}},
    "dictionary.json": {"attributes": {"time": {"type": "timestamp_t"}, "is_alert": {"type": "boolean_t"}, "port": {"type": "port_t"}, "ip": {"type": "ip_t"}, "metadata": {"type": "metadata"}, "product": {"type": "product"}} | _one("class_uid category_uid activity_id type_uid severity_id", type="integer_t") | _one("src_endpoint dst_endpoint", type="network_endpoint")},
    "includes/classification.json": {"attributes": _one("class_uid category_uid activity_id type_uid", requirement="required")},
    "profiles/security_control.json": {"attributes": {"is_alert": {"requirement": "recommended"}}},
    "events/base_event.json": {"name": "base_event", "category": "other", "uid": 0, "attributes": {"$include": ["includes/classification.json"], "severity_id": {"requirement": "required"}, "metadata": {"requirement": "required"}, "message": {}} | _one("time", requirement="required")},
    "events/network/network.json": {"name": "network", "extends": "base_event", "category": "network", "attributes": {"$include": ["profiles/security_control.json"], "src_endpoint": {"requirement": "recommended"}, "dst_endpoint": {"requirement": "required"}}},
    "events/network/network_activity.json": {"name": "network_activity", "extends": "network", "uid": 1, "caption": "Network Activity", "attributes": {}},
    "objects/metadata.json": {"name": "metadata", "attributes": {"version": {"requirement": "required"}, "product": {"requirement": "required"}}},
    "objects/product.json": {"name": "product", "attributes": {"name": {}, "vendor_name": {"requirement": "required"}}},
    "objects/endpoint.json": {"name": "endpoint", "attributes": {"ip": {}, "hostname": {}}},
    "objects/network_endpoint.json": {"name": "network_endpoint", "extends": "endpoint", "attributes": {"port": {"requirement": "recommended"}}},
}
#: Every event as JSON, faulty in one way or several by its number.
EVENT = """concat('{"class_uid": ', CASE WHEN event_id % 53 = 0 THEN 9999 ELSE 4001 END, ', "category_uid": 4, "activity_id": 6, "type_uid": 400106, "severity_id": 1',
  CASE WHEN event_id % 7 = 0 THEN '' ELSE ', "time": 1704067200000' END, CASE WHEN event_id % 11 = 0 THEN concat(', "', event_type, '_note": "x"') ELSE '' END,
  CASE WHEN event_id % 17 = 0 THEN ', "is_alert": "yes"' ELSE ', "is_alert": true' END,
  ', "metadata": {"version": "1.3.0"', CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 3 = 0 THEN ', "product": {"name": "Gate"}' ELSE ', "product": {"name": "Gate", "vendor_name": "Acme"}' END, '}',
  ', "dst_endpoint": {"ip": "192.0.2.1", "port": ', CASE WHEN event_id % 5 = 0 THEN concat('"p', user_id, '"') ELSE '443' END, '}, "unmapped": {"k": ', user_id, '}', CASE WHEN event_id % 59 = 0 THEN '' ELSE '}' END)"""


def definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, json.dumps(d)) for p, d in DEFINITIONS.items()], "path string, text string")


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults of all events, against a schema that is compiled here."""
    extract.prepare(spark)
    made = schema.compiled(definitions(spark)).kept(f"{shared_dir(spark)}/schema-{uuid.uuid4().hex}")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(EVENT).alias("event"))
    return schema.faults(events, made, "event_id")


SQL = """
WITH sound AS (SELECT event_id, event_type FROM events WHERE event_id % 53 > 0 AND event_id % 59 > 0)
SELECT event_id, 'json' AS kind, '' AS path, 'object' AS expected FROM events WHERE event_id % 59 = 0
UNION ALL SELECT event_id, 'class', 'class_uid', NULL FROM events WHERE event_id % 53 = 0 AND event_id % 59 > 0
UNION ALL SELECT event_id, 'missing', 'time', 'timestamp_t' FROM sound WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'unknown', event_type || '_note', NULL FROM sound WHERE event_id % 11 = 0
UNION ALL SELECT event_id, 'type', 'is_alert', 'boolean_t' FROM sound WHERE event_id % 17 = 0
UNION ALL SELECT event_id, 'missing', 'metadata.product', 'product' FROM sound WHERE event_id % 13 = 0
UNION ALL SELECT event_id, 'missing', 'metadata.product.vendor_name', 'string_t' FROM sound WHERE event_id % 13 > 0 AND event_id % 3 = 0
UNION ALL SELECT event_id, 'type', 'dst_endpoint.port', 'port_t' FROM sound WHERE event_id % 5 = 0
"""
