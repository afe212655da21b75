"""The envelope of an event: derived core attributes, what wasn't mapped, digests, counts and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import sha256, snake

# Classes of the public event schema: uid, category uid, caption.
CLASSES = {
    "base_event": (0, 0, "Base Event"),
    "file_activity": (1001, 1, "File System Activity"),
    "module_activity": (1005, 1, "Module Activity"),
    "scheduled_job_activity": (1006, 1, "Scheduled Job Activity"),
    "process_activity": (1007, 1, "Process Activity"),
    "registry_value_activity": (201002, 1, "Registry Value Activity"),
    "win_service_activity": (201004, 1, "Windows Service Activity"),
    "detection_finding": (2004, 2, "Detection Finding"),
    "account_change": (3001, 3, "Account Change"),
    "authentication": (3002, 3, "Authentication"),
    "network_activity": (4001, 4, "Network Activity"),
    "http_activity": (4002, 4, "HTTP Activity"),
    "dns_activity": (4003, 4, "DNS Activity"),
    "ssh_activity": (4007, 4, "SSH Activity"),
}
CATEGORIES = {0: "Uncategorized", 1: "System", 2: "Findings", 3: "Iam", 4: "Network"}
SEVERITY = {0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical", 6: "Fatal", 99: "Other"}
# Enum captions of the public event schema, by class and attribute.
CAPTIONS = {
    "network_activity.activity_id": {0: "Unknown", 1: "Open", 2: "Close", 3: "Reset", 4: "Fail", 5: "Refuse", 6: "Traffic", 7: "Listen", 99: "Other"},
    "http_activity.activity_id": {0: "Unknown", 1: "Connect", 2: "Delete", 3: "Get", 4: "Head", 5: "Options", 6: "Post", 7: "Put", 8: "Trace", 99: "Other"},
    "dns_activity.activity_id": {0: "Unknown", 1: "Query", 2: "Response", 6: "Traffic", 99: "Other"},
    "ssh_activity.activity_id": {0: "Unknown", 1: "Open", 2: "Close", 3: "Reset", 4: "Fail", 5: "Refuse", 6: "Traffic", 99: "Other"},
    "detection_finding.activity_id": {0: "Unknown", 1: "Create", 2: "Update", 3: "Close", 99: "Other"},
    "authentication.activity_id": {0: "Unknown", 1: "Logon", 2: "Logoff", 3: "Authentication Ticket", 4: "Service Ticket Request", 5: "Service Ticket Renew", 6: "Preauth", 99: "Other"},
    "process_activity.activity_id": {0: "Unknown", 1: "Launch", 2: "Terminate", 3: "Open", 4: "Inject", 5: "Set User ID", 99: "Other"},
    "file_activity.activity_id": {0: "Unknown", 1: "Create", 2: "Read", 3: "Update", 4: "Delete", 5: "Rename", 6: "Set Attributes", 7: "Set Security", 8: "Get Attributes", 9: "Get Security", 10: "Encrypt", 11: "Decrypt", 12: "Mount", 13: "Unmount", 14: "Open", 99: "Other"},
    "module_activity.activity_id": {0: "Unknown", 1: "Load", 2: "Unload", 99: "Other"},
    "registry_value_activity.activity_id": {0: "Unknown", 1: "Get", 2: "Set", 3: "Modify", 4: "Delete", 99: "Other"},
    "account_change.activity_id": {0: "Unknown", 1: "Create", 2: "Enable", 3: "Password Change", 4: "Password Reset", 5: "Disable", 6: "Delete", 7: "Attach Policy", 8: "Detach Policy", 9: "Lock", 10: "MFA Factor Enable", 11: "MFA Factor Disable", 99: "Other"},
    "win_service_activity.activity_id": {0: "Unknown", 1: "Create", 2: "Reconfigure", 3: "Start", 4: "Stop", 5: "Pause", 6: "Continue", 7: "Delete", 99: "Other"},
    "scheduled_job_activity.activity_id": {0: "Unknown", 1: "Create", 2: "Update", 3: "Delete", 4: "Enable", 5: "Disable", 6: "Start", 99: "Other"},
    "disposition_id": {0: "Unknown", 1: "Allowed", 2: "Blocked", 3: "Quarantined", 4: "Isolated", 5: "Deleted", 6: "Dropped", 15: "Detected", 17: "Logged", 19: "Alert", 21: "Reset", 23: "Challenged", 25: "Rejected", 99: "Other"},
    "action_id": {0: "Unknown", 1: "Allowed", 2: "Denied", 3: "Observed", 4: "Modified", 99: "Other"},
    "status_id": {0: "Unknown", 1: "Success", 2: "Failure", 99: "Other"},
    "logon_type_id": {0: "System", 2: "Interactive", 3: "Network", 4: "Batch", 5: "OS Service", 7: "Unlock", 8: "Network Cleartext", 9: "New Credentials", 10: "Remote Interactive", 11: "Cached Interactive", 99: "Other"},
}
#: Enums that an object must have, by the object: unknown is 0.
REQUIRED_ENUMS = {"device": "type_id", "connection_info": "direction_id"}
REQUIRED = {"detection_finding": ("finding_info.title", "finding_info.uid")}
VERSION = "1.3.0"


def lookup(values: dict[int, str], key: Column) -> Column:
    """A caption by its number; null for others."""
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key.cast("int"))


def severity_name(severity_id: Column) -> Column:
    return F.coalesce(lookup(SEVERITY, severity_id), F.lit("Other"))


def activity_name(class_name: str, activity_id: Column) -> Column:
    """The caption of an activity of a class; null if it has none."""
    return lookup(CAPTIONS[f"{class_name}.activity_id"], activity_id) if f"{class_name}.activity_id" in CAPTIONS else F.lit(None).cast("string")


def sibling_captions(attrs: Column) -> Column:
    """A caption beside each top-level ``*_id`` attribute that has one and isn't mapped itself."""
    named = [F.struct(F.lit(k[:-3]).alias("key"), lookup(v, F.try_element_at(attrs, F.lit(k)).try_cast("int")).alias("value")) for k, v in CAPTIONS.items() if "." not in k]
    return F.map_from_entries(F.filter(F.array(*named), lambda e: e["value"].isNotNull() & ~F.map_contains_key(attrs, e["key"])))


def required_enums(attrs: Column) -> Column:
    """Unknown (0) for each required enum of an object that is present without it."""
    paths = F.map_keys(attrs)
    has = lambda o: F.exists(paths, lambda p: p.startswith(f"{o}."))
    wanted = [F.when(has(o) & ~F.array_contains(paths, f"{o}.{e}"), F.lit(f"{o}.{e}")) for o, e in REQUIRED_ENUMS.items()]
    return F.map_from_entries(F.transform(F.array_compact(F.array(*wanted)), lambda p: F.struct(p.alias("key"), F.lit("0").alias("value"))))


def unmapped(fields: Column, consumed: Column) -> Column:
    """Fields that no attribute carries as they are, by names in snake case; equal names get ``_2``, ``_3`` in the fields' order."""
    left = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull() & (e["value"] != "") & ~F.array_contains(consumed, e["key"]))
    keys = F.transform(left, lambda e: snake(e["key"]))
    nth = F.transform(keys, lambda k, i: F.size(F.filter(F.slice(keys, F.lit(1), i), lambda x: x == k)))
    names = F.zip_with(keys, nth, lambda k, n: F.when(n > 0, F.concat(k, F.lit("_"), (n + 1).cast("string"))).otherwise(k))
    return F.map_from_arrays(names, F.transform(left, lambda e: e["value"]))


def seal(events: DataFrame) -> DataFrame:
    """Adds digests, sizes and counts to events with raw, fields, consumed, unmapped, errors and trust."""
    raw = F.col("raw")
    return events.withColumns({
        "raw_sha256": sha256(raw), "raw_size": F.octet_length(raw).cast("bigint"),
        "n_extracted": F.size("fields"), "n_mapped": F.size(F.array_intersect(F.map_keys("fields"), F.col("consumed"))), "n_unmapped": F.size("unmapped"),
        "valid": F.size("errors") == 0, "confidence": F.when(F.size("errors") == 0, F.col("trust")).otherwise(F.round(F.col("trust") * 0.9, 3)),
        "uid": sha256(F.concat_ws("\x1f", raw, F.coalesce(F.col("received_ms").cast("string"), F.lit("")), F.coalesce(F.to_json("source"), F.lit("")))),
    })
