"""Questions to stored events: filters, look-ups, the newest version of each event, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def found(events: DataFrame, **wanted: object) -> DataFrame:
    """Events that fit every filter given: uid, class_uid, pack, severity_min, src_ip, dst_ip, valid, since, until (both included), fallback.

    All filters are plain comparisons, so they reach the scan and its partitions. An unknown filter is an error.
    """
    tests = {
        "class_uid": lambda v: F.col("class_uid") == v, "pack": lambda v: F.col("pack") == v, "severity_min": lambda v: F.col("severity_id") >= v, "src_ip": lambda v: F.col("src_ip") == v, "dst_ip": lambda v: F.col("dst_ip") == v,
        "uid": lambda v: F.col("uid") == v, "valid": lambda v: F.col("valid") == bool(v), "since": lambda v: F.col("time") >= v, "until": lambda v: F.col("time") <= v, "fallback": lambda v: F.col("pack").isNull() if v else F.col("pack").isNotNull(),
    }
    for name, value in wanted.items():
        if name not in tests:
            raise ValueError(f"unknown filter {name!r}")
        if value is not None:
            events = events.filter(tests[name](value))
    return events


def newest(events: DataFrame, limit: int = 100, offset: int = 0, by: str = "seq") -> DataFrame:
    """A page of events, the latest arrival first; 1 to 1000 rows."""
    return events.orderBy(F.desc(by)).offset(max(0, offset)).limit(min(max(1, limit), 1000))


def latest(events: DataFrame, key: str = "uid", by: str = "seq") -> DataFrame:
    """Of rows with equal keys the last: ``max_by`` merges before the shuffle, so a key with many versions is no load."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), by).alias("row")).select(key, "row.*")


def by_class(events: DataFrame) -> DataFrame:
    return events.groupBy("class_name").agg(F.count("*").alias("n"))


def by_pack(events: DataFrame) -> DataFrame:
    """Events, mean confidence and share of valid events for each pack; those without one are ``fallback``."""
    return events.groupBy(F.coalesce("pack", F.lit("fallback")).alias("pack")).agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg(F.col("valid").cast("int")).alias("valid_ratio"))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"), F.round(F.avg(F.col("valid").cast("int")), 4).alias("valid_ratio"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def counters(events: DataFrame, dead: DataFrame) -> DataFrame:
    """(name, label, value) of processed events, faulty ones, those without a pack, by pack and by class, and dead letters."""
    label = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("label"))
    none = F.lit("")
    all_ = F.array_compact(F.array(label("processed", none), F.when(~F.col("valid"), label("validation_errors", none)), F.when(F.col("pack").isNull(), label("fallback", none)), label("by_pack", F.coalesce("pack", F.lit("fallback"))), label("by_class", F.col("class_name"))))
    return events.select(F.explode(all_).alias("c")).groupBy("c.name", "c.label").agg(F.count("*").alias("value")).unionByName(dead.agg(F.lit("dead_letter").alias("name"), F.lit("").alias("label"), F.count("*").alias("value")))


def agreement(verdicts: DataFrame) -> DataFrame:
    """By format: cases, share of verdicts on events that equal those on raw lines, and of raw verdicts that are as expected."""
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("int"))
    return verdicts.groupBy("format").agg(F.count("*").alias("cases"), same("raw_alert", "event_alert").alias("fidelity"), same("raw_alert", "expected").alias("oracle"), F.avg(F.when(F.col("expected"), F.col("event_alert").cast("int"))).alias("detected"), F.avg(F.when(~F.col("expected"), 1 - F.col("event_alert").cast("int"))).alias("silent"))


def latency(batches: DataFrame, took_ms: str = "took_ms") -> DataFrame:
    """p50 and p99 of how long batches took: values that occurred, not ones in between."""
    return batches.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {took_ms})").alias(f"p{round(q * 100)}") for q in (0.5, 0.99)])


def prometheus(counts: DataFrame, prefix: str = "emberlog") -> DataFrame:
    """(line) of ``counters`` in the text format of Prometheus; labels are escaped."""
    label = F.replace(F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    name = F.concat(F.lit(f"{prefix}_"), "name", F.lit("_total"))
    return counts.select(F.concat(name, F.when(F.col("label") == "", "").otherwise(F.concat(F.lit('{label="'), label, F.lit('"}'))), F.lit(" "), F.col("value").cast("string")).alias("line"))
