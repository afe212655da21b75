"""Events to tables, files and the formats of other systems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAKE = ["uid", "time", "class_uid", "class_name", "activity_id", "severity_id", "src_ip", "dst_ip", "src_port", "dst_port", "disposition_id", "vendor", "product", "pack", "confidence", "raw_sha256", "event", "raw_data"]
# severity_id of an event to that of a CEF line.
CEF_SEVERITY = {0: 0, 1: 1, 2: 3, 3: 5, 4: 7, 5: 9, 6: 10}


def attr(path: str) -> Column:
    """An attribute of an event; null if it has none."""
    return F.try_element_at("attrs", F.lit(path))


def as_json(events: DataFrame) -> Column:
    """An event without its raw line, as JSON text."""
    return F.to_json(F.struct(*[c for c in events.columns if c not in ("raw", "batch_id")]))


def lake_rows(events: DataFrame) -> DataFrame:
    """The columns of the data lake and ``dt``, the event's day."""
    rows = events.withColumns({"event": as_json(events), "raw_data": F.col("raw"), "disposition_id": attr("disposition_id").try_cast("int"), "vendor": attr("metadata.product.vendor_name"), "product": attr("metadata.product.name")})
    return rows.select(*LAKE, F.to_date(F.timestamp_millis("time")).alias("dt"))


def write_lake(events: DataFrame, path: str, mode: str = "append", rows_per_file: int = 2_000_000) -> None:
    """Parquet by class and day. Rows are dealt evenly to tasks near their partition, so that a hot class has many writers and a rare one few files."""
    rows = lake_rows(events)
    rows = rows.hint("rebalance", "class_uid", "dt").sortWithinPartitions("class_uid", "dt", "time")
    rows.write.mode(mode).partitionBy("class_uid", "dt").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_json_lines(events: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines in a folder for each day."""
    events.withColumn("dt", F.to_date(F.timestamp_millis("time"))).write.mode(mode).partitionBy("dt").json(path)


def cef_line(events: DataFrame, product: str = "emberlog") -> Column:
    """An event as a CEF line; what is missing or empty is left out."""
    head = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    tail = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\=")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    text = lambda name: F.col(name).cast("string") if name in events.columns else F.lit(None).cast("string")
    pairs = {"rt": text("time"), "src": text("src_ip"), "spt": text("src_port"), "dst": text("dst_ip"), "dpt": text("dst_port"), "suser": text("user_name"), "act": attr("disposition"), "msg": attr("message"), "cs1Label": F.lit("ocsf_class"), "cs1": text("class_name"), "cs2Label": F.lit("event_uid"), "cs2": text("uid"), "cs3Label": F.lit("raw_sha256"), "cs3": text("raw_sha256")}
    shown = F.array_join(F.array_compact(F.array(*[F.when(v != "", F.concat(F.lit(f"{k}="), tail(v))) for k, v in pairs.items()])), " ")
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CEF_SEVERITY.items() for x in kv]), F.col("severity_id").cast("int")), F.lit(5))
    return F.concat(F.lit("CEF:0|"), head(F.coalesce(attr("metadata.product.vendor_name"), F.lit("Unknown"))), F.lit("|"), head(attr("metadata.product.name")), F.lit(f"|{product}|"), F.col("type_uid").cast("string"), F.lit("|"), head(F.coalesce(attr("finding_info.title"), text("type_name"))), F.lit("|"), severity.cast("string"), F.lit("|"), shown)


def bulk_lines(events: DataFrame) -> DataFrame:
    """(n, line): for each event an index action and its document, the two lines of a bulk request."""
    action = F.to_json(F.struct(F.struct(F.concat(F.lit("ocsf-"), F.col("class_name")).alias("_index"), F.col("uid").alias("_id")).alias("index")))
    return events.select("uid", F.posexplode(F.array(action, as_json(events))).alias("n", "line"))


def collector_lines(events: DataFrame, sourcetype: str = "ocsf") -> DataFrame:
    """(uid, line): each event in the envelope of an HTTP event collector; time in seconds."""
    body = F.concat(F.lit('{"time":'), (F.col("time") / 1000).cast("decimal(20,3)").cast("string"), F.lit(f',"sourcetype":"{sourcetype}","event":'), as_json(events), F.lit("}"))
    return events.select("uid", body.alias("line"))


def table_rows(events: DataFrame) -> DataFrame:
    """The rows of a column store's table, in the order of its key within each task: class_uid, time, uid; ``day`` is its partition."""
    return lake_rows(events).withColumnRenamed("dt", "day").sortWithinPartitions("class_uid", "day", "time", "uid")


def topic_messages(events: DataFrame) -> DataFrame:
    """(key, value) of events for a topic: one source's events keep their order, since its address is the key."""
    return events.select(F.coalesce(F.try_element_at("source", F.lit("peer")), F.col("uid")).alias("key"), as_json(events).alias("value"))


def write_topic(events: DataFrame, servers: str, name: str) -> None:
    """Publishes events to a topic; needs Spark's connector for it."""
    topic_messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).save()


def deliver(sinks: dict[str, Callable[[DataFrame], None]], first: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], dict[str, str]]:
    """A function for ``foreachBatch``: ``first`` (the ledger) must succeed, then each sink is tried; a sink's error is returned, not raised."""

    def batch(events: DataFrame, batch_id: int) -> dict[str, str]:
        errors: dict[str, str] = {}
        events = events.persist()
        try:
            if first:
                first(events, batch_id)
            for name, sink in sinks.items():
                try:
                    sink(events)
                except Exception as e:  # noqa: BLE001  one sink's fault must not stop the others
                    errors[name] = f"{type(e).__name__}: {e}"[:500]
        finally:
            events.unpersist()
        return errors

    return batch
