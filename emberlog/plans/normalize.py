"""From raw lines to events.

One projection guards, sniffs and routes each line and parses it with its first pack; the parsed lines are staged once, apart by what became
of them. Only lines whose pack failed go through the next round, with their next pack, and only lines of packs that need Python workers are parsed apart. Then
one expression maps the lines of all packs and rules, and the rest becomes events by field names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import envelope, guard, mapper
from emberlog.operators.extract import prepare
from emberlog.operators.mapping import TOO_WIDE, Compiled
from emberlog.operators.packs import Registry
from emberlog.operators.sniff import sniffed
from emberlog.plans.library import library
from emberlog.sources.shared import shared_dir

EVENT = ["uid", "raw", "source", "received_ms", "pack", "class_uid", "class_name", "class_rule", "category_uid", "category_name", "activity_id", "activity_name", "severity_id", "severity", "type_uid", "type_name", "time", "attrs", "unmapped", "lineage", "errors", "warnings", "valid", "confidence", "format", "raw_sha256", "raw_size", "n_extracted", "n_mapped", "n_unmapped", "src_ip", "src_port", "dst_ip", "dst_port", "user_name"]


def lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Input rows: raw, source (a map) and received_ms; what is missing is empty, the time of receipt 0."""
    have = df.columns
    source = F.col("source") if "source" in have else F.expr("cast(map() as map<string,string>)")
    received = F.col("received_ms").cast("bigint") if "received_ms" in have else F.lit(0).cast("bigint")
    return df.select(guard.decoded(F.col(raw)).alias("raw"), source.alias("source"), received.alias("received_ms"))


#: What became of a line: parsed, its pack failed, its pack needs Python workers, no pack is left, rejected, too many fields.
PARSED, FAILED, SLOW, REST, DEAD, WIDE = range(6)


def routed(df: DataFrame, registry: Registry) -> DataFrame:
    """Lines with ``rejected`` (why, or null), ``sniffed`` and ``candidates`` (packs to try, in order)."""
    df = sniffed(guard.not_blank(df))
    df = df.withColumn("rejected", guard.rejection(F.col("raw"), F.col("sniffed.format")))
    return df.withColumn("candidates", registry.routes)


def parsed(lines: DataFrame, compiled: Compiled, slow: list[int]) -> DataFrame:
    """Lines (with candidates and ``turn``, the place of the pack to try) with their fields and ``state``."""
    lines = lines.withColumn("pack_no", F.when(F.col("rejected").isNotNull(), -2).otherwise(F.coalesce(F.get("candidates", F.col("turn")), F.lit(-1))))
    rows = compiled.parsed(lines)
    state = F.when(F.col("pack_no") == -2, DEAD).when(F.col("pack_no") == -1, REST).when(F.col("pack_no").isin(slow), SLOW).when(F.col("rule_no") == TOO_WIDE, WIDE).when(F.col("rule_no") >= 0, PARSED)
    return rows.withColumn("state", state.otherwise(FAILED))


def finished(events: DataFrame) -> DataFrame:
    """Adds the derived attributes of the envelope and puts the columns in order."""
    classes = {k: v for k, v in envelope.CLASSES.items()}
    pick = lambda i: F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("class_name")]
    name = F.coalesce(*[F.when(F.col("class_name") == c, envelope.activity_name(c, F.col("activity_id"))) for c in classes])
    attr = lambda p: F.try_element_at("attrs", F.lit(p))
    events = events.withColumns({"attrs": F.map_concat(F.col("attrs"), F.when(F.col("class_name") != "base_event", F.map_concat(envelope.sibling_captions(F.col("attrs")), envelope.required_enums(F.col("attrs")))).otherwise(F.expr("cast(map() as map<string,string>)")))})
    when = attr("time").try_cast("bigint")
    filled = F.transform(F.filter(F.map_keys("attrs"), lambda p: ~F.map_contains_key("lineage", p) & p.endswith("_id")), lambda p: F.struct(p.alias("key"), F.array(F.lit("default:unknown")).alias("value")))
    missing = [F.when((F.col("class_name") == c) & attr(p).isNull(), F.lit(f"missing required {p}")) for c, paths in envelope.REQUIRED.items() for p in paths]
    events = events.withColumns({
        "class_uid": pick(0), "category_uid": pick(1), "type_caption": pick(2), "activity_name": name, "severity": envelope.severity_name(F.col("severity_id")),
        "time": F.coalesce(when, F.col("received_ms")), "warnings": F.array_compact(F.array(F.when(when.isNull(), F.lit("time not present in source; receipt time used")))),
        "unmapped": envelope.unmapped(F.col("fields"), F.col("consumed")), "errors": F.concat("errors", F.array_compact(F.array(*missing))),
        "lineage": F.map_concat("lineage", F.map_from_entries(filled), F.when(when.isNull(), F.create_map(F.lit("time"), F.array(F.lit("received_time")))).otherwise(F.expr("cast(map() as map<string,array<string>>)"))),
        "format": F.array_join(F.sort_array("sniffed.tags"), "+"),
        "src_ip": F.coalesce(attr("src_endpoint.ip"), attr("evidences[0].src_endpoint.ip")), "dst_ip": F.coalesce(attr("dst_endpoint.ip"), attr("evidences[0].dst_endpoint.ip")),
        "src_port": F.coalesce(attr("src_endpoint.port"), attr("evidences[0].src_endpoint.port")).try_cast("bigint"), "dst_port": F.coalesce(attr("dst_endpoint.port"), attr("evidences[0].dst_endpoint.port")).try_cast("bigint"),
        "user_name": F.coalesce(attr("user.name"), attr("actor.user.name")),
    })
    events = events.withColumns({"category_name": envelope.lookup(envelope.CATEGORIES, F.col("category_uid")), "type_uid": (F.col("class_uid").cast("bigint") * 100 + F.col("activity_id")).cast("bigint"), "type_name": F.concat("type_caption", F.lit(": "), F.coalesce("activity_name", F.lit("Unknown")))})
    return envelope.seal(events).select(*EVENT)


def normalize(df: DataFrame, packs: list[dict] | Registry | None = None, now_ms: int | None = None, staging: str | None = None, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Events and dead letters of the lines in ``df`` (a column of raw text; source and received_ms if there are any).

    A line goes to the first pack that takes it; where that pack fails, the next one tries, until none is left; the rest becomes an
    event by field names. ``now_ms`` is the clock for stamps without a year. Lines are staged under ``staging``, a folder
    that driver and executors share, once for each pack that they try. The events read it: remove it with
    ``discard`` after they have been delivered. A registry keeps what it compiled: give the same one to every batch.
    """
    spark = df.sparkSession
    prepare(spark)
    registry = packs if isinstance(packs, Registry) else Registry.of(library) if packs is None else Registry(packs)
    everyone, native, slow = registry.compiled
    now = F.lit(now_ms).cast("bigint") if now_ms is not None else F.unix_millis(F.current_timestamp())
    path = f"{staging or folder(spark)}/{uuid.uuid4().hex}"
    todo = routed(spread(lines(df, raw)), registry).withColumn("turn", F.lit(0))
    parts: list[DataFrame] = []
    for n in count():  # ends when no line has a pack left to try
        now_done = [staged(parsed(todo, native, list(slow.packs)), f"{path}/round-{n}", "state")]
        if SLOW in present(now_done[0], "state"):
            again = now_done[0].filter(F.col("state") == SLOW).drop("fields", "used", "failure", "rule_no", "pack_no", "state")
            now_done.append(staged(parsed(again, slow, []), f"{path}/round-{n}-slow", "state"))
        parts += now_done
        failed = [d.filter(F.col("state") == FAILED) for d in now_done if FAILED in present(d, "state")]
        if not failed:
            break
        todo = reduce(DataFrame.unionByName, failed).withColumn("turn", F.lit(n + 1)).drop("fields", "used", "failure", "rule_no", "pack_no", "state")
    of = lambda state: [d.filter(F.col("state") == state).drop("state") for d in parts if state in present(d, "state")]
    made = [everyone.mapped(reduce(DataFrame.unionByName, of(PARSED)), now)] if of(PARSED) else []
    if of(REST) or not made:
        left = reduce(DataFrame.unionByName, of(REST)) if of(REST) else parts[0].filter(F.col("state") == REST).drop("state")
        left = staged(mapper.fallback_fields(numbered(left.drop("fields", "used", "failure", "rule_no", "pack_no"))), f"{path}/rest", None)
        made.append(staged(mapper.fallback_events(left, now), f"{path}/fallback", None))
    common = [c for c in made[0].columns if all(c in m.columns for m in made)]
    events = finished(reduce(DataFrame.unionByName, [m.select(*common) for m in made]))
    dead = [guard.dead_letters(d) for d in of(DEAD)] + [guard.dead_letters(d.withColumn("rejected", guard.too_wide(F.col("fields")))) for d in of(WIDE)]
    return events, reduce(DataFrame.unionByName, dead) if dead else guard.dead_letters(parts[0].filter(F.col("state") == DEAD))


def spread(df: DataFrame) -> DataFrame:
    """Deals lines out to all cores where they come in fewer parts: a small file is one part, but its lines take long to parse."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def present(df: DataFrame, column: str) -> list[int]:
    """The numbers, from 0, that a staging column has; read from the folders' names, without a job."""
    return sorted({int(n) for f in df.inputFiles() for n in re.findall(rf"/{column}=(\d+)/", f)})


def numbered(df: DataFrame) -> DataFrame:
    """Rows with a key that no two share, also where lines repeat."""
    return df.withColumn("row", F.monotonically_increasing_id())


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, path: str, by: str | None) -> DataFrame:
    """Writes the rows to a folder, apart by a column, and reads them back. Parsers are too long for one generated method: compiling it takes longer than it saves."""
    with setting(df.sparkSession, "spark.sql.codegen.wholeStage", "false"), setting(df.sparkSession, "spark.sql.codegen.factoryMode", "NO_CODEGEN"):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark) -> str:
    """A staging folder in the place that driver and executors share."""
    return f"{shared_dir(spark)}/emberlog-staging"


def discard(spark, path: str) -> None:
    """Removes a staging folder, once what was read from it has been delivered."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
