"""A ledger that is kept in a folder and grows by appends.

An append has a number; what it writes lies in folders of that number, and its heads come last: without their ``_SUCCESS`` file it
hasn't happened, and writing it again replaces whatever is there. An append that has happened is not written again, so a micro-batch that is repeated
changes nothing. Batches that aren't full wait for the rows of later appends, so the chain doesn't depend on how the rows
were cut into appends; ``close`` seals what waits. Only the heads, one row for each shard, and the waiting rows, fewer than a batch for each, are read again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators import ledger
from emberlog.operators.lineage import BATCH

HEADS = "shard string, batches long, events long, head string"
LEAVES = "shard string, seq long, leaf string"


class Ledger:
    """The ledger in a folder that the driver and all executors share: ``size`` rows a batch, one chain a shard."""

    def __init__(self, spark: SparkSession, folder: str, size: int = BATCH):
        self.spark, self.folder, self.size = spark, folder, size

    def path(self, what: str, number: int) -> str:
        return f"{self.folder}/{what}/append={number}"

    def _files(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath().toString() for f in found or []]

    def appends(self) -> list[int]:
        """The numbers of the appends that have happened."""
        return sorted(int(re.search(r"append=(\d+)/_SUCCESS$", f)[1]) for f in self._files("heads/append=*/_SUCCESS"))

    def _table(self, what: str, schema: str) -> DataFrame:
        """A table's rows of all appends that have happened."""
        done = self.appends()
        empty = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.path(what, n) for n in done]) if done else empty

    def _last(self, what: str, schema: str, done: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(what, done[-1])) if done else self.spark.createDataFrame([], schema)

    def chain(self) -> DataFrame:
        """All sealed batches."""
        return self._table("batches", ledger.CHAIN)

    def leaves(self) -> DataFrame:
        """The numbered rows of all appends, sealed or waiting."""
        return self._table("leaves", LEAVES)

    def waiting(self) -> DataFrame:
        """Rows whose batch isn't full."""
        return self._last("waiting", LEAVES, self.appends())

    def heads(self) -> DataFrame:
        """Of each shard the number of sealed batches and events, and the last hash."""
        return self._last("heads", HEADS, self.appends())

    def numbered(self, rows: DataFrame, order: tuple[str, ...], number: int, heads: DataFrame, waiting: DataFrame) -> DataFrame:
        """Gives the rows (shard, leaf, order) their numbers within their shards, after those that are there.

        A shard may hold most rows: they are dealt out by ranges and numbered within them, and only the ranges' counts are summed.
        The join is one of sorted rows, which they are by then: left to the planner, it may send all rows to the driver and broadcast them.
        """
        ranged = rows.repartitionByRange("shard", *order, "leaf").select("shard", "leaf", *order, F.spark_partition_id().alias("_range"))
        ranged.write.mode("overwrite").parquet(self.path("ranges", number))
        ranged = self.spark.read.schema(ranged.schema).parquet(self.path("ranges", number))
        counts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = waiting.groupBy("shard").agg(F.count("*").alias("held"))
        start = counts.withColumn("before", before).join(heads.select("shard", "batches"), "shard", "left").join(held, "shard", "left")
        start = start.select("shard", "_range", (F.col("before") + F.coalesce("batches", F.lit(0)) * self.size + F.coalesce("held", F.lit(0))).alias("start"))
        place = F.row_number().over(Window.partitionBy("shard", "_range").orderBy(*order, "leaf")) - 1
        return ranged.withColumn("_place", place).join(start.hint("merge"), ["shard", "_range"]).select("shard", (F.col("start") + F.col("_place")).cast("long").alias("seq"), "leaf")

    def append(self, rows: DataFrame, number: int, order: tuple[str, ...], close: bool = False) -> bool:
        """Adds rows (shard, leaf and ``order``, by which they follow each other); false if that append has happened already.

        Numbers rise from append to append; gaps are fine. A null shard is the shard of that name; a null leaf is an error. With ``close``, batches that aren't full are sealed, too.
        """
        done = self.appends()
        if number in done:
            return False
        if done and number < done[-1]:
            raise ValueError(f"append {number} comes after {done[-1]}")
        heads, waiting = self._last("heads", HEADS, done), self._last("waiting", LEAVES, done)
        named = rows.withColumn("shard", F.coalesce(F.col("shard").cast("string"), F.lit("null"))).withColumn("leaf", F.when(F.col("leaf").isNull(), F.raise_error(F.lit("a leaf is null"))).otherwise(F.col("leaf")))
        self.numbered(named, order, number, heads, waiting).write.mode("overwrite").parquet(self.path("leaves", number))
        new = self.spark.read.schema(LEAVES).parquet(self.path("leaves", number))
        due = waiting.unionByName(new)
        full = due.groupBy("shard").agg(F.max("seq").alias("last")).select("shard", ((F.col("last") + 1) if not close else F.expr(f"(last div {self.size} + 1) * {self.size}")).alias("_end"))
        due = due.join(F.broadcast(full), "shard").withColumn("_sealed", F.expr(f"(seq div {self.size} + 1) * {self.size}") <= F.col("_end"))
        sealed = ledger.batches(due.filter("_sealed"), self.size)
        ledger.chained(sealed, heads).write.mode("overwrite").parquet(self.path("batches", number))
        due.filter("not _sealed").select("shard", "seq", "leaf").write.mode("overwrite").parquet(self.path("waiting", number))
        now = self.spark.read.schema(ledger.CHAIN).parquet(self.path("batches", number))
        added = ledger.heads(now).select("shard", F.col("batches").alias("b"), F.col("events").alias("e"), F.col("head").alias("h"))
        both = heads.join(added, "shard", "full_outer")
        both.select("shard", (F.coalesce("batches", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("batches"), (F.coalesce("events", F.lit(0)) + F.coalesce("e", F.lit(0))).alias("events"), F.coalesce("h", "head").alias("head")).write.mode("overwrite").parquet(self.path("heads", number))
        return True
