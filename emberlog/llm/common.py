"""Helpers shared by the training-data operators.

Nothing here keeps rows on the driver: tables that are used more than once are checkpointed in the shared
folder of ``spark.checkpoint.dir``, and a side is broadcast only when its size has been counted first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.shared import shared_dir

#: The characters of `[\x20\x09-\x0D]`, which end a word.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows that one broadcast may hold; a larger side is shuffled.
BROADCAST_ROWS = 200_000
#: Keys that hold more than one row in so many are few enough to broadcast.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and cuts the lineage there, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Bounds the bytes of one Arrow batch, for texts of very different lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_key(df: DataFrame, key: DataFrame, on: str, hint: str = "left") -> DataFrame:
    """Joins a table that has one row for a key: broadcast if its counted rows are few, else shuffled."""
    return df.join(F.broadcast(key) if key.count() <= BROADCAST_ROWS else key, on, hint)


def text_hash(text_col: str) -> Column:
    """A hash that names a text."""
    return F.xxhash64(F.col(text_col).cast("string"))


def without_rows(docs: DataFrame, id_col: str, text_col: str, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that were kept, by decisions (doc_id, th, kept, and, where rows may repeat, repeats) on their id and text.

    Only ids and hashes of rows that go are joined. Of kept rows that repeat an id and a text, one stays.
    """

    def same(keys: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(keys["_gone_id"]) & (F.xxhash64(docs[text_col].cast("string")) == keys["_gone_th"])

    def keys_of(rows: DataFrame) -> DataFrame:
        rows = keep(rows.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")))
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    gone = keys_of(decisions.filter("not kept").select("doc_id", "th").distinct())
    left = docs.join(gone, same(gone), "left_anti")
    if "repeats" not in decisions.columns:
        return left
    many = keys_of(decisions.filter("kept and repeats").groupBy("doc_id", "th").count().filter("count > 1"))
    if many.isEmpty():
        return left
    return left.join(many, same(many), "left_anti").unionByName(left.join(many, same(many), "left_semi").dropDuplicates([id_col, text_col]))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows with one row for each group of them, where a group may hold a third of all rows.

    Groups of more than total / HOT_SHARE rows are at most HOT_SHARE many: they are broadcast, so that their rows
    stay where they are. The rest is an ordinary shuffle join, in which no key has more rows than that.
    """
    least = max(total // HOT_SHARE, 1000)
    hot = F.broadcast(groups.filter(F.col(size) > least))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(size) <= least), key, how)
    return rows.join(hot, key, "inner").unionByName(cold)


def task_id() -> int:
    """The number of this task's partition."""
    return TaskContext.get().partitionId()


def vector_rows(name: str, vector: np.ndarray, weight: float, chunk: int = 4096, task: int | None = None) -> Iterator[pd.DataFrame]:
    """One task's vector in pieces, as rows for ``sum_vectors``; ``task`` numbers it, if not its partition."""
    at = range(0, len(vector), chunk)
    if len(vector):
        yield pd.DataFrame({"name": name, "chunk": [i // chunk for i in at], "task": task_id() if task is None else task, "weight": float(weight), "values": [vector[i : i + chunk].astype(np.float32 if vector.dtype == np.float32 else np.float64) for i in at]})


VECTORS = "name string, chunk int, task long, weight double, values array<double>"
#: Vectors whose own precision is that: half the bytes to shuffle.
SINGLES = VECTORS.replace("array<double>", "array<float>")


def sum_vectors(parts: DataFrame, fan_in: int = 256, weighed: bool = False) -> dict[str, tuple[float, np.ndarray]]:
    """Adds up the tasks' vectors, piece by piece, in two shuffled levels of bounded groups; in the order of tasks, so that reruns agree.

    Only the sums come to the driver: their size is that of a model, whatever the input's. With ``weighed``, each task's vector counts as often as its weight says.
    """

    def added(pdf: pd.DataFrame, weighed: bool = False) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        values = np.stack(pdf["values"].to_list()).astype(np.float64)
        total = np.sum(values * pdf["weight"].to_numpy()[:, None] if weighed else values, axis=0)
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "task": [pdf["task"].iloc[0]], "weight": [pdf["weight"].sum()], "values": [total]})

    level = parts.groupBy("name", "chunk", F.floor(F.col("task") / fan_in).alias("_block")).applyInPandas(lambda key, pdf: added(pdf, weighed), VECTORS)
    sums = level.groupBy("name", "chunk").applyInPandas(lambda pdf: added(pdf), VECTORS).collect()
    out: dict[str, tuple[float, np.ndarray]] = {}
    for name in sorted({r["name"] for r in sums}):
        mine = sorted((r for r in sums if r["name"] == name), key=lambda r: r["chunk"])
        out[name] = (mine[0]["weight"], np.concatenate([np.asarray(r["values"]) for r in mine]))
    return out


def rows_of(batch: pa.RecordBatch, target_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are of about the given bytes; a longer text gets a slice of its own."""
    sizes = [len(x or b"") for x in batch.column(column).cast(pa.binary()).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > target_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


class Interned(dict):
    """Gives each distinct word a number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class WordHash(dict):
    """64-bit hashes of words, remembered; forgets all when it holds too many."""

    def __init__(self, hasher: Callable[[bytes], int], most: int = 500_000):
        super().__init__()
        self.hasher, self.most = hasher, most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        self[word] = h = self.hasher(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finishing step of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the folds that queries are stated in."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column), F.lit(modulus))
