"""Blocks of vectors: rows packed as matrices within their tasks, and every block beside every block of queries.

A row block is packed where its rows lie, so no key decides where rows go and no copy of a row can make a block hot. Blocks
of queries are broadcast while their counted bytes are few; beyond that both sides are shuffled by (query block, slice).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import keep, small_batches, task_id

#: Bytes of a block's matrix, rows of it at most, and bytes of query blocks that one broadcast may hold.
BLOCK_BYTES, BLOCK_ROWS, BROADCAST_BYTES = 2 << 20, 4096, 32 << 20


def usable(df: DataFrame, id_col: str, vector_col: str, most: float, extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, columns of ``extra``, v): rows whose vector is a non-empty array of finite numbers of at most ``most`` in size."""
    fine = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) <= most))  # nan counts as larger than any number
    rows = df.select(F.col(id_col).cast("long").alias("id"), *[c.alias(n) for n, c in (extra or {}).items()], F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(fine, F.lit(False)))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose vectors have the length that most have (of ties, the longest), and that length; 0 if there are none."""
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return rows.filter(F.size("v") == d), d


def matrix(batch: pa.RecordBatch, dims: int, column: str = "v") -> np.ndarray:
    """The vectors of an Arrow batch, one a row."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], longs: list[str], dims: int, kind: str, rows: int | None) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] | None = None

    def block(n: int) -> pa.RecordBatch:
        cols = [c[:n] for c in held]
        data = {"task": pa.array([task_id()], pa.int64()), "n": pa.array([n], pa.int64())}
        data |= {name: pa.array([c.astype("<i8").tobytes()], pa.binary()) for name, c in zip(longs, cols, strict=False)}
        return pa.RecordBatch.from_pydict(data | {"m": pa.array([cols[-1].astype(kind).tobytes()], pa.binary())})

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in longs] + [matrix(batch, dims)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        while rows and len(held[-1]) >= rows:
            yield block(rows)
            held = [c[rows:] for c in held]
    if held is not None and len(held[-1]):
        yield block(len(held[-1]))


def packed(rows: DataFrame, longs: list[str], dims: int, kind: str = "<f8", block_bytes: int = BLOCK_BYTES, whole_tasks: bool = False) -> DataFrame:
    """One row a block of rows: task, n, each of ``longs`` as 64-bit integers, m: the matrix as ``kind``. With ``whole_tasks``, one block a task."""
    per = None if whole_tasks else max(1, min(BLOCK_ROWS, block_bytes // (8 * max(dims, 1))))
    small_batches(rows.sparkSession)
    return rows.select(*longs, "v").mapInArrow(lambda b: _blocks(b, longs, dims, kind, per), "task long, n long, " + "".join(f"{c} binary, " for c in longs) + "m binary")


def query_blocks(queries: DataFrame, longs: list[str], dims: int, kind: str = "<f8", rows: int = 1024) -> tuple[DataFrame, int, int]:
    """Blocks of about ``rows`` queries, numbered by their column a from 0; how many numbers there are, and how many queries."""
    total = queries.count()
    count = max(1, -(-total // rows))
    return keep(packed(queries.repartition(count), longs, dims, kind, whole_tasks=True).withColumnRenamed("task", "a")), count, total


def beside(rows: DataFrame, queries: DataFrame, count: int, size: int, broadcast_bytes: int = BROADCAST_BYTES, slices: int = 64) -> DataFrame:
    """Each row block beside each query block. Columns of query blocks, but for their number a, must be named apart from those of row blocks.

    ``size``: bytes of all query blocks; over ``broadcast_bytes`` they are shuffled, in as many copies as there are slices of rows.
    """
    small_batches(rows.sparkSession)
    rows = rows.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(queries), "a")
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("ids"), F.lit(slices)))
    queries = queries.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    return rows.join(queries.hint("shuffle_hash"), ["a", "_slice"])


def column(batch: pa.RecordBatch, name: str, kind: str, i: int) -> np.ndarray:
    """A packed column of a block, as an array."""
    return np.frombuffer(batch.column(name)[i].as_py(), kind)
