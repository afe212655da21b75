"""Exact deduplication by two-pass Bloom filtering.

Pass 1 hashes every text and finds the filter bits that two rows or more set: each task fills two maps, of bits set once and
of bits set again, and the maps' pieces are merged, so that no row moves. Pass 2 tests each row against those bits: a row
with a bit that no other row sets is unique and passes straight through; only the others (copies, and a few
false alarms) shuffle, and the shuffle carries a digest, never a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import SPACES, as_bytes, join_groups, keep, small_batches, table, task_id, text_hash, without_rows

PROBES = 3
#: Bits of one piece of a map.
PIECE = 1 << 15


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, sha256 of the text without white space, its code points and a hash of it as it is; null counts as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [hashlib.sha256(t.translate(None, SPACES)).digest() for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.binary()), pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64()), b.column(2)], ["doc_id", "h", "n", "th"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), text_hash(text_col).alias("th")).mapInArrow(hashed, "doc_id long, h binary, n long, th long")


def probes(bits: int) -> list:
    """The filter's bit positions of a row."""
    return [F.pmod(F.xxhash64("h", F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def add_bits(once: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Sets the given positions in the packed map ``once``, and those that it had already, or that repeat, in ``twice``."""
    at, n = np.unique(at, return_counts=True)
    byte, bit = at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)
    again = (n > 1) | (once[byte] & bit != 0)
    np.bitwise_or.at(twice, byte[again], bit[again])
    np.bitwise_or.at(once, byte, bit)


def packed(piece: np.ndarray) -> bytes:
    """A piece of a map: its positions where these are fewer bytes than the bits."""
    at = np.flatnonzero(np.unpackbits(piece, bitorder="little"))
    return at.astype(np.uint16).tobytes() if 2 * len(at) < len(piece) else piece.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The bits of what ``packed`` made."""
    if len(data) == PIECE // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(PIECE, np.uint8)
    bits[np.frombuffer(data, np.uint16)] = 1
    return np.packbits(bits, bitorder="little")


def repeated_bits(rows: DataFrame, bits: int, fan_in: int = 256) -> np.ndarray:
    """The filter: bits that two rows or more set, as packed bytes. At most ``bits / 8`` bytes reach the driver.

    Tasks send pieces of their maps, never rows; pieces are merged as they come, those of ``fan_in`` tasks first.
    """
    kind = "piece int, task long, once binary, twice binary"

    def piece_rows(found: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary()), pa.array([f[3] for f in found], pa.binary())], ["piece", "task", "once", "twice"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            add_bits(once, twice, np.concatenate([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        step = PIECE // 8
        for start in range(0, len(once) // step, 256):
            found = [(k, task_id(), packed(once[k * step : (k + 1) * step]), packed(twice[k * step : (k + 1) * step])) for k in range(start, min(start + 256, len(once) // step)) if once[k * step : (k + 1) * step].any()]
            if found:
                yield piece_rows(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task, once, twice = None, 0, None, None
        for b in batches:
            for r in b.to_pylist():
                if r["piece"] != at:
                    if at is not None:
                        yield piece_rows([(at, task, packed(once), packed(twice))])
                    at, task, once, twice = r["piece"], r["task"], unpacked(r["once"]).copy(), unpacked(r["twice"]).copy()
                else:
                    more = unpacked(r["once"])
                    twice |= (once & more) | unpacked(r["twice"])
                    once |= more
        if at is not None:
            yield piece_rows([(at, task, packed(once), packed(twice))])

    maps = rows.select(*[p.alias(f"p{i}") for i, p in enumerate(probes(bits))]).mapInArrow(local, kind)
    level = maps.repartition("piece", F.expr(f"task div {fan_in}")).sortWithinPartitions("piece", F.expr(f"task div {fan_in}")).mapInArrow(merged, kind)
    out = np.zeros(bits // 8, np.uint8)
    for r in level.repartition("piece").sortWithinPartitions("piece").mapInArrow(merged, kind).select("piece", "twice").collect():
        out[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = unpacked(bytes(r["twice"]))
    return out


def possibly_repeated(rows: DataFrame, bits: int) -> DataFrame:
    """The rows with a column ``again``: false only if no other row has the same digest."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(repeated_bits(rows, bits))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = np.ones(b.num_rows, bool)
            for i in range(PROBES):
                p = b.column(4 + i).to_numpy(zero_copy_only=False)
                held &= (shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(held)], ["doc_id", "h", "n", "th", "again"])

    return rows.select("doc_id", "h", "n", "th", *[p.alias(f"p{i}") for i, p in enumerate(probes(bits))]).mapInArrow(tested, "doc_id long, h binary, n long, th long, again boolean")


def judged(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """What ``exact_dedup`` returns, with hashes of the text as it is and of the one that stays, and repeats: whether the group has other rows."""
    small_batches(docs.sparkSession)
    rows = keep(digests(docs, id_col, text_col))
    n = rows.count()
    bits = min(max_bits, 1 << max(15, (bits_per_row * max(n, 1) - 1).bit_length()))
    tested = possibly_repeated(rows, bits)
    again, once = tested.filter("again").drop("again"), tested.filter("not again").drop("again")
    groups = again.groupBy("h").agg(F.max(F.struct("n", F.bitwise_not("doc_id").alias("inv"), "th")).alias("best"), F.count("*").alias("group_size"))
    groups = keep(groups.select("h", F.bitwise_not("best.inv").alias("keep_id"), F.col("best.th").alias("keep_th"), "group_size"))
    out = join_groups(again, groups, "h", "group_size", n).unionByName(once.withColumns({"keep_id": F.col("doc_id"), "keep_th": F.col("th"), "group_size": F.lit(1).cast("long")}))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("h")).alias("text_sha256"), "th", "keep_th", (F.col("group_size") > 1).alias("repeats"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """Groups equal texts: one row for each row of ``docs`` with doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``. The row with the most code points,
    then the smallest id, stays. The filter has ``bits_per_row`` bits a row, ``max_bits`` at most: beyond it more unique
    rows shuffle their digests, and results stay exact.

    Null and empty texts are equal to one another. Rows that share an id and a text are one document: each is returned,
    counted in group_size and kept or not alike. A null id loses ties against any other. An empty table gives no rows.
    Other columns of ``docs`` are not read, so their names can't clash.
    """
    return judged(docs, id_col, text_col, bits_per_row, max_bits).drop("th", "keep_th", "repeats")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, one of each group, with all their columns.

    A decision holds for the row's id and text together: another text of the same id stays. Of rows that repeat both, one
    stays. Null and empty texts are one group. An empty table stays empty.
    """
    rows = judged(docs, id_col, text_col)
    return without_rows(docs, id_col, text_col, rows.withColumn("kept", F.col("kept") & (F.col("th") == F.col("keep_th"))))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all rows of documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
