"""Tamper evidence: leaf digests, one Merkle root for each batch of events, and the chain that links the batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 256
LEVELS = 8
GENESIS = "0" * 64


def joined(tag: str, left: Column, right: Column) -> Column:
    """sha256 of a tag byte and two digests, all in hexadecimal."""
    return F.sha2(F.concat(F.unhex(F.lit(tag)), F.unhex(left), F.unhex(right)), 256)


def leaf(raw_sha256: Column, norm_sha256: Column) -> Column:
    """An event's leaf."""
    return joined("00", raw_sha256, norm_sha256)


def above(level: Column) -> Column:
    """The level over one of a tree; an odd digest moves up as it is."""
    pair = lambda i: F.when(i + 1 < F.size(level), joined("01", F.get(level, i), F.get(level, i + 1))).otherwise(F.get(level, i))
    return F.when(F.size(level) <= 1, level).otherwise(F.transform(F.sequence(F.lit(0), F.size(level) - 1, F.lit(2)), pair))


def tree(leaves: Column) -> Column:
    """All levels over an ordered array of at most 2 ** LEVELS leaves, from the leaves to the root."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(leaves), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def root(leaves: Column) -> Column:
    """The root over an ordered array of at most 2 ** LEVELS leaves; no leaf gives the digest of nothing."""
    top = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), leaves, lambda level, _: above(level))
    return F.coalesce(F.get(top, F.lit(0)), F.sha2(F.lit(""), 256))


def batches(events: DataFrame, seq: str, leaf_col: str, size: int = BATCH) -> DataFrame:
    """batch_id, count, merkle_root of consecutive slices by a sequence number; a group never has more than ``size`` rows."""
    rows = events.groupBy(F.expr(f"{seq} div {size}").alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct(seq, leaf_col))).alias("l"))
    return rows.select("batch_id", F.size("l").cast("long").alias("count"), root(F.transform("l", lambda x: x[leaf_col])).alias("merkle_root"))


def broken_links(chain: DataFrame) -> DataFrame:
    """The batches of a stored chain (batch_id, count, merkle_root, prev_chain, chain_hash) that don't follow from the one before."""
    before = F.lag("chain_hash", 1, GENESIS).over(Window.orderBy("batch_id"))  # one row a batch
    due = F.sha2(F.concat_ws("|", "prev_chain", "merkle_root", F.col("batch_id").cast("string"), F.col("count").cast("string")), 256)
    return chain.withColumn("before", before).filter((F.col("before") != F.col("prev_chain")) | (due != F.col("chain_hash"))).drop("before")
