"""The ledger: chained batches, inclusion proofs, checks of events and of the chain, signed heads and the audit trail.

A chain is sequential by nature. There is one for each shard (a day, a collector), so that shards run side by side; a task
walks its shards' batches in order and holds one hash at a time. Checking needs no walk: every link is compared with the row before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators.lineage import BATCH, GENESIS, joined, root, tree

CHAIN = "shard string, batch_id long, count long, merkle_root string, prev_chain string, chain_hash string"


def link(prev: Column, merkle_root: Column, batch_id: Column, count: Column) -> Column:
    """The hash that ties a batch to the one before."""
    return F.sha2(F.concat_ws("|", prev, merkle_root, batch_id.cast("string"), count.cast("string")), 256)


def batches(leaves: DataFrame, size: int = BATCH) -> DataFrame:
    """shard, batch_id, count, merkle_root of rows (shard, seq, leaf); a group never has more than ``size`` rows."""
    grouped = leaves.groupBy("shard", F.expr(f"seq div {size}").alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "leaf"))).alias("l"))
    return grouped.select("shard", "batch_id", F.size("l").cast("long").alias("count"), root(F.col("l.leaf")).alias("merkle_root"))


def chained(sealed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Adds prev_chain and chain_hash to batches, in the order of batch_id within each shard; from the heads (shard, head) of ``stored``, where a shard has one."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, prev = object(), GENESIS
        for pdf in parts:
            before, after = [], []
            for row in pdf.itertuples(index=False):
                if row.shard != shard:
                    shard, prev = row.shard, row.head or GENESIS
                before.append(prev)
                prev = hashlib.sha256(f"{prev}|{row.merkle_root}|{row.batch_id}|{row.count}".encode()).hexdigest()
                after.append(prev)
            yield pdf.drop(columns="head").assign(prev_chain=before, chain_hash=after)

    rows = sealed.select("shard", "batch_id", "count", "merkle_root")
    rows = rows.withColumn("head", F.lit(None).cast("string")) if stored is None else rows.join(stored.select("shard", "head"), "shard", "left")
    return rows.repartition("shard").sortWithinPartitions("shard", "batch_id").mapInPandas(walk, CHAIN)


def broken(chain: DataFrame) -> DataFrame:
    """(shard, batch_id, reason) of batches that don't follow from the one before: a gap in the numbers, a wrong link or a wrong hash."""
    order = Window.partitionBy("shard").orderBy("batch_id")
    seen = chain.withColumns({"before": F.lag("chain_hash", 1, GENESIS).over(order), "number": F.lag("batch_id", 1).over(order)})
    reason = F.when(F.col("batch_id") != F.coalesce(F.col("number") + 1, F.lit(0)), "gap").when(~F.col("prev_chain").eqNullSafe(F.col("before")), "link")
    reason = reason.when(~F.col("chain_hash").eqNullSafe(link(F.col("prev_chain"), F.col("merkle_root"), F.col("batch_id"), F.col("count"))), "hash")
    return seen.withColumn("reason", reason).filter("reason is not null").select("shard", "batch_id", "reason")


def proof(levels: Column, at: Column) -> Column:
    """The siblings from a leaf to the root, out of the tree's levels, as structs (left, digest); ``left`` says that the sibling stands before."""

    def step(level: Column, k: Column) -> Column:
        i = F.call_function("shiftright", at.cast("int"), k)
        other = i + 1 - 2 * (i % 2)
        return F.when(other < F.size(level), F.struct((other < i).alias("left"), F.get(level, other).alias("digest")))

    return F.array_compact(F.transform(levels, step))


def proven(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.when(s["left"], joined("01", s["digest"], h)).otherwise(joined("01", h, s["digest"])))


def proofs(leaves: DataFrame, size: int = BATCH) -> DataFrame:
    """shard, seq, batch_id, leaf and path for each row (shard, seq, leaf). A batch's tree is built once, and all its paths are read from it."""
    grouped = leaves.groupBy("shard", F.expr(f"seq div {size}").alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "leaf"))).alias("l"))
    trees = grouped.select("shard", "batch_id", "l", tree(F.col("l.leaf")).alias("levels"))
    each = trees.select("shard", "batch_id", F.explode(F.transform("l", lambda x, at: F.struct(x["seq"], x["leaf"], proof(F.col("levels"), at).alias("path")))).alias("x"))
    return each.select("shard", "x.seq", "batch_id", "x.leaf", "x.path")


def verified(events: DataFrame, proofs_: DataFrame, chain: DataFrame, digests: DataFrame | None = None, signed: DataFrame | None = None) -> DataFrame:
    """Checks of events (shard, seq, leaf as computed anew): known, leaf_match, proof_match, link_match, and verified, all of them.

    With ``digests``, the stored (shard, seq, raw_sha256, norm_sha256), events must have these columns, too, as computed anew, and are checked for raw_match and
    norm_match. With ``signed``, (shard, signed): whether a head that covers the shard has a valid signature, there is signature_match.
    """
    bad = broken(chain).select("shard", "batch_id", "reason")
    sound = chain.join(bad, ["shard", "batch_id"], "left").select("shard", "batch_id", "merkle_root", F.col("reason").isNull().alias("sound"))
    stored = proofs_.join(sound, ["shard", "batch_id"], "left").withColumnRenamed("leaf", "stored_leaf")
    out = events.join(stored, ["shard", "seq"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    out = out.select("shard", "seq", F.col("stored_leaf").isNotNull().alias("known"), no(F.col("leaf") == F.col("stored_leaf")).alias("leaf_match"), no(proven(F.col("leaf"), F.col("path")) == F.col("merkle_root")).alias("proof_match"), no(F.col("sound")).alias("link_match"))
    checks = ["known", "leaf_match", "proof_match", "link_match"]
    if digests is not None:
        both = events.select("shard", "seq", "raw_sha256", "norm_sha256").join(digests.select("shard", "seq", F.col("raw_sha256").alias("_raw"), F.col("norm_sha256").alias("_norm")), ["shard", "seq"], "left")
        out = out.join(both.select("shard", "seq", no(F.col("raw_sha256") == F.col("_raw")).alias("raw_match"), no(F.col("norm_sha256") == F.col("_norm")).alias("norm_match")), ["shard", "seq"], "left")
        checks += ["raw_match", "norm_match"]
    if signed is not None:
        out = out.join(signed.select("shard", F.col("signed").alias("signature_match")), "shard", "left").withColumn("signature_match", no(F.col("signature_match")))
        checks += ["signature_match"]
    return out.select("shard", "seq", *checks).withColumn("verified", reduce(Column.__and__, [no(F.col(c)) for c in checks]))


def heads(chain: DataFrame) -> DataFrame:
    """Of each shard the number of batches and events and the last hash: what gets signed and published."""
    return chain.groupBy("shard").agg(F.count("*").alias("batches"), F.sum("count").alias("events"), F.max_by("chain_hash", "batch_id").alias("head"))


def broken_audit(records: DataFrame) -> DataFrame:
    """The records (n, ts, actor, action, detail, prev, hash) of an audit trail that don't follow from the one before."""
    due = F.sha2(F.concat_ws("|", "prev", F.to_json(F.struct("action", "actor", "detail", "prev", "ts"))), 256)
    before = F.lag("hash", 1, GENESIS).over(Window.orderBy("n"))  # a trail has a row for each act of a person
    return records.withColumns({"before": before, "due": due}).filter(~F.col("before").eqNullSafe(F.col("prev")) | ~F.col("due").eqNullSafe(F.col("hash"))).drop("before", "due")


class Signer:
    """Ed25519 signatures of the heads, by the JVM's provider. Heads are few: one for each shard."""

    def __init__(self, spark: SparkSession):
        self.security = spark._jvm.java.security
        pair = self.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
        self.private, self.public = pair.getPrivate(), pair.getPublic()

    def sign(self, digest: str) -> bytes:
        tool = self.security.Signature.getInstance("Ed25519")
        tool.initSign(self.private)
        tool.update(bytearray.fromhex(digest))
        return bytes(tool.sign())

    def verify(self, digest: str, signature: bytes) -> bool:
        tool = self.security.Signature.getInstance("Ed25519")
        tool.initVerify(self.public)
        tool.update(bytearray.fromhex(digest))
        return bool(tool.verify(bytearray(signature)))
