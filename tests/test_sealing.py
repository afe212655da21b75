"""The kept ledger: appends in any cut give one chain, repeats and broken-off appends change nothing."""

import hashlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from emberlog.operators import ledger
from emberlog.operators.lineage import GENESIS
from emberlog.plans.sealing import Ledger
from emberlog.streaming import streams


def rows(n=130, seed=3):
    draw = random.Random(seed)
    return [(draw.choice(["a", "a", "a", "b", None]), i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "shard string, at long, leaf string").repartition(3)


def walked(data, size):
    """Batches and their hashes by plain Python."""

    def root(level):
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0].hex()

    out = []
    for shard in ("a", "b", "null"):
        mine, prev = [bytes.fromhex(leaf) for s, _, leaf in data if (s or "null") == shard], GENESIS
        for i in range(0, len(mine) - size + 1, size):
            top = root(mine[i : i + size])
            after = hashlib.sha256(f"{prev}|{top}|{i // size}|{size}".encode()).hexdigest()
            out.append((shard, i // size, size, top, prev, after))
            prev = after
    return out


def chain(kept):
    return sorted(map(tuple, kept.chain().collect()))


def test_cuts_repeats_and_broken_appends(spark, tmp_path):
    data = rows()
    kept = Ledger(spark, str(tmp_path / "one"), 8)
    assert kept.append(frame(spark, data), 0, ("at",)) and chain(kept) == walked(data, 8)
    parts = Ledger(spark, str(tmp_path / "three"), 8)
    for number, part in ((1, data[:5]), (4, data[5:70]), (5, []), (9, data[70:])):
        assert parts.append(frame(spark, part), number, ("at",))
        assert not parts.append(frame(spark, data[::-1]), number, ("at",))
    assert chain(parts) == chain(kept) and parts.appends() == [1, 4, 5, 9]
    assert ledger.broken(parts.chain()).collect() == []
    assert sorted(map(tuple, parts.heads().collect())) == sorted(map(tuple, kept.heads().collect()))
    assert sorted(map(tuple, parts.leaves().collect())) == sorted(map(tuple, kept.leaves().collect()))
    (tmp_path / "three/heads/append=9/_SUCCESS").unlink()  # broken off before its end
    assert parts.appends() == [1, 4, 5] and len(chain(parts)) < len(chain(kept))
    assert parts.append(frame(spark, data[70:]), 9, ("at",)) and chain(parts) == chain(kept)
    with pytest.raises(ValueError, match="comes after"):
        parts.append(frame(spark, data), 3, ("at",))


def test_closing_seals_what_waits(spark, tmp_path):
    data = rows(20)
    kept = Ledger(spark, str(tmp_path), 8)
    kept.append(frame(spark, data), 0, ("at",), close=True)
    assert kept.waiting().collect() == [] and sum(r["count"] for r in kept.chain().collect()) == 20
    kept.append(frame(spark, data[:3]), 1, ("at",), close=True)
    assert ledger.broken(kept.chain()).collect() == [] and {r["shard"]: r["events"] for r in kept.heads().collect()} == {s: sum((x[0] or "null") == s for x in data) + sum((x[0] or "null") == s for x in data[:3]) for s in {x[0] or "null" for x in data}}
    assert Ledger(spark, str(tmp_path / "none")).chain().collect() == []


def test_micro_batches_seal_once(spark, tmp_path):
    data = rows(60)
    for i in range(3):
        frame(spark, data[i * 20 : i * 20 + 20]).coalesce(1).write.json(str(tmp_path / f"in{i}"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("shard string, at long, leaf string").json(str(tmp_path / "in"))
    kept = Ledger(spark, str(tmp_path / "ledger"), 8)
    for i in range(3):
        next((tmp_path / f"in{i}").glob("part-*")).rename(tmp_path / "in" / f"{i}.json")
        streams.sealed(stream, kept, ("at",), str(tmp_path / "cp")).awaitTermination()
    assert chain(kept) == walked(data, 8)
    shutil.rmtree(tmp_path / "cp/commits")  # the last batches are told again
    streams.sealed(stream, kept, ("at",), str(tmp_path / "cp")).awaitTermination()
    assert chain(kept) == walked(data, 8)


def test_all_checks(spark):
    made = spark.range(40).select(F.lit("s").alias("shard"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("raw_sha256"), F.sha2(F.lit("n"), 256).alias("norm_sha256")).withColumn("leaf", F.sha2(F.concat("raw_sha256", "norm_sha256"), 256))
    chained = ledger.chained(ledger.batches(made, 16))
    now = made.withColumn("norm_sha256", F.when(F.col("seq") == 7, F.lit(None)).otherwise(F.col("norm_sha256")))
    bad = ledger.verified(now, ledger.proofs(made, 16), chained, made, spark.createDataFrame([("s", True)], "shard string, signed boolean")).filter("not verified").collect()
    assert [(r["seq"], r["raw_match"], r["norm_match"], r["signature_match"]) for r in bad] == [(7, True, False, True)]
    assert ledger.verified(now, ledger.proofs(made, 16), chained, made, spark.createDataFrame([], "shard string, signed boolean")).filter("verified").collect() == []


def test_numbering_broadcasts_no_rows(spark, tmp_path):
    """The rows are joined to the starts of their ranges, where they are: a plan may not send them to the driver, however small it takes them to be."""
    kept = Ledger(spark, str(tmp_path / "ledger"), 8)
    named = frame(spark, rows()).fillna({"shard": "null"})
    numbered = kept.numbered(named, ("at",), 0, kept.heads(), kept.waiting())
    joins = [line for line in numbered._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [shard" in line and "_range" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    got = {(r["shard"], r["seq"]): r["leaf"] for r in numbered.collect()}
    want = {shard: [leaf for s, _, leaf in rows() if (s or "null") == shard] for shard in ("a", "b", "null")}
    assert got == {(shard, i): leaf for shard, leaves in want.items() for i, leaf in enumerate(leaves)}
