"""Hard negatives by distributed radix selection.

Scores are whole numbers. Each anchor and positive has a window of scores; the tasks count, for every window, how many rows of
their blocks fall into each digit's bucket. The counts of all blocks tell in which bucket the k-th score lies, the next
digit is counted inside that bucket only, and after the last digit the k-th score itself is known: then the rows at or above it are
gathered, which are k a window and the ties of the k-th score. Positives are found the same way, with the window of all scores.

A block reports no bucket below its own k-th row: such rows can't be among the first k of all. Nothing else is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import keep, table
from emberlog.llm.vectors import BROADCAST_BYTES, beside, column, of_one_length, packed, query_blocks, usable

SCALE, POSITIVES, NEGATIVES, LOWER, UPPER = 256, 5, 10, 30, 90
#: Bits of a digit; anchors of a block; a component beyond MOST would let a score leave 64 bits.
DIGIT, ANCHORS, MOST = 9, 512, 2.0**16
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _cell(batch: pa.RecordBatch, i: int, dims: int, bound: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of one row block beside one block of anchors, for each window: its number, its anchor's id, how many are wanted, and the scores and ids of the rows in it."""
    windows = np.array([list(w.values()) for w in batch.column("windows")[i].as_py()], np.int64).reshape(-1, 6)
    kind = np.float64 if bound < 2**53 else np.int64
    rows, anchors = column(batch, "m", "<i4", i).reshape(-1, dims).astype(kind), column(batch, "anchor_m", "<i4", i).reshape(-1, dims).astype(kind)
    ids, labels = column(batch, "ids", "<i8", i), column(batch, "labels", "<i8", i)
    anchor_ids, anchor_labels = column(batch, "anchor_ids", "<i8", i), column(batch, "anchor_labels", "<i8", i)
    windows = windows[np.argsort(windows[:, 1], kind="stable")]
    firsts = np.flatnonzero(np.diff(windows[:, 1], prepend=-1))
    for group in np.split(windows, firsts[1:]):
        if not len(group):
            continue
        a = group[0, 1]
        scores = (rows @ anchors[a]).astype(np.int64)
        like = labels == anchor_labels[a]
        other = ids != anchor_ids[a]
        for number, _, low, high, want, same in group:
            at = np.flatnonzero((like & other if same else ~like) & (scores >= low) & (scores <= high))
            if len(at):
                yield number, anchor_ids[a], want, scores[at], ids[at]


def _counted(dims: int, bound: int, shift: int):
    """Counts by window and bucket; from a block, only the buckets down to that of its own last wanted row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for i in range(batch.num_rows):
                for number, _, want, scores, _ in _cell(batch, i, dims, bound):
                    bucket, count = np.unique((scores + bound) >> shift, return_counts=True)
                    bucket, count = bucket[::-1], count[::-1]
                    cut = int(np.searchsorted(np.cumsum(count), want)) + 1
                    out += zip([int(number)] * cut, bucket[:cut].tolist(), count[:cut].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["win", "bucket", "count"])

    return run


def _gathered(dims: int, bound: int, k: int):
    """The rows of each window; of equal scores, at most k a block, those of the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wins, whose, found, who = [], [], [], []
            for i in range(batch.num_rows):
                for number, anchor, _, scores, ids in _cell(batch, i, dims, bound):
                    first = np.lexsort((ids, -scores))[:k]
                    wins.append(np.full(len(first), number))
                    whose.append(np.full(len(first), anchor))
                    found.append(scores[first])
                    who.append(ids[first])
            both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (wins, whose, found, who)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], ["win", "anchor_id", "score", "other_id"])

    return run


def select(blocks: DataFrame, anchors: DataFrame, count: int, size: int, windows: DataFrame, k: int, dims: int, bound: int, broadcast_bytes: int) -> DataFrame:
    """The first k rows of each window (a, win, anchor, low, high, same), by falling score, then id: win, anchor_id, score, other_id, rank.

    Windows of a block of anchors travel with it; there are a bounded number of them.
    """

    def cells(state: DataFrame) -> DataFrame:
        told = state.groupBy("a").agg(F.collect_list(F.struct("win", "anchor", "low", "high", "want", "same")).alias("windows"))
        return beside(blocks.select("ids", "labels", "m"), anchors.join(told, "a"), count, size, broadcast_bytes)

    state = keep(windows.withColumn("want", F.lit(k).cast("long")).withColumn("last", F.col("high")))
    bits = int(2 * bound + 1).bit_length()
    for shift in reversed(range(0, bits, DIGIT)):
        found = cells(state.filter("low < high")).mapInArrow(_counted(dims, bound, shift), "win long, bucket long, count long").groupBy("win", "bucket").agg(F.sum("count").alias("count"))
        order = Window.partitionBy("win").orderBy(F.desc("bucket"))
        summed = found.withColumn("upto", F.sum("count").over(order)).join(state.select("win", "want"), "win").filter("upto >= want").groupBy("win").agg(F.max(F.struct("bucket", (F.col("upto") - F.col("count")).alias("above"))).alias("at"))
        start = F.shiftleft(F.col("at.bucket"), shift) - bound
        narrowed = state.join(summed, "win", "left").withColumns(
            {
                # fewer rows than wanted are in the window: its own end is the threshold, and nothing is left to refine
                "low": F.when(F.col("at").isNull(), F.col("low")).otherwise(F.greatest("low", start)),
                "high": F.when(F.col("at").isNull(), F.col("low")).otherwise(F.least("high", start + (1 << shift) - 1)),
                "want": F.col("want") - F.coalesce(F.col("at.above"), F.lit(0)),
            }
        )
        state = keep(narrowed.drop("at"))
    rows = cells(state.withColumn("high", F.col("last"))).mapInArrow(_gathered(dims, bound, k), "win long, anchor_id long, score long, other_id long")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy(F.desc("score"), "other_id"))).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, shifted_every: int = 7, labels: int = 10, broadcast_bytes: int = BROADCAST_BYTES, block_anchors: int = ANCHORS) -> DataFrame:
    """The hardest negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row takes part if its id and label aren't null and its vector is a non-empty array of finite numbers up to 2^16 in size; if
    vectors differ in length, those of the most frequent length (of ties, the longest) do. Labels of ids divisible by ``shifted_every`` move to
    the next of ``labels`` (0: none move). Anchors are rows whose id is divisible by ``anchor_every``. A row with the anchor's own id is no positive of it.
    Repeated rows stay rows of their own: each fills a rank, and each copy of an anchor has results. An anchor without a positive and a window without a
    negative give no row. Windows are lower*positive_score <= 100*negative_score <= upper*positive_score; a negative positive_score leaves them empty. Other columns are ignored, whatever
    their names. An empty table gives no row.
    """
    spark = vectors.sparkSession
    extra = {"label": F.col(label_col).cast("long")}
    rows, d = of_one_length(usable(vectors, id_col, vector_col, MOST, extra).filter("id is not null and label is not null"))
    if not d:
        return spark.createDataFrame([], SCHEMA)
    moved = F.when(F.col("id") % shifted_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")) if shifted_every else F.col("label")
    rows = rows.select(F.col("id").alias("ids"), moved.alias("labels"), F.transform("v", lambda c: F.floor(c * SCALE).cast("double")).alias("v"))
    blocks = keep(packed(rows, ["ids", "labels"], d, "<i4"))

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [column(batch, "m", "<i4", i).reshape(-1, d).astype(np.float64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({"top": pa.array([float((m * m).sum(1).max()) for m in wide], pa.float64())})

    top = blocks.select("m").mapInArrow(longest, "top double").agg(F.max("top")).first()[0]
    bound = int(top * (1 + 1e-9)) + 1  # no inner product exceeds the square of the greatest length
    anchors, count, total = query_blocks(rows.filter(F.col("ids") % anchor_every == 0), ["ids", "labels"], d, "<i4", block_anchors)
    anchors = anchors.select("a", "n", F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), F.col("m").alias("anchor_m"))
    size = total * (4 * d + 16 + 48 * positives)
    numbers = anchors.select("a", F.explode(F.expr("sequence(0L, n - 1)")).alias("anchor"))
    windows = numbers.select("a", "anchor", (F.shiftleft("a", 24) + F.col("anchor")).alias("win"), F.lit(-bound).cast("long").alias("low"), F.lit(bound).cast("long").alias("high"), F.lit(1).cast("long").alias("same"))
    near = select(blocks, anchors, count, size, windows, positives, d, bound, broadcast_bytes)
    pairs = keep(near.select((F.col("win") * positives + F.col("rank") - 1).alias("pair"), F.shiftright("win", 24).alias("a"), F.expr("win & 16777215").alias("anchor"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    hundreds, rest = F.expr("positive_score div 100"), F.expr("positive_score % 100")  # products with the whole score could overflow
    low, high = hundreds * lower + F.floor((rest * lower + 99) / 100), hundreds * upper + F.floor(rest * upper / 100)
    windows = pairs.filter("positive_score >= 0").select("a", "anchor", F.col("pair").alias("win"), low.alias("low"), high.alias("high"), F.lit(0).cast("long").alias("same")).filter("low <= high")
    far = select(blocks, anchors, count, size, windows, negatives, d, bound, broadcast_bytes)
    return far.join(pairs.withColumnRenamed("pair", "win"), "win").select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: ten negatives for each anchor and positive."""
    return mine(table(spark, sf_dir, "embeddings"))


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
