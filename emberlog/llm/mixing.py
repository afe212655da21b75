"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Every source's documents are shuffled into one stream of words and cut into blocks of equal words, by the source's own size. Slot i
of the mix is the i-th golden-ratio point of [0, 1), mapped through the cumulative targets of the sources, counted in their
blocks; the slots of a source, ranked, take its blocks in turn and begin again when the stream ends. A document gets the words of it that its blocks
hold, as often as they are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import keep, table

WORD = r"[^\x20\x09-\x0D]+"
#: Points are multiples of 2^-32; STEP is 2^32 divided by the golden ratio.
ONE, STEP = 1 << 32, 2654435769
GRID = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """For each source (src, cap in words): weight and target.

    Sources in the order of code points, null last, get the weights in turn. A source reaches its cap when cap / weight
    is below the common level; in that order the level after k capped sources is what is left over the weights left, and
    the first level that caps no further source holds. One row a source, so these windows are small.
    """
    order = Window.orderBy(F.col("src").isNull(), F.col("src"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").isNull(), F.col("src"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.get(turn, ((F.row_number().over(order) - 1) % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    s = s.withColumns({"total": F.sum("source_size").over(everything) * share, "caps": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "left": F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("level", F.greatest(F.lit(0.0), F.col("total") - F.col("caps")) / F.col("left"))
    held = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level"))).over(everything)["level"]
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("w") * held, F.col("cap")))).select("src", "source_size", "w", "target")


def running(rows: DataFrame, keys: list[str], chunk: Column, order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, within the keys, in the order of chunk, then ``order``.

    A key may hold a third of all rows: the sum runs within (key, chunk), and the chunks' totals are summed apart.
    """
    rows = rows.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(totals.drop("_sum"), [*keys, "_chunk"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within", "_chunk")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """The mix: slot, k (number of its source), turn (its rank among that source's slots).

    ``sources`` has k, lo and hi: the part of [0, 2^32) that is the source's. The points find their part through a
    grid of cells, by an equality join.
    """
    high, low = F.shiftright(F.pmod("slot", F.lit(ONE)), 16), F.pmod("slot", F.lit(1 << 16))
    point = F.pmod(F.shiftleft(F.pmod(high * STEP, F.lit(1 << 16)), 16) + low * STEP, F.lit(ONE))  # slot * STEP modulo 2^32, without overflow
    points = sources.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("p", point).withColumn("cell", F.expr(f"p div {ONE // GRID}"))
    cells = sources.filter("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo div {ONE // GRID}, (hi - 1) div {ONE // GRID})")))
    placed = points.join(F.broadcast(cells) if sources.count() <= 10_000 else cells, "cell").filter("p >= lo and p < hi").select("slot", "k", F.lit(1).alias("one"))
    return running(placed, ["k"], F.expr("slot div 65536"), ["slot"], "one", "turn").drop("one")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, slots_a_source: int = 4096, block_words: int = 65536, seed: int = 10) -> DataFrame:
    """Takes words of all sources by their targets: doc_id, size, source_size, target, taken, source, first_slot.

    A size is a text's words (null: 0). The sources' targets share ``share`` of all sizes by weight; none exceeds
    ``most`` times its source's size, and the excess goes to the others. A source's block has so many words that it
    has ``slots_a_source`` blocks, one word at least and ``block_words`` at most. A source's taken words differ from its target by
    a few of its blocks; blocks past ``most`` passes over a source are left out, so no document exceeds ``most`` times its size.
    first_slot is where in the mix a document's first block comes (null: never).

    Null sources are one source, the last. Documents without words take none and stay in the result. Rows that repeat an
    id each have their own words; equal rows may stand in for one another. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("src"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(id_col, text_col, F.lit(seed)).alias("h"))  # of id and text: a null or repeated id is no hot chunk
    rows = keep(rows)
    sizes = targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = keep(sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("src").isNull(), "src"))).coalesce(1))
    length = F.least(F.greatest(F.expr(f"source_size div {slots_a_source}"), F.lit(1)), F.lit(block_words)).cast("long")
    sources = keep(sources.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long")))
    total, count = sources.agg(F.coalesce(F.sum(F.col("target") / F.col("length")), F.lit(0.0)), F.count("*")).first()
    slots = int(round(total))
    upto = F.sum(F.col("target") / F.col("length")).over(Window.orderBy("k"))
    edges = sources.withColumn("hi", F.round(upto / F.lit(max(total, 1.0)) * ONE).cast("long")).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("k")), F.lit(0)))
    taken = schedule(edges.select("k", "lo", "hi"), slots).join(F.broadcast(sources.select("k", "blocks")) if count <= 10_000 else sources.select("k", "blocks"), "k")
    taken = taken.filter(F.col("blocks") > 0).filter(F.col("turn") < F.col("blocks") * int(most)).groupBy("k", F.expr("turn % blocks").alias("block")).agg(F.count("*").alias("times"), F.min("slot").alias("first_slot"))

    one = sources.select("src", "k", "source_size", "target", "length")
    same = F.broadcast(one) if count <= 10_000 else one
    placed = rows.join(same, rows["src"].eqNullSafe(one["src"])).drop(one["src"])
    chunks = max(1, min(1 << 16, rows.count() // 4096))
    placed = keep(running(placed, ["k"], F.pmod("h", F.lit(chunks)), ["h", "doc_id", "size"], "size", "start"))
    parts = placed.filter("size > 0").select("k", "start", "size", "length", F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest(F.col("start"), F.col("block") * F.col("length"))
    got = parts.join(taken, ["k", "block"]).groupBy("k", "start", F.lit(True).alias("has")).agg(F.sum(words * F.col("times")).alias("taken"), F.min("first_slot").alias("first_slot"))
    out = placed.withColumn("has", F.col("size") > 0).join(got, ["k", "start", "has"], "left")  # with words, k and start name one row
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("src").alias("source"), "first_slot")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents."""
    return mix(table(spark, sf_dir, "documents"))


#: What SQL can say of the result: sizes and targets. Taken words depend on the shuffle. Caps take at most as many rounds as there are sources.
SHARES_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (SELECT source, source_size, n, [3, 1, 2][(n - 1) % 3 + 1] AS weight, 2.0 * source_size AS cap FROM s),
fill AS (
  SELECT 0 AS round, n, weight, cap, false AS capped, 1.5 * sum(source_size) OVER () * weight / sum(weight) OVER () AS target FROM w
  UNION ALL
  SELECT round + 1, n, weight, cap, capped OR target > cap,
         CASE WHEN capped OR target > cap THEN cap ELSE
           (sum(target) OVER () - sum(CASE WHEN capped OR target > cap THEN cap ELSE 0 END) OVER ()) * weight
           / nullif(sum(CASE WHEN capped OR target > cap THEN 0 ELSE weight END) OVER (), 0) END
  FROM fill WHERE round < (SELECT count(*) FROM w)
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, w.source_size, CAST(f.target AS DOUBLE) AS target
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN fill f ON f.n = w.n AND f.round = (SELECT max(round) FROM fill)
"""
