"""Nearest neighbours by inner product: a vantage-point tree in each shard, pruned by the triangle inequality.

A shard is a block of rows. One more coordinate lifts its vectors to a common length, so that the largest inner product is the
smallest distance. A tree is an order of the shard's rows and, for every node, its vantage point and the least and greatest distance of the rows
in each half from it. All queries of a block go down together: first each to the leaf it would lie in, which bounds its k-th
distance, then through the whole tree, leaving out a half that no row nearer than factor times that bound can lie in. Factor one is
exact; a smaller one looks at fewer rows. Shards report their k best, and the first k of all shards are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import keep, table
from emberlog.llm.vectors import BROADCAST_BYTES, beside, column, of_one_length, packed, query_blocks, usable

NEIGHBOURS, LEAF, FACTOR, QUERIES = 20, 128, 1.0, 1024
#: A larger component's square could leave the range of a double.
MOST = 1e150
#: What rounding may add to a squared distance, in units of the squared lengths: pruning allows for it.
SLACK = 1e-12
SCHEMA = "query_id long, rank int, vec_id long, score double"


def lifted(m: np.ndarray) -> tuple[np.ndarray, float]:
    """The rows with one more coordinate, which makes them all as long as the longest; and that length squared."""
    square = (m * m).sum(1)
    top = float(square.max(initial=0.0))
    return np.column_stack([m, np.sqrt(np.maximum(top - square, 0.0))]), top


class Tree:
    """A vantage-point tree over the rows of a matrix: an order of the rows, and (start, end, middle, vantage row, least and greatest distance left, and right) of inner nodes, in order of depth first."""

    def __init__(self, m: np.ndarray, leaf: int = LEAF):
        self.order, nodes = np.arange(len(m)), []
        rows, _ = lifted(m)
        todo = [(0, len(m))]
        while todo:
            start, end = todo.pop()
            if end - start <= leaf:
                nodes.append((start, end, -1, -1, 0.0, 0.0, 0.0, 0.0))
                continue
            part = self.order[start:end]
            # the vantage point: the row farthest from the first row, whose distances spread most
            vantage = part[np.argmax(((rows[part] - rows[part[0]]) ** 2).sum(1))]
            away = np.sqrt(((rows[part] - rows[vantage]) ** 2).sum(1))
            half = (end - start) // 2
            by = np.argpartition(away, half)
            self.order[start:end], away = part[by], away[by]
            near, far = away[:half], away[half:]
            nodes.append((start, end, start + half, int(vantage), near.min(), near.max(), far.min(), far.max()))
            todo += [(start + half, end), (start, start + half)]
        self.nodes = np.array(nodes, np.float64).reshape(-1, 8)

    def packed(self) -> tuple[bytes, bytes]:
        return self.order.astype("<i4").tobytes(), self.nodes.astype("<f8").tobytes()


class Search:
    """The k nearest rows of one shard for all queries of a block."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, order: np.ndarray, nodes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.ids, self.order, self.nodes, self.query_ids, self.queries, self.k, self.factor = ids, order, nodes, query_ids, queries, k, factor
        self.m = m[order]  # leaves are slices
        self.rows, top = lifted(m)
        self.squares = (queries * queries).sum(1) + top  # distance^2 = this - 2 * product
        self.best = np.full((len(queries), k), -np.inf)  # products, falling
        self.at = np.full((len(queries), k), -1)
        self.seen = 0
        self.starts = {int(n[0]) << 32 | int(n[1]): i for i, n in enumerate(nodes)}

    def child(self, start: int, end: int) -> int:
        return self.starts[start << 32 | end]

    def look(self, start: int, end: int, who: np.ndarray) -> None:
        """Meets the queries with the rows of a leaf. Of equal products, the smaller ids stay."""
        self.seen += len(who) * (end - start)
        products = dots(self.queries[who], self.m[start:end])
        ids = self.ids[self.order[start:end]]
        products[self.query_ids[who][:, None] == ids[None, :]] = -np.inf
        hopeful = products.max(1, initial=-np.inf) >= self.best[who, -1]
        who, products = who[hopeful], products[hopeful]
        if not len(who):
            return
        both = np.concatenate([self.best[who], products], 1)
        places = np.concatenate([self.at[who], np.broadcast_to(np.arange(start, end), products.shape)], 1)
        named = np.where(places >= 0, self.ids[self.order[places]], np.iinfo(np.int64).max)
        first = np.lexsort((named, -both), axis=1)[:, : self.k]
        self.best[who], self.at[who] = np.take_along_axis(both, first, 1), np.take_along_axis(places, first, 1)
        self.at[who] = np.where(np.isneginf(self.best[who]), -1, self.at[who])

    def distances(self, vantage: int, who: np.ndarray) -> np.ndarray:
        """How far the queries, which have 0 as their further coordinate, are from a row."""
        return np.sqrt(np.maximum(self.squares[who] - 2 * (self.queries[who] @ self.rows[vantage, :-1]), 0.0))

    def run(self) -> None:
        everyone = np.arange(len(self.queries))
        home = np.full(len(everyone), -1)
        todo = [(0, everyone)] if len(self.nodes) else []
        while todo:  # each query to the leaf on its side of every vantage point
            i, who = todo.pop()
            start, end, middle, vantage, _, inner, outer, _ = self.nodes[i]
            if not len(who):
                continue
            if middle < 0:
                home[who] = i
                self.look(int(start), int(end), who)
                continue
            left = self.distances(int(vantage), who) <= (inner + outer) / 2
            todo += [(self.child(int(start), int(middle)), who[left]), (self.child(int(middle), int(end)), who[~left])]
        todo = [(0, everyone)] if len(self.nodes) else []
        while todo:
            i, who = todo.pop()
            start, end, middle, vantage, *bounds = self.nodes[i]
            if middle < 0:
                who = who[home[who] != i]
                if len(who):
                    self.look(int(start), int(end), who)
                continue
            away = self.distances(int(vantage), who)
            for (s, e), (least, most) in zip(((middle, end), (start, middle)), (bounds[2:], bounds[:2]), strict=True):
                with np.errstate(invalid="ignore"):
                    reach = np.sqrt(np.maximum(self.squares[who] * (1 + SLACK) - 2 * self.best[who, -1], 0.0))  # the k-th distance so far
                    gap = np.maximum(away - most, least - away)
                    inside = gap <= self.factor * reach + np.sqrt(SLACK * self.squares[who])
                if inside.any():
                    todo.append((self.child(int(s), int(e)), who[inside]))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, each summed from the first dimension to the last, so that a pair has one score in whatever block it meets."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += np.multiply.outer(x, y)
    return out


def _built(dims: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [Tree(column(batch, "m", "<f8", i).reshape(-1, dims), leaf).packed() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("m"), *(pa.array([t[k] for t in trees], pa.binary()) for k in (0, 1))], ["ids", "m", "tree_order", "tree_nodes"])

    return run


def _searched(dims: int, k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids = column(batch, "query_ids", "<i8", i)
                search = Search(column(batch, "ids", "<i8", i), column(batch, "m", "<f8", i).reshape(-1, dims), column(batch, "tree_order", "<i4", i), column(batch, "tree_nodes", "<f8", i).reshape(-1, 8), query_ids, column(batch, "query_m", "<f8", i).reshape(-1, dims), k, factor)
                search.run()
                who, rank = np.nonzero(search.at >= 0)
                found = search.ids[search.order[search.at[who, rank]]]
                number = (int(batch.column("a")[i].as_py()) << 24) + who
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, query_ids[who], found, search.best[who, rank])], ["query", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = NEIGHBOURS, factor: float = FACTOR, leaf: int = LEAF, shard_bytes: int = 2 << 20, block_queries: int = QUERIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each query's k nearest rows by inner product: query_id, rank, vec_id, score.

    Queries are rows whose id is divisible by ``every``; candidates are all rows but those with the query's own id. Rows with a null id or a
    vector that is null, empty, zero or holds null or non-finite entries (or larger than 1e150) take no part; if vectors differ in length, those of the
    most frequent length (of ties, the longest) do. Repeated rows are rows of their own: each fills a rank, and each copy of a
    query has results. ``factor`` in (0, 1] relaxes pruning; one is exact. Other columns are ignored, whatever their names. An empty table gives no row.
    """
    spark = vectors.sparkSession
    rows, d = of_one_length(usable(vectors, id_col, vector_col, MOST).filter("id is not null and exists(v, c -> c <> 0)"))
    if not d:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.withColumnRenamed("id", "ids")
    shards = keep(packed(rows, ["ids"], d, block_bytes=shard_bytes).mapInArrow(_built(d, leaf), "ids binary, m binary, tree_order binary, tree_nodes binary"))
    queries, count, total = query_blocks(rows.filter(F.col("ids") % every == 0), ["ids"], d, rows=block_queries)
    queries = queries.select("a", F.col("ids").alias("query_ids"), F.col("m").alias("query_m"))
    found = beside(shards, queries, count, total * (8 * d + 8), broadcast_bytes).mapInArrow(_searched(d, k, factor), "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, exactly: twenty neighbours of each twentieth row."""
    return search(table(spark, sf_dir, "embeddings"))


SQL = """
WITH rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b, 0.0::DOUBLE) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
