"""Embedding whitening from a compensated covariance.

Entries are cut to whole numbers, so sums are exact and a centred entry is (n*x - S) / n of two whole numbers: a double and the
rest that it lacks. A task splits its centred rows into slices of so few bits that products of slices add up without rounding,
and adds those outer products to a pair of high and low parts with error-free sums. The parts of all tasks are merged the same
way in two shuffled levels; only the finished matrix, of the square of the dimensions, comes to the driver, where a tridiagonal
divide-and-conquer solver gives the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import small_batches, table, task_id
from emberlog.llm.eigen import eigh
from emberlog.llm.vectors import matrix, of_one_length, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries above this have no whole number of 64 bits.
MOST = 2.0**56
#: Rows whose outer products are added without rounding, bits of a slice, and slices: 21 + 21 bits and 2^10 rows stay below 2^53.
ROWS, BITS, SLICES = 1024, 21, 5
PIECE = 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and exactly what rounding took."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """a * b rounded, and exactly what rounding took, by halves of 26 bits."""
    p = a * b

    def halves(x):
        t = 134217729.0 * x
        high = t - (t - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add_pair(high: np.ndarray, low: np.ndarray, h: np.ndarray, lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (h, lo) as a pair whose high part is the rounded sum."""
    s, e = two_sum(high, h)
    return two_sum(s, e + (low + lo))


def outer_sum(high: np.ndarray, low: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' outer products, of at most ROWS rows of (high, low), as a pair. ``scale``: powers of two, of no less than any entry of a column."""
    slices, rest = [], high
    for k in range(1, SLICES + 1):
        unit = scale * 2.0 ** (-BITS * k)
        if k == 3:  # what is left of the high part is now as small as the low part
            rest = rest + low
        slices.append(np.rint(rest / unit) * unit)
        rest = rest - slices[-1]
    h, lo = np.zeros((high.shape[1],) * 2), np.zeros((high.shape[1],) * 2)
    for i, j in sorted(((i, j) for i in range(SLICES) for j in range(i, SLICES) if i + j < SLICES), key=sum):
        product = slices[i].T @ slices[j]  # exact
        h, lo = add_pair(h, lo, product)
        if i != j:
            h, lo = add_pair(h, lo, product.T)
    return h, lo


def whole(v: np.ndarray) -> np.ndarray:
    """floor(64 c): the whole numbers without their common shift, which no centred figure depends on."""
    return np.floor(SCALE * v).astype(np.int64)


class Centre:
    """The exact centring of a fit list: n, the sums of whole numbers by dimension, and the largest of them in size."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums, self.most = n, sums, most
        self.small = 2 * n * max(most, 1) < 2**62  # n*x and its difference from a sum fit into 64 bits

    def offsets(self, y: np.ndarray) -> np.ndarray:
        """n*x - S, exact: 64-bit integers where they fit, else Python's."""
        kind = np.int64 if self.small else object
        return y.astype(kind) * (self.n if self.small else int(self.n)) - np.array(self.sums, kind)

    def parts(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """offsets / n as a double and the rest."""
        if offsets.dtype == object:
            rounded = offsets / self.n
            high = rounded.astype(np.float64)
            rest = [[(d * q - p * self.n) / (self.n * q) for d, (p, q) in zip(r, map(float.as_integer_ratio, h), strict=True)] for r, h in zip(offsets.tolist(), high.tolist(), strict=True)]
            return high, np.array(rest, np.float64).reshape(high.shape)
        high = offsets.astype(np.float64)
        low = (offsets - high.astype(np.int64)).astype(np.float64)
        q = high / self.n
        p, e = two_product(q, float(self.n))
        return q, ((high - p) + (low - e)) / self.n

    def deviations(self, offsets: np.ndarray) -> list[int | None]:
        """The sum of squared offsets of each row; null beyond a 64-bit integer."""
        if self.small and offsets.shape[1] * (2 * self.n * max(self.most, 1)) ** 2 < 2**63:
            return (offsets * offsets).sum(1).tolist()
        sums = [sum(int(x) * int(x) for x in row) for row in offsets]
        return [s if s < 2**63 else None for s in sums]


def _merged(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Adds the tasks' pairs, piece by piece, in two levels of bounded groups."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        high, low = np.array(pdf["high"].iloc[0]), np.array(pdf["low"].iloc[0])
        for h, lo in zip(pdf["high"].iloc[1:], pdf["low"].iloc[1:], strict=True):
            high, low = add_pair(high, low, h, lo)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "task": pdf["task"].iloc[:1], "high": [high], "low": [low]})

    kind = "piece int, task long, high array<double>, low array<double>"
    level = parts.groupBy("piece", F.floor(F.col("task") / 256).alias("_block")).applyInPandas(lambda _, pdf: merge(pdf), kind)
    rows = sorted(level.groupBy("piece").applyInPandas(merge, kind).collect(), key=lambda r: r["piece"])
    return np.concatenate([r["high"] for r in rows] or [[]]), np.concatenate([r["low"] for r in rows] or [[]])


def covariance(rows: DataFrame, d: int, n: int, values: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, scale: np.ndarray) -> np.ndarray:
    """The mean outer product of ``values`` of all rows, which must be centred, from pairs of high and low parts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        high, low, seen = np.zeros((width, width)), np.zeros((width, width)), False
        for batch in batches:
            v = matrix(batch, d)
            for i in range(0, len(v), ROWS):
                high, low, seen = *add_pair(high, low, *outer_sum(*values(v[i : i + ROWS]), scale)), True
        if seen:
            at = range(0, width * width, PIECE)
            flat = high.ravel(), low.ravel()
            out = {"piece": pa.array([i // PIECE for i in at], pa.int32()), "task": pa.array([task_id()] * len(at), pa.int64())}
            yield pa.RecordBatch.from_pydict(out | {k: pa.array([x[i : i + PIECE].tolist() for i in at], pa.list_(pa.float64())) for k, x in zip(("high", "low"), flat, strict=True)})

    parts = rows.select("v").mapInArrow(sums, "piece int, task long, high array<double>, low array<double>")
    high, low = _merged(parts)
    both = (high / n + low / n).reshape(width, width)
    return (both + both.T) / 2


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit list is every row whose vector isn't null or empty and holds finite numbers only; rows with a null id, with an id or
    vector that repeats, and all-zero vectors are in it. An entry beyond 2^56, which has no 64-bit whole number, counts as not finite. If
    vectors differ in length, those of the most frequent length (of ties, the longest) are the fit list. ``deviation`` is null where
    it exceeds a 64-bit integer. A component without variance (beyond the rank; one row; equal rows) has a null ``whitened``;
    it counts in neither direction in ``identity_error``, which is null if no component has variance. ``explained`` is null if the trace is 0. Other
    columns are ignored, whatever their names. An empty table gives no row. The input is read four times.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows, d = of_one_length(usable(vectors, id_col, vector_col, MOST))
    if not d:
        return spark.createDataFrame([], SCHEMA)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, [0] * d, 0
        for batch in batches:
            y = whole(matrix(batch, d))
            if len(y):
                top = int(np.abs(y).max())
                part = y if top * len(y) < 2**62 else y.astype(object)
                n, sums, most = n + len(y), [a + int(b) for a, b in zip(sums, part.sum(0), strict=True)], max(most, top)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array(sums, pa.decimal128(38, 0)), "most": pa.array([most] * d, pa.int64())})

    by_dim = rows.select("v").mapInArrow(totals, "dim int, n long, s decimal(38,0), most long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")).collect()
    by_dim.sort(key=lambda r: r["dim"])
    centre = Centre(int(by_dim[0]["n"]), [int(r["s"]) for r in by_dim], int(by_dim[0]["most"]))
    n = centre.n
    limit = 2.0 ** np.ceil(np.log2(2.0 * max(centre.most, 1)))
    v = covariance(rows, d, n, lambda a: centre.parts(centre.offsets(whole(a))), d, np.full(d, limit))
    e, unit = eigh(v)
    trace, width = float(np.trace(v)), min(components, d)
    rank = int((e[:width] > max(e[0], 0.0) * d * 2.0**-50).sum())
    turn = unit[:, :rank] / np.sqrt(e[:rank])

    def projected(a: np.ndarray) -> np.ndarray:
        return centre.parts(centre.offsets(whole(a)))[0] @ turn

    error = None
    if rank:
        reach = 2.0 ** np.ceil(np.log2(limit * np.abs(turn).sum(0)))
        after = covariance(rows, d, n, lambda a: (w := projected(a), np.zeros_like(w)), rank, reach)  # the projected rows are centred, too
        error = float(np.abs(after - np.eye(rank)).max())
    explained = [float(x) / trace if trace > 0 else None for x in np.maximum(e[:width], 0.0)]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                offsets = centre.offsets(whole(matrix(part, d)))
                m = part.num_rows
                white = np.full((m, width), np.nan)
                white[:, :rank] = centre.parts(offsets)[0] @ turn
                flat = white.ravel()
                at = pa.array(np.repeat(np.arange(m), width))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column("id").take(at),
                        "component": pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)),
                        "n": pa.array(np.full(m * width, n)),
                        "deviation": pa.array(centre.deviations(offsets), pa.int64()).take(at),
                        "whitened": pa.array(flat, mask=np.isnan(flat)),
                        "explained": pa.array(explained * m, pa.float64()),
                        "identity_error": pa.array([error] * (m * width), pa.float64()),
                    }
                )

    return rows.select("id", "v").mapInArrow(results, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, 32 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
