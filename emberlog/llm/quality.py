"""Quality classifier: naive Bayes support vectors.

Class log-count ratios come from all labelled documents, in one distributed count. The n-gram indicators, scaled by
those ratios, feed a linear hinge-loss model that dual coordinate descent fits on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import VECTORS, as_bytes, fold, small_batches, sum_vectors, table, vector_rows, with_key
from emberlog.llm.linear import FEATURES, hinge_fit, platt, present, sigmoid


@dataclass
class QualityModel:
    """score = sigmoid(slope * (sum of weight over the features present / sqrt(their number) + bias) + offset)."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weight[features].sum() / np.sqrt(max(len(features), 1)) + self.bias)

    def score(self, text: bytes, seen: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(present(text, seen)) + self.offset))


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str, max_fit_rows: int = 6000, smoothing: float = 1.0, cost: float = 1.0, blend: float = 0.25) -> QualityModel:
    """Fits the model on rows with an id, a text and a label 0 or 1.

    The counts cover every row. Rows that repeat an id and a text are fitted once. The fit takes the ``max_fit_rows`` rows that come first by a hash of id and text, a fifth of
    them to turn margins into probabilities. ``blend`` mixes the fitted weights with their mean size, as usual for this
    model. With one class only, or no row, every score is that class's smoothed share.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.xxhash64(id_col, F.col(text_col).cast("string")).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums, n = np.zeros(FEATURES, np.uint8), np.zeros((2, FEATURES)), [0, 0]
        for b in batches:
            for t, y in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                sums[y][present(t, seen)] += 1
                n[y] += 1
        for y in (0, 1):
            if n[y]:
                for pdf in vector_rows(str(y), sums[y], n[y]):
                    yield pa.RecordBatch.from_pandas(pdf, schema=pa.schema([("name", pa.string()), ("chunk", pa.int32()), ("task", pa.int64()), ("weight", pa.float64()), ("values", pa.list_(pa.float64()))]), preserve_index=False)

    sums = sum_vectors(rows.select("t", "y").mapInArrow(counted, VECTORS))
    n = [sums[str(y)][0] if str(y) in sums else 0.0 for y in (0, 1)]
    if min(n) == 0:
        share = (n[1] + 1) / (sum(n) + 2)
        return QualityModel(np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    one, zero = ((sums[y][1] + smoothing) / (sums[y][0] + 2 * smoothing) for y in ("1", "0"))
    ratio = np.log(one / zero)

    first = rows.select("i").orderBy("i").limit(max_fit_rows)
    chosen = sorted({r["i"] for r in first.collect()})
    ids = spark.createDataFrame(pd.DataFrame({"i": chosen}), rows.select("i").schema)
    got = rows.join(F.broadcast(ids), "i").dropDuplicates(["i", "y"]).mapInArrow(featured, "i long, y int, f binary").collect()
    got.sort(key=lambda r: (r["i"], r["y"], r["f"]))
    order = np.random.default_rng(7).permutation(len(got))
    data = [(np.frombuffer(got[k]["f"], np.uint32), got[k]["y"]) for k in order]
    x = [(f, ratio[f] / np.sqrt(max(len(f), 1))) for f, _ in data]
    y = np.array([1.0 if label else -1.0 for _, label in data])
    cut = len(data) - len(data) // 5
    balance = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    w, bias = hinge_fit(x[:cut], y[:cut], FEATURES, cost * balance[:cut])
    used = np.unique(np.concatenate([f for f, _ in x[:cut]] or [np.empty(0, np.uint32)]))
    mean = np.abs(w[used]).mean() if len(used) else 0.0
    weight = ((1 - blend) * w + blend * mean) * ratio
    model = QualityModel(weight, bias, 1.0, 0.0)
    held = slice(cut, None) if len(data) - cut >= 20 and len(set(y[cut:])) == 2 else slice(None)
    model.slope, model.offset = platt(np.array([model.margin(f) for f, _ in data[held]]), y[held])
    return model


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features present in each text, packed."""
    seen = np.zeros(FEATURES, np.uint8)
    for b in batches:
        packed = [present(t, seen).tobytes() for t in as_bytes(b.column("t"))]
        yield pa.RecordBatch.from_arrays([b.column("i").cast(pa.int64()), b.column("y").cast(pa.int32()), pa.array(packed, pa.binary())], ["i", "y", "f"])


def add_score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores between 0 and 1; null and empty texts get the score of a text without features.

    A column of that name in ``docs`` is replaced. Every row stays, equal rows alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.slope, model.offset))  # not the class: executors may lack it
    at = docs.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, model = np.zeros(FEATURES, np.uint8), QualityModel(*shared.value)
        for b in batches:
            s = [model.score(t, seen) for t in as_bytes(b.column(at).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, score_col])

    return docs.mapInArrow(scored, docs.withColumn(score_col, F.lit(0.0)).schema)


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of the learning folds with their label. A document that several rows of ``labels`` mark is marked 0 if one does."""
    marks = labels.filter("quality is not null and doc_id is not null").filter(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.min("quality").alias("label"))
    return with_key(docs.select("doc_id", "text").filter(fold("doc_id", 5) != 0), marks, "doc_id", "inner")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; see ``train`` and ``add_score`` for empty and null values. A null id is not held out and learnt from."""
    model = train(labelled_documents(docs, labels), "doc_id", "text", "label", **options)
    rows = add_score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return rows.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores the threshold or more, with all their columns.

    Null and empty texts score like a text without features. Rows that repeat a text stay or go alike, whatever their id. Without
    labels every text scores 0.5 and stays. An empty table stays empty.
    """
    model = train(labelled_documents(docs, labels), "doc_id", "text", "label")
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"_score{i}") not in docs.columns)
    return add_score(docs, model, score_col=name).filter(F.col(name) >= threshold).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
