"""Language identification in two steps: first the family, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import as_bytes, fold, rows_of, small_batches, table
from emberlog.llm.linear import FEATURES, grams, hinge_fit, sigmoid, windows

# Closely related languages by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "finnic": ["et", "fi"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "malay": ["id", "jv", "ms", "su", "tl"],
    "semitic": ["am", "ar", "he", "mt"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


@dataclass
class LanguageModel:
    """Columns of ``weight`` are machines: one for each family against the rest, then one for each pair within a family."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weight: np.ndarray
    bias: np.ndarray

    def predict(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of margins: the family with the largest, then votes of its pairs, by margin if even."""
        out, score = np.empty(len(margin), object), np.zeros(len(margin))
        best = margin[:, : len(self.families)].argmax(axis=1) if self.families else np.zeros(len(margin), int)
        sure = sigmoid(4 * margin[:, : len(self.families)].max(axis=1)) if len(self.families) > 1 else np.ones(len(margin))
        for f, family in enumerate(self.families):
            mine, langs = best == f, self.languages[family]
            votes = np.zeros((int(mine.sum()), len(langs)))
            for k, (of, a, b) in enumerate(self.pairs):
                if of == family:
                    p = sigmoid(4 * margin[mine, len(self.families) + k])
                    votes[:, langs.index(a)] += (p >= 0.5) + 0.01 * p
                    votes[:, langs.index(b)] += (p < 0.5) + 0.01 * (1 - p)
            won = votes.argmax(axis=1)
            out[mine] = np.array(langs, object)[won]
            within = (votes[np.arange(len(won)), won] / (1.01 * (len(langs) - 1))) if len(langs) > 1 else np.ones(len(won))
            score[mine] = sure[mine] * np.clip(within, 0, 1)
        return out, np.clip(score, 0, 1)


def letters(text: str | None) -> bool:
    """Whether the text has a letter."""
    return bool(text) and any(map(str.isalpha, text))


def ready(text: str) -> bytes:
    """What the features read: lower case, words set apart by one space."""
    return f" {' '.join(text.lower().split())} ".encode()


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and their shares of the text, scaled so that ordinary texts have about unit length."""
    at, n = np.unique(grams(text), return_counts=True)
    return at, n * (20.0 / max(n.sum(), 1))


def train(rows: DataFrame, text_col: str, lang_col: str, rows_a_language: int = 1200, parts: tuple[int, ...] = (60, 250), cost: float = 1.0) -> LanguageModel:
    """Fits all machines on ``rows_a_language`` different texts of each language, the first by a hash of the text. Only their features,
    FEATURES a text at most, come to the driver.

    Besides the whole text, parts of it in the sizes of ``parts`` (in bytes) are learnt, since documents may be short. Languages
    that no row names can't be predicted; without any row, everything is ``und``.
    """
    small_batches(rows.sparkSession)
    keyed = rows.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).filter("t is not null and lang is not null").withColumn("h", F.xxhash64("t"))
    count = keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("count"))  # of different texts: copies don't crowd others out
    least = keyed.join(F.broadcast(count), "lang").filter(F.pmod("h", F.lit(1 << 20)) < F.lit(float(rows_a_language << 20)) / F.col("count") * 1.5 + 64)  # about as many as are asked for
    ranked = least.dropDuplicates(["lang", "t"]).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).filter(F.col("n") <= rows_a_language)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, text, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if letters(text):
                    whole = ready(text)
                    out += [(lang, h, k, *shares(t)) for k, t in enumerate((whole, *windows(whole, parts, h % (1 << 32))))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3].tobytes() for r in out], pa.binary()), pa.array([r[4].tobytes() for r in out], pa.binary())], ["lang", "h", "part", "at", "share"])

    got = ranked.select("lang", "t", "h").mapInArrow(featured, "lang string, h long, part int, at binary, share binary").collect()
    got.sort(key=lambda r: (r["lang"], r["h"], r["part"], r["at"]))
    x, langs = [(np.frombuffer(r["at"], np.uint32), np.frombuffer(r["share"])) for r in got], [r["lang"] for r in got]
    known = sorted(set(langs))
    of = {lang: FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang) for lang in known}
    families = sorted(set(of.values()))
    languages = {f: [lang for lang in known if of[lang] == f] for f in families}
    pairs = [(f, a, b) for f in families for a, b in itertools.combinations(languages[f], 2)]
    langs = np.array(langs, object)
    family = np.array([of[lang] for lang in langs], object)
    fits = []
    for f in families:
        y = np.where(family == f, 1.0, -1.0)
        fits.append(fit(x, y, cost) if len(families) > 1 else (np.zeros(FEATURES), 0.0))
    for _, a, b in pairs:
        mine = np.flatnonzero((langs == a) | (langs == b))
        fits.append(fit([x[i] for i in mine], np.where(langs[mine] == a, 1.0, -1.0), cost))
    weight = np.stack([w for w, _ in fits], axis=1).astype(np.float32) if fits else np.zeros((FEATURES, 0), np.float32)
    return LanguageModel(families, languages, pairs, weight, np.array([b for _, b in fits]))


def fit(x: list, y: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """One machine; both classes weigh the same."""
    balance = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    return hinge_fit(x, y, FEATURES, cost * balance, epochs=10)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``, from the whole text.

    Null texts and texts without a letter are ``und`` with score 0. Equal texts get equal answers; ids may repeat or be
    null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.families, model.languages, model.pairs, model.weight, model.bias))  # not the class: executors may lack it

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*shared.value)
        for whole in batches:
            for b in rows_of(whole, 1 << 20, "t"):
                texts = [x.decode() for x in as_bytes(b.column("t"))]
                codes = [grams(ready(t)) for t in texts]
                margin = np.stack([m.weight[c].sum(axis=0, dtype=np.float64) * (20.0 / max(len(c), 1)) for c in codes]) + m.bias
                lang, score = m.predict(margin)
                ok = np.array([letters(t) for t in texts]) & bool(m.families)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.where(ok, lang, "und"), pa.string()), pa.array(np.where(ok, score, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents; learnt from rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.filter(~held), "text", "lang")
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
