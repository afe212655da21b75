"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits leaves one of its k + 1 pieces untouched. An Aho-Corasick automaton
finds the exact pieces in each text; every hit names a place where the item may lie, and Myers' bit-parallel distance
verifies that place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import small_batches, table, text_hash, without_rows

OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower case, with one space for each run of anything but letters and digits; a space at either end."""
    return f" {OTHER.sub(' ', (text or '').lower()).strip()} "


def budget(item: str, rate: float) -> int:
    """Edits that an item of this length may have."""
    return int(len(item) * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """Cuts an item into edits + 1 pieces of nearly equal length: (offset, piece)."""
    cut = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def myers(pattern: str, text: str) -> int:
    """The least edit distance between the pattern and any part of the text (bit-parallel; one big integer a column)."""
    m = len(pattern)
    if not m:
        return 0
    full, top, masks = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(d | up) & full, up & d
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(x | rise) & full, rise & x
        best = min(best, score)
    return best


def machine(items: list[tuple[int | None, str]], rate: float) -> ahocorasick.Automaton:
    """The automaton over all pieces; each names the items and offsets that it comes from."""
    found: dict[str, list[tuple[int, int]]] = {}
    for k, (_, item) in enumerate(items):
        for at, piece in pieces(item, budget(item, rate)):
            found.setdefault(piece, []).append((k, at))
    out = ahocorasick.Automaton()
    for piece, places in found.items():
        out.add_word(piece, (len(piece), places))
    out.make_automaton()
    return out


def matches(text: str, items: list[tuple[int | None, str]], auto: ahocorasick.Automaton, rate: float) -> dict[int, int]:
    """The items that occur in a plain text within their budget: {place in items: distance}."""
    places: dict[int, set[int]] = {}
    for end, (n, origins) in auto.iter(text):
        for k, at in origins:
            places.setdefault(k, set()).add(end - n + 1 - at)
    out: dict[int, int] = {}
    for k, starts in places.items():
        item = items[k][1]
        edits, done = budget(item, rate), -1
        for s in sorted(starts):
            if text.startswith(item, max(s, 0)) and s >= 0:
                out[k] = 0
                break
            if s <= done:  # the window before reaches as far
                continue
            done = s + edits
            d = myers(item, text[max(0, s - edits) : s + len(item) + 2 * edits])
            if d <= edits:
                out[k] = min(d, out.get(k, d))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05, block_chars: int = 8_000_000) -> DataFrame:
    """Finds the benchmark items that each document quotes: doc_id, contaminated, n_items, item_ids, best_distance.

    Texts are compared in lower case, with one space for whatever isn't a letter or a digit. An item may have
    ``error_rate`` of its characters in edits. The items are queries against all rows: they go out in blocks of
    ``block_chars`` characters at most, one scan each, so that no broadcast grows with the benchmark.

    Null and empty texts quote nothing; items without a letter or digit match nothing; best_distance is null for clean
    documents. Each row of ``docs`` gets a row, repeated ids too. Items that repeat are reported under each id; items without
    an id are searched like any other and reported as one null id, the last. Without items every document is clean.
    """
    return judged(docs, benchmark, id_col, text_col, item_col, item_text_col, error_rate, block_chars).drop("th")


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05, block_chars: int = 8_000_000) -> DataFrame:
    """What ``contamination`` returns, with th, a hash of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("t is not null")
    blocks = 1 + (items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.array().cast("array<struct<i:bigint,d:int>>").alias("found"))
    kind = "doc_id long, t string, found array<struct<i:bigint,d:int>>"
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(sorted(((r["i"], plain(r["t"])) for r in mine if plain(r["t"]).strip()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = machine(shared.value, error_rate)
            for b in batches:
                out = []
                for t, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    got = matches(plain(t), shared.value, auto, error_rate) if shared.value and t else {}
                    out.append(before + [{"i": shared.value[k][0], "d": d} for k, d in got.items()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, b.schema.field(2).type)], ["doc_id", "t", "found"])

        rows = rows.mapInArrow(scan, kind)
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["i"])))
    return rows.select("doc_id", text_hash("t").alias("th"), (F.size("found") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min(F.transform("found", lambda x: x["d"])).alias("best_distance"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that quote no item, with all their columns.

    A decision holds for the row's id and text together: another text of the same id, or of a null id, stays. Rows that repeat
    both stay or go alike; null and empty texts stay. An empty table stays empty.
    """
    return without_rows(docs, id_col, text_col, judged(docs, benchmark, id_col, text_col).withColumn("kept", ~F.col("contaminated")))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
