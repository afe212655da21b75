"""Unknown sources: fingerprints of lines, clusters, and templates of free text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.network import let

# What varies in a line, in the order in which it is masked, and the pattern that reads it back.
MASKS = {
    "MAC": r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{2}[:\-]){5}[0-9a-fA-F]{2}(?![A-Za-z0-9])",
    "IP": r"(?<![A-Za-z0-9])(?:\d{1,3}\.){3}\d{1,3}(?![A-Za-z0-9])",
    "NUM": r"(?<![A-Za-z0-9.])\d+(?![A-Za-z0-9.])",
}
READ = {"MAC": r"(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}", "IP": r"\d{1,3}(?:\.\d{1,3}){3}", "NUM": r"\d+", "*": r"\S+"}


def fingerprint(raw: Column, format_: Column, fields: Column) -> Column:
    """(fingerprint, label): lines of one shape share it. ``fields`` are those of the syslog header, or null."""
    return let(F.struct(raw.alias("raw"), format_.alias("format"), fields.alias("fields")), lambda x: shape(x["raw"], x["format"], x["fields"]))


def shape(raw: Column, format_: Column, fields: Column) -> Column:
    """``fingerprint`` of columns that cost nothing to read again."""
    part = lambda name: F.try_element_at(fields, F.lit(name))
    body = F.coalesce(part("message"), raw)
    base = F.when(fields.isNotNull(), F.concat(F.lit("syslog:"), F.coalesce(part("syslog_app"), part("syslog_host"), F.lit("?")))).otherwise(format_)
    head = lambda mark: F.concat(F.lower(F.lit(mark)), F.array_join(F.slice(F.split(F.substring(raw, F.instr(raw, mark), F.length(raw)), r"\|"), 2, 2), "|"))
    keys = lambda pattern: F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), 1))), 1, 12)
    pairs, names = keys(r"(?:^|\s)([A-Za-z_][\w.\-]*)="), keys(r'"([A-Za-z_][\w.\-]*)"\s*:')
    start = F.array_join(F.slice(F.filter(F.split(F.regexp_replace(body, r"\d+", "#"), r"\s+"), lambda t: t != ""), 1, 3), " ")
    key = F.when(format_ == "cef", head("CEF:")).when(format_ == "leef", head("LEEF:")).when(format_ == "kv", F.concat(F.lit("kv:"), F.array_join(pairs, ","))).when(format_ == "json", F.concat(F.lit("json:"), F.array_join(names, ","))).otherwise(F.concat(base, F.lit(":"), start))
    label = F.when(format_ == "cef", head("CEF:")).when(format_ == "leef", head("LEEF:")).when(format_ == "kv", F.concat(base, F.lit(" kv("), F.size(pairs).cast("string"), F.lit(" keys)"))).otherwise(base)
    return F.struct(F.substring(F.sha2(key, 256), 1, 12).alias("fingerprint"), label.alias("label"))


def clusters(lines: DataFrame, samples: int = 200) -> DataFrame:
    """fingerprint, label, count, first and last time and the ``samples`` newest lines of each cluster, from (raw, received_ms, print).

    Counts merge before the shuffle, and so does the choice of lines: Spark limits each task's rows of a cluster first.
    """
    rows = lines.select("raw", "received_ms", "print.*")
    counted = rows.groupBy("fingerprint").agg(F.min("label").alias("label"), F.count("*").alias("count"), F.min("received_ms").alias("first_ms"), F.max("received_ms").alias("last_ms"))
    order = Window.partitionBy("fingerprint").orderBy(F.desc("received_ms"), "raw")
    top = rows.select("fingerprint", "received_ms", "raw").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= samples)
    shown = top.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("nth", "raw"))).alias("l")).select("fingerprint", F.col("l.raw").alias("samples"))
    return counted.join(shown, "fingerprint")


def masked(text: Column) -> Column:
    """A line with its addresses and numbers as ``<MAC>``, ``<IP>``, ``<NUM>`` and single blanks."""
    for name, pattern in MASKS.items():
        text = F.regexp_replace(text, pattern, f"<{name}>")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def templates(lines: DataFrame, text: str = "raw", similar: float = 0.4) -> DataFrame:
    """template, count: lines of as many tokens and the same start whose other tokens agree to ``similar`` share a template; ``<*>`` is what differs.

    Equal masked lines are counted first, with partial sums. Only distinct ones are sorted by bucket, the frequent first, and walked
    with the templates of one bucket in memory.
    """
    shapes = lines.select(masked(F.coalesce(F.col(text), F.lit(""))).alias("shape")).filter("shape != ''").groupBy("shape").agg(F.count("*").alias("n"))
    token = F.split("shape", " ")
    start = F.transform(F.slice(token, 1, 2), lambda t: F.when(t.rlike(r"\d"), "<*>").otherwise(t))
    shapes = shapes.withColumn("bucket", F.concat_ws(" ", F.size(token).cast("string"), F.array_join(start, " ")))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held = None, []
        done = lambda: pd.DataFrame({"template": pd.Series([" ".join(t) for t, _ in held], dtype=object), "count": pd.Series([n for _, n in held], dtype="int64")})
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                if row.bucket != bucket:
                    yield done()
                    bucket, held = row.bucket, []
                tokens = row.shape.split(" ")
                best = max(held, key=lambda c: sum(a == b for a, b in zip(c[0], tokens, strict=True)), default=None)
                if best and sum(a == b for a, b in zip(best[0], tokens, strict=True)) >= similar * len(tokens):
                    best[0][:] = [a if a == b else "<*>" for a, b in zip(best[0], tokens, strict=True)]
                    best[1] += row.n
                else:
                    held.append([tokens, row.n])
        yield done()

    return shapes.repartition("bucket").sortWithinPartitions("bucket", F.desc("n"), "shape").mapInPandas(walk, "template string, count long").groupBy("template").agg(F.sum("count").alias("count"))


def pattern(template: str) -> str:
    """A pattern with a named group for each varying place: after the key before it (``port 22``, ``port=22``), else numbered."""
    out, names, at = "", set(), 0
    for m in re.finditer(r"<(MAC|IP|NUM|\*)>", template):
        before = template[at : m.start()]
        key = re.search(r"([A-Za-z][\w\-]*)[\s:=]+\S?$", template[: m.start()])
        name = re.sub(r"\W", "_", key[1].lower()) if key else m[1].lower().replace("*", "field")
        while name in names:
            stem, _, n = name.rpartition("_")
            name = f"{stem}_{int(n) + 1}" if stem and n.isdigit() else f"{name}_2"
        names.add(name)
        out += re.escape(before).replace(r"\ ", r"\s+") + f"(?P<{name}>{READ[m[1]]})"
        at = m.end()
    return f"^{out}{re.escape(template[at:])}$".replace(r"\ ", r"\s+")
