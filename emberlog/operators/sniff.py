"""Format of a line, by its look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.extract import HOST, RFC5424, STAMP, TAG

# What a priority, a key=value pair and the start of a syslog header look like.
PRI = r"^<\d{1,3}>"
PAIR = r"(?:^|[\s,;])[A-Za-z_][\w.\-]*=(?:\"[^\"]*\"|[^\s,;]*)"
HEADED = r"^(?:1 )?(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d{1,2} |\d{4}-\d{2}-\d{2}T)"
#: A whole header in one pattern: priority, then a timestamp with a host behind it, then a tag; each may be missing.
HEADER = rf"^(?:<\d{{1,3}}>)?(?:{STAMP[1:]} *(?:(?!%|:|CEF:|LEEF:){HOST[1:]})?)?[: ]*(?:(?!CEF:|LEEF:|\{{){TAG[1:]})?"
MODERN = rf"^(?:<\d{{1,3}}>)?{RFC5424[1:]}"


def count_of(text: Column, char: str) -> Column:
    """How often a character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def sniffed(df: DataFrame, raw: str = "raw", out: str = "sniffed") -> DataFrame:
    """Adds struct(format, envelope, confidence, tags). Behind a syslog header the payload counts; a text there is ``syslog`` itself.

    Each step is a projection of its own, so that what later steps use more than once is worked out once; pairs are counted only
    where no simpler sign tells.
    """
    name = lambda k: f"_{out}_{k}"
    s, headed, text, sign, pairs, commas, blanks, tabs = (F.col(name(k)) for k in ("s", "headed", "text", "sign", "pairs", "commas", "blanks", "tabs"))
    df = df.withColumn(name("s"), F.regexp_replace(F.regexp_replace(raw, "^\ufeff+", ""), "[\r\n]+$", ""))
    df = df.withColumn(name("headed"), s.rlike(PRI) | s.rlike(HEADED))
    body = F.when(~headed, s).when(s.rlike(r"^(?:<\d{1,3}>)?1 ") & s.rlike(MODERN), F.regexp_replace(F.regexp_extract(s, MODERN, 7), "^\ufeff+", "")).otherwise(F.regexp_replace(s, HEADER, ""))
    df = df.withColumn(name("text"), F.trim(body))
    head = F.substring(text, 1, 200)
    sure = F.when(text == "", "empty").when(text.rlike(r"(?s)^[{\[].*[}\]]$"), "json").when(text.startswith("<") & ~text.rlike(PRI), "xml").when(head.contains("CEF:"), "cef").when(head.contains("LEEF:"), "leef")
    df = df.withColumn(name("sign"), sure)
    counted = {"pairs": F.regexp_count(text, F.lit(PAIR)), "commas": count_of(text, ","), "blanks": count_of(text, " "), "tabs": count_of(text, "\t")}
    df = df.withColumns({name(k): F.when(sign.isNull(), c).otherwise(0) for k, c in counted.items()})
    found = lambda kind, c: F.struct(F.lit(kind).alias("format"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    best = (
        F.when(sign == "empty", found("text", 0.1))
        .when(sign == "json", found("json", 0.95))
        .when(sign == "xml", found("xml", 0.9))
        .when(sign == "cef", found("cef", 0.97))
        .when(sign == "leef", found("leef", 0.97))
        .when((pairs >= 3) & (pairs * 2 >= F.greatest(F.lit(1), commas)), found("kv", F.least(F.lit(0.95), 0.5 + pairs * 0.05)))
        .when((commas >= 5) & (commas > blanks), found("csv", F.least(F.lit(0.9), 0.5 + commas * 0.02)))
        .when(tabs >= 4, found("csv", 0.7))
        .otherwise(found("text", 0.4))
    )
    df = df.withColumn(name("best"), best)
    p = F.col(name("best"))
    plain = headed & (p["format"] == "text")
    kind, envelope = F.when(plain, "syslog").otherwise(p["format"]), F.when(headed & ~plain, F.lit("syslog"))
    whole = F.struct(kind.alias("format"), envelope.alias("envelope"), F.when(plain, F.lit(0.7)).otherwise(p["confidence"]).alias("confidence"), F.array_compact(F.array(kind, envelope)).alias("tags"))
    return df.withColumn(out, whole).drop(*[name(k) for k in ("s", "headed", "text", "sign", "pairs", "commas", "blanks", "tabs", "best")])
