"""What the lines of unknown sources have in common, for all clusters at once: tokens that each line has, and the fields that most lines agree on.

A set intersection is a count: a token that as many lines have as the cluster does is in all of them. Counts merge before the shuffle, so a
cluster may hold any number of lines; nothing of a cluster comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators import mapper

# Words that stand for a month.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def tokens(raw: Column, format_: Column) -> Column:
    """The different tokens of a line that could tell its source: keys of pairs or objects, the head of CEF and LEEF, else words that aren't stamps."""
    keys = F.regexp_extract_all(raw, F.lit(r"(?:^|\s)([A-Za-z_][\w.\-]*=)"), 1)
    names = F.transform(F.regexp_extract_all(raw, F.lit(r'"([A-Za-z_][\w.\-]*)"\s*:'), 1), lambda k: F.concat(F.lit('"'), k, F.lit('"')))
    head = lambda mark: F.when(F.instr(raw, mark) > 0, F.array(F.array_join(F.slice(F.split(F.substring(raw, F.instr(raw, mark), F.length(raw)), r"\|"), 1, 3), "|"))).otherwise(F.expr("cast(array() as array<string>)"))
    stamp = lambda t: F.rtrim(F.lower(t), F.lit(":,")).isin(MONTHS) | t.rlike(r"^<\d+>") | t.rlike(r"\d{2}:\d{2}")
    words = F.filter(F.split(raw, r"\s+"), lambda t: t.rlike("[A-Za-z]{3}") & ~stamp(t))
    return F.array_distinct(F.when(format_ == "kv", keys).when(format_ == "json", names).when(format_ == "cef", head("CEF:")).when(format_ == "leef", head("LEEF:")).otherwise(words))


def common_tokens(lines: DataFrame, most: int = 2) -> DataFrame:
    """(cluster, rank, token): the longest tokens that all lines of a cluster have; of equal lengths the first by code points.

    ``lines`` has cluster, format and raw. Lines without a mark of CEF or LEEF don't count in a cluster of that format; null lines are left out.
    """
    found = lines.filter("raw is not null").select("cluster", tokens(F.col("raw"), F.coalesce(F.col("format"), F.lit(""))).alias("t"), F.col("format").isin("cef", "leef").alias("marked"))
    of = found.groupBy("cluster").agg(F.count_if(~F.coalesce("marked", F.lit(False)) | (F.size("t") > 0)).alias("of"))
    counted = found.select("cluster", F.explode("t").alias("token")).groupBy("cluster", "token").agg(F.count("*").alias("n"))
    shared = counted.join(of, "cluster").filter(F.col("n") == F.col("of"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.length("token")), "token"))
    return shared.withColumn("rank", place).filter(F.col("rank") <= most).select("cluster", "rank", "token")


def votes(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """(cluster, class_name, path, raw, support, score): of each cluster the class that most of its lines would be, and for each attribute the field that most lines
    have for it, if ``least`` of them do; a field goes to the attribute with the most lines. A cluster without such a field has one row with a null path.

    ``lines`` has cluster, a key ``row`` that no two share, and fields. Ties: the class, field or attribute that comes first by code points.
    """
    found = mapper.matched(lines)
    per_line = found.groupBy("row").agg(F.collect_set("path").alias("paths"))  # at most the dictionary's attributes
    classed = lines.join(per_line, "row", "left").select("cluster", mapper.choose_class(F.coalesce("paths", F.expr("cast(array() as array<string>)")), F.transform(F.map_keys("fields"), F.lower)).alias("class_name"))
    by_class = classed.groupBy("cluster", "class_name").agg(F.count("*").alias("n"))
    modal = by_class.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "class_name"))).filter("nth = 1").select("cluster", "class_name")
    of = by_class.groupBy("cluster").agg(F.sum("n").alias("of"))
    counted = found.join(lines.select("row", "cluster"), "row").groupBy("cluster", "path", "raw").agg(F.count("*").alias("support"), F.max("score").alias("score"))
    best = counted.withColumn("nth", F.row_number().over(Window.partitionBy("cluster", "path").orderBy(F.desc("support"), "raw"))).filter("nth = 1").join(of, "cluster").filter(F.col("support") >= least * F.col("of"))
    single = best.withColumn("nth", F.row_number().over(Window.partitionBy("cluster", "raw").orderBy(F.desc("support"), "path"))).filter("nth = 1")
    return modal.join(single.select("cluster", "path", "raw", "support", "score"), "cluster", "left")
