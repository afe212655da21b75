"""Lines from files, topics and lists, as rows (raw, source, received_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = "raw string, source map<string,string>, received_ms bigint"


def described(df: DataFrame, raw: Column, source: dict[str, Column], received_ms: Column | None = None) -> DataFrame:
    """Rows of the engine's input; blank lines and the line's end go."""
    entries = F.create_map(*[x for k, v in source.items() for x in (F.lit(k), v)])
    now = F.unix_millis(F.current_timestamp()) if received_ms is None else received_ms
    return df.select(F.regexp_replace(raw, r"[\r\n\x00]+\z", "").alias("raw"), F.map_filter(entries, lambda _, v: v.isNotNull()).alias("source"), now.alias("received_ms")).filter(F.trim("raw") != "")


def files(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """Lines of text files."""
    return described(spark.read.text(path, lineSep="\n"), F.col("value"), {"transport": F.lit("file"), "file": F.col("_metadata.file_path"), "source_hint": F.lit(hint)})


def follow(spark: SparkSession, path: str, hint: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of the files that appear in a folder, as a stream."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, lineSep="\n")
    return described(stream, F.col("value"), {"transport": F.lit("file"), "file": F.col("_metadata.file_path"), "source_hint": F.lit(hint)})


def topic(spark: SparkSession, servers: str, name: str, per_trigger: int = 100_000) -> DataFrame:
    """Messages of a topic as a stream, for ``messages`` and ``faulty``; needs Spark's connector for it."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return stream.select(F.col("value").cast("string").alias("value"))


def messages(topic_rows: DataFrame) -> DataFrame:
    """Lines of a topic's messages, JSON objects with raw, source and received_ms."""
    return topic_rows.select(F.from_json("value", LINE).alias("line")).select("line.*").filter("raw is not null")


def faulty(topic_rows: DataFrame) -> DataFrame:
    """Dead letters of the messages that are no such objects: error and raw_preview."""
    return topic_rows.filter(F.from_json("value", LINE)["raw"].isNull()).select(F.lit("message without a line").alias("error"), F.substring(F.coalesce("value", F.lit("")), 1, 512).alias("raw_preview"))


def given(spark: SparkSession, lines: list[str], hint: str | None = None, most: int = 5000) -> DataFrame:
    """A request's lines; more than ``most`` are an error."""
    if len(lines) > most:
        raise ValueError(f"more than {most} lines in one request")
    return described(spark.createDataFrame([(x,) for x in lines], "value string"), F.col("value"), {"transport": F.lit("http"), "source_hint": F.lit(hint)})


def sampled(lines: DataFrame, per_file: int = 30, most: int = 400) -> DataFrame:
    """The first lines of each file: a preview."""
    order = Window.partitionBy(F.col("source")["file"]).orderBy("received_ms", "raw")
    return lines.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_file).drop("nth").limit(most)


def framed(blobs: DataFrame, data: str = "value") -> DataFrame:
    """Lines from TCP captures in binary: a message starts with its length in decimal and a blank, or ends with a line feed."""

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"raw": [m for b in pdf[data] for m in frames(bytes(b or b""))]}, dtype=object)

    return blobs.select(data).mapInPandas(cut, "raw string")


def frames(data: bytes) -> list[str]:
    """The whole messages of a capture, also a last one without its end."""
    out, at = [], 0
    while at < len(data):
        blank = data.find(b" ", at, at + 8)
        if data[at : at + 1].isdigit() and blank > at and data[at:blank].isdigit():
            end = blank + 1 + int(data[at:blank])
            out.append(data[blank + 1 : end])
            at = end
        else:
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            out.append(data[at:end])
            at = end + 1
    return [m.decode("utf-8", "replace").rstrip("\r\n\x00") for m in out if m.strip()]
