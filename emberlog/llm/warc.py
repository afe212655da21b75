"""WARC archives of web captures, and their merged index.

Pages are written as WARC 1.1 records by Spark's own file writer, sorted by URL key and time within each file, so that every
file's index is a sorted run on the shared storage. Reading the archives gives the runs back; ranges of the key are dealt to tasks,
Spark hands each task its part of one run after another, as they stand in the files, and a loser tree merges them by key and
time into the globally ordered capture history. A range is bounded, whatever the number of runs or of captures of one URL.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import as_bytes, join_groups, keep, shared_dir, small_batches, table, with_key

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
URN = "urn:x-capture:"
CAPTURE = "urlkey string, ts string, id long, url string, run string, at long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: Column) -> Column:
    """The sort key of a URL: host names from the top level down, then path and query; no scheme, port or fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*", 0), ":[0-9]+$", ""))
    path = F.regexp_replace(rest, "^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the captures whose payload of ``least_bytes`` or more a capture with a larger id has too."""
    small = keep(pages.filter(F.col("bytes") >= least_bytes).select("id", "digest"))
    groups = keep(small.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("size")).filter("size > 1"))
    return join_groups(small, groups, "digest", "size", small.count()).filter("id < refers_to").select("id", "digest", "refers_to").distinct()


def captures(pages: DataFrame, id_col: str, url_col: str, html_col: str, ts: Column | None) -> DataFrame:
    """id, url, ts (as in WARC-Date), html, bytes, digest; a null html is empty."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    when = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") if ts is not None else F.lit("2000-01-01T00:00:00Z")
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(when, F.lit("1970-01-01T00:00:00Z")).alias("ts"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html).alias("digest"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts: Column | None = None, least_bytes: int = 1000, compression: str = "gzip") -> None:
    """Writes one record for each row to files under ``path``, each sorted by URL key, time and id.

    Of captures with equal payloads of ``least_bytes`` or more, the one with the largest id is a response and the others
    are revisits that refer to it, without the payload. A null html is an empty payload, a null URL leaves its header out, a
    null id is never a revisit and is referred to by none. Rows that repeat an id and a payload are written alike. An empty
    table gives files without records.

    With ``compression``, each file is compressed as a whole, by a codec that readers don't split. Files are named by Spark's writer.
    """
    if compression not in ("gzip", "deflate", "lz4", "snappy"):
        raise ValueError("archives need a codec that isn't split: gzip, deflate, lz4 or snappy")
    rows = captures(pages, id_col, url_col, html_col, ts)
    again = keep(revisits(rows, least_bytes).withColumn("key", F.struct("id", "digest")).select("key", "refers_to"))
    rows = with_key(rows.withColumn("key", F.struct("id", "digest")), again, "key")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))
    line = lambda name, value: F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), c.cast("string"), F.lit(">"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"), F.lit("\r\n"),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(urn(F.col("id")), F.lit(f"<{URN}none>")), F.lit("\r\n")),
        line("WARC-Date", F.col("ts")), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("refers_to").isNull(), "").otherwise("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    rows = rows.withColumn("block", block).withColumn("urlkey", url_key(F.col("url"))).sortWithinPartitions("urlkey", "ts", "id")
    rows.select(F.concat(head, "block").alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def headers(head: bytes) -> dict[str, str]:
    """The named fields of a record's or a response's head."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")) if v}


def number(urn: str | None) -> int | None:
    """The id in a record's name."""
    text = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record under ``path``: ``CAPTURE`` without urlkey; at is the record's place in its file.

    The reader cuts files at the first line of a record; where a payload holds such a line, the pieces are put together again
    by the record's stated length. Digests and sizes of responses are taken from the payload that was read. A record that ends
    before its length is an error that names its file.
    """
    small_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at, part = None, 0, b""
        for b in batches:
            rows = []
            for name, piece in zip(b.column(1).to_pylist(), as_bytes(b.column(0)), strict=True):
                if name != run:
                    whole(run, at, part)
                    run, at, part = name, 0, b""
                part = part + MAGIC.encode() + piece if part else piece
                head, gap, rest = part.partition(END.encode())
                if not gap:
                    continue  # before the first record, or a cut head
                fields = headers(head)
                n = int(fields["content-length"])
                if len(rest) < n + len(END):
                    continue
                http, _, payload = rest[:n].partition(END.encode())
                kind = fields["warc-type"]
                full = kind == "response"
                size = len(payload) if full else int(headers(http)["content-length"])
                digest = hashlib.sha1(payload).hexdigest() if full else fields["warc-payload-digest"].removeprefix("sha1:")
                rows.append((fields["warc-date"], number(fields["warc-record-id"]), fields.get("warc-target-uri"), run, at, kind, size, digest, number(fields.get("warc-refers-to"))))
                at, part = at + 1, b""
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)], NAMES)
        whole(run, at, part)

    def whole(run: str | None, at: int, part: bytes) -> None:
        if part:
            raise ValueError(f"record {at} of {run} is damaged: it ends before its length")

    lines = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_name").alias("run"))
    return lines.mapInArrow(parse, CAPTURE.removeprefix("urlkey string, "))


NAMES = [x.split()[0] for x in CAPTURE.split(", ")][1:]
KINDS = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in CAPTURE.split(", ")][1:]


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the next winner takes one match a level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.n = runs, [0] * len(runs), max(len(runs), 1)
        self.loser = [-1] * self.n
        for i in range(len(runs)):
            self.play(i)

    def beats(self, a: int, b: int) -> bool:
        """Whether run a's next row comes before run b's; a run at its end loses, -1 (not seated yet) wins."""
        if a < 0 or b < 0:
            return a < 0
        if self.at[a] >= len(self.runs[a]) or self.at[b] >= len(self.runs[b]):
            return self.at[a] < len(self.runs[a])
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def play(self, run: int) -> None:
        """Sends a run up from its leaf; losers stay, the winner ends at the top."""
        node, winner = (run + self.n) // 2, run
        while node > 0:
            if self.beats(self.loser[node], winner):
                winner, self.loser[node] = self.loser[node], winner
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.loser[0] >= 0 and self.at[self.loser[0]] < len(self.runs[self.loser[0]]):
            run = self.loser[0]
            row = self.runs[run][self.at[run]]
            self.at[run] += 1
            yield row
            self.play(run)


def merged_index(records: DataFrame, rows_a_range: int = 100_000) -> DataFrame:
    """The capture history: all rows of ``read_archives`` with their urlkey, ordered by urlkey, ts and id across partitions.

    A range of keys holds about ``rows_a_range`` rows, also where one URL has very many captures, since time and id are part
    of the key. Null ids come first among equal keys. No record gives no rows.
    """
    rows = records.withColumn("urlkey", url_key(F.col("url")))
    ranges = max(1, -(-rows.count() // rows_a_range))
    names = ["urlkey", *NAMES]
    order = [names.index(x) for x in ("urlkey", "ts", "id", "run", "at")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, ts, i, run, at = (row[k] for k in order)
                runs.setdefault(run, []).append(((key.encode(), ts, i is not None, i or 0, run, at), row))
        merged = (row for _, row in LoserTree([runs[k] for k in sorted(runs)]))
        while out := list(islice(merged, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), *KINDS], strict=True)], names)

    parts = rows.select(*names).repartitionByRange(ranges, "urlkey", "ts", "id").sortWithinPartitions("run", "at")
    return parts.mapInArrow(merge, CAPTURE)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all pages, written, read back and merged. The archives go once their index is kept."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    records = keep(read_archives(spark, path))
    remove(spark, path)
    return merged_index(records).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey")


SQL = """
WITH p AS (
  SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload_digest) AS again,
         max(page_id) OVER (PARTITION BY payload_digest) AS top,
         regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest
  FROM p
), k AS (
  SELECT *, regexp_replace(rest, '^[^/?]*', '') AS path,
         array_to_string(list_reverse(string_split(lower(regexp_replace(regexp_extract(rest, '^[^/?]*'), ':[0-9]+$', '')), '.')), ',') AS host
  FROM g
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to, host || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS urlkey
FROM k
"""
