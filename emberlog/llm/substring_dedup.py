"""Substring deduplication by super-k-mers.

A window is k consecutive words. Its minimiser is the m-word piece with the least hash in it; consecutive windows share
one, and travel together to the minimiser's bucket as one packed string of words instead of as k words each. In the
bucket the windows are sorted and equal ones counted exactly: hashes order them, word numbers decide. A bucket that outgrows
its bound is passed on unread, and its windows meet by 128-bit hashes in a shuffle that splits them.

Within a chunk of documents only the first window of each word sequence travels: the others have an earlier
equal already. So a passage that a third of all documents share reaches its bucket once for each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import as_bytes, join_groups, keep, mixed, small_batches, table

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A null id sorts before all others.
NO_ID = -(1 << 63)


class Words:
    """The words of some texts, one after the other: exact numbers, and for each position its document and place."""

    def __init__(self, texts: list[list[bytes]]):
        coded = pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode()
        self.known, self.id = coded.dictionary, coded.indices.to_numpy()
        self.count = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.place = np.arange(len(self.id)) - self.first[self.doc]

    def hashes(self) -> np.ndarray:
        """Hashes of the words that are the same in every task."""
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, self.known.to_pylist()), np.uint64, len(self.known))
        return known[self.id] if len(known) else known

    def starts(self, k: int) -> np.ndarray:
        """Positions where a window of k words of one document starts."""
        return np.flatnonzero(self.place + k <= self.count[self.doc])

    def window_hash(self, at: np.ndarray, k: int) -> np.ndarray:
        """A hash of the k words from each position, for these texts alone: running sums of a polynomial modulo 2^64."""
        n = len(self.id)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]), dtype=np.uint64)
        run = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.id.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
        return mixed((run[at + k] - run[at]) * back[at])

    def same(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Whether the windows at a and b have the same words."""
        out = np.ones(len(a), bool)
        for i in range(k):
            out &= self.id[a + i] == self.id[b + i]
        return out


def repeats(w: Words, at: np.ndarray, doc: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Flags of the windows at ``at`` whose word sequence also starts at a smaller (doc, place) among them."""
    out = np.zeros(len(at), bool)
    h = w.window_hash(at, k)
    order = np.argsort(h)
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    todo = order[np.union1d(near, near + 1)]  # windows alone with their hash repeat nothing
    while len(todo) > 1:
        order = todo[np.lexsort((place[todo], doc[todo], h[todo]))]
        new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        rest = order != head
        order, head = order[rest], head[rest]
        equal = w.same(at[order], at[head], k)
        out[order[equal]] = ((doc[order] > doc[head]) | (place[order] > place[head]))[equal]
        todo = order[~equal]  # other words with the same hash: once more without their head
    return out


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(w: Words, sent: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits the windows ``sent`` (sorted positions) into runs that share a minimiser: first, last, minimiser hash."""
    if not len(sent):
        return sent, sent, np.empty(0, np.uint64)
    h = w.hashes()
    piece = mixed(h)
    for i in range(1, m):
        piece = piece[:-1] * BASE + h[i : i + len(piece) - 1]
    least = least_in(mixed(piece), k - m + 1)[sent]
    cut = np.flatnonzero((np.diff(sent) != 1) | (np.diff(w.doc[sent]) != 0) | (least[1:] != least[:-1]))
    a, z = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(sent) - 1]])
    return sent[a], sent[z], least[a]


PACK = "bucket int, doc_id long, th long, first array<int>, last array<int>, packed binary"


def packing(k: int, m: int, buckets: int, chunk_bytes: int):
    """The map side: marks of windows that repeat within a chunk, and one packed row for each bucket and chunk."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        held: list[tuple[int, int, list[bytes]]] = []
        size = 0
        for b in batches:
            for i, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                if held and size + len(t) > chunk_bytes:
                    yield from chunk(held, press)
                    held, size = [], 0
                held.append((i, th, t.split()))
                size += len(t)
        if held:
            yield from chunk(held, press)

    def chunk(docs: list, press) -> Iterator[pa.RecordBatch]:
        ids, ths = np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
        w = Words([d[2] for d in docs])
        at = w.starts(k)
        again = repeats(w, at, ids[w.doc[at]], w.place[at], k)
        rows = {name: [] for name in ("bucket", "doc_id", "th", "first", "last", "packed")}

        def row(*values):
            for name, v in zip(rows, values, strict=True):
                rows[name].append(v)

        mark, deal = at[again], (mixed(ids.astype(np.uint64) ^ ths.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        for d in np.unique(w.doc[mark]):
            a, z = runs(w.place[mark[w.doc[mark] == d]])
            row(int(deal[d]), ids[d], ths[d], a, z, None)
        a, z, least = super_kmers(w, at[~again], k, m)
        bucket = (least % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((a, bucket))
        edge = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, edge) if len(order) else ():
            text = b"\n".join(b" ".join(docs[d][2][p : q + k]) for d, p, q in zip(w.doc[a[part]], w.place[a[part]], w.place[z[part]], strict=True))
            where = np.stack([ids[w.doc[a[part]]], ths[w.doc[a[part]]], w.place[a[part]]]).astype(np.int64).tobytes()
            row(int(bucket[part[0]]), 0, 0, None, None, press.compress(len(part).to_bytes(4, "little") + where + text))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        if rows["bucket"]:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

    return pack


def opened(blob: bytes, press) -> tuple[np.ndarray, list[list[bytes]]]:
    """(id, text hash, place) of each super-k-mer of a packed row, as columns, and their words."""
    data = press.decompress(blob)
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data[4 : 4 + 24 * n], np.int64).reshape(3, n), [line.split() for line in data[4 + 24 * n :].split(b"\n")]


MARKS = "doc_id long, th long, first array<int>, last array<int>, packed binary"


def mark_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "th", "first", "last", "packed"])


def counting(k: int, most_bytes: int):
    """The bucket side, over rows sorted by bucket: exact marks of all windows that have an earlier equal. Chunk marks pass through,
    and so do the packed rows of a bucket that holds more than ``most_bytes``."""

    def counted(blobs: list[bytes], press) -> list[tuple]:
        parts = [opened(blob, press) for blob in blobs]
        ids, ths, place = np.concatenate([p[0] for p in parts], axis=1)
        w = Words(list(chain.from_iterable(p[1] for p in parts)))
        at = w.starts(k)
        mine = w.doc[at]
        again = repeats(w, at, ids[mine], place[mine] + w.place[at], k)
        out = pd.DataFrame({"doc_id": ids[mine[again]], "th": ths[mine[again]], "p": (place[mine] + w.place[at])[again]})
        return [(d, t, *runs(np.sort(g.to_numpy())), None) for (d, t), g in out.groupby(["doc_id", "th"])["p"]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        now, blobs, held, over = None, [], 0, False
        for b in batches:
            out = []
            for bucket, d, t, first, last, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if bucket != now:
                    if blobs:
                        out += counted(blobs, press)
                    now, blobs, held, over = bucket, [], 0, False
                if blob is None:
                    out.append((d, t, first, last, None))
                    continue
                blobs.append(blob)
                held += zstandard.frame_content_size(blob)
                if over := over or held > most_bytes:
                    out += [(None, None, None, None, x) for x in blobs]
                    blobs = []
            if out:
                yield mark_rows(out)
        if blobs:
            yield mark_rows(counted(blobs, press))

    return count


def marked_apart(packed: DataFrame, k: int) -> DataFrame:
    """Marks of the windows of packed rows, one row a window: (doc_id, th, first, last)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            for blob in b.column(0).to_pylist():
                where, texts = opened(blob, press)
                rows = [(xxhash.xxh3_128_digest(b" ".join(t[i : i + k])), d, th, p + i) for d, th, p, t in zip(*where.tolist(), texts, strict=True) for i in range(len(t) - k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32()))], ["w", "doc_id", "th", "p"])

    rows = keep(packed.mapInArrow(windows, "w binary, doc_id long, th long, p int"))
    firsts = keep(rows.groupBy("w").agg(F.min(F.struct("doc_id", "p")).alias("one"), F.count("*").alias("size")).filter("size > 1"))
    later = join_groups(rows, firsts, "w", "size", rows.count()).filter(F.struct("doc_id", "p") > F.col("one"))
    return later.select("doc_id", "th", F.array("p").alias("first"), F.array("p").alias("last"))


def marked(docs: DataFrame, k: int, m: int, bucket_bytes: int, chunk_bytes: int, most_bytes: int) -> DataFrame:
    """For each document with windows to remove: doc_id, th (a hash of its text), spans (first and last start of runs of them)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    buckets = int(max(32, 3 * size // bucket_bytes))
    packed = docs.mapInArrow(packing(k, m, buckets, chunk_bytes), PACK)
    found = keep(packed.repartition(max(32, min(buckets, int(3 * size // (8 << 20)))), "bucket").sortWithinPartitions("bucket").mapInArrow(counting(k, most_bytes), MARKS))
    over, found = found.filter("packed is not null").select("packed"), found.filter("packed is null").drop("packed")
    if not over.isEmpty():
        found = found.unionByName(marked_apart(over, k))
    return found.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(F.arrays_zip("first", "last"))).alias("spans"))


def covered(n: int, spans: list, k: int) -> np.ndarray:
    """Flags of the words that lie in a window to remove."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["first"]] += 1
        edge[min(s["last"] + k, n)] -= 1
    return np.cumsum(edge[:n]) > 0


def bit_of(bits: int) -> Column:
    """The place of a document in a map of so many bits."""
    return F.pmod(F.xxhash64("doc_id", "th"), F.lit(bits))


def marked_bits(marks: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 28) -> tuple[int, Broadcast]:
    """A map with the bits of all documents that have marks, and the number of its bits: a document without its bit has none, so its text
    needs no join. Pieces of the map reach the driver, ``bits_per_row`` bits a document and ``max_bits`` at most, never rows."""
    bits = min(max_bits, 1 << max(15, (bits_per_row * marks.count()).bit_length()))
    at = marks.select((bit_of(bits) + 1).alias("p"))  # the built-in functions count from 1
    pieces = at.groupBy(F.bitmap_bucket_number("p").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    held = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():
        step = len(r["bits"])
        held[(r["piece"] - 1) * step : r["piece"] * step] = np.frombuffer(r["bits"], np.uint8)
    return bits, marks.sparkSession.sparkContext.broadcast(held)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, m: int = 3, bucket_bytes: int = 6 << 20, chunk_bytes: int = 8 << 20, most_bytes: int = 96 << 20) -> DataFrame:
    """Removes every word in a window of ``k`` words that also starts earlier: doc_id, n_words, n_removed, kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Earlier means a smaller id, or the same id and an earlier start; windows
    are judged on the input. kept_text is the kept words joined by one space. ``m`` is the words of a minimiser;
    a task holds a bucket of at most ``most_bytes``.

    Null, empty and shorter texts lose nothing (n_words 0 where there are none). Rows that repeat an id and text are equally
    early and lose nothing to each other; rows that repeat an id with other texts are compared by start alone. A null id
    comes before all others. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("t").alias("th"), "t")
    marks = keep(marked(rows, k, m, bucket_bytes, chunk_bytes, most_bytes))
    places, held = marked_bits(marks)
    tests = rows.select("doc_id", "th", "t", bit_of(places).alias("p"))

    def row(i: int, words: list[bytes], spans: list | None) -> tuple:
        gone = covered(len(words), spans, k) if spans else None
        left = words if gone is None else [x for x, g in zip(words, gone, strict=True) if not g]
        return None if i == NO_ID else i, len(words), len(words) - len(left), b" ".join(left).decode()

    def result(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_text"])

    def hit(b: pa.RecordBatch) -> np.ndarray:
        at = b.column(3).to_numpy(zero_copy_only=False)
        return (held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~hit(b)))
            yield result([row(i, t.split(), None) for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(2)), strict=True)])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hit(b))).select(["doc_id", "th", "t"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield result([row(i, t.split(), s) for i, t, s in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True)])

    kind = "doc_id long, n_words long, n_removed long, kept_text string"
    joined = tests.mapInArrow(possible, "doc_id long, th long, t string").join(marks, ["doc_id", "th"], "left").select("doc_id", "t", "spans")
    return tests.mapInArrow(whole, kind).unionByName(joined.mapInArrow(cut, kind))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: windows of twenty words of all documents."""
    out = substring_dedup(table(spark, sf_dir, "documents"), k=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM w WHERE len(words) >= 20
), h AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 19], ' ')) AS h FROM s
), r AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM h) WHERE n > 1
), gone AS (
  SELECT doc_id, list(DISTINCT pos + i) AS places FROM r, range(20) AS o(i) GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN words
              ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
