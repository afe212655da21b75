"""Masked pseudo-likelihood: a window network in numpy predicts every token from both sides.

All distinct words of the corpus are counted, and a word's probability is that of its class, by the network, times that of the
word within its class, by the counts. The commonest words are classes of their own, the others share the rest by hash; the
number of classes grows with the vocabulary. In each class words that were never counted have a share (Witten and Bell's).

The network reads the classes left and right of a place and gives the class between a probability, in two softmax steps (its
group, then its place in the group). Tasks train on their documents from common parameters and the averages of the tasks'
parameters begin the next round; each document is trained on in one round. A document's score is the sum of the
log-probabilities of all its words.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import SINGLES, WordHash, as_bytes, keep, rows_of, shared_dir, small_batches, sum_vectors, table, vector_rows, with_key

SIDE, WIDTH, HIDDEN = 2, 8, 32
INPUT = 2 * SIDE * WIDTH
#: Log-probabilities of words in their classes are whole numbers of this fraction: their sums don't depend on the order.
UNIT = 10**9
#: Where memories of squared gradients begin. Gradients are means of a batch: a larger start would hold back all but the commonest words.
FIRST = 1e-8
PARTS = pa.schema([("name", pa.string()), ("chunk", pa.int32()), ("task", pa.int64()), ("weight", pa.float64()), ("values", pa.list_(pa.float32()))])


def word_hash(word: bytes) -> int:
    """64 bits that stand for the word, signed."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def hashed(texts: list[bytes], memo: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, in lower case, and the number of words of each text."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum())), n


def groups_of(distinct: int) -> int:
    """Groups of classes, and classes in a group, for so many distinct words: about 4 * sqrt(distinct) classes, as two bytes hold them."""
    return int(min(max(np.ceil(2 * distinct**0.25), 32), 255))


def shapes(groups: int) -> dict[str, tuple[int, ...]]:
    """The network's parameters."""
    return {"embed": (groups * groups + 1, WIDTH), "w1": (INPUT, HIDDEN), "b1": (HIDDEN,), "wg": (HIDDEN, groups), "bg": (groups,), "wt": (groups, HIDDEN, groups), "bt": (groups, groups)}


def contexts(ids: np.ndarray, n: np.ndarray, end: int) -> np.ndarray:
    """For each place the SIDE tokens before and after it in its text; ``end`` stands where the text ends."""
    doc = np.repeat(np.arange(len(n)), n)
    padded = np.full(len(ids) + 2 * SIDE, end, np.int32)
    padded[SIDE : len(ids) + SIDE] = ids
    owner = np.full(len(ids) + 2 * SIDE, -1)
    owner[SIDE : len(ids) + SIDE] = doc
    out = np.empty((len(ids), 2 * SIDE), np.int32)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = slice(SIDE + d, SIDE + d + len(ids))
        out[:, k] = np.where(owner[at] == doc, padded[at], end)
    return out


@dataclass
class WindowNetwork:
    """The parameters by name, and the number of groups."""

    p: dict[str, np.ndarray]
    groups: int

    @staticmethod
    def begun(groups: int, seed: int) -> WindowNetwork:
        """Small random parameters."""
        draw = np.random.default_rng(seed)
        p = {k: (draw.normal(0, 0.1, s) if len(s) > 1 and k != "bt" else np.zeros(s)).astype(np.float32) for k, s in shapes(groups).items()}
        return WindowNetwork(p, groups)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in shapes(self.groups)])

    def filled(self, flat: np.ndarray) -> WindowNetwork:
        """A network with these parameters."""
        at, p = 0, {}
        for k, s in shapes(self.groups).items():
            n = int(np.prod(s))
            p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return WindowNetwork(p, self.groups)

    def forward(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden values and the probabilities of groups."""
        p = self.p
        x = p["embed"].take(ctx.ravel(), 0).reshape(len(ctx), INPUT)
        h = x @ p["w1"]
        h += p["b1"]
        np.tanh(h, out=h)
        z = held("groups", len(ctx), self.groups)
        np.matmul(h, p["wg"], out=z)
        z += p["bg"]
        return x, h, softmax(z)

    def within(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Places in the order of their token's group, their hidden values and scores of the tokens in the group, and each group's part."""
        group = (ids // self.groups).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[order], np.arange(self.groups + 1))
        parts = [(g, slice(edge[g], edge[g + 1])) for g in range(self.groups) if edge[g + 1] > edge[g]]
        hs, z = h.take(order, 0), held("within", len(ids), self.groups)
        for g, at in parts:
            np.matmul(hs[at], self.p["wt"][g], out=z[at])
            z[at] += self.p["bt"][g]
        return order, hs, z, parts

    def log_probability(self, ids: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """The log-probability of each token given its context."""
        _, h, pg = self.forward(ctx)
        row, out = np.arange(len(ids)), np.empty(len(ids))
        order, _, z, _ = self.within(h, ids)
        out[order] = np.log(np.maximum(softmax(z)[row, ids[order] % self.groups], 1e-30))
        return out + np.log(np.maximum(pg[row, ids // self.groups], 1e-30))

    def gradient(self, ids: np.ndarray, ctx: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of a batch's summed negative log-probability; its arrays hold until the next call."""
        p, n = self.p, len(ids)
        row = np.arange(n)
        x, h, pg = self.forward(ctx)
        pg[row, ids // self.groups] -= 1
        ones = np.ones(n, np.float32)
        grad = {"wg": h.T @ pg, "bg": ones @ pg, "wt": held("wt", *p["wt"].reshape(-1, self.groups).shape).reshape(p["wt"].shape), "bt": np.zeros_like(p["bt"])}
        grad["wt"].fill(0)
        order, hs, z, parts = self.within(h, ids)
        q, back = softmax(z), held("back", n, HIDDEN)
        q[row, ids[order] % self.groups] -= 1
        for g, at in parts:
            np.matmul(hs[at].T, q[at], out=grad["wt"][g])
            np.matmul(ones[at], q[at], out=grad["bt"][g])
            np.matmul(q[at], p["wt"][g].T, out=back[at])
        dz = np.matmul(pg, p["wg"].T, out=held("hidden", n, HIDDEN))
        dz[order] += back
        np.square(h, out=h)
        dz *= np.subtract(1, h, out=h)
        grad["w1"], grad["b1"] = x.T @ dz, ones @ dz
        dx = np.matmul(dz, p["w1"].T, out=x).reshape(-1, WIDTH).T.astype(np.float64)
        at = ctx.ravel().astype(np.intp)
        grad["embed"] = np.stack([np.bincount(at, d, self.groups**2 + 1) for d in dx], axis=1)
        return grad

    def step(self, ids: np.ndarray, ctx: np.ndarray, memory: dict[str, np.ndarray], rate: float) -> None:
        """One step of gradient descent on a batch, each parameter by its own past gradients."""
        for k, d in self.gradient(ids, ctx).items():
            d = (d / len(ids)).astype(np.float32)
            by = np.square(d)
            memory[k] += by
            np.sqrt(memory[k], out=by)
            by += 1e-6
            d *= rate
            d /= by
            self.p[k] -= d


_HELD: dict[str, np.ndarray] = {}


def held(name: str, rows: int, columns: int) -> np.ndarray:
    """A float32 array that the next call with this name overwrites: memory that is asked for anew with each batch costs more than the work in it."""
    if name not in _HELD or _HELD[name].size < rows * columns:
        _HELD[name] = np.empty(rows * columns, np.float32)
    return _HELD[name][: rows * columns].reshape(rows, columns)


def softmax(z: np.ndarray, rows: int = 512) -> np.ndarray:
    """Shares of each row, in float32; changes its argument, so many rows at a time as a core's cache holds."""
    ones = np.ones(z.shape[1], np.float32)
    for at in range(0, len(z), rows):
        part = z[at : at + rows]
        part -= part.max(axis=1, keepdims=True)
        np.exp(part, out=part)
        part *= (1 / (part @ ones))[:, None]
    return z


def words_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (a hash of id and text), n (words) and the words' hashes, eight bytes each."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash(word_hash)
        for whole in batches:
            for b in rows_of(whole, 1 << 20, "t"):
                ids, n = hashed(as_bytes(b.column("t")), memo)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n), pieces(ids, n)], ["doc_id", "h", "n", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("doc_id", "t"))
    return rows.mapInArrow(coded, "doc_id long, h long, n long, words binary")


def pieces(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """The bytes of each text's values."""
    return pa.array([x.tobytes() for x in np.split(values, np.cumsum(n)[:-1])], pa.binary())


def unpacked(b: pa.RecordBatch, column: str = "tokens", kind: type = np.uint16) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all words of a batch, and the number of words of each text."""
    return np.frombuffer(b"".join(b.column(column).to_pylist()), kind), b.column("n").to_numpy(zero_copy_only=False)


def word_counts(rows: DataFrame, most: int = 1 << 21) -> DataFrame:
    """(w, count) of all distinct words; tasks add up about ``most`` words at a time before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append(unpacked(b, "words", np.int64)[0])
                size += len(held[-1])
            if size > most or b is None and size:
                w, n = np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n.astype(np.int64))], ["w", "n"])

    return rows.select("n", "words").mapInArrow(counted, "w long, n long").groupBy("w").agg(F.sum("n").alias("count"))


@dataclass
class Vocabulary:
    """The commonest words' hashes in order, their tokens and log-probabilities within them; and the other words, (w, lp), or None."""

    groups: int
    own: int
    words: np.ndarray
    token: np.ndarray
    lp: np.ndarray
    rare: DataFrame | None
    #: Log-probability of all words that weren't counted, for each token.
    unseen: np.ndarray

    def shared(self) -> int:
        return self.groups**2 - self.own


def vocabulary(rows: DataFrame, head: int) -> Vocabulary:
    """Tokens and probabilities of all words from their counts. About ``head`` words at most are collected."""
    spark = rows.sparkSession
    counts = keep(word_counts(rows).withColumn("level", F.floor(F.log2("count") * 8).cast("int")))
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    distinct, held, least = sum(n for _, n in levels), 0, 1 << 30
    for level, n in levels:
        held += n
        if held > head:
            break
        least = level
    groups = groups_of(distinct)
    first = [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(groups**2 * 3 // 4).collect()]
    own, shared = len(first), groups**2 - len(first)
    tokens = with_key(counts, spark.createDataFrame(list(zip(first, range(own), strict=True)), "w long, place int"), "w")
    tokens = tokens.withColumn("token", F.coalesce("place", (F.lit(own) + F.pmod("w", F.lit(shared))).cast("int")))
    totals = keep(tokens.groupBy("token").agg(F.sum("count").alias("total"), F.count("*").alias("kinds")))
    known = keep(tokens.join(F.broadcast(totals), "token").select("w", "token", (F.col("place").isNotNull() | (F.col("level") >= least)).alias("common"), F.round(F.log(F.col("count") / (F.col("total") + F.col("kinds"))) * UNIT).cast("long").alias("lp")))
    common = known.filter("common").select("w", "token", "lp").toArrow().sort_by("w")
    unseen = np.zeros(groups**2, np.int64)
    for r in totals.collect():
        unseen[r["token"]] = round(np.log(r["kinds"] / (r["total"] + r["kinds"])) * UNIT)
    return Vocabulary(groups, own, *(common.column(k).to_numpy().astype(t) for k, t in (("w", np.int64), ("token", np.uint16), ("lp", np.int64))), None if len(common) == distinct else known.filter("not common").select("w", "lp"), unseen)


def tokens_of(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """row, doc_id, h, n, the words' tokens, two bytes each, lp (the sum of the common words' log-probabilities within their tokens) and
    the hashes of the other words: training and scoring read these."""
    table = rows.sparkSession.sparkContext.broadcast((v.words, v.token, v.lp, v.own, v.shared()))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, token, lp, own, shared = table.value
        for whole in batches:
            for b in rows_of(whole, 1 << 21, "words"):
                ids, n = unpacked(b, "words", np.int64)
                at = np.minimum(np.searchsorted(words, ids), max(len(words) - 1, 0))
                hit = words[at] == ids if len(words) else np.zeros(len(ids), bool)
                if hit.all():
                    mine, sums = token[at], lp[at]
                else:
                    mine, sums = (own + ids % shared).astype(np.uint16), np.zeros(len(ids), np.int64)
                    mine[hit], sums[hit] = token[at[hit]], lp[at[hit]]
                ends = np.concatenate([[0], np.cumsum(n)])
                upto, strays = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(~hit)])
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("h"), b.column("n"), pieces(mine, n), pa.array(upto[ends[1:]] - upto[ends[:-1]]), pieces(ids[~hit], strays[ends[1:]] - strays[ends[:-1]])], ["row", "doc_id", "h", "n", "tokens", "lp", "rare"])

    return rows.mapInArrow(coded, "row long, doc_id long, h long, n long, tokens binary, lp long, rare binary")


def rare_sums(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """(row, more): the sum of the rare words' log-probabilities within their tokens. A rare word has few places, so no key is large."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in rows_of(whole, 1 << 20, "rare"):
                ids = [np.frombuffer(x, np.int64) for x in b.column("rare").to_pylist()]
                row = np.repeat(b.column("row").to_numpy(), [len(x) for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate(ids))], ["row", "w"])

    places = rows.filter("length(rare) > 0").select("row", "rare").mapInArrow(listed, "row long, w long")
    unseen = F.get(F.array(*[F.lit(int(x)) for x in v.unseen[v.own :]]), F.pmod("w", F.lit(v.shared())).cast("int"))
    return places.join(v.rare, "w", "left").groupBy("row").agg(F.sum(F.coalesce("lp", unseen)).alias("more"))


def dealt(docs: DataFrame, rounds: int, shards: int, width: int = 4096) -> list[DataFrame]:
    """The documents of each round with their shard, written once: a round reads its own folder. Shards stand in the order of hashes in at most ``width`` files a round."""
    path = f"{shared_dir(docs.sparkSession)}/lm-{uuid.uuid4().hex}"
    rows = docs.filter("n > 0").select("n", "tokens", "h", F.pmod("h", F.lit(rounds)).cast("int").alias("round"), F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"))
    files = min(shards, width)
    rows = rows.repartition(min(rounds * files, width), "round", F.col("shard") % files).sortWithinPartitions("round", "shard", "h")
    rows.write.partitionBy("round").parquet(path)
    kept = docs.sparkSession.read.schema(rows.schema).parquet(path)
    return [kept.filter(F.col("round") == r).select("n", "tokens", "shard") for r in range(rounds)]


def train(docs: DataFrame, groups: int, least_rounds: int, batch: int, rate: float, seed: int, shard_words: int = 1 << 20) -> WindowNetwork:
    """The network after all rounds; round r takes the documents whose hash is r modulo the number of rounds.

    A round's documents are dealt by hash to shards of about ``shard_words`` words. Each shard learns from the network before, in the order of hashes, and the
    networks and their memories of gradients are averaged: neither files nor partitions matter. Rounds and shards both grow with the square root of the corpus, so
    that more text means more steps one after the other, and wider averages; each document is trained on once.
    """
    spark = docs.sparkSession
    net = WindowNetwork.begun(groups, seed)
    past = np.concatenate([np.full(int(np.prod(s)), FIRST, np.float32) for s in shapes(groups).values()])
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rounds = max(least_rounds, math.isqrt(total // shard_words))
    shards = int(max(1, -(-total // (rounds * shard_words))))
    for part in dealt(docs, rounds, shards):
        shared = spark.sparkContext.broadcast((net.flat(), past, groups))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, past, groups = shared.value
            memory, net, seen, now, waiting = {}, None, 0, None, 0
            held: list[pa.RecordBatch] = []

            def take() -> None:
                nonlocal seen
                parts = [unpacked(b) for b in held]
                held.clear()
                ids, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                ctx = contexts(ids, n, groups * groups)
                for at in range(0, len(ids), batch):
                    net.step(ids[at : at + batch], ctx[at : at + batch], memory, rate)
                seen += len(ids)

            def learnt() -> Iterator[pa.RecordBatch]:
                if held:
                    take()
                if seen:
                    for name, flat in (("p", net.flat()), ("memory", WindowNetwork(memory, groups).flat())):
                        for pdf in vector_rows(name, flat, seen, task=now):
                            yield pa.RecordBatch.from_pandas(pdf, schema=PARTS, preserve_index=False)

            for whole in batches:
                for k in range(whole.num_rows):
                    b = whole.slice(k, 1)
                    shard = b.column("shard")[0].as_py()
                    if shard != now:
                        yield from learnt()
                        net = WindowNetwork({}, groups).filled(start)
                        memory, seen, now, waiting = WindowNetwork({}, groups).filled(past).p, 0, shard, 0
                    held.append(b)
                    waiting += b.column("n")[0].as_py()
                    if waiting >= 1 << 17:
                        take()
                        waiting = 0
            yield from learnt()

        found = sum_vectors(part.mapInArrow(learn, SINGLES), weighed=True)
        if found:
            net, past = net.filled(found["p"][1] / found["p"][0]), (found["memory"][1] / found["memory"][0]).astype(np.float32)
    return net


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_rounds: int = 3, batch: int = 8192, rate: float = 0.2, seed: int = 1, head: int = 1 << 18) -> DataFrame:
    """Trains on all texts and scores all: doc_id, n_tokens, log_prob (their sum), mean_log_prob.

    Null, empty and blank texts have no token: log_prob 0, mean_log_prob null. Equal texts get equal scores; ids may repeat
    or be null. An empty table gives no rows. Tasks hold about ``head`` of the commonest words; the probabilities of others are
    joined, so ``head`` doesn't change the scores.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = keep(words_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    known = vocabulary(rows, head)
    rows = keep(tokens_of(rows, known))
    shared = spark.sparkContext.broadcast((train(rows, known.groups, least_rounds, batch, rate, seed).flat(), known.groups))  # not the class: executors may lack it

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = WindowNetwork({}, shared.value[1]).filled(shared.value[0])
        for whole in batches:
            for b in rows_of(whole, 1 << 18, "tokens"):
                ids, n = unpacked(b)
                ctx, lp = contexts(ids, n, net.groups**2), np.zeros(len(ids) + 1)
                for at in range(0, len(ids), batch):
                    lp[1 + at : 1 + min(at + batch, len(ids))] = net.log_probability(ids[at : at + batch], ctx[at : at + batch])
                ends = np.concatenate([[0], np.cumsum(n)])
                total = np.array([lp[1 + a : 1 + z].sum() for a, z in zip(ends, ends[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n), pa.array(total, pa.float64()), b.column("lp")], ["row", "doc_id", "n_tokens", "net", "lp"])

    out = rows.select("row", "doc_id", "n", "tokens", "lp").mapInArrow(score, "row long, doc_id long, n_tokens long, net double, lp long")
    if known.rare is not None:
        out = out.join(rare_sums(rows, known), "row", "left").withColumn("lp", F.col("lp") + F.coalesce("more", F.lit(0)))
    log_prob = F.col("net") + F.col("lp") / F.lit(float(UNIT))
    return out.select("doc_id", "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents."""
    return lm_score(table(spark, sf_dir, "documents"))
