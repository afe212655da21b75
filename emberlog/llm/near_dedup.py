"""Near-duplicate detection: a similarity join of shingle sets along chosen paths.

Each distinct shingle set has a signature of minwise hashes. A tree starts with all sets and branches: a node picks a place
of the signature, and its sets go to one child for each value there, so that sets of similarity s stay together with
probability s. Nodes of a few sets are compared exhaustively; larger ones branch again, by ``STEP`` places at a time. A pair
that has to agree at d places needs more trees than one that agrees at one: each depth has as many independent trees as its
own recall asks for, grown only for the sets that a large node held.

Only connected components are asked for. In small nodes a spanning forest of the pairs with similar signatures is confirmed
first, on the full sets; nodes that still hold several components then get their sets' texts, and every pair of
different components is tested there. The sets of a large node are confirmed against a few leaders, linear in their number;
a large node that is one component by then is done, the others branch.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import BROADCAST_ROWS, WordHash, as_bytes, join_groups, keep, mixed, rows_of, small_batches, table, text_hash, with_key, without_rows
from emberlog.sources.shared import staged

PLACES = 128
#: Signature places that must agree before a pair is confirmed on its sets: 4.6 standard deviations below 0.85.
SLACK = 4.65
#: Places by which a large node branches at once.
STEP = 3
#: Text bytes that one list of sets may hold; pairs of heavier lists are confirmed one by one.
LIST_BYTES = 32 << 20
#: Pairs of one text that share a copy of it in a join.
PAIRS_A_COPY = 500
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_draw = np.random.default_rng(85)
TURN = _draw.integers(0, 1 << 32, PLACES, np.uint32)
STRETCH = _draw.integers(0, 1 << 31, PLACES, np.uint32) * np.uint32(2) + np.uint32(1)


def words(text: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return text.translate(LOWER).split()


def shingle_set(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles; a shorter text is one shingle, a text without words none."""
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(width)), strict=False))


def shingle_hashes(text: bytes, width: int, memo: WordHash) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    n = min(width, len(w))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out + np.uint64(n)))


SKETCH = "doc_id long, th long, bytes long, n long, sh binary, roots array<int>, sig binary"


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int) -> DataFrame:
    """For each row: a hash of the text, its bytes, the size of its set, a 128-bit hash of the set, the minwise hashes at the trees'
    first places and one byte of each place's; nulls where the set is empty."""
    first = np.arange(trees) * 37 % PLACES

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash(xxhash.xxh3_64_intdigest)
        for whole in batches:
            for b in rows_of(whole, 1 << 20, "t"):
                texts = as_bytes(b.column("t"))
                sets = [shingle_hashes(t, width, memo) for t in texts]
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                sh, roots, sig = (np.full(len(n), None, object) for _ in range(3))
                if len(full):
                    s = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    sums = np.stack([np.add.reduceat(s, starts), np.add.reduceat(mixed(s ^ np.uint64(0xD6E8FEB86659FD93)), starts)], axis=1)
                    low = (s >> np.uint64(32)).astype(np.uint32)
                    mins = np.empty((len(full), PLACES), np.int32)
                    for j in range(PLACES):
                        mins[:, j] = np.minimum.reduceat((low ^ TURN[j]) * STRETCH[j], starts).view(np.int32)
                    tails = mixed(mins.view(np.uint32)).astype(np.uint8)
                    for k, i in enumerate(full):
                        sh[i], roots[i], sig[i] = sums[k].tobytes(), mins[k, first], tails[k].tobytes()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(sh, pa.binary()), pa.array(roots, pa.list_(pa.int32())), pa.array(sig, pa.binary())], ["doc_id", "th", "bytes", "n", "sh", "roots", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("th"), F.col(text_col).cast("string").alias("t")).mapInArrow(sketched, SKETCH)


def trees_of(least: float, depth: int, miss: float) -> int:
    """Trees in which a pair of the least similarity meets at this depth but for the probability ``miss``, with one standard deviation
    of the signature's agreement to spare."""
    agree = least - (least * (1 - least) / PLACES) ** 0.5
    return ceil(log(miss) / log1p(-(agree**depth)))


def nodes_at(sets: DataFrame, depth: int, trees: int) -> DataFrame:
    """(v, part, node) at the given depth of each tree. A tree's first place is its own; each next one is chosen by the path so far."""
    if depth == 1:
        return sets.select("v", "part", F.explode(F.transform("roots", lambda value, tree: F.xxhash64(tree, value))).alias("node"))
    value = lambda place: F.substring("sig", place.cast("int") + 1, F.lit(1))
    root = lambda tree: F.xxhash64(tree, value(F.pmod(tree * 37, F.lit(PLACES))))
    deeper = lambda node, _: F.xxhash64(node, value(F.pmod(F.xxhash64(node, F.lit("place")), F.lit(PLACES))))
    return sets.select("v", "part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.aggregate(F.sequence(F.lit(2), F.lit(depth)), root(tree), deeper))).alias("node"))


def grow(sets: DataFrame, depth: int, trees: int, small: int) -> tuple[DataFrame, DataFrame | None]:
    """The trees at one depth, for sets with their components: (node, v, part) of distinct lists of 2 to ``small`` sets, and of larger nodes (None: no such node)."""
    rows = keep(nodes_at(sets, depth, trees))
    count = keep(rows.groupBy("node").count().filter("count > 1"))
    wide = not count.filter(F.col("count") > small).isEmpty()
    placed = with_key(rows, count, "node", "inner")
    placed = keep(placed) if wide else placed
    lists = placed.filter(F.col("count") <= small).groupBy("node").agg(F.array_sort(F.collect_set(F.struct("v", "part"))).alias("vs")).filter("size(vs) > 1").select("vs").distinct()
    lists = keep(lists.select(F.xxhash64("vs.v").alias("node"), F.explode("vs").alias("x")).select("node", "x.v", "x.part"))
    return lists, keep(placed.filter(F.col("count") > small).select("node", "v", "part")) if wide else None


def agreement(least: float) -> float:
    """Signature places that a pair of the least similarity agrees at, but for a probability of about 2e-6."""
    return PLACES * least - SLACK * (PLACES * least * (1 - least)) ** 0.5


def unpacked(members: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array | None]]:
    """Of each list of members: its place, the columns v, n, part and sig, and the texts if it has them."""
    flat, off = members.flatten(), members.offsets.to_numpy() - members.offsets[0].as_py()
    v, n, part = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    sig = np.frombuffer(b"".join(flat.field(3).to_pylist()), np.uint8).reshape(-1, PLACES)
    texts = flat.field(4) if flat.type.num_fields > 4 else None
    for at, (i, j) in enumerate(zip(off, off[1:], strict=False)):
        yield at, v[i:j], n[i:j], part[i:j], sig[i:j], texts.slice(i, j - i) if texts is not None else None


def outside(part: np.ndarray) -> np.ndarray:
    """The places of all members but those of the largest part: every pair of different parts has one of them."""
    _, at, n = np.unique(part, return_inverse=True, return_counts=True)
    return np.flatnonzero(at != n.argmax())


def alike(n: np.ndarray, part: np.ndarray, sig: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (places x, y) of different parts with similar sizes and signatures, the likeliest first."""
    agree, mine = agreement(least), outside(part)
    left = np.ones(len(n), bool)
    x, y, same = [], [], []
    for i in mine:
        left[i] = False  # a pair counts once
        j = np.flatnonzero(left & (part != part[i]) & (np.minimum(n, n[i]) >= least * np.maximum(n, n[i])))
        if len(j):
            found = np.count_nonzero(sig[j] == sig[i], axis=1)
            ok = found >= agree
            x.append(np.full(int(ok.sum()), i))
            y.append(j[ok])
            same.append(found[ok])
    if not x:
        return np.empty(0, int), np.empty(0, int)
    order = np.argsort(-np.concatenate(same), kind="stable")
    return np.concatenate(x)[order], np.concatenate(y)[order]


class Parts(dict):
    """Components by union: each points to a smaller one of its own, or is missing."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = self[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        p, q = self.find(x), self.find(y)
        if p != q:
            self[max(p, q)] = min(p, q)
        return p != q


def similar(members: DataFrame, least: float, every: bool = False) -> DataFrame:
    """From rows (node, list of (v, n, part, sig)): pairs (node, a, b), a < b, of similar signatures and different parts that span the list,
    where no pair joins what earlier ones of the list have joined, or ``every`` such pair; and (node, a, null) for each member of any."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, v, n, c, sig, _ in unpacked(b.column(1)):
                x, y = alike(n, c, sig, least)
                seen, node = Parts(), b.column(0)[k].as_py()
                out += [(node, min(v[i], v[j]), max(v[i], v[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True) if every or seen.join(c[i], c[j])]
                out += [(node, v[i], None) for i in np.union1d(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(3)], ["node", "a", "b"])

    return members.mapInArrow(paired, "node long, a long, b long")


def dealt(pairs: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b) by whole pairs, so that no end's many pairs are one task's."""
    return pairs.repartition(1) if tasks == 1 else pairs.repartition(tasks, "a", "b")


def thinned(pairs: DataFrame, most: int = 200_000) -> DataFrame:
    """Tasks of about ``most`` pairs each leave out those whose ends others of theirs connect."""
    tasks = 1 + pairs.count() // most

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Parts()
        for b in batches:
            yield b.filter(pa.array([seen.join(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.bool_()))

    return dealt(pairs, tasks).mapInArrow(spanning, "a long, b long")


def settled(members: DataFrame, least: float, width: int, num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) between the parts of each row's list of (v, n, part, sig, text): all pairs of different parts are
    tested on their full sets; what earlier links of the list connect needs no more."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash(xxhash.xxh3_64_intdigest)
        for b in batches:
            out = []
            for _, v, _, part, _, column in unpacked(b.column(0)):
                texts, seen = as_bytes(column), Parts()
                hashes = [shingle_hashes(t, width, memo) for t in texts]
                n = np.array([len(h) for h in hashes])
                _, at = np.unique(np.concatenate(hashes), return_inverse=True)
                starts, have = np.concatenate([[0], np.cumsum(n)]), np.zeros(int(at.max()) + 1, np.int64)
                for i in outside(part):
                    own = at[starts[i] : starts[i + 1]]
                    have[own] = 1
                    both = np.add.reduceat(have[at], starts[:-1])  # no set is empty
                    have[own] = 0
                    for j in np.flatnonzero((part != part[i]) & (den * both >= num * (n + n[i] - both))):
                        if seen.find(part[i]) != seen.find(part[j]) and linked(texts[i], texts[j], width, num, den):
                            seen.join(part[i], part[j])
                            out.append((min(v[i], v[j]), max(v[i], v[j])))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return members.mapInArrow(tested, "a long, b long").distinct()


def linked(x: bytes, y: bytes, width: int, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union holds for the two texts' sets."""
    s, t = shingle_set(x, width), shingle_set(y, width)
    both = len(s & t)
    return den * both >= num * (len(s) + len(t) - both)


def several(placed: DataFrame) -> DataFrame:
    """The rows (node, v, part) of nodes with more than one part."""
    apart = keep(placed.groupBy("node").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q").select("node"))
    return with_key(placed, apart, "node", "left_semi")


def star_pairs(large: DataFrame, sets: DataFrame, least: float, pivots: int = 8) -> DataFrame:
    """Candidate pairs of large nodes, from rows (node, v, part).

    Their sets agree all along the path: each is paired with the node's pivots, sets of as many components as there are pivots, but
    not with one of its own component nor with one of a dissimilar signature.
    """
    first = pivot_table(large, pivots).select("node", F.explode("p").alias("w")).select("node", "w.v", "w.part")
    first = keep(first.join(sets.select("v", "n", "sig"), "v").groupBy("node").agg(F.collect_list(F.struct("v", "n", "part", "sig")).alias("p")))
    agree = agreement(least)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, n, part = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, PLACES)
            lists = b.column(4)
            off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            flat = lists.flatten()
            pv, pn, ppart = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            psig = np.frombuffer(b"".join(flat.field(3).to_pylist()), np.uint8).reshape(-1, PLACES)
            ok = (part[row] != ppart) & (np.minimum(n[row], pn) >= least * np.maximum(n[row], pn)) & (np.count_nonzero(sig[row] == psig, axis=1) >= agree)
            a, w = v[row][ok], pv[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, w)), pa.array(np.maximum(a, w))], ["a", "b"])

    members = with_key(looked_up(large, sets.select("v", "n", "sig")), first, "node", "inner")
    return members.select("v", "n", "part", "sig", "p").mapInArrow(near, "a long, b long").distinct()


def labelled(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Sets with their components, by rows (v, part); a set without a row is its own."""
    return with_key(sets, parts, "v", "left").withColumn("part", F.coalesce("part", "v"))


def looked_up(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (node, v, part) with the columns of their sets. A set is joined once, however many nodes hold it: at most one a tree."""
    once = placed.groupBy("v").agg(F.collect_list(F.struct("node", "part")).alias("_at")).join(sets, "v")
    return once.withColumn("_at", F.explode("_at")).select("_at.node", "v", "_at.part", *[c for c in sets.columns if c != "v"])


def placed_parts(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (node, v) with the sets' components. A set is looked up once, however many nodes hold it: at most one a tree."""
    of = labelled(placed.groupBy("v").agg(F.collect_list("node").alias("nodes")), parts)
    return of.select(F.explode("nodes").alias("node"), "v", "part")


def texts_of(docs: DataFrame, id_col: str, text_col: str, need: DataFrame) -> DataFrame:
    """(v, t) of the sets in ``need`` (v, rid): the text that hashes to v, from the row with the id rid."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_hash(text_col).alias("v"), F.col(text_col).cast("string").alias("t"))
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    return rows.join(need.select("v", "rid"), "v").filter("i <=> rid").select("v", "t")


def pivot_table(rows: DataFrame, pivots: int) -> DataFrame:
    """Up to ``pivots`` members of each node: of each class of components the member with the least hash."""
    slots = rows.groupBy("node", F.pmod(F.xxhash64("part", F.lit(1)), F.lit(pivots)).alias("slot")).agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v", "part")).alias("first"))
    return slots.groupBy("node").agg(F.collect_list(F.struct("first.v", "first.part")).alias("p"))


def confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """The pairs with den * intersection >= num * union on the full shingle sets of their texts.

    A text of very many pairs is copied once for each ``PAIRS_A_COPY`` of them, and its pairs are dealt to the copies.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
    need = keep(sets.select("v", "rid").join(ends, "v"))
    texts = with_key(texts_of(docs, id_col, text_col, need), need, "v", "inner").select("v", "t", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    many = need.filter("copies > 1")
    none = many.isEmpty()
    for side, other in (("a", "b"), ("b", "a")):
        pairs = pairs.withColumn("copies", F.lit(1)) if none else with_key(pairs, many.select(F.col("v").alias(side), "copies"), side, "left")
        pairs = pairs.withColumn("copy", F.pmod(F.xxhash64(other, F.lit(side)), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        pairs = pairs.join(texts.select(F.col("v").alias(side), "copy", F.col("t").alias(f"t{side}")), [side, "copy"]).drop("copy")

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keepers = pa.array([linked(x, y, width, num, den) for x, y in zip(as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keepers), b.column(1).filter(keepers)], ["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(tested, "a long, b long").distinct()


def contracted(links: DataFrame, most: int = 200_000) -> tuple[DataFrame, int]:
    """The same components with fewer links: tasks of about ``most`` links each join what theirs connect, and give (a, b) with b the
    smallest id of that. Returns them and the number of tasks; after one task alone, b is the component."""
    tasks = 1 + links.count() // most

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids = Parts(), {}
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.join(x, y)
                ids[x] = ids[y] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.int64()), pa.array([seen.find(x) for x in ids], pa.int64())], ["a", "b"])

    return keep(dealt(links, tasks).mapInArrow(joined, "a long, b long")), tasks


def components(links: DataFrame) -> DataFrame:
    """(v, part): for each end of a link the smallest id that it reaches. Where one task can't hold the links, labels spread along
    the contracted ones and then jump to their label's label. Labels are staged: a checkpoint keeps the estimate of the plan before it, which
    each round's joins multiply, until the number itself fills the driver's memory."""
    links, tasks = contracted(links.select("a", "b"))
    if tasks == 1:
        return links.select(F.col("a").alias("v"), F.col("b").alias("part"))
    both = keep(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("part")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(both["a"].alias("v")).agg(F.min("part").alias("low"))
        step = labels.join(near, "v").select("v", "part", F.least("part", "low").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("part").alias("far"))
        step = staged(step.join(jump, "low", "left").select("v", F.col("part").alias("was"), F.least(F.col("low"), F.coalesce("far", "low")).alias("part")))
        done = step.filter("part < was").isEmpty()
        labels = step.select("v", "part")
        if done:
            return labels


def judged(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, small: int, miss: float) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept, repeats for each row of ``docs``; th is the text's hash, repeats whether other rows have its set."""
    small_batches(docs.sparkSession)
    least, depth = num / den, 1
    trees = trees_of(least, depth, miss)
    rows = keep(sketches(docs, id_col, text_col, width, trees))
    total = rows.count()
    full = rows.filter("n > 0")
    one = F.struct(F.col("th").alias("v"), F.col("doc_id").alias("rid"), "n", "bytes", "roots", "sig")
    classes = keep(full.groupBy("sh").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"), F.min_by(one, F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("s")))
    sets = classes.select("s.*")  # v names a set by a hash of one of its texts
    links, parts, active = None, None, sets.withColumn("part", F.col("v"))

    def lists(mine: DataFrame) -> DataFrame:
        return looked_up(mine, active.select("v", "n", "sig")).groupBy("node").agg(F.collect_list(F.struct("v", "n", "part", "sig")).alias("m"))

    def between(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs)
        return confirmed(pairs, sets, docs, id_col, text_col, width, num, den) if not pairs.isEmpty() else pairs

    def within(mine: DataFrame) -> list[DataFrame]:
        mine = keep(several(mine))
        if mine.isEmpty():
            return []
        weights = keep(looked_up(mine, active.select("v", "bytes")).groupBy("node").agg(F.sum("bytes").alias("held")))
        heavy = keep(weights.filter(F.col("held") > LIST_BYTES).select("node"))
        none = heavy.isEmpty()
        light = mine if none else with_key(mine, heavy, "node", "left_anti")
        need = keep(active.select("v", "rid").join(light.select("v").distinct(), "v"))
        full_sets = looked_up(light, active.select("v", "n", "sig").join(texts_of(docs, id_col, text_col, need), "v"))
        out = [settled(full_sets.groupBy("node").agg(F.collect_list(F.struct("v", "n", "part", "sig", "t")).alias("m")).select("m"), least, width, num, den)]
        return out if none else [*out, between(similar(lists(with_key(mine, heavy, "node", "left_semi")), least, every=True).filter("b is not null").select("a", "b").distinct())]

    def linked_by(found: list[DataFrame]) -> None:
        nonlocal links, parts
        for df in found:
            links = df if links is None else links.unionByName(df)
        links = staged(links.distinct())  # as in components, so that estimates start anew at each depth
        parts = components(links)

    while True:
        placed, large = grow(active, depth, trees, small)
        first = keep(similar(lists(placed if parts is None else several(placed)), least))
        pairs = thinned(keep(first.filter("b is not null").select("a", "b").distinct()))
        linked_by([between(pairs if large is None else pairs.unionByName(star_pairs(large, active, least)).distinct())])
        if found := within(keep(placed_parts(first.filter("b is null").select("node", F.col("a").alias("v")), parts))):  # sets without a similar one are done
            linked_by(found)
        again = keep(several(keep(placed_parts(large, parts))).select("v").distinct()) if large is not None else None
        if again is None or again.isEmpty():
            break
        depth += STEP
        trees = trees_of(least, depth, miss)
        active = keep(labelled(with_key(sets, again, "v", "left_semi"), parts))
    mine = keep(with_key(classes.select("sh", F.col("s.v").alias("v"), "first", "size"), parts, "v", "left"))
    least_ids = keep(mine.filter("part is not null").groupBy("part").agg(F.min("first").alias("low")))
    groups = with_key(mine, least_ids, "part", "left").select("sh", "size", F.coalesce("low", "first").alias("component_id"))
    out = join_groups(full.select("doc_id", "th", "n", "sh"), groups, "sh", "size", total).select("doc_id", "th", "n", "component_id", (F.col("size") > 1).alias("repeats"))
    out = out.unionByName(rows.filter("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("component_id"), F.lit(False).alias("repeats")))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "repeats")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, small: int = 2048, miss: float = 1e-6) -> DataFrame:
    """Groups documents of similar shingle sets: one row for each row of ``docs`` with doc_id, n_shingles, component_id, kept.

    Sets of ``width``-word shingles are linked when den * intersection >= num * union; component_id is the smallest
    doc_id reachable over links. Equal sets are one vertex, so groups of exact copies make no pairs. ``small`` is the most sets
    that a node compares exhaustively, ``miss`` the probability with which a link of the least similarity may meet in no tree.

    A text with fewer words than ``width`` is one shingle; null, empty and blank texts have none, are linked with nothing
    and are their own component. Rows that repeat an id are judged each by its own text. A row with a null id links others like
    any other, but gives no component its id; a component without ids has a null one and keeps all. An empty table gives no rows.
    """
    return judged(docs, id_col, text_col, width, num, den, small, miss).drop("th", "repeats")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, small: int = 2048, miss: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, one of each group, with all their columns.

    A decision holds for the row's id and text together, so that another text of the same id, or of a null id, stays; of rows that
    repeat both, one stays. Null, empty and blank texts all stay. An empty table stays empty.
    """
    return without_rows(docs, id_col, text_col, judged(docs, id_col, text_col, width, num, den, small, miss))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents, shingles of three words, similarity 0.85."""
    return near_dedup(table(spark, sf_dir, "documents"), width=3, num=85)
