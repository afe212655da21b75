"""Operators on vectors against brute force: odd rows, ties, copies, empty tables, both ways of meeting queries."""

from fractions import Fraction

import numpy as np
import pytest

from emberlog.llm import eigen, negatives, vptree, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string, n string"


def rows(count=420, dims=6, seed=1):
    draw = np.random.default_rng(seed)
    out = [(i, [float(np.float32(x)) for x in draw.normal(size=dims) / 3], int(draw.integers(4)), "clash", None, "x") for i in range(count)]
    out += [(count + i, out[7][1], 1, None, None, None) for i in range(60)]  # one vector, many ids: ties
    out += [out[100], out[100], out[40]]  # whole rows repeat, an anchor and query among them
    out += [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 2), (903, [NAN] + [0.0] * (dims - 1), 1), (904, [INF] * dims, 1), (905, [None] * dims, 1), (None, [0.125] * dims, 1), (1000, [0.125] * dims, None), (907, [0.5], 3)]
    return [(*r, *[None] * (6 - len(r))) for r in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def clean(ids=True, labels=False, zero=True):
    out = []
    for i, v, label, *_ in rows():
        if v is None or len(v) != 6 or any(c is None or not np.isfinite(c) for c in v) or (ids and i is None) or (labels and label is None) or (not zero and not any(v)):
            continue
        out.append((i, v, label))
    return out


@pytest.mark.parametrize("kind", ["random", "rank one", "equal values", "clusters", "graded", "zero"])
@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_eigen(kind, n):
    draw = np.random.default_rng(n)
    q = np.linalg.qr(draw.normal(size=(n, n)))[0]
    a = {"random": lambda: q + q.T, "rank one": lambda: np.ones((n, n)), "equal values": lambda: np.eye(n) * 3, "clusters": lambda: (q * (np.arange(n) // 3)) @ q.T, "graded": lambda: (q * 10.0 ** -np.arange(n)) @ q.T, "zero": lambda: np.zeros((n, n))}[kind]()
    a = (a + a.T) / 2
    w, v = eigen.eigh(a)
    size = max(np.abs(a).max(), 1e-30)
    assert np.all(np.diff(w) <= 0)
    assert np.abs(w[::-1] - np.linalg.eigvalsh(a)).max() < 1e-13 * size * max(n, 4)
    assert np.abs(a @ v - v * w).max() < 1e-14 * size * max(n, 4)
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-14 * max(n, 4)


def test_outer_products_lose_nothing():
    draw = np.random.default_rng(5)
    high = draw.normal(size=(200, 3)) * [1.0, 1e-6, 1e3]
    low = high * draw.uniform(-1, 1, size=high.shape) * 2.0**-54
    h, lo = whitening.outer_sum(high, low, np.array([8.0, 2.0**-16, 8192.0]))
    for i in range(3):
        for j in range(3):
            exact = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i], low[:, i], high[:, j], low[:, j], strict=True))
            scale = sum(abs(Fraction(a) * Fraction(c)) for a, c in zip(high[:, i], high[:, j], strict=True))
            assert abs(Fraction(h[i, j]) + Fraction(lo[i, j]) - exact) < scale * Fraction(2) ** -90


def test_whitening(table):
    fit = clean(ids=False)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in fit]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    offsets = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in offsets), n**3)) for j in range(6)] for i in range(6)])
    e, unit = np.linalg.eigh(v)
    e, unit = e[::-1], unit[:, ::-1]
    got = whitening.whiten(table, components=4).toPandas()
    assert len(got) == 4 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-12
    by = {}
    for i, r, o in zip([f[0] for f in fit], x, offsets, strict=True):
        by.setdefault(i, []).append((sum(c * c for c in o), (np.array(o, float) / n) @ unit / np.sqrt(e)))
    signs = {}
    for row in got.itertuples():
        k = row.component - 1
        i = None if np.isnan(row.vec_id) else int(row.vec_id)
        assert any(row.deviation == d and abs(abs(row.whitened) - abs(w[k])) < 1e-10 for d, w in by[i])
        assert abs(row.explained - e[k] / e.sum()) < 1e-12
        if abs(row.whitened) > 1e-6:
            signs.setdefault(k, set()).update(np.sign(row.whitened) * np.sign(w[k]) for _, w in by[i])
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_beyond_64_bits(spark):
    data = [(1, [2.0**55, 2.0**50]), (2, [-(2.0**54), -(2.0**55)]), (3, [3.0, 2.0**54]), (4, [2.0**40, 5.0])]
    got = whitening.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 8 and got["deviation"].isna().any() and got["identity_error"].max() < 1e-4


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(same).toPandas()
    assert len(got) == 4 and got["whitened"].isna().all() and got["identity_error"].isna().all() and set(got["deviation"]) == {0}
    line = spark.createDataFrame([(i, [1.0 * i, 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).toPandas()
    assert got[got.component == 1]["whitened"].notna().all() and got[got.component == 2]["whitened"].isna().all()


def mined(every, positives, count):
    data = [(i, [int(np.floor(256 * c)) for c in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in clean(labels=True)]
    out = []
    for a, av, al in data:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=True)), i, label) for i, v, label in data)
        for ps, p, _ in [s for s in scored if s[2] == al and s[1] != a][:positives]:
            found = [s for s in scored if s[2] != al and 30 * -ps <= 100 * -s[0] <= 90 * -ps]
            out += [(a, p, rank + 1, i, -ps, -s) for rank, (s, i, _) in enumerate(found[:count])]
    return sorted(out)


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": 0, "block_anchors": 3}])
def test_negatives_equal_brute_force(table, way):
    got = sorted(tuple(r) for r in negatives.mine(table, anchor_every=20, positives=3, negatives=4, **way).collect())
    assert got == mined(20, 3, 4)


def test_negatives_of_large_scores(spark):
    draw = np.random.default_rng(3)
    data = [(i, [float(x) for x in draw.integers(-60_000, 60_000, 40)], int(i % 3)) for i in range(60)]
    got = sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), anchor_every=15, shifted_every=0, lower=-500).collect())
    whole = [(i, [int(256 * c) for c in v], k) for i, v, k in data]
    want = []
    for a, av, al in (w for w in whole if w[0] % 15 == 0):
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=True)), i, k) for i, v, k in whole)
        for ps, p, _ in [s for s in scored if s[2] == al and s[1] != a][:5]:
            if ps <= 0:
                want += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate([s for s in scored if s[2] != al and -500 * -ps <= 100 * -s[0] <= 90 * -ps][:10])]
    assert got == sorted(want) and len(want) > 50


def nearest(k, every):
    data = clean(zero=False)
    out = []
    for q, qv, _ in data:
        if q % every == 0:
            scored = []
            for i, v, _ in data:
                if i != q:
                    s = 0.0
                    for x, y in zip(qv, v, strict=True):
                        s += x * y
                    scored.append((-s, i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("way", [{}, {"broadcast_bytes": 0, "block_queries": 4, "shard_bytes": 4000, "leaf": 8}, {"leaf": 4, "k": 1000}])
def test_nearest_equal_brute_force(table, way):
    got = sorted(tuple(r) for r in vptree.search(table, **{"k": 9} | way).collect())
    assert got == nearest(way.get("k", 9), 20)


def test_factor_trades_recall_for_work():
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 8))
    m = np.repeat(centres, 100, 0) + draw.normal(size=(4000, 8)) / 10
    queries, ids = m[::20], np.arange(4000)
    tree = vptree.Tree(m, 32)
    exact = np.argsort(-(queries @ m.T) + 1e9 * (ids[::20][:, None] == ids), axis=1, kind="stable")[:, :10]
    seen, recall = [], []
    for factor in (1.0, 0.9, 0.4):
        s = vptree.Search(ids, m, tree.order, tree.nodes, ids[::20], queries, 10, factor)
        s.run()
        seen.append(s.seen)
        recall.append(np.mean([len(set(tree.order[a]) & set(b)) / 10 for a, b in zip(s.at, exact, strict=True)]))
    assert recall[0] == 1.0 and seen[0] < 0.9 * 200 * 4000 and seen[0] > seen[1] > seen[2] and recall[1] > 0.9


def test_empty_tables(spark):
    for data in ([], [(1, None, 1)], [(100, [NAN], None)]):
        none = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
        assert whitening.whiten(none).collect() == negatives.mine(none).collect() == vptree.search(none).collect() == []
    one = spark.createDataFrame([(100, [1.0], 3)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(one).collect() == vptree.search(one).collect() == [] and len(whitening.whiten(one).collect()) == 1
