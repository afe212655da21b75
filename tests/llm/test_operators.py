"""The ten operators on small tables: null, empty, repeated and tied rows, and brute force where it is exact."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from emberlog.llm import common, decontaminate, exact_dedup, html_text, langid, lm_score, mixing, near_dedup, substring_dedup

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    rows = []
    for i in range(60):
        w = [draw.choice(WORDS) for _ in range(draw.randint(30, 80))]
        rows.append((i, " ".join(w), "ab"[i % 2], "en", "clash"))
        if i % 5 == 0:
            w[3] = "changed"
            rows += [(100 + i, " ".join(w), None, "en", "x"), (200 + i, "  ".join(w), "a", "en", "x")]
    rows += [(900, None, None, None, None), (901, "", "a", None, None), (902, " \n", "b", None, None), (903, "one two", "b", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep_id string")


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_exact_dedup(docs):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups = {}
    for i, t in texts(docs).items():
        groups.setdefault("".join(t.split()), []).append((-len(t), i))
    for members in groups.values():
        for _, i in members:
            assert (got[i]["keep_id"], got[i]["group_size"]) == (min(members)[1], len(members))


def test_near_dedup_equals_brute_force(docs):
    sets = {i: near_dedup.shingle_set(t.encode(), 3) for i, t in texts(docs).items()}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = {i: low if p == high else p for i, p in part.items()}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, width=3, num=85).collect()}
    assert got == part
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, width=3, num=85, small=2).collect()} == part


def test_substring_dedup_equals_brute_force(docs):
    words = {i: t.split() for i, t in texts(docs).items()}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words):
        for p in range(len(words[i]) - 19):
            w = tuple(words[i][p : p + 20])
            if w in seen:
                gone[i].update(range(p, p + 20))
            seen.add(w)
    for r in substring_dedup.substring_dedup(docs, k=20).collect():
        assert r["kept_text"] == " ".join(w for p, w in enumerate(words[r["doc_id"]]) if p not in gone[r["doc_id"]])


def test_decontamination_finds_edits(spark, docs):
    item = " ".join(WORDS[:30])
    quoted = spark.createDataFrame([(1, "before " + item.replace("w7", "w7x") + " after"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["best_distance"]) for r in decontaminate.contamination(quoted, spark.createDataFrame([(5, item), (6, None)], "item_id long, text string")).collect()}
    assert got == {1: (True, 1), 2: (False, None), 3: (False, None)}


def test_mixing_keeps_targets_and_reruns_agree(docs):
    first = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    by = {}
    for r in mixing.mix(docs).collect():
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(taken - target) <= 0.02 * target + 2 for target, taken in by.values())


def test_mixing_keeps_the_targets_of_small_sources(spark):
    rows = [(i, "w " * 500, "hot") for i in range(2000)] + [(5000 + i, "w " * 5, "tiny") for i in range(4)] + [(6000 + i, "w " * 50, None) for i in range(3)]
    by = {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert by["tiny"][0] == 40 and by[None][0] == 300
    assert all(abs(taken - target) <= 0.02 * target + 2 for target, taken in by.values()), by


def test_html_blocks(spark):
    page = "<html><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two</p><script>x</script></article><footer>f</footer></html>"
    rows = spark.createDataFrame([(1, "http://h/a", page), (2, None, None), (3, "http://h/b", "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(rows).collect()}
    assert got == {1: ("A & B\n\none two", 14), 2: ("", 0), 3: ("", 0)}


def test_scores_of_odd_texts(docs):
    got = {r["doc_id"]: r for r in lm_score.lm_score(docs).collect()}
    assert len(got) == docs.count() and got[900]["log_prob"] == 0 and got[901]["mean_log_prob"] is None and got[0]["log_prob"] < 0


def test_scores_tell_words_of_one_bucket_apart(spark):
    seen = {}
    for i in range(100_000):  # two words that a hash of 16 bits doesn't tell apart
        w = f"x{i}"
        common = seen.setdefault(xxhash.xxh3_64_intdigest(w.encode()) & 0xFFFF, w)
        if common != w:
            break
    rows = spark.createDataFrame([(i, common) for i in range(200)] + [(900, w)], "doc_id long, text string")
    got = {r["doc_id"]: r["log_prob"] for r in lm_score.lm_score(rows).collect()}
    assert got[900] < got[0] - 0.5


def test_words_in_their_classes(spark):
    draw = random.Random(5)
    words = [f"v{min(int(draw.paretovariate(0.5)), 10**5)}" for _ in range(17_000)] + [f"u{i}" for i in range(3_000)]
    draw.shuffle(words)
    rows = spark.createDataFrame([(i, " ".join(words[i * 100 : i * 100 + 100])) for i in range(200)], "doc_id long, text string").coalesce(1)
    counts = Counter(words)
    mine = lm_score.words_of(rows, "doc_id", "text")
    v = lm_score.vocabulary(mine, 1 << 18)
    assert len(v.words) == len(counts) > 3000 and v.groups == lm_score.groups_of(len(counts))
    at = {h: k for k, h in enumerate(v.words.tolist())}
    total, kinds = Counter(), Counter()
    for w, n in counts.items():
        token = int(v.token[at[lm_score.word_hash(w.encode())]])
        total[token] += n
        kinds[token] += 1
    for w, n in counts.items():
        k = at[lm_score.word_hash(w.encode())]
        token = int(v.token[k])
        assert abs(v.lp[k] / lm_score.UNIT - math.log(n / (total[token] + kinds[token]))) < 1e-8
    few = {r["doc_id"]: r["log_prob"] for r in lm_score.lm_score(rows, head=100).collect()}
    assert few == pytest.approx({r["doc_id"]: r["log_prob"] for r in lm_score.lm_score(rows).collect()}, abs=1e-6)


def test_network_of_more_classes_learns():
    net = lm_score.WindowNetwork.begun(40, 1)
    ids = np.tile(np.arange(0, 1600, 16), 20).astype(np.uint16)
    ctx = lm_score.contexts(ids, np.array([len(ids)]), 1600)
    before = net.log_probability(ids, ctx).mean()
    memory = {k: np.full(s, 1e-3, np.float32) for k, s in lm_score.shapes(40).items()}
    for _ in range(50):
        net.step(ids, ctx, memory, 0.1)
    assert net.log_probability(ids, ctx).mean() > before + 1


def test_language_of_odd_texts(docs):
    model = langid.train(docs, "text", "lang")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert (got[900], got[902], got[0]) == ("und", "und", "en")


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, near_dedup.near_dedup, substring_dedup.substring_dedup, mixing.mix, lm_score.lm_score])
def test_empty_tables(docs, run):
    assert run(docs.filter("false")).count() == 0


def test_texts_without_repeats_are_not_shuffled(spark):
    """op8: only texts that may have marks are joined with them, whatever their number; results are those of a plain loop."""
    from emberlog.llm.substring_dedup import marked_bits, substring_dedup

    texts = [" ".join(f"w{i}x{j}" for j in range(9)) + (" a b c d e f" if i % 10 == 3 else "") for i in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (500, None), (None, texts[3]), (501, "a b")], "doc_id long, text string")
    out = substring_dedup(docs, k=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "broadcast" not in plan
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()}
    want = {i: (len(t.split()), 0, t) for i, t in enumerate(texts)} | {500: (0, 0, ""), 501: (2, 0, "a b"), None: (15, 0, texts[3])}
    for i in range(3, 200, 10):
        want[i] = (15, 15, "") if i == 3 else (15, 6, " ".join(texts[i].split()[:9]))
    assert got == want
    marks = spark.createDataFrame([(i, i * 7) for i in range(5000)], "doc_id long, th long")
    bits, held = marked_bits(marks)
    from emberlog.llm.substring_dedup import bit_of

    places = [r["p"] for r in marks.select(bit_of(bits).alias("p")).collect()]
    assert all(held.value[p >> 3] >> (p & 7) & 1 for p in places) and sum(bin(x).count("1") for x in held.value) == len(set(places))


def test_a_set_is_looked_up_once_for_all_its_nodes(spark):
    placed = spark.createDataFrame([(node, v) for v in range(40) for node in range(v % 7 + 1)], "node long, v long")
    parts = spark.createDataFrame([(v, v % 3) for v in range(20)], "v long, part long")
    got = near_dedup.placed_parts(placed, parts)
    assert Counter(tuple(r) for r in got.collect()) == Counter((node, v, v % 3 if v < 20 else v) for v in range(40) for node in range(v % 7 + 1))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(nodes") < plan.index("Join LeftOuter") < plan.index("Aggregate [v")  # rows of nodes are made after the join


def test_vectors_travel_in_their_own_precision(spark):
    draw = np.random.default_rng(2)
    flats, weights = draw.normal(size=(5, 9000)).astype(np.float32), [3, 70_001, 5, 999_983, 12]
    rows = [(*r[:4], [float(x) for x in r[4]]) for task in range(5) for pdf in common.vector_rows("p", flats[task], weights[task], task=task) for r in pdf[["name", "chunk", "task", "weight", "values"]].itertuples(index=False)]
    assert next(iter(common.vector_rows("p", flats[0], 3, task=0)))["values"][0].dtype == np.float32
    weight, total = common.sum_vectors(spark.createDataFrame(rows, common.SINGLES).repartition(3), fan_in=2, weighed=True)["p"]
    want = [flats[k].astype(np.float64) * weights[k] for k in range(5)]
    assert weight == sum(weights) and np.array_equal(total, ((want[0] + want[1]) + (want[2] + want[3])) + want[4])


def test_a_set_is_looked_up_once(spark):
    """A set that many nodes hold goes through the join with its signature once, not once for each node."""
    placed = spark.createDataFrame([(node, v, v // 2) for v in range(6) for node in range(50)], "node long, v long, part long")
    sets = spark.createDataFrame([(v, 10 * v) for v in range(5)], "v long, n long")
    held = near_dedup.looked_up(placed, sets)
    above, join, below = held._jdf.queryExecution().optimizedPlan().toString().partition("Join Inner")
    assert join and "Generate explode" in above and "collect_list" in below and "Generate" not in below
    assert sorted(map(tuple, held.collect())) == [(node, v, v // 2, 10 * v) for node in range(50) for v in range(5)]


def test_size_estimates_start_anew_with_each_round(spark, monkeypatch):
    """Joins multiply the planner's estimates: carried from round to round, the numbers themselves fill the driver."""
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    real, seen = near_dedup.contracted, []
    monkeypatch.setattr(near_dedup, "contracted", lambda links: (seen.append(bits(links)), real(links, 4))[1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    parts = near_dedup.components(chain)
    assert bits(parts) < 64 and {tuple(r) for r in parts.collect()} == {(i, 0) for i in range(41)}
    del seen[:]
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:-1], f"x{i}"])) for i in range(8)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=85, small=2)
    assert {r["component_id"] for r in got.collect()} == {0}
    assert seen and max(seen) < 64
