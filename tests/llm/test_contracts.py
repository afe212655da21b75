"""Methods against brute force, held-out accuracy, odd rows, empty tables and models without the package."""

import collections
import hashlib
import math
import random
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import decontaminate, exact_dedup, html_text, langid, linear, lm_score, mixing, near_dedup, quality, substring_dedup, warc

SMALL = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def made(seed, n, size=60):
    draw = random.Random(seed)
    words = ["".join(draw.choices(LETTERS, k=draw.randint(2, 8))) for _ in range(2000)]
    return [" ".join(draw.choices(words, k=size)) for _ in range(n)]


# near dedup


def components(sets, num, den):
    part = list(range(len(sets)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                part[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def family():
    """Versions of one text with 0 to 12 changed words: many sets that share most of their shingles, in many components."""
    draw = random.Random(11)
    base = made(1, 1, 120)[0].split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4, 6, 9, 12])):
            w[draw.randrange(len(w))] = draw.choice(LETTERS) * 3 + str(draw.randrange(40))
        rows.append((i, " ".join(w)))
    return rows, components([near_dedup.shingle_set(t.encode(), 3) for _, t in rows], 85, 100)


@pytest.mark.parametrize("small", [120])
def test_links_of_one_large_family(spark, family, small):
    rows, want = family
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=85, small=small)
    assert len(set(want)) > 50 and {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(want))


def test_trees_reach_the_recall_asked_for():
    for depth in (1, 4, 7):
        n = near_dedup.trees_of(0.8, depth, 1e-6)
        assert (1 - 0.8**depth) ** n < 1e-6


def test_heavy_lists_are_confirmed_in_pairs(spark, monkeypatch):
    texts = made(3, 4, 80)
    rows = [(10 * i + k, t + f" tail{k}") for i, t in enumerate(texts) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()}
    monkeypatch.setattr(near_dedup, "LIST_BYTES", 1)
    monkeypatch.setattr(near_dedup, "PAIRS_A_COPY", 1)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()} == want


# decisions by rows


def test_repeated_and_missing_ids_keep_their_own_texts(spark):
    a, b, c = made(5, 3)
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (2, a, "z"), (None, c, "n"), (None, a, "n"), (3, None, None), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    left = sorted([(r["doc_id"], r["text"]) for r in exact_dedup.without_copies(docs).collect()], key=str)
    assert left == sorted([(1, a), (1, b), (None, c), (3, None)], key=str)
    near = sorted([(r["doc_id"], r["text"]) for r in near_dedup.without_near_copies(docs).collect()], key=str)
    assert near == sorted([(1, a), (1, b), (None, c), (3, None), (4, "")], key=str)
    items = spark.createDataFrame([(None, " ".join(c.split()[:30]))], "item_id long, text string")
    clean = decontaminate.without_contaminated(docs, items)
    assert clean.count() == len(rows) - 1 and clean.filter("th = 'n'").count() == 1


# exact dedup


def test_bits_of_maps():
    draw = np.random.default_rng(1)
    once, twice = np.zeros(1 << 12, np.uint8), np.zeros(1 << 12, np.uint8)
    seen = []
    for _ in range(5):
        at = draw.integers(0, 1 << 15, 3000)
        exact_dedup.add_bits(once, twice, at)
        seen.append(at)
    count = np.bincount(np.concatenate(seen), minlength=1 << 15)
    assert (np.unpackbits(once, bitorder="little") == (count > 0)).all() and (np.unpackbits(twice, bitorder="little") == (count > 1)).all()
    for piece in (once, np.zeros(1 << 12, np.uint8)):
        assert (exact_dedup.unpacked(exact_dedup.packed(piece)) == piece).all()


# decontamination


def edit_table(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distances_equal_the_table():
    draw = random.Random(2)
    items = [(i, decontaminate.plain(t)) for i, t in enumerate(made(8, 12, 12))]
    auto = decontaminate.machine(items, 0.05)
    for _ in range(120):
        words = draw.choice(items)[1].split()
        text = list(" ".join(words))
        for _ in range(draw.randint(0, 8)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choice([[], ["q"], [" "]])
        text = decontaminate.plain("before " + "".join(text) + " after")
        want = {k: d for k, (_, item) in enumerate(items) if (d := edit_table(item, text)) <= decontaminate.budget(item, 0.05)}
        assert decontaminate.matches(text, items, auto, 0.05) == want


# html


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, template string")


def test_the_wrapper_finds_content_without_names(spark):
    """No page marks an article or says what its parts are: the host's constants and its varying part decide."""
    texts = made(21, 12, 90)
    shell = "<body><div class=a>Home of the example</div><div class=b><p>{}</p><p>Printed by hand</p><p>{}</p></div><div class=c><div>All rights kept</div></div></body>"
    rows = [(i, f"http://plain.example/{i}", shell.format(t[:200], t[200:]), "clash", None) for i, t in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, rows)).collect()}
    assert got == {i: " ".join(t[:200].split()) + "\n\n" + " ".join(t[200:].split()) for i, t in enumerate(texts)}
    few = {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, rows), least_pages=100).collect()}
    assert "Home of the example" in few[0] and "Printed by hand" in few[0]  # without a wrapper nothing tells


def test_menus_that_vary_and_constants_in_articles(spark):
    texts = made(22, 8, 50)
    rows = [(i, f"http://b.example/{i}", f"<nav><a>{t[:9]}</a></nav><article><h1>{t[10:30]}</h1><p>{t}</p><p>Share this story</p><p class='lead promo'>{t[5:40]}</p><div class=comments>{t[:20]}</div></article><footer>{t[3:9]}</footer>", None, None) for i, t in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, rows)).collect()}
    one = lambda s: " ".join(s.split())
    assert got == {i: "\n\n".join([one(t[10:30]), one(t), one(t[5:40])]) for i, t in enumerate(texts)}


def test_pages_that_are_all_alike_keep_their_article(spark):
    rows = [(i, f"http://c.example/{i}", f"<p>{i}</p><article><p>the same text</p></article>", None, None) for i in range(9)]
    assert {r["text"] for r in html_text.extract(pages_of(spark, rows)).collect()} == {"the same text"}


def test_deep_and_wide_pages(spark):
    deep = "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>"
    wide = "<article>" + "".join(f"<{t}>{t} {i}</{t}>" for i in range(4000) for t in ("h2", "p", "pre", "ul", "p")) + "</article>"
    rows = [(i, "http://d.example/", (deep, wide)[i % 2] + f"<p>{i}</p>", None, None) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, rows)).collect()}
    assert got[0] == "deep" and got[1].count("\n\n") == 19_999
    assert html_text.main_text("<article>" + "<font>a " * 3000) == " ".join(["a"] * 3000)


def test_tree_matching_equals_brute_force():
    draw = random.Random(4)

    def tree(depth):
        return html_text.Slot(draw.choice("abc"), [tree(depth - 1) for _ in range(draw.randint(0, 4))] if depth else [])

    def brute(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x, y))
        return best[-1][-1] + 1

    for _ in range(200):
        a, b = (html_text.Slot("r", [tree(2) for _ in range(4)]) for _ in range(2))
        n, pairs = html_text.matching(a, b)
        assert n == brute(a, b) == 1 + sum(brute(a.children[i], b.children[j]) for i, j in pairs)
        both = html_text.merge(a, b)
        assert html_text.matching(both, a)[0] == brute(a, a) and html_text.unflat(html_text.flat(both)).shape == both.shape


# classifiers


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").select("score", "predicted", "quality").collect()
    pos, neg = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_copies_fill_no_sample(spark):
    rows = [("one and the same english sentence over and over", "en")] * 3000 + [(t, "xx") for t in made(31, 60, 20)] + [("other words that english has too", "en")]
    model = langid.train(spark.createDataFrame(rows, "t string, lang string"), "t", "lang", rows_a_language=5)
    assert sorted(model.languages) == ["germanic", "xx"]


def test_hinge_fit_equals_a_plain_solver():
    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(60, 5)), np.where(draw.random(60) > 0.5, 1.0, -1.0)
    cost = np.full(60, 0.7)
    w, b = linear.hinge_fit([(np.arange(5), r) for r in x], y, 5, cost, epochs=2000)
    value = lambda w, b: (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    at = value(w, b)
    for _ in range(300):
        step = draw.normal(scale=0.01, size=6)
        assert value(w + step[:5], b + step[5]) >= at - 1e-3


def test_models_run_where_the_package_is_missing(spark, tmp_path):
    """Workers start in a folder without the package: models travel as arrays, functions by value."""
    code = f"""
        import os, sys
        sys.path.insert(0, {str(__import__("pathlib").Path(corpus_pipeline.__file__).parent)!r})
        from pyspark.sql import SparkSession
        import __spark_entry__ as e
        sys.path.pop(0)
        os.environ.pop("PYTHONPATH", None)
        s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
        for q in ("op2_quality", "op6_language", "op1_lm_score"):
            print(q, e.queries()[q](s, {SMALL!r}).count())
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, cwd=tmp_path, timeout=280, check=False)
    assert out.stdout.split() == ["op2_quality", "200", "op6_language", "200", "op1_lm_score", "200"], out.stderr[-2000:]


# empty tables and every stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert quality.quality_scores(docs, labels).count() == 0 and html_text.extract(pages).count() == 0
    assert decontaminate.contamination(docs, items).count() == 0 and langid.identify(docs, langid.train(docs, "text", "lang")).count() == 0
    for kept in (quality.without_low_quality(docs, labels), exact_dedup.without_copies(docs), near_dedup.without_near_copies(docs), decontaminate.without_contaminated(docs, items)):
        assert kept.columns == docs.columns and kept.count() == 0


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Every stage on all that the one before kept, with nulls, repeats and clashing columns, against sets and tables of plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = docs.orderBy("doc_id").first()
    odd = spark.createDataFrame([(first["doc_id"], "another text with an id that is taken already", "en", "s", 1), (None, None, None, None, None), (10**6, "", "en", None, 0)], DOCS)
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("labels", "benchmark"))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(quality.labelled_documents(now, labels), "doc_id", "text", "label")
    seen = np.zeros(linear.FEATURES, np.uint8)
    rows = [tuple(r) for r in now.collect()]
    want = [r for r in rows if model.score((r[1] or "").encode(), seen) >= 0.3]
    steps = [want]
    best = {}
    for r in want:
        key = "".join((r[1] or "").split(" ")).translate(str.maketrans("", "", "\t\n\x0b\x0c\r"))
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    want = [r for _, r in best.values()]
    steps.append(want)
    part = components([near_dedup.shingle_set((r[1] or "").encode(), 5) for r in want], 80, 100)
    low = {}
    for r, p in zip(want, part, strict=True):
        low.setdefault(p, []).append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in low.values()]
    steps.append(want)
    items = [decontaminate.plain(r["text"]) for r in bench.collect() if r["text"]]
    hit = lambda t: any(edit_table(i, t) <= decontaminate.budget(i, 0.05) for i in items if i[2:12] in t or i[-12:-2] in t or i[len(i) // 2 : len(i) // 2 + 8] in t)
    want = [r for r in want if not hit(decontaminate.plain(r[1]))]
    steps.append(want)
    for (name, stage), rows_wanted in zip(corpus_pipeline.STAGES[:4], steps, strict=True):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        now.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        now = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        assert sorted(map(str, [tuple(r) for r in now.collect()])) == sorted(map(str, rows_wanted)), name
    mixed = corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path))
    assert mixed.count() == len(want) and all(r["taken"] <= 2 * r["size"] for r in mixed.collect())


# warc


def test_archives_and_their_index(spark, tmp_path):
    draw = random.Random(9)
    big = made(41, 6, 300)
    rows = [(i, f"http://{draw.choice('abc')}.example/{draw.randrange(9)}", big[i % 6] if i % 3 else f"small {i}") for i in range(60)] + [(90, None, None), (91, "http://a.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in warc.query(spark, str(tmp_path)).collect()}
    last = {}
    for i, _, page in rows:
        data = (page or "").encode()
        if len(data) >= 1000:
            last[data] = max(i, last.get(data, -1))
    for i, _, page in rows:
        data = (page or "").encode()
        of = last.get(data)
        want = ("revisit", of) if of is not None and of != i else ("response", None)
        assert (got[i]["record_type"], got[i]["refers_to"]) == want and got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha1(data).hexdigest()


def test_the_history_is_in_order_across_ranges(spark, tmp_path):
    draw = random.Random(7)
    rows = [(i, f"http://{draw.choice(['a.x', 'b.x', 'x'])}/{draw.randrange(5)}" if i % 3 else "http://hot.x/", f"page {i % 40}") for i in range(900)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), f"{tmp_path}/w")
    records = warc.read_archives(spark, f"{tmp_path}/w")
    merged = warc.merged_index(records, rows_a_range=100)
    got = [(r["urlkey"].encode(), r["ts"], r["id"]) for r in merged.collect()]
    assert merged.rdd.getNumPartitions() > 5 and got == sorted(got) and sorted(i for _, _, i in got) == list(range(900))
    lists = [sorted(draw.choices(range(50), k=draw.randrange(9))) for _ in range(13)]
    assert list(warc.LoserTree(lists)) == sorted(x for r in lists for x in r) and not list(warc.LoserTree([]))


def test_damaged_archives_are_errors(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, "http://a.x/", "text " * 50) for i in range(3)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w")
    file = next((tmp_path / "w").glob("part-*"))
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "part-0.txt.gz").write_bytes(gzip.compress(gzip.decompress(file.read_bytes())[:-60]))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, f"{tmp_path}/v").collect()
    with pytest.raises(ValueError, match="codec"):
        warc.write_archives(pages, f"{tmp_path}/u", compression="none")


# substring dedup


def test_buckets_over_their_bound(spark):
    passage = " ".join(made(61, 1, 90))
    rows = [(i, t + " " + passage + " " + t[:30]) for i, t in enumerate(made(62, 40, 30))] + [(7, "short"), (None, passage), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, got = ({(r["doc_id"], r["n_words"]): (r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs, k=20, chunk_bytes=600, **o).collect()} for o in ({}, {"most_bytes": 1}))
    assert want == got and sum(r[0] for r in got.values()) >= 39 * 90


# the model's gradient


def test_gradient_of_the_window_network():
    net = lm_score.WindowNetwork.begun(8, 1)
    draw = np.random.default_rng(2)
    ids = draw.integers(0, 64, 40).astype(np.uint16)
    ctx = lm_score.contexts(ids, np.array([25, 15]), 64)
    grad = net.gradient(ids, ctx)
    for name, g in grad.items():
        assert g.shape == net.p[name].shape
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:3], g.shape), strict=True):
            kept, sides = net.p[name][at], []
            for step in (1e-2, -1e-2):
                net.p[name][at] = kept + step
                sides.append(-net.log_probability(ids, ctx).sum())
            net.p[name][at] = kept
            assert abs((sides[0] - sides[1]) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at])), name


def test_pseudo_likelihood_equals_a_plain_loop(spark):
    """Both sides of every token: each window by hand."""
    ids = np.arange(12, dtype=np.uint16)
    ctx = lm_score.contexts(ids, np.array([7, 0, 5]), 64)
    side = ctx.shape[1] // 2
    for at in range(12):
        lo, hi = (0, 7) if at < 7 else (7, 12)
        want = [at + d if lo <= at + d < hi else 64 for d in [*range(-side, 0), *range(1, side + 1)]]
        assert sorted(ctx[at].tolist()) == sorted(want)


def test_scores_do_not_depend_on_the_partitions(spark):
    docs = spark.createDataFrame(list(enumerate(made(51, 60, 40))), "doc_id long, text string")
    one, many = ({r["doc_id"]: r["log_prob"] for r in lm_score.lm_score(d).collect()} for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert one == pytest.approx(many, abs=1e-4)  # products in single precision


def test_scores_equal_a_plain_loop_over_windows_classes_and_words(spark):
    texts = made(53, 40, 30) + ["", None, "alone", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm_score.words_of(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    v = lm_score.vocabulary(rows, 1 << 18)
    net = lm_score.train(lm_score.tokens_of(rows, v), v.groups, 3, 8192, 0.2, 1)
    p, g = {k: x.astype(float) for k, x in net.p.items()}, v.groups
    words = [(t or "").lower().split() for t in texts]
    counts = collections.Counter(w for d in words for w in d)
    token = dict(zip(v.words.tolist(), v.token.tolist(), strict=True))
    token = {w: token[lm_score.word_hash(w.encode())] for w in counts}
    total, kinds = collections.Counter(), collections.Counter(token.values())
    for w, n in counts.items():
        total[token[w]] += n
    got = {r["doc_id"]: r for r in lm_score.lm_score(docs).collect()}
    for i, d in enumerate(words):
        want = 0.0
        for at, w in enumerate(d):
            sides = [token[d[k]] if 0 <= k < len(d) else g * g for k in (at - 2, at - 1, at + 1, at + 2)]
            x = [value for t in sides for value in p["embed"][t]]
            h = [math.tanh(sum(a * b for a, b in zip(x, column, strict=True)) + c) for column, c in zip(p["w1"].T, p["b1"], strict=True)]
            group, place = divmod(token[w], g)
            for weights, bias, k in ((p["wg"], p["bg"], group), (p["wt"][group], p["bt"][group], place)):
                z = [sum(a * b for a, b in zip(h, weights[:, j], strict=True)) + bias[j] for j in range(g)]
                want += z[k] - math.log(sum(math.exp(y) for y in z))
            want += math.log(counts[w] / (total[token[w]] + kinds[token[w]]))
        assert got[i]["log_prob"] == pytest.approx(want, abs=1e-3 + 1e-4 * len(d)) and got[i]["n_tokens"] == len(d)


def test_training_gains_from_more_text(spark):
    """Held-out texts against their own words in random order: the gap, and the log-probability, grow with the text that is learnt from."""
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").dropDuplicates(["text"])
    rows = lm_score.words_of(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    v = lm_score.vocabulary(rows, 1 << 18)
    rows = lm_score.keep(lm_score.tokens_of(rows, v))
    held, seen = [np.frombuffer(r["tokens"], np.uint16) for r in rows.filter("pmod(h, 8) = 0 and n > 5").orderBy("h").collect()], rows.filter("pmod(h, 8) > 0")
    draw, found = np.random.default_rng(1), []
    both = [np.concatenate(held), np.concatenate([draw.permutation(d) for d in held])]
    ctx = [lm_score.contexts(ids, np.array([len(d) for d in held]), v.groups**2) for ids in both]
    for part in (seen.filter("pmod(h, 64) < 4"), seen):
        net = lm_score.train(part, v.groups, 3, 256, 0.2, 1, shard_words=1 << 15)  # 128 steps a shard, as at full size
        found.append([net.log_probability(ids, c).mean() for ids, c in zip(both, ctx, strict=True)])
    (few, mixed), (all_, mixed_all) = found
    assert all_ > few + 0.05 and all_ - mixed_all > few - mixed > 0, found


def test_a_null_id_of_many_rows_is_no_hot_chunk(spark):
    docs = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs).agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).first()
    assert got["n"] == 9000 and abs(got["taken"] - got["target"]) <= 0.01 * got["target"] and got["most"] <= 2


def test_mixing_sql_columns(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(mixing.SHARES_SQL).fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"]) for r in mixing.query(spark, SMALL).collect()}
    assert {k: (v[0], v[1], pytest.approx(v[2])) for k, v in want.items()} == got
