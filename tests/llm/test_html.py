"""What is and isn't an article's text, and wrappers of hosts whose pages have names of their own."""

import random
import time

import pytest

from emberlog.llm import html_text

SCHEMA = "page_id long, url string, html string"
WORDS = [f"word{i}" for i in range(300)]


def sentences(seed, n=12, size=40):
    draw = random.Random(seed)
    return [" ".join(draw.choice(WORDS) for _ in range(size)) for _ in range(n)]


def extracted(spark, shell, texts):
    rows = [(i, f"http://h.example/{i}", shell.replace("TEXT", t).replace("NUMBER", str(i))) for i, t in enumerate(texts)]
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize(
    ("shell", "text"),
    [
        ("<div><article><p>TEXT</p></article></div><section class='comments'><article class='comment-body'><p>reader NUMBER says so</p></article></section>", "TEXT"),
        ("<main><article><p>TEXT</p></article><ol id='comment-list'><li><article class=comment>me NUMBER</article></li></ol></main>", "TEXT"),
        ("<article><p>TEXT</p><div class='comment-list'>c NUMBER</div><div class='comments-area'>d NUMBER</div><div class='reader-comments'>e NUMBER</div><div class='ad-slot'>f NUMBER</div><div class='notice-box'>g NUMBER</div><figure class=ad>h NUMBER</figure><p class=advertisement>i NUMBER</p></article>", "TEXT"),
        ("<div class='sponsored-posts'><article>buy NUMBER</article></div><article><p>TEXT</p></article>", "TEXT"),
        ("<div class='layout has-sidebar'><div class=sidebar>other NUMBER</div><p>TEXT</p></div>", "TEXT"),
        ("<div class='page-header-fixed'><div class='site-header'>Title of all</div><p>TEXT</p></div>", "TEXT"),
        ("<article><h2>Ingredients</h2><p>TEXT</p><h2>Method</h2><p>NUMBER times</p><p>Share this</p></article>", "Ingredients\n\nTEXT\n\nMethod\n\nNUMBER times"),
        ("<article><p>TEXT<button>Copy</button>after</p><p>one<script>var x = 1</script>word</p></article>", "TEXT after\n\noneword"),
        ("<form><nav>menu</nav><article><p>TEXT</p></article></form>", "TEXT"),
        ("<body class='comments-open sidebar-left'><div class=wrap><p>TEXT</p></div><footer>NUMBER</footer></body>", "TEXT"),
    ],
)
def test_contract(spark, shell, text):
    texts = sentences(len(shell))
    assert extracted(spark, shell, texts) == {i: text.replace("TEXT", t).replace("NUMBER", str(i)) for i, t in enumerate(texts)}


def blog(n, seed=1):
    draw = random.Random(seed)
    pages = []
    for i, t in enumerate(sentences(seed, n)):
        tag = "".join(draw.choice("abcdefghij") for _ in range(9))
        pages.append((i, f"http://blog.example/{i}", f"<body><div class=top>The Blog</div><div class='post post-{i} tag-{tag} author-{tag[::-1]}'><div class='title t{i}'><h1>{t[:30]}</h1></div><div class=text><p>{t}</p><p>{t[::-1]}</p></div></div><div class=bottom>All rights</div></body>"))
    return pages


def test_names_of_one_page_do_not_grow_the_wrapper(spark):
    pages = blog(600)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {i: "\n\n".join([t[:30].strip(), t, t[::-1]]) for i, t in enumerate(sentences(1, 600))}
    wrapper = html_text.wrappers(spark.createDataFrame([("h", html) for _, _, html in pages], "host string, html string")).collect()
    assert len(wrapper) == 1 and len(wrapper[0]["wrapper"].split("\n")) < 20 and "post" in wrapper[0]["wrapper"]


def test_merging_takes_linear_time(spark):
    took = []
    for n in (1000, 4000):
        rows = spark.createDataFrame([("h", html) for _, _, html in blog(n)], "host string, html string").repartition(4)
        began = time.time()
        assert len(html_text.wrappers(rows).collect()) == 1
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 5
