"""Main text of web pages by wrapper induction.

The pages of one host are parsed to trees of block elements and texts, in which siblings of one name that follow each other are one
repeated slot. Simple tree matching aligns them, one after another, into the host's wrapper: a tree of all slots that its pages
have. Then every page is aligned with its wrapper, and Spark counts for each slot how many pages have which text there. What
nearly all pages have in one slot is template; slots whose texts vary hold content. Where pages mark no article, the part of the
wrapper that holds most of the varying text takes its place. Names, classes and roles are a second vote: they tell menus, adverts
and the like from content where these vary too.

Structures that repeat are merged once, in an order of their own, so that the wrapper depends neither on the partitions nor on the
order of rows; two shuffled levels merge them, so that no host needs its pages in one place.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import BROADCAST_ROWS, keep, small_batches, table, with_key

TOKEN = re.compile(r"<!--.*?-->|<!--.*\Z|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=\s|/|$)", re.I)
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}
# Elements and names that aren't part of an article.
ASIDE = frozenset("nav aside footer form menu head script style noscript template iframe svg canvas object button select textarea input dialog title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TOKENS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist commentform respond disqus cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe signup masthead toolbar pagination".split())
NOTICES = frozenset("cookie cookies consent gdpr notice notices notification popup modal newsletter".split())
# Containers that an article may hold beside its text.
CONTAINERS = frozenset("div section ul ol dl table figure".split())
# What readers write, what advertisers do, words of names that tell what a page has or how it looks, and first words of short lines that go with every article.
COMMENTS = frozenset("comment comments commentlist commentform respond disqus".split())
ADVERTS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo".split())
MODIFIERS = frozenset("has have with without no not is are hide show enable enabled disable disabled open closed allow free".split())
FURNITURE = frozenset("share tweet print email follow subscribe advertisement sponsored bookmark".split())

#: Trees are walked to their full depth, which the page alone bounds; frames of Python functions are on the heap.
DEPTH = 10_000_000


class Node:
    """An element: its label is its name with its classes; children are elements and texts, in order."""

    __slots__ = ("tag", "label", "names", "role", "children", "main", "holds_main")

    def __init__(self, tag: str, attributes: str = ""):
        found = {k.lower(): html.unescape(a or b or c or "").lower() for k, a, b, c in NAMED.findall(attributes)} if attributes else {}
        self.tag, self.children = tag, []
        self.role = found.get("role", "")
        self.names = f"{found.get('class', '')} {found.get('id', '')}".split()
        # a class with a digit in it is most likely the page's own
        self.label = ".".join([tag, *sorted(n for n in found.get("class", "").split() if not any(map(str.isdigit, n)))])
        self.main = tag in ("article", "main") or self.role == "main" or found.get("itemprop") == "articlebody"
        self.holds_main = False  # whether an article or main element lies within
        if "hidden" in found:
            self.role = "hidden"

    def size(self) -> int:
        """Characters of text within."""
        n, todo = 0, [self]
        while todo:
            for c in todo.pop().children:
                if type(c) is str:
                    n += len(c)
                else:
                    todo.append(c)
        return n

    def kinds(self) -> set[str]:
        """What the element's classes and id call it: comments, whole (a single listed word), part (a listed word begins or ends a name) or inner (one stands in it)."""
        out = set()
        for name in self.names:
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if not words or not MODIFIERS.isdisjoint(words):
                continue
            ends = {words[0], words[-1]}
            if not COMMENTS.isdisjoint(ends):
                out.add("comments")
            if not TOKENS.isdisjoint(ends) or "header" in ends:
                out.add("header" if TOKENS.isdisjoint(ends) else "whole" if len(words) == 1 else "part")
            elif not TOKENS.isdisjoint(words) or "header" in words:
                out.add("inner")
        return out

    def foreign(self) -> bool:
        """Whether every class is one word for comments or adverts."""
        return bool(self.names) and all(n in COMMENTS or n in ADVERTS for n in self.names)

    def aside(self, within: bool, page: Node) -> bool:
        """Whether the element says that it isn't part of an article.

        Elements and roles say so unless an article lies within. Names of comments do so anywhere, also of and around articles. Other names do, unless
        the element holds most of the page, as a layout's does, or, but for adverts and notices, an article. Within an article a header is its own, containers are set
        aside by whole names or their ends, and anything else, a paragraph say, only if all its classes are words for comments or adverts.
        """
        kinds = self.kinds() if self.names else set()
        if "comments" in kinds and (self.main or self.tag in CONTAINERS or not within):
            return True
        if self.main:
            return False
        if (self.tag in ASIDE or self.role in ROLES or self.role == "hidden" or (self.tag == "header" and not within)) and not self.holds_main:
            return True
        if within:
            if self.tag not in CONTAINERS:
                return self.foreign()
            kinds -= {"header", "inner"}
        kinds.discard("comments")
        if not kinds or (self.holds_main and kinds.isdisjoint({"whole", "part"})):
            return False
        if self.holds_main and not any(not (ADVERTS | NOTICES).isdisjoint(re.split(r"[^a-z0-9]+", n)) for n in self.names):
            return False
        if "whole" in kinds and not self.holds_main:
            return True
        share = 5 if kinds == {"inner"} else 8  # tenths of the page's text that such a name may hold
        return 10 * self.size() <= share * page.size()


def parse(page: str) -> Node:
    """The tree of a page, with the usual repairs: implied ends, stray ends, cut-off tags."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    open_tags: dict[str, int] = {}

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close(names: set[str] | frozenset, walls: set[str] | frozenset = frozenset()) -> None:
        if not any(open_tags.get(t) for t in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for x in stack[i:]:
                    open_tags[x.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in walls:
                return

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            close({tag}, {"table"} if tag not in ("table", "body", "html") else frozenset())
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            close({"p"}, {"table", "button", "td", "th"})
        if tag in CLOSES:
            close(CLOSES[tag], WALLS[tag])
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if node.main:
            for x in reversed(stack):
                if x.holds_main:
                    break
                x.holds_main = True
        if tag in RAW:
            over = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(page[at : over.start() if over else n]))
            at = over.start() if over else n
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag == "br":
            stack[-1].children[-1] = "\n"
    return root


class Slot:
    """A node of a wrapper: an element's label or # for a text, and its children. Equal structures share a shape. In a page's
    tree, a # has the places of the page's blocks; in a wrapper, every node has a number."""

    __slots__ = ("label", "children", "shape", "blocks", "number")

    def __init__(self, label: str, children: list[Slot], blocks: tuple[int, ...] = ()):
        self.label, self.children, self.blocks, self.number = label, children, blocks, -1
        self.shape = xxhash.xxh3_64_intdigest(f"{label}({','.join([str(c.shape) for c in children])}")


def appended(into: list[Slot], slot: Slot) -> None:
    """Adds a slot; one that follows another of its label is merged with it."""
    if into and into[-1].label == slot.label:
        into[-1] = merge(into[-1], slot)
    else:
        into.append(slot)


def read(page: str | None) -> tuple[list[tuple[str, bool, bool, bool]], Slot]:
    """The blocks of a page in order, each with whether an element sets it aside, whether it is in an article and whether most of it
    are links; and the page's tree of slots."""
    root = parse(page or "")
    held: list[tuple[str, bool]] = []
    out: list[tuple[str, bool, bool, bool]] = []

    def flush(into: list[Slot], off: bool, main: bool) -> None:
        if held and (t := " ".join("".join([s for s, _ in held]).split())):
            linked = sum([len("".join(s.split())) for s, link in held if link])
            appended(into, Slot("#", [], (len(out),)))
            out.append((t, off, main, 2 * linked > len(t.replace(" ", ""))))
        held.clear()

    top: list[Slot] = []
    # of each open element: the rest of its children, the slots of the block it is in, off, main, link, and the slot list to add itself to
    stack = [(iter(root.children), top, False, False, False, None, "")]
    while stack:
        children, slots, off, main, link, outer, label = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            if outer is not None:  # a block ends, or what is set aside or an article does
                flush(slots, off, main)
                if outer is not slots:
                    appended(outer, Slot(label, slots))
        elif type(c) is str:
            held.append((c, link))
        else:
            inner = main or c.main
            away = off or (c.tag not in ("html", "body") and c.aside(inner, root))
            if away and not off and c.tag not in BLOCK and not c.holds_main:
                if c.tag not in RAW:  # a button, an inline advert: it doesn't divide its paragraph
                    held.append((" ", link))
            elif c.tag in BLOCK:
                flush(slots, off, main)
                stack.append((iter(c.children), [], away, inner, link or c.tag == "a", slots, c.label))
            elif away != off or inner != main:
                flush(slots, off, main)
                stack.append((iter(c.children), slots, away, inner, link or c.tag == "a", slots, ""))
            else:
                stack.append((iter(c.children), slots, off, main, link or c.tag == "a", None, ""))
    flush(top, False, False)
    return out, Slot("", top)


class Weights(dict):
    """The matches of two structures, by their shapes: worked out once, forgotten when too many."""

    def of(self, a: Slot, b: Slot) -> int:
        if a.label != b.label:
            return 0
        key = (a.shape, b.shape)
        if (n := self.get(key)) is None:
            n = matching(a, b)[0]
            if len(self) > 200_000:
                self.clear()
            self[key] = n
        return n


WEIGHTS = Weights()


def matching(a: Slot, b: Slot) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two trees of one label: the most nodes that match in order, and which children match.

    Equal structures at either end of the child lists match first; dynamic programming does what lies between, a row at a time
    and in halves, so that its memory is that of the lists.
    """
    x, y = a.children, b.children
    lo, end, least = 0, 0, min(len(x), len(y))
    while lo < least and x[lo].shape == y[lo].shape:
        lo += 1
    while end < least - lo and x[-1 - end].shape == y[-1 - end].shape:
        end += 1
    pairs = [(i, i) for i in range(lo)] + [(len(x) - i, len(y) - i) for i in range(end, 0, -1)]
    total = 1 + sum([WEIGHTS.of(x[i], y[j]) for i, j in pairs])
    p, q = x[lo : len(x) - end], y[lo : len(y) - end]
    if p and q:
        kinds = {c.shape: c for c in q}
        at = {s: k for k, s in enumerate(kinds)}
        places = np.array([at[c.shape] for c in q])
        rows: dict[int, np.ndarray] = {}

        def row(c: Slot) -> np.ndarray:
            if c.shape not in rows:
                rows[c.shape] = np.array([WEIGHTS.of(c, d) for d in kinds.values()])[places]
            return rows[c.shape]

        found = aligned([row(c) for c in p], 0, len(q))
        total += sum([int(row(p[i])[j]) for i, j in found])
        pairs += [(lo + i, lo + j) for i, j in found]
    return total, sorted(pairs)


def last_row(w: list[np.ndarray], a: int, b: int) -> np.ndarray:
    """The most weight of the rows against the first 0, 1, ... columns of [a, b)."""
    best = np.zeros(b - a + 1, np.int64)
    for r in w:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + r[a:b]))
    return best


def aligned(w: list[np.ndarray], a: int, b: int) -> list[tuple[int, int]]:
    """The pairs (row, column), both rising, of the most weight: rows are halved, and each half gets its columns of [a, b)."""
    out, todo = [], [(0, len(w), a, b)]
    while todo:
        i, j, a, b = todo.pop()
        if i == j or a == b:
            continue
        if j - i == 1:
            k = a + int(w[i][a:b].argmax())
            if w[i][k]:
                out.append((i, k))
            continue
        mid = (i + j) // 2
        after = last_row([r[::-1] for r in w[mid:j][::-1]], len(w[i]) - b, len(w[i]) - a)[::-1]
        cut = a + int((last_row(w[i:mid], a, b) + after).argmax())
        todo += [(i, mid, a, cut), (mid, j, cut, b)]
    return out


def merge(a: Slot, b: Slot) -> Slot:
    """One tree of two of one label: aligned slots are one, those of one side stay."""
    if a.shape == b.shape and not b.blocks and not a.children:
        return a
    out: list[Slot] = []
    i = j = 0
    pairs = [(k, k) for k in range(len(a.children))] if a.shape == b.shape else matching(a, b)[1]
    for x, y in [*pairs, (len(a.children), len(b.children))]:
        out += a.children[i:x] + b.children[j:y]
        if x < len(a.children) and y < len(b.children):
            out.append(merge(a.children[x], b.children[y]))
        i, j = x + 1, y + 1
    return Slot(a.label, out, a.blocks + b.blocks)


def with_classes(tree: Slot, known: frozenset[str]) -> Slot:
    """The tree without other classes than the known ones; siblings that are now alike are one slot."""
    children: list[Slot] = []
    for c in tree.children:
        appended(children, with_classes(c, known))
    tag, *names = tree.label.split(".")
    return Slot(".".join([tag, *[n for n in names if n in known]]), children, tree.blocks)


def classes_of(tree: Slot) -> frozenset[str]:
    """All classes of a tree."""
    out, todo = set(), [tree]
    while todo:
        node = todo.pop()
        out.update(node.label.split(".")[1:])
        todo += node.children
    return frozenset(out)


def flat(tree: Slot) -> str:
    """A tree as text: a line for each node, in order, with its depth and label. The blocks stay behind."""
    out, todo = [], [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        out.append(f"{depth} {node.label}")
        todo += [(c, depth + 1) for c in reversed(node.children)]
    return "\n".join(out)


def unflat(lines: str) -> Slot:
    """The tree of such a text; its nodes are numbered by their lines."""
    open_: list[tuple[str, list[Slot], int]] = []

    def shut(depth: int) -> None:
        while len(open_) > depth:
            label, children, number = open_.pop()
            slot = Slot(label, children)
            slot.number = number
            open_[-1][1].append(slot) if open_ else top.append(slot)

    top: list[Slot] = []
    for number, line in enumerate(lines.split("\n")):
        depth, _, label = line.partition(" ")
        shut(int(depth))
        open_.append((label, [], number))
    shut(0)
    return top[0]


def placed(page: Slot, wrapper: Slot) -> list[tuple[int, int]]:
    """(block, number of its slot) for all blocks of a page that align with a slot of the wrapper."""
    out, todo = [], [(page, wrapper)]
    while todo:
        a, b = todo.pop()
        out += [(k, b.number) for k in a.blocks]
        todo += [(a.children[i], b.children[j]) for i, j in matching(a, b)[1]]
    return out


class Placing(dict):
    """Slots of a page's blocks, by host: pages of one structure are aligned once, as long as they come together."""

    def of(self, host: str, lines: str, page: Slot) -> dict[int, int]:
        if host not in self:
            if len(self) > 500:
                self.clear()
            tree = unflat(lines)
            self[host] = tree, classes_of(tree)
        tree, known = self[host]
        return dict(placed(with_classes(page, known), tree))


def digest(text: str) -> int:
    """A text's hash as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def content(wrapper: Slot, varied: dict[int, int]) -> list[int]:
    """The numbers of the slots that hold content where pages mark no article: those of the smallest part of the wrapper with four
    fifths of the varying text, and of first headings on the way there. ``varied`` has the characters of each slot."""
    order, todo = [], [wrapper]
    while todo:
        order.append(node := todo.pop())
        todo += node.children
    held = {node.number: varied.get(node.number, 0) for node in order}
    for node in reversed(order):
        held[node.number] += sum([held[c.number] for c in node.children])
    heads, at = [], wrapper
    while most := [c for c in at.children if held[c.number] and 5 * held[c.number] >= 4 * held[at.number]]:
        beside = [c for c in at.children if c is not most[0]]
        while beside:
            c = beside.pop()
            if c.label.split(".")[0] == "h1":
                heads.append(c)
            beside += c.children
        at = most[0]
    out, todo = [], [at, *heads]
    while todo:
        node = todo.pop()
        if varied.get(node.number):
            out.append(node.number)
        todo += node.children
    return sorted(set(out))


def furniture(text: str, off: bool, main: bool, link: bool) -> bool:
    """Whether a constant block of an article is no part of its text."""
    words = re.findall(r"\w+", text[:80].lower())
    return link or (len(words) <= 6 and bool(words) and words[0] in FURNITURE)


def main_text(page: str | None, host: str = "", wrapper: str | None = None, template: frozenset = frozenset(), kept: frozenset = frozenset(), placing: Placing | None = None) -> str:
    """The text of a page: the blocks of its articles, or of the whole page if it has none, that nothing sets aside and that aren't
    template; without an article, blocks of the wrapper's content only. Within an article, template is only what looks like furniture: links, and
    short lines such as "Share this". Pages of which nothing else is left keep what is template."""
    blocks, tree = read(page)
    at = (placing or Placing()).of(host, wrapper, tree) if wrapper else {}
    within = any([main and not off for _, off, main, _ in blocks])
    mine = [k for k, (_, off, main, _) in enumerate(blocks) if not off and main >= within and (within or k not in at or at[k] in kept)]
    fresh = [k for k in mine if k not in at or (within and not furniture(*blocks[k])) or (at[k], digest(blocks[k][0])) not in template] if template else mine
    return "\n\n".join([blocks[k][0] for k in (fresh or (mine if within else []))])


def wrappers(pages: DataFrame, parts: int = 64, rare: float = 0.02) -> DataFrame:
    """(host, wrapper) from rows of host and html: structures are merged once each, ``parts`` at first for a host.

    A class that fewer than ``rare`` of a host's structures have, such as a tag's or an author's, doesn't tell slots apart: with it, nodes of different pages
    would never align, and the wrapper would grow with every page.
    """
    kind = "host string, tree string"

    def structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        seen: set[tuple[str, int]] = set()
        for b in batches:
            out = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = read(page)[1]
                if (host, tree.shape) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add((host, tree.shape))
                    out.append((host, flat(tree)))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], ["host", "tree"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        host, tree = None, None
        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h != host:
                    if tree:
                        yield row(host, tree)
                    host, tree = h, unflat(t)
                else:
                    tree = merge(tree, unflat(t))
        if tree:
            yield row(host, tree)

    def row(host: str, tree: Slot) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([flat(tree)])], ["host", "tree"])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        for b in batches:
            trees = [flat(with_classes(unflat(t), frozenset(known or ()))) for t, known in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.string())], ["host", "tree"])

    found = keep(pages.mapInArrow(structures, kind).distinct())
    words = F.array_distinct(F.flatten(F.transform(F.split("tree", "\n"), lambda line: F.slice(F.split(line, r"\."), 2, 1_000_000))))
    common = found.select("host", F.explode(words).alias("name")).groupBy("host", "name").agg(F.count("*").alias("n"))
    common = common.join(found.groupBy("host").agg(F.count("*").alias("of")), "host").filter((F.col("n") >= rare * F.col("of")) & ((F.col("n") > 1) | (F.col("of") == 1)))
    common = keep(common.groupBy("host").agg(F.collect_list("name").alias("known")))  # at most the classes of a page, divided by the share
    found = joined_by_host(found, common.withColumn("_all", F.to_json("known")), ["_all"], "left", salted_by=("tree",)).select("host", "tree", "known").mapInArrow(reduced, kind).distinct().withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(parts)))
    level = found.repartition("host", "part").sortWithinPartitions("host", "part", F.length("tree"), "tree")
    level = level.select(F.concat_ws("\n", "host", F.col("part").cast("string")).alias("host"), "tree").mapInArrow(merged, kind)
    level = level.select(F.substring_index("host", "\n", 1).alias("host"), "tree")
    return level.repartition("host").sortWithinPartitions("host", F.length("tree"), "tree").mapInArrow(merged, kind).withColumnRenamed("tree", "wrapper")


def joined_by_host(rows: DataFrame, table_: DataFrame, text_cols: list[str], how: str, salts: int = 64, most_bytes: int = 16 << 20, salted_by: tuple[str, ...] = ("page_id", "html")) -> DataFrame:
    """Joins rows with one row for each host: broadcast where that table is small; else a host, which may have a third of all pages, is
    dealt in ``salts`` parts, each with a copy of its row."""
    size = table_.agg(F.count("*"), F.coalesce(F.sum(sum([F.octet_length(F.col(c)) for c in text_cols], F.lit(0))), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS and size[1] <= most_bytes:
        return rows.join(F.broadcast(table_), "host", how)
    salted = table_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*salted_by), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], how).drop("salt")


def decided(pages: DataFrame, wrapper: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """(host, wrapper, template, kept): which texts of which slots are template, as alternating numbers and hashes, and which slots hold
    content. ``pages`` has host and html, ``counts`` the pages of each host."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        placing = Placing()
        for b in batches:
            out: list[tuple] = []
            for host, page, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found, tree = read(page)
                mine: dict[tuple[int, int], int] = {}
                for k, slot in placing.of(host, lines, tree).items():
                    text, off, _, link = found[k]
                    mine[slot, digest(text)] = 0 if off or link else len(text)
                out += [(host, slot, d, n) for (slot, d), n in mine.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64())], ["host", "slot", "d", "n"])

    each = joined_by_host(pages.select("page_id", "host", "html"), wrapper, ["wrapper"], "inner").select("host", "html", "wrapper").mapInArrow(blocks, "host string, slot int, d long, n long")
    each = each.groupBy("host", "slot", "d").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))
    each = with_key(each, counts, "host", "inner").withColumn("same", F.col("pages") >= share * F.col("of"))
    slots = each.groupBy("host", "slot").agg(F.sum(F.when(~F.col("same"), F.col("chars")).otherwise(0)).alias("varied"), F.collect_list(F.when(F.col("same"), F.col("d"))).alias("ds"))
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "varied", "ds")).alias("slots"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            template, kept = [], []
            for lines, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                template.append([x for r in found for d in sorted(r["ds"]) for x in (r["slot"], d)])
                kept.append(content(unflat(lines), {r["slot"]: r["varied"] for r in found}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(template, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int64()))], ["host", "wrapper", "template", "kept"])

    return wrapper.join(slots, "host").select("host", "wrapper", "slots").mapInArrow(chosen, "host string, wrapper string, template array<long>, kept array<long>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5, share: float = 0.9) -> DataFrame:
    """The main text of each page, from the whole html: page_id, url, text, n_chars.

    A host's wrapper needs ``least_pages`` different pages; a text is template where ``share`` of them have it in the same
    slot. Pages of other hosts are judged by their own elements alone. Character references are decoded, white space in a
    block is one space, and blocks are joined in page order by two line ends.

    A null or empty html gives an empty text; a null URL has no host. Rows that repeat are extracted alike and counted once
    in their host's wrapper. An empty table gives no rows. Other columns are not read. Elements may nest to any depth.
    """
    small_batches(pages.sparkSession, 4 << 20)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    seen = keep(rows.filter("host <> '' and html <> ''").select("page_id", "host", F.xxhash64("html").alias("h")).withColumn("row", F.struct("page_id", "h")))
    different = keep(seen.groupBy("host", "h").agg(F.min("row").alias("one"), F.count("*").alias("n")))
    many = keep(different.groupBy("host").agg(F.count("*").alias("of")).filter(F.col("of") >= least_pages))
    copies = keep(with_key(different.filter("n > 1"), many.select("host"), "host", "left_semi").select("host", "h", "one"))
    gone = keep(seen.join(F.broadcast(copies) if copies.count() <= 50_000 else copies, ["host", "h"]).filter("row != one").select("row").distinct())
    used = with_key(rows.filter("host <> '' and html <> ''"), many.select("host"), "host", "left_semi")
    if not gone.isEmpty():
        used = with_key(used.withColumn("row", F.struct("page_id", F.xxhash64("html").alias("h"))), gone, "row", "left_anti").drop("row")
    wrapper = keep(wrappers(used.select("host", "html")))
    wrapper = keep(decided(used, wrapper, many, share))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        placing, sets = Placing(), {}
        for b in batches:
            texts = []
            for page, h, lines, template, kept in zip(*[b.column(k).to_pylist() for k in range(2, 7)], strict=True):
                if lines and h not in sets:
                    if len(sets) > 500:
                        sets.clear()
                    sets[h] = frozenset(zip(template[::2], template[1::2], strict=True)), frozenset(kept)
                texts.append(main_text(page, h, lines, *sets[h], placing) if lines else main_text(page))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = joined_by_host(rows, wrapper.withColumn("_all", F.to_json(F.struct("template", "kept"))), ["wrapper", "_all"], "left")
    return joined.select("page_id", "url", "html", "host", "wrapper", "template", "kept").mapInArrow(cut, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all pages."""
    return extract(table(spark, sf_dir, "pages"))
