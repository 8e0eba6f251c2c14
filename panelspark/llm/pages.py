"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree of hidden labels (content, boilerplate, or a frame around both).  Each edge has a parent-child potential
and each node an evidence potential over its tag, its class and id words, its text length, its share of link text and
its punctuation.  One upward and one downward pass of sum-product messages give the exact marginals; text under nodes
with a content marginal of a half or more is the main text.  Potentials are smoothed counts over labelled pages: a few
labelled by hand (below) and a bounded sample of given pages labelled by their own article markup.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Pages used to fit the potentials beside the ones labelled by hand.
TRAINING_PAGES = 400
HAND_WEIGHT = 20.0

# Kinds of elements.
RAW = ("script", "style", "template", "svg", "iframe", "noscript", "object", "textarea", "title")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCK = set("""address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
head header hgroup html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul""".split())
HIDDEN = set("head form select option button fieldset legend label menu dialog".split())
CLOSES_P = BLOCK - set("option label button legend summary".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Without an end tag these are read on as markup; of the others the rest of the page is content.
OPEN_ENDED = set("template svg iframe noscript object".split())
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")

# Pages labelled by hand; an element with data-y carries its label, which its descendants take over.
HAND = (
    '<body><nav data-y=0 class="menu main-nav"><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><main data-y=1><h1>A title</h1><p>A first paragraph, with a longer text.</p><p>Another one, which ends here.</p></main><footer data-y=0><p>All rights reserved.</p></footer></body>',
    '<body><header data-y=0 class="site-header"><h1>Daily</h1><p>Your paper.</p></header><div class="content" data-y=1><h2>Title</h2><p>Some sentences of text. And more of it.</p><ul><li>One point.</li><li>Another point, longer.</li></ul></div><aside data-y=0 class="sidebar"><h3>Related</h3><p>Read this too.</p><ul><li><a>Link</a></li></ul></aside></body>',
    '<body><div class="ad" data-y=0>Buy this now.</div><article data-y=1><h1>Title</h1><p>The text of an article goes on for long.</p><blockquote><p>A quotation.</p></blockquote><div class="ad advert" data-y=0>Buy more.</div><p>The end.</p></article><div class="comments" data-y=0 id="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much.</p></div></div></body>',
    '<body><div class="cookie notice banner" data-y=0><p>We use cookies on this site.</p></div><section class="post entry" data-y=1><h1>Title</h1><p>Text of a post, with several words.</p><pre>code here</pre><table><tr><td>1</td><td>2</td></tr></table></section><section class="reader-comments discussion" data-y=0><p>First comment, not so short.</p></section></body>',
    '<body><div id="sidebar" class="widget related promo" data-y=0><p>More stories.</p></div><div id="main" class="article-body text" data-y=1><p>Text in the main part of the page.</p><figure><figcaption>A picture of it.</figcaption></figure><h2>Part</h2><p>More text here.</p></div><div id="footer" class="copyright legal" data-y=0>Company, 2020.</div></body>',
    '<body><div class="header top masthead" data-y=0><p>Site name</p></div><div class="breadcrumb navigation menu" data-y=0><a>Home</a> <a>Sports</a></div><article data-y=1><p>The report. It is long, and it goes on.</p><section><h2>More</h2><p>Text again.</p><dl><dt>Term</dt><dd>Meaning of it.</dd></dl></section><aside class="newsletter subscribe share social" data-y=0><p>Sign up here.</p></aside></article></body>',
    '<body><div class="alert warning message" data-y=0>This site moves soon.</div><article data-y=1><header><h1>Title</h1></header><p>Article text with words.</p><footer data-y=0>Posted by someone.</footer></article><div class="sponsored advertisement sponsor ads" data-y=0><p>A product for you.</p></div><div class="respond replies" data-y=0><p>Leave a reply.</p></div></body>',
    '<body><article data-y=1><h1>Title</h1><p>What happened, in some words. And in some more.</p><div class="ad" data-y=0><p>Buy this thing, it is cheap and good.</p></div><p>The text goes on here.</p><ul><li>One thing to know.</li><li>Another thing.</li></ul><section class="comments" data-y=0><h2>Comments</h2><div class="comment"><p>A reader wrote this, with some words.</p></div></section></article></body>',
    '<body><main><article class="post" data-y=1><h1>Title</h1><p>The main story of the page, which is long.</p><ol><li>First.</li><li>Second, with words.</li></ol><p>It has a last part.</p></article><article class="related teaser" data-y=0><h2>Another story</h2><p>Read about it there, it is of interest too.</p></article><section class="comment-list discussion" data-y=0><div class="comment"><p>I do not agree with this, sorry.</p></div></section></main></body>',
)

# Class and id words that mark boilerplate inside an article.
SIDE_WORDS = set("ad ads advert advertisement sponsor sponsored promo comment comments respond replies discussion related share social newsletter subscribe cookie banner widget".split())


class Scanner:
    """Tags of a page in order, in time linear in its length.

    A tag ends at the first ``>`` outside quotes, or at the first one where no quote closes before the page does.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = {q: html.rfind(q) for q in "\"'>"}
        self.dead: set[int] = set()  # opening quotes from which no ``>`` outside quotes is reached
        self.without_end: set[str] = set()

    def _tag_end(self, at: int) -> int:
        """The place after the tag whose name ends at ``at``; there is a ``>`` beyond it."""
        opened, k = [], at
        while (m := STOP.search(self.html, k)) is not None:
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead or m.start() >= self.last[m[0]]:
                break
            opened.append(m.start())
            k = self.html.index(m[0], m.end()) + 1
        self.dead.update(opened)
        return self.html.index(">", at) + 1

    def _content_end(self, name: str, at: int) -> int:
        """The place after the content of a raw element that begins at ``at``."""
        if name not in self.without_end:
            if m := re.compile(rf"</{name}(?:\s[^>]*)?>", re.I).search(self.html, at):
                return m.end()
            self.without_end.add(name)
        return at if name in OPEN_ENDED else len(self.html)

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(start, end, closing, name, attributes); the name is empty for what holds no element and no text."""
        html, at = self.html, 0
        while (i := html.find("<", at)) >= 0:
            if html.startswith("<!--", i):
                e = html.find("-->", i + 4)
                at = e + 3 if e >= 0 else len(html)
                yield i, at, False, "", ""
                continue
            if i > self.last[">"]:
                return
            if html[i + 1:i + 2] in ("!", "?"):
                at = html.index(">", i) + 1
                yield i, at, False, "", ""
                continue
            m = NAME.match(html, i)
            if m is None or m.end() > self.last[">"]:
                at = i + 1
                continue
            name = m[2].lower()
            at = self._tag_end(m.end())
            if name in RAW and not m[1]:
                if not (name == "svg" and html[at - 2] == "/"):
                    at = self._content_end(name, at)
                yield i, at, False, "", ""
            else:
                yield i, at, bool(m[1]), name, html[m.end():at - 1]


class Node:
    __slots__ = ("tag", "parent", "names", "hand", "chars", "links", "stops", "up")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...], hand: int | None) -> None:
        self.tag, self.parent, self.names, self.hand = tag, parent, names, hand
        self.chars = self.links = self.stops = 0


def parsed(html: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Block elements in document order (the first is the root) and the text pieces under them; None marks a break."""
    nodes, pieces = [Node("html", -1, (), None)], []
    stack: list[tuple[str, int]] = [("html", 0)]
    anchors, at = 0, 0

    def text(raw: str) -> None:
        if raw:
            t = unescape(raw) if "&" in raw else raw
            k = stack[-1][1]
            pieces.append((k, t))
            size = len(t.strip())
            nodes[k].chars += size
            nodes[k].links += size if anchors else 0
            nodes[k].stops += t.count(".") + t.count(",")

    def pop(upto: int) -> None:
        nonlocal anchors
        while len(stack) > upto:
            tag, _ = stack.pop()
            anchors -= tag == "a"
            if tag in BLOCK:
                pieces.append((stack[-1][1], None))

    for start, end, closing, tag, attributes in Scanner(html):
        text(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if stack[i][0] in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pieces.append((stack[-1][1], None))
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SIBLINGS[tag]:
                    pop(i)
                    if tag != "tr":
                        break
                elif stack[i][0] in HOLDS[tag]:
                    break
        if tag in BLOCK:
            pieces.append((stack[-1][1], None))
            names = tuple(WORDS.findall(" ".join(a or b or c for a, b, c in NAMED.findall(attributes)).lower())) if attributes else ()
            hand = re.search(r"data-y=(\d)", attributes) if "data-y=" in attributes else None
            nodes.append(Node(tag, stack[-1][1], names, int(hand[1]) if hand else None))
            stack.append((tag, len(nodes) - 1))
        else:
            anchors += tag == "a"
            stack.append((tag, stack[-1][1]))
    text(html[at:])
    return nodes, pieces


def evidence(n: Node) -> list[str]:
    """Features of a node; those never seen in training say nothing."""
    size = "none" if n.chars == 0 else "short" if n.chars < 25 else "some" if n.chars < 120 else "long"
    linked = " of links" if 2 * n.links > n.chars else ""  # a list of links is not a list of points
    out = ["tag " + n.tag + linked, "size " + size, *("name " + x for x in set(n.names))]
    if n.tag not in ("body", "main") and not SIDE_WORDS.isdisjoint(n.names):  # one feature for all such words, as each alone is rare
        out.append("side")
    if n.chars:
        out += ["link " + str(min(3, 4 * n.links // n.chars)), "stop " + str(min(3, n.stops))]
    return out


#: Labels: boilerplate, content, and frames (elements around both).
BOILER, CONTENT, FRAME = 0, 1, 2
LABELS = (BOILER, CONTENT, FRAME)


class Model:
    """Potentials: ``edge[parent label][child label]``, ``root[label]``, and per feature its likelihood under each label."""

    def __init__(self, pages: Iterable[tuple[list[Node], list[int], float]]) -> None:
        edge, root, count, total = [[0.1] * 3 for _ in LABELS], [0.1] * 3, [Counter() for _ in LABELS], [1.0] * 3
        for nodes, labels, weight in pages:
            root[labels[0]] += weight
            for n, y in zip(nodes, labels):
                total[y] += weight
                for f in evidence(n):
                    count[y][f] += weight
                if n.parent >= 0:
                    edge[labels[n.parent]][y] += weight
        self.edge = [[x / sum(row) for x in row] for row in edge]
        self.root = [x / sum(root) for x in root]
        self.log = {f: tuple(math.log((count[y][f] + 0.5) / (total[y] + 1)) for y in LABELS) for f in set().union(*count)}

    def _potential(self, n: Node) -> list[float]:
        s = [0.0, 0.0, 0.0] if n.tag not in HIDDEN else [0.0, -30.0, -30.0]
        for f in evidence(n):
            if w := self.log.get(f):
                for y in LABELS:
                    s[y] += w[y]
        top = max(s)
        return [math.exp(max(-60.0, x - top)) for x in s]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node by sum-product; parents come before children."""
        own, e = [self._potential(x) for x in nodes], self.edge
        msg: list[list[float]] = [[1.0] * 3] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a = own[i]
            msg[i] = up = [r[0] * a[0] + r[1] * a[1] + r[2] * a[2] for r in e]
            p = own[nodes[i].parent]
            top = max(p[0] * up[0], p[1] * up[1], p[2] * up[2])
            for y in LABELS:
                p[y] = max(p[y] * up[y] / top, 1e-200)
        down, out = [self.root] * len(nodes), []
        for i, x in enumerate(nodes):
            if i:
                # belief of the parent without what this child told it
                p = x.parent
                b = [down[p][y] * own[p][y] / msg[i][y] for y in LABELS]
                top = sum(b)
                down[i] = [sum(b[z] * e[z][y] for z in LABELS) / top for y in LABELS]
            b = [down[i][y] * own[i][y] for y in LABELS]
            out.append(b[CONTENT] / sum(b))
        return out


def hand_labels(nodes: list[Node]) -> list[int]:
    """A labelled element's label holds for its descendants; elements above labelled ones are frames."""
    out: list[int] = []
    for n in nodes:
        out.append(n.hand if n.hand is not None else FRAME if n.parent < 0 else out[n.parent])
    return out


def markup_labels(nodes: list[Node]) -> list[int] | None:
    """Labels by a page's only article element, without its asides and parts that SIDE_WORDS name; None if there is not one."""
    main = [i for i, n in enumerate(nodes) if n.tag == "article"]
    if len(main) != 1:
        return None
    out, frames, i = [], set(), nodes[main[0]].parent
    while i >= 0:
        frames.add(i)
        i = nodes[i].parent
    for i, n in enumerate(nodes):
        inside = i == main[0] or (n.parent >= 0 and out[n.parent] == CONTENT)
        out.append(FRAME if i in frames else CONTENT if inside and n.tag not in ("nav", "aside", "footer") and n.tag not in HIDDEN and (i == main[0] or SIDE_WORDS.isdisjoint(n.names)) else BOILER)
    return out


def fitted(pages: Iterable[str] = ()) -> Model:
    """Potentials from the pages labelled by hand and from ``pages`` labelled by their markup."""
    rows = []
    for h in HAND:
        nodes, _ = parsed(h)
        rows.append((nodes, hand_labels(nodes), HAND_WEIGHT))
    given = [(nodes, labels) for h in pages for nodes in [parsed(h)[0]] if (labels := markup_labels(nodes))]
    # together the given pages weigh no more than those labelled by hand, which alone hold what markup doesn't tell
    weight = min(1.0, HAND_WEIGHT * len(HAND) / max(1, len(given)))
    return Model(rows + [(nodes, labels, weight) for nodes, labels in given])


def main_text(html: str, model: Model) -> str:
    nodes, pieces = parsed(html)
    good = [p >= 0.5 for p in model.marginals(nodes)]
    blocks, now = [], []
    for k, t in pieces:
        if t is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif good[k]:
            now.append(t)
    blocks.append("".join(now))
    return " ".join(x for b in blocks if (x := " ".join(b.split())))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (clashing names get an underscore).

    The potentials are fitted once, on the driver, from at most TRAINING_PAGES pages taken by hash; every whole page is
    then read in its own task, nothing is shuffled.  Null and empty pages give an empty text; repeated rows stay.
    """
    # the least hashes first, then one page for each: whole pages beyond the sample are not sent anywhere
    rows = pages.select(F.col(html).alias("_html")).where((F.length(html) < 200_000) & (F.length(html) > 0)).withColumn("_h", F.xxhash64("_html", F.lit(5)))
    least = [r[0] for r in rows.select("_h").distinct().orderBy("_h").limit(TRAINING_PAGES).collect()]
    sample = rows.where(F.col("_h") <= least[-1]).groupBy("_h").agg(F.min("_html").alias("_html")).orderBy("_h").collect() if least else []
    model = fitted(r["_html"] for r in sample)
    at = pages.columns.index(html)
    text, chars = fresh(pages.drop(html), "text", "n_chars")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h, model) if h else "" for h in b.column(at).to_pylist()]
            names = [n for n in b.schema.names if n != html]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*names, text, chars])

    return pages.mapInArrow(run, ", ".join([*fields, f"`{text}` string", f"`{chars}` bigint"]))
