"""Main text of web pages: flat text blocks, judged with their neighbours by a decision tree.

A page is cut at block-level tags into text blocks. Each has a row of features: its words, the share of them in links, the same for the
block before and after, whether it lies in a container that names itself as navigation, advert, form, comments and so on, whether it
lies in the article element (or the page has none; an article or main element in a page-wide wrapper counts, whatever the wrapper is named),
whether it is a heading and whether it ends like a sentence. A decision tree
trained on the small labelled pages below (``EXAMPLES``; blocks marked ``data-main`` are main text) classifies the rows; the tree
is fitted once on the driver and travels with the task.

The text of a page is its main blocks in order, joined by one space; character references are decoded and white space inside a
block becomes one space. A null page is empty. Pages without main blocks give the empty string. Repeated rows give
repeated results; other columns are ignored. Unclosed elements and comments end with the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML, and words by which containers name themselves.
SKIPPED = "script|style|noscript|template|title|svg|annotation|annotation-xml|iframe|object|canvas|audio|video|textarea|select|button"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
                   "mtable mtext munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
BOILER_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead topbar header footer sidebar aside widget widgets rail cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login register paywall share sharing social related recommended recommendations trending popular comment comments commentlist "
    "disqus reply replies respond discussion search form pagination pager copyright legal disclaimer toolbar skip hidden tags").split())
#: Names of page-wide wrappers as well as of boilerplate; such a wrapper is judged by what it holds.
SOFT_WORDS = frozenset("sidebar nav navbar navigation menu header footer topbar toolbar rail aside banner form search widget widgets hidden modal overlay".split())
#: Names that tell boilerplate on a paragraph or the like too; others only tell it on containers.
PARAGRAPH_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription share sharing comment comments "
    "commentlist breadcrumb breadcrumbs pagination pager").split())
PARAGRAPH_TAGS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption td th address".split())
#: First words of names that tell about the whole, as in ``has-sidebar``.
ABOUT = frozenset("has with no without is not".split())
#: Names that are headings of an article as well.
SECTION_WORDS = frozenset("header discussion disclaimer legal copyright notice notices related social".split())
#: What an article or main element inside does not lift.
FIRM_TAGS = BOILER_TAGS - {"form", "fieldset"}
FIRM_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
ARTICLE_WORDS = frozenset("article content post entry main story body text maincontent".split())
CLOSED_BY_SAME = {"p": "", "li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table tr", "th": "table tr", "option": ""}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>|<({SKIPPED})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z0-9]+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    boiler: bool
    article: bool
    heading: bool
    marked: bool


class _Open(NamedTuple):
    tag: str
    boiler: bool
    article: bool
    marked: bool
    firm: bool = False  # boiler whatever it holds
    wrapper: int = -1  # number of the outermost container that is boiler
    lifted: bool = False  # in an article or main element below a wrapper that is not firm
    sure: bool = False  # it is a main element
    inner: bool = False  # boiler, from the lifting element on
    soft: bool = False  # the outermost container that is boiler has only a soft name
    below: bool = False  # boiler, from within the outermost container that is


def _container(tag: str, attributes: str, outer: _Open, number: int = -1) -> _Open:
    """State inside an element: what its name and attributes say, and what it inherits."""
    boiler, article, marked, firm, soft = False, outer.article, outer.marked, False, True
    own = tag if tag in ("article", "main") else ""
    article = article or bool(own)
    if tag in BOILER_TAGS or (tag == "header" and not article):
        boiler, firm = True, tag in FIRM_TAGS or tag == "header"
    if attributes and not attributes.isspace():
        values = {k.lower(): entities.unescape(a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attributes)}
        marked = marked or "data-main" in values
        if values.get("role") in BOILER_ROLES or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
            boiler = firm = True
        if values.get("role") in ("main", "article"):
            article, own = True, own or values["role"]
        if tag not in ("html", "body", "main"):
            tokens = [NAME.findall(t) for t in f"{values.get('class', '')} {values.get('id', '')}".split()]
            names = {w for t in tokens if t and t[0] not in ABOUT for w in t}
            told = names & (PARAGRAPH_WORDS if tag in PARAGRAPH_TAGS else BOILER_WORDS)
            if told and not (names & ARTICLE_WORDS and not names & {"comment", "comments"}) and not (article and told <= (SECTION_WORDS if tag == "section" else {"header"})):
                boiler, firm, soft = True, firm or bool(told & FIRM_WORDS), told <= SOFT_WORDS
            elif not told and names & ARTICLE_WORDS:
                own = own or "content"
    lifted, sure, inner = outer.lifted, outer.sure, outer.inner or boiler
    if own and outer.boiler and not outer.firm and (not lifted or own == "main" and not sure):
        lifted, sure, inner = True, own == "main", boiler
    wrapper, soft = (number, soft and not firm) if boiler and not outer.boiler else (outer.wrapper, outer.soft)
    return _Open(tag, outer.boiler or boiler, article, marked, outer.firm or firm, wrapper, lifted, sure, inner, soft, outer.below or (boiler and outer.boiler))


def _lift(rows: list[tuple[Block, _Open]]) -> list[Block]:
    """Blocks; those in a page-wide wrapper are judged by what lies between them and the article, the content element or the wrapper.

    A wrapper is page-wide if it holds a main element, or at least half of the page's words and no article lies outside of boiler. One without an
    article or content element must have a soft name (or be a form) and hold a heading.
    """
    if not any(o.wrapper >= 0 and not o.firm for _, o in rows):
        return [b for b, _ in rows]
    words: dict[int, int] = {}
    for b, o in rows:
        words[o.wrapper] = words.get(o.wrapper, 0) + b.words
    half, free = sum(words.values()) / 2, not any(b.article and not b.boiler for b, _ in rows)
    wide = {o.wrapper for _, o in rows if o.lifted and (o.sure or (free and words[o.wrapper] >= half))}
    plain = {o.wrapper for b, o in rows if o.soft and b.heading and not o.below and free and words[o.wrapper] >= half} - wide
    judged = lambda b, o: b._replace(boiler=o.inner) if o.lifted and o.wrapper in wide else b._replace(boiler=o.below) if o.wrapper in plain else b
    return [judged(b, o) for b, o in rows]


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    root = _Open("", False, False, False)
    stack, out, parts, link, heading = [root], [], [], 0, False

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(entities.unescape("".join(x for x, _ in parts)).split())
            if text:
                linked = sum(len(entities.unescape(x).split()) for x, in_link in parts if in_link)
                top = stack[-1]
                out.append((Block(text, len(text.split()), linked, top.boiler, top.article, heading, top.marked), top))
            parts = []

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], link > 0))
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                parts.append((" ", False)) if m[1].lower() in ("button", "select", "textarea") else None
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            continue  # it stays in its block, whatever its name
        if tag in ("br", "mtr", "mtd"):
            parts.append((" ", False))
            continue
        flush()
        link = 0 if tag not in INLINE else link
        if closing:
            names = [x.tag for x in stack]
            if tag in names[1:]:
                del stack[len(names) - 1 - names[::-1].index(tag) :]
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = False
            continue
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in CLOSED_BY_SAME or any(x.tag == "p" for x in stack[-2:]):
            ends = ("p",) if tag not in CLOSED_BY_SAME else (tag, "p") if tag not in ("dt", "dd", "td", "th") else ("dt", "dd", "p") if tag in ("dt", "dd") else ("td", "th", "p")
            limit = CLOSED_BY_SAME.get(tag, "").split()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in limit or stack[k].tag in ("div", "section", "article", "main", "body", "nav", "aside", "footer", "header", "form"):
                    break
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(_container(tag, m[4], stack[-1], m.start()))
    if at < len(page):
        parts.append((page[at:], link > 0))
    flush()
    return _lift(out)


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "place", "heading", "sentence")


def features(rows: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block. ``place``: 1 in the article, 0 if the page has none, -1 outside it."""
    out = np.zeros((len(rows), len(FEATURES)))
    if rows:
        words = np.array([b.words for b in rows], float)
        links = np.array([b.linked for b in rows]) / words
        out[:, 0], out[:, 1] = words, links
        out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = words[:-1], links[:-1], words[1:], links[1:]
        has = any(b.article and not b.boiler for b in rows)
        out[:, 6] = [b.boiler for b in rows]
        out[:, 7] = [1 if b.article else -1 if has else 0 for b in rows]
        out[:, 8] = [b.heading for b in rows]
        out[:, 9] = [b.text.rstrip("\"')]»”’")[-1:] in (".", "!", "?", "…", ":") for b in rows]
    return out


_LONG = "The river rose in the night and by the morning the lower fields lay under water as far as the old mill."
_MORE = "Nobody had seen such a flood since the bridge was built, and the elders spoke of it for years to come. It took a week to dry."
EXAMPLES = (
    f"<html><body><header><h1>Valley News</h1><a href=/>Home</a></header><nav><ul><li><a href=1>Weather</a><li><a href=2>Sport today</a></ul></nav><article data-main><h1>Flood</h1><p>{_LONG}</p><p>So it was.</p><p>{_MORE}</p>"
    f"<p><a href=3>See the map of the valley</a></p><p>Two.</p><ul><li>first boat</li><li>second boat</li></ul></article><aside><h2>Most read</h2><p>{_LONG}</p></aside><footer>Copyright Valley News. All rights reserved.</footer></body></html>",
    f"<body><div class=menu><a href=1>Start</a> <a href=2>Contact us</a></div><div class='ad'>Buy two boats and pay for one.</div><main data-main><h2>Report</h2><p>{_MORE}</p><p>Yes.</p><p>{_LONG}</p></main><section id=comments><h3>2 comments</h3>"
    f"<p>{_LONG}</p><p>I agree.</p></section><form>Your name <input> Your message to the editor, please be kind to others.</form></body>",
    f"<body><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>About</a></div><div>Valley News</div><div data-main><h1>Flood in the valley</h1></div><div data-main>{_LONG} {_MORE}</div><div data-main>{_MORE}</div><div data-main>So it was, they said.</div>"
    f"<div data-main>{_LONG}</div><div><a href=4>Next</a></div><div><a href=6>Read our story on the dam.</a></div><div><a href=7>Ten boats you will want to own.</a> Yes.</div><div><a href=5>More news</a> <a href=6>from the valley and the hills</a></div><div>All rights reserved</div></body>",
    f"<body><p>Log in</p><p><a href=9>Register</a></p><p data-main>{_LONG}</p><p data-main>{_MORE}</p><p data-main>It <a href=1>rained</a> again that night and the road was closed.</p><p data-main>{_LONG}</p><p><a href=2>Back to the top of this page</a></p><p>Page 1 of 3</p></body>",
    f"<body><div class=cookie-notice><p>{_MORE}</p><p>We use cookies.</p></div><article data-main><header><h1>Title of it</h1><p>By a reporter</p></header><p>{_LONG}</p><p>Les.</p><ul><li><a href=1>Sources</a></li><li><a href=2>Letters of the time</a></li></ul></article><p>{_LONG}</p><div class=footer><p>{_MORE}</p></div></body>",
    f"<body><div class=sidebar><p>{_LONG}</p><p>{_MORE}</p></div><div class=notice>{_LONG}</div><div data-main><h1>Flood</h1></div><div data-main>{_LONG} {_MORE}</div><div data-main>{_MORE}</div><div class=promo>{_LONG} {_MORE}</div>"
    f"<div data-main>{_LONG}</div><div class=comments><p>{_MORE}</p><p>{_LONG}</p><p>True.</p></div><div class=related><a href=1>{_LONG}</a></div></body>",
    f"<body><article><h1 data-main>Flood</h1><p data-main>{_LONG}</p><div class=ad>{_LONG}</div><p data-main>{_MORE}</p><aside><p>{_MORE}</p><p>Read on.</p></aside><p data-main>Les.</p><p data-main><a href=7>The first map</a></p><p data-main><a href=8>The second map, drawn after the flood.</a></p><form><p>{_LONG}</p><p>Send it.</p></form>"
    f"<section class=comments><p>{_MORE}</p><p>{_LONG}</p><p>I agree with all of it.</p></section></article></body>",
    f"<body><div id=page class='site has-sidebar'><header><svg class='i'/><a href=/>Home</a></header><article data-main><h1>Flood</h1><p>{_LONG}</p><p>So it was.</p><p>{_MORE}</p></article><aside><p>{_LONG}</p></aside><footer>All rights reserved.</footer></div></body>",
    f"<body><form id=aspnetForm><div class=menu><a href=1>Start</a></div><main data-main><h2>Report</h2><p>{_MORE}</p><p>Of <math><mi>x</mi><mo>=</mo><mn>2</mn></math> boats.</p></main><div class=footer><p>{_LONG}</p></div></form></body>",
)


class Node(NamedTuple):
    feature: int  # -1: a leaf
    bound: float
    low: object
    high: object
    value: bool


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Node:
    """Binary decision tree by the Gini index; of equally good splits the first feature and the lowest bound win."""
    share = float(y.mean())
    leaf = Node(-1, 0.0, None, None, share > 0.5)
    if depth == 0 or share in (0.0, 1.0):
        return leaf
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= bound
            a, b = y[low].mean(), y[~low].mean()
            cost = low.sum() * a * (1 - a) + (~low).sum() * b * (1 - b)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(bound), low)
    if best is None:
        return leaf
    _, f, bound, low = best
    return Node(f, bound, fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1), leaf.value)


def apply_tree(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0 or not len(x):
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.bound
    out = np.empty(len(x), bool)
    out[low], out[~low] = apply_tree(node.low, x[low]), apply_tree(node.high, x[~low])
    return out


def labelled(examples: tuple[str, ...] = EXAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the example pages."""
    pages = [blocks(e) for e in examples]
    return np.concatenate([features(p) for p in pages]), np.array([b.marked for p in pages for b in p])


def main_text(page: str, tree: Node) -> str:
    rows = blocks(page)
    return " ".join(b.text for b, keep in zip(rows, apply_tree(tree, features(rows))) if keep)


def extract(pages: DataFrame, examples: tuple[str, ...] = EXAMPLES, payload: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    tree = fit_tree(*labelled(examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(page or "", tree) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(payload).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
