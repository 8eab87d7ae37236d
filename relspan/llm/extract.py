"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page is cut at block-level tags into flat blocks. Each block is described by its own word count and link density, by those of
the blocks before and after, and by two hints of the elements around it: how strongly they name themselves boilerplate (an
element like nav, a class like "ad" or "comments"), and whether they name themselves main content. A decision tree, trained on the blocks of
the few labelled pages of LABELLED, keeps or drops it. The hints are features like the others: named blocks can be text and unnamed ones boilerplate.

Defined cases: null and empty html give the empty text; markup that is cut off or not closed is read as far as it
goes; a quote that no white space, slash or > follows doesn't end a value, and a tag whose quotes don't pair ends at its first >; elements that
aren't displayed (hidden, display: none) have no text; rows that repeat are extracted each; other columns are ignored. Time is linear in the page's
length, however deep its elements nest.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm.common import python_ready

#: Elements of which no text is shown, void elements, elements that end a block, and those that hold no main text.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "title", "textarea", "select", "button", "datalist"}
RAW = r"script|style|textarea|title|noscript|iframe|template"
FOREIGN = {"svg", "math"}  # in these a slash closes an element, and a block of HTML ends them
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "ul", "button"}
#: What a new block ends, if it is the block around: an open paragraph, and an item of the same list or row.
ENDED = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
#: Boilerplate unless the page itself stands in it; a word of main content outside speaks against that as MAIN_WEIGHT words do.
FORMS, MAIN_WEIGHT = {"form", "fieldset"}, 10
#: Words in class, id and role that name what an element is for; those of the second kind name text as well.
BOILER_WORDS = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|paywall|nav|navi\w*|navbar|menu\w*|breadcrumb\w*|crumbs?|pagination|pager|sidebar\w*|aside|widget\w*|related|recommend\w*|trending|share|sharing|social\w*|footer\w*|alertdialog|masthead|topbar|toolbar|complementary|contentinfo|navigation|comment\w*|replies|disqus\w*|toc)"
)
SOFT_WORDS = re.compile(r"(?:side|rail|popular|follow|foot|copyright|legal|disclaimer|skip|search\w*|respond|reply|discussion|reactions?|tags|bio|byline)")
SOFT = 0.6
#: Words that say nothing by themselves, and those of main content.
NEUTRAL = {"container", "wrapper", "wrap", "box", "block", "area", "section", "list", "item", "items", "inner", "outer", "left", "right", "top", "bottom", "bar", "group", "row", "col", "column", "panel", "holder", "unit", "slot", "module", "text", "body", "content", "contents", "main", "primary", "secondary", "global", "site", "page", "desktop", "mobile", "js", "is", "to", "link", "links", "icon", "btn", "buttons", "form", "thread", "title", "posts", "articles", "stories", "author"}
MAIN_WORDS = {"article", "post", "entry", "story"}
MAIN_NAMES = re.compile(r"(?:article\w*|main|content|main-?content|body-?text)", re.I)
#: What stands beside or without something isn't that thing.
LAYOUT_NAMES = re.compile(r"(?:^|[-_])(?:has|with|no|without|hide|show)[-_]", re.I)
TOP_WORDS = {"header", "banner"}  # boilerplate outside main content

_QUOTED = r"\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)"
_ATTRS = rf"(?:[^>\"']|{_QUOTED})*+(?=>|\Z)|[^>]*"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:{_ATTRS})(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[(?:[^\]>]|\](?!\]>))*+(?:\]\]>|>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>{_ATTRS})(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|href)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    named: float  # as boilerplate, 0 to 1
    main: bool


class _Open(NamedTuple):
    """An open element, with what it and all around it say together."""

    name: str
    block: int  # place in the stack of the nearest block element
    named: float
    apart: float  # the same without what forms say
    main: bool
    hidden: bool
    link: bool
    form: int  # number of the nearest form that may hold the page itself, or 0
    foreign: bool


@lru_cache(4096)
def _token(token: str, in_main: bool) -> tuple[float, bool]:
    """How far a class, id or role names boilerplate, and whether it names main content. In a compound the last word counts twice."""
    if LAYOUT_NAMES.search(token):
        return 0.0, False
    parts = [p.lower() for p in _PARTS.split(token) if p and not p.isdigit()]
    telling = [p for p in parts if p not in NEUTRAL]
    if len(telling) > 1:  # the header of something is a part of it
        telling = [p for p in telling if p not in TOP_WORDS]
    score = total = own = 0.0
    for k, p in enumerate(telling):
        weight = 1 + (k == len(telling) - 1)
        total += weight
        own += weight * (p in MAIN_WORDS)
        score += weight * (1.0 if BOILER_WORDS.fullmatch(p) or (p in TOP_WORDS and not in_main) else SOFT if SOFT_WORDS.fullmatch(p) else 0.0)
    return score / total if total else 0.0, bool(MAIN_NAMES.fullmatch(token)) or 2 * own > total


def _element(name: str, attr: str, in_main: bool) -> tuple[float, bool, bool, bool]:
    """How far an element names itself boilerplate, whether it is main content, whether it isn't shown, and whether it has a target."""
    named, main, hidden, target = float(name in BOILER or (name == "header" and not in_main)), name in MAIN, name in HIDDEN, False
    for key, value in _ATTR.findall(attr) if attr else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "href":
            target = True
        elif key == "hidden" or (key == "style" and _NOT_SHOWN.search(value)):
            hidden = True
        elif key == "aria-hidden":
            named = max(named, float(value == "true"))
        elif key != "style":
            for token in value.split():
                score, own = _token(token[:100], in_main)
                main = main or own
                if name not in ("body", "html", "article", "main"):
                    named = max(named, score)
    return named, main and named < 0.5, hidden and name not in ("html", "body"), target


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order; references decoded, white space inside a block is one space."""
    found: list[Block] = []
    forms: list[int] = []  # of each block: the nearest form around it that may hold the page
    above = [0]  # of each such form: the next one around it
    root = _Open("", -1, 0.0, 0.0, False, False, False, 0, False)
    stack: list[_Open] = []
    places: defaultdict[str, list[int]] = defaultdict(list)
    text: list[str] = []
    links: list[str] = []

    def flush(top: _Open) -> None:
        joined = " ".join("".join(text).split())
        if joined:
            words = joined.count(" ") + 1
            forms.append(top.form)
            found.append(Block(joined, words, min(words, len("".join(links).split())), top.named, top.main))
        text.clear()
        links.clear()

    def add(raw: str, top: _Open) -> None:
        if raw and not top.hidden:
            shown = htmllib.unescape(raw)
            text.append(shown)
            if top.link:
                links.append(shown)

    def cut(k: int) -> None:
        for x in stack[k:]:
            places[x.name].pop()
        del stack[k:]

    at = 0
    for m in _TAG.finditer(page):
        top = stack[-1] if stack else root
        add(page[at : m.start()], top)
        at = m.end()
        if m["name"] is None:
            continue
        name, attr = m["name"].lower(), m["attr"]
        if name in BLOCK:
            flush(top)
        elif name == "br":
            text.append(" ")
            links.append(" " if top.link else "")
        if m["end"]:
            own = places[name]
            if own and (name in BLOCK or own[-1] > top.block):  # an inline end doesn't close a block
                cut(own[-1])
            continue
        if top.foreign and name in BLOCK and name != "title":
            cut(min(places[x][0] for x in FOREIGN if places[x]))
        if name in VOID or (attr.endswith("/") and (name in FOREIGN or (stack and stack[-1].foreign))):
            continue
        if name in BLOCK:
            ended = ENDED.get(name, {"p"})
            while stack and stack[-1].block >= 0 and stack[stack[-1].block].name in ended:
                cut(stack[-1].block)
        elif name == "a" and places["a"] and places["a"][-1] > stack[-1].block:
            cut(places["a"][-1])
        top = stack[-1] if stack else root
        named, main, hidden, target = _element(name, attr, top.main)
        form, around, apart = top.form, top.named, top.apart
        if name in MAIN:  # a form around the whole page is no form to leave out
            form, around = 0, apart
        plain = named
        if name in FORMS:
            plain = 0.0
            if _element("div", attr, top.main)[0] < 0.5:
                above.append(form)
                form, named = len(above) - 1, 0.0
        places[name].append(len(stack))
        stack.append(_Open(name, len(stack) if name in BLOCK else top.block, max(around, named), max(apart, plain), top.main or main, top.hidden or hidden, top.link or (name == "a" and target), form, top.foreign or name in FOREIGN))
    top = stack[-1] if stack else root
    add(page[at:], top)
    flush(top)
    return _outside_forms(found, forms, above)


def _outside_forms(found: list[Block], forms: list[int], above: list[int]) -> list[Block]:
    """found, with what stands in a form as boilerplate, but for a form that holds most words of the page's not in other boilerplate."""
    if len(above) == 1:
        return found
    words, weighed, rest = [0] * len(above), [0] * len(above), 0
    for b, k in zip(found, forms):
        if b.named < 0.5:
            own = b.words * (MAIN_WEIGHT if b.main else 1)
            rest += own
            words[k] += b.words
            weighed[k] += own
    for k in range(len(above) - 1, 0, -1):  # a form within another one has the greater number
        words[above[k]] += words[k]
        weighed[above[k]] += weighed[k]
    out = [False] * len(above)
    for k in range(1, len(above)):
        out[k] = out[above[k]] or words[k] <= rest - weighed[k]
    return [b._replace(named=1.0) if out[k] else b for b, k in zip(found, forms)]


NAMES = (6, 7)  # the features that aren't counts


def features(found: list[Block]) -> np.ndarray:
    """One row a block: words and link density of itself, of the one before and of the one after; named; main."""
    if not found:
        return np.empty((0, 8))
    w = np.array([b.words for b in found], float)
    d = np.array([b.linked for b in found], float) / w
    shift = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    return np.stack([w, d, shift(w, -1), shift(d, -1), shift(w, 1), shift(d, 1), np.array([b.named for b in found], float), np.array([b.main for b in found], float)], 1)


#: Labelled pages, block by block: words, words in links, named, main; then 1 for main text.
LABELLED = [
    # an article marked as such, a menu and notes around it; an advert and a list of links within it
    [(1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (2, 2, 0, 0, 0), (1, 1, 0, 0, 0), (9, 0, 1, 0, 0), (8, 0, 0, 1, 1), (62, 0, 0, 1, 1), (45, 6, 0, 1, 1), (14, 0, 1, 1, 0), (4, 0, 0, 1, 1), (1, 0, 0, 1, 1), (1, 0, 0, 1, 1), (40, 0, 0, 1, 1), (5, 5, 0, 1, 0), (7, 7, 0, 1, 0), (6, 6, 0, 1, 0), (16, 0, 1, 0, 0)],
    # one-line paragraphs, readers' comments of any length
    [(2, 2, 1, 0, 0), (1, 1, 1, 0, 0), (6, 0, 0, 1, 1), (1, 0, 0, 1, 1), (3, 0, 0, 1, 1), (2, 1, 0, 1, 1), (90, 2, 0, 1, 1), (12, 3, 0, 1, 1), (33, 0, 1, 1, 0), (75, 0, 1, 1, 0), (4, 0, 1, 1, 0), (120, 5, 1, 1, 0), (2, 2, 0, 0, 0)],
    # text in elements whose names say something else too
    [(3, 3, 0, 0, 0), (2, 2, 0, 0, 0), (7, 0, 0, 1, 1), (55, 0, 0.33, 1, 1), (38, 3, 0.25, 1, 1), (9, 0, 0.33, 1, 1), (60, 0, 0.25, 0, 1), (5, 0, 0, 1, 1), (48, 0, 0.6, 1, 1), (70, 4, 0.6, 1, 1), (31, 0, 0.6, 1, 1), (6, 0, 0.6, 1, 0), (3, 0, 0.6, 1, 0), (8, 0, 0.6, 0, 0), (14, 0, 0.6, 0, 0), (30, 0, 0.6, 0, 0)],
    [(44, 0, 0.33, 0, 1), (80, 3, 0.4, 0, 1), (26, 0, 0.25, 0, 1), (4, 4, 0.33, 0, 0), (3, 3, 0.25, 0, 0), (5, 0, 0.67, 1, 0), (50, 0, 0.67, 1, 0), (65, 0, 0.67, 0, 0)],
    # no names at all: menu, text, links at the end
    [(1, 1, 0, 0, 0), (2, 2, 0, 0, 0), (1, 1, 0, 0, 0), (3, 3, 0, 0, 0), (5, 0, 0, 0, 1), (30, 0, 0, 0, 1), (44, 5, 0, 0, 1), (1, 0, 0, 0, 1), (33, 0, 0, 0, 1), (100, 20, 0, 0, 1), (4, 4, 0, 0, 0), (2, 2, 0, 0, 0), (5, 0, 0, 0, 0), (3, 3, 0, 0, 0)],
    [(4, 4, 0, 0, 0), (3, 0, 0, 0, 0), (2, 2, 0, 0, 0), (2, 2, 0, 0, 0), (6, 0, 0, 0, 1), (45, 0, 0, 0, 1), (9, 1, 0, 0, 1), (20, 0, 0, 0, 1), (22, 0, 0, 0, 1), (1, 1, 0, 0, 0), (21, 0, 0, 0, 1), (50, 0, 0, 0, 1), (7, 0, 0, 0, 0), (2, 2, 0, 0, 0)],
    [(6, 3, 0, 0, 0), (9, 7, 0, 0, 0), (3, 3, 0, 0, 0), (28, 3, 0, 0, 1), (1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (19, 0, 0, 0, 1), (60, 6, 0, 0, 1), (40, 0, 0, 0, 1), (8, 0, 0, 0, 0)],
    [(3, 3, 0, 0, 0), (20, 18, 0, 0, 0), (35, 28, 0, 0, 0), (2, 2, 0, 0, 0), (12, 7, 0, 0, 0), (9, 6, 0, 0, 0), (30, 24, 0, 0, 0), (4, 4, 0, 0, 0)],
    # headings that are links, between long texts
    [(2, 2, 0, 1, 0), (70, 0, 0, 1, 1), (8, 8, 0, 1, 1), (55, 0, 0, 1, 1), (80, 8, 0, 1, 1), (4, 4, 0, 1, 1), (45, 0, 0, 1, 1), (90, 0, 0, 1, 1), (3, 3, 0, 1, 0), (5, 5, 0, 1, 0), (2, 2, 0, 1, 0)],
    # lists of links within and after main content
    [(75, 0, 0, 1, 1), (3, 3, 0, 1, 0), (5, 5, 0, 1, 0), (4, 4, 0, 1, 0), (9, 8, 0, 1, 0), (150, 0, 0, 1, 1), (2, 2, 0, 1, 0), (1, 1, 0, 1, 0), (100, 0, 0, 0, 1), (10, 10, 0, 0, 0), (8, 8, 0, 0, 0), (6, 6, 0, 0, 0)],
    # short pages, whole: a heading or a line
    [(4, 0, 0, 0, 1)], [(1, 0, 0, 0, 1)], [(9, 0, 0, 0, 1)], [(45, 0, 0, 0, 1)], [(3, 0, 0, 1, 1)], [(5, 0, 0, 0, 1), (30, 0, 0, 0, 1)],
    # short among short: menus without links, notices, ends of pages
    [(3, 0, 0, 0, 0), (7, 0, 0, 0, 0), (6, 0, 0, 0, 0), (2, 0, 0, 0, 0), (4, 4, 0, 0, 0), (1, 0, 0, 0, 0), (3, 3, 0, 0, 0), (3, 0, 0, 0, 0), (2, 2, 0, 0, 0)],
    [(25, 1, 0, 0, 1), (16, 1, 0, 0, 1), (14, 0, 0, 0, 1), (60, 0, 0, 0, 1), (18, 0, 0, 0, 1), (40, 0, 0, 0, 1), (5, 1, 0, 0, 0), (3, 0, 0, 0, 0)],
    # adverts, sign-up forms, boxes at the side and ends of pages, with names
    [(22, 0, 1, 0, 0), (2, 2, 0, 0, 0), (5, 0, 1, 0, 0), (11, 0, 1, 0, 0), (7, 0, 0, 1, 1), (85, 0, 0, 1, 1), (18, 0, 1, 1, 0), (52, 0, 0, 1, 1), (27, 0, 1, 0, 0), (13, 0, 1, 0, 0), (40, 0, 1, 0, 0), (12, 0, 1, 0, 0)],
    [(3, 0, 1, 0, 0), (6, 0, 0, 1, 1), (2, 0, 0, 1, 1), (25, 0, 0, 1, 1), (20, 2, 1, 0, 0), (65, 0, 1, 0, 0), (1, 0, 1, 0, 0)],
]


def labelled_rows() -> np.ndarray:
    """The table that the tree is trained on: features of each labelled block, then its label."""
    return np.concatenate([np.column_stack([features([Block("", w, n, named, bool(main)) for w, n, named, main, _ in page]), [x[-1] for x in page]]) for page in LABELLED])


class Leaf(NamedTuple):
    value: bool


class Split(NamedTuple):
    feature: int
    at: float  # below goes left
    left: Split | Leaf
    right: Split | Leaf


def train(rows: np.ndarray, depth: int = 9) -> Split | Leaf:
    """A binary tree that lowers Gini impurity; the first best split in order of feature and value is taken."""
    y = rows[:, -1]
    majority = Leaf(bool(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return majority
    best = None
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] < at
            score = gini(y[left]) + gini(y[~left])
            if best is None or score < best[0] - 1e-9:
                best = (score, f, at, left)
    if best is None or best[0] >= gini(y) - 1e-9:
        return majority
    _, f, at, left = best
    return Split(f, at, train(rows[left], depth - 1), train(rows[~left], depth - 1))


def classify(tree: Split | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    out = np.empty(len(x), bool)
    left = x[:, tree.feature] < tree.at
    out[left], out[~left] = classify(tree.left, x[left]), classify(tree.right, x[~left])
    return out


def by_counts(tree: Split | Leaf, x: np.ndarray) -> np.ndarray:
    """Whether the tree comes to its answer by word counts and link densities alone, for every row."""
    if isinstance(tree, Leaf):
        return np.ones(len(x), bool)
    out = np.zeros(len(x), bool)
    if tree.feature not in NAMES:
        left = x[:, tree.feature] < tree.at
        out[left], out[~left] = by_counts(tree.left, x[left]), by_counts(tree.right, x[~left])
    return out


def main_text(page: str | None, tree: Split | Leaf) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, classify(tree, features(found))) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of the whole html of every row."""
    python_ready(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = train(labelled_rows())
        for b in batches:
            t = [main_text(x, tree) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
