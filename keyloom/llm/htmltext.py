"""Main text of web pages: flat text blocks with word count and link density of themselves and their neighbours, and where they
stand, classified by a decision tree that is trained here on a small labelled table.

A page becomes a list of elements and a list of blocks. Class and id words, tags and the page's shape only give each block
features (how strongly it is marked as furniture, whether it stands in the article); the tree weighs them with lengths and links.
An element that holds the article, or most of a page without one, is a wrapper: its class words and a form tag say nothing.

Defined results: a null or empty page, and one without article text, gives the empty string; unclosed tags end with their
parent, an unclosed comment, script or style takes the rest; repeated rows are each extracted; extra columns are dropped.
A line break (br) ends a block, and each table cell is a block. A page is held in memory whole, with its blocks, one at a time, so
very long ones are extracted whole. Where two articles are equally long the first is the page's.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<(?:!--|(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?/][^>]*+>)""")
_LOOSE = re.compile(r"<(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>[^>]*+)>")
_ATTR = re.compile(r"""(class|id|role|style|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|(?:^|\s)(hidden)(?=[\s/=]|$)|(aria-hidden)\s*=\s*["']?true""", re.I)
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base basefont bgsound br col embed hr img input keygen link meta param source track wbr".split())
#: Their content is no markup and ends with their end tag only; a slash before `>` does not close them.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is not text of the page.
UNSEEN = frozenset("noscript template svg object canvas select datalist audio video annotation annotation-xml".split())
#: Of these and of formulas, those that a slash before `>` closes and that stand within a block's text.
WITHIN = frozenset("svg annotation annotation-xml math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: A formula's text belongs to the block it stands in; outside articles formulas are dropped.
FORMULA = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mfenced menclose mmultiscripts semantics".split())
FURNITURE = frozenset("nav aside footer header form menu dialog button label fieldset legend figcaption head".split())
#: Of these, those that pages also use around everything.
AROUND = frozenset("form fieldset dialog label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote dd dt figcaption td th".split())
SCOPES = frozenset("ul ol table tr div section article body main nav aside footer header form blockquote".split())
TWINS = frozenset("li td th tr dt dd option".split())
#: Words in class, id or role that name page furniture; whole words after splitting at marks and case changes.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination footer header masthead topbar toolbar newsletter subscribe subscription contentinfo complementary dialog".split()
)
#: Words that name furniture or a part of an article.
WEAK = frozenset("side skip pager share sharing social related recommended recommendations trending popular signup login search copyright legal disclaimer tags toc discussion respond".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies".split())
#: Strong words that say what an element holds, not where it stands: they count on an element of any size.
OWN_KIND = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter".split()) | COMMENTS
#: Class names beginning with these describe a state of the element (`category-search`), they don't name it.
STATES = frozenset("category tag has with without no is js type format status tax term".split())
SWITCHES = frozenset("open closed enabled disabled on off".split())
#: Class names of article bodies.
BODIES = frozenset("article main articlebody article-body article-content article-text main-content post-content post-body entry-content entry-body story-body page-content hentry post entry".split())
NONE, LIGHT, FULL = range(3)


class Element:
    __slots__ = ("name", "parent", "strong", "weak", "remarks", "own_kind", "hidden", "unseen", "content", "body", "words", "mark", "inside", "prose", "holds_article")

    def __init__(self, name: str, parent: int):
        self.name, self.parent = name, parent
        self.strong = self.weak = self.remarks = self.own_kind = self.hidden = self.unseen = self.content = self.body = False
        self.words = self.prose = 0
        self.mark, self.inside, self.holds_article = NONE, 0, False


@dataclass
class Block:
    words: list[str]
    linked: int
    at: int  # its element
    heading: bool
    prose: bool
    mark: int = NONE
    inside: int = 0


def _read(attrs: str, e: Element) -> None:
    """What class, id, role, itemprop and style say."""
    for name, a, b, c, bare, aria in _ATTR.findall(attrs):
        value = a or b or c
        if bare or aria:
            e.hidden = True
            continue
        name = name.lower()
        if name == "style":
            e.hidden |= bool(_INVISIBLE.search(value))
            continue
        for token in value.split():
            words = [w.lower() for w in _WORD.findall(token)]
            low = token.lower()
            if not words or len(words) > 1 and (words[0] in STATES or words[-1] in SWITCHES):
                continue
            if name == "itemprop":
                e.content |= low == "articlebody"
                e.remarks |= low == "comment"
                continue
            if e.name in ("article", "main"):  # articles are named after many things
                e.remarks |= words[0] in COMMENTS
                continue
            named = set(words)
            if name == "role":
                e.content |= low in ("main", "article")
            e.remarks |= bool(named & COMMENTS)
            e.own_kind |= bool(named & OWN_KIND)
            e.strong |= bool(named & (STRONG | COMMENTS))
            e.weak |= bool(named & WEAK)
            e.body |= low in BODIES


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """The page's elements, parents first, and its text blocks in page order."""
    elements, found = [Element("", -1)], []
    stack = [0]
    parts: list[tuple[str, bool]] = []
    in_link, at, n = False, 0, len(page)

    def close() -> None:
        if not parts:
            return
        words = "".join(p for p, _ in parts).split()
        if words:
            linked = sum(len(p.split()) for p, link in parts if link)
            names = [elements[k].name for k in stack]
            found.append(Block(words, min(linked, len(words)), stack[-1], any(x in HEADINGS for x in names), any(x in PROSE for x in names[-3:])))
        parts.clear()

    def pop_to(k: int) -> None:
        close()
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not elements[stack[-1]].unseen:
            piece = page[at:lt]
            parts.append((html.unescape(piece) if "&" in piece else piece, in_link))
        if lt == n:
            break
        tag = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not tag:
            if lt + 1 == n or re.match(r"<[a-zA-Z/!?]", page[lt : lt + 2]):  # the page ends inside a tag
                break
            if not elements[stack[-1]].unseen:
                parts.append(("<", in_link))
            at = lt + 1
            continue
        at = tag.end()
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4 if not page.startswith("<!-->", lt) else lt + 2)
            at = n if end < 0 else end + 3
            continue
        name = (tag.groupdict().get("name") or "").lower()
        if not name:
            continue
        if name == "br" or name == "hr":
            close()
            continue
        if tag["end"]:
            if name == "a":
                in_link = False
            if name in FORMULA and name != "math":
                continue
            if name not in INLINE or elements[stack[-1]].name == name:
                for k in range(len(stack) - 1, 0, -1):
                    if elements[stack[k]].name == name:
                        if name in WITHIN:  # the block goes on after it
                            del stack[k:]
                            break
                        pop_to(k)
                        in_link = in_link and name in INLINE
                        break
                else:
                    if name not in INLINE and name not in WITHIN:
                        close()
            continue
        attrs = tag["attrs"]
        if name in RAW:
            if not elements[stack[-1]].unseen:
                close()
            end = _end_of(name).search(page, at)
            gt = page.find(">", end.end()) if end else -1
            at = n if gt < 0 else gt + 1
            continue
        if name in VOID or name in FORMULA and name != "math":
            continue
        e = Element(name, stack[-1])
        if attrs.strip():
            _read(attrs, e)
        if name == "a":
            in_link = bool(_HREF.search(attrs))
        if name == "math":
            e.unseen = not any(elements[k].content or elements[k].body or elements[k].name in ("article", "main") for k in stack)
            if not e.unseen:
                continue
        e.unseen |= name in UNSEEN or elements[stack[-1]].unseen
        if name in WITHIN and attrs.rstrip().endswith("/"):
            continue
        if elements[stack[-1]].unseen:  # nothing in there makes a block
            if attrs.rstrip().endswith("/"):
                continue
        elif name in INLINE:
            if not (e.strong or e.weak or e.remarks or e.hidden):
                continue
            close()
        elif name not in WITHIN:
            close()
            for k in range(len(stack) - 1, 0, -1):  # what this tag ends without saying so
                x = elements[stack[k]].name
                if x == "p" or x in HEADINGS or x == name and name in TWINS:
                    pop_to(k)
                elif x in SCOPES:
                    break
            e.parent = stack[-1]
        stack.append(len(elements))
        elements.append(e)
    close()
    return elements, found


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I | re.A)


def _place(elements: list[Element], found: list[Block]) -> None:
    """Give each block its mark (NONE, LIGHT, FULL) and place: 2 in an article, 1 in a main element beside its article, 0 on a page
    without either, -1 outside them."""
    for b in found:
        elements[b.at].words += len(b.words)
        elements[b.at].prose += len(b.words) if len(b.words) >= 15 and 2 * b.linked < len(b.words) else 0
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.words += e.words
        up.prose += e.prose
    total = elements[0].words
    most = lambda e: 2 * e.words > total

    remarks, furniture = [False], [False]  # of each element: stands in reader comments; in furniture that isn't most of the page
    candidates = []
    for k, e in enumerate(elements[1:], 1):
        remarks.append(remarks[e.parent] or e.remarks)
        own = e.strong and e.name not in ("html", "body") or e.name in FURNITURE or e.hidden and e.name not in ("html", "body")
        furniture.append(furniture[e.parent] or own and not most(e))
        named = e.name in ("article", "main") or e.content or e.body and not e.strong
        e.content = named and not remarks[k]
        if e.content and e.words and not furniture[k]:
            candidates.append(k)
    # the page's article: the largest; it makes its ancestors wrappers
    root = max(candidates, key=lambda k: (elements[k].words, -k), default=None)
    around = set()
    k = root
    while k is not None and k >= 0:
        around.add(k)
        k = elements[k].parent
    for e in reversed(elements[1:]):
        if e.name == "article" and e.content and e.words:
            k = e.parent
            while k >= 0 and not elements[k].holds_article:
                elements[k].holds_article = True
                k = elements[k].parent

    for k, e in enumerate(elements[1:], 1):
        up = elements[e.parent]
        e.inside = up.inside
        if e.content and (root is None or k == root or not furniture[k]):
            e.inside = 1 if e.holds_article and e.name != "article" else 2
        wrapper = k in around or e.name in ("html", "body", "main")
        if root is None and most(e) and not e.own_kind and e.prose >= 40 and (e.name in AROUND or e.name not in FURNITURE):
            wrapper = True  # of a page without an article
        header = e.name == "header" or e.strong and not e.own_kind and e.name in HEADINGS
        own = NONE
        if e.remarks or e.hidden and not wrapper:
            own = FULL
        elif e.name in FURNITURE and not (wrapper and e.name in AROUND) and not (header and up.inside > 0) and not (e.name == "figcaption" and up.inside > 0):
            own = FULL
        elif e.strong and not wrapper and not (header and up.inside > 0):
            own = FULL
        elif e.weak and not wrapper and e.name not in ("article", "main"):
            own = LIGHT
        e.mark = max(up.mark, own)
        if k == root and not remarks[k]:
            e.mark = NONE
    spoken = {NONE: 0, LIGHT: 0, FULL: 0}
    in_article = 0
    for b in found:
        b.mark, b.inside = elements[b.at].mark, elements[b.at].inside
        spoken[b.mark] += len(b.words)
        in_article += len(b.words) * (b.mark == NONE and b.inside > 0)
    if in_article * 4 >= spoken[NONE] and in_article:
        titled = any(b.heading and b.inside > 0 for b in found)
        for b in found:
            if b.inside == 0:
                b.inside = -1
                b.heading &= not titled


def blocks(page: str) -> list[Block]:
    """The page's text blocks in page order."""
    elements, found = parse(page)
    _place(elements, found)
    return found


#: words, link density, words before, link density before, words after, link density after, mark, place, heading, prose tag,
#: words of the page's longest block without a mark
FEATURES = 11


def features(found: list[Block]) -> np.ndarray:
    if not found:
        return np.zeros((0, FEATURES))
    own = np.array([[len(b.words), b.linked / len(b.words)] for b in found], np.float64).reshape(-1, 2)
    pad = np.zeros((1, 2))
    longest = max((len(b.words) for b in found if b.mark == NONE), default=0)
    flags = np.array([[b.mark, b.inside, b.heading, b.prose, longest] for b in found], np.float64).reshape(-1, 5)
    return np.hstack([own, np.vstack([pad, own[:-1]]), np.vstack([own[1:], pad]), flags])


#: What the cases below draw from: lengths, link densities and neighbours (words, link density).
FEW, SOME, MANY = (1, 2, 3, 4, 5, 6, 8), (10, 12, 14), (18, 25, 40, 80, 200, 500)
PLAIN, MIXED, LINKED = (0.0, 0.0, 0.0, 0.1, 0.2, 0.3, 0.4), (0.1, 0.2, 0.3, 0.4), (0.6, 0.7, 0.8, 0.9, 1.0, 1.0)
LINKS = ((1, 1.0), (3, 1.0), (9, 0.9), (30, 0.7))
TEXT = ((25, 0.0), (60, 0.0), (90, 0.1), (250, 0.05))
QUIET = ((0, 0.0), (2, 0.0), (5, 0.2), (9, 0.0), (14, 0.1), *TEXT)  # any but links
NEAR = QUIET + LINKS
EITHER, NO, YES = (0, 1), (0,), (1,)

#: Kinds of blocks, labelled by hand: words, link density, neighbour before, neighbour after, mark, place, heading, prose tag, longest
#: block, and 1 for article text.
CASES = (
    # in an article: paragraphs, titles, single words, links, lists of links
    (FEW + SOME + MANY, PLAIN, NEAR, NEAR, NO, (2,), EITHER, EITHER, FEW + MANY, 1), (FEW + SOME + MANY, LINKED, NEAR, NEAR, NO, (2,), EITHER, EITHER, MANY, 1), (FEW, PLAIN, NEAR, NEAR, NO, (2,), YES, YES, MANY, 1),
    # in a main element, beside its article: text yes, lists of links no
    (FEW + SOME + MANY, PLAIN, NEAR, NEAR, NO, (1,), EITHER, EITHER, MANY, 1), (FEW + SOME + MANY, LINKED, NEAR, NEAR, NO, (1,), EITHER, EITHER, MANY, 0),
    # outside the article of a page that has one: nothing but its title
    (FEW + SOME + MANY, PLAIN, NEAR, NEAR, NO, (-1,), NO, EITHER, MANY, 0), (FEW + SOME + MANY, LINKED, NEAR, NEAR, NO, (-1,), EITHER, EITHER, MANY, 0),
    (FEW + SOME, PLAIN, NEAR, QUIET, NO, (-1,), YES, YES, MANY, 1), (FEW + SOME, PLAIN, NEAR, LINKS, NO, (-1,), YES, YES, MANY, 0),
    # named as furniture, wherever it stands and however long
    (FEW + SOME + MANY, PLAIN, NEAR, NEAR, (2,), (-1, 0, 1, 2), EITHER, EITHER, FEW + MANY, 0), (FEW + SOME + MANY, LINKED, NEAR, NEAR, (2,), (-1, 0, 1, 2), EITHER, EITHER, FEW + MANY, 0),
    (FEW + SOME + MANY, PLAIN, NEAR, NEAR, (2,), (2,), EITHER, YES, MANY, 0), (MANY, PLAIN, TEXT, TEXT, (2,), (0, 2), NO, YES, MANY, 0),
    # a name that may be of furniture or of a part of an article: the text itself decides
    ((25, 40, 80, 200, 500), (0.0, 0.0, 0.1, 0.2), NEAR, NEAR, YES, (0, 1, 2), NO, EITHER, MANY, 1), (FEW, PLAIN, NEAR, TEXT, YES, (0, 1, 2), YES, YES, MANY, 1), (FEW, PLAIN, NEAR, ((0, 0.0), (2, 0.0), (5, 0.2), *LINKS), YES, (0, 1, 2), YES, YES, MANY, 0),
    (FEW + SOME, PLAIN, NEAR, NEAR, YES, (0, 1, 2), NO, EITHER, MANY, 0), (FEW + SOME + MANY, LINKED, NEAR, NEAR, YES, (0, 1, 2), EITHER, EITHER, MANY, 0), (FEW + SOME + MANY, PLAIN, NEAR, NEAR, YES, (-1,), EITHER, EITHER, MANY, 0),
    # pages without an article: paragraphs, long blocks, titles before text, short blocks amid text
    (FEW + SOME + MANY, PLAIN, NEAR, NEAR, NO, NO, NO, YES, FEW + MANY, 1), (MANY, PLAIN, NEAR, NEAR, NO, NO, NO, NO, MANY, 1), (FEW + SOME, PLAIN, NEAR, QUIET, NO, NO, YES, YES, FEW + MANY, 1), (FEW + SOME, PLAIN, TEXT, TEXT, NO, NO, NO, NO, MANY, 1),
    # short pages without an article
    (FEW + SOME, PLAIN, NEAR, NEAR, NO, NO, NO, EITHER, FEW + SOME, 1),
    # pages without an article: menus, lists of links, titles of lists, short blocks beside them or at an end
    (FEW + SOME + MANY, LINKED, NEAR, NEAR, NO, NO, EITHER, EITHER, FEW + MANY, 0), (FEW + SOME, PLAIN, NEAR, LINKS, NO, NO, YES, YES, MANY, 0),
    (FEW + SOME, PLAIN, LINKS, NEAR, NO, NO, NO, NO, MANY, 0), (FEW + SOME, PLAIN, NEAR, LINKS, NO, NO, NO, NO, MANY, 0), (FEW + SOME, PLAIN, NEAR, ((0, 0.0), (2, 0.0), (5, 0.2), (9, 0.0)), NO, NO, NO, NO, MANY, 0), (FEW + SOME, PLAIN, ((0, 0.0), (2, 0.0), (5, 0.2), (9, 0.0)), NEAR, NO, NO, NO, NO, MANY, 0),
)


def labelled(each: int = 300) -> np.ndarray:
    """The labelled table: `each` blocks of every kind, FEATURES columns and the label."""
    rng = np.random.default_rng(1)
    rows = []
    for words, density, before, after, mark, place, heading, prose, longest, label in CASES:
        one = lambda values: values[rng.integers(len(values))]
        for _ in range(each):
            n, m = one(words), one(mark)
            rows.append((n, one(density), *one(before), *one(after), m, one(place), one(heading), one(prose), max(one(longest), 0 if m else n), label))
    return np.array(rows, np.float64)


@dataclass
class Node:
    label: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 1) -> Node:
    """A classification tree by Gini impurity; the first best cut wins."""
    here = Node(bool(y.mean() >= 0.5))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return here
    best = (1e-9,)
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= least and (gain := gini(y) - gini(y[low]) - gini(y[~low])) > best[0] + 1e-9:
                best = (gain, f, cut)
    if len(best) == 1:
        return here
    here.feature, here.cut = best[1], float(best[2])
    low = x[:, here.feature] <= here.cut
    here.low, here.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return here


@functools.cache
def tree() -> Node:
    table = labelled()
    return grow(table[:, :FEATURES], table[:, FEATURES])


def classify(node: Node, row) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.cut else node.high
    return node.label


def main_text(page: str | None, trained: Node | None = None) -> str:
    found, trained = blocks(page) if page else [], trained or tree()
    return "\n".join(" ".join(b.words) for b, row in zip(found, features(found)) if classify(trained, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    trained = tree()  # once, on the driver

    def run(batches):
        for batch in batches:
            texts = [main_text(p, trained) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
