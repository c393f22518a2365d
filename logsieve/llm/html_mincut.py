"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is scanned into blocks (the text between block-level tags) with their open
elements. A logistic classifier on a block's own look (length, links, punctuation,
tag, ...) and the evidence of its containers give a log-odds for "content", which
becomes a capacity to the source or the sink. Neighbouring blocks, and blocks
with the same parent, are tied by edges whose capacity halves with each step
between them in the element tree. The minimum cut (Dinic's maximum flow) parts
content from boilerplate. Blocks inside scripts, navigation, footers, asides, forms,
hidden elements and the like are tied to the sink for good.

Class and id words only weigh. A name made of nothing but words of page parts
("sidebar", "ad-box") draws each block of its element to the sink, a reader-comment
name more so; a name with other words beside them ("related-work", "has-sidebar"),
or the id of a section of an article, is one node of the cut, tied to the element's
blocks, so that they go or stay together by their own look. Neither counts for an
element that holds the page's main element or most of its paragraph text.

The classifier is trained, in one task, on the blocks of at most ``SAMPLE`` pages:
what stands in an article or main element counts as content, what stands in
navigation, footers, asides or adverts as boilerplate. The containers themselves
are no features. With no such blocks the built-in weights are used.

Text: character references are decoded, white space (also ``<br>``) becomes one
space, blocks are trimmed and joined by one line feed in page order; nothing is
capped. Defined results: a null or empty html and a page without content have an
empty text of 0 characters; broken markup is read as far as it goes (an unclosed
tag, comment or script ends with the page); repeated rows get equal results; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, spread
from .sampling import bounded_sample

SAMPLE = 300
SMOOTH = 2.0
INSIDE, OUTSIDE, HINT = 6.0, -4.0, 2.0
# what a name costs: a block in a comment or a page part; an element with a doubtful name, and its tie to its blocks
COMMENT, PART, DOUBT, TIE = -16.0, -8.0, -1.5, 4.0

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg".split())
GONE = frozenset("nav footer aside menu dialog head button select option optgroup datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar "
                  "tablist form".split())
# class and id words of page parts that are not the article
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
PARTS = frozenset(
    "nav navbar navigation navi topnav subnav menu menus submenu sidebar side rail aside footer foot bottom header masthead "
    "topbar top ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices notification alert warning popup modal overlay dialog newsletter "
    "subscribe subscription signup signin login register share sharing social follow related recommended recommendations "
    "popular trending breadcrumb breadcrumbs pagination pager toolbar widget widgets tags taglist copyright legal disclaimer "
    "skip search searchbox form hidden print discussion".split())
# words that are hardly ever about a subject, but for names like "has-ads"
SURE = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsored promo newsletter".split())
STATES = frozenset("has with without no show hide".split())
# words that say nothing beside those
NEUTRAL = frozenset(
    "area bar block box bottom button buttons card cards col column container group icon icons inner item items left link "
    "links list main middle outer panel post posts articles stories right row section site slot title top unit wrap "
    "wrapper".split())
BODY = frozenset("article content main post entry story text body articlebody prose".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|"
    r"<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"©|\bcopyright\b|all rights reserved|privacy policy|cookie|subscribe|sign (?:in|up)|log ?in|"
                   r"read more|click here|share (?:this|on)|advertis|newsletter", re.I)


class Element:
    __slots__ = ("name", "parent", "depth", "gone", "form", "inside", "hint", "weak", "marks", "cost", "main")

    def __init__(self, name, parent, attrs=""):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.gone = bool(parent and parent.gone)
        self.form = parent.form if parent else None
        self.inside = bool(parent and parent.inside)
        self.hint = parent.hint if parent else 0.0
        self.weak = parent.weak if parent else None  # what the training labels say
        self.marks = parent.marks if parent else ()  # the elements around it, itself too, named like a page part
        self.cost = 0.0  # of its own name
        self.main = parent.main if parent else None  # the article or main element it is in
        if name in GONE:
            self.gone = True
            self.weak = 0 if name in ("nav", "footer", "aside") else self.weak
        elif name == "form":
            self.form = self
        elif name in ("article", "main"):
            self.inside = True
            self.main = self if self.main is None or name == "main" else self.main
            self.weak = 1 if self.weak is None else self.weak
        elif name == "header" and not self.inside:
            self.gone = True
        if attrs and "=" in attrs or "hidden" in attrs:
            self._read(attrs)

    def _read(self, attrs):
        words, names, outer = set(), [], self.inside
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for name in value.split():
                    names.append((key, {w.lower() for w in _WORDS.findall(name)}))
                    words |= names[-1][1]
            elif key == "role":
                if value.lower() in ROLES:
                    self.gone = True
                elif value.lower() in ("main", "article"):
                    self.inside, self.main = True, self.main or self
            elif key == "itemprop" and value.lower() == "articlebody":
                self.inside, self.main = True, self.main or self
            elif (key == "hidden" and m[0].lower().startswith("hidden") and m.start() == 0 or
                  key == "hidden" and attrs[m.start() - 1].isspace() or
                  key == "aria-hidden" and value.lower() == "true" or
                  key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                self.gone = True
        if not words or self.name in ("html", "body", "article", "main"):
            return
        if words & COMMENTS:
            own = any(w & BODY and not w & COMMENTS for _, w in names)  # as in "entry-content comments-open"
            self.cost = DOUBT if own else COMMENT
        elif words & PARTS:
            if words & BODY or self.name in ("h1", "h2", "h3", "h4", "h5", "h6", "p"):
                self.hint -= HINT / 2
            else:
                # the id of a section within the article may be its heading's
                sure = any(w & PARTS and (w <= PARTS | NEUTRAL or w & SURE and not w & STATES)
                           and w != {"discussion"} and not (outer and key == "id" and self.name == "section") for key, w in names)
                self.cost = PART if sure else DOUBT
        elif words & BODY:
            self.hint += HINT
        if self.cost:
            self.marks += (self,)


class Block:
    __slots__ = ("element", "parts", "linked", "text", "size")

    def __init__(self, element):
        self.element, self.parts, self.linked = element, [], 0


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks with text, in order."""
    page = page or ""
    root = top = Element("#page", None)
    out, block, links, at = [], Block(root), 0, 0
    n = len(page)
    open_: dict[str, int] = {}  # names of open elements, so that a stray end tag costs no walk

    def push(e):
        nonlocal top
        top = e
        open_[e.name] = open_.get(e.name, 0) + 1

    def pop_to(x):
        nonlocal top
        while top is not x:
            open_[top.name] -= 1
            top = top.parent

    def text(lo, hi):
        if lo < hi:
            s = page[lo:hi]
            s = _html.unescape(s) if "&" in s else s
            block.parts.append(s)
            if links:
                block.linked += len(s)

    def close():
        nonlocal block
        if block.parts:
            s = _SPACE.sub(" ", "".join(block.parts)).strip()
            if s:
                block.text, block.size = s, len(s)
                out.append(block)
        block = Block(top)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(at, n)
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a lone "<"
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if not (m["end"] or m["end2"]):
            attrs = m["attrs"] if m["name"] else m["attrs2"]
            if name in RAW:
                # only a drawing may end in its own tag; elsewhere the slash belongs to a value or to nothing
                if name != "svg" or not attrs.rstrip().endswith("/"):
                    stop = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
                    at = stop.end() if stop else n
                if name in BLOCKS:
                    close()
            elif name in ("br", "wbr"):
                if name == "br":
                    block.parts.append(" ")
            elif name in BLOCKS:
                # a paragraph ends where another block begins; items end their like
                x = top
                while x.name == "p" or x.name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    x = x.parent
                if name in ("dt", "dd") and x.name in ("dt", "dd"):
                    x = x.parent
                pop_to(x)
                if name not in VOID:
                    push(Element(name, top, attrs))
                close()
            elif name == "a":
                links = 1
            elif attrs and name not in VOID and ("class" in attrs or "id" in attrs or "role" in attrs):
                # an inline element that names a page part counts as a block
                e = Element(name, top, attrs)
                if e.gone and not top.gone or e.cost:
                    push(e)
                    close()
        elif name == "a":
            links = 0
        elif name not in VOID:
            if open_.get(name):
                x = top
                while x.name != name:
                    x = x.parent
                pop_to(x.parent)
                close()
            elif name in BLOCKS:
                close()
    close()
    return out


FEATURES = 14


def look(b: Block) -> list[float]:
    t, n = b.text, b.size
    words = t.count(" ") + 1
    marks = sum(t.count(c) for c in ".,;:!?")
    name = b.element.name
    return [1.0, np.log1p(n) / 5, np.log1p(words) / 4, min(1.0, b.linked / n), min(1.0, 5.0 * marks / words / 2),
            float(t[-1] in ".!?:;\"')»”…"), float(name == "p"), float(name in ("h1", "h2", "h3")),
            float(name in ("li", "dt", "dd")), float(name in ("td", "th")), float(words <= 3),
            float(sum(c.isdigit() for c in t) > 0.3 * n), float(bool(_STOP.search(t)) and n < 200), float(words > 25)]


DEFAULT = np.array([-1.2, 0.6, 0.6, -4.0, 1.0, 0.8, 0.8, 0.5, -0.6, -0.6, -0.8, -1.0, -2.0, 1.5])


def min_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the nodes on the source side of a minimum cut. gain > 0: capacity
    from the source, < 0: to the sink; edges hold both ways. Dinic's algorithm."""
    n = len(gain)
    if not (gain > 0).any():
        return np.zeros(n, dtype=bool)
    if not (gain < 0).any():
        return np.ones(n, dtype=bool)
    s, t = n, n + 1
    head, to, cap = [[] for _ in range(n + 2)], [], []

    def link(a, b, forth, back):
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain.tolist()):
        if g > 0:
            link(s, i, g, 0.0)
        elif g < 0:
            link(i, t, -g, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array(level[:n]) >= 0
        nxt, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(head[a]):
                path.append(e)
                a = to[e]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def steps_between(a: Element, b: Element) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def free_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks that are not tied to the sink."""
    # a form around most of the page's paragraphs is the page, not a form
    total = sum(b.size for b in blocks)
    inside: dict = {}
    for b in blocks:
        if b.element.form:
            inside[b.element.form] = inside.get(b.element.form, 0) + b.size * (b.element.name == "p")
    whole = {f for f, size in inside.items() if 2 * size > total}
    return [b for b in blocks if not b.element.gone and (b.element.form is None or b.element.form in whole)]


def wrappers(free: list[Block]) -> set[Element]:
    """The elements whose names do not count: they hold the main element or most
    of the page's paragraph text (of its text, if it has no paragraphs)."""
    only_p = any(b.element.name == "p" for b in free)
    total, held, out = 0, {}, set()
    heads = [b for b in free if b.element.name == "h1" or b.element.inside]
    for b in free:
        size = b.size * (not only_p or b.element.name == "p")
        total += size
        for m in b.element.marks:
            held[m] = held.get(m, 0) + size
        main = b.element.main
        if main:
            out.update(m for m in main.marks if main.name == "main" or m.cost == DOUBT)
    for m, size in held.items():
        # comments may be longer than what they are about
        if 2 * size > total and (m.cost != COMMENT or all(m in b.element.marks for b in heads)):
            out.add(m)
    return out


def content_blocks(blocks: list[Block], weights: np.ndarray) -> list[Block]:
    free = free_blocks(blocks)
    if not free:
        return []
    idle = wrappers(free)
    marks = [[m for m in b.element.marks if m not in idle] for b in free]
    gain = (np.array([look(b) for b in free]) @ weights).tolist()
    named = any(b.element.inside and not of for b, of in zip(free, marks))
    doubts: dict = {}
    ties = []
    for i, (b, of) in enumerate(zip(free, marks)):
        gain[i] += b.element.hint + (OUTSIDE if named and not b.element.inside else
                                     INSIDE if b.element.inside and not of else 0.0)
        cost = min((m.cost for m in of), default=0.0)
        if cost == DOUBT:  # nothing surer around it
            gain[i] += INSIDE / 3 if b.element.inside else 0.0
            ties.append((doubts.setdefault(of[-1], len(free) + len(doubts)), i, TIE))
        else:
            gain[i] += cost
    gain = np.array(gain + [DOUBT] * len(doubts))
    edges, last = [], {}
    for i, b in enumerate(free):
        if i:
            edges.append((i - 1, i, SMOOTH * 2.0 ** -steps_between(free[i - 1].element, b.element)))
        parent = b.element.parent
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SMOOTH / 4))
        last[parent] = i
    side = min_cut(gain, edges + ties)
    return [b for b, yes in zip(free, side) if yes]


def main_text(page: str | None, weights: np.ndarray = DEFAULT) -> str:
    return "\n".join(b.text for b in content_blocks(blocks_of(page), weights))


def train_weights(pages: list) -> np.ndarray:
    """Logistic regression on the blocks whose containers tell what they are;
    kinds are weighted alike, and the built-in weights are where it starts from
    and is drawn to."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        idle = wrappers(free_blocks(blocks))
        for b in blocks:
            cost = min((m.cost for m in b.element.marks if m not in idle), default=0.0)
            weak = b.element.weak if not cost else None if cost == DOUBT else 0
            if weak is not None:
                x.append(look(b))
                y.append(weak)
    y = np.array(y, dtype=float)
    if not len(y) or y.min() == y.max():
        return DEFAULT
    x = np.array(x)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, rate = DEFAULT.copy(), 1.0 / (0.25 * np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2 + 0.02)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (share * (p - y)) + 0.02 * (w - DEFAULT))
    return w


def _train_task(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"w": [train_weights(frame.sort_values("page_id")["html"].tolist())]})


def fitted_weights(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    own = pages.select(F.col("page_id").cast("long"), "html").filter("page_id is not null and html is not null")
    ids = keep(bounded_sample(own.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("one")), "one", sample)
               .select(F.col("doc_id").alias("page_id"), "one"), "page-sample")
    row = own.join(ids, "page_id").groupBy("one").applyInPandas(_train_task, "w array<double>").first()
    return np.array(row.w) if row else DEFAULT


def extract_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = pages.sparkSession.sparkContext.broadcast(fitted_weights(pages, sample))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h, model.value) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInPandas(
        scan, "page_id long, url string, text string, n_chars long")
