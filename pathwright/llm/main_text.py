"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags). A logistic classifier over block features gives the
chance that a block is content; its costs are the capacities from the source (content) and to the sink (boilerplate).
Neighbouring blocks, and blocks next to each other in one container, are joined by smoothness edges that weigh more the
closer they are in the DOM. The maximum flow's cut is the cheapest labelling. Elements that are boilerplate by their
meaning (menus, footers, forms, adverts, comments, ...) are bound to the sink, however long they are. Not so wrappers: if a page (or a
wrapper) has no prose and no article outside such elements, the one of them that holds main, or else headings and most prose, wraps the
main text; menus, footers, dialogs and comments never do. Nor is main boilerplate within such an element, nor an article if no
other article is clear of all.

The classifier starts from PRIOR and is fitted on the blocks of a bounded sample of pages (SAMPLE_PAGES, none of more than SAMPLE_CHARS characters) whose structure
tells what they are; every such block counts twice, once without its structural features, so that it also learns to do
without them. Pages are processed whole.

Defined results: a null, empty or textless page has an empty text; unclosed tags and comments end with the page or, as
for p and li, with the next of their kind; every row gives one row, repeated rows too."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_scan

SAMPLE_PAGES = 300
SAMPLE_CHARS = 200_000
NEAR, DOM = 0.6, 0.9
PULL = 0.05

#: HTML elements by what they mean here.
UNSEEN = frozenset("head script style noscript template title svg math canvas iframe object embed select option datalist textarea button audio video map".split())
RAW = frozenset("script style noscript template title textarea iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav footer aside form dialog menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments disqus respond reply replies cookie cookies consent gdpr notice notices footer"
    " masthead menu nav navbar navigation newsletter subscribe pagination pager popup modal overlay promo promotion related recommended share sharing social sidebar sponsor sponsored login signup skip toolbar widget".split()
)
#: Elements, roles and names that hold no main text, whatever stands around them; other names may tell of a wrapper's state.
FIRM = frozenset("nav footer dialog menu navigation contentinfo alertdialog menubar".split())
FIRM_NAMES = frozenset("comment comments disqus respond reply replies".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
GOOD_NAMES = frozenset("article articlebody content entry main post story text body maincontent".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}}

_TOKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<!\[CDATA\[|<[!?/]")
_VALUE = re.compile(r">|=\s*(?:([\"'])|[^\s>\"'][^\s>]*)?")
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME = re.compile(r"[^a-z0-9]+")

FEATURES = ("one", "in_article", "good_name", "heading", "paragraph", "item", "links", "words", "sentences", "short")
STRUCTURE = slice(1, 3)
#: Where the fit starts and what it is pulled to.
PRIOR = np.array([-0.5, 3.5, 1.5, 0.8, 1.0, -0.6, -3.5, 0.9, 0.8, -0.6])


class Block:
    __slots__ = ("article", "bad", "chars", "common", "container", "depth", "good", "linked", "root", "tag", "text")


class Roots:
    """The elements of a page that are boilerplate by their meaning, each below the one that holds it. A block's or element's root is
    (number or -1, whether an article and whether a main stands between)."""

    def __init__(self):
        self.above: list[tuple[int, bool, bool]] = []
        self.firm: list[bool] = []  # never a wrapper of the main text

    def judge(self, blocks: list[Block]) -> None:
        """Sets bad of each block. Nothing here depends on how long a part is, but for the choice between several possible wrappers."""
        n = len(self.above)
        if not n:
            for b in blocks:
                b.bad = False
            return
        told = [False] * (n + 1)  # content among an element's own blocks, outside boilerplate in it; the last place is the page's
        heading, prose, clear = [False] * n, [0] * n, [0] * n
        clear_total = 0
        for b in blocks:
            k, article, main = b.root
            free = b.article and (k < 0 or main)
            clear_total += free
            content = prose_like(b)
            told[k] |= content or article or (k < 0 and b.article)
            if k >= 0:
                clear[k] += free
                heading[k] |= b.tag in HEADINGS
                prose[k] += b.chars * content
        for k in range(n - 1, -1, -1):
            if (up := self.above[k][0]) >= 0:
                clear[up] += clear[k]
                heading[up] |= heading[k]
                prose[up] += prose[k]
        wrapper, level = [False] * n, -1
        inner: dict[int, list[int]] = {}
        for k in range(n):
            if clear[k] or (prose[k] and not self.firm[k]):
                inner.setdefault(self.above[k][0], []).append(k)
        while not told[level]:
            some = inner.get(level)
            if not some:
                break
            level = max(some, key=lambda k: (clear[k] > 0, heading[k], prose[k], -k))
            wrapper[level] = True
        near, far = [False] * n, [False] * n  # bad up to the next article or main, and up to the next main
        for k, (up, article, main) in enumerate(self.above):
            near[k] = not wrapper[k] or (up >= 0 and not article and near[up])
            far[k] = not wrapper[k] or (up >= 0 and not main and far[up])
        for b in blocks:
            k, article, main = b.root
            b.bad = k >= 0 and ((not article and near[k]) or (clear_total > 0 and not main and far[k]))


def prose_like(b: Block) -> bool:
    """Sentences that PRIOR takes for content by the block alone."""
    if b.tag in HEADINGS or b.text.count(" ") < 3 or not any(c in b.text for c in ".!?;。"):
        return False
    x = features([b])[0]
    x[STRUCTURE] = 0
    return float(x @ PRIOR) > 0


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the > is that ends a tag; quotation marks count after =. -1 if a value has no end; dead keeps the marks that lead there."""
    seen = []
    while m := _VALUE.search(page, at):
        if m.group() == ">":
            return m.start()
        at = m.end()
        if m.group(1):
            if m.start(1) in dead:
                break
            seen.append(m.start(1))
            at = page.find(m.group(1), at) + 1
            if not at:
                break
    dead.update(seen)
    return -1


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order; their texts have single spaces and decoded references."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple] = []  # (tag, number, bad, good, article, unseen)
    roots, dead, top = Roots(), set(), ("", 0, (-1, False, False), False, False, False)
    state = top
    held: list[str] = []
    linked = numbers = 0
    outer: list[tuple] = []  # those of stack that are not inline
    opened: dict[str, int] = {}
    low = 0  # the least depth since the last block: so many elements hold both that block and the next one

    def drop() -> str:
        nonlocal low
        tag = stack.pop()[0]
        opened[tag] -= 1
        if tag not in INLINE:
            outer.pop()
            low = min(low, len(outer))
        return tag

    def flush():
        nonlocal held, linked, low
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                b = Block()
                b.text, b.chars, b.linked = text, len(text), min(linked, len(text))
                b.tag = outer[-1][0] if outer else ""
                b.root, b.good, b.article = state[2], state[3], state[4]
                b.container = outer[-2][1] if len(outer) > 1 else 0
                b.depth, b.common = len(outer), low
                low = len(outer)
                out.append(b)
        held, linked = [], 0

    def take(raw: str):
        nonlocal linked
        if raw and not state[5]:
            held.append(raw)
            if opened.get("a"):
                linked += len(raw)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        tag = m.group(2)
        if tag is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m.group(), ">")
            stop = page.find(close, m.end())
            at = stop + len(close) if stop >= 0 else end
            continue
        stop = page.find(">", m.end())
        if stop < 0:  # a tag that the page's end cuts off
            break
        attrs = page[m.end() : stop]
        double, single = attrs.count('"'), attrs.count("'")
        if double % 2 or single % 2 or (double and single):
            longer = tag_end(page, m.end(), dead)
            if longer >= 0:
                stop = longer
                attrs = page[m.end() : stop]
        at = stop + 1
        tag = tag.lower()
        if m.group(1):
            if opened.get(tag):
                if tag not in INLINE:
                    flush()
                while stack:
                    gone = drop()
                    if gone == tag:
                        break
                state = stack[-1] if stack else top
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br" or tag == "hr":
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            flush()
            closes = CLOSES.get(tag) or ({"p"} if tag not in INLINE else set())
            bounds = BOUNDS.get(tag, set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    while len(stack) > k:
                        drop()
                    break
                if stack[k][0] in bounds or (stack[k][0] not in INLINE and closes == {"p"}):
                    break
            state = stack[-1] if stack else top
        numbers += 1
        root, bad, good, article, unseen = state[2], False, state[3], state[4], state[5] or tag in UNSEEN
        firm = tag in FIRM
        main = tag == "main"
        fresh = main or tag == "article"
        if tag in ("article", "main"):
            article = True
        elif tag in ASIDE or (tag == "header" and not article):
            bad = True
        if attrs and len(attrs) > 3:
            for a in _ATTR.finditer(attrs):
                name = a.group(1).lower()
                if name in ("class", "id"):
                    words = [w for w in _NAME.split((a.group(2) or a.group(3) or a.group(4) or "").lower()) if w]
                    named = [w for k, w in enumerate(words) if not (k and words[k - 1] in ("has", "with", "no", "without"))]
                    if tag not in ("article", "main", "body", "html") and any(w in BAD_NAMES for w in named):
                        bad = True
                        firm = firm or any(w in FIRM_NAMES for w in named)
                    good = good or any(w in GOOD_NAMES for w in named)
                elif name == "role":
                    role = (a.group(2) or a.group(3) or a.group(4) or "").lower()
                    bad, firm = bad or role in ROLES, firm or role in FIRM
                    article = article or role in ("main", "article")
                    main, fresh = main or role == "main", fresh or role in ("main", "article")
                elif name == "hidden" or (name == "aria-hidden" and "true" in a.group(0).lower()) or (name == "style" and re.search(r"display\s*:\s*none", a.group(0), re.I)):
                    unseen = True
        if attrs.endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if fresh:
            root = (root[0], True, root[2] or main)
        if bad:
            roots.above.append(root)
            roots.firm.append(firm)
            root = (len(roots.above) - 1, False, False)
        state = (tag, numbers, root, good, article, unseen)
        stack.append(state)
        opened[tag] = opened.get(tag, 0) + 1
        if tag not in INLINE:
            outer.append(state)
    flush()
    roots.judge(out)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        x[i] = (
            1, b.article, b.good, b.tag in HEADINGS, b.tag in ("", "body", "p", "blockquote", "pre", "figcaption", "td", "dd"), b.tag in ("li", "dt", "th"),
            b.linked / b.chars, min(1.0, np.log1p(words) / 4), min(1.0, sum(map(b.text.count, ".!?;")) / 3), words < 4,
        )
    return x


def fit(pages: list[str]) -> np.ndarray:
    xs, ys = [], []
    for page in pages:
        blocks = blocks_of(page)
        known = [k for k, b in enumerate(blocks) if b.bad or b.article]
        if any(b.article for b in blocks) and known:
            x = features(blocks)[known]
            without = x.copy()
            without[:, STRUCTURE] = 0
            y = np.array([not blocks[k].bad for k in known], float)
            xs += [x, without]
            ys += [y, y]
    w = PRIOR.copy()
    if not xs:
        return w
    x, y = np.concatenate(xs), np.concatenate(ys)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 1.0 * (x.T @ (weight * (p - y)) + PULL * (w - PRIOR))
    return w


def cut(content: list[float], other: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of the source in a minimum cut: node i costs other[i] if it is on the source's side, content[i] if not.

    Flow over source-node-sink paths is cancelled at once. The rest is pushed along shortest augmenting paths, found
    breadth first from all nodes that still have supply; a node's level is not searched again once nothing more passes."""
    n = len(content)
    excess = [c - o for c, o in zip(content, other, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    tiny = 1e-12
    while True:
        parent = {i: -1 for i in range(n) if excess[i] > tiny}
        queue, reached = list(parent), []
        for i in queue:
            if excess[i] < -tiny:
                reached.append(i)
                continue
            for j, room in near[i].items():
                if room > tiny and j not in parent:
                    parent[j] = i
                    queue.append(j)
        if not reached:
            return [i in parent for i in range(n)]
        for sink in reached:
            push, i = -excess[sink], sink
            while parent[i] >= 0:
                push = min(push, near[parent[i]][i])
                i = parent[i]
            push = min(push, excess[i])
            if push <= tiny:
                continue
            excess[i] -= push
            excess[sink] += push
            i = sink
            while parent[i] >= 0:
                near[parent[i]][i] -= push
                near[i][parent[i]] += push
                i = parent[i]


def graph(blocks: list[Block], weights: np.ndarray) -> tuple[list[int], list[float], list[float], list[tuple[int, int, float]]]:
    """The blocks that are not bound to the sink, what each costs as boilerplate and as content, and the edges between them."""
    z = np.clip(features(blocks) @ weights, -12, 12)
    gain, loss = np.logaddexp(0, z).tolist(), np.logaddexp(0, -z).tolist()  # -log of boilerplate's and content's chance
    keep = [i for i, b in enumerate(blocks) if not b.bad]
    place = {i: k for k, i in enumerate(keep)}
    content, other = [gain[i] for i in keep], [loss[i] for i in keep]
    edges: list[tuple[int, int, float]] = []

    def join(i: int, j: int, weight: float):
        if i in place and j in place:
            edges.append((place[i], place[j], weight))
        elif i in place:
            other[place[i]] += weight  # the other end is boilerplate for certain
        elif j in place:
            other[place[j]] += weight

    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            join(i - 1, i, NEAR * b.common / max(1, a.depth, b.depth))
        j = last.get(b.container)
        if j is not None and not (b.bad or blocks[j].bad):
            join(j, i, DOM)
        last[b.container] = i
    return keep, content, other, edges


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep, content, other, edges = graph(blocks, weights)
    side = cut(content, other, edges)
    return " ".join(blocks[i].text for i, s in zip(keep, side, strict=True) if s)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    span = 1 << 30
    share = min(span, int(span * 2 * SAMPLE_PAGES / max(1, df.count())))  # so that tasks send the driver few pages more than it takes
    drawn = df.where((F.length("html") > 0) & (F.length("html") <= SAMPLE_CHARS)).select("html", F.pmod(F.xxhash64("html"), F.lit(span)).alias("draw"))
    sample = drawn.where(F.col("draw") < share).orderBy("draw").limit(SAMPLE_PAGES)
    shared = df.sparkSession.sparkContext.broadcast(fit([r["html"] for r in sample.collect()]))

    def factory():
        weights = shared.value
        return lambda texts: [pa.array([main_text(t, weights) for t in texts], pa.string())]

    df = append_scan(df, "html", [T.StructField("text", T.StringType())], factory)
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
