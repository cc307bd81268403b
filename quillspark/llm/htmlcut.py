"""Main text of web pages by minimum cut.

A page is read once into blocks of text with their place in the element tree. A logistic model gives the cost of calling a
block article or boilerplate: the capacities to the two terminals. It adds up a block's looks (length, links, punctuation,
tag), its place against the container that holds most of the page's text, and what its elements say: names of classes and
ids in degrees, and elements whose meaning HTML fixes. Each of these is bounded, and so is their sum; nothing decides
alone, so an article stays one in an element that is called ``menu`` if it holds the page's text and heading, and a
container behind the article goes whatever it is called. Names of states ("has-sidebar", "comments-open") say nothing.
Neighbours in page order and like blocks under one parent are joined by smoothness edges, stronger the nearer they stand in
the tree. The minimum cut labels all blocks of a page together.

The model is fitted on a bounded sample of pages. Labels are blocks in elements whose meaning HTML fixes (``nav``,
``footer``, ``article`` ...), which the fit does not see. Blocks that only have a telling name join in a second fit, labelled
by what the first makes of them; so names get the weight that looks and place bear out.

Defined results: null or empty html gives an empty text, as does a page of boilerplate only; unclosed and stray tags are
taken as browsers do for blocks; text outside any tag is a block; repeated rows have equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Element names of HTML by their part in a page.
SKIPPED = frozenset("script style title noscript template textarea select svg math iframe object video audio canvas".split())
BLOCKS = frozenset(
    "html head body article main section div nav header footer aside form fieldset menu dialog ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "p pre h1 h2 h3 h4 h5 h6 blockquote figure figcaption details summary address hr center button label".split()
)
VOID = frozenset("hr br img input meta link source wbr area base col embed param track".split())
CLOSED_BY_NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dl table".split())
HARD_TAGS = frozenset("nav footer aside menu dialog button".split())
SOFT_TAGS = frozenset("form fieldset label".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
HARD_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar comment comments disqus replies respond cookie cookies consent gdpr newsletter related "
    "recommended pagination pager".split()
)
SOFT_NAMES = frozenset(
    "banner rail aside footer header masthead topbar toolbar discussion notice notification alert popup modal overlay subscribe subscription signup login "
    "share sharing social widget form search copyright disclaimer legal skip reply".split()
)
CONTENT_NAMES = frozenset("article main content post entry story body text".split())
# Words that may stand beside a name without changing what it means, and words that make it a state of the page.
BESIDE = frozenset(
    "site page global top bottom left right upper lower primary secondary inner outer box list item items area section block container wrapper wrap slot unit "
    "bar panel group row col column link links icon icons title inline sticky fixed mobile desktop user first last small large".split()
)
STATES = frozenset("with without has have no not is show hide enable enabled disable disabled open closed on off".split())
CONTAINERS = frozenset("article main section div nav header footer aside form details dialog".split())

WEAK, SOFT, HARD, ADVERT = 1, 2, 3, 4


def name_says(name: str) -> int:
    """What a class or id says: -1 for article, WEAK to ADVERT for boilerplate, 0 for nothing."""
    parts = [x.lower() for x in NAME_PARTS.findall(name)]
    parts = [x for x in parts if not x.isdigit()]
    if not parts or len(parts) > 1 and not STATES.isdisjoint(parts):
        return 0
    advert, hard, soft, good = (any(x in names for x in parts) for names in (ADVERT_NAMES, HARD_NAMES, SOFT_NAMES, CONTENT_NAMES))
    foreign = any(x not in ADVERT_NAMES | HARD_NAMES | SOFT_NAMES | CONTENT_NAMES | BESIDE for x in parts)
    if advert or hard or soft:
        if good and not (advert or hard):
            return 0  # the head of an article, not of the page
        return WEAK if foreign else ADVERT if advert else HARD if hard else SOFT
    return -1 if good and not foreign else 0


class Said(NamedTuple):
    """What the elements around a block say."""

    mark: int = 0  # by HTML: SOFT or HARD for boilerplate
    name: int = 0  # by names: WEAK to ADVERT
    good: bool = False  # a name of articles
    content: int = 0  # 1 in main, 2 in article


def read_element(tag: str, attributes: str, around: Said) -> tuple[Said, str]:
    """What holds inside an element, by what it says of itself and what holds around it; its name."""
    mark, names, classes, ident, lifts, lifts_all = 0, [], "", "", tag == "article", tag == "main"
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role" and value.lower() in BOILERPLATE_ROLES:
                mark = HARD
            elif key == "role" and value.lower() in ("main", "article"):
                lifts, lifts_all = True, lifts_all or value.lower() == "main"
            elif key == "hidden" and not value or key == "aria-hidden" and value.lower() == "true":
                mark = HARD
            elif key == "style" and "display:none" in value.replace(" ", "").lower():
                mark = HARD
            elif key in ("class", "id"):
                names += [name_says(x) for x in value.split()]
                classes, ident = (value, ident) if key == "class" else (classes, value)
    called = classes or ident.rstrip("0123456789")
    if tag in HARD_TAGS or tag == "header" and not (around.good or around.content):
        mark = HARD
    elif tag in SOFT_TAGS:
        mark = max(mark, SOFT)
    if tag in ("html", "body"):
        names = []
    name, good = max(names, default=0), -1 in names
    if tag == "p" or tag in HEADINGS:
        name, good = (name if name >= HARD else 0), False
    name = max(name, 0)
    if lifts_all:
        return Said(content=max(1, around.content)), called
    if lifts:
        mark, name = max(mark, around.mark), max(name, around.name)
        return Said(mark if mark == HARD else 0, name if name >= HARD else 0, False, 2 * (mark < HARD)), called
    content = around.content * (mark < HARD)
    if content and name == WEAK:
        name = 0
    return Said(max(mark, around.mark), max(name, around.name), mark < SOFT and name < SOFT and (good or around.good), content), called


class Block:
    __slots__ = ("text", "tag", "said", "depth", "common", "element", "link_chars", "group")

    def __init__(self, text, tag, said, depth, common, element, link_chars, group):
        self.text, self.tag, self.said, self.depth, self.common, self.element, self.link_chars, self.group = text, tag, said, depth, common, element, link_chars, group


def read_blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of text in page order, and the group that holds each group.

    ``common`` is the depth of the element that holds this block and the one before, ``element`` the number of the parent
    of its own element. A group is a container, together with its siblings of the same tag and name; a ``div`` or
    ``section`` without a name is none.
    """
    out: list[Block] = []
    stack: list[tuple[str, Said, int, int]] = [("", Said(), 0, 0)]  # tag, what holds inside, number, group
    groups: dict[tuple[int, int, str, str], int] = {}
    holders = [0]
    parts: list[str] = []
    links, link_chars, elements, lowest = 0, 0, 0, 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, link_chars, lowest
        text = " ".join("".join(parts).split())
        if text:
            tag, said, _, group = stack[-1]
            out.append(Block(text, tag, said, len(stack), lowest, stack[-2][2] if len(stack) > 1 else 0, link_chars, group))
            lowest = len(stack)
        parts, link_chars = [], 0

    def add(text: str) -> None:
        nonlocal link_chars
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        if links:
            link_chars += len(text)

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag in SKIPPED:
            if not closing and not m[0].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if stack[-1][0] == "p":
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSED_BY_NEXT.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in LISTS or tag not in CLOSED_BY_NEXT:
                    break
            lowest = min(lowest, len(stack))
            elements += 1
            said, called = read_element(tag, m[3] or m[6] or "", stack[-1][1])
            group = stack[-1][3]
            if tag in CONTAINERS and (called or tag not in ("div", "section")):
                key = (group, stack[-1][2], tag, called)
                if key not in groups:
                    groups[key] = len(holders)
                    holders.append(group)
                group = groups[key]
            stack.append((tag, said, elements, group))
        lowest = min(lowest, len(stack))
        if tag not in ("p", "li"):
            links = 0
    flush()
    return out, holders


#: Where the fit starts and what it is drawn to, by kind of evidence: bounds of the sum, then the weights.
#: Looks: long, unlinked, punctuated paragraphs are article.
LOOKS = (-2.5, 2.5), (-2.0, 0.8, -4.0, 0.5, 1.0, 2.0, -1.0, -0.5, -0.5)
#: Place: in the main group, before it, behind it with and without a heading, between its blocks.
PLACE = (-3.5, 2.0), (2.0, -1.5, -2.0, -3.0, -0.7)
#: Names: WEAK, SOFT, HARD, ADVERT, of articles. Advertising reads like an article, so its name says more.
NAMES = (-4.5, 1.5), (-0.3, -1.0, -2.5, -4.5, 1.0)
#: HTML: SOFT and HARD elements, ``article`` or ``main``. The fit leaves these as they are.
MARKS = (-4.5, 1.5), (-1.0, -4.5, 1.5)
KINDS = (LOOKS, PLACE, NAMES, MARKS)
PRIOR = np.array([w for _, weights in KINDS for w in weights])
STARTS = np.cumsum([0, *[len(weights) for _, weights in KINDS]]).tolist()
FITTED = STARTS[3]


def main_group(blocks: list[Block], holders: list[int]) -> tuple[int, set[int]]:
    """The group of most unlinked text, which counts less under telling names and twice with a main heading; what is around it."""
    mass, headed = [0.0] * len(holders), [False] * len(holders)
    for b in blocks:
        name = (0.0, *NAMES[1])[b.said.name] + (0.0, 0.0, *MARKS[1])[b.said.mark] + MARKS[1][2] * (b.said.content > 0)
        mass[b.group] += max(0, len(b.text) - 2 * b.link_chars) * math.exp(name)
        headed[b.group] |= b.tag == "h1"
    best = max(sorted({b.group for b in blocks}), key=lambda g: mass[g] * (1 + headed[g]))
    around, g = set(), best
    while g:
        g = holders[g]
        around.add(g)
    return best, around


def features(blocks: list[Block], holders: list[int]) -> np.ndarray:
    rows = np.zeros((len(blocks), len(PRIOR)))
    if not blocks:
        return rows
    main, around = main_group(blocks, holders)
    own = [k for k, b in enumerate(blocks) if b.group == main]
    whole = blocks[own[0]].said.content
    headed = {b.group for b in blocks if b.tag in HEADINGS}
    inside = [g == main for g in range(len(holders))]
    for g in range(1, len(holders)):
        inside[g] |= inside[holders[g]]
    for k, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        rows[k, : STARTS[1]] = (
            1.0,
            math.log1p(words),
            min(1.0, b.link_chars / n),
            b.text[-1] in ".!?…\"'»”",
            b.tag == "p",
            b.tag in HEADINGS,
            b.tag in ("li", "td", "th"),
            min(k, len(blocks) - 1 - k) == 0,
            words < 4,
        )
        place = 0 if b.group == main else 1 if k < own[0] else 4 if k < own[-1] else 2 if b.group in headed else 3
        if b.group not in around and b.group:  # the page itself tells nothing
            rows[k, STARTS[1] + place] = 1.0
        if b.said.name:
            rows[k, STARTS[2] + b.said.name - 1] = 1.0
        rows[k, STARTS[3] - 1] = b.said.good
        if b.said.mark:
            rows[k, STARTS[3] + b.said.mark - SOFT] = 1.0
        behind = place == 3 and (inside[b.group] or b.said.content < whole)  # hangs at the end of an article, or follows it in main
        rows[k, STARTS[4] - 1] = b.said.content > 0 and not behind
    return rows


def costs(rows: np.ndarray, weights: np.ndarray, *, most: float = 4.0) -> np.ndarray:
    """What calling each block boilerplate costs more than calling it article; every kind of evidence within its bounds."""
    kinds = [np.clip(rows[:, a:b] @ weights[a:b], *bounds) for (bounds, _), a, b in zip(KINDS, STARTS, STARTS[1:])]
    return np.clip(sum(kinds), -most, most)


def fit(rows: np.ndarray, labels: np.ndarray, *, strength: float = 0.02, steps: int = 25) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to PRIOR; both classes weigh the same. Labels may lie between 0 and 1.

    Kinds of evidence are fitted one after another, each to what those before leave open, so that looks are worth what
    they are worth alone.
    """
    weights = PRIOR.copy()
    if not len(labels) or not 0 < labels.mean() < 1:
        return weights
    share = labels * 0.5 / labels.mean() + (1 - labels) * 0.5 / (1 - labels.mean())
    draw, known = 5.0 + strength * len(labels), np.zeros(len(labels))
    for (bounds, prior), a, b in zip(KINDS[:3], STARTS, STARTS[1:]):
        x, w = rows[:, a:b], np.array(prior)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(known + x @ w, -30, 30)))
            slope = x.T @ (share * (p - labels)) + draw * (w - prior)
            w = w - np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + draw * np.eye(b - a), slope)
        weights[a:b], known = w, known + np.clip(x @ w, *bounds)
    return weights


def train(pages: DataFrame, *, sample_pages: int = 400, page_bytes: int = 1 << 20, page_blocks: int = 200) -> np.ndarray:
    """Fit the model on about ``sample_pages`` pages of up to ``page_bytes``, those of smallest hash (the documented bound)."""
    n = pages.count()
    bound = (1 << 63) - 1 if n <= sample_pages else int((sample_pages / n * 2 - 1) * ((1 << 63) - 1))
    few = pages.where((F.xxhash64("page_id") <= bound) & (F.octet_length("html") <= page_bytes)).select("html")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page in batch["html"]:
                blocks, holders = read_blocks(page)
                told = [b.said.mark == HARD or b.said.content > 0 or bool(b.said.name) or b.said.good for b in blocks]
                some = [x for x, t in zip(features(blocks, holders).tolist(), told, strict=True) if t][:page_blocks]
                yield pd.DataFrame({"x": some})

    found = np.array([r.x for r in few.mapInPandas(rows, "x array<double>").collect()])
    return learn(found) if len(found) else PRIOR.copy()


def learn(rows: np.ndarray) -> np.ndarray:
    """Weights from blocks that elements label, then also from those that are only named."""
    soft, hard, content = rows[:, FITTED:].T > 0
    named = rows[:, STARTS[2] + HARD - 1 : STARTS[2] + ADVERT].any(axis=1)
    labelled = hard | content & ~named & ~soft
    first = fit(rows[labelled], (content & ~hard)[labelled].astype(float))
    guess = 1 / (1 + np.exp(-costs(rows, first)))
    return fit(rows, np.where(labelled, (content & ~hard).astype(float), guess))


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side. ``unary`` > 0 is capacity from the source, < 0 to the sink.

    A node whose terminal outweighs all its edges keeps that side in every minimum cut; such nodes are settled first, one
    after another, and their edges become terminals of their neighbours. Augmenting paths settle what is left.
    """
    n = len(unary)
    unary = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if side[k] is None and abs(unary[k]) >= sum(near[k].values()):
            side[k] = unary[k] > 0
            for other, w in near[k].items():
                del near[other][k]
                unary[other] += w if side[k] else -w
                queue.append(other)
            near[k] = {}
    left = [k for k in range(n) if side[k] is None]
    if not left:
        return [bool(x) for x in side]
    source, sink = n, n + 1
    flow: dict[int, dict[int, float]] = {k: dict(near[k]) for k in left} | {source: {}, sink: {}}
    for k in left:
        if unary[k] > 0:
            flow[source][k], flow[k][source] = unary[k], 0.0
        elif unary[k] < 0:
            flow[k][sink], flow[sink][k] = -unary[k], 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            k = queue.popleft()
            for other, room in flow[k].items():
                if room > 1e-9 and other not in came:
                    came[other] = k
                    queue.append(other)
        if sink not in came:
            break
        path, k = [], sink
        while k != source:
            path.append((came[k], k))
            k = came[k]
        room = min(flow[a][b] for a, b in path)
        for a, b in path:
            flow[a][b] -= room
            flow[b][a] = flow[b].get(a, 0.0) + room
    for k in left:
        side[k] = k in came
    return [bool(x) for x in side]


def main_text(page: str, weights: np.ndarray, *, smoothness: float = 1.0) -> str:
    """The page's article: blocks on the article's side of the minimum cut, in page order."""
    blocks, holders = read_blocks(page)
    if not blocks:
        return ""
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            border = 0.25 if b.group != blocks[k - 1].group or b.said != blocks[k - 1].said else 1.0  # a container or a name begins or ends here
            like = 2.0 if blocks[k - 1].tag in HEADINGS else 1.0 if blocks[k - 1].tag == b.tag else 0.5  # a heading goes with what it heads
            steps = b.depth + blocks[k - 1].depth - 2 * b.common  # through the tree; 2 between siblings
            edges.append((k - 1, k, like * border * smoothness * 0.5 ** max(0, steps - 2)))
        twin = (b.element, b.tag)
        if twin in last and last[twin] != k - 1:
            edges.append((last[twin], k, smoothness))
        last[twin] = k
    keep = minimum_cut(costs(features(blocks, holders), weights).tolist(), edges)
    return " ".join(b.text for b, kept in zip(blocks, keep, strict=True) if kept)


def extract(pages: DataFrame, weights: np.ndarray, *, smoothness: float = 1.0) -> DataFrame:
    """Per page (page_id, url, html): page_id, url, text, n_chars (code points)."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page or "", weights, smoothness=smoothness) for page in batch])

    found = pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
