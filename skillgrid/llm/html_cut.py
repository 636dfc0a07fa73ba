"""Main text of web pages by minimum cut.

A page is parsed into blocks of text. What a classifier and the markup say of a block become its capacities to the two terminals; neighbours in
page order, and the nearest blocks below the same element, are joined by smoothness edges that fall with their distance in the tree. The minimum
cut, found by maximum flow, separates content from boilerplate.

The classifier is a logistic model of a block's text (length, links, punctuation, place), at most ``TEXT`` either way. It learns from blocks whose own
elements tell content from boilerplate (``article``, ``main`` against ``nav``, ``footer``, ``aside`` and the like), fitted on a bounded sample: about
``SAMPLE_PAGES`` pages, chosen by a hash of the page, and ``SAMPLE_BLOCKS`` blocks of each at most, spread over it.

The markup counts ``MARKUP`` times its mark: the nearest element that has one counts in full, what encloses it a tenth of that, and so on. Elements and
roles mark by 1, a class or id by 1 if a whole name is known and by ``PART`` if a part of it is; names such as ``no-sidebar`` or ``has-banner`` and those of
``html`` and ``body`` mark nothing. On a page where nothing marks content, what a name or a ``form`` says fades as the element holds more than half of the page's long blocks.

Defined results: a null or empty page, or one without content, has an empty text; broken or unclosed markup is read as far as it goes, an open comment and a
marked section up to the next >; pages nested without end cost memory in proportion to their length; repeated rows stay; an empty table gives an empty one;
other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, SAMPLE_BLOCKS = 1500, 200

#: Elements that end a block where they begin and end.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page.
SILENT = frozenset("script style noscript template head title iframe svg object textarea select button".split())
#: What may stand in a head; anything else ends it, since its end tag is optional.
HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of few words that a page leaves open by mistake: a block of the second kind ends them.
SHORT = frozenset("title option select button".split())
ENDS_SHORT = frozenset("address article aside blockquote body dl figure footer h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer aside menu dialog search form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Names in a class or id that mark boilerplate or content.
MARKS = frozenset("ad ads advert adverts advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup popular promo recommended related reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
GOOD_MARKS = frozenset("article articlebody content entry entrycontent main maincontent post postcontent story storybody".split())
#: A name with one of these speaks of what a page has or shows, not of what the element is.
ABOUT = frozenset("no not non has have hide hides with without is show shows on off open close closed".split())
#: Characters from which a block counts towards what an element holds of its page's text.
LONG = 80
#: Capacity of a mark, most of the classifier's, of smoothness between neighbours and between blocks of one element; and the weights of a mark by a part of a name and of the mark around a mark.
MARKUP, TEXT, NEAR, SAME = 4.0, 2.5, 1.0, 0.5
PART, AROUND = 0.6, 0.1

#: Weights of a plain rule (long, few links), which a fit of few pages stays near.
PRIOR = np.array([-1.5, 3.0, -4.0, 2.0, 2.0, 1.0, 0.0, 0.5, -1.0])

CAMEL = re.compile("([a-z0-9])([A-Z])")
BEGUN, ZEROS, HUGE = re.compile("<[A-Za-z/!?]"), re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")


def named(value: str) -> float:
    """What the names of a class or id say: the strongest of them, boilerplate before content."""
    said = 0.0
    for name in CAMEL.sub(r"\1-\2", value).lower().replace("_", "-").split():
        parts = [p for p in name.split("-") if p]
        if not ABOUT.isdisjoint(parts):
            continue
        bad, good = not MARKS.isdisjoint(parts), not GOOD_MARKS.isdisjoint(parts)
        if name in MARKS:
            return -1.0
        if "".join(parts) in GOOD_MARKS:
            said = 1.0 if said >= 0 else said
        elif bad and not good:
            said = -PART if said < 1 else said
        elif good and not bad:
            said = PART if said == 0 else said
    return said


def mark(tag: str, attrs: list) -> tuple[float, bool]:
    """What an element says about the text in it, from -1 to 1; and whether its tag or role says so."""
    by_name = 0.0
    for key, value in attrs:
        if key == "hidden" or value and (key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true"):
            return -1.0, True
        if value and key in ("class", "id") and tag not in ("html", "body"):
            said = named(value)
            by_name = said if abs(said) > abs(by_name) or said == -1 else by_name
    if tag in BOILERPLATE:
        return -1.0, True
    if tag in CONTENT:
        return (-1.0, False) if by_name == -1 else (1.0, True)
    return by_name, False


class Blocks(HTMLParser):
    """Blocks of a page, and its elements: each block knows its text, characters within links, element, tag and distance in the tree to the block before."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag and number of the open elements
        self.open: Counter = Counter()
        self.silent, self.low = 0, 0  # low: fewest open elements since the last block
        self.text: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, int, int, str, int]] = []
        self.last_depth = 0
        # of each element, the first being the page: the one around it, its mark, whether its tag says so, the nearest that has a mark
        self.around, self.marks, self.sure, self.nearest = [0], [0.0], [False], [0]
        self.forms: set[int] = set()

    def end_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            depth = len(self.stack)
            self.low = min(self.low, depth)
            tag = next((t for t, _ in reversed(self.stack[-8:]) if t in BLOCK), "")
            self.blocks.append((text, self.linked, self.stack[-1][1] if self.stack else 0, tag, depth + self.last_depth - 2 * self.low))
            self.last_depth = self.low = depth
        self.text, self.linked = [], 0

    def end_open(self, tag):
        """End what the start of ``tag`` implies: a head, and elements of few words left open."""
        if self.open["template"] or self.open["svg"]:
            return
        if self.open["head"] and tag not in HEAD and not self.open["noscript"]:
            self.handle_endtag("head")
        if tag in ENDS_SHORT:
            for name in SHORT:
                if self.open[name]:
                    self.handle_endtag(name)

    def handle_starttag(self, tag, attrs):
        self.end_open(tag)
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            self.end_block()
        if tag in VOID:
            return
        if tag in ("p", "li") and self.open[tag]:  # these end one another
            for name, _ in reversed(self.stack):
                if name == tag:
                    self.handle_endtag(tag)
                    break
                if name in BLOCK:
                    break
        said, sure = mark(tag, attrs)
        above = self.stack[-1][1] if self.stack else 0
        if tag == "header" and not said:
            said, sure = (-1.0, True) if self.marks[self.nearest[above]] <= 0 else (0.0, False)
        number = len(self.around)
        self.around.append(above)
        self.marks.append(said)
        self.sure.append(sure)
        self.nearest.append(number if said else self.nearest[above])
        if tag == "form":
            self.forms.add(number)
        self.stack.append((tag, number))
        self.open[tag] += 1
        self.silent += tag in SILENT

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_block()
        if not self.open[tag]:
            return
        while self.stack:
            name = self.stack.pop()[0]
            self.open[name] -= 1
            self.silent -= name in SILENT
            if name == tag:
                break
        self.low = min(self.low, len(self.stack))

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():  # text ends a head, too
            self.handle_endtag("head")
        if not self.silent:
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(data)

    def parse_comment(self, i, report=1):
        return super().parse_comment(i, report) if i <= self.last_comment else self.parse_bogus_comment(i)

    def parse_html_declaration(self, i):  # the parser raises on sections that it doesn't know
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


def page_of(html: str | None) -> Blocks:
    page = Blocks()
    if html:
        html = HUGE.sub("\ufffd", ZEROS.sub("&#", html))
        whole = html.rfind(">") + 1
        begun = BEGUN.search(html, whole)  # a tag that never ends would be looked at again and again
        html = html[: begun.start()] if begun else html
        page.last_comment = html.rfind("-->")
        page.feed(html)
        page.close()
        page.end_block()
    return page


def blocks_of(html: str | None) -> list[tuple[str, int, int, str, int]]:
    return page_of(html).blocks


def marks_of(page: Blocks) -> np.ndarray:
    """The mark of each block: that of the nearest marked element, and a tenth of what is around it."""
    held = [0] * len(page.around)
    for text, _, element, _, _ in page.blocks:
        held[element] += len(text) * (len(text) >= LONG)
    for e in range(len(held) - 1, 0, -1):  # elements come after those around them
        held[page.around[e]] += held[e]
    fade = not any(m > 0 for m in page.marks)
    value, form = [0.0] * len(held), page.forms
    for e in range(1, len(held)):
        own, above = page.marks[e], value[page.around[e]]
        if own < 0 and fade and (e in form or not page.sure[e]):
            own *= min(1.0, 2 - 2 * held[e] / max(1, held[0]))
        value[e] = own + AROUND * above if page.marks[e] else above
    return np.array([value[b[2]] for b in page.blocks])


def features(blocks: list) -> np.ndarray:
    """What the classifier sees of each block; no element names, so that it also judges pages without telling markup."""
    n = len(blocks)
    out = np.zeros((n, 9))
    total = sum(len(b[0]) for b in blocks) or 1
    for i, (text, linked, _, tag, _) in enumerate(blocks):
        size = len(text)
        words = text.count(" ") + 1
        out[i] = (1, np.log1p(size) / 8, min(1.0, linked / size), min(1.0, 10 * sum(map(text.count, ".,;!?")) / size), min(1.0, words / 40), size / total, i / n, tag in ("p", "blockquote", "pre"), "©" in text or "|" in text)
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the logistic model; without pages that tell, those of a plain rule (long, few links)."""
    total = pages.count()
    if not total:
        return PRIOR
    # pages that are equal in all count once
    key = F.xxhash64(F.col(id_col), F.col(html_col))
    chosen = pages.select(key.alias("key"), F.col(html_col).alias("html")).where(F.pmod("key", F.lit(1 << 30)) / (1 << 30) < min(1.0, sample_pages / total))
    sample = chosen.groupBy("key").agg(F.first("html").alias("html")).select("html")

    def run(batches):
        for batch in batches:
            for html in batch.column(0).to_pylist():
                page = page_of(html)
                by = [page.nearest[b[2]] for b in page.blocks]
                said = np.array([page.marks[e] if page.sure[e] else 0.0 for e in by])
                told = np.flatnonzero(said)
                if len(told):
                    told = told[np.unique(np.linspace(0, len(told) - 1, SAMPLE_BLOCKS).astype(int))]
                    yield pa.RecordBatch.from_arrays([pa.array(features(page.blocks)[told].tolist(), pa.list_(pa.float64())), pa.array(np.sign(said[told]), pa.int32())], ["x", "y"])

    rows = sample.mapInArrow(run, "x array<double>, y int").toArrow()
    if not rows.num_rows or len(set(rows["y"].to_pylist())) < 2:
        return PRIOR
    x, y = np.array(rows["x"].to_pylist()), rows["y"].to_numpy() > 0
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, hold = PRIOR.copy(), min(1.0, 20 / len(y))
    for _ in range(30):  # Newton steps; few rows hardly move the plain rule
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * p * (1 - p)
        grad = x.T @ (weight * (p - y)) / len(y) + hold * (w - PRIOR)
        w -= np.linalg.solve((x * s[:, None]).T @ x / len(y) + hold * np.eye(len(w)), grad)
    return w


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (True: source side) of the minimum cut with terminal capacities |gain| and undirected ``edges``.

    Blocks that no set of neighbours could turn are settled first and their edges become terminal capacity; what is left goes to maximum flow.
    """
    n = len(gain)
    gain, near = gain.astype(float).copy(), [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    label = np.zeros(n, bool)
    open_ = set(range(n))
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if i not in open_ or abs(gain[i]) <= sum(near[i].values()):
            continue
        label[i] = gain[i] > 0
        open_.discard(i)
        for j, w in near[i].items():
            gain[j] += w if label[i] else -w
            near[j].pop(i, None)
            queue.append(j)
        near[i] = {}
    while open_:  # what is left, piece by piece
        piece, queue = [], [open_.pop()]
        while queue:
            piece.append(queue.pop())
            new = near[piece[-1]].keys() & open_
            open_ -= new
            queue += new
        for i in source_side(piece, gain, near):
            label[i] = True
    return label


def source_side(piece: list[int], gain: np.ndarray, near: list[dict[int, float]]) -> list[int]:
    """Blocks of a connected piece that maximum flow, by shortest augmenting paths, leaves on the source's side."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in piece} | {source: {}, sink: {}}
    for i in piece:
        if gain[i] > 0:
            cap[source][i], cap[i][source] = gain[i], 0.0
        else:
            cap[i][sink], cap[sink][i] = -gain[i], 0.0
    while True:
        before, queue = {source: source}, deque([source])
        while queue and sink not in before:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-12 and j not in before:
                    before[j] = i
                    queue.append(j)
        if sink not in before:
            return [i for i in piece if i in before]
        path, j = [], sink
        while j != source:
            path.append((before[j], j))
            j = before[j]
        flow = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= flow
            cap[b][a] = cap[b].get(a, 0.0) + flow


def labels(page: Blocks, weights: np.ndarray) -> np.ndarray:
    """Which blocks of a page are content."""
    gain = np.clip(features(page.blocks) @ weights, -TEXT, TEXT) + MARKUP * marks_of(page)
    edges, last = [], {}
    for i, (_, _, element, _, distance) in enumerate(page.blocks):
        if i:
            edges.append((i - 1, i, NEAR * 0.6**distance))
        parent = page.around[element]
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SAME))
        last[parent] = i
    return minimum_cut(gain, edges)


def main_text(html: str | None, weights: np.ndarray) -> str:
    """The content blocks of one page, joined by spaces."""
    page = page_of(html)
    if not page.blocks:
        return ""
    return " ".join(b[0] for b, keep in zip(page.blocks, labels(page, weights)) if keep)


def extract(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    weights = fit(pages, id_col, html_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(h.as_py(), weights) for h in batch.column(2)], pa.string())], ["page_id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"page_id {kind}, url string, text string")
