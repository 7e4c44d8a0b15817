"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into text blocks with the places they have in the element tree. A logistic classifier
gives each block a cost for either label, which becomes its capacity to the source (content) or the
sink (boilerplate). Consecutive blocks and blocks under the same parent are joined by smoothness
edges. The minimum cut, found by maximum flow, separates content from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400  # bound of the sample of pages the classifier is fitted on
TRAIN_BLOCKS = 200  # blocks of a training page that are used
ADJACENT, SAME_PARENT = 0.6, 1.0

# Element names with a meaning for layout.
HIDDEN = frozenset("head script style noscript template title textarea select option button svg iframe object canvas audio video".split())
RAW = "script style noscript template textarea title iframe".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover menclose none semantics annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp data output font img br wbr input svg".split()) | MATH
# Elements of a page that end an open drawing when they start inside it.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CLOSES = {"li": ("li",), "dt": ("dd", "dt"), "dd": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# Words in class, id or role that speak for one side.
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs combx comment comments complementary contentinfo cookie cookies consent disqus footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted promotion related remark reply replies search share shares sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())

NAME = re.compile(r"/?([a-zA-Z][\w:-]*)")
# The rest of a tag with quoted values, and up to where such a scan is stuck.
QUOTED = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>")
STATES = re.compile(r"[\"'<]")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

# Weights before any page is seen: bias, log words, link share, sentence marks, paragraph, list item,
# heading, boilerplate word, content word.
PRIOR = np.array([-0.4, 0.5, -4.0, 1.5, 0.8, -0.6, 0.3, -7.0, 1.0])
CONTAINER = 9.0  # weight of a content or boilerplate element around the block
EXAMPLES = 200.0  # what the sample's examples of either kind weigh together, against one for the prior


@dataclass
class Block:
    parent: int
    tag: str
    content: int  # enclosing content elements
    boilerplate: int  # enclosing boilerplate elements
    cue: int  # of the nearest class word: 1 content, -1 boilerplate
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class Tags:
    """The tags of a page and the text between them, in time linear in the page.

    A quote that is never closed makes a scan run to the page's end. Such a scan passes each later tag
    with one of three states (no quote, either quote), and one without a quote would fail just the
    same: those tags are remembered, so that at most three scans run to the end.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.stuck: set[int] = set()

    def _end(self, start: int, at: int) -> int:
        """Behind the ``>`` of the tag that begins at ``start``: the first outside quotes, else the first."""
        if start not in self.stuck:
            found = QUOTED.match(self.page, at)
            if found:
                return found.end()
            quote = ""
            for m in STATES.finditer(self.page, at):
                mark = m[0]
                if mark == "<":
                    if not quote:
                        self.stuck.add(m.start())
                elif not quote:
                    quote = mark
                elif quote == mark:
                    quote = ""
        return self.page.find(">", at) + 1

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before, name, whether it closes, attributes); the name is empty behind the last tag.

        Comments, declarations and the contents of elements such as ``script`` are passed over.
        """
        page, size = self.page, len(self.page)
        text_from = at = 0
        while True:
            start = page.find("<", at)
            if start < 0:
                break
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                yield page[text_from:start], "", False, ""
                text_from = at = size if end < 0 else end + 3
                continue
            at = start + 1
            if start > self.last:
                continue  # no tag ends any more, but a comment may begin
            if page.startswith(("!", "?"), at):
                yield page[text_from:start], "", False, ""
                text_from = at = page.find(">", at) + 1
                continue
            name = NAME.match(page, at)
            if name is None:
                continue
            closing, own = page[at] == "/", name[1].lower()
            end = self._end(start, name.end())
            attributes = page[name.end() : end - 1]
            before, text_from, at = page[text_from:start], end, end
            self.raw = None if closing else RAW_END.get(own)
            yield before, own, closing, attributes
            if self.raw is not None:  # what it holds is no markup
                found = self.raw.search(page, end)
                text_from = at = found.end() if found else size
        yield page[text_from:], "", False, ""

    def keep_contents(self) -> None:
        """The element of the tag just given is whole: what follows is markup again."""
        self.raw = None


def _cue(attributes: str) -> int:
    found = ATTRIBUTE.findall(attributes) if "=" in attributes else ()
    words = {w for groups in found for w in re.split(r"[^a-z]+", "".join(groups).lower())}
    return -1 if words & BOILERPLATE_WORDS else 1 if words & CONTENT_WORDS else 0


@dataclass
class Element:
    name: str
    number: int
    cue: int  # its own, or that of the nearest element around it that has one
    block: int  # place of the nearest element, itself included, that is not inline; -1 without


class Open:
    """The open elements, with what is asked of them kept up to date, so that nothing walks them."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.content = self.boilerplate = self.hidden = self.links = 0

    def _shift(self, name: str, by: int) -> None:
        self.content += by * (name in CONTENT_TAGS)
        self.boilerplate += by * (name in BOILERPLATE_TAGS)
        self.hidden += by * (name in HIDDEN)
        self.links += by * (name == "a")

    def push(self, name: str, number: int, cue: int) -> None:
        top = self.stack[-1] if self.stack else None
        place = len(self.stack)
        block = place if name not in INLINE else top.block if top else -1
        self.stack.append(Element(name, number, cue or (top.cue if top else 0), block))
        self.places.setdefault(name, []).append(place)
        self._shift(name, 1)

    def pop_to(self, place: int) -> None:
        for element in self.stack[place:]:
            self.places[element.name].pop()
            self._shift(element.name, -1)
        del self.stack[place:]

    def nearest(self, name: str) -> int:
        """Place of the innermost open element of that name, -1 without."""
        places = self.places.get(name)
        return places[-1] if places else -1

    @property
    def block(self) -> Element | None:
        """The innermost open element that is not inline."""
        place = self.stack[-1].block if self.stack else -1
        return self.stack[place] if place >= 0 else None

    def drawing(self) -> int:
        """Place of the open drawing if what comes belongs to it, else -1."""
        place = self.nearest("svg")
        return place if place > self.nearest("foreignobject") else -1


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks in page order, white space collapsed, character references decoded, none empty."""
    opened = Open()
    done: list[Block] = []
    current: Block | None = None
    count = 0

    def end_block() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                done.append(current)
            current = None

    def add(raw: str) -> None:
        nonlocal current
        if opened.hidden or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            around = opened.block
            cue = opened.stack[-1].cue if opened.stack else 0
            current = Block(
                around.number if around else -1, around.name if around else "", opened.content, opened.boilerplate, cue
            )
        text = html.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if opened.links:
            current.linked += len(text)

    tags = Tags(page or "")
    for text, name, closing, attributes in tags:
        add(text)
        if not name:
            continue
        whole = attributes.rstrip().endswith("/")
        svg = opened.drawing() if opened.hidden else -1
        if not closing and name in RAW_END:
            if svg >= 0 and whole:  # in a drawing, <style/> or <title/> has no contents
                tags.keep_contents()
            continue
        if svg >= 0 and not closing and name in BREAKOUT:
            opened.pop_to(opened.places["svg"][0])
        elif svg >= 0 and not closing:
            # The parts of a drawing do not end the text around it.
            if not whole:
                count += 1
                opened.push(name, count, 0)
            continue
        elif svg >= 0 and opened.nearest(name) >= svg:
            opened.pop_to(opened.nearest(name))
            continue
        if name not in INLINE:
            end_block()
        elif name == "br" and current is not None:
            current.parts.append(" ")
        if closing:
            if opened.nearest(name) >= 0:
                opened.pop_to(opened.nearest(name))
            continue
        if name in VOID:
            continue
        around = opened.block
        if name not in INLINE and around is not None:
            # A paragraph ends at the next block element, list items and cells at the next of their kind.
            if around.name == "p" or around.name in CLOSES.get(name, ()):
                opened.pop_to(around.block)
        if whole and name in ("svg", "math"):
            continue
        count += 1
        opened.push(name, count, _cue(attributes))
    end_block()
    return done


def features(block: Block) -> list[float]:
    words = block.text.count(" ") + 1
    marks = sum(map(block.text.count, ".,;:!?"))
    return [
        1.0, float(np.log1p(words)), min(1.0, block.linked / len(block.text)), min(1.0, marks / words * 4),
        float(block.tag == "p"), float(block.tag == "li"), float(block.tag[:1] == "h" and block.tag[1:].isdigit()),
        float(block.cue < 0), float(block.cue > 0),
    ]


def cost(block: Block, weights: np.ndarray) -> float:
    """Log odds of content: the classifier's, and a fixed weight for meaningful elements around.

    Elements and class words that name a part of the page outweigh the classifier; where a page has
    none, as most blocks do, it decides.
    """
    odds = float(np.dot(weights, features(block)))
    if block.boilerplate:
        return odds - CONTAINER
    return odds + CONTAINER * (1 if block.content and block.cue >= 0 else 0)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in the page, and the nearest earlier block with the same parent."""
    last: dict[int, int] = {}
    out = []
    for k, block in enumerate(blocks):
        if k:
            out.append((k - 1, k, ADJACENT))
        if block.parent in last:
            out.append((last[block.parent], k, SAME_PARENT))
        last[block.parent] = k
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Side of each node in the cut that minimises lost costs plus cut edges (True: positive side).

    Nodes whose cost outweighs all their edges keep their side and turn their edges into costs of their
    neighbours; maximum flow decides the rest.
    """
    n = len(costs)
    cost, around = list(costs), [dict() for _ in range(n)]
    for a, b, w in edges:
        around[a][b] = around[a].get(b, 0.0) + w
        around[b][a] = around[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if side[v] is not None or abs(cost[v]) < sum(around[v].values()):
            continue
        side[v] = cost[v] > 0
        for u, w in around[v].items():
            del around[u][v]
            cost[u] += w if side[v] else -w
            queue.append(u)
    rest = [v for v in range(n) if side[v] is None]
    if rest:
        for v, positive in zip(rest, _flow([cost[v] for v in rest], [around[v] for v in rest], rest), strict=True):
            side[v] = positive
    return [bool(s) for s in side]


def _flow(cost: list[float], around: list[dict[int, float]], names: list[int]) -> list[bool]:
    """Source side of the minimum cut by Dinic's blocking flows, with an explicit stack.

    Behind a full path the search goes on at the first edge it has used up, and no edge is tried twice
    in a phase.
    """
    place = {v: k for k, v in enumerate(names)}
    n = len(names)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [{place[u]: w for u, w in around[k].items()} for k in range(n)] + [{}, {}]
    for k, c in enumerate(cost):
        if c > 0:
            room[source][k], room[k][source] = c, 0.0
        elif c < 0:
            room[k][sink], room[sink][k] = -c, 0.0
    ways = [list(r) for r in room]
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for u, w in room[v].items():
                if w > tiny and level[u] < 0:
                    level[u] = level[v] + 1
                    queue.append(u)
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        tried = [0] * (n + 2)
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                used_up = None
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    room[a][b] -= least
                    room[b][a] += least
                    if used_up is None and room[a][b] <= tiny:
                        used_up = k
                del path[used_up + 1 :]
                continue
            while tried[v] < len(ways[v]):
                u = ways[v][tried[v]]
                if room[v][u] > tiny and level[u] == level[v] + 1:
                    path.append(u)
                    break
                tried[v] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    sides = minimum_cut([cost(b, weights) for b in blocks], edges_of(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, sides, strict=True) if keep)


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> np.ndarray:
    """Classifier weights from a sample of at most ``most`` pages, the first by a hash of url and html.

    Blocks inside article or main elements are examples of content, those inside menus, headers and the
    like of boilerplate; the elements themselves are no feature. The weights are drawn towards the
    prior, so that a sample without examples, or of one kind only, leaves them sensible.
    """

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], []
            for page in batch.column(0):
                for block in blocks_of(page.as_py())[:TRAIN_BLOCKS]:
                    if block.content or block.boilerplate:
                        rows.append(features(block))
                        known.append(not block.boilerplate)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(known, pa.bool_())], ["x", "y"])

    key = F.xxhash64("url", "html")
    # The smallest hashes are found without the pages; the bound is met before any page is parsed.
    threshold = pages.where(F.col("html").isNotNull()).select(key.alias("key")).orderBy("key").limit(most).agg(F.max("key")).first()[0]
    if threshold is None:
        return PRIOR
    sample = pages.where((key <= threshold) & F.col("html").isNotNull()).select("html")
    found = sample.mapInArrow(examples, "x array<double>, y boolean").groupBy("x", "y").count().limit(most * TRAIN_BLOCKS).collect()
    if not found:
        return PRIOR
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float)
    n = np.array([r["count"] for r in found], float)
    for kind in (0.0, 1.0):  # both kinds weigh alike
        n[y == kind] *= EXAMPLES / max(n[y == kind].sum(), 1.0)
    weights = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (p - y)) + (weights - PRIOR)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(PRIOR))
        weights = weights - np.linalg.solve(curve, gradient)
    return weights


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by two line feeds), n_chars.

    A null or empty page, or one without content blocks, has an empty text. Repeated rows are treated
    alike; other columns are ignored; an empty table stays empty.
    """
    weights = train(pages.select("url", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
