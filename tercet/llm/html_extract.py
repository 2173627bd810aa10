"""Main text of web pages by minimum-cut labelling.

A page is cut at its block elements into blocks of text. A logistic classifier gives each block a probability of being content;
its log costs become the capacities from the source (content) and to the sink (boilerplate). Neighbouring blocks are joined by
edges whose capacity falls with their distance in the document tree, and so are consecutive blocks below one parent,
whatever lies between them. The maximum flow's minimum cut is the labelling of least total cost.

The classifier is trained on at most `sample` pages, those of least hash, without labels made by hand: what
lies in an article or main element is content, what lies in navigation, header, footer or aside elements is not. Each of these
blocks is learnt from twice, once without sight of the elements around it, so that pages without such elements are told by their text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*+>(?P<inner>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>?|<[!?][^>]*+>?",
    re.I | re.S,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(["hr"])
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An element that ends an open one of its kind doesn't reach beyond these.
SCOPES = frozenset("article aside body blockquote div dl footer header main menu nav ol section table td th ul".split())
GOOD, BAD = frozenset(["article", "main"]), frozenset(["nav", "footer", "aside", "header", "menu", "form", "dialog"])
HINTS = re.compile(r"(?:^|[\s\"'_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|copyright|footer|header|login|menu|nav\w*|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|tags?|widget)(?=$|[\s\"'_-])", re.I)
CLASSES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
N_FEATURES = 12
SEEN = (9, 10, 11)  # the features that tell of elements around
SCALE = 10_000


@dataclass
class Block:
    text: str
    depth: int
    #: How many of the elements around it are around the block before it too.
    common: int
    parent: int
    tag: str
    linked: int
    good: bool
    bad: bool
    hint: bool


def blocks_of(page: str | None) -> tuple[str, list[Block]]:
    """The title and the blocks of text, in order. Malformed markup is taken as browsers roughly do."""
    page = page or ""
    title, out = "", []
    stack: list[tuple[str, int, bool, bool, bool]] = []  # (tag, id, in good, in bad, hinted)
    parts: list[str] = []
    linked, in_link, serial, common = 0, 0, 0, 0
    opened: Counter[str] = Counter()  # of the stack's tags

    def close(i: int) -> None:
        nonlocal common
        opened.subtract(s[0] for s in stack[i:])
        del stack[i:]
        common = min(common, i)

    def flush() -> None:
        nonlocal linked, common
        if parts:
            lines = (" ".join(x.split()) for x in html.unescape("".join(parts)).split("\0"))
            text = "\n".join(x for x in lines if x)
            if text:
                tag, _, good, bad, hint = stack[-1] if stack else ("", 0, False, False, False)
                out.append(Block(text, len(stack), common, stack[-2][1] if len(stack) > 1 else 0, tag, linked, good, bad, hint))
                common = len(stack)
        parts.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text.replace("\0", " "))
            if in_link:
                linked += len(text.strip())

    at = 0
    for m in TOKEN.finditer(page):
        said(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() == "title" and not title:
                title = " ".join(html.unescape(m["inner"]).split())
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append("\0")
        elif tag == "a":
            in_link = 0 if m["end"] else 1
        elif tag in BLOCKS:
            flush()
            if m["end"]:
                if opened[tag]:  # else the whole stack would be looked through for each such tag
                    close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag not in VOID:
                if any(opened[c] for c in CLOSES.get(tag, ())):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in CLOSES[tag]:
                            close(i)
                            break
                        if stack[i][0] in SCOPES:
                            break
                good, bad, hint = stack[-1][2:] if stack else (False, False, False)
                said_class = " ".join(CLASSES.findall(m["attrs"])) if m["attrs"] else ""
                serial += 1
                opened[tag] += 1
                stack.append((tag, serial, good or tag in GOOD, bad or tag in BAD and not good, hint or bool(HINTS.search(said_class))))
    said(page[at:])
    flush()
    return title, out


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), N_FEATURES))
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.split()
        marks = sum(map(b.text.count, ".!?;,"))
        x[i] = (
            1, min(math.log1p(n) / 5, 2), min(math.log1p(len(words)) / 4, 2), min(1.0, b.linked / n), min(1.0, 10 * marks / max(10, len(words))), b.text[-1] in ".!?\"”»",
            b.tag in ("p", "pre", "blockquote"), b.tag in ("li", "td", "dd", "option"), b.tag[:1] == "h" and b.tag[1:].isdigit(), b.good, b.bad, b.hint,
        )
    return x


@dataclass
class Model:
    """The classifier's weights; these stand where the sample has no blocks of both kinds."""

    weights: np.ndarray = field(default_factory=lambda: np.array([-2.5, 1.5, 1.5, -3.0, 0.8, 0.8, 0.5, -0.8, 0.3, 2.0, -2.0, -1.5]))
    adjacency: float = 0.8
    proximity: float = 0.4

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -8, 8)))


def trained(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton's method, both kinds weighing alike."""
    if len(y) == 0 or y.min() == y.max():
        return Model()
    blind = x.copy()
    blind[:, SEEN] = 0
    x, y = np.concatenate([x, blind]), np.concatenate([y, y]).astype(float)
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + ridge * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return Model(w)


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node, whether it lies on the source's side of the minimum cut that has the fewest nodes there. Dinic's algorithm."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i in range(n):
        both = min(source[i], sink[i])  # flows straight through
        if source[i] > both:
            edge(s, i, source[i] - both, 0)
        elif sink[i] > both:
            edge(i, t, sink[i] - both, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []  # of edges from s
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                cut = None
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if cut is None and room[e] == 0:
                        cut = k
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nth[a] < len(out[a]):
                e = out[a][nth[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                nth[a] += 1
            if nth[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def graph_of(blocks: list[Block], model: Model) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    p = model.probabilities(features(blocks))
    source = np.rint(-np.log1p(-p) * SCALE).astype(int).tolist()
    sink = np.rint(-np.log(p) * SCALE).astype(int).tolist()
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, int(SCALE * model.adjacency / (1 + blocks[i - 1].depth + b.depth - 2 * b.common))))
        parent = b.parent
        if parent in last:
            edges.append((last[parent], i, int(SCALE * model.proximity)))
        last[parent] = i
    return source, sink, edges


def labelled(blocks: list[Block], model: Model) -> list[bool]:
    return min_cut(*graph_of(blocks, model)) if blocks else []


def model_of(pages: DataFrame, *, sample: int = 2000) -> Model:
    """The model learnt from the pages of at most `sample` ids; pages without an id or html don't count."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").where("page_id is not null and html is not null")
    chosen = pages.join(F.broadcast(least_hashed(pages.select("page_id"), "page_id", sample)), "page_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(t)[1] for t in batch.column(1).to_pylist()]
            found = [[b for b in own if b.good or b.bad] for own in found]
            rows = [(features(own).astype("<f8").tobytes(), bytes(b.good for b in own)) for own in found if own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], ["x", "y"])

    rows = sorted((bytes(r["x"]), bytes(r["y"])) for r in chosen.mapInArrow(run, "x binary, y binary").collect())
    x = np.frombuffer(b"".join(a for a, _ in rows), "<f8").reshape(-1, N_FEATURES)
    return trained(x, np.frombuffer(b"".join(b for _, b in rows), np.uint8))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, title, text, n_blocks, n_content) for each row of pages, repeated ones and those with a null page_id too.

    The text is that of the content blocks, a line each (more where the page breaks lines). A null or empty page, and one without text,
    has an empty title and text and no blocks; a null url stays null. Of labellings that cost the same, that with the fewest content blocks is taken. Other columns aren't read. No shuffle.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for page in batch.column(2).to_pylist():
                title, blocks = blocks_of(page)
                kept = [b.text for b, y in zip(blocks, labelled(blocks, model)) if y]
                rows.append((title, "\n".join(kept), len(blocks), len(kept)))
            titles, texts, n, k = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], ["page_id", "url", "title", "text", "n_blocks", "n_content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, title string, text string, n_blocks long, n_content long")
