"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with their place in the tree. A classifier over the block's text and the
names of the containers around it gives each block the cost of calling it content and of calling it
boilerplate: these are its capacities to the two terminals. Neighbours on the page and in the tree are tied by
edges that cost their weight if their labels differ. The minimum cut is the labelling of least cost. Weights of
text and names are learnt from pages whose containers are marked, each block once with its names and once
without, so that text counts as well; weights of ties from how often neighbours so far apart agree. No cost is
beyond what ties can overrule. Blocks whose own costs outweigh all their ties are labelled at once, which is
exact; a maximum flow settles the rest.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import mapped, others, small_batches, table

#: Pages on which the classifier is fitted, at most or so.
SAMPLE_PAGES = 2048
#: Bounds of the text's part of a block's log odds of content and of a tie's weight.
TEXT, LOOSEST, TIGHTEST = 2.5, 0.05, 2.0
#: Share of a tie's weight that is left where one of its blocks lies in a marked container and the other doesn't.
CROSSING = 0.1
#: Weights before any fit: of Page.features(); of the names around a block (in boilerplate, in an article, in a
#: container named as content, in an article within boilerplate, in a container whose name may as well be an ordinary
#: word), which are also their bounds; and of ties by the steps in the tree between neighbours (0 to 6 or more), and
#: of the last of an element before its neighbour. TEXT outweighs the last of the names: prose overrules it.
WEIGHTS = np.array([-1.0, 0.7, -4.0, 1.0, 1.0, -0.5, -3.0])
NAMES = np.array([-3.0, 2.0, 1.0, -1.0, -1.5])
TIES = np.array([1.5, 1.2, 1.0, 0.7, 0.5, 0.35, 0.25, 0.6])

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+>|[^>]*+>)|[!?/][^>]*+>)")
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {k: re.compile(rf"</{k}\b[^>]*>?", re.I) for k in ("script", "style", "title", "textarea", "template", "iframe", "svg", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msqrt".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_BAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_BAD_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense sponsored nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer "
    "colophon masthead topbar sidebar aside widget cookie cookies consent gdpr newsletter popup modal comment comments disqus login signup".split()
)
#: Names that are ordinary words too, so that a container may be named after what it is about.
_WEAK_NAMES = frozenset(
    "sponsor promo promotion banner foot copyright related recommended recommendations share sharing social notice alert subscribe "
    "subscription disclaimer reply replies respond form search".split()
)
_ADVERT = frozenset("ad ads advert advertisement sponsored".split())
#: Weak marks: by such a name, or as a fallback for pages without scripts.
NAMED, FALLBACK = 1, 2
#: Words that turn a name into one about a page's layout, as in "has-sidebar".
_ABOUT = frozenset("has with no without".split())
_GOOD_NAMES = frozenset("article content main post entry story".split())
_END = re.compile(r"[.!?…:;»”\"')\]]$")
#: Start tags that end an open element of these names (up to the next container).
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Page:
    """Blocks of a page: text, characters in links, place (tuple of container numbers), names around it (as
    NAMES has them), heading or not."""

    __slots__ = ("texts", "links", "paths", "names", "heads")

    def __init__(self, source: str):
        self.texts, self.links, self.paths, self.names, self.heads = [], [], [], [], []
        names: list[str] = []  # open containers: name, number, what they say
        numbers: list[int] = []
        said: list[tuple[bool, bool, bool, bool, int]] = [(False, False, False, False, 0)]
        buffer: list[str] = []
        linked = in_link = count = 0
        skipped, inside_skipped = "", 0  # an inline element that is hidden or an advert: its text is left out
        at, n = 0, len(source)
        last = source.rfind(">") + 1  # no tag ends behind it, so none is looked for there

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.texts.append(text)
                    self.links.append(linked)
                    self.paths.append(tuple(numbers))
                    self.names.append(said[-1])
                    self.heads.append(bool(names) and len(names[-1]) == 2 and names[-1][0] == "h" and names[-1][1].isdigit())
                buffer.clear()
            linked = 0

        def text(to: int) -> None:
            nonlocal linked
            if to > at and not skipped:
                piece = source[at:to]
                piece = _html.unescape(piece) if "&" in piece else piece
                buffer.append(piece)
                if in_link:
                    linked += len(piece.strip())

        while at < n:
            m = _TAG.search(source, at, last) if at < last else None
            if m is None:
                # a tag that the end of the page cuts off is no text
                cut = _OPEN.search(source, at)
                text(cut.start() if cut else n)
                break
            text(m.start())
            at = m.end()
            if m[1]:
                end = source.find("-->", at)
                at = n if end < 0 else end + 3
                continue
            name = (m[3] or "").lower()
            if not name:
                continue
            if skipped:
                if name == skipped:
                    inside_skipped += -1 if m[2] else 1
                    if inside_skipped == 0:
                        skipped = ""
                    continue
                if name in _INLINE:
                    continue
                skipped = ""  # it was never closed
            if m[2]:  # end tag
                if name == "a":
                    in_link = 0
                elif name not in _INLINE:
                    flush()
                    if name in names:
                        while names:
                            numbers.pop()
                            said.pop()
                            if names.pop() == name:
                                break
                continue
            if name in _RAW:
                if name != "svg" or not m[4].endswith("/>"):
                    end = _RAW[name].search(source, at)
                    at = end.end() if end else n
                continue
            if name == "a":
                in_link = 1
            elif name == "br":
                buffer.append(" ")
            if name in _INLINE:
                if self._inline_apart(name, m[4]):
                    skipped, inside_skipped = name, 1
                continue
            flush()
            in_link = in_link if name == "a" else 0
            if name in _VOID:
                continue
            if names and names[-1] == "p":  # a block ends an open paragraph
                names.pop(), numbers.pop(), said.pop()
            for other in _CLOSES.get(name, ()):
                if names and names[-1] == other:
                    names.pop(), numbers.pop(), said.pop()
            kind = self._kind(name, m[4])
            bad, article, good, above, weak = said[-1]
            if kind == "bad" or name == "header" and not article:
                bad = True
            elif kind == "article":
                bad, article, above, weak = False, True, above or bad, 0
            elif kind == "good" and not bad:
                good = True
            elif kind == "weak":
                weak = NAMED
            elif name == "noscript":
                weak = weak or FALLBACK
            count += 1
            names.append(name)
            numbers.append(count)
            said.append((bad, article and not bad, good and not bad, above, weak))
        flush()
        # where the page marks its article, a weak name marks what isn't part of it
        marked = any(n[1] for n in self.names)
        self.names = [(True, False, False, n[3], False) if marked and n[4] == NAMED else (*n[:4], n[4] > 0) for n in self.names]

    @staticmethod
    def _inline_apart(name: str, attributes: str) -> bool:
        """Whether an inline element is hidden, or a span that is called an advert and nothing else."""
        for a in _ATTR.finditer(attributes):
            if a[1].lower() == "hidden" or name == "span" and (a[2] or a[3] or a[4] or "").lower() in _ADVERT:
                return True
        return False

    @staticmethod
    def _kind(name: str, attributes: str) -> str:
        """bad, article, good, weak or nothing, by the name and attributes of a container."""
        if name in _BAD_TAGS:
            return "bad"
        kind = "article" if name in ("article", "main") else ""
        if "=" in attributes or "hidden" in attributes:
            for a in _ATTR.finditer(attributes):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "hidden":
                    return "bad"
                if a[1].lower() == "role":
                    if value.lower() in _BAD_ROLES:
                        return "bad"
                    if value.lower() in ("main", "article"):
                        kind = "article"
                else:
                    got = {x.lower() for x in _SPLIT.split(value)}
                    if got & _BAD_NAMES and not got & _ABOUT and name not in ("body", "html", "article", "main"):
                        return "bad"
                    if got & _WEAK_NAMES and not got & _ABOUT and not kind and name not in ("body", "html"):
                        kind = "weak"
                    if got & _GOOD_NAMES and not kind:
                        kind = "good"
        return kind

    def features(self) -> np.ndarray:
        """Per block: 1, log of words, share of linked characters, ends like a sentence, heading, short
        and not ending like one, copyright sign."""
        out = np.zeros((len(self.texts), 7))
        for i, (t, k) in enumerate(zip(self.texts, self.links, strict=True)):
            size, end = t.count(" ") + 1, bool(_END.search(t))
            out[i] = 1, math.log(size), min(1.0, k / len(t)), end, self.heads[i], size < 4 and not end, "©" in t
        return out


def ties(page: Page) -> list[tuple[int, int, int, bool]]:
    """Pairs of tied blocks, with the kind of their tie (see TIES) and whether it crosses into a marked
    container: each with the next, and with the last before it that has the same parent."""
    out, last = [], {}
    for i, path in enumerate(page.paths):
        if i:
            old, same = page.paths[i - 1], 0
            for a, b in zip(old, path, strict=False):
                if a != b:
                    break
                same += 1
            out.append((i - 1, i, min(6, len(old) + len(path) - 2 * same), page.names[i - 1] != page.names[i]))
        parent = path[:-1]
        j = last.get(parent)
        if j is not None and j < i - 1:
            out.append((j, i, 7, page.names[j] != page.names[i]))
        last[parent] = i
    return out


class Model:
    """Weights of text, of names and of ties."""

    def __init__(self, text: np.ndarray = WEIGHTS, names: np.ndarray = NAMES, tie: np.ndarray = TIES):
        self.text, self.names, self.tie = text, names, tie

    def odds(self, page: Page) -> np.ndarray:
        """Each block's own log odds of content."""
        return np.clip(page.features() @ self.text, -TEXT, TEXT) + np.array(page.names, float).reshape(-1, len(NAMES)) @ self.names

    def edges(self, page: Page) -> list[tuple[int, int, float]]:
        return [(i, j, float(self.tie[k]) * (CROSSING if crosses else 1.0)) for i, j, k, crosses in ties(page)]

    def labels(self, page: Page) -> list[bool]:
        return minimum_cut(self.odds(page).tolist(), self.edges(page))


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, agree: np.ndarray) -> Model:
    """Logistic regression of marked blocks, drawn to the first weights: features and names of blocks in articles
    (y 1) and in boilerplate (0), and n, how often each occurs; each with its names and again without.
    agree: for each kind of tie, how many pairs of marked blocks have one label and how many have two."""
    tie = np.where(agree.sum(1) > 0, np.clip(np.log((agree[:, 0] + 2) / (agree[:, 1] + 2)) / 2, LOOSEST, TIGHTEST), TIES)
    first = np.concatenate([WEIGHTS, NAMES])
    if not len(y) or y.min() == y.max():
        return Model(tie=tie)
    k = len(WEIGHTS)
    x = np.concatenate([x, np.where(np.arange(len(first)) < k, x, 0.0)])
    y, n, b = np.tile(y, 2), np.tile(n, 2), first.copy()
    share = (y * n).sum() / n.sum()
    w = n * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - 10.0 * (b - first)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 10.0 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return Model(b[:k], np.clip(b[k:], np.minimum(NAMES, 0), np.maximum(NAMES, 0)), tie)


def fitted(sample: DataFrame) -> Model:
    """fit() on a sample of pages (one column): workers send distinct rounded features and kinds of ties with
    their counts, never pages."""
    wide = len(WEIGHTS) + len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = []
            for page in (Page(t) for t in b.column(0).to_pylist() if t):
                if not page.texts:
                    continue
                names = np.array(page.names, float)
                y = np.where(names[:, 0] > 0, 0, np.where(names[:, 1] > 0, 1, -1))
                x.append(np.column_stack([np.round(page.features(), 1), names, y, np.zeros(len(y))])[y >= 0])
                pairs = [(k, y[i] != y[j]) for i, j, k, _ in ties(page) if min(y[i], y[j]) >= 0]
                if pairs:
                    at = np.zeros((len(pairs), wide + 2))
                    at[:, 0], at[:, wide], at[:, -1] = *np.array(pairs, float).T, 1
                    x.append(at)
            if x:
                rows, n = np.unique(np.concatenate(x), axis=0, return_counts=True)
                yield pa.record_batch([*(pa.array(c) for c in rows.T), pa.array(n.astype(np.int64))], [*cols, "n"])

    cols = [*(f"x{i}" for i in range(wide)), "y", "tie"]
    small_batches(sample.sparkSession)
    rows = sample.mapInArrow(run, ", ".join(f"{c} double" for c in cols) + ", n long").groupBy(*cols).agg(F.sum("n").alias("n")).orderBy(*cols).toPandas()
    agree = np.zeros((len(TIES), 2))
    blocks, pairs = rows[rows["tie"] == 0], rows[rows["tie"] == 1]
    np.add.at(agree, (pairs["x0"].to_numpy().astype(int), pairs["y"].to_numpy().astype(int)), pairs["n"].to_numpy())
    return fit(blocks[cols[:wide]].to_numpy(), blocks["y"].to_numpy(), blocks["n"].to_numpy(float), agree)


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling x that costs least: -odds[i] for each true block, plus the weight of each edge whose
    ends differ. Of several, that with the fewest true blocks left open to choice."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    left = list(odds)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # what outweighs its ties is settled, and pulls on its neighbours
        i = todo.popleft()
        if label[i] is None and abs(left[i]) > sum(near[i].values()):
            label[i] = left[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    left[j] += w if label[i] else -w
                    near[j].pop(i, None)
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    for i, side in zip(rest, _source_side([near[i] for i in rest], [left[i] for i in rest], rest), strict=True):
        label[i] = side
    return label


def _source_side(near: list[dict[int, float]], odds: list[float], rest: list[int]) -> list[bool]:
    """Which of the blocks `rest` lie on the content terminal's side of the minimum cut, by a maximum flow in
    levels: a few searches of the whole graph, however many blocks."""
    place = {i: k for k, i in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, i in enumerate(rest):
        if odds[k] > 0:
            edge(s, k, odds[k], 0.0)
        else:
            edge(k, t, -odds[k], 0.0)
        for j, w in near[k].items():
            if j > i:
                edge(k, place[j], w, w)
    while True:
        level, queue = [-1] * (t + 1), deque([s])
        level[s] = 0
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:s]]
        at, path, a = [0] * (t + 1), [], s
        while True:  # a blocking flow, depth first
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(n for n, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[k] ^ 1]
                del path[k:]
            elif at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    at[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def main_text(source: str | None, model: Model | None = None) -> str:
    """The content blocks of a page, in order, two newlines between them; null has none."""
    page = Page(source or "")
    if not page.texts:
        return ""
    kept = (model or Model()).labels(page)
    return "\n\n".join(t for t, k in zip(page.texts, kept, strict=True) if k)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `text` and `n_chars` (code points) in place of `column`: a row per row. Null and empty
    pages have the empty text, a page of any length is taken whole, repeated rows are rows of their own and an empty
    table gives none. Columns of pages with those names are replaced, all others stay, whatever their names. The weights are learnt from SAMPLE_PAGES pages or so; without marked ones the first weights hold."""
    n = max(1, pages.count() // SAMPLE_PAGES)
    drawn = pages.where(F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(n)) == 0).select(F.col(f"`{column}`").alias("h"))
    model = fitted(drawn)
    cols = others(pages, column.lower(), "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, model) for x in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*cols, "text", "n_chars"])

    return mapped(pages, F.col(f"`{column}`").cast("string"), cols, run, [("text", T.StringType()), ("n_chars", T.LongType())])


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable] = {"op2_html_extraction": op2_html_extraction}
ORACLE: dict[str, str] = {}
