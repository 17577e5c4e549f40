"""HTML main text by a tree-structured graphical model.

Every element of a page is a node labelled content or not. A node potential comes from its features (tag,
words of class, id and role, hidden or not, share of link text, nothing but links under headings, and whether it wraps the
page: an element with half of all plain text if that is long, or with a headline and a fifth of it, is judged by
its tag alone, as names on wrappers say what else the page has), a parent-child potential couples each
element with the one it stands in. Sum-product messages passed up and down the tree give each element's
content marginal; text directly inside elements above one half is the main text. The weights are those of a
conditional random field, fitted to labelled pages by gradient ascent with the same messages.

Text is decoded, white space inside a block becomes one space, and blocks are joined by one space.

Defined results: a null, empty or text-free page gives the empty text; broken markup is read as browsers do
in the simple cases (implied ends of paragraphs and list items, unknown end tags ignored, an unfinished tag
or comment at the end dropped); pages of any length and depth are read whole; repeated pages are extracted one by
one; an empty table gives an empty result; columns whose names clash are kept beside a longer name.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh, map_rows, struct

EPOCHS = 60
RATE = 0.5
SHRINK = 1e-3
# Characters of plain text from which half of a page's text is taken for a wrapped page.
LONG = 300
# At most so many labelled pages are learned from.
LABELLED = 500

# How HTML reads these elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
SAME_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th"},
}
LIST_SCOPE = frozenset("ul ol dl table select body html div section article".split())

_TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)"""
    r"""|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<rest>[^>]*+)(?:>|\Z))"""
    r"""|[!?/][^>]*+(?:>|\Z))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")


# Elements whose text nobody reads, and elements that hold text themselves.
UNSEEN = frozenset("script style title template noscript iframe textarea select option svg".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre a span b i em strong button label".split())
# Elements that say the same about where they stand.
_KIND = dict.fromkeys(INLINE - {"a"}, "inline") | {f"h{i}": "heading" for i in range(1, 7)}


class Page:
    """A page's elements in document order (a parent before its children) and its text in between."""

    def __init__(self, source: str):
        self.parent = [-1]
        self.tag = ["#root"]
        self.attributes: list[str] = [""]
        # (element, text), and (element, None) where a block begins or ends.
        self.flow: list[tuple[int, str | None]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        parent, tags, attributes, flow = self.parent, self.tag, self.attributes, self.flow
        stack, at, end, n = [0], 0, 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            stop = m.start() if m else n
            if stop > end:
                flow.append((stack[-1], source[end:stop]))
            if not m:
                break
            at = end = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                self._close(stack, name)
                continue
            if m["attrs"] is None and not source.endswith(">", 0, at):
                break
            if name in ENDS_PARAGRAPH:
                self._end_paragraph(stack)
            if name in SAME_ENDS:
                self._end_same(stack, SAME_ENDS[name])
            if name == "br" or name not in INLINE:
                flow.append((stack[-1], None))
            node = len(tags)
            parent.append(stack[-1])
            tags.append(name)
            given = m["attrs"] if m["attrs"] is not None else m["rest"]
            attributes.append(given or "")
            if name in VOID:
                continue
            if name in RAW:
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE)
                close = closing.search(source, at)
                stop = close.start() if close else n
                if stop > at:
                    flow.append((node, source[at:stop]))
                at = end = close.end() if close else n
                continue
            stack.append(node)

    def _close(self, stack: list[int], name: str) -> None:
        block = name not in INLINE
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == name:
                if block:
                    self.flow.append((stack[i], None))
                del stack[i:]
                return
            if not block and tag in ENDS_PARAGRAPH:
                return

    def _end_paragraph(self, stack: list[int]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == "p":
                del stack[i:]
                return
            if tag not in INLINE:
                return

    def _end_same(self, stack: list[int], names: set[str]) -> None:
        first = None
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in names:
                first = i
            elif tag in LIST_SCOPE:
                break
        if first is not None:
            del stack[first:]

    def text(self, content: list[bool]) -> str:
        """The decoded text of content elements."""
        parts = []
        for node, piece in self.flow:
            if piece is None:
                parts.append(" ")
            elif content[node]:
                parts.append(html.unescape(piece) if "&" in piece else piece)
        return " ".join("".join(parts).split())


def features(page: Page) -> list[list[str]]:
    """Names of each element's features."""
    n = len(page.tag)
    text, linked, links, headed = [0] * n, [0] * n, [0] * n, [0] * n
    headline = [False] * n
    for node, piece in page.flow:
        if piece is not None and page.tag[node] not in UNSEEN:
            piece = html.unescape(piece) if "&" in piece else piece
            text[node] += len(piece) - piece.count(" ") - piece.count("\n")
    for v in range(n - 1, -1, -1):
        if page.tag[v] == "a":
            linked[v] = text[v]
            links[v] += 1
        elif _KIND.get(page.tag[v]) == "heading":
            headline[v] = page.tag[v] == "h1"
            headed[v] = text[v] - linked[v]
        if v:
            p = page.parent[v]
            text[p] += text[v]
            linked[p] += linked[v]
            links[p] += links[v]
            headed[p] += headed[v]
            headline[p] = headline[p] or headline[v]
    whole = text[0] - linked[0]
    out = []
    for v in range(n):
        tag = page.tag[v]
        plain = text[v] - linked[v]
        wraps = 2 * plain >= whole and plain >= LONG or (headline[v] and 5 * plain >= whole)
        wraps = wraps and plain > 0 and tag not in _LEAVES
        own = [("wraps " if wraps else "tag ") + (_KIND.get(tag, tag))]
        given = page.attributes[v]
        if "=" in given or "hidden" in given:
            for name, a, b, c in _ATTRIBUTE.findall(given):
                name, value = name.lower(), html.unescape(a or b or c).lower()
                if name in ("class", "id", "role"):
                    for word in () if wraps else _WORDS.findall(value):
                        own.append("is " + (word[:-1] if len(word) > 2 and word[-1] == "s" else word))
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    own.append("hidden")
                elif name == "style" and "none" in value and "display" in value:
                    own.append("hidden")
        if text[v] and page.tag[v] != "a":
            share = linked[v] / text[v]
            own.append("links " + ("most" if share > 0.6 else "some" if share > 0.2 else "few"))
            # A little may stand between links.
            if links[v] > 1 and text[v] - linked[v] - headed[v] <= 2 * links[v]:
                own.append("links only")
        out.append(own)
    return out


class Model:
    """Feature weights (log odds of content) and the four parent-child potentials, parent first."""

    def __init__(self):
        self.weights: dict[str, float] = defaultdict(float)
        self.pair = [[0.5, -0.5], [-0.5, 0.5]]

    def __getstate__(self):
        return {"weights": dict(self.weights), "pair": self.pair}

    def messages(self, parent: list[int], own: list[float]):
        """Log odds of every node from below and in all, and what each sent its parent."""
        (c00, c01), (c10, c11) = self.pair
        e00, e01, e10, e11 = map(math.exp, (c00, c01, c10, c11))
        exp, log = math.exp, math.log
        n = len(parent)
        up, sent = list(own), [0.0] * n
        for v in range(n - 1, 0, -1):
            x = exp(min(max(up[v], -60.0), 60.0))
            sent[v] = m = log((e10 + e11 * x) / (e00 + e01 * x))
            up[parent[v]] += m
        odds = list(up)
        for v in range(1, n):
            x = exp(min(max(odds[parent[v]] - sent[v], -60.0), 60.0))
            odds[v] = up[v] + log((e01 + e11 * x) / (e00 + e10 * x))
        return up, odds, sent

    def own(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in row]) for row in rows]

    def content(self, page: Page) -> list[bool]:
        """Which elements have a content marginal above one half."""
        _, odds, _ = self.messages(page.parent, self.own(features(page)))
        return [x > 0 for x in odds]


def _odds(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -60.0), 60.0)))


def fit(pages: list[str], epochs: int = EPOCHS) -> Model:
    """Fit to pages whose elements carry ``data-label`` 0 or 1; a label holds for what stands inside."""
    model = Model()
    read = []
    for source in pages:
        page = Page(source)
        labels = [1]
        for v in range(1, len(page.tag)):
            own = re.search(r'data-label="([01])"', page.attributes[v])
            labels.append(int(own[1]) if own else labels[page.parent[v]])
            page.attributes[v] = re.sub(r'data-label="[01]"', "", page.attributes[v])
        read.append((page.parent, features(page), labels))
    squares: dict = defaultdict(lambda: 1e-6)
    for _ in range(epochs):
        for parent, rows, labels in read:
            up, odds, sent = model.messages(parent, model.own(rows))
            change: dict = defaultdict(float)
            for row, x, y in zip(rows, odds, labels):
                error = y - _odds(x)
                for f in row:
                    change[f] += error
            pair = [[0.0, 0.0], [0.0, 0.0]]
            for v in range(1, len(parent)):
                above = odds[parent[v]] - sent[v]
                cells = [
                    math.exp(model.pair[a][b] + (above if a else 0) + (up[v] if b else 0))
                    if abs(above) < 60 and abs(up[v]) < 60
                    else float((a == (above > 0)) and (b == (up[v] > 0)))
                    for a in (0, 1)
                    for b in (0, 1)
                ]
                total = sum(cells) or 1.0
                for k, (a, b) in enumerate(itertools.product((0, 1), (0, 1))):
                    pair[a][b] += (labels[parent[v]] == a and labels[v] == b) - cells[k] / total
            for f, g in change.items():
                g -= SHRINK * model.weights[f]
                squares[f] += g * g
                model.weights[f] += RATE * g / math.sqrt(squares[f])
            for a, b in itertools.product((0, 1), (0, 1)):
                g = pair[a][b] - SHRINK * model.pair[a][b]
                squares[a, b] += g * g
                model.pair[a][b] += RATE * g / math.sqrt(squares[a, b])
    return model


def extract(source: str | None, model: Model) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    return page.text(model.content(page))


def train(labelled: DataFrame, source: str = "html", size: int = LABELLED) -> Model:
    """Fit to at most ``size`` labelled pages of a table, those of the smallest hashes, in a fixed order."""
    rows = labelled.select(source).orderBy(F.xxhash64(source), source).limit(size).collect()
    return fit([r[0] for r in rows if r[0]])


def main_text(pages: DataFrame, model: Model, source: str = "html", text: str = "text", keep=None):
    """``pages`` with their main text in a new column; returns the frame and the column's name."""
    keep = pages.columns if keep is None else keep
    column = fresh(pages.select(*keep), text)

    def make():
        return lambda batch: {
            column: [extract(x, model) for x in batch.column(source).to_pylist()]
        }

    return map_rows(pages, make, struct(f"`{column}` string"), keep), column
