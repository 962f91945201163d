"""The main text of web pages, from flat text blocks that a decision tree keeps or drops.

A page is read once from front to back. Text between block-level tags is a block; each has its number of words, its
share of linked words, the same of the block before and after it, and four marks: the innermost landmark element
around it (1 article or main, -1 navigation, header, footer, aside or form, -0.5 a header inside an article), the innermost
element whose class, id or role tells something (1 or -1), whether it is a heading, and whether it stands in a
list or table. A decision tree, grown here on the blocks of the few labelled pages of `html_samples`, decides
by these alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm import html_samples
from perfattr.llm.common import ship, slices

# Elements and words of HTML pages.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source track area map".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
SKIPPED = frozenset(
    "script style title template noscript iframe object canvas svg math audio video select textarea button "
    "datalist noframes noembed xmp head".split()
)
#: Of these, content that is not parsed: only the end tag ends it.
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li td th dt dd option caption".split())
LANDMARKS = {"article": 1, "main": 1, "nav": -1, "header": -1, "footer": -1, "aside": -1, "form": -1, "menu": -1, "dialog": -1}
GOOD_WORDS = frozenset("article articlebody blog body content entry main maincontent post postbody prose story text".split())
BAD_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert aside author banner bio breadcrumb breadcrumbs byline "
    "comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion "
    "disqus feedback footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice "
    "notification pager pagination popup privacy promo promoted promotion recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar "
    "toc widget widgets".split()
)
_TAG = re.compile(
    r"<!--(?P<comment>)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]|=)*+)>"
    r"|<[!?/][^>]*>"
    r"|<[!?/a-zA-Z][^>]*\Z"
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
FEATURES = ("landmark", "named", "heading", "listed", "words", "links", "words_before", "links_before", "words_after", "links_after")


def _named(attributes: str) -> int:
    """What class, id and role say of an element: 1, -1, or 0 if they say nothing or both."""
    good = bad = False
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return -1
        if name in ("class", "id", "role"):
            found = {w.lower() for w in _WORD.findall(value)}
            good, bad = good or not found.isdisjoint(GOOD_WORDS), bad or not found.isdisjoint(BAD_WORDS)
    return int(good) - int(bad)


class Blocks:
    """Text blocks of pages, gathered one page after the other."""

    def __init__(self):
        self.texts: list[str] = []
        self.marks: list[tuple] = []
        self.pages: list[int] = []
        self.n_pages = 0

    def read(self, page: str) -> None:
        """Add the blocks of one page. Elements left open end with an element around them."""
        stack: list[tuple[str, float, int, int]] = []  # name and what held before it: landmark, named, listed
        landmark, named, listed = 0.0, 0, 0
        heading = False
        link = -1  # number of open elements where a link began
        parts: list[tuple[str, bool]] = []

        def flush() -> None:
            if not parts:
                return
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                n = text.count(" ") + 1
                linked = sum(len(t.split()) for t, is_link in parts if is_link)
                self.texts.append(text)
                self.marks.append((n, min(1.0, linked / n), landmark, named, float(heading), float(listed)))
                self.pages.append(self.n_pages)
            parts.clear()

        at, n = 0, len(page)
        while at < n:
            tag = _TAG.search(page, at)
            to = tag.start() if tag else n
            if to > at:
                parts.append((html.unescape(page[at:to]), link >= 0))
            if not tag:
                break
            at = tag.end()
            if tag["comment"] is not None:
                close = page.find("-->", at)
                at = n if close < 0 else close + 3
                continue
            if tag["name"] is None:
                continue
            name = tag["name"].lower()
            if tag["end"]:
                if name == "a":
                    link = -1
                elif name not in INLINE:
                    flush()
                    heading = heading and name not in HEADINGS
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            _, landmark, named, listed = stack[k]
                            del stack[k:]
                            link = link if link <= k else -1
                            break
                continue
            if name in SKIPPED:
                at = _skipped(page, name, at, tag["attrs"])
                parts.append((" ", False))
                continue
            if name in INLINE:
                if name == "a":
                    link = len(stack)
                continue
            flush()
            if name in VOID:
                continue
            heading = name in HEADINGS or heading and name not in LANDMARKS and name not in ("p", "div", "section")
            if name in ("p", "body", "html") or name in HEADINGS:
                continue
            stack.append((name, landmark, named, listed))
            own = _named(tag["attrs"])
            landmark = -0.5 if name == "header" and landmark > 0 else LANDMARKS.get(name, landmark)
            named = own or (0 if name == "main" or name == "article" and named > 0 else named)
            listed = 1 if name in LISTED else 0 if name in LANDMARKS else listed
        flush()
        self.n_pages += 1

    def features(self) -> np.ndarray:
        """A row per block; before the first and after the last block of a page there are no words."""
        own = np.array(self.marks, float).reshape(-1, 6)
        pages = np.array(self.pages)
        size = own[:, :2]
        before, after = np.zeros_like(size), np.zeros_like(size)
        same = pages[1:] == pages[:-1]
        before[1:][same], after[:-1][same] = size[:-1][same], size[1:][same]
        return np.concatenate([own[:, 2:], size, before, after], axis=1)


_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in SKIPPED}
_EITHER = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>?", re.I) for name in SKIPPED}


def _skipped(page: str, name: str, at: int, attributes: str) -> int:
    """Where the page goes on after an element whose content is no text."""
    if attributes.endswith("/") and name in ("svg", "math"):
        return at
    if name in RAW:
        close = _ENDS[name].search(page, at)
        return close.end() if close else len(page)
    depth = 1
    for tag in _EITHER[name].finditer(page, at):
        depth += -1 if tag[1] else 1
        if not depth:
            return tag.end()
    # Never closed: the head ends with the body, anything else is taken as empty.
    body = re.compile(r"<body[\s>]", re.I).search(page, at) if name == "head" else None
    return body.start() if body else at


# -- the tree -------------------------------------------------------------------------------------


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1) -> list[tuple]:
    """A decision tree as a list of (feature, threshold, left, right, share of ones); feature -1 is a leaf.

    Each split takes the feature and threshold with the least Gini impurity, halfway between two values; the first such
    feature wins a tie. Splits leave `least` rows on either side.
    """
    nodes: list[tuple] = []

    def split(at: np.ndarray, level: int) -> int:
        number, share = len(nodes), labels[at].mean() if len(at) else 0.0
        nodes.append((-1, 0.0, -1, -1, float(share)))
        if level == depth or share in (0.0, 1.0):
            return number
        best = (1e-9 - _gini(labels[at]) * len(at), -1, 0.0)
        for f in range(rows.shape[1]):
            values = rows[at, f]
            order = np.argsort(values, kind="stable")
            ones = np.cumsum(labels[at][order])
            k = np.flatnonzero(values[order][1:] > values[order][:-1]) + 1
            k = k[(k >= least) & (k <= len(at) - least)]
            if not len(k):
                continue
            left, right = ones[k - 1], ones[-1] - ones[k - 1]
            cost = 2 * left * (1 - left / k) + 2 * right * (1 - right / (len(at) - k))
            j = int(np.argmin(cost))
            if -cost[j] > best[0] + 1e-9:
                best = (-cost[j], f, (values[order][k[j] - 1] + values[order][k[j]]) / 2)
        _, f, cut = best
        if f >= 0:
            low = rows[at, f] <= cut
            left, right = split(at[low], level + 1), split(at[~low], level + 1)
            nodes[number] = (f, float(cut), left, right, float(share))
        return number

    split(np.arange(len(rows)), 0)
    return nodes


def _gini(labels: np.ndarray) -> float:
    share = labels.mean()
    return 2 * share * (1 - share)


def shares(tree: list[tuple], rows: np.ndarray) -> np.ndarray:
    """The share of ones in the leaf of each row."""
    feature, cut, left, right, share = (np.array(x) for x in zip(*tree))
    at = np.zeros(len(rows), int)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return share[at]
        node = at[inner]
        low = rows[inner, feature[node]] <= cut[node]
        at[inner] = np.where(low, left[node], right[node])


def labelled_blocks(pages: Sequence[str] = html_samples.PAGES) -> tuple[Blocks, np.ndarray]:
    """Blocks of labelled pages: every line is one block, `+` to keep or `-` to drop."""
    blocks, labels = Blocks(), []
    for page in pages:
        lines = page.strip().splitlines()
        before = len(blocks.texts)
        blocks.read("\n".join(line[2:] for line in lines))
        if len(blocks.texts) - before != len(lines):
            raise ValueError(f"a labelled page has {len(lines)} lines and {len(blocks.texts) - before} blocks: {page}")
        labels += [line[0] == "+" for line in lines]
    return blocks, np.array(labels, float)


def fitted(pages: Sequence[str] = html_samples.PAGES) -> list[tuple]:
    """The tree grown on the labelled pages."""
    blocks, labels = labelled_blocks(pages)
    return grow(blocks.features(), labels)


def main_text(
    pages: DataFrame,
    *,
    html_column: str = "html",
    keep: Sequence[str] = ("page_id", "url"),
    tree: list[tuple] | None = None,
) -> DataFrame:
    """The columns `keep`, `text` and `n_chars` (code points) of every page.

    Character references are decoded, white space in a block becomes one space, kept blocks are joined by one space. Null or
    empty html and pages without a kept block give an empty text. Every row is a page of its own; other columns are
    not read. Pages are read whole, whatever their length; tags left open at the end of the page count as closed.
    """
    ship(pages.sparkSession)
    tree = tree or fitted()
    own = [f"c{k}" for k in range(len(keep))]
    rows = pages.select(
        *[F.col(f"`{c}`").alias(x) for c, x in zip(keep, own)], F.col(f"`{html_column}`").cast("string").alias("html")
    )
    schema = rows.select(*own, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            blocks = Blocks()
            for page in batch.column("html").to_pylist():
                blocks.read(page or "")
            kept = np.flatnonzero(shares(tree, blocks.features()) > 0.5)
            texts: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for k in kept.tolist():
                texts[blocks.pages[k]].append(blocks.texts[k])
            joined = [" ".join(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(x) for x in own],
                    pa.array(joined, pa.string()),
                    pa.array([len(x) for x in joined], pa.int64()),
                ],
                [*own, "text", "n_chars"],
            )

    found = rows.mapInArrow(extract, schema)
    return found.select(*[F.col(x).alias(c) for c, x in zip(keep, own)], "text", "n_chars")
