"""Main text of web pages: flat text blocks, judged by a decision tree on word counts and link densities of neighbours.

What HTML itself marks as menu, header, footer, sidebar, form or script is out by its element. A decision tree judges every other block
by its own words and link density, those of the blocks before and after it, whether it is a heading, and whether a class or id
around it names boilerplate. The tree is grown from the labelled pages below, which hold both outcomes with and without such names.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, texts_of

# HTML's elements by kind, and the words by which pages name what isn't article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head button canvas datalist iframe input label math noscript object option select svg textarea title video audio".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT_TAGS = frozenset("aside dialog footer form menu nav search fieldset".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset("ad ads advert advertisement banner breadcrumbs comment comments consent cookie disqus footer header menu nav navbar newsletter notice popup promo related replies reply share sidebar social sponsored subscribe widget".split())
#: A name that says what the page has or lacks, like "has-sidebar", doesn't name its element.
NOT_NAMES = frozenset("has no not with without".split())

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|xmp|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.S | re.I)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: An attribute: its name, then its value in double or single quotes or bare. A quote that never closes begins a bare value.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|[\s/=]+""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ITEMS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}
WATCHED = frozenset("class id role hidden aria-hidden style".split())


def attributes_of(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The watched attributes of the tag whose name ends at `at`, where the tag ends, whether it closes itself."""
    found: dict[str, str] = {}
    while m := ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1] and (name := m[1].lower()) in WATCHED:
            found.setdefault(name, next((v for v in m.groups()[1:] if v is not None), ""))
    return found, min(at + 1, len(page)), page[at - 1] == "/"


def is_named(value: str) -> bool:
    """Whether a class or id names boilerplate: one of its words is a name, like "sidebar" in "left-sidebar"."""
    for name in value.split():
        parts = {x.lower() for x in NAME_PARTS.findall(name)}
        if parts & NAMES and not parts & NOT_NAMES:
            return True
    return False


def _kind(tag: str, attributes: dict[str, str], in_main: bool) -> str:
    """What an element says of its content: drop (no text at all), out, named, or nothing."""
    if tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return "drop"
    if tag in OUT_TAGS or tag == "header" and not in_main or attributes.get("role", "").lower() in OUT_ROLES:
        return "out"
    return "named" if tag not in ("html", "body") and any(is_named(attributes.get(a, "")) for a in ("class", "id")) else ""


class Block:
    __slots__ = ("text", "words", "linked", "heading", "within", "out", "named")

    def __init__(self, text: str, words: int, linked: int, heading: bool, within: tuple = ()):
        self.text, self.words, self.linked, self.heading, self.within = text, words, linked, heading, within
        self.out = self.named = False


class Element:
    __slots__ = ("tag", "kind", "holds_page")

    def __init__(self, tag: str, kind: str):
        self.tag, self.kind, self.holds_page = tag, kind, False


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order; scripts, styles, comments, forms' controls and hidden parts leave none.

    A form, or what a class or id names, is an ordinary part of the page if it holds the page's main element or an h1.
    """
    page = RAW.sub(lambda m: " " if m[0][:4] == "<!--" else "", page)
    blocks: list[Block] = []
    stack: list[Element] = []
    open_tags: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    headings = links = dropped = mains = 0
    marked: tuple[Element, ...] = ()

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join([p for p, _ in parts])).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
                blocks.append(Block(text, len(text.split()), linked, headings > 0, marked))
            parts.clear()

    def pop() -> str:
        nonlocal headings, links, dropped, mains, marked
        last = stack.pop()
        tag = last.tag
        open_tags[tag] -= 1
        headings -= tag in HEADINGS
        links -= tag == "a"
        mains -= tag in ("article", "main")
        if last.kind == "drop":
            dropped -= 1
        elif last.kind:
            marked = marked[:-1]
        return tag

    def close(tag: str) -> None:
        if open_tags.get(tag):
            while pop() != tag:
                pass

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at and not dropped:
            parts.append((page[at : m.start()], links > 0))
        tag, ending = m[2].lower(), m[1]
        if page[m.end() : m.end() + 1] == ">":
            attributes, at, alone = {}, m.end() + 1, False
        else:
            attributes, at, alone = attributes_of(page, m.end())
        if tag in BLOCK:
            flush()
        elif tag == "br" and not dropped:
            parts.append((" ", False))
        if ending:
            close(tag)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            # A block ends an open paragraph; paragraphs hold no blocks.
            close("p")
        if tag in ITEMS and stack and stack[-1].tag in (tag, ITEMS[tag]):
            pop()
        if tag == "body":
            close("head")
        if tag == "a":
            close("a")
        if alone and tag not in BLOCK:
            continue
        if tag in ("h1", "main"):
            for element in marked:
                element.holds_page = True
        element = Element(tag, _kind(tag, attributes, mains > 0))
        stack.append(element)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        headings += tag in HEADINGS
        links += tag == "a"
        mains += tag in ("article", "main")
        if element.kind == "drop":
            dropped += 1
        elif element.kind:
            marked = (*marked, element)
    if at < len(page) and not dropped:
        parts.append((page[at:], links > 0))
    flush()
    for block in blocks:
        # Navigation and the like are out whatever they hold.
        block.out = any(e.kind == "out" and not (e.tag == "form" and e.holds_page) for e in block.within)
        block.named = any(e.kind == "named" and not e.holds_page for e in block.within)
    return blocks


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "named")

#: The labelled table, a page a line. Each block is its number of words, then h (heading), n (a class or id names boilerplate),
#: l (all linked) or %share linked, and + (main text), - (not) or x (out by its element, seen as a neighbour only).
LABELLED = """
1lx 1lx 1lx 1lx 1lx 1lx 8n- 11h+ 49+ 108+ 40+ 2+ 7+ 48+ 12x
1lx 1lx 1lx 1lx 1lx 1lx 9n- 11h+ 75+ 8+ 12+ 123+ 1+ 9+ 11x
1lx 1lx 1lx 1lx 1lx 1lx 13n- 5h+ 5+ 104+ 24+ 41+ 3+ 12+ 57+ 26+ 7+ 44+ 7+ 21+ 13x
1lx 1lx 1lx 1lx 1lx 1lx 7n- 8h+ 8+ 9+ 12x
1lx 1lx 1lx 1lx 1lx 1lx 12n- 4h+ 4+ 63+ 2+ 2+ 168+ 16+ 75+ 2+ 8x
1lx 1lx 1lx 1lx 1lx 5n- 8h+ 21+ 19+ 172+ 9x
1l- 1l- 1l- 1l- 1l- 6- 14h+ 70+ 13x
1l- 1l- 1l- 1l- 10- 9h+ 70+ 40+ 62+ 8x
1l- 2l- 1l- 2l- 14- 8h+ 8+ 85+ 4+ 7x
1l- 1l- 1l- 4- 10h+ 11+ 9+ 23+ 9+ 12+ 10x
1l- 1l- 1l- 8h+ 60+ 1+ 5+ 103+ 43+ 13x
2l- 1l- 3l- 6h+ 35+ 40+ 12+
1l- 1l- 1l- 55+ 30+ 8+ 6x
1l- 2l- 12h+ 5+ 80+ 64+ 9x
9h+ 44+ 3+ 52+ 70+ 6+
30+ 25+ 4+
7+
6h+ 5+
120+
1l- 1l- 9h+ 45+ 6n- 60+ 38+ 10n- 72+ 9x
1l- 1l- 7h+ 80+ 12n- 3nl- 64+ 5h+ 40+ 33+ 11x
2l- 1l- 8h+ 90+ 70+ 2hn- 4nl- 5nl- 3nl- 6nl- 9x
1l- 3l- 8h+ 40+ 110+ 66+ 2hn- 3n- 24n- 1nl- 3n- 60n- 1nl- 4n- 12n- 1nl- 8x
1l- 1l- 11h+ 72+ 35+ 3hn- 2nl- 45n- 2nl- 2nl- 31n- 2nl- 7x
2l- 2l- 7h+ 52+ 18+ 47+ 1hn- 38n- 4nl- 3nl- 9x
1l- 1l- 8h+ 50+ 9n- 55+ 41+ 13n- 52+ 60+ 7n- 49+ 22+ 11n- 57+ 9n- 95+ 10x
9n- 1nl- 1l- 1l- 10h+ 88+ 43+ 7x
16n- 2nl- 2nl- 1l- 6h+ 31+ 29+ 95+ 5n-
24n- 1nl- 1l- 9h+ 61+ 77+ 9n- 2nl-
1l- 1l- 5h+ 8%50- 66+ 92+ 12%25+ 48+ 5l- 6l- 4l- 6x
1l- 1l- 1l- 8h+ 3- 4l- 75+ 40+ 2l- 2l- 3l- 2l- 9x
1l- 1l- 10h+ 40%8+ 66%12+ 31%19+ 90%4+ 20%30+ 50+ 9x
1l- 2l- 9h+ 70+ 4l+ 65+ 8%75+ 58+ 10%90+ 44+ 7x
1l- 2l- 6h+ 82+ 2h+ 44+ 3h+ 51+ 12+ 1h+ 39+ 10x
1l- 1l- 7h+ 33+ 5+ 6+ 4+ 7+ 48+ 3+ 2+ 5+ 60+ 8x
2l- 1l- 2h- 4l- 5l- 3l- 3h- 6l- 4l- 7l- 8h+ 90+ 76+ 9x
1l- 1l- 8h+ 95+ 61+ 3h- 5l- 7l- 6l- 2h- 4l- 3l- 5l- 8x
1l- 1l- 9h+ 47+ 80+ 4h- 9l- 11l- 8l- 2l- 2l- 7x
2l- 2l- 2l- 5%60- 7%70- 6h+ 58+ 41+ 20%80- 14%90- 12l- 8x
1l- 8h+ 66n+ 49n+ 71n+ 5n- 1nl-
1l- 10hn+ 84n+ 52n+ 45n+ 97n+ 63n+ 2nl- 3nl-
2l- 7hn+ 58n+ 77n+ 90n+ 44n+ 3nl- 7x
1l- 1l- 2hn- 35n- 5nl- 2hn- 28n- 2nl- 9h+ 74+ 52+ 8x
1l- 1l- 2hn- 4nl- 4nl- 3nl- 8h+ 2+ 47+ 3+ 9x
3n- 1l- 1l- 8h+ 7+ 6n- 9+ 30+ 14+ 8x
1l- 1l- 1l- 1l-
2l- 3l- 2l- 4l- 2l- 3l- 9x
"""


_TOKEN = re.compile(r"(\d+)(h?)(n?)(l|%\d+)?([-+x])")


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and outcomes of the labelled blocks; those that are out by their element are neighbours only."""
    rows, outcomes = [], []
    for line in LABELLED.strip().split("\n"):
        tokens = [_TOKEN.fullmatch(x).groups() for x in line.split()]
        blocks = []
        for words, heading, named, link, outcome in tokens:
            share = 0 if not link else 100 if link == "l" else int(link[1:])
            block = Block("", int(words), round(int(words) * share / 100), bool(heading))
            block.named, block.out = bool(named), outcome == "x"
            blocks.append(block)
        for row, block, (*_, outcome) in zip(features_of(blocks), blocks, tokens):
            if not block.out:
                rows.append(row)
                outcomes.append(outcome == "+")
    return np.array(rows, dtype=float), np.array(outcomes)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple | bool:
    """A tree that splits where Gini impurity falls most (the first feature and lowest cut of equals): (feature, cut, low, high)."""
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    impurity = lambda part: len(part) * (p := part.mean()) * (1 - p)
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, k] <= cut
            loss = impurity(y[low]) + impurity(y[~low])
            if best is None or loss < best[0] - 1e-12:
                best = (loss, k, float(cut))
    if best is None:
        return bool(y.mean() >= 0.5)
    _, k, cut = best
    low = x[:, k] <= cut
    return (k, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree: tuple | bool, row: tuple) -> bool:
    while not isinstance(tree, bool):
        k, cut, low, high = tree
        tree = low if row[k] <= cut else high
    return tree


def features_of(blocks: list[Block]) -> list[tuple]:
    """What the tree sees of each block, by FEATURES: its own and its neighbours' word counts and link densities (in percent)."""
    sizes = [(0, 0.0), *((b.words, 100 * b.linked / b.words) for b in blocks), (0, 0.0)]
    return [(*sizes[i + 1], *sizes[i], *sizes[i + 2], int(b.heading), int(b.named)) for i, b in enumerate(blocks)]


def main_blocks(blocks: list[Block], tree: tuple | bool) -> list[bool]:
    return [not b.out and decide(tree, row) for b, row in zip(blocks, features_of(blocks))]


def main_text(page: str, tree: tuple | bool) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, good in zip(blocks, main_blocks(blocks, tree)) if good)


def extract(df: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, then text and n_chars (code points): the main text of each row's whole page.

    Null, empty and text-free pages give the empty text. Rows come out one for one, repeated ones included, very long ones
    whole; an empty table gives none, and other columns are left alone, whatever their names. Blocks are
    joined by an empty line, in page order; inside a block all white space is one space, and references are decoded.
    """
    tree = grow(*labelled())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page, tree) for page in texts_of(batch.column(len(keep)))]
        return batch_of([*keep, "text", "n_chars"], [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{html_column}`").alias("html"))
    return arrow_map(rows, run, schema + "text string, n_chars long", rows=128)
