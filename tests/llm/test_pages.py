"""Page extraction against a second parser, and the tree's precision and recall on pages that it didn't learn from."""

import os
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from kinweave.llm import pages

DATA = "/root/testdata/sf0.01"


class Plain(HTMLParser):
    """Blocks of well-formed pages: [text, linked words, heading, out, named]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.text, self.linked = [], [], "", 0

    def flush(self):
        if text := " ".join(self.text.split()):
            tags = [t for t, _ in self.stack]
            names = {n for t, c in self.stack if t not in ("nav", "footer", "aside") for n in c.split()}
            self.blocks.append([text, self.linked, any(re.fullmatch("h[1-6]", t) for t in tags), bool({"nav", "footer", "aside"} & {*tags}), "sidebar" in names])
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attributes):
        if tag in pages.BLOCK:
            self.flush()
        if tag == "br":
            self.text += " "
        elif tag != "img":
            self.stack.append((tag, dict(attributes).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in pages.BLOCK:
            self.flush()
        assert self.stack.pop()[0] == tag

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "script" not in tags and "style" not in tags:
            self.text += data
            if "a" in tags:
                self.linked += len(data.split())


def random_page(r):
    def inline(n):
        return " ".join(r.choice(["word", "caf&eacute;", "a&amp;b", '<a href="x">two words</a>', "<b>bold</b>", "<br>", "x &lt; y", '<img alt="a>b">', "\n\t"]) for _ in range(n))

    def block(depth):
        tag = r.choice(["div", "p", "h2", "ul", "section", "nav", "footer", "aside"] if depth else ["div", "section"])
        attribute = r.choice(["", ' class="left sidebar"', " title='a > b'", " class=x data-class='sidebar'", ' id="k9"'])
        if tag in ("p", "h2"):
            return f"<{tag}{attribute}>{inline(r.randrange(1, 9))}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{inline(r.randrange(4))}</li>" for _ in range(r.randrange(4))) + "</ul>"
        return f"<{tag}{attribute}>{inline(r.randrange(3))}" + "".join(block(depth - 1) for _ in range(r.randrange(3)) if depth > 0) + f"</{tag}>"

    return "<html><body>" + r.choice(["", "<script>var t='<p>no</p>';</script>", "<!-- <p>no</p> -->"]) + "".join(block(3) for _ in range(r.randrange(6))) + "</body></html>"


def test_blocks_are_a_second_parsers():
    r = random.Random(4)
    for _ in range(600):
        page, plain = random_page(r), Plain()
        plain.feed(page)
        plain.flush()
        assert [[b.text, b.linked, b.heading, b.out, b.named] for b in pages.blocks_of(page)] == plain.blocks, page


def test_features_and_tree_are_the_plain_ones():
    r, (x, y) = random.Random(5), pages.labelled()
    tree = pages.grow(x, y)
    for _ in range(100):
        blocks = pages.blocks_of(random_page(r))
        for i, row in enumerate(pages.features_of(blocks)):
            sizes = [(len(b.text.split()), 100 * b.linked / len(b.text.split())) for b in blocks]
            before, after = sizes[i - 1] if i else (0, 0), sizes[i + 1] if i + 1 < len(sizes) else (0, 0)
            assert row == (*sizes[i], *before, *after, blocks[i].heading, blocks[i].named)
            # What the tree says is what the labelled rows in its leaf say.
            node, rows = tree, list(zip(x.tolist(), y.tolist()))
            while not isinstance(node, bool):
                k, cut, low, high = node
                rows = [(f, l) for f, l in rows if (f[k] <= cut) == (row[k] <= cut)]
                node = low if row[k] <= cut else high
            assert rows and pages.decide(tree, row) == (2 * sum(l for _, l in rows) >= len(rows))


VARIANTS = {
    "as it is": lambda h: h,
    "no article": lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>"),
    "no names": lambda h: VARIANTS["no article"](h).replace(' class="ad"', ""),
    "menu of plain elements": lambda h: VARIANTS["no names"](h).replace("<nav>", "<div>").replace("</nav>", "</div>"),
    "inside a form": lambda h: h.replace("<body>", "<body><form method=post>"),
    "a name that says little": lambda h: VARIANTS["no article"](h).replace("<body>", "<body><div class='content has-sidebar'>"),
    "a name that is wrong": lambda h: VARIANTS["no article"](h).replace("<body>", "<body><div class='sidebar'>"),
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", VARIANTS)
def test_held_out_pages(name):
    """Page ids 30 and up: none of them is in the labelled table."""
    duckdb = pytest.importorskip("duckdb")
    rows = duckdb.connect().execute(f"SELECT html FROM '{DATA}/pages.parquet' WHERE page_id >= 30 AND html LIKE '%<article>%'").fetchall()
    tree, right, found, wanted = pages.grow(*pages.labelled()), 0, 0, 0
    for (page,) in rows:
        truth = Counter(b.text for b in pages.blocks_of(re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]))
        got = Counter(x for x in pages.main_text(VARIANTS[name](page), tree).split("\n\n") if x)
        right, found, wanted = right + (truth & got).total(), found + got.total(), wanted + truth.total()
    assert wanted > 1000 and right / found > 0.95 and right / wanted > 0.95


def test_word_counts_and_link_densities_decide():
    x, y = pages.labelled()
    for named in (0, 1):
        assert {*y[x[:, pages.FEATURES.index("named")] == named].tolist()} == {True, False}

    def used(node):
        return set() if isinstance(node, bool) else {pages.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    tree = pages.grow(x, y)
    assert {"words", "density", "words_before", "density_before", "words_after", "density_after"} <= used(tree) and pages.FEATURES[tree[0]] == "density"
    assert (sum(pages.decide(tree, row) == label for row, label in zip(x.tolist(), y.tolist())) / len(y)) > 0.99


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<p title='" + "x" * 9000 + ">'>long value</p>", "long value"),
        ("<p class=a\"b>one</p><p class='open>two</p><p>three</p>", "one\n\ntwo\n\nthree"),
        ("<div data-x='hidden' title='class=ad'><p>kept, as values are no attributes</p></div>", "kept, as values are no attributes"),
        ("<p>shown</p><p hidden>not</p><div style='display: none'>not</div><p aria-hidden=true>not</p>", "shown"),
        ("", ""), ("no tags at all", "no tags at all"), ("<p>  &nbsp; </p>", ""), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_odd_markup(page, wanted):
    assert pages.main_text(page, pages.grow(*pages.labelled())) == wanted


def test_repeated_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "u", "<p>one</p>"), (1, "u", "<p>one</p>"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS k0")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in pages.extract(rows).collect()) == [(0, "", 0), (1, "one", 3), (1, "one", 3)]
