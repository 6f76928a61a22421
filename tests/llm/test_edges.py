"""Nulls, empty and very long texts, repeated rows, empty tables and columns of clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from kinweave.llm import bpe, brown, decontaminate, embeddings, langid, licenses, linededup, pages, secrets, shingles
from kinweave.llm.queries import word_bpe_path

LONG = "the quick brown fox jumps over the lazy dog and runs away " * 3000
TEXTS = [(1, "the cat sat on the mat and looked at the dog"), (1, "the cat sat on the mat and looked at the dog"), (2, None), (3, ""), (None, "le chat est sur le tapis avec le chien"), (4, LONG), (5, " \n\t"), (6, "x" * 50_000), (None, None)]
#: Names that operators use inside, and the columns they return.
EXTRA = {"id": 1, "k": "a", "s": 2, "score": "z", "spans": 0, "row": 1, "part": 3, "class_id": 1, "n_tokens": "q", "label": 1, "component": 1, "dropped": 0, "left": "l", "first": 3, "__id": 1, "__k": 2, "__dropped": 1, "__left": 4, "m": 5, "n": 6}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "en" if i != 2 else None, None if i == 3 else "s", 0) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit(v) for c, v in EXTRA.items()})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "short")], "item_id long, text string")


OPERATORS = {
    "brown": lambda d: brown.score(d),
    "secrets": lambda d: secrets.secret_scan(d),
    "licenses": lambda d: licenses.license_scan(d, model=licenses.Model(["mit", "none"], ["mit"], __import__("numpy").array([[2.0, -2.0]]), __import__("numpy").array([0.0, 1.0]), 0.5)),
    "bpe": lambda d: bpe.bpe(d, word_bpe_path()),
    "langid": lambda d: langid.predict(d, langid.train(d), keep={"doc_id": "doc_id", "id": "id"}),
    "linededup": lambda d: linededup.repeated(d),
    "shingles": lambda d: shingles.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, name):
    assert OPERATORS[name](docs).count() == len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name](docs.where("false")).count() == 0


def test_filters_keep_columns(docs, items):
    for out in (linededup.dedup(docs), shingles.keep_one(docs), decontaminate.clean(docs, items)):
        assert out.columns == docs.columns
        assert out.where("false").count() == 0
    assert decontaminate.clean(docs, items).where("text is null").count() == 2
    assert decontaminate.clean(docs, items.where("false")).count() == len(TEXTS)
    assert linededup.dedup(docs.where("false")).count() == shingles.keep_one(docs.where("false")).count() == 0


def test_matches(docs, items, spark):
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs.withColumns({"item_id": F.lit(9), "distance": F.lit("x")}), items.withColumn("doc_id", F.lit(1))).collect())
    assert got == [(4, 1, 0)]
    again = spark.createDataFrame([(1, "a short one"), (1, "a short one"), (None, "SHORT"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.item_id) for r in decontaminate.matches(again, items).collect())) == [(0, 4), (1, 4), (1, 4)]
    assert decontaminate.matches(docs.where("false"), items).count() == decontaminate.matches(docs, items.where("false")).count() == 0


def test_null_and_empty_results(docs):
    for name, check in {
        "brown": lambda r: r.n_tokens == 1,
        "secrets": lambda r: r.spans == "" and r.base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
        "licenses": lambda r: r.family == "none" and r.n_paragraphs == 0,
        "bpe": lambda r: r.n_tokens == 0 and bytes(r.ids) == b"" and r.decoded == "",
        "langid": lambda r: r.lang_pred == "und" and r.score == 0.0,
        "linededup": lambda r: r.n_dropped == 0,
        "shingles": lambda r: r.n_links == 0 and r.class_id == r.doc_id,
    }.items():
        rows = OPERATORS[name](docs).where("doc_id in (2, 3)").collect()
        assert len(rows) == 2 and all(map(check, rows)), name


def test_repeated_rows_are_copies(docs):
    rows = shingles.near_duplicates(docs).where("doc_id = 1").collect()
    assert [(r.class_id, r.n_links) for r in rows] == [(1, 1), (1, 1)]
    assert {r.n_dropped for r in linededup.repeated(docs).where("doc_id = 1").collect()} == {0}


def test_embeddings(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0], 1), (13, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"s": F.lit(1), "block": F.lit(2), "n": F.lit(1)})
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    alone = [(i, 0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted([(1, 4, 1), (2, 4, 1), (3, 4, 1), (13, 4, 1), (13, 4, 1), *alone])
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 50_000), (None, "u", "<<<>>>&&& <p")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r for r in pages.extract(rows).collect()}
    assert len(got) == 4 and got[1].text == got[2].text == "" and got[1].n_chars == 0 and got[3].n_chars == 50_000 * 5 - 1
    assert pages.extract(rows.where("false")).count() == 0


def test_very_long_line_and_ties(spark):
    long = "a" * 100_000
    df = spark.createDataFrame([(2, long), (1, long + "b"), (3, long[:-1])], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in linededup.repeated(df).collect()} == {1: 0, 2: 1, 3: 1}


def test_lines_are_not_gone_through_for_what_they_do_not_hold(monkeypatch):
    # Normal lines were cut into words and put together, and every letter was held against seven ranges of scripts.
    from kinweave.llm import linededup

    class Line(str):
        def lower(self):
            return Line(super().lower())

        def split(self, *a):
            raise AssertionError("a normal line needs no cutting")

    class Ranges(tuple):
        def __iter__(self):
            raise AssertionError("no letter is near these scripts")

    line = "Ein Satz für die Probe, " * 8 + "ende"
    assert linededup.normal(Line(line)) == line.lower()
    odd = ["", " ", "a", " a", "a ", "a  b", "a\tb", "a　b", "a b", "a​b", "a\x1fb", "a b", "İ Σ", "ΑΣ", "x\ud800y", "東京 都"]
    assert [linededup.normal(x) for x in odd] == [" ".join(x.lower().split()) for x in odd]
    wanted = linededup.word_keys([line, line + " x"], 100)
    monkeypatch.setattr(linededup, "UNSPACED", Ranges(linededup.UNSPACED))
    assert all((a == b).all() for a, b in zip(wanted, linededup.word_keys([line, line + " x"], 100)))
    assert len(wanted[0]) and len(wanted[2])
