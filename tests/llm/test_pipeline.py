"""The pipeline's stages in turn, each against what its input says."""

import os

import pytest

import corpus_pipeline as P
from kinweave.llm import decontaminate, linededup

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes, texts = docs.columns, [docs.count()], {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns and docs.dtypes == before.dtypes
            texts[name] = {r.doc_id: r for r in docs.collect()}
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0.5 * sizes[0]
    lines = [(linededup.normal(x)) for r in texts["line_dedup"].values() for x in r.text.split("\n")]
    long = [x for x in lines if len(x) >= linededup.MIN_CHARS]
    assert len(long) == len(set(long))
    assert all(r.n_chars == len(r.text) for r in texts["line_dedup"].values())
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, r in texts["jaccard_join"].items() if (w := r.text.lower().split())}
    ids = list(sets)
    assert not [(a, b) for n, a in enumerate(ids) for b in ids[:n] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    items = [decontaminate.Item(t, decontaminate.ERROR_RATE) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(t := decontaminate.normal(r.text)) >= decontaminate.MIN_CHARS]
    leaked = {i for i, r in texts["jaccard_join"].items() for x in items if x.text in decontaminate.normal(r.text)}
    assert leaked and not leaked & set(texts["decontamination"])


def test_run_is_the_stages(spark, tmp_path):
    rows = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in P.run(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert rows == {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in docs.collect()}


def test_exact_copy_with_a_short_title_leaves(spark):
    body = "This paragraph is long enough for the edit join to find it again."
    rows = [(1, f"A title\n\n{body}", "en", "s", 0), (2, f"A title\n\n{body}", "en", "s", 0), (3, "Another\n\nOf its own, this one keeps each line that it has.", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in P.dedup_lines(spark, docs, DATA).collect()}
    assert left == {1: rows[0][1], 3: rows[2][1]}


ODD = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "the cat sat on the mat and looked at the other dog", "en"), (4, "the cat sat on the mat and looked at the other dog", "en"), (5, "the cat sat on the mat and looked at the other dog", "en"), (6, "der Hund und die Katze sind nicht im Haus " * 2000, "de"), (None, "eine Katze ohne Nummer ist auch im Haus", "de")]


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    rows = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    rows = rows.selectExpr("*", "1 AS id", "'k' AS k", "2 AS `row`", "3 AS dropped", "'t' AS t", "4 AS k0", "5 AS lang_pred", "6 AS score")
    out = stage(spark, rows, DATA)
    got = sorted((r.doc_id or 0) for r in out.collect())
    assert got == {"language_id": [0, 4, 4, 5, 6], "line_dedup": [0, 1, 2, 3, 4, 4, 6], "jaccard_join": [0, 1, 2, 3, 4, 4, 6]}.get(name, [0, 1, 2, 3, 4, 4, 5, 6])
    if name != "bpe":
        assert out.columns == rows.columns and stage(spark, out.where("false"), DATA).columns == rows.columns
    assert stage(spark, rows.where("false"), DATA).count() == 0


def test_without_labels_every_document_with_a_letter_stays(spark):
    rows = spark.createDataFrame([(1, "words", None, "s", 5), (2, "12", None, "s", 2), (3, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P.identify_language(spark, rows, DATA).collect()] == [1]
