"""The corpus pipeline over `documents`: language ID, line dedup, near-duplicates, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents;
the last returns ids. Stages never look at rows that went before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontaminate, langid, linededup, shingles
from kinweave.llm.common import cut
from kinweave.llm.queries import word_bpe_path

#: A document goes if its language can't be told: no letters, or no language likelier than the others together.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told, as they are; null, empty and letterless texts go.

    Learns from the labelled rows among docs. Where none is labelled no language can be told apart, so every document with a letter
    stays. Repeated rows are judged alike, an empty table stays empty, and other columns pass through under any name.
    """
    model = langid.train(langid.split_training(docs))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = {f"k{i}": c for i, c in enumerate(docs.columns)}
    found = langid.predict(docs, model, keep=named)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(k).alias(c) for k, c in named.items()])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that an earlier document or line has, or nearly has, out of each text; n_chars follows the text.

    The first by doc_id keeps the line. A document of which nothing is left goes; null and empty texts, and an empty table, stay.
    Rows alike in doc_id and text keep the same lines.
    """
    left = linededup.dedup(docs, exact_chars=1)
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near copies. Texts without a word, and rows without an id, stay.

    Rows alike in doc_id and text are one document and stay together; an empty table stays empty.
    """
    return shingles.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none. An empty benchmark drops nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256 of each row that is left; null is the empty text."""
    coded = bpe.bpe(docs, word_bpe_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: No stage's method can be said in SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            # Stages read their input more than once.
            docs = cut(docs)
    return docs
