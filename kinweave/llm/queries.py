"""The queries over this subpackage's operators: each takes (spark, sf_dir) and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, decontaminate, embeddings, langid, licenses, linededup, pages, secrets, shingles
from .common import crc_bucket, documents


def word_bpe_path() -> str:
    """Where the public tokenizer's file lies, unless a caller names another."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe(documents(spark, sf_dir), word_bpe_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated(documents(spark, sf_dir), exact_chars=1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(langid.split_training(docs))
    found = langid.predict(docs, model, keep={"doc_id": "doc_id"})
    return found.withColumn("held_out", crc_bucket("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_duplicates(documents(spark, sf_dir))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(documents(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_score": op1_brown_score,
        "op2_secret_scan": op2_secret_scan,
        "op3_license_scan": op3_license_scan,
        "op4_decontamination": op4_decontamination,
        "op5_bpe": op5_bpe,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_language_id": op8_language_id,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_main_text": op10_main_text,
    }


#: What links and components of op6 are, by comparing all vectors of a label.
OP6_SQL = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a),
top AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, t.component_id, e.vec_id = t.component_id AS kept FROM embeddings e JOIN top t ON e.vec_id = t.a LEFT JOIN degree d ON e.vec_id = d.a"""

#: What links and classes of op9 are, by counting shared word n-grams.
OP9_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes p ON s.a = p.doc_id JOIN sizes q ON s.b = q.doc_id WHERE s.n / (p.n + q.n - s.n) >= 0.8),
reach(a, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a),
top AS (SELECT a, min(r) AS class_id FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, t.class_id, coalesce(k.n, 0) AS n_links, d.doc_id = t.class_id AS kept FROM documents d JOIN top t ON d.doc_id = t.a LEFT JOIN degree k ON d.doc_id = k.a"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express at the size it is checked at; tests compare the others with plain Python."""
    return {"op6_embedding_near_dedup": OP6_SQL, "op9_jaccard_join": OP9_SQL}
