"""Language identification: word frequencies first, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, batch_of, crc_bucket, kept, narrow, texts_of

WORDS = re.compile(r"[^\W\d_]+")
#: Longest and shortest n-grams for words that aren't known; labelled rows learned from, at most.
LONGEST, SHORTEST, TRAIN_ROWS = 5, 1, 1_000
#: Words that a worker remembers the score rows of, and the length beyond which it looks them up anew.
MEMO_WORDS, MEMO_CHARS = 150_000, 64
UNKNOWN = "und"


class Model:
    """Log frequencies in each language of words and of n-grams of words (with a space at both ends).

    units: a table of unit, is_word; scores: a row for each unit, a column for each language.
    """

    def __init__(self, languages: list[str], words: list[str], grams: list[str], scores: np.ndarray):
        self.languages, self.scores = languages, scores
        self.words, self.grams = words, grams

    def opened(self) -> Model:
        self.word_at = {w: i for i, w in enumerate(self.words)}
        self.gram_at = {g: i for i, g in enumerate(self.grams, len(self.words))}
        return self

    def rows(self, word: str) -> bytes:
        """The rows whose mean scores a word, packed: its own if it is known, else those of the longest known n-grams from each letter on."""
        if (at := self.word_at.get(word)) is not None:
            return np.int32(at).tobytes()
        padded, found, at, get = f" {word} ", [], 0, self.gram_at.get
        end = len(padded)
        while at < end:
            for size in range(min(LONGEST, end - at), SHORTEST - 1, -1):
                if (gram := get(padded[at : at + size])) is not None:
                    found.append(gram)
                    break
            at += 1
        return array("i", found).tobytes()


def split_training(df: DataFrame, doc_id: str = "doc_id", modulus: int = 3, held: int = 1) -> DataFrame:
    """The rows to learn from: those whose crc32 of the id isn't `held` modulo `modulus`."""
    return df.where(crc_bucket(doc_id, modulus) != held)


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """A model from `rows` labelled rows at most, those with the lowest hash of the id: the documented bound of the fit.

    Rows without a language or text teach nothing. Words are lower-cased runs of letters, of any length. Counts are summed on the
    executors; every word and n-gram of these rows comes to the driver, as many as `rows` texts hold.
    """
    labelled = narrow(df, id=doc_id, text=text, lang=lang).where("lang is not null").withColumn("key", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    highest = labelled.select("key").orderBy("key").limit(rows).agg(F.max("key")).first()[0]
    if highest is None:
        return Model([], [], [], np.zeros((0, 0)))
    chosen = labelled.where(F.col("key") <= highest).limit(rows).where("text is not null").select("lang", "text")
    # A limit leaves one partition.
    chosen = chosen.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, x in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words[lang].update(WORDS.findall(x.lower()))
        out: Counter = Counter()
        for lang, counts in words.items():
            for word, n in counts.items():
                out[lang, True, word] += n
                padded = f" {word} "
                for size in range(SHORTEST, LONGEST + 1):
                    for i in range(len(padded) - size + 1):
                        out[lang, False, padded[i : i + size]] += n
        return batch_of(["lang", "is_word", "unit", "n"], [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.bool_()), pa.array([k[2] for k in out], pa.string()), pa.array([*out.values()], pa.int64())])

    counts = arrow_map(chosen, count, "lang string, is_word boolean, unit string, n long").groupBy("lang", "is_word", "unit").agg(F.sum("n").alias("n")).toArrow()
    langs, is_word, units, n = (counts.column(c).to_pylist() for c in ("lang", "is_word", "unit", "n"))
    languages = sorted(set(langs))
    index = {x: i for i, x in enumerate(languages)}
    words, grams = ({u: i for i, u in enumerate(sorted({u for u, w in zip(units, is_word) if w == kind}))} for kind in (True, False))
    scores = np.full((len(words) + len(grams), len(languages)), 0.1)
    for lang, w, u, k in zip(langs, is_word, units, n):
        scores[words[u] if w else len(words) + grams[u], index[lang]] += k
    # Words are measured against words, n-grams against n-grams of their length.
    kinds = np.array([0] * len(words) + [len(g) for g in grams])
    for kind in set(kinds.tolist()):
        scores[kinds == kind] = np.log10(scores[kinds == kind] / scores[kinds == kind].sum(axis=0))
    return Model(languages, [*words], [*grams], scores)


def predict(df: DataFrame, model: Model, text: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """The columns that `keep` names (new name: column), then lang_pred and score for each row, from the text alone.

    Other columns are left alone, whatever their names. Null texts and texts without a letter are 'und' with score 0, and so is every text if nothing was learned. Ties go to
    the language first in order. Texts are read whole. The score is the winner's share of the languages' likelihoods, as
    of ten average words at most. Rows come out one for one, repeated ones included.
    """
    keep = keep or {}
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the rows that it was learned from
    key = uuid.uuid4().hex

    def opened() -> tuple[list[str], np.ndarray, Memo, Callable]:
        own = shared.value.opened()
        return own.languages, own.scores, Memo(own.rows, MEMO_WORDS), own.rows

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, scores, memo, look = kept(f"langid {key}", opened)
        best, share = [], []
        for x in texts_of(batch.column(len(keep))):
            words = WORDS.findall(x.lower())
            if not words or not languages:
                best.append(UNKNOWN)
                share.append(0.0)
                continue
            counts = Counter(words)
            rows = [memo[w] if len(w) <= MEMO_CHARS else look(w) for w in counts]
            each = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            weight = np.fromiter(counts.values(), np.float64, len(rows)) / np.maximum(each, 1)
            total = np.repeat(weight, each) @ scores[np.frombuffer(b"".join(rows), np.int32)]
            weights = np.exp((total - total.max()) * (math.log(10) * min(10, len(words)) / len(words)))
            best.append(languages[winner := int(np.argmax(total))])
            share.append(float(weights[winner] / weights.sum()))
        return batch_of([*keep, "lang_pred", "score"], [*(batch.column(i) for i in range(len(keep))), pa.array(best, pa.string()), pa.array(share, pa.float64())])

    schema = "".join(f"`{name}` {df.schema[source].dataType.simpleString()}, " for name, source in keep.items())
    rows = df.select(*[F.col(f"`{source}`").alias(f"k{i}") for i, source in enumerate(keep.values())], F.col(f"`{text}`").alias("t"))
    return arrow_map(rows, score, schema + "lang_pred string, score double", holds=True)
