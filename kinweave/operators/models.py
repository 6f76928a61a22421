"""Trained matchers: boosted trees over pair features, a text-pair scorer, and the stack of both."""

from __future__ import annotations

import hashlib
import json
import math
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from . import decisions, retrieval

#: Fixed budgets: the first model, and the regularised refit, whose small steps and large leaves stand for penalties that the library lacks.
FIRST = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 17}
STABLE = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.05, "minInstancesPerNode": 10, "subsamplingRate": 0.9, "seed": 17}
#: Pairs of texts that are described at a time; texts and grams that a task remembers.
PAIRS, MOST_TEXTS, MOST_GRAMS = 4_096, 50_000, 1_000_000


def train_trees(rows: DataFrame, features: list[str], label: str = "label", **budget) -> PipelineModel:
    """Gradient-boosted trees on the named columns, or on rows' vectors of them: the same rows and budget give the same model."""
    assembler = [] if "features" in rows.columns else [VectorAssembler(inputCols=features, outputCol="features")]
    trees = GBTClassifier(labelCol=label, featuresCol="features", **(FIRST | budget))
    return Pipeline(stages=[*assembler, trees]).fit(rows.withColumn(label, F.col(label).cast("double")))


def score_trees(rows: DataFrame, model: PipelineModel, keep: list[str]) -> DataFrame:
    """keep and score: the probability of a match. Features are computed and scored in one plan and never stored."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("score"))


def first_trees(model: PipelineModel, n: int) -> tuple[list, list[float]]:
    """The first n trees of a model, with their weights."""
    trees: GBTClassificationModel = model.stages[-1]
    return trees.trees[:n], [float(w) for w in trees.treeWeights[:n]]


def score_first_trees(rows: DataFrame, model: PipelineModel, keep: list[str], n: int) -> DataFrame:
    """As score_trees(), with the first n trees only: their weighted votes through the model's own link."""
    chosen, weights = first_trees(model, n)
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    margin = F.lit(0.0)
    for i, (tree, w) in enumerate(zip(chosen, weights)):
        # The column names differ by tree, so one plan holds all of them.
        tree.setPredictionCol(f"tree_{i}")
        rows = tree.transform(rows)
        margin = margin + w * F.col(f"tree_{i}")
    return rows.select(*keep, (1.0 / (1.0 + F.exp(-2.0 * margin))).alias("score"))


def importance(model: PipelineModel, features: list[str], top: int | None = 12) -> list[tuple[str, float]]:
    """Features by share of gain, highest first, by name among equals."""
    shares = model.stages[-1].featureImportances.toArray()
    return sorted(((f, float(s)) for f, s in zip(features, shares)), key=lambda x: (-x[1], x[0]))[:top]


def largest_update(model: PipelineModel) -> float:
    """The largest change that a tree after the first makes to a margin: what the leaf audit bounds."""
    trees: GBTClassificationModel = model.stages[-1]
    leaves = [abs(float(x)) * float(w) for tree, w in list(zip(trees.trees, trees.treeWeights))[1:] for x in re.findall(r"Predict: (-?[0-9.E-]+)", tree.toDebugString)]
    return max(leaves, default=0.0)


def describe(model: PipelineModel, features: list[str], threshold: float | None = None) -> dict:
    """What a frozen model is: its features, parameters, trees' checksum and threshold."""
    trees: GBTClassificationModel = model.stages[-1]
    return {"features": features, "trees": trees.getNumTrees, "depth": trees.getMaxDepth(), "sha256": hashlib.sha256(trees.toDebugString.split("\n", 1)[1].encode()).hexdigest(), "threshold": threshold}


def save(model: PipelineModel, path: str, features: list[str], threshold: float | None = None) -> None:
    """The model and, beside it, its description, written by Spark so that any store will do."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(describe(model, features, threshold)),)], "description string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def load(spark, path: str, features: list[str]) -> tuple[PipelineModel, dict]:
    """A saved model, refused unless it is what its description says and has these features and a threshold within range."""
    model = PipelineModel.load(f"{path}/model")
    wanted = json.loads(spark.read.text(f"{path}/description").first()[0])
    found = describe(model, features, wanted["threshold"])
    if found != wanted:
        raise ValueError(f"the model at {path} isn't the one described: {[k for k in wanted if wanted[k] != found[k]]} differ")
    if wanted["threshold"] is not None and not 0 <= wanted["threshold"] <= math.nextafter(1.0, 2.0):
        raise ValueError("the threshold is out of range")
    return model, wanted


class TextPairScorer(ABC):
    """Scores how likely two texts ("name | address") are of one business."""

    @abstractmethod
    def fit(self, pairs: DataFrame) -> TextPairScorer:
        """Learns from a, b and label."""

    @abstractmethod
    def score(self, pairs: DataFrame) -> DataFrame:
        """pairs with text_score, a probability."""


class HashedPairScorer(TextPairScorer):
    """The scorer that needs no weights from outside: shared and one-sided trigrams, hashed, in logistic regression.

    A transformer cross-encoder would implement the same two methods.
    """

    def __init__(self, features: int = 1 << 14, reg: float = 0.01, iterations: int = 30, cleaned: bool = False):
        """cleaned: the texts of pairs are what clean() makes of them, so each record's is cleaned once."""
        self.features, self.reg, self.iterations, self.cleaned, self.model = features, reg, iterations, cleaned, None

    @staticmethod
    def clean(text: Column) -> Column:
        return T.clean_words(F.coalesce(text, F.lit("")))

    def _coded(self, pairs: DataFrame) -> DataFrame:
        """pairs with features: what HashingTF, binary, makes of shared (=) and one-sided (<, >) trigrams and of the graded share (j).

        Grams are met as numbers, a batch of pairs at a time.
        """
        taken, size = pairs.columns, self.features
        texts = pairs if self.cleaned else pairs.select(*taken, self.clean(F.col("a")).alias("a_clean"), self.clean(F.col("b")).alias("b_clean"))
        a, b = ("a", "b") if self.cleaned else ("a_clean", "b_clean")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = _PairFeatures(size)
            for whole in batches:
                for start in range(0, whole.num_rows, PAIRS):
                    batch = whole.slice(start, PAIRS)
                    starts, places = features.of(batch.column(a), batch.column(b))
                    lists = [pa.ListArray.from_arrays(starts, x) for x in (pa.array(places), pa.array(np.ones(len(places))))]
                    vectors = pa.StructArray.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), pa.array(np.full(batch.num_rows, size, np.int32)), *lists], ["type", "size", "indices", "values"])
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in taken], vectors], names=[*taken, "features"])

        coded = texts.mapInArrow(run, StructType([*pairs.schema.fields, StructField("features", VectorUDT())]))
        # Else a row is made only to see how long its vector is.
        return coded.select(*taken, F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": size}}))

    def fit(self, pairs: DataFrame) -> HashedPairScorer:
        regression = LogisticRegression(labelCol="label", regParam=self.reg, maxIter=self.iterations)
        self.model = regression.fit(self._coded(pairs).select("features", F.col("label").cast("double").alias("label")))
        return self

    def score(self, pairs: DataFrame) -> DataFrame:
        out = self.model.transform(self._coded(pairs))
        return out.select(*pairs.columns, vector_to_array("probability")[1].alias("text_score"))


def _murmur(term: bytes, seed: int = 42) -> int:
    """32 bits of Murmur3, as HashingTF takes them."""
    mix = lambda k: ((k := k * 0xCC9E2D51 & 0xFFFFFFFF) << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
    h, whole = seed, len(term) & ~3
    for i in range(0, whole, 4):
        h ^= mix(int.from_bytes(term[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    if whole < len(term):
        h ^= mix(int.from_bytes(term[whole:], "little"))
    h ^= len(term)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _place(term: str, size: int) -> int:
    """Where HashingTF puts a term."""
    h = _murmur(term.encode("utf-8", "surrogatepass"))
    return (h - (h >> 31 << 32)) % size


class _PairFeatures:
    """Places of the features of pairs of clean texts. Texts and grams met so far are remembered, within bounds."""

    def __init__(self, size: int):
        self.size, self.numbers, self.table, self.texts = size, {}, np.zeros((3, 1024), np.int32), {}
        # The share of common trigrams, graded: each grade holds those below it.
        self.grades = np.array([_place(f"j{i}", size) for i in range(11)], np.int32)

    def _number(self, gram: int) -> int:
        if (n := self.numbers.get(gram)) is None:
            n = self.numbers[gram] = len(self.numbers)
            if n == self.table.shape[1]:
                self.table = np.concatenate((self.table, np.zeros_like(self.table)), axis=1)
            letters = chr(gram >> 42) + chr(gram >> 21 & 0x1FFFFF) + chr(gram & 0x1FFFFF)
            self.table[:, n] = [_place(tag + letters, self.size) for tag in "=<>"]
        return n

    def _grams(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's grams, in order."""
        new = [x for x in dict.fromkeys(texts) if x not in self.texts]
        row, gram = retrieval._postings(new)
        grams, code = np.unique(gram, return_inverse=True)
        own = np.sort(row << 32 | np.array([self._number(g) for g in grams.tolist()], np.int64)[code] if len(grams) else row)
        edges = np.searchsorted(own, np.arange(len(new) + 1) << 32)
        own = own & 0xFFFFFFFF
        self.texts |= {x: own[low:high].astype(np.int32) for x, low, high in zip(new, edges, edges[1:])}
        return [self.texts[x] for x in texts]

    def of(self, a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair's features start, and their places, in order within each pair."""
        if len(self.texts) > MOST_TEXTS or len(self.numbers) > MOST_GRAMS:
            self.texts.clear()
            self.numbers.clear()
        n, keys = len(a), []
        for side in (a.dictionary_encode(), b.dictionary_encode()):
            grams = self._grams(side.dictionary.to_pylist())
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            text = side.indices.to_numpy()
            first, counts = (np.cumsum(sizes) - sizes)[text], sizes[text]
            ends = np.cumsum(counts)
            at = np.arange(ends[-1] if n else 0) + np.repeat(first - (ends - counts), counts)
            keys.append(np.repeat(np.arange(n) << 32, counts) | np.concatenate([*grams, np.zeros(0, np.int32)])[at])
        # Keys are in order on both sides: by pair, then by gram.
        left, right = keys
        at = np.searchsorted(right, left)
        shared = np.zeros(len(left), bool)
        inside = at < len(right)
        shared[inside] = right[at[inside]] == left[inside]
        also = np.zeros(len(right), bool)
        also[at[shared]] = True
        parts = left[shared], left[~shared], right[~also]
        pairs = [x >> 32 for x in parts]
        places = [self.table[tag][x & 0xFFFFFFFF] for tag, x in enumerate(parts)]
        common, *rest = (np.bincount(x, minlength=n) for x in pairs)
        share = np.floor(10 * common / np.maximum(1, common + sum(rest))).astype(np.int64) + 1
        pairs.append(np.repeat(np.arange(n), share))
        places.append(self.grades[np.arange(len(pairs[-1])) - np.repeat(np.cumsum(share) - share, share)])
        found = np.concatenate(pairs) * self.size + np.concatenate(places)
        found = np.unique(found.astype(np.int32) if n * self.size < 1 << 31 else found)
        which, place = np.divmod(found, self.size)
        return np.searchsorted(which, np.arange(n + 1)).astype(np.int32), place.astype(np.int32)


def length_sorted(pairs: DataFrame, partitions: int) -> DataFrame:
    """Pairs dealt and sorted by length, so that batches of a model hold texts about as long."""
    length = F.length("a") + F.length("b")
    return pairs.withColumn("pair_length", length).repartitionByRange(partitions, "pair_length").sortWithinPartitions("pair_length").drop("pair_length")


def fit_stack(rows: DataFrame, c: float = 1.0) -> tuple[list[float], float]:
    """Coefficients and intercept of logistic regression on the stack's terms: rows hold score, text_score and label."""
    terms = decisions.stack_terms(F.col("score"), F.col("text_score"))
    named = rows.select(F.col("label").cast("double").alias("label"), *[t.alias(f"t{i}") for i, t in enumerate(terms)])
    n = named.count()
    coded = VectorAssembler(inputCols=["t0", "t1", "t2"], outputCol="features").transform(named)
    fitted = LogisticRegression(regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(coded)
    return [float(x) for x in fitted.coefficients], float(fitted.intercept)
