"""From pair scores to decisions: winners, the per-entity metric over thresholds, the stack, and the rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.similarity import logit, sigmoid

KINDS = ("tp", "wrong_owner", "unmatched")


def winners(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row a query: the reference of the highest score, the lower id of equals, and the runner-up's score (-1 if alone).

    A query names a reference once. One pass: Spark keeps the first two rows of a query before it shuffles them, and the
    aggregate lies as the window does.
    """
    order = Window.partitionBy("country", "query_id").orderBy(F.desc(score), "ref_id")
    two = scored.select("country", "query_id", "ref_id", F.col(score).alias("score"), F.row_number().over(order).alias("place")).where("place <= 2")
    at = lambda column, place: F.max(F.when(F.col("place") == place, F.col(column)))
    return two.groupBy("country", "query_id").agg(at("ref_id", 1).alias("ref_id"), at("score", 1).alias("score"), F.coalesce(at("score", 2), F.lit(-1.0)).alias("runnerup_score"))


def grid() -> list[float]:
    """Thresholds of the metric: 201 from 0 to 1, a few close to 1, and one that nothing reaches."""
    return sorted({i / 200 for i in range(201)} | {0.9975, 0.999, 0.9995, 0.9999, math.nextafter(1.0, 2.0)})


def stack_grid() -> list[float]:
    """Thresholds of the stack: 69 from 0.30 to 0.98 and three above."""
    return [round(0.30 + i / 100, 2) for i in range(69)] + [0.985, 0.99, 0.995]


def outcome(owner: str = "owner_id", ref: str = "ref_id") -> Column:
    """What a decided record is: tp, of a wrong owner, or without an owner."""
    return F.when(F.col(owner).isNull(), "unmatched").when(F.col(owner) == F.col(ref), "tp").otherwise("wrong_owner")


def histogram(decided: DataFrame, thresholds: list[float]) -> DataFrame:
    """(country, ref_id, kind, bin, n): winners by the last threshold that their score reaches.

    The bin is found by counting thresholds, so winners never meet the grid in a join.
    """
    literal = F.array(*map(F.lit, thresholds))
    place = F.size(F.filter(literal, lambda t: t <= F.col("score"))) - 1
    return decided.select("country", "ref_id", outcome().alias("kind"), place.alias("bin")).where("bin >= 0").groupBy("country", "ref_id", "kind", "bin").agg(F.count(F.lit(1)).alias("n"))


def f_half(tp: Column, fp: Column, truth: Column) -> Column:
    """F0.5 of an entity, 1 where nothing is true and nothing is claimed."""
    down = 4.0 * tp + 4.0 * fp + truth
    return F.when(down == 0, 1.0).otherwise(5.0 * tp / down)


def metric_curve(decided: DataFrame, refs: DataFrame, thresholds: list[float], stress: float = fixed.UNMATCHED_STRESS) -> DataFrame:
    """(country, bin, threshold, f_half, f_stress, tp, wrong_owner, unmatched): means and sums over a country's references.

    refs: (country, ref_id, truth). Scores are binned once; counts at a threshold are running sums from the highest bin
    down. Only references with a decision are followed over the grid; the others' share is the same at every threshold.
    """
    binned = histogram(decided, thresholds)
    wide = binned.groupBy("country", "ref_id", "bin").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS])
    running = Window.partitionBy("country", "ref_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lower = F.lead("bin", 1, -1).over(Window.partitionBy("country", "ref_id").orderBy(F.desc("bin")))
    # Between two bins of a reference nothing changes: its row stands for all thresholds down to the next.
    steps = wide.select("country", "ref_id", "bin", lower.alias("next"), *[F.sum(k).over(running).alias(k) for k in KINDS])
    # A reference of the list that no record claims above its highest bin scores as if there were none.
    truth = refs.select("country", "ref_id", "truth")
    none = f_half(F.lit(0.0), F.lit(0.0), F.col("truth"))
    change = steps.join(truth, ["country", "ref_id"]).select(
        "country", F.explode(F.sequence(F.col("next") + 1, F.col("bin"))).alias("bin"), *KINDS,
        (f_half(F.col("tp"), F.col("wrong_owner") + F.col("unmatched"), F.col("truth")) - none).alias("d"),
        (f_half(F.col("tp"), F.col("wrong_owner") + stress * F.col("unmatched"), F.col("truth")) - none).alias("ds"),
    )
    sums = change.groupBy("country", "bin").agg(F.sum("d").alias("d"), F.sum("ds").alias("ds"), *[F.sum(k).alias(k) for k in KINDS])
    whole = truth.groupBy("country").agg(F.count(F.lit(1)).alias("refs"), F.sum(none).alias("base"))
    points = whole.select("country", "refs", "base", F.posexplode(F.array(*map(F.lit, thresholds))).alias("bin", "threshold"))
    mean = lambda c: ((F.col("base") + F.coalesce(c, F.lit(0.0))) / F.col("refs")).alias
    return points.join(sums, ["country", "bin"], "left").select("country", "bin", "threshold", mean("d")("f_half"), mean("ds")("f_stress"), *[F.coalesce(k, F.lit(0)).alias(k) for k in KINDS])


def choose_threshold(curve: DataFrame, metric: str = "f_half", strictest: bool = True) -> DataFrame:
    """(threshold, value): the best mean over countries, of equals (to 12 digits) the highest threshold, or the lowest."""
    means = curve.groupBy("threshold").agg(F.round(F.avg(metric), 12).alias("value"))
    return means.orderBy(F.desc("value"), F.desc("threshold") if strictest else F.asc("threshold")).limit(1)


def weighted_mean(curve: DataFrame, metric: str = "f_half", weights: dict[str, float] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(threshold, value): the metric's mean over countries by given shares, or by their number of references (country, refs)."""
    if weights is not None:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        rated = curve.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("country")), F.lit(0.0)))
    else:
        rated = curve.join(F.broadcast(sizes.select("country", F.col("refs").cast("double").alias("weight"))), "country")
    return rated.groupBy("threshold").agg((F.sum(F.col(metric) * F.col("weight")) / F.sum("weight")).alias("value"))


def at_threshold(decided: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """A row a country: true positives, both kinds of false ones, misses, entities without truth and how many of those are merged."""
    accepted = decided.where(F.col("score") >= threshold).withColumn("kind", outcome()).groupBy("country", "ref_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    joined = refs.join(accepted, ["country", "ref_id"], "left").na.fill(0, list(KINDS))
    empty, claimed = F.col("truth") == 0, F.col("tp") + F.col("wrong_owner") + F.col("unmatched") > 0
    return joined.groupBy("country").agg(
        *[F.sum(k).alias(k) for k in KINDS], F.sum(F.col("truth") - F.col("tp")).alias("fn"), F.count_if(empty).alias("zero_truth"), (F.count_if(empty & claimed) / F.greatest(F.lit(1), F.count_if(empty))).alias("zero_truth_merged")
    )


def oracle_f_half(recovered: Column, truth: Column) -> Column:
    """F0.5 with perfect decisions among the candidates."""
    return F.when(truth == 0, 1.0).otherwise(5.0 * recovered / (4.0 * recovered + truth))


def worst_errors(decided: DataFrame, most: int = 100) -> DataFrame:
    """The wrong assignments of the highest scores: a top-k report."""
    return decided.withColumn("kind", outcome()).where("kind <> 'tp'").orderBy(F.desc("score"), "query_id").limit(most)


def stack_terms(s: Column, t: Column) -> list[Column]:
    a, b = logit(s), logit(t)
    return [a, b, a * b / fixed.PRODUCT_SCALE]


def stacked(s: Column, t: Column, coefficients: list[float], intercept: float) -> Column:
    """The stack's probability from two scores and frozen coefficients."""
    terms = stack_terms(s, t)
    return sigmoid(sum((c * x for c, x in zip(coefficients, terms)), F.lit(intercept)))


def decoy(query_tokens: Column, ref_tokens: Column, query_house: Column, ref_house: Column) -> Column:
    """Whether a pair looks like a neighbour's record: no new name word, house numbers as long and 1 to 9 apart. Null keeps."""
    gap = F.abs(query_house.try_cast("bigint") - ref_house.try_cast("bigint"))
    rule = (F.size(F.array_except(query_tokens, ref_tokens)) == 0) & (F.length(query_house) == F.length(ref_house)) & gap.between(1, 9)
    return F.coalesce(rule, F.lit(False))


def accept(decided: DataFrame, threshold: float, removed: DataFrame | None = None) -> DataFrame:
    """Winners that reach the threshold, without those that a rule removed: (country, query_id, ref_id)."""
    out = decided.where(F.col("ref_id").isNotNull() & (F.col("score") >= threshold))
    return out if removed is None else out.join(removed, ["query_id", "ref_id"], "left_anti")


def overridden(rows: DataFrame, other: DataFrame, country: str, key: str = "ref_id", value: str = "matches") -> DataFrame:
    """rows whose value is the other model's in one country, empty where that has none; elsewhere as it was."""
    theirs = other.select(F.col(key), F.col(value).alias("theirs"))
    return rows.join(theirs, key, "left").withColumn(value, F.when(F.col("country") == country, F.coalesce("theirs", F.lit(""))).otherwise(F.col(value))).drop("theirs")
