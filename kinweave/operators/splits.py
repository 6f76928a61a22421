"""Folds, roles of references, isolation of queries, and which pairs train."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.similarity import extra_negative, fold, sampled

TRAIN, TUNE, CHECK, HELD = 0, 1, 2, 3


def roles(refs: DataFrame, seed: int, chosen: int, held_fold: int = 0, need_all: bool = True) -> DataFrame:
    """refs with fold and role: of the held-out fold `chosen` a country, half 1 (tune) and half 2 (check), its rest 3; the others 0.

    So nothing that was fitted on the other folds has seen a reference that decides. The sample is those of lowest md5 of seed
    and id: a fixed permutation, of which each half takes every other. A country whose held fold has fewer is
    an error, unless need_all is false: then all of them decide.
    """
    folded = refs.withColumn("fold", fold(F.col("entity_id")))
    held = folded.where(F.col("fold") == held_fold).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), "entity_id").cast("binary")))
    # Only the held fold is put in order; Spark keeps the first of each country early.
    least = Window.partitionBy("country").orderBy("key", "entity_id")
    first = held.withColumn("place", F.row_number().over(least)).where(F.col("place") <= chosen).select("country", "entity_id", "place")
    enough = first.groupBy("country").agg(F.count(F.lit(1)).alias("found"))
    joined = folded.join(first, ["country", "entity_id"], "left").join(enough, "country", "left")
    role = F.when(F.col("fold") != held_fold, TRAIN).when(F.col("place").isNull(), HELD).when(F.col("place") % 2 == 1, TUNE).otherwise(CHECK)
    if not need_all:
        return joined.withColumn("role", role).drop("place", "found")
    short = F.coalesce("found", F.lit(0)) < chosen
    message = F.concat(F.lit(f"fewer than {chosen} references in the held fold of "), "country")
    return joined.withColumn("role", F.when(short, F.raise_error(message).cast("int")).otherwise(role)).drop("place", "found")


def isolation(queries: DataFrame, pairs: DataFrame, refs: DataFrame, seed: int, modulus: int, held_fold: int = 0) -> DataFrame:
    """queries with eval and train: a query is for evaluation if its owner or any candidate is a tune or check reference.

    It trains if it isn't, its owner isn't in the held fold, and it is in the sample of one in `modulus`: so no reference
    that decides is ever seen in training.
    """
    # roles() bounds them by country, so they go to the pairs.
    selected = F.broadcast(refs.where(F.col("role").isin(TUNE, CHECK)).select("country", F.col("entity_id").alias("ref_id")))
    touched = pairs.join(selected, ["country", "ref_id"], "left_semi").select("country", F.col("query_id").alias("entity_id"))
    owned = queries.join(selected.withColumnRenamed("ref_id", "owner_id"), ["country", "owner_id"], "left_semi").select("country", "entity_id")
    marked = touched.unionByName(owned).distinct().withColumn("eval", F.lit(True))
    out = queries.join(marked, ["country", "entity_id"], "left").withColumn("eval", F.coalesce("eval", F.lit(False)))
    return out.withColumn("train", ~F.col("eval") & (F.coalesce(fold(F.col("owner_id")), F.lit(-1)) != held_fold) & sampled(seed, F.col("entity_id"), modulus))


def training_pairs(pairs: DataFrame, query_ordinal: str = "query_index", ref_ordinal: str = "ref_index", rank: int = fixed.NEGATIVE_RANK) -> DataFrame:
    """Pairs of training queries and training references that teach: true ones, those ranked high, and a tenth of the rest."""
    keep = F.col("label") | (F.col("combo_rank") <= rank) | extra_negative(F.col(query_ordinal), F.col(ref_ordinal))
    return pairs.where(F.col("train") & (F.col("role") == TRAIN) & keep)


def overlapping(pairs: DataFrame) -> DataFrame:
    """Pairs that both train and evaluate: there may be none."""
    return pairs.where(F.col("train") & F.col("eval"))


def stratified(rows: DataFrame, kind: Column, key: str, seed: int, most: int) -> DataFrame:
    """The `most` rows of each kind with the lowest md5 of seed and key: a sampling operator."""
    order = Window.partitionBy("kind").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary")), key)
    return rows.withColumn("kind", kind).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in an order that a hash of seed and key fixes."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def in_shard(rows: DataFrame, key: str, shard: int, shards: int = 4, seed: int = 7) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(shards)) == shard)
