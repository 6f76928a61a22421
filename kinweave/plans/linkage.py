"""The record-linkage chain over records: prepare, retrieve, describe, train, decide, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions.similarity import fold
from ..operators import batches, decisions, exports, features, models, priors, records, retrieval, splits
from .stages import Stage


def references(stats: DataFrame) -> DataFrame:
    return stats.where("source = 1")


def noisy(stats: DataFrame) -> DataFrame:
    return stats.where("source <> 1")


def prepared(inputs: dict, settings: dict) -> DataFrame:
    return records.record_stats(records.prepare(inputs["records"]))


def best_lists(stats: DataFrame, k: int = fixed.TOP_K, name_weight: float = fixed.NAME_WEIGHT, **how) -> DataFrame:
    """The modes' lists of all noisy records, of references that their states allow."""
    allowed, mask = T.allowed_states(F.col("name_script")), F.col("reference_state_mask")
    return retrieval.top_lists(noisy(stats), references(stats), k, name_weight, allowed=allowed, mask=mask, **how)


def candidate_pairs(inputs: dict, settings: dict) -> DataFrame:
    k = settings.get("top_k", fixed.TOP_K)
    return retrieval.union_lists(best_lists(inputs["prepared"], k, settings.get("name_weight", fixed.NAME_WEIGHT)), k)


def reference_roles(inputs: dict, settings: dict) -> DataFrame:
    """References that teach, tune and check: `chosen` a country decide, all of them from the held fold."""
    refs = references(inputs["prepared"]).select("country", "entity_id")
    return splits.roles(refs, settings.get("seed", 23), settings.get("chosen", 2_000), need_all=settings.get("need_all", False))


def query_split(inputs: dict, settings: dict) -> DataFrame:
    """Which queries evaluate and which train: one in `modulus` of those that touch no reference that decides."""
    queries = noisy(inputs["prepared"]).select("country", "entity_id", "owner_id")
    return splits.isolation(queries, inputs["candidates"], inputs["roles"], settings.get("seed", 23), settings.get("modulus", 1)).select("country", "entity_id", "eval", "train")


def query_side(stats: DataFrame) -> DataFrame:
    """Noisy records with twins, priors and the least frequency of their tokens."""
    queries = records.twins(noisy(stats))
    vocab = priors.vocabulary(references(stats))
    owned = F.col("owner_id").isNotNull()
    # Priors never see records of the held fold.
    teach = queries.where(F.coalesce(fold(F.col("owner_id")), F.lit(-1)) != 0)
    seen = priors.query_token_stats(queries, priors.token_priors(teach, owned), priors.base_rates(teach, owned), vocab)
    return features.with_frequencies(queries, vocab).join(seen, ["country", "entity_id"])


def reference_side(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    claimed = retrieval.claims(pairs).withColumnRenamed("ref_id", "entity_id")
    refs = features.with_frequencies(records.name_multiplicity(references(stats)), priors.vocabulary(references(stats)))
    return refs.join(claimed, ["country", "entity_id"], "left").withColumn("r_claims", F.coalesce("r_claims", F.lit(0)))


def with_context(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs with each query's context."""
    sizes = references(stats).groupBy("country").agg(F.count(F.lit(1)).alias("refs"))
    return pairs.join(retrieval.context(pairs, sizes), ["country", "query_id"])


def pair_rows(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs with both sides' columns and each query's context."""
    return features.sides(with_context(stats, pairs), query_side(stats), reference_side(stats, pairs)).withColumn("q_vocab_min", F.col("q_vocab_min"))


def pair_features(inputs: dict, settings: dict) -> DataFrame:
    """Both kinds of features of each pair, with its owner and label; settings may have them as stored vectors, for a reader of many passes, and keep columns of queries."""
    stats, pairs = inputs["prepared"], inputs["candidates"]
    both = batches.described(with_context(stats, pairs), query_side(stats), reference_side(stats, pairs), perturb=True, keep=("owner_id", *settings.get("keep", ())), vectors=settings.get("vectors", False))
    return both.withColumn("label", F.coalesce(F.col("owner_id") == F.col("ref_id"), F.lit(False)))


def scored_pairs(inputs: dict, settings: dict) -> DataFrame:
    rows = inputs["features"]
    # Ids as the ordinals of the sampling rule: small enough that its products stay whole.
    ordinal = lambda key: F.pmod(F.xxhash64(key), F.lit(1 << 31))
    split = inputs["split"].withColumnRenamed("entity_id", "query_id")
    roles = inputs["roles"].select("country", F.col("entity_id").alias("ref_id"), "role")
    parted = rows.join(split, ["country", "query_id"]).join(roles, ["country", "ref_id"]).withColumns({"query_index": ordinal("query_id"), "ref_index": ordinal("ref_id")})
    teach = splits.training_pairs(parted)
    try:
        return fit_and_score(rows, teach, settings)
    except Exception as e:
        if teach.isEmpty():
            raise ValueError("no pair may train: all queries touch a reference that decides, so choose fewer of those") from e
        raise


def fit_and_score(rows: DataFrame, teach: DataFrame, settings: dict) -> DataFrame:
    """All pairs with the score of trees fitted on those that teach."""
    model = models.train_trees(teach, features.BASE + features.PERTURB, **settings.get("trees", {}))
    return models.score_trees(rows, model, ["country", "query_id", "ref_id", "owner_id", "label"])


def decided(inputs: dict, settings: dict) -> DataFrame:
    scored = inputs["scored"]
    owners = scored.select("country", "query_id", "owner_id").distinct()
    return decisions.winners(scored).join(owners, ["country", "query_id"])


def threshold_chosen(inputs: dict, settings: dict) -> DataFrame:
    """(threshold, tune, check): the threshold that is best on the tune references, and what it gives there and on the check ones.

    A query whose winner is one of them has it among its candidates, so it never trained.
    """
    stats, won = inputs["prepared"], inputs["decided"]
    refs = inputs["roles"].select("country", F.col("entity_id").alias("ref_id"), "role")
    owned = noisy(stats).groupBy("country", F.col("owner_id").alias("ref_id")).agg(F.count(F.lit(1)).alias("truth"))
    truth = refs.join(owned, ["country", "ref_id"], "left").na.fill(0, ["truth"])
    curve = lambda role: decisions.metric_curve(won, truth.where(F.col("role") == role), decisions.grid())
    check = curve(splits.CHECK).groupBy("threshold").agg(F.avg("f_half").alias("check"))
    return decisions.choose_threshold(curve(splits.TUNE)).withColumnRenamed("value", "tune").join(check, "threshold", "left")


def matches(inputs: dict, settings: dict) -> DataFrame:
    stats, won, threshold = inputs["prepared"], inputs["decided"], settings.get("threshold")
    refs = references(stats).select("country", F.col("entity_id").alias("ref_id"))
    if threshold is None:
        chosen = inputs["threshold"].first()
        if chosen is None:
            raise ValueError("no reference of the held fold tunes the threshold: set one")
        threshold = chosen.threshold
    return exports.matches(refs, decisions.accept(won, threshold))


def one_owner(lists: DataFrame) -> None:
    twice = exports.claimed_twice(exports.edges(lists, "ref_id", "matches")).count()
    if twice:
        raise ValueError(f"{twice} records have more than one owner")


STAGES = [
    Stage("prepared", prepared, ("records",)),
    Stage("candidates", candidate_pairs, ("prepared",), ("name_weight", "top_k")),
    Stage("features", pair_features, ("prepared", "candidates")),
    Stage("roles", reference_roles, ("prepared",), ("seed", "chosen", "need_all")),
    Stage("split", query_split, ("prepared", "candidates", "roles"), ("seed", "modulus")),
    Stage("scored", scored_pairs, ("features", "roles", "split"), ("trees",)),
    Stage("decided", decided, ("scored",)),
    Stage("threshold", threshold_chosen, ("prepared", "roles", "decided")),
    Stage("matches", matches, ("prepared", "decided", "threshold"), ("threshold",), gate=one_owner),
]

#: Settings of a quick trial: few and small trees, short lists, two references a country that decide.
SMOKE = {"trees": {"maxIter": 3, "maxDepth": 3}, "top_k": 3, "chosen": 2}
