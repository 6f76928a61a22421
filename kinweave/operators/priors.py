"""What is learned from the data by counting: vocabularies, token priors and native-to-Latin dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def vocabulary(refs: DataFrame, tokens: str = "tok") -> DataFrame:
    """(country, token, freq): how many references of a country have each token among their distinct ones."""
    return refs.select("country", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("country", "token").agg(F.count(F.lit(1)).alias("freq"))


def base_rates(queries: DataFrame, owned: Column) -> DataFrame:
    """(country, p0): the share of queries that have an owner; give only rows to learn from."""
    return queries.groupBy("country").agg(F.avg(owned.cast("double")).alias("p0"))


def token_priors(queries: DataFrame, owned: Column, tokens: str = "tok", smoothing: float = fixed.PRIOR_SMOOTHING, least: int = fixed.PRIOR_MIN_COUNT) -> DataFrame:
    """(country, token, n, matched, prior): how likely a query with a token has an owner, drawn to the base rate.

    A token of fewer than `least` queries has the base rate. Counts are summed before the shuffle; base rates have a row a
    country and are broadcast.
    """
    each = queries.select("country", owned.alias("owned"), F.explode(F.array_distinct(tokens)).alias("token"))
    counts = each.groupBy("country", "token").agg(F.count(F.lit(1)).alias("n"), F.count_if("owned").alias("matched"))
    rated = counts.join(F.broadcast(base_rates(queries, owned)), "country")
    return rated.select("country", "token", "n", "matched", _smoothed(F.col("n"), F.col("matched"), F.col("p0"), smoothing, least).alias("prior"))


def _smoothed(n: Column, matched: Column, p0: Column, smoothing: float, least: int) -> Column:
    return F.when(n < least, p0).otherwise((matched + smoothing * p0) / (n + smoothing))


def pooled_priors(priors: DataFrame, rates: DataFrame, smoothing: float = fixed.PRIOR_SMOOTHING, least: int = fixed.PRIOR_MIN_COUNT) -> DataFrame:
    """(token, n, matched, prior) for a country without training rows: sums over the others, base rate the plain mean of theirs."""
    p0 = rates.agg(F.avg("p0").alias("p0"))
    sums = priors.groupBy("token").agg(F.sum("n").alias("n"), F.sum("matched").alias("matched"))
    return sums.crossJoin(F.broadcast(p0)).select("token", "n", "matched", _smoothed(F.col("n"), F.col("matched"), F.col("p0"), smoothing, least).alias("prior"))


def query_token_stats(queries: DataFrame, priors: DataFrame, rates: DataFrame, vocab: DataFrame, tokens: str = "tok") -> DataFrame:
    """(entity_id, wp_min, wp_mean, wp_low, vocab_min): least and mean prior of a query's tokens, how many are under a half, log1p of the least frequency.

    A token without a prior has the base rate, one that no reference has a frequency of 0. Without tokens: the base rate
    twice, 0, and -1.
    """
    each = queries.select("country", "entity_id", F.explode_outer(F.array_distinct(tokens)).alias("token"))
    found = each.join(priors.select("country", "token", "prior"), ["country", "token"], "left").join(vocab, ["country", "token"], "left").join(F.broadcast(rates), "country", "left")
    prior = F.coalesce("prior", "p0")
    least = F.min(F.when(F.col("token").isNotNull(), F.coalesce("freq", F.lit(0))))
    return found.groupBy("country", "entity_id").agg(
        F.min(prior).alias("wp_min"), F.avg(prior).alias("wp_mean"), F.count_if(F.col("token").isNotNull() & (prior < 0.5)).alias("wp_low"), F.coalesce(F.log1p(least.cast("double")), F.lit(-1.0)).alias("vocab_min")
    )


def spelling_counts(pairs: DataFrame, native: str, latin: str, fold: str = "fold") -> DataFrame:
    """(fold, native, latin, n): how often a native token stands where a Latin one does, over pairs of equally many tokens."""
    same = pairs.where((F.size(native) == F.size(latin)) & (F.size(native) > 0))
    zipped = same.select(F.col(fold).alias("fold"), F.explode(F.arrays_zip(F.col(native).alias("native"), F.col(latin).alias("latin"))).alias("z"))
    return zipped.groupBy("fold", F.col("z.native").alias("native"), F.col("z.latin").alias("latin")).agg(F.count(F.lit(1)).alias("n"))


def dictionaries(counts: DataFrame, folds: int = fixed.FOLDS, least: int = 2) -> DataFrame:
    """(scope, native, latin): the most frequent spelling, from all folds ('full') and from all but each one.

    Counts of the left-out fold are subtracted from the sums, so nothing is counted twice; a native token needs `least` over
    all its spellings, ties go to the first by letter.
    """
    per_fold = F.array(*[F.struct(F.lit(str(f)).alias("scope"), F.sum(F.when(F.col("fold") != f, F.col("n")).otherwise(0)).alias("n")) for f in range(folds)], F.struct(F.lit("full").alias("scope"), F.sum("n").alias("n")))
    summed = counts.groupBy("native", "latin").agg(per_fold.alias("scopes")).select("native", "latin", F.explode("scopes").alias("s")).select("s.scope", "native", "latin", "s.n")
    best = Window.partitionBy("scope", "native").orderBy(F.desc("n"), "latin")
    support = Window.partitionBy("scope", "native")
    placed = summed.where("n > 0").withColumns({"place": F.row_number().over(best), "support": F.sum("n").over(support)})
    return placed.where((F.col("place") == 1) & (F.col("support") >= least)).select("scope", "native", "latin")
