"""Grouped outputs and the checks that they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(refs: DataFrame, accepted: DataFrame) -> DataFrame:
    """(ref_id, matches): a row for every reference, its records' ids sorted and comma-joined, empty for none."""
    joined = accepted.groupBy("ref_id").agg(F.array_join(F.array_sort(F.collect_list("query_id")), ",").alias("matches"))
    return refs.select("ref_id").join(joined, "ref_id", "left").withColumn("matches", F.coalesce("matches", F.lit("")))


def candidates(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ref_id, candidates): as matches(), over all candidate pairs, each id once."""
    joined = pairs.groupBy("ref_id").agg(F.array_join(F.array_sort(F.collect_set("query_id")), ",").alias("candidates"))
    return refs.select("ref_id").join(joined, "ref_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit("")))


def edges(lists: DataFrame, key: str, value: str) -> DataFrame:
    """(key, query_id): a comma-joined list as rows; empty lists have none."""
    return lists.where(F.coalesce(value, F.lit("")) != "").select(key, F.explode(F.split(value, ",")).alias("query_id"))


def claimed_twice(accepted: DataFrame) -> DataFrame:
    """Records that more than one reference claims: there may be none."""
    return accepted.groupBy("query_id").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


def outside_candidates(accepted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Accepted pairs that were no candidates: there may be none."""
    return accepted.join(pairs, ["query_id", "ref_id"], "left_anti")


def output_stats(lists: DataFrame, value: str = "matches") -> DataFrame:
    """By country: references, matched records, the share of references without any, and the mean number of records."""
    n = F.when(F.col(value) == "", 0).otherwise(F.size(F.split(value, ",")))
    return lists.groupBy("country").agg(F.count(F.lit(1)).alias("refs"), F.sum(n).alias("matched"), F.avg(F.when(F.col(value) == "", 1.0).otherwise(0.0)).alias("empty_share"), F.avg(n).alias("mean_matches"))


def constraints(refs: DataFrame, lists: DataFrame, accepted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(constraint, violations): row count, one owner a record, matches among candidates, and keys that are missing."""
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("constraint"), "violations")
    rows = [
        count("row_for_each_reference", refs.select("ref_id").join(lists, "ref_id", "left_anti").unionByName(lists.groupBy("ref_id").count().where("count > 1").select("ref_id"))),
        count("one_owner", claimed_twice(accepted)),
        count("matches_are_candidates", outside_candidates(accepted, pairs)),
        count("known_keys", accepted.where("query_id is null or ref_id is null")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def changed_rows(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value isn't what it was in an earlier output."""
    return new.join(old.select(key, F.col(value).alias("was")), key).where(~F.col(value).eqNullSafe(F.col("was")))


def id_checksum(rows: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n, checksum): an order-free 64-bit sum of hashes of the ids, so that no group's ids need to meet."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long")).alias("checksum"))
