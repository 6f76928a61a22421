"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, tidy


#: Links from which on an id's links are joined where they lie, not brought together; ids with so many links, at most.
HOT, HOT_IDS = 100_000, 100_000


def _with_least(rows: DataFrame, least: DataFrame, hot: int | None) -> DataFrame:
    """rows (a, b) with the least m of their a; of ids with more than `hot` links the rows stay where they are.

    As there are so few such ids (HOT_IDS at most), they are broadcast; without any, `hot` is None.
    """
    if hot is None:
        return rows.join(least.select("a", "m"), "a")
    few = F.broadcast(least.where(F.col("n") > hot).select("a", "m"))
    many = least.where(F.col("n") <= hot).select("a", "m")
    return rows.join(few, "a").unionByName(rows.join(few.select("a"), "a", "left_anti").join(many, "a"))


def _large_star(links: DataFrame, hot: int | None) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    return _with_least(both, least, hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame, hot: int | None) -> DataFrame:
    """links run from larger to smaller, some more than once: each node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(links, least, hot).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: each id in a link, with the least id that its links reach.

    Links without an end, links to oneself and repeated links change nothing; no links give no rows. Neighbours are never
    gathered: steps are joins and minima, which Spark sums before it deals rows out; rows of an id with very many links
    aren't dealt out by it.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = cut(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        with tidy(links.sparkSession):
            ends = now.select(F.explode(F.array("a", "b")).alias("id"), F.xxhash64("a", "b").cast("decimal(38,0)").alias("h"))
            found = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if not found[0] or tuple(found)[:2] == state:
            break
        state = tuple(found)[:2]
        # More than an even share of the links, in as many parts as Spark deals them out.
        limit = max(HOT, found[0] // HOT_IDS, found[0] // int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        hot = limit if found[2] > limit else None
        before, now = now, cut(_small_star(_large_star(now, hot), hot))
        drop(before)
    # Each id now has one link, to the least of its component.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
