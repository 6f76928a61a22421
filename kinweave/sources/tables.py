"""Parquet tables: projected scans, compressed writes in shards, small JSON documents and postings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A scan of one or more Parquet files (globs too) that reads only these columns and passes the filter to the reader."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows if columns is None else rows.select(*columns)


def count_rows(spark: SparkSession, path: str, where: Column | None = None) -> int:
    return scan(spark, path, where=where).count()


def key_range(spark: SparkSession, path: str, key: str, low, high) -> DataFrame:
    """Rows whose key is in [low, high): row groups outside are skipped if the table was written by write_sorted()."""
    return spark.read.parquet(path).where((F.col(key) >= low) & (F.col(key) < high))


def write(rows: DataFrame, path: str, partition_by: list[str] | None = None, shard_rows: int = 250_000) -> None:
    """Replaces a table; readers see either all of a job's files or none of them. Shards hold shard_rows rows at most."""
    writer = rows.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", shard_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sorted(rows: DataFrame, path: str, key: str, partitions: int, row_group_bytes: int = 8 << 20) -> None:
    """Replaces a table that is dealt and sorted by key, in row groups small enough for their ranges to prune."""
    rows.repartitionByRange(partitions, key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(path)


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int = 32) -> None:
    """A table bucketed by key, which joins on that key without a shuffle."""
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small JSON document, in any store that Spark writes."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_report(rows: DataFrame, path: str) -> None:
    """A small diagnostic table as CSV with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
