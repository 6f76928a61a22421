"""Tab-separated text without quoting: what stands between two tabs is the value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MalformedTable(ValueError):
    """A table that isn't what its reader was told it is."""


def read_literal(spark: SparkSession, path: str, columns: list[str], check: bool = True) -> DataFrame:
    """The rows of UTF-8 TSV files as strings: no quotes, no escapes, no nulls; only a carriage return at the end is dropped.

    The header must be `columns`; with check, a row with another number of values or an empty first one is an error when it
    is read. Line order within a file is kept a partition.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    header = "\t".join(columns)
    body = F.regexp_replace("value", "[\r]+$", "")
    rows = lines.select(body.alias("line"), F.col("_metadata.file_block_start").alias("start"))
    first = rows.limit(1).first()
    if first is None or first.line.lstrip("﻿") != header:
        raise MalformedTable(f"the header of {path} isn't {columns}")
    values = F.split("line", "\t", -1)
    rows = rows.where(F.col("line") != header).withColumn("values", values)
    if check:
        sound = (F.size("values") == len(columns)) & (F.get("values", F.lit(0)) != "")
        rows = rows.withColumn("values", F.when(sound, F.col("values")).otherwise(F.raise_error(F.concat(F.lit("malformed row: "), F.substring("line", 1, 200)))))
    return rows.select(*[F.get("values", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_results(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A result table, where a missing value is the empty text."""
    return read_literal(spark, path, columns, check=False).select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def write_literal(rows: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """Rows as unquoted TSV with a header, LF ends, in the order of a column (which isn't written).

    Each part has the header unless single asks for one file: then rows pass through one task, which only small outputs should.
    """
    columns = [c for c in rows.columns if c != order]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    if order:
        rows = rows.orderBy(order)
    text = rows.select(line.alias("\t".join(columns)))
    (text.coalesce(1) if single else text).write.mode("overwrite").option("header", True).option("quote", "").option("escape", "").option("escapeQuotes", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("sep", "\x01").csv(path)
