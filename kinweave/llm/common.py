"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, drop, tidy  # noqa: F401


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of df, under names of our own, so other columns can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 512, holds: bool = False) -> DataFrame:
    """mapInArrow where batches of `rows` rows at most are each handled alone, so memory is bounded by that many texts.

    holds: per_batch uses kept().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            forget()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                if (out := per_batch(batch.slice(start, rows))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def batch_of(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def crc_bucket(column: str, modulus: int):
    """crc32 of the id written as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


class Memo(dict):
    """A dict that computes missing entries and holds about `most`: those in use stay, the others are forgotten."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable):
    """What make() gives, once for each key in a Python worker, across its tasks. A worker holds one such thing at a time."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Lets go of what an earlier operator's tasks left in this worker, and of its memory."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Gives memory that is free in this worker back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to `most` at most, or hold a single one."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def prefix_sums(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def packed_by_part(part: np.ndarray, parts: int, *columns: np.ndarray) -> list[bytes]:
    """Rows of unsigned 64-bit columns, packed for each part in turn."""
    # Numbers of two bytes are sorted by counting.
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    rows = np.stack([c[order] for c in columns], axis=1)
    edges = np.zeros(parts + 1, np.int64)
    np.cumsum(np.bincount(part, minlength=parts), out=edges[1:])
    return [rows[a:b].tobytes() for a, b in zip(edges, edges[1:])]
