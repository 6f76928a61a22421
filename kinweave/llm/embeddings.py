"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Each unit vector is its int8 form times a scale, plus a rest whose length is known. Products of int8 tiles then tell the
cosine up to a bound that those lengths give; only pairs that may reach the threshold are computed in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow
from .components import components
from .shingles import _forest

COSINE, TILE = 0.98, 2048
#: More than rounding can add to a bound in double precision.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what each leaves out: unit = int8 * scale + rest."""
    scale = np.abs(unit).max(axis=1) / 127
    rounded = np.rint(unit / scale[:, None])
    rest = np.linalg.norm(unit - rounded * scale[:, None], axis=1)
    return rounded.astype(np.int8), scale, rest


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows. Floats hold them exactly (up to 2**24 in single precision), and multiply fast."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def links(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of x and y whose cosine is `cosine` or more; with same, y is x and pairs are those of row < column."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    found = []
    for low in range(0, len(x), 512):
        part = slice(low, low + 512)
        about = products(qx[part], qy) * (sx[part][:, None] * sy[None, :])
        # |xy - about| <= |qx sx| |ey| + |qy sy| |ex| + |ex| |ey|, and |q s| <= 1 + |e|.
        bound = (1 + ex[part])[:, None] * ey[None, :] + (1 + ey)[None, :] * ex[part][:, None] + ex[part][:, None] * ey[None, :] + SLACK
        i, j = np.nonzero(about + bound >= cosine)
        i += low
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            exact = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
            found.append((a[exact >= cosine], b[exact >= cosine]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("s", "ascending")])
        block, side, s, n, i, j = (table.column(c).to_numpy() for c in ("block", "side", "s", "n", "i", "j"))
        vectors = table.column("v").combine_chunks()
        offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
        weight, parent = np.zeros(len(s), np.int64), s.copy()
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        for low, high in zip(edges, edges[1:]):
            own = np.arange(low, high)
            rows, columns = (own, own) if i[low] == j[low] else (own[side[own] == 0], own[side[own] == 1])
            if not len(rows) or not len(columns):
                continue
            held = values[offsets[low] : offsets[high]].reshape(high - low, -1).astype(np.float64)
            a, b = links(held[rows - low], held[columns - low], cosine, i[low] == j[low])
            x, y = rows[a], columns[b]
            np.add.at(weight, x, n[y])
            np.add.at(weight, y, n[x])
            parent[own] = s[low + _forest(len(own), x - low, y - low)]
        linked = weight > 0
        return pa.table({"a": s[linked], "b": parent[linked], "weight": weight[linked]})

    return run


def near_duplicates(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null, their vectors as long, and the cosine in double precision is
    `cosine` or more. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
    n_links counts the other rows linked directly, equal vectors included; component_id is the least id that links reach,
    its own included. Rows with equal vectors and labels are one in the products, so copies cost nothing. Nothing is left out:
    all of a label's tiles meet.
    """
    rows = narrow(df, id=vec_id, v=vector, label=label)
    kind = "array<float>" if rows.schema["v"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.withColumn("v", F.col("v").cast(kind))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    able = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(F.exists("v", bad), F.lit(False)) & F.exists("v", lambda x: x != 0)
    named = rows.withColumn("able", F.coalesce(able, F.lit(False))).withColumn("s", F.when(F.col("able"), F.xxhash64("label", "v")))
    classes = cut(named.where("able").groupBy("label", "v", "s").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("block", F.xxhash64("label", F.size("v"))))
    sizes = classes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.join(sizes, "block").withColumn("own", F.pmod("s", "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "block", "s", "n", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.when(F.col("tiles") == 1, F.pmod("block", F.lit(parts))).otherwise(F.col("block")).alias("part"), (F.col("tiles") > 1).alias("large"),
    )
    found = cut(dealt.groupBy("large", "part", "i", "j").applyInArrow(_compare(cosine), "a long, b long, weight long"))
    joined = components(found).withColumnRenamed("id", "s")
    weights = found.groupBy(F.col("a").alias("s")).agg(F.sum("weight").alias("weight"))
    judged = classes.join(weights, "s", "left").join(joined, "s", "left").select("s", "n", "least", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("component", "s").alias("component"))
    firsts = judged.groupBy("component").agg(F.min("least").alias("component_id"))
    verdict = judged.join(firsts, "component").where("n > 1 or weight > 0").select("s", "component_id", (F.col("weight") + F.col("n") - 1).alias("n_links"))
    out = named.where("able").select("id", "s").join(verdict, "s", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    # Vectors that can't link would all have one key.
    out = out.unionByName(named.where(~F.col("able")).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
