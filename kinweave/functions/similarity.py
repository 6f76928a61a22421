"""Similarities, hashes and numeric scalars as column expressions.

Indel similarity has no built-in counterpart. It comes in two forms with the same results: column expressions alone, and an
Arrow function with bit-parallel rows that suits long texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import fixed
from .text import words


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time (Hyyro 2004)."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & masks.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


@F.pandas_udf(DoubleType())
def _indel_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    # Frequent pairs of texts, such as equal names, are computed once a batch.
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna("")):
        if pair not in seen:
            seen[pair] = 1.0 if pair[0] == pair[1] else _indel(*pair)
        out.append(seen[pair])
    return pd.Series(out)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (length + length), 1 if both are empty; null is the empty text."""
    return _indel_arrow(a, b)


def indel_ratio_native(a: Column, b: Column) -> Column:
    """indel_ratio without leaving the JVM: the table's rows folded over letters. For short texts."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def next_row(row: Column, c: Column) -> Column:
        cells = F.zip_with(F.sequence(F.lit(1), F.length(b)), letters(b), lambda j, d: F.struct(j.alias("j"), (c == d).alias("same")))
        return F.when(F.length(b) == 0, row).otherwise(
            F.aggregate(cells, F.array(F.lit(0)), lambda new, x: F.concat(new, F.array(F.greatest(F.get(new, x.j - 1), F.get(row, x.j), F.when(x.same, F.get(row, x.j - 1) + 1).otherwise(0)))))
        )

    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.array_max(F.aggregate(letters(a), start, next_row)) / total)


def token_sort_ratio(a: Column, b: Column) -> Column:
    order = lambda x: F.array_join(F.array_sort(words(F.coalesce(x, F.lit("")))), " ")
    return indel_ratio(order(a), order(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best of comparing what both have with either side, and what is left of both; 0 if a side has no token.

    1 if they share tokens and one side has no other.
    """
    x, y = (F.array_distinct(words(F.coalesce(t, F.lit("")))) for t in (a, b))
    both, only_x, only_y = F.array_sort(F.array_intersect(x, y)), F.array_sort(F.array_except(x, y)), F.array_sort(F.array_except(y, x))
    joined = lambda t: F.array_join(t, " ")
    n, p, q = F.length(joined(both)), F.length(joined(only_x)), F.length(joined(only_y))
    gap = F.when(n > 0, 1).otherwise(0)
    whole_x, whole_y = n + gap + p, n + gap + q
    # Both sides begin with the tokens they share, which match in full; the rest is compared letter by letter.
    rest = 1.0 - (p + q - indel_ratio(joined(only_x), joined(only_y)) * (p + q)) / (whole_x + whole_y)
    with_x, with_y = 2.0 * n / F.greatest(F.lit(1), n + whole_x), 2.0 * n / F.greatest(F.lit(1), n + whole_y)
    best = F.when(n > 0, F.greatest(rest, with_x, with_y)).otherwise(rest)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when((n > 0) & ((p == 0) | (q == 0)), 1.0).otherwise(best)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Jaccard similarity and the shares of either set, 0 where a set is empty."""
    both = F.size(F.array_intersect(a, b))
    share = lambda n: both / F.greatest(F.lit(1), n)
    return share(F.size(F.array_union(a, b))), share(F.size(F.array_distinct(a))), share(F.size(F.array_distinct(b)))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a), F.length(b))


def log_difference(a: Column, b: Column) -> Column:
    """log1p of the distance of two numbers written as text, -1 if either is missing or too large."""
    gap = F.abs(F.try_subtract(a.try_cast("bigint"), b.try_cast("bigint")))
    return F.coalesce(F.log1p(gap.cast("double")), F.lit(-1.0))


def fold(key: Column, folds: int = fixed.FOLDS) -> Column:
    """md5 of the key as one number modulo the number of folds."""
    digits = F.md5(key.cast("binary"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0).cast("long"), lambda rest, i: (rest * 16 + F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("long")) % folds).cast("int")


def sampled(seed: int, key: Column, modulus: int) -> Column:
    """Whether a key is in a sample of one in `modulus`, by md5 of seed and key."""
    return fold(F.concat(F.lit(f"{seed}:"), key), modulus) == 0


def extra_negative(query: Column, ref: Column, keep: int = fixed.EXTRA_NEGATIVES) -> Column:
    """Whether a pair of ordinals is among `keep` in a thousand, by a multiplicative hash."""
    return (query.cast("long") * F.lit(2654435761) + ref.cast("long") * F.lit(40503)) % 1000 < keep


def idf(refs: Column, df: Column) -> Column:
    return F.log((refs + 1.0) / (df + 1.0)) + 1.0


def logit(p: Column, clip: float = fixed.CLIP) -> Column:
    inside = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(inside / (1 - inside))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def state_allows(allowed: Column, mask: Column) -> Column:
    """Whether a reference may match: no state is asked for, its own is open (none or several), or it is one asked for."""
    return (allowed == 0) | (F.bit_count(mask) != 1) | (allowed.bitwiseAND(mask) != 0)
