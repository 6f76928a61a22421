"""Pair features in Arrow batches: what features.py says in columns, for many pairs at a time.

A text that repeats in a batch is cut into words once, two texts that meet again are compared once, and the subsequences of all
pairs of a batch grow side by side, a letter and 64 bits a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import fixed
from ..session import cut
from . import features

#: Pairs that are described at a time; pairs whose rows of bits grow together; cells of a table of letters.
PAIRS, SIDE_BY_SIDE, CELLS = 10_000, 4_096, 4_000_000
#: Columns of a record that pairs carry, lists as texts.
BASE_TEXTS, LISTS = ("name_core", "name_full", "address_clean", "numbers"), ("numbers", "units", "alnum", "numset")
PERTURB_TEXTS, PERTURB_QUERY = ("house", "units", "alnum", "numset", "tok_freqs"), ("vocab_min", "wp_min", "wp_mean", "wp_low", "tw_full", "tw_num", "tw_name", "tw_addr", "addr_empty")


def side(records: DataFrame, letter: str, perturb: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """What pairs carry of a record, as {letter}_*, and keep: clean texts, lists as texts, and numbers. tok is the distinct words of name_core."""
    texts = BASE_TEXTS + (PERTURB_TEXTS if perturb else ())
    numbers = (("name_script", "unknown_native_tokens", "source") + (PERTURB_QUERY if perturb else ())) if letter == "q" else (("r_name_mult", "r_claims") if perturb else ())
    out = {x: F.array_join(F.transform(x, lambda e: F.concat(e, F.lit(features.END))), "") for x in texts if x in LISTS}
    # In the order of tok, so that the tokens themselves needn't travel.
    out |= {"tok_freqs": F.coalesce(F.array_join(F.transform("tok", lambda t: F.coalesce(F.try_element_at("tok_freq", t), F.lit(0)).cast("string")), " "), F.lit(""))} if perturb else {}
    return records.select("country", F.col("entity_id").alias("query_id" if letter == "q" else "ref_id"), *[out.get(x, F.col(x)).alias(f"{letter}_{x}") for x in texts], *[F.col(x).cast("double").alias(f"{letter}_{x}") for x in numbers], *keep)


def described(pairs: DataFrame, queries: DataFrame, refs: DataFrame, perturb: bool = False, keep: tuple[str, ...] = (), vectors: bool = False) -> DataFrame:
    """country, query_id, ref_id, the 61 features, with perturb the 31, and keep, of pairs with their scores, ranks and context.

    keep names columns of queries. With perturb, records have what query_side() and reference_side() of the chain give them. With vectors,
    pairs are described once however often they are read: each batch is kept compressed, by column, and read as one vector `features` a pair.
    """
    names = features.BASE + (features.PERTURB if perturb else [])
    q = side(queries, "q", perturb, keep)
    rows = pairs.join(q, ["country", "query_id"]).join(side(refs, "r", perturb), ["country", "ref_id"])
    kinds = {f.name: f for f in rows.schema.fields}
    schema = StructType([*[kinds[k] for k in features.KEYS], *[StructField(n, DoubleType()) for n in names], *[kinds[k] for k in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(start, PAIRS)
                found = describe(batch, perturb)
                columns = [batch.column(c) for c in features.KEYS], [pa.array(np.asarray(found[n], np.float64)) for n in names], [batch.column(c) for c in keep]
                out = pa.RecordBatch.from_arrays([c for some in columns for c in some], names=[*features.KEYS, *names, *keep])
                yield _packed(out) if vectors else out

    if not vectors:
        return rows.mapInArrow(run, schema)
    others = [*features.KEYS, *keep]
    read = cut(rows.mapInArrow(run, "packed binary")).mapInArrow(_vectors(names, others), StructType([*[kinds[k] for k in others], StructField("features", VectorUDT())]))
    # Else a row is made only to see how long its vector is.
    return read.select(*others, F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": len(names)}}))


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["packed"])


def _vectors(names: list[str], others: list[str]):
    """What _packed() made, with the named columns as one dense vector a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in batches:
            for x in packed.column(0):
                for batch in pa.ipc.open_stream(x.as_buffer()):
                    n = batch.num_rows
                    values = pa.array(np.column_stack([batch.column(c).to_numpy() for c in names]).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(names)), values)
                    dense = pa.StructArray.from_arrays([pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), lists], ["type", "size", "indices", "values"])
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], dense], names=[*others, "features"])

    return run


class _Ragged:
    """Rows of numbers of any length, one after the other."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes.astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of some rows' values, and which of the rows each is of."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - sizes), sizes), np.repeat(np.arange(len(rows)), sizes)


def _letters(texts: pa.Array) -> _Ragged:
    return _Ragged(np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), pc.utf8_length(texts).to_numpy(zero_copy_only=False))


def _combined(*arrays: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct texts of some arrays, and each array as places in them."""
    whole = pa.concat_arrays([pc.fill_null(x.cast(pa.string()), "") for x in arrays]).dictionary_encode()
    return whole.dictionary, np.split(whole.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x in arrays])[:-1])


def _bits(patterns: _Ragged, rows: np.ndarray, words: int, letters: int) -> list[np.ndarray]:
    """Where each pattern has each letter, as `words` numbers of 64 bits for each (pattern, letter)."""
    at, row = patterns.of(rows)
    place = at - patterns.starts[rows][row]
    cell = row * letters + patterns.values[at]
    out = []
    for w in range(words):
        table = np.zeros(len(rows) * letters, np.uint64)
        some = place >> 6 == w
        np.add.at(table, cell[some], np.uint64(1) << (place[some] & 63).astype(np.uint64))
        out.append(table)
    return out


def _coded(*texts: _Ragged) -> int:
    """Letters of rows as small numbers, the same on all sides; how many there are."""
    seen = np.zeros(0x110000, bool)
    for x in texts:
        seen[x.values] = True
    code = np.cumsum(seen) - 1
    for x in texts:
        x.values = code[x.values]
    return int(code[-1]) + 1


def _meetings(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, letters: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """Pairs of rows with letters on both sides in portions: their places, patterns, pattern of each, words a pattern; longest texts first."""
    words = (size_b[b] + 63) >> 6
    some = np.flatnonzero((size_a[a] > 0) & (words > 0))
    for w in np.unique(words[some]).tolist():
        own = some[words[some] == w]
        step = max(1, min(SIDE_BY_SIDE, CELLS // (letters * w)))
        for low in range(0, len(own), step):
            part = own[low : low + step]
            part = part[np.argsort(-size_a[a[part]], kind="stable")]
            rows, pattern = np.unique(b[part], return_inverse=True)
            # How many texts have a letter at each place.
            lengths = size_a[a[part]]
            yield part, rows, pattern, w, len(part) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")


def lcs(texts: _Ragged, a: np.ndarray, patterns: _Ragged, b: np.ndarray, letters: int) -> np.ndarray:
    """The longest common subsequence of rows a of texts and rows b of patterns (similarity.lcs_length), all side by side."""
    out = np.zeros(len(a), np.int64)
    for part, rows, pattern, words, active in _meetings(a, b, texts.sizes, patterns.sizes, letters):
        tables = _bits(patterns, rows, words, letters)
        first, base = texts.starts[a[part]], pattern * letters
        state = [np.full(len(part), ~np.uint64(0)) for _ in range(words)]
        for j, n in enumerate(active.tolist()):
            cell = base[:n] + texts.values[first[:n] + j]
            carry = None
            for table, own in zip(tables, state):
                row = own[:n]
                both = row & table[cell]
                total = row + both
                rest = row ^ both
                if words > 1:
                    over = total < both
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                np.bitwise_or(total, rest, out=row)
        out[part] = 64 * words - sum(np.bitwise_count(x).astype(np.int64) for x in state)
    return out


def levenshtein(texts: _Ragged, a: np.ndarray, b: np.ndarray, letters: int) -> np.ndarray:
    """Edits between rows a and b, of 64 letters at most (Myers' rows of bits)."""
    out = np.maximum(texts.sizes[a], texts.sizes[b])
    one = np.uint64(1)
    for part, rows, pattern, _, active in _meetings(a, b, texts.sizes, texts.sizes, letters):
        table = _bits(texts, rows, 1, letters)[0]
        size = texts.sizes[rows][pattern]
        last, score = (size - 1).astype(np.uint64), size.copy()
        first, base = texts.starts[a[part]], pattern * letters
        plus, minus = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64)
        for j, n in enumerate(active.tolist()):
            equal = table[base[:n] + texts.values[first[:n] + j]]
            p, m = plus[:n], minus[:n]
            vertical, across = equal | m, (((equal & p) + p) ^ p) | equal
            up, down = m | ~(across | p), p & across
            score[:n] += (up >> last[:n] & one).astype(np.int64) - (down >> last[:n] & one).astype(np.int64)
            up, down = up << one | one, down << one
            plus[:n], minus[:n] = down | ~(vertical | up), up & vertical
        out[part] = score
    return out


def _ratio(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * common / np.maximum(1, total), 1.0)


def _elements(texts: pa.Array, end: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What stands between ends: its text, row, and whether it is the last of its row."""
    lists = pc.split_pattern(texts, end)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    last = np.zeros(int(sizes.sum()), bool)
    last[np.cumsum(sizes) - 1] = True
    return pc.list_flatten(lists), np.repeat(np.arange(len(texts)), sizes), last


def _numbered(elements: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct elements in order of their bytes, and the place of each element among them."""
    coded = elements.dictionary_encode()
    order = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)


def _sets(row: np.ndarray, number: np.ndarray, rows: int) -> tuple[_Ragged, np.ndarray]:
    """Each row's distinct numbers in order, and the place where each came first."""
    order = np.lexsort((number, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (row[order][1:] != row[order][:-1]) | (number[order][1:] != number[order][:-1])
    # lexsort is stable, so the first of equals is the one that came first.
    order = order[fresh]
    return _Ragged(number[order], np.bincount(row[order], minlength=rows)), order


def _met(sets: _Ragged, a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows a and b: places of their numbers, the pair of each, and whether the other side has it."""
    (at_a, pair_a), (at_b, pair_b) = sets.of(a), sets.of(b)
    left, right = pair_a << 32 | sets.values[at_a], pair_b << 32 | sets.values[at_b]
    found = np.searchsorted(right, left)
    shared = np.zeros(len(left), bool)
    inside = found < len(right)
    shared[inside] = right[found[inside]] == left[inside]
    also = np.zeros(len(right), bool)
    also[found[shared]] = True
    return (at_a, pair_a, shared), (at_b, pair_b, also)


def _overlap(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return both / np.maximum(1, n + m - both), both / np.maximum(1, n), both / np.maximum(1, m)


class _Words:
    """Distinct words of a batch, with their letters."""

    def __init__(self, words: pa.Array):
        self.sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        # Each word's letters and a space.
        self.letters = _letters(pc.binary_join_element_wise(words, "", " "))

    def joined(self, row: np.ndarray, number: np.ndarray, rows: int) -> _Ragged:
        """The words of each row with a space between two."""
        last = np.ones(len(row), bool)
        last[:-1] = row[1:] != row[:-1]
        sizes = self.sizes[number] + ~last
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.letters.starts[number] - (ends - sizes), sizes)
        return _Ragged(self.letters.values[at], np.bincount(row, sizes, rows).astype(np.int64))


def _text_features(kind: str, q: pa.Array, r: pa.Array, freqs: tuple[pa.Array, pa.Array] | None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Features of two clean texts; and, with frequencies of their distinct words, what else their words tell."""
    if freqs is None:
        texts, (qi, ri) = _combined(q, r)
    else:
        # A word's frequency is that of its country, so equal texts may differ in it.
        keys, (qi, ri) = _combined(*[pc.binary_join_element_wise(x, y, features.END) for x, y in zip((q, r), freqs)])
        halves = pc.split_pattern(keys, features.END)
        texts, counts = pc.list_element(halves, 0), pc.list_element(halves, 1)
    n = len(texts)
    pairs, back = np.unique(qi * n + ri, return_inverse=True)
    a, b = pairs // n, pairs % n
    elements, row, _ = _elements(texts, " ")
    full = pc.utf8_length(elements).to_numpy(zero_copy_only=False) > 0
    elements, row = elements.filter(pa.array(full)), row[full]
    names, number = _numbered(elements)
    words = _Words(names)
    plain = _letters(texts)
    at = np.flatnonzero(plain.values != 32)
    close = _Ragged(plain.values[at], np.bincount(np.repeat(np.arange(n), plain.sizes)[at], minlength=n))
    order = np.lexsort((number, row))
    sets, came = _sets(row, number, n)
    left, right = _met(sets, a, b)
    m = len(pairs)
    (at_a, pair_a, shared), (at_b, pair_b, also) = left, right
    only_a, only_b = (words.joined(pair[~met], sets.values[at[~met]], m) for at, pair, met in (left, right))
    both = words.joined(pair_a[shared], sets.values[at_a[shared]], m).sizes
    in_order = words.joined(row[order], number[order], n)
    letters = _coded(plain, close, in_order, only_a, only_b)
    out = {}
    for name, x in (("ratio", plain), ("sort_ratio", in_order), ("compact_ratio", close)):
        out[f"{kind}_{name}"] = _ratio(lcs(x, a, x, b, letters), x.sizes[a] + x.sizes[b])
    each = np.arange(m)
    p, s = only_a.sizes, only_b.sizes
    ratio = _ratio(lcs(only_a, each, only_b, each, letters), p + s)
    gap = both > 0
    whole_a, whole_b = both + gap + p, both + gap + s
    sizes = sets.sizes[a], sets.sizes[b]
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = 1.0 - (p + s - ratio * (p + s)) / (whole_a + whole_b)
    best = np.where(gap, np.maximum(np.maximum(rest, 2.0 * both / np.maximum(1, both + whole_a)), 2.0 * both / np.maximum(1, both + whole_b)), rest)
    out[f"{kind}_set_ratio"] = np.where((sizes[0] == 0) | (sizes[1] == 0), 0.0, np.where(gap & ((p == 0) | (s == 0)), 1.0, best))
    out[f"{kind}_exact"] = (a == b if freqs is None else pc.equal(texts.take(pa.array(a)), texts.take(pa.array(b))).to_numpy(zero_copy_only=False)) & (plain.sizes[a] > 0)
    common = np.bincount(pair_a[shared], minlength=m)
    out |= dict(zip((f"{kind}_jaccard", f"{kind}_query_coverage", f"{kind}_ref_coverage"), _overlap(common, *sizes)))
    out[f"{kind}_length_ratio"] = np.minimum(plain.sizes[a], plain.sizes[b]) / np.maximum(1, np.maximum(plain.sizes[a], plain.sizes[b]))
    out |= {f"{kind}_query_tokens": sizes[0], f"{kind}_ref_tokens": sizes[1]}
    more = {}
    if kind == "name":
        closed = pc.replace_substring(texts, " ", "").to_pylist()
        heads = pc.utf8_slice_codeunits(elements, 0, 1).to_pylist()
        ends = np.searchsorted(row, np.arange(n + 1))
        heads = ["".join(heads[low:high]) for low, high in zip(ends.tolist(), ends[1:].tolist())]
        met = list(zip(a.tolist(), b.tolist()))
        out["name_initials_equal"] = np.array([heads[i] == heads[j] != "" for i, j in met], bool)
    if freqs is not None:
        qo, ro = sizes[0] - common, sizes[1] - common
        more = {"nr_shared": common, "nr_q_only": qo, "nr_r_only": ro}
        more["nr_rel"] = np.select([(sizes[0] == 0) | (sizes[1] == 0), (qo == 0) & (ro == 0), qo == 0, ro == 0, common == 0, (qo == 1) & (ro == 1)], [6, 0, 1, 2, 4, 3], 5)
        more["nr_swap_ratio"] = np.where((qo == 0) | (ro == 0), 0.0, ratio)
        filler = pc.is_in(names, pa.array(sorted(set(fixed.FILLER_WORDS)))).to_numpy(zero_copy_only=False)
        more["nr_q_only_filler"] = np.bincount(pair_a[~shared], filler[sets.values[at_a[~shared]]], m)
        # Frequencies come in the order in which words came first.
        listed, of, _ = _elements(counts, " ")
        held = pc.utf8_length(listed).to_numpy(zero_copy_only=False) > 0
        if not np.array_equal(np.bincount(of[held], minlength=n), sets.sizes):
            raise ValueError("tok isn't the distinct words of name_core")
        known = np.empty(len(came), np.int64)
        known[np.argsort(came)] = listed.filter(pa.array(held)).cast(pa.int64()).to_numpy()
        for name, at, pair, met_ in (("nr_q_only_vocab_min", at_a, pair_a, shared), ("nr_r_only_vocab_min", at_b, pair_b, also)):
            least = np.full(m, np.inf)
            np.minimum.at(least, pair[~met_], known[at[~met_]].astype(np.float64))
            more[name] = np.where(np.isinf(least), -1.0, np.log1p(least))
        acronym = lambda i, j, size: len(closed[i]) >= 2 and closed[i] == heads[j] and size >= 2
        more["nr_acronym"] = np.array([acronym(i, j, y) or acronym(j, i, x) for (i, j), x, y in zip(met, sizes[0].tolist(), sizes[1].tolist())], bool)
        begins = lambda x, y: len(x) >= 4 and y.startswith(x)
        more["nr_compact_prefix"] = np.array([x != y and (begins(x, y) or begins(y, x)) for x, y in ((closed[i], closed[j]) for i, j in met)], bool)
    return {k: v[back] for k, v in out.items()}, {k: v[back] for k, v in more.items()}


def _list_features(q: pa.Array, r: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct elements two lists have, and share."""
    texts, (a, b) = _combined(q, r)
    elements, row, last = _elements(texts, features.END)
    _, number = _numbered(elements)
    sets, _ = _sets(row[~last], number[~last], len(texts))
    (_, pair, shared), _ = _met(sets, a, b)
    return sets.sizes[a], sets.sizes[b], np.bincount(pair[shared], minlength=len(a))


def _number_features(q: pa.Array, r: pa.Array) -> dict[str, np.ndarray]:
    texts, (a, b) = _combined(q, r)
    n = len(a)
    elements, row, last = _elements(texts, features.END)
    elements, row = elements.filter(pa.array(~last)), row[~last]
    names, number = _numbered(elements)
    sets, _ = _sets(row, number, len(texts))
    (_, pair, shared), _ = _met(sets, a, b)
    sizes, both = (sets.sizes[a], sets.sizes[b]), np.bincount(pair[shared], minlength=n)
    out = {"number_query_count": sizes[0], "number_ref_count": sizes[1], "number_intersection": both}
    out |= dict(zip(("number_jaccard", "number_query_coverage", "number_ref_coverage"), _overlap(both, *sizes)))
    out["number_sets_equal"] = (sizes[0] > 0) & (both == sizes[0]) & (both == sizes[1])
    # Every number of one side with every one of the other; the first of either side with the first.
    at, of = sets.of(a)
    times = sizes[1][of]
    ends = np.cumsum(times)
    x, p = np.repeat(sets.values[at], times), np.repeat(of, times)
    y = sets.values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(sets.starts[b][of] - (ends - times), times)]
    head = np.full(len(texts), -1)
    head[row[::-1]] = number[::-1]
    i, j = head[a], head[b]
    two = (i >= 0) & (j >= 0)
    total = max(1, len(names))
    keys, back = np.unique(np.concatenate((x * total + y, i[two] * total + j[two])), return_inverse=True)
    letters = _letters(names)
    size = letters.sizes
    u, v = keys // total, keys % total
    similar = 1.0 - levenshtein(letters, u, v, _coded(letters)) / np.maximum(size[u], size[v]) if len(keys) else np.zeros(0)
    best, first = np.zeros(n), np.zeros(n)
    np.maximum.at(best, p, similar[back[: len(x)]])
    first[two] = similar[back[len(x) :]]
    out |= {"number_first_equal": two & (i == j), "number_first_edit": first, "number_best_edit": best}
    # Numbers have up to 19 digits, more than a long holds.
    value = names.cast(pa.uint64()).to_numpy()
    gap = np.full(n, -1.0)
    c, d = value[i[two]], value[j[two]]
    gap[two] = np.log1p((np.maximum(c, d) - np.minimum(c, d)).astype(np.float64))
    said = names.to_pylist()
    flags = np.zeros((3, n), bool)
    met = [(said[k], said[l]) for k, l in zip(i[two].tolist(), j[two].tolist())]
    flags[:, two] = np.array([(len(k) == len(l), k.startswith(l) or l.startswith(k), k.endswith(l) or l.endswith(k)) for k, l in met], bool).reshape(-1, 3).T
    return out | {"number_first_log_difference": gap} | dict(zip(("number_first_same_length", "number_first_prefix", "number_first_suffix"), flags))


def _house_features(q: pa.Array, r: pa.Array) -> dict[str, np.ndarray]:
    out = np.empty((3, len(q)))
    for n, (x, y) in enumerate(zip(q.to_pylist(), r.to_pylist())):
        if x is None or y is None:
            out[:, n] = -1.0, 0.0, -1.0
        else:
            # Texts alike in length are one edit apart where one letter differs.
            near = len(x) == len(y) and x != y and sum(c != d for c, d in zip(x, y)) == 1
            c, d = int(x), int(y)
            out[:, n] = x == y, near, abs(c - d) if max(c, d) < 1 << 63 else -1.0
    out[2] = np.where(out[2] < 0, -1.0, np.log1p(np.maximum(out[2], 0.0)))
    return dict(zip(("hn_equal", "hn_sub1", "hn_absdiff_log"), out))


def describe(batch: pa.RecordBatch, perturb: bool) -> dict[str, np.ndarray]:
    """The features of a batch of pairs with both sides' columns, by name."""
    text = lambda x: pc.fill_null(batch.column(x).cast(pa.string()), "")
    number = lambda x: batch.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = {}
    for m in features.MODES:
        score, best, second = (number(f"{m}_{x}") for x in ("score", "best", "second"))
        out |= {f"{m}_cosine": score, f"{m}_rank": number(f"{m}_rank"), f"{m}_best": best, f"{m}_second": second, f"{m}_to_best": score - best, f"{m}_top_margin": best - second}
    found, more = _text_features("name", text("q_name_core"), text("r_name_core"), (text("q_tok_freqs"), text("r_tok_freqs")) if perturb else None)
    q, r = text("q_address_clean"), text("r_address_clean")
    out |= found | _text_features("address", q, r, None)[0] | _number_features(text("q_numbers"), text("r_numbers"))
    texts, (a, b) = _combined(text("q_name_full"), text("r_name_full"))
    pairs, back = np.unique(a * len(texts) + b, return_inverse=True)
    a, b = pairs // len(texts), pairs % len(texts)
    full = _letters(texts)
    out["name_full_ratio"] = _ratio(lcs(full, a, full, b, _coded(full)), full.sizes[a] + full.sizes[b])[back]
    empty = lambda x: pc.equal(x, "").to_numpy(zero_copy_only=False)
    out |= {"address_query_missing": empty(q), "address_ref_missing": empty(r), "query_has_native_name": number("q_name_script") != 0}
    out |= {"query_unknown_native_tokens": number("q_unknown_native_tokens"), "query_source": number("q_source")}
    if perturb:
        out |= more | _house_features(batch.column("q_house"), batch.column("r_house"))
        for kind, met, apart in (("units", "unit_equal", "unit_conflict"), ("alnum", "alnum_shared", "alnum_conflict")):
            n, m, both = _list_features(text(f"q_{kind}"), text(f"r_{kind}"))
            out |= {met: both if kind == "alnum" else both > 0, apart: (n > 0) & (m > 0) & (both == 0)}
        n, m, both = _list_features(text("q_numset"), text("r_numset"))
        out |= {"num_q_extra": n - both, "num_r_missing": m - both}
        out |= {name: number(f"q_{name}") for name in ("wp_min", "wp_mean", "wp_low", "tw_full", "tw_num", "tw_name", "tw_addr")} | {"q_vocab_min": number("q_vocab_min"), "q_addr_empty": number("q_addr_empty")}
        out |= {"nr_alias": (out["name_query_tokens"] == 1) & (out["q_vocab_min"] <= 0), "r_name_mult": number("r_r_name_mult"), "r_claims": number("r_r_claims")}
    return out
