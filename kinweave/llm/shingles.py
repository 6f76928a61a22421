"""N-gram Jaccard join by a MinHash LSH forest (Bawa et al. 2005).

Each text's set of word n-grams gets a label in each of `trees` prefix tries: the values of `deepest` hash minima, one byte of each.
Each trie is the labels in order, so sets that agree in their first d values are neighbours there, and the longest prefix that
neighbours share says for every d at once who meets. The join starts at the longest prefix, compares exactly what meets there, and
reads from the similarities of the links that it found which share of all links a prefix of that length finds. Prefixes
are shortened until that share reaches the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, cut, forget, in_portions, narrow, prefix_sums, texts_of
from .components import components
from .linededup import MIX, PORTION, POWERS, normal

WORDS, SIMILARITY, TREES, DEEPEST, RECALL = 5, 0.8, 20, 8, 0.999
#: Sets in a tile of a large group; pairs up to which they are compared one by one; grades of similarity that links are counted by.
TILE, ONE_BY_ONE, GRADES = 512, 600, 20


def meeting(similarity, depth: int, trees: int):
    """The chance that sets of some similarity agree in the first `depth` values of one of the tries at least."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def shortest(similarity: float, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The prefix that reaches the recall even if all links are at just that similarity, 1 at least: none need be shorter."""
    return next((d for d in range(deepest, 1, -1) if meeting(similarity, d, trees) >= recall), 1)


def shortened(links: np.ndarray, depth: int, similarity: float, trees: int, floor: int, recall: float) -> int:
    """The longest prefix, `depth` at most, that finds the target share of all links, judged by those found at `depth`.

    links: how many by grades of similarity from `similarity` to 1. A link stands for as many as it takes to find one of
    its similarity there. One more at just the wanted similarity is supposed, so that none found is no proof of none.
    """
    at = similarity + (1 - similarity) * np.arange(GRADES) / GRADES
    supposed = (links + (np.arange(GRADES) == 0)) / meeting(at, depth, trees)
    return next((d for d in range(depth, floor, -1) if (supposed * meeting(at, d, trees)).sum() >= recall * supposed.sum()), min(depth, floor))


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the word n-grams of each text, in order, and where each text's begin.

    Words are what white space separates, in lower case. A text of fewer words has one n-gram, all of it; one without
    words has none.
    """
    lines = [normal(x) for x in texts]
    parts = [_shingles(lines[a:b], words) for a, b in in_portions([len(x) for x in lines], PORTION)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate([h for h, _ in parts]), prefix_sums(np.concatenate([np.diff(starts) for _, starts in parts]))


def _shingles(lines: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    bounds = prefix_sums(sizes)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    up, down = POWERS.get(len(code) + 1)
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    space = code == 32
    begins, ends = np.zeros(len(code), bool), np.zeros(len(code), bool)
    begins[1:], ends[:-1] = space[:-1], space[1:]
    full = sizes > 0
    begins[bounds[:-1][full]] = True
    ends[bounds[1:][full] - 1] = True
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # Spaces themselves neither begin nor end a word.
    begins, ends = begins[~space[begins]], ends[~space[ends - 1]]
    first = np.searchsorted(begins, bounds)
    count = np.diff(first)
    grams = np.where(count == 0, 0, np.maximum(1, count - words + 1))
    of = np.repeat(np.arange(len(lines)), grams)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams)
    last = np.minimum(at + words, first[of + 1]) - 1
    h = (sums[ends[last]] - sums[begins[at]]) * down[begins[at]]
    h = (h ^ (h >> np.uint64(31))) * MIX
    h ^= h >> np.uint64(29)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[fresh], of[fresh]
    return h, np.searchsorted(of, np.arange(len(lines) + 1))


def labels_of(h: np.ndarray, starts: np.ndarray, trees: int, deepest: int) -> np.ndarray:
    """The label of each non-empty set in each trie: a byte of each of `deepest` hash minima."""
    seeds = np.random.default_rng(7).integers(0, 1 << 63, (trees * deepest, 2), dtype=np.uint64)
    labels = np.zeros((len(starts), trees * deepest), dtype=np.uint8)
    for k, (a, b) in enumerate(seeds):
        least = np.minimum.reduceat(h * (a | np.uint64(1)) + b, starts) * MIX
        labels[:, k] = least >> np.uint64(56)
    return labels


def _sketch(docs: DataFrame, words: int, trees: int, deepest: int) -> DataFrame:
    """id, k, size, s, s2 (two order-free hashes of the set), labels: one row for each row; size 0 if the text has no word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, starts = shingle_sets(texts_of(batch.column("text")), words)
        size = np.diff(starts)
        some = np.flatnonzero(size)
        s, s2, labels = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64), [b""] * len(size)
        if len(some):
            at = starts[:-1][some]
            s[some] = np.add.reduceat(h, at)
            s2[some] = np.add.reduceat((h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53), at)
            for i, label in zip(some.tolist(), labels_of(h, at, trees, deepest)):
                labels[i] = label.tobytes()
        return batch_of(["id", "k", "size", "s", "s2", "labels"], [batch.column("id"), batch.column("k"), pa.array(size, pa.int32()), s.view(np.int64), s2.view(np.int64), pa.array(labels, pa.binary())])

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, k long, size int, s long, s2 long, labels binary")


def forest(sets: DataFrame, trees: int, deepest: int, floor: int) -> DataFrame:
    """a, b, depth: links between sets (s, labels) that share a prefix of `depth` values, floor to deepest, in a trie.

    Sets that share their first d values, directly or through others of that prefix, are those that links of depth d or more
    connect: each set is linked to the first of its prefix in its sorted trie. Tries are sorted over ranges of labels, so a
    frequent prefix spreads over as many tasks as its sets need; ends of ranges are linked afterwards.
    """
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring("labels", t * deepest + 1, F.lit(deepest)).alias("label")))
    order = ["tree", "label", "s"]
    ranged = sets.select("s", F.inline(each)).repartitionByRange(*order).sortWithinPartitions(*order)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        names = ["a", "b", "depth", "range", "tree", "label"]
        own, first, last, heads = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, tree = batch.column("s").to_numpy(), batch.column("tree").to_numpy()
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, deepest)
            if first is None:
                first, heads = (s[0], tree[0], label[0]), np.full(deepest + 1, s[0])
            # The row before, or, at the very start, one that shares nothing.
            before = last or (s[0], -1, label[0])
            same = (label == np.concatenate((before[2][None], label[:-1]))) & (tree == np.concatenate(([before[1]], tree[:-1])))[:, None]
            shared = np.cumprod(same, axis=1).sum(axis=1)
            place = np.arange(len(s))
            out, longer = [], None
            for depth in range(deepest, floor - 1, -1):
                at = np.maximum.accumulate(np.where(shared < depth, place, -1))
                head = np.where(at < 0, heads[depth], s[at])
                # A link that a longer prefix gives is given once.
                fresh = (shared >= depth) if longer is None else (shared >= depth) & ((head != longer) | (shared < depth + 1))
                out.append((s[fresh], head[fresh], np.full(fresh.sum(), depth, np.int32)))
                heads[depth], longer = head[-1], head
            last = (s[-1], tree[-1], label[-1])
            a, b, depth = map(np.concatenate, zip(*out))
            yield batch_of(names, [a, b, depth, *(pa.nulls(len(a), t) for t in (pa.int32(), pa.int32(), pa.binary()))])
        if first is not None:
            ends = (first, last)
            yield batch_of(names, [pa.array([int(x[0]) for x in ends], pa.int64()), pa.nulls(2, pa.int64()), pa.array([0, 1], pa.int32()), pa.array([own] * 2, pa.int32()), pa.array([int(x[1]) for x in ends], pa.int32()), pa.array([x[2].tobytes() for x in ends], pa.binary())])

    climbed = cut(ranged.mapInArrow(climb, "a long, b long, depth int, range int, tree int, label binary"))
    # Two rows for each range, however many sets there are.
    ends = sorted(climbed.where("range is not null").select("range", "depth", "a", "tree", "label").collect())
    between = []
    for x, y in zip(ends[1::2], ends[2::2]):
        depth = next((d for d in range(deepest) if x.label[d] != y.label[d]), deepest) if x.tree == y.tree else 0
        if depth >= floor:
            between.append((x.a, y.a, depth))
    links = climbed.where("range is null").select("a", "b", "depth")
    return links.unionByName(sets.sparkSession.createDataFrame(between, "a long, b long, depth int")) if between else links


def prefixes(labels: list[bytes], trees: int, depth: int) -> np.ndarray:
    """A number for the first `depth` values of each label in each trie; equal prefixes have equal numbers."""
    held = np.frombuffer(b"".join(labels), np.uint8).reshape(len(labels), trees, -1)
    keys = np.zeros((len(labels), trees), np.uint64)
    for d in range(depth):
        keys = (keys + held[:, :, d] + np.uint64(1)) * MIX
    return keys


def _similar(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, keys: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (row, column) of sets that meet in a trie and are similar, and how much; row < column where both lists hold the two."""
    sizes = np.array([len(x) for x in sets])
    meets = np.zeros((len(rows), len(columns)), bool)
    for t in range(keys.shape[1]):
        meets |= keys[rows, t][:, None] == keys[columns, t][None, :]
    a, b = sizes[rows][:, None].astype(np.int64), sizes[columns][None, :].astype(np.int64)
    meets &= np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
    if np.array_equal(rows, columns):
        meets = np.triu(meets, 1)
    x, y = np.nonzero(meets)
    if not len(x):
        return rows[x], columns[y], np.zeros(0)
    if len(x) <= ONE_BY_ONE:
        shared = np.array([len(np.intersect1d(sets[rows[i]], sets[columns[j]], assume_unique=True)) for i, j in zip(x, y)])
    else:
        # Products of 0/1 matrices count what sets share; a value that one set holds is shared by none.
        every = np.unique(np.concatenate((rows, columns)))
        values, times = np.unique(np.concatenate([sets[i] for i in every]), return_counts=True)
        values = values[times > 1]
        counts = np.zeros((len(rows), len(columns)), np.float32)
        place = {int(i): n for n, i in enumerate(every)}
        held = [np.searchsorted(values, own[np.isin(own, values, assume_unique=True)]) for own in (sets[i] for i in every)]
        for low in range(0, len(values), 2048):
            bits = np.zeros((len(every), min(2048, len(values) - low)), np.float32)
            for n, own in enumerate(held):
                bits[n, own[(own >= low) & (own < low + 2048)] - low] = 1
            counts += bits[[place[int(i)] for i in rows]] @ bits[[place[int(i)] for i in columns]].T
        shared = np.rint(counts[x, y]).astype(np.int64)
    union = sizes[rows[x]] + sizes[columns[y]] - shared
    jaccard = shared / union
    good = jaccard >= similarity
    return rows[x[good]], columns[y[good]], jaccard[good]


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the pairs reach from it."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        root = root[root]
        if np.array_equal(root, before):
            return root


def _compare(similarity: float, trees: int, depth: int):
    """Of the sets of a tile, or a share of the small groups: links to the least that a set is linked to there, then a row of link counts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("s", "ascending")])
        component, side, s, n = (table.column(c).to_numpy() for c in ("component", "side", "s", "n"))
        keys = prefixes(table.column("labels").to_pylist(), trees, depth)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        whole = (table.column("i").to_numpy() == table.column("j").to_numpy())
        weight, parent, grades = np.zeros(len(s), np.int64), s.copy(), np.zeros(GRADES, np.int64)
        edges = np.flatnonzero(np.concatenate(([True], component[1:] != component[:-1], [True])))
        for low, high in zip(edges, edges[1:]):
            own = np.arange(low, high)
            # Within a tile all with all; between two tiles the one's with the other's.
            rows, columns = (own, own) if whole[low] else (own[side[own] == 0], own[side[own] == 1])
            if not len(rows) or not len(columns):
                continue
            x, y, jaccard = _similar(sets, rows, columns, keys, similarity)
            np.add.at(weight, x, n[y])
            np.add.at(weight, y, n[x])
            parent[own] = s[low + _forest(len(own), x - low, y - low)]
            grades += np.bincount(np.minimum(GRADES - 1, ((jaccard - similarity) / max(1e-9, 1 - similarity) * GRADES).astype(int)), minlength=GRADES)
        linked = weight > 0
        none = pa.nulls(1, pa.int64())
        counts = pa.array([None] * int(linked.sum()) + [grades.tolist()], pa.list_(pa.int64()))
        return pa.table({"a": pa.concat_arrays([pa.array(s[linked]), none]), "b": pa.concat_arrays([pa.array(parent[linked]), none]), "weight": pa.concat_arrays([pa.array(weight[linked]), none]), "grades": counts})

    return run


def _verified(held: DataFrame, met: DataFrame, depth: int, similarity: float, trees: int, tile: int) -> DataFrame:
    """a, b, weight, grades: the links among the sets (s, n, labels, shingles) that meet at prefixes of `depth` values."""
    near = components(met.where(F.col("depth") >= depth))
    sizes = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    grouped = held.join(near.join(sizes, "component").withColumnRenamed("id", "s"), "s")
    parts = 4 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped.withColumn("own", F.pmod("s", "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "component", "s", "n", "labels", "shingles", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.when(F.col("tiles") == 1, F.pmod("component", F.lit(parts))).otherwise(F.col("component")).alias("part"), (F.col("tiles") > 1).alias("large"),
    )
    return cut(dealt.groupBy("large", "part", "i", "j").applyInArrow(_compare(similarity, trees, depth), "a long, b long, weight long, grades array<long>"))


def groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """One row for each row of df: id, k, class_id, n_links.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is `similarity` or more; n_links counts
    the other rows that a row is linked to, copies included, and class_id is the least id that links reach, its own if none. Rows whose
    text is null or has no word are linked to none, texts of any length are read whole, an empty table gives no rows, and
    other columns are not looked at. Every link found is exact; the share `recall` of all links at least is expected to be
    found, by the similarities of those found; of equal sets all are.
    """
    docs = narrow(df, id=doc_id, text=text).withColumn("k", F.xxhash64("id", "text"))
    sketch = cut(_sketch(docs, words, trees, deepest))
    # Equal sets are one class from here on: a group of copies is a row.
    classes = cut(sketch.where("size > 0").groupBy("s", "s2").agg(F.min(F.struct("id", "k")).alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("labels").alias("labels")))
    floor = shortest(similarity, trees, deepest, recall)
    met = forest(classes.select("s", "labels"), trees, deepest, floor)
    # Texts of what may be compared are fetched once, as sets.
    some = met.select(F.col("a").alias("s")).unionByName(met.select(F.col("b").alias("s"))).distinct()
    wanted = classes.join(some, "s").select("s", "n", "labels", F.col("first.id").alias("i_"), F.col("first.k").alias("k_"))
    texts = docs.join(wanted, F.col("i_").eqNullSafe(F.col("id")) & (F.col("k_") == F.col("k"))).select("s", "n", "labels", "text").dropDuplicates(["s"])

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, starts = shingle_sets(texts_of(batch.column("text")), words)
        packed = [h[a:b].tobytes() for a, b in zip(starts, starts[1:])]
        names = ["s", "n", "labels"]
        return batch_of([*names, "shingles"], [*(batch.column(c) for c in names), pa.array(packed, pa.binary())])

    held = cut(arrow_map(texts, sets, "s long, n long, labels binary, shingles binary"))
    depth = deepest
    while True:
        found = _verified(held, met, depth, similarity, trees, tile)
        counted = found.where("grades is not null").select(F.posexplode("grades").alias("grade", "n")).groupBy("grade").agg(F.sum("n").alias("n")).collect()
        by_grade = np.zeros(GRADES)
        for r in counted:
            by_grade[r.grade] = r.n
        shorter = shortened(by_grade, depth, similarity, trees, floor, recall)
        if shorter == depth:
            break
        depth = shorter
    links = found.where("grades is null")
    joined = components(links).withColumnRenamed("id", "s")
    weights = links.groupBy(F.col("a").alias("s")).agg(F.sum("weight").alias("weight"))
    named = classes.join(weights, "s", "left").join(joined, "s", "left").select("s", "s2", "n", "least", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("component", "s").alias("component"))
    firsts = named.groupBy("component").agg(F.min("least").alias("class_id"))
    verdict = named.join(firsts, "component").where("n > 1 or weight > 0").select("s", "s2", "class_id", (F.col("weight") + F.col("n") - 1).alias("n_links"))
    # Rows without words would all have one key.
    empty = sketch.where("size = 0").select("id", "k", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return sketch.where("size > 0").join(verdict, ["s", "s2"], "left").select("id", "k", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).unionByName(empty)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, class_id, n_links, kept (the row is its class's first): see groups(). Repeated rows count as copies."""
    return groups(df, text, doc_id, **options).select(F.col("id").alias("doc_id"), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """df with the row of the least id of each class only; rows without an id stay. Rows alike in id and text are one document.

    Columns keep their names, whatever these are.
    """
    gone = groups(df, text, doc_id, **options).where("id <> class_id").select("id", "k").distinct()
    own, body = F.col(f"row.`{doc_id}`"), F.col(f"row.`{text}`")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.join(gone, (own == F.col("id")) & (F.xxhash64(own, body) == F.col("k")), "left_anti").select("row.*")
