"""Language-model scoring with Brown's class-based bigrams.

Words are assigned to classes by exchange clustering (Kneser and Ney 1993): words move to the class that raises
the likelihood of the class bigrams most. The most frequent words move one after the other, and with them groups of the others that
end alike. Then all words that were seen often enough move at once, each by its own neighbours' classes, which the executors count.
Rarer and unknown words stay with those that end alike.
A text's probability is that of its class transitions times that of each word in its class, both smoothed.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch_of, crc_bucket, cut, forget, in_portions, kept, narrow, packed_by_part, prefix_sums

#: Words that move one after the other, groups of the others by their ending, classes, sweeps over the words at most.
CLUSTERED, ENDINGS, CLASSES, SWEEPS = 2_048, 256, 64, 8
#: Occurrences from which on a word moves by itself; tokens that a task counts neighbours of before it passes the sums on.
OFTEN, TOKENS = 3, 2_000_000
#: Bytes of text that a task takes apart at a time.
PORTION = 6_000_000
#: Words whose counts and classes are broadcast (18 bytes each), words that a worker remembers, distinct words a task holds back.
COMMON, MEMO_WORDS, HELD = 400_000, 250_000, 250_000
#: Observations that a class's own transitions are weighed against.
TRUST = 50.0
END = b"\n"  # no word holds white space


def tokens_of(text: str) -> list[bytes]:
    """The words of a text in lower case (A-Z only), split at ASCII white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def encoded(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Portions of a column of texts: the distinct tokens, where each token of the texts in turn is among them, tokens a text.

    Tokens are those of tokens_of() and then END for each text; null is the empty text.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for start, stop in in_portions(sizes, PORTION):
        # A fresh array: the kernels aren't sure of slices.
        whole = pa.array([x or "" for x in texts.slice(start, stop - start).to_pylist()], pa.string())
        words = pc.ascii_split_whitespace(pc.ascii_lower(whole))
        flat, offsets = words.flatten(), words.offsets.to_numpy().astype(np.int64)
        # White space at either end of a text leaves an empty part.
        full = pc.not_equal(pc.binary_length(flat), 0)
        before = prefix_sums(full.to_numpy(zero_copy_only=False))
        lengths = np.diff(before[offsets - offsets[0]])
        coded = flat.filter(full).dictionary_encode()
        known = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
        index = np.full(int(lengths.sum()) + len(lengths), len(known) - 1, np.int64)
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(index), bool)
        inside[ends] = False
        index[inside] = coded.indices.to_numpy()
        yield known, index, lengths + 1


def ending_of(word: bytes) -> bytes:
    """The last two letters."""
    if word.isascii():
        return word[-2:]
    starts = [i for i, b in enumerate(word) if b & 0xC0 != 0x80]
    return word[starts[-2] :] if len(starts) > 1 else word


def word_key(word: bytes) -> int:
    """55 bits of a word's hash, then 8 bits that its last two letters decide: the group of words with its ending."""
    return xxhash.xxh3_64_intdigest(word) & 0x7FFF_FFFF_FFFF_FF00 | xxhash.xxh32_intdigest(ending_of(word)) % ENDINGS


def _dealt(keys: np.ndarray, rest: np.ndarray, parts: int) -> list[bytes]:
    """Pairs of numbers packed for each part of the key space."""
    return packed_by_part(((keys >> np.uint64(8)) % np.uint64(parts)).astype(np.int64), parts, keys, rest)


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=np.uint64).reshape(-1, 2)


def _summed(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's numbers."""
    keys, place = np.unique(pairs[:, 0], return_inverse=True)
    sums = np.zeros(len(keys), dtype=np.uint64)
    np.add.at(sums, place, pairs[:, 1])
    return keys, sums


BINS = np.concatenate((np.arange(1, 1025), 1024 * 2 ** np.arange(1, 41))).astype(np.uint64)


def word_counts(train: DataFrame, parts: int) -> DataFrame:
    """part, counts (packed word keys and counts), types and tokens by ending, bins: all words of the texts, ends included.

    Each task sums before it deals out; a part is a share of the key space, so it is as large as the vocabulary's share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(map(word_key, seen), np.uint64, len(seen))
            packed = _dealt(keys, np.fromiter(seen.values(), np.uint64, len(seen)), parts)
            seen.clear()
            return batch_of(["part", "packed"], [pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary())])

        for batch in batches:
            for words, index, _ in encoded(batch.column(0)):
                for word, n in zip(words, np.bincount(index, minlength=len(words)).tolist()):
                    seen[word] += n
                if len(seen) > HELD:
                    yield flush()
        if seen:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        keys, sums = _summed(_unpacked(table.column("packed")))
        ending = (keys & np.uint64(0xFF)).astype(np.int64)
        types = np.bincount(ending, minlength=ENDINGS)
        tokens = np.zeros(ENDINGS, np.int64)
        np.add.at(tokens, ending, sums.astype(np.int64))
        bins = np.bincount(np.searchsorted(BINS, sums, "right") - 1, minlength=len(BINS))
        return pa.table({"part": table.column("part").slice(0, 1), "counts": [np.stack((keys, sums), axis=1).tobytes()], "types": [types.tolist()], "tokens": [tokens.tolist()], "bins": [bins.tolist()]})

    return cut(train.mapInArrow(count, "part int, packed binary").groupBy("part").applyInArrow(add, "part int, counts binary, types array<long>, tokens array<long>, bins array<long>"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's rows of equally long lists, place by place, as one row."""
    total = None
    for batch in batches:
        for row in batch.column(0).to_pylist():
            total = np.array(row) if total is None else total + row
    if total is not None:
        yield batch_of(["n"], [pa.array([total.tolist()], pa.list_(pa.int64()))])


def _common_words(counts: DataFrame, bins: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (in order) and counts of the words of the highest counts, `most` at most, whole bins of counts at a time."""
    above = np.cumsum(bins[::-1])[::-1]
    fits = np.flatnonzero(above <= most)
    least = BINS[fits[0]] if len(fits) else np.uint64(2**63)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for blob in batch.column(0).to_pylist():
                pairs = np.frombuffer(blob, dtype=np.uint64).reshape(-1, 2)
                found.append(pairs[pairs[:, 1] >= least].tobytes())
            yield batch_of(["packed"], [pa.array(found, pa.binary())])

    pairs = np.concatenate([np.zeros((0, 2), np.uint64), *(np.frombuffer(r.packed, dtype=np.uint64).reshape(-1, 2) for r in counts.select("counts").mapInArrow(pick, "packed binary").collect())])
    pairs = pairs[np.argsort(pairs[:, 0])]
    return pairs[:, 0], pairs[:, 1]


class Units:
    """What is clustered: the most frequent words, each alone (the end of a text is the first), and the endings."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, most: int):
        end = np.uint64(word_key(END))
        order = np.lexsort((keys, -counts.astype(np.int64)))
        chosen = keys[order]
        self.words = np.concatenate(([end], chosen[chosen != end][: most - 1])).astype(np.uint64)
        self.size = len(self.words) + ENDINGS
        self.at = {int(k): i for i, k in enumerate(self.words)}

    def unit(self, word: bytes) -> int:
        key = word_key(word)
        return self.at.get(key, len(self.words) + (key & 0xFF))


def bigrams(train: DataFrame, units: Units, parts: int) -> np.ndarray:
    """How often each unit follows each: a square of at most CLUSTERED + ENDINGS a side, whatever the corpus's size."""
    shared, name, size = train.sparkSession.sparkContext.broadcast(units), uuid.uuid4().hex, units.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept(f"units {name}", lambda: Memo(shared.value.unit, MEMO_WORDS))
        square = np.zeros(size * size, dtype=np.uint32)
        for batch in batches:
            for words, index, _ in encoded(batch.column(0)):
                # The end of a text is unit 0, and stands before the first as well.
                ids = np.concatenate(([0], np.array([memo[w] for w in words], dtype=np.int64)[index]))
                codes, n = np.unique(ids[:-1] * size + ids[1:], return_counts=True)
                square[codes] += n.astype(np.uint32)
        codes = np.flatnonzero(square).astype(np.uint64)
        # Keys are spread by their upper bits.
        packed = _dealt(codes << np.uint64(8), square[codes.astype(np.int64)].astype(np.uint64), parts)
        yield batch_of(["part", "packed"], [pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary())])

    def total(table: pa.Table) -> pa.Table:
        keys, sums = _summed(_unpacked(table.column("packed")))
        return pa.table({"packed": [np.stack((keys >> np.uint64(8), sums), axis=1).tobytes()]})

    square = np.zeros(size * size)
    for r in train.mapInArrow(count, "part int, packed binary").groupBy("part").applyInArrow(total, "packed binary").collect():
        pairs = np.frombuffer(r.packed, dtype=np.uint64).reshape(-1, 2)
        square[pairs[:, 0].astype(np.int64)] = pairs[:, 1]
    return square.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(square: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit, by exchange: units in order of frequency move to the class that raises the likelihood most.

    It starts from the classes - 1 most frequent units alone and the rest together, and ends when no unit moves or after
    `sweeps` sweeps. Ties stay, or go to the lower class.
    """
    size = len(square)
    frequency = square.sum(axis=0)
    order = np.argsort(-frequency, kind="stable")
    of = np.full(size, classes - 1)
    of[order[: classes - 1]] = np.arange(min(classes - 1, size))
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    after, before = square @ member, square.T @ member  # by unit: what classes follow it, precede it
    table = member.T @ after
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    spot = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = of[w], square[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= own
            left[a] -= own
            r, c = right.sum() + own, left.sum() + own
            if r + c == 0:
                continue
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            rows[a] -= r
            columns[a] -= c
            was = _xlogx(table)
            gain = (_xlogx(table + right[None, :]) - was).sum(axis=1) + (_xlogx(table + left[:, None]) - was).sum(axis=0)
            corner = table[spot, spot]
            gain += _xlogx(corner + right + left + own) + _xlogx(corner) - _xlogx(corner + right) - _xlogx(corner + left)
            gain -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(columns + c) - _xlogx(columns)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += right
            table[:, b] += left
            table[b, b] += own
            rows[b] += r
            columns[b] += c
            if a != b:
                moved += 1
                of[w] = b
                after[:, a] -= square[:, w]
                after[:, b] += square[:, w]
                before[:, a] -= square[w]
                before[:, b] += square[w]
        if not moved:
            break
    return of


def leanings(table: np.ndarray) -> np.ndarray:
    """How much the likelihood gains for each class (column) by one more neighbour of each class, before and then after (rows).

    The gain of a move is to first order the sum over a word's neighbours, with all other words where they are.
    """
    classes = len(table)
    counted = table + 0.5
    follows = np.log(counted / counted.sum(axis=1)[:, None])
    precedes = np.log(counted / counted.sum(axis=0)[None, :])
    return np.concatenate((precedes, follows.T)).reshape(2 * classes, classes)


class Words:
    """The common words' keys in order, and where a worker finds each word: its place, or its key's complement, which is negative."""

    def __init__(self, keys: np.ndarray):
        self.places = {k: i for i, k in enumerate(keys.tolist())}
        self.memo = Memo(self.look, MEMO_WORDS)
        self.end = self.look(END)

    def look(self, word: bytes) -> int:
        key = word_key(word)
        return self.places.get(key, ~key)

    def codes(self, words: list[bytes], index: np.ndarray) -> np.ndarray:
        """The codes of the tokens that encoded() gave."""
        memo = self.memo
        return np.array([memo[w] for w in words], dtype=np.int64)[index]


class Classes:
    """The class of each common word by its place, and of all others by their ending."""

    def __init__(self, common: np.ndarray, endings: np.ndarray):
        self.common, self.endings = common, endings

    def path(self, codes: np.ndarray) -> np.ndarray:
        away = codes < 0
        out = np.empty(len(codes), np.int64)
        out[~away] = self.common[codes[~away]]
        out[away] = self.endings[(~codes[away]) & 0xFF]
        return out


def _streams(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[np.ndarray]:
    """The codes of texts, many at a time; an end is before the first text and after each."""
    held, size = [np.array([words.end])], 0
    for batch in batches:
        for found, index, _ in encoded(batch.column(0)):
            held.append(words.codes(found, index))
            size += len(index)
            if size > TOKENS:
                yield np.concatenate(held)
                held, size = [np.array([words.end])], 0
    if size:
        yield np.concatenate(held)


def moved(train: DataFrame, words_of, classes: Classes, table: np.ndarray, moves: np.ndarray, parts: int) -> np.ndarray:
    """The common words' classes after each of those that `moves` marks has gone where its neighbours' classes draw it most.

    Neighbours are counted by word and class on the executors, and each word is decided there; places and classes come here,
    as many as there are common words at most. Ties go to the lower class.
    """
    n = len(table)
    shared = train.sparkSession.sparkContext.broadcast((classes, moves))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, may = shared.value
        for codes in _streams(batches, words_of()):
            path = own.path(codes)
            at = np.flatnonzero(codes[1:-1] >= 0) + 1
            at = at[may[codes[at]]]
            place = codes[at] * (2 * n)
            found, times = np.unique(np.concatenate((place + path[at - 1], place + n + path[at + 1])), return_counts=True)
            yield batch_of(["part", "packed"], [pa.array(range(parts), pa.int32()), pa.array(packed_by_part(found // (2 * n) % parts, parts, found.astype(np.uint64), times.astype(np.uint64)), pa.binary())])

    leaning = leanings(table)

    def decide(rows: pa.Table) -> pa.Table:
        codes, sums = _summed(_unpacked(rows.column("packed")))
        codes = codes.astype(np.int64)
        places, row = np.unique(codes // (2 * n), return_inverse=True)
        best = np.zeros(len(places), np.int64)
        for low in range(0, len(places), 50_000):
            some = (row >= low) & (row < low + 50_000)
            seen = np.zeros((min(50_000, len(places) - low), 2 * n))
            seen[row[some] - low, codes[some] % (2 * n)] = sums[some]
            best[low : low + 50_000] = (seen @ leaning).argmax(axis=1)
        return pa.table({"packed": [np.stack((places, best), axis=1).tobytes()]})

    out = classes.common.copy()
    for r in train.mapInArrow(count, "part int, packed binary").groupBy("part").applyInArrow(decide, "packed binary").collect():
        places, best = np.frombuffer(r.packed, dtype=np.int64).reshape(-1, 2).T
        out[places] = best
    return out


def transitions(train: DataFrame, words_of, classes: Classes, n: int) -> np.ndarray:
    """How often each class follows each, a square of n a side."""
    shared = train.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for codes in _streams(batches, words_of()):
            path = shared.value.path(codes)
            total += np.bincount(path[:-1] * n + path[1:], minlength=n * n)
        yield batch_of(["n"], [pa.array([total.tolist()], pa.list_(pa.int64()))])

    rows = train.mapInArrow(count, "n array<long>").repartition(16).mapInArrow(_totals, "n array<long>").collect()
    return np.sum([np.zeros(n * n, np.int64), *(r.n for r in rows)], axis=0, dtype=np.int64).reshape(n, n).astype(float)


def steps_of(table: np.ndarray, types: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The part of each token's log10 probability that doesn't depend on the word's own count, by the class before and its own.

    Transitions are weighed against the classes' own shares. A word's probability in its class is (count + 1) / (tokens +
    types + 1 of the class), so unknown words have one share.
    """
    from_, total = table.sum(axis=1), table.sum()
    alone = (table.sum(axis=0) + 1) / (total + len(table))
    weight = from_ / (from_ + TRUST)
    transition = weight[:, None] * table / np.maximum(from_, 1)[:, None] + (1 - weight)[:, None] * alone[None, :]
    return np.log10(transition) - np.log10(tokens + types + 1)[None, :]


def score(df: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 7, held: int = 2, classes: int = CLASSES, clustered: int = CLUSTERED, sweeps: int = SWEEPS, common: int = COMMON, least: int = OFTEN) -> DataFrame:
    """One row for each row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Null is the empty text. Learns from rows whose crc32 of the id isn't `held` modulo `modulus`; every word, count and
    transition of theirs counts. base_score is the add-one unigram log10 probability, score the class model's, perplexity
    10 ** (-score / n_tokens). Words that occur `least` times or more have a class of their own choice, if they are among the
    `common` most frequent ones. With nothing to learn from, all words are unknown and all transitions alike. Repeated rows
    are scored, and learned from, each for itself; texts of any length are read whole; an empty table gives no rows, and other
    columns are not looked at.
    """
    spark = df.sparkSession
    docs = narrow(df, id=doc_id, text=text).withColumn("held_out", crc_bucket("id", modulus) == held)
    train = docs.where(~F.col("held_out")).select("text")
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = word_counts(train, parts)
    # Summed in each task, then in a few: as many rows come here for any number of parts.
    listed = counts.select(F.concat("types", "tokens", "bins").alias("n")).mapInArrow(_totals, "n array<long>").repartition(16).mapInArrow(_totals, "n array<long>")
    flat = np.sum([np.zeros(2 * ENDINGS + len(BINS), np.int64), *(r.n for r in listed.collect())], axis=0, dtype=np.int64)
    types, tokens, bins = flat[:ENDINGS], flat[ENDINGS : 2 * ENDINGS], flat[2 * ENDINGS :]
    n, v = int(tokens.sum()), int(types.sum())
    keys, often = _common_words(counts, bins, common)
    units = Units(keys, often, clustered)
    square = bigrams(train, units, parts)
    of = exchange(square, classes, sweeps)
    first = len(units.words)
    alone = np.array([units.at.get(k, -1) for k in keys.tolist()], dtype=np.int64)
    endings = of[first:].astype(np.int64)
    given = Classes(np.where(alone >= 0, of[alone], endings[(keys & np.uint64(0xFF)).astype(np.int64)]).astype(np.int16), endings)
    shared, name = spark.sparkContext.broadcast((keys, often)), uuid.uuid4().hex  # bounded by `common`
    words_of = lambda: kept(f"brown {name}", lambda: Words(shared.value[0]))
    member = np.zeros((units.size, classes))
    member[np.arange(units.size), of] = 1
    given = Classes(moved(train, words_of, given, member.T @ square @ member, (alone < 0) & (often >= least), parts), endings)
    # What isn't common is known by its ending's sums, less those of the common words with it.
    ending_of_key = (keys & np.uint64(0xFF)).astype(np.int64)
    rare_types, rare_tokens = (all_ - np.bincount(ending_of_key, weights=w, minlength=ENDINGS) for all_, w in ((types, np.ones(len(keys))), (tokens, often.astype(float))))
    class_types, class_tokens = (np.bincount(endings, weights=rare, minlength=classes) + np.bincount(given.common, weights=w, minlength=classes) for rare, w in ((rare_types, np.ones(len(keys))), (rare_tokens, often.astype(float))))
    ready = spark.sparkContext.broadcast((given, steps_of(transitions(train, words_of, given, classes), class_types, class_tokens), np.log10(often.astype(np.float64) + 1)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (own, steps, logs_of) = words_of(), ready.value
        row, wait_keys, wait_rows, waiting = TaskContext.get().partitionId() << 36, [], [], 0
        names = ["row", "id", "held_out", "n_tokens", "n_known", "counted", "steps", "part", "packed"]

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            packed = _dealt(np.concatenate(wait_keys), np.concatenate(wait_rows), parts)
            wait_keys.clear()
            wait_rows.clear()
            nothing = [pa.nulls(parts, t) for t in (pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            return batch_of(names, [*nothing, pa.array(range(parts), pa.int32()), pa.array(packed, pa.binary())])

        kind = None
        for whole in batches:
            kind = whole.schema.field("id").type
            start = 0
            for found, index, lengths in encoded(whole.column("text")):
                size, codes = len(lengths), words.codes(found, index)
                batch = whole.slice(start, size)
                start += size
                away = codes < 0
                keys_away = (~codes[away]).astype(np.uint64)
                path, logs = own.path(codes), np.zeros(len(codes))
                logs[~away] = logs_of[codes[~away]]
                # Every text ends with an end, so what precedes a text's first word is one.
                before = np.concatenate((path[-1:], path[:-1]))
                starts = prefix_sums(lengths)[:-1]
                n_away = np.add.reduceat(away.astype(np.int64), starts)
                rows_ = np.arange(row, row + size)
                row += size
                if len(keys_away):
                    wait_keys.append(keys_away)
                    wait_rows.append(np.repeat(rows_, n_away).astype(np.uint64))
                    waiting += len(keys_away)
                yield batch_of(names, [rows_, batch.column("id"), batch.column("held_out"), lengths, lengths - n_away, np.add.reduceat(logs, starts), np.add.reduceat(steps[before, path], starts), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())])
                if waiting > 1_000_000:
                    waiting = 0
                    yield flush(kind)
        if wait_keys:
            yield flush(kind)

    id_kind = df.schema[doc_id].dataType.simpleString()
    scored = cut(docs.mapInArrow(local, f"row long, id {id_kind}, held_out boolean, n_tokens long, n_known long, counted double, steps double, part int, packed binary"))

    def rare(asked: pa.Table, table: pa.Table) -> pa.Table:
        pairs = _unpacked(asked.column("packed"))
        known_pairs = _unpacked(table.column("counts"))
        place = np.minimum(np.searchsorted(known_pairs[:, 0], pairs[:, 0]), max(0, len(known_pairs) - 1))
        hit = known_pairs[place, 0] == pairs[:, 0] if len(known_pairs) else np.zeros(len(pairs), bool)
        rows_, where = np.unique(pairs[hit, 1], return_inverse=True)
        return pa.table({"row": rows_.astype(np.int64), "logs": np.bincount(where, weights=np.log10(known_pairs[place[hit], 1].astype(np.float64) + 1), minlength=len(rows_)).astype(np.float64), "known": np.bincount(where, minlength=len(rows_)).astype(np.int64)})

    asked = scored.where("part is not null").select("part", "packed")
    away = asked.groupBy("part").cogroup(counts.select("part", "counts").groupBy("part")).applyInArrow(rare, "row long, logs double, known long").groupBy("row").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))
    logs = F.col("counted") + F.coalesce("logs", F.lit(0.0))
    total = (logs + F.col("steps")).alias("score")
    return scored.where("row is not null").join(away, "row", "left").select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), total, F.pow(F.lit(10.0), -(logs + F.col("steps")) / F.col("n_tokens")).alias("perplexity"),
    )
