"""Line dedup by a segment-partition edit join (Li et al. 2011).

Lines within `edits` edits of each other share one of edits+1 segments at nearly the same place. Each line is indexed by its
segments and probes for the segments of lines up to `edits` shorter, at the places where the join needs to look. Lines that meet are compared
by banded bit-parallel edit distance.

Lines of `word_chars` or more characters are also joined by edits of whole words, of which a longer line may have more (word_edits()).
Line lengths fall into bands; a band has its own number of edits and so of segments, half of them counted from the line's start and half
from its end, so probes need to look i words about the i-th place from either.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, cut, drop, forget, in_portions, narrow, packed_by_part, prefix_sums, texts_of, trim
from .components import components

#: Edits between lines taken for the same; lines with fewer characters are in no edit join; entries a
#: task holds before it passes them on; lines of a large group compared at a time.
EDITS, MIN_CHARS, FLUSH, TILE = 2, 30, 1_000_000, 4_096
#: Lines with as many characters are joined by words too: one edit in WORDS_AN_EDIT words, MOST_WORDS edits at most.
WORD_CHARS, WORDS_AN_EDIT, MOST_WORDS = 100, 20, 64
#: Scripts written without spaces: each letter counts as a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Characters hashed at a time.
PORTION = 1_000_000

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)


def normal(line: str) -> str:
    """Lower case, each run of white space one space, trimmed."""
    low = line.lower()
    # Of white space only the plain space is printable, so most lines need no cutting into words.
    return low if low.isprintable() and "  " not in low and low[:1] != " " != low[-1:] else " ".join(low.split())


def line_hashes(lines: list[str]) -> np.ndarray:
    """128 bits of each normal line, in two columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), np.uint64).reshape(-1, 2)


class Powers:
    """Powers of the hash base and its inverse modulo 2**64; as many as a portion of text needs are kept."""

    def __init__(self):
        self.made = None

    @staticmethod
    def make(n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (BASE, INVERSE))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > PORTION + 1:
            return self.make(n)
        if self.made is None:
            self.made = self.make(PORTION + 1)
        return self.made


POWERS = Powers()


def _mixed(h: np.ndarray, length: np.ndarray, segment: int | np.ndarray) -> np.ndarray:
    h = (h ^ (length.astype(np.uint64) * np.uint64(0x100000001B3) + np.asarray(segment).astype(np.uint64))) * MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _places(length: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of some length: even parts, the longer ones last."""
    parts = edits + 1
    base, longer = length // parts, length % parts
    short = parts - longer
    start = i * base + np.maximum(0, i - short)
    return start, base + (i >= short)


def keys_of(lines: list[str], edits: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and line numbers of the index, keys and line numbers of the probes, for normal lines. Index entries are probes as well."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = prefix_sums(sizes)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    up, down = POWERS.get(len(code) + 1)
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    first, number = ends[:-1], np.arange(len(lines))

    def hashed(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (sums[start + length] - sums[start]) * down[start]

    index, index_of, probe, probe_of = [], [], [], []
    for i in range(edits + 1):
        start, length = _places(sizes, edits, i)
        index.append(_mixed(hashed(first + start, length), sizes, i))
        index_of.append(number)
        for shorter in range(edits + 1):
            other = sizes - shorter
            some = np.flatnonzero(other >= min_chars)
            start, length = _places(other[some], edits, i)
            # Where the segment can lie if what precedes it and what follows it take at most the edits left to them.
            for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                if not shorter and not move:
                    continue  # the line's own index entry
                at = start + move
                fits = np.flatnonzero((at >= 0) & (at + length <= sizes[some]))
                own = some[fits]
                probe.append(_mixed(hashed(first[own] + at[fits], length[fits]), other[own], i))
                probe_of.append(own)
    return np.concatenate(index), np.concatenate(index_of), np.concatenate(probe), np.concatenate(probe_of)


def word_edits(n: int) -> int:
    """Edits of words between lines taken for the same, the shorter of n words: 1 of 10, 2 of 20, then one in WORDS_AN_EDIT."""
    return min(MOST_WORDS, max(n // WORDS_AN_EDIT, min(2, n // 10)))


@functools.lru_cache(64)
def _bands(longest: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of numbers of words that have the same word_edits, as far as longest."""
    firsts, at = [], 10
    while at <= longest:
        firsts.append(at)
        same = at + max(1, at // 4)
        at = next((n for n in range(at + 1, same) if word_edits(n) != word_edits(at)), same)
    return list(zip(firsts, [x - 1 for x in firsts[1:]] + [at - 1]))


def word_keys(lines: list[str], word_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As keys_of(), for lines of word_chars or more characters and segments of words."""
    number = np.array([i for i, x in enumerate(lines) if len(x) >= word_chars], dtype=np.int64)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(number):
        return *none, *none
    long = [lines[i] for i in number]
    ends = prefix_sums(np.fromiter(map(len, long), np.int64, len(long)))
    code = np.frombuffer("".join(long).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    up, down = POWERS.get(len(code) + 1)
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    # Words start, and end, at spaces, ends of lines and letters that are words.
    space = code == 32
    opens, closes = np.ones(len(code), bool), np.ones(len(code), bool)
    if code.max() < UNSPACED[0][0]:
        opens[1:], closes[:-1] = space[:-1], space[1:]
    else:
        alone = np.zeros(len(code), bool)
        for a, b in UNSPACED:
            alone |= (code >= a) & (code <= b)
        parts = space | alone
        opens[1:], closes[:-1] = parts[:-1] | alone[1:], parts[1:] | alone[:-1]
    opens[ends[:-1]], closes[ends[1:] - 1] = True, True
    starts, stops = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
    words = _mixed((sums[stops] - sums[starts]) * down[starts], stops - starts, 0)
    first = np.searchsorted(starts, ends)
    first, sizes = first[:-1], np.diff(first)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])

    index, index_of, probe, probe_of = [none[0]], [none[1]], [none[0]], [none[1]]
    order = np.sort(sizes)
    for low, high in _bands(1 << int(sizes.max()).bit_length()):
        edits = word_edits(low)
        if np.searchsorted(order, low) == np.searchsorted(order, high + edits, "right"):
            continue
        segments, half = edits + 1, (edits + 2) // 2
        length = low // segments
        place = lambda i, n: np.where(i < half, i * length, n - (segments - i) * length)
        own = np.flatnonzero((sizes >= low) & (sizes <= high))
        looks = np.flatnonzero((sizes >= low) & (sizes <= high + edits))
        i = np.arange(segments)
        most = np.where(i < half, i, edits - i)
        moved = np.repeat(i, 2 * most + 1)
        moves = np.concatenate([np.arange(-m, m + 1) for m in most])
        for some, segment, move, keys, of in ((own, i, 0, index, index_of), (looks, moved, moves, probe, probe_of)):
            n = sizes[some][:, None]
            at = place(segment, n) + move
            fits = (at >= 0) & (at + length <= n)
            if keys is probe:
                fits &= (n > high) | (moves != 0)  # other lines' segments at their own place are their index entries
            fits = np.flatnonzero(fits)
            row = fits // len(segment)
            at = first[some][row] + at.ravel()[fits]
            keys.append(_mixed((sums[at + length] - sums[at]) * down[at], np.array([(1 << 32) + low]), segment[fits - row * len(segment)]))
            of.append(number[some][row])
    return tuple(map(np.concatenate, (index, index_of, probe, probe_of)))


_WORDS = re.compile("[{0}]|[^ {0}]+".format("".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)))


@functools.lru_cache(1024)
def _words(line: str) -> tuple[list[str], Counter]:
    words = _WORDS.findall(line)
    return words, Counter(words)


def near(a: str, b: str, edits: int, word_chars: int) -> bool:
    """Whether two lines are within `edits` edits or, if long enough, within the edits of words that their length allows."""
    if a == b:
        return True
    close, long = abs(len(a) - len(b)) <= edits, min(len(a), len(b)) >= word_chars
    if not close and not long:
        return False
    (words, count), (others, other) = _words(a), _words(b)
    most = word_edits(min(len(words), len(others))) if long else 0
    # An edit of a word leaves all other words; one of a letter touches three words at most, where a letter alone is one.
    room = max(most, 3 * edits if close else 0)
    if abs(len(words) - len(others)) > room:
        return False
    least = max(len(words), len(others)) - sum([n if n < (m := other[w]) else m for w, n in count.items() if w in other])
    if close and least <= 3 * edits and within(a, b, edits):
        return True
    if not most or least > most:
        return False
    words, others = _middles(words, others)
    return max(len(words), len(others)) <= most or apart(words, others) <= most


def apart(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists, bit-parallel (Myers 1999, Hyyro 2003)."""
    if not a or not b:
        return max(len(a), len(b))
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d = full, 0, len(a)
    for c in b:
        equal = masks.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        more, less = down | ~(across | up) & full, up & across
        d += bool(more & last) - bool(less & last)
        more, less = more << 1 & full | 1, less << 1 & full
        up, down = less | ~(across | more) & full, more & across
    return d


def within(a: str, b: str, edits: int) -> bool:
    """Whether two lines are within `edits` edits: banded bit-parallel distance on what differs between their ends."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    a, b = _middles(a, b)
    return banded(a, b, edits) if a and b else max(len(a), len(b)) <= edits


def _middles(a, b):
    """a and b without what they share at the start and then at the end."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle :] == b[len(b) - middle :] else (low, middle - 1)
    return a[: len(a) - low], b[: len(b) - low]


def banded(a: str, b: str, edits: int) -> bool:
    """Edit distance of a and b is at most `edits`: states e hold, as bits, the diagonals of the band and how far each reaches.

    Bit d of row e says that the text so far ends on diagonal d - edits with at most e errors (Wu and Manber's rows, of
    2 * edits + 1 bits each).
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    # rows[e]: bit d set if a's prefix of length j + d - edits is within e of b's prefix of length j.
    rows = [((1 << (e + 1)) - 1) << edits & full for e in range(edits + 1)]
    for j, c in enumerate(b):
        shift = j - edits
        equal = (masks.get(c, 0) >> shift if shift >= 0 else masks.get(c, 0) << -shift) & full
        # Prefixes of negative length don't exist.
        valid = full if j + 1 >= edits else full & ~((1 << (edits - j - 1)) - 1)
        before, now = 0, []
        for e, row in enumerate(rows):
            new = row & equal
            if e:
                new |= rows[e - 1] | rows[e - 1] >> 1 | before << 1
            new &= full & valid
            now.append(new)
            before = new
        rows = now
        if not rows[-1]:
            return False
    d = len(a) - len(b) + edits
    return 0 <= d < width and bool(rows[-1] >> d & 1)


def _keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows by their id and a hash of id and text: what tells rows apart. Rows alike in both are one document."""
    return narrow(df, id=doc_id, text=text).withColumn("k", F.xxhash64("id", "text"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, k, line_no (from 0), h, h2 of every line of min_chars or more characters in its normal form."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, number, lines = [], [], []
        for i, x in enumerate(batch.column("text").to_pylist()):
            for n, line in enumerate([] if x is None else x.split("\n")):
                if len(line) >= min_chars and len(line := normal(line)) >= min_chars:
                    row.append(i)
                    number.append(n)
                    lines.append(line)
        row = pa.array(row, pa.int64())
        hashes = line_hashes(lines).view(np.int64)
        return batch_of(["id", "k", "line_no", "h", "h2"], [batch.column("id").take(row), batch.column("k").take(row), pa.array(number, pa.int32()), hashes[:, 0].copy(), hashes[:, 1].copy()])

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, k long, line_no int, h long, h2 long")


def _keys(lines: list[str], edits: int, min_chars: int, word_chars: int) -> tuple[np.ndarray, ...]:
    return tuple(map(np.concatenate, zip(keys_of(lines, edits, min_chars), word_keys(lines, word_chars))))


def _candidates(docs: DataFrame, edits: int, min_chars: int, word_chars: int) -> DataFrame:
    """a, b: links between hashes of lines that meet at a segment, all to the least of those that do.

    Keys travel packed, a blob for each of `parts` parts of the key space and flush, and each part is matched by sorting.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[list[np.ndarray]] = [[], [], [], []]
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            out = []
            for keys, ids in ((held[0], held[1]), (held[2], held[3])):
                key, own = np.concatenate(keys), np.concatenate(ids)
                out.append(packed_by_part((key % np.uint64(parts)).astype(np.int64), parts, key, own))
            for x in held:
                x.clear()
            return batch_of(["part", "indexed", "probes"], [pa.array(range(parts), pa.int32()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())])

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                lines = []
                for x in texts_of(whole.slice(start, 256).column("text")):
                    for line in x.split("\n"):
                        if len(line) >= min_chars and len(line := normal(line)) >= min_chars:
                            if (h := hash(line)) not in seen:
                                seen.add(h)
                                lines.append(line)
                if len(seen) > 200_000:
                    seen.clear()
                for a, b in in_portions([len(x) for x in lines], PORTION):
                    own = line_hashes(lines[a:b])[:, 0]
                    index, index_of, probe, probe_of = _keys(lines[a:b], edits, min_chars, word_chars)
                    for place, x in zip(held, (index, own[index_of], probe, own[probe_of])):
                        place.append(x)
                    size += len(index) + len(probe)
                if size > FLUSH:
                    size = 0
                    yield flush()
        if held[0]:
            yield flush()
        seen.clear()
        trim()

    def match(table: pa.Table) -> pa.Table:
        index, probe = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.uint64).reshape(-1, 2) for c in ("indexed", "probes"))
        # A link for each entry to the least line that has its key, not one for each pair, as frequent segments have many.
        keys, place = np.unique(index[:, 0], return_inverse=True)
        at = np.minimum(np.searchsorted(keys, probe[:, 0]), max(0, len(keys) - 1))
        met = probe[keys[at] == probe[:, 0]] if len(keys) else probe[:0]
        at = at[keys[at] == probe[:, 0]] if len(keys) else at[:0]
        least = np.full(len(keys), np.uint64(2**64 - 1))
        np.minimum.at(least, place, index[:, 1])
        np.minimum.at(least, at, met[:, 1])
        a, b = np.concatenate((index[:, 1], met[:, 1])), np.concatenate((least[place], least[at]))
        found = np.unique(np.stack((a[a != b], b[a != b]), axis=1), axis=0)
        return pa.table({"a": found[:, 0].copy().view(np.int64), "b": found[:, 1].copy().view(np.int64)})

    packed = docs.select("text").mapInArrow(emit, "part int, indexed binary, probes binary")
    return packed.groupBy("part").applyInArrow(match, "a long, b long").distinct()


def _pairs(lines: list[str], group: np.ndarray, edits: int, min_chars: int, word_chars: int) -> Iterator[tuple[int, int]]:
    """Numbers of lines of a group that share a segment where the join looks for it, each pair once, a few at a time."""
    index, index_of, probe, probe_of = _keys(lines, edits, min_chars, word_chars)
    index, probe = _mixed(index, group[index_of], 0), _mixed(probe, group[probe_of], 0)
    probe, probe_of = np.concatenate((index, probe)), np.concatenate((index_of, probe_of))
    order = np.argsort(index, kind="stable")
    index, index_of = index[order], index_of[order]
    low, high = (np.searchsorted(index, probe, side) for side in ("left", "right"))
    some = np.flatnonzero(high > low)
    probe_of, low, counts = probe_of[some], low[some], (high - low)[some]
    order = np.argsort(probe_of, kind="stable")
    probe_of, low, counts = probe_of[order], low[order], counts[order]
    # A line's probes stay together, so that a pair comes up in one portion.
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(probe_of)), bool), probe_of[1:] != probe_of[:-1])))
    each = np.add.reduceat(counts, first).tolist() if len(first) else []
    first = [*first.tolist(), len(probe_of)]
    for a, b in in_portions(each, PORTION):
        x, y = first[a], first[b]
        own = np.repeat(probe_of[x:y], counts[x:y])
        step = np.arange(len(own)) - np.repeat(np.cumsum(counts[x:y]) - counts[x:y], counts[x:y])
        other = index_of[np.repeat(low[x:y], counts[x:y]) + step]
        met = own != other
        found = np.unique(own[met].astype(np.int64) << 32 | other[met])
        yield from zip((found >> 32).tolist(), (found & 0xFFFFFFFF).tolist())


def _verify(edits: int, min_chars: int, word_chars: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("h", "ascending")])
        component, h, side = (table.column(c).to_numpy() for c in ("component", "h", "side"))
        # Of two tiles' lines, those of one are compared with the other's.
        across = bool(len(table)) and table.column("i")[0] != table.column("j")[0]
        lines = [normal(x) for x in table.column("line").to_pylist()]
        root = list(range(len(lines)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = np.flatnonzero(np.concatenate(([True], component[1:] != component[:-1], [True])))
        sizes, more = np.diff(edges), []
        for low, n in zip(edges.tolist(), sizes.tolist()):
            if n == 2 and near(lines[low], lines[low + 1], edits, word_chars):
                root[low + 1] = low
            elif n > 2:
                more.append((low, low + n))
        # Keys of many small components are made at once.
        for start, stop in in_portions([sum(map(len, lines[low:high])) for low, high in more], PORTION):
            own = [x for low, high in more[start:stop] for x in range(low, high)]
            group = np.repeat(np.arange(start, stop), [high - low for low, high in more[start:stop]])
            apart = set()
            for x, y in _pairs([lines[x] for x in own], group, edits, min_chars, word_chars):
                # Lines that others link already need no comparing.
                x, y = own[x], own[y]
                if across and side[x] == side[y]:
                    continue
                if (a := find(x)) != (b := find(y)) and (y, x) not in apart:
                    if near(lines[x], lines[y], edits, word_chars):
                        root[max(a, b)] = min(a, b)
                    elif len(apart) < 100_000:  # what is found apart once needn't be compared again
                        apart.add((x, y))
        tops = np.array([find(x) for x in range(len(lines))], dtype=np.int64)
        linked = tops != np.arange(len(lines))
        _words.cache_clear()
        return pa.table({"a": h[linked], "b": h[tops[linked]]})

    return run


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", edits: int = EDITS, min_chars: int = MIN_CHARS, word_chars: int = WORD_CHARS, exact_chars: int = MIN_CHARS, tile: int = TILE) -> DataFrame:
    """The rows that hold lines of classes of two or more: id, k, dropped (numbers, in order, of such lines but the first of each class).

    Lines equal in normal form, or near(), or linked by such lines, are a class; its first line is so
    by id (nulls first), hash of the row and number. Lines under
    min_chars characters are in a class with equal ones only, those under exact_chars in none (1: all but blank ones are).
    """
    docs = _keyed(df, text, doc_id)
    # What the keys shuffle is gone before lines are stored.
    met = components(_candidates(docs, edits, min_chars, word_chars))
    lines = cut(_lines(docs, min(min_chars, exact_chars)))
    # Most lines occur once and meet no other; what follows is about the rest.
    often = lines.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    some = cut(lines.join(often.unionByName(met.select(F.col("id").alias("h"))).distinct(), "h", "left_semi"))
    drop(lines)
    distinct = cut(some.groupBy("h", "h2").agg(F.min(F.struct("id", "k", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")))
    sizes = met.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    where = distinct.join(met.withColumnRenamed("id", "h"), "h").join(sizes, "component").select("h", "component", "tiles", F.col("first.id").alias("i_"), F.col("first.k").alias("k_"), F.col("first.line_no").alias("n_"))
    held = docs.join(where, F.col("i_").eqNullSafe(F.col("id")) & (F.col("k_") == F.col("k"))).select("component", "tiles", "h", F.element_at(F.split("text", "\n"), F.col("n_") + 1).alias("line"))
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.withColumn("own", F.pmod("h", "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "component", "h", "line", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.when(F.col("tiles") == 1, F.pmod("component", F.lit(parts))).otherwise(F.col("component")).alias("part"), (F.col("tiles") > 1).alias("large"),
    ).dropDuplicates(["h", "i", "j"])
    linked = components(dealt.groupBy("large", "part", "i", "j").applyInArrow(_verify(edits, min_chars, word_chars), "a long, b long")).withColumnRenamed("id", "h")
    inside = distinct.join(linked, "h")
    firsts = inside.groupBy("component").agg(F.min("first").alias("f"))
    near = inside.drop("first").join(firsts, "component").select("h", "h2", F.col("f").alias("first"))
    alone = distinct.where("n > 1").join(linked.select("h"), "h", "left_anti").select("h", "h2", "first")
    marked = some.join(near.unionByName(alone), ["h", "h2"]).select("id", "k", "line_no", (F.struct("id", "k", "line_no") == F.col("first")).alias("is_first"))
    out = cut(marked.where(~F.coalesce("is_first", F.lit(False))).groupBy("id", "k").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")))
    drop(some, distinct)
    return out


def repeated(df: DataFrame, text: str = "text", doc_id: str = "doc_id", edits: int = EDITS, min_chars: int = MIN_CHARS, word_chars: int = WORD_CHARS, exact_chars: int = MIN_CHARS, tile: int = TILE) -> DataFrame:
    """One row for each row of df: doc_id, n_lines, n_dropped, dropped (numbers from 0 of the lines to drop, in order).

    A line goes if it isn't the first of its class (see classes()). Null and empty texts drop nothing (a null text has no
    lines, an empty one a single line); texts and lines of any length are read whole; an empty table gives no rows, and other
    columns are not looked at. Rows alike in id and text are one document and keep the same lines.
    """
    drops = classes(df, text, doc_id, edits, min_chars, word_chars, exact_chars, tile)
    rows = _keyed(df, text, doc_id).select("id", "k", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    return (
        rows.join(drops.select(F.col("id").alias("i"), F.col("k").alias("kk"), "dropped"), F.col("i").eqNullSafe(F.col("id")) & (F.col("kk") == F.col("k")), "left")
        .select(F.col("id").alias("doc_id"), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    )


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", edits: int = EDITS, min_chars: int = MIN_CHARS, word_chars: int = WORD_CHARS, exact_chars: int = MIN_CHARS) -> DataFrame:
    """df with each repeated line taken out of its text (see repeated()), other columns, of whatever names, as they are.

    A row goes if nothing but white space is left of a text that lost lines.
    """
    drops = classes(df, text, doc_id, edits, min_chars, word_chars, exact_chars)
    # The caller's columns travel inside one, so that no name of theirs meets one of ours.
    own, body = F.col(f"row.`{doc_id}`"), F.col(f"row.`{text}`")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    joined = rows.join(drops, own.eqNullSafe(F.col("id")) & (F.xxhash64(own, body) == F.col("k")), "left")
    left = F.array_join(F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    joined = joined.withColumn("left", F.when(F.col("dropped").isNull(), body).otherwise(left)).where(F.col("dropped").isNull() | F.col("left").rlike(r"\S"))
    return joined.select(*[F.col("left").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
