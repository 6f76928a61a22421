"""BPE encoding and decoding with a memory-mapped transducer lexicon of the corpus's frequent words."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import transducer
from .common import Memo, arrow_map, batch_of, cut, forget, in_portions, kept, narrow, texts_of

# Fixed values of the tokenizer's format: the white space that its normaliser folds, and the pieces it splits text into.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
WORDS = re.compile(f"[^{SPACE}]+")
#: str.split() takes these for white space; the tokenizer doesn't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

#: Words in the lexicon, distinct words and pieces of words remembered by a worker, distinct words a task counts before it passes them on.
LEXICON_WORDS, MEMO_WORDS, MEMO_PIECES, COUNT_WORDS = 65_536, 350_000, 150_000, 200_000
NEVER = 1 << 62
#: Longer pieces are merged one by one; characters of the texts, and pieces of one length, that are handled at a time.
SHORT, PORTION, ROWS = 48, 1 << 21, 8_192


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merges:
    """The tokenizer file's vocabulary and merges: exact ids of one piece."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.first = [self.vocab[c] for c in letters]
        self.end = [self.vocab[c + self.suffix] for c in letters]
        #: For a pair of ids, rank << 32 | new id: the least is the merge that comes first.
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), rank << 32 | self.vocab[a + b])

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def encode(self, piece: bytes) -> list[int]:
        """Merges the lowest rank first, among equals the leftmost; n log n for long pieces."""
        ids = [self.first[b] for b in piece[:-1]] + [self.end[piece[-1]]]
        if len(ids) > SHORT:
            return self._encode_long(ids)
        get = self.pairs.get
        ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece, as encode() gives them: those of one length merge side by side, one merge a round."""
        out = [b""] * len(pieces)
        same: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            same.setdefault(len(piece), []).append(n)
        for length, numbers in same.items():
            if not 0 < length <= SHORT:
                for n in numbers:
                    out[n] = pack_ids(self.encode(pieces[n])) if length else b""
                continue
            for start in range(0, len(numbers), ROWS):
                self._encode_rows(pieces, numbers[start : start + ROWS], length, out)
        return out

    def _encode_rows(self, pieces: list[bytes], numbers: list[int], length: int, out: list[bytes]) -> None:
        if not hasattr(self, "_table"):
            keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
            order = np.argsort(keys)
            self._table = keys[order], np.array([*self.pairs.values()], np.int64)[order], np.array(self.first, np.int64), np.array(self.end, np.int64)
        keys, values, first, end = self._table

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << 32 | b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, values[at], NEVER)

        letters = np.frombuffer(b"".join([pieces[n] for n in numbers]), np.uint8).reshape(-1, length)
        row, ids = np.array(numbers), first[letters]
        ids[:, -1] = end[letters[:, -1]]
        ranks = look(ids[:, :-1], ids[:, 1:]) if len(keys) else np.full((len(ids), length - 1), NEVER)
        while len(row):
            each = np.arange(len(row))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[each, at] if ranks.shape[1] else np.full(len(row), NEVER)
            if (over := best == NEVER).any():
                done, width = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, n in enumerate(row[over].tolist()):
                    out[n] = done[k * width : (k + 1) * width]
                some = ~over
                row, ids, ranks, at, best, each = row[some], ids[some], ranks[some], at[some], best[some], each[: np.count_nonzero(some)]
                if not len(row):
                    return
            places = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, places + (places > at[:, None]), axis=1)
            ids[each, at] = best & 0xFFFFFFFF
            ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= at[:, None]), axis=1)
            for some, left in ((np.flatnonzero(at > 0), at - 1), (np.flatnonzero(at < ids.shape[1] - 1), at)):
                ranks[some, left[some]] = look(ids[some, left[some]], ids[some, left[some] + 1])

    def _encode_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [(found, i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if (found := pairs.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = best & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := pairs.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (found, a, (ids[a], ids[b])))
        return [x for x in ids if x >= 0]


def pieces_of(word: str) -> list[str]:
    """The pieces of a word without white space, normalised: composed, lower case letter by letter."""
    # Letters alone, or with one sign at the end, need no expression.
    if word.isascii():
        if word.isalpha():
            return [word.lower()]
        if word[:-1].isalpha() and not word[-1].isdigit():
            return [word[:-1].lower(), word[-1]]
    elif word.isalpha() and unicodedata.is_normalized("NFC", word) and "Σ" not in word and (low := word.lower()).isalpha():
        return [low]
    # The normaliser lower-cases letters one by one; str.lower() knows a final sigma.
    return PIECES.findall(unicodedata.normalize("NFC", word).replace("Σ", "σ").lower())


def words_of(text: str) -> list[str]:
    return WORDS.findall(text) if any(c in text for c in SEPARATORS) else text.split()


def frequent_words(df: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces of all texts, `most` at most (a bound on the lexicon; other words are merged exactly).

    Each task sums before anything is dealt out. A word that a task meets once in COUNT_WORDS distinct words is not
    passed on: it isn't frequent, and a word missing here costs time, not correctness.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            pieces: Counter = Counter()
            for word, n in seen.items():
                if n > 1:
                    for piece in pieces_of(word):
                        pieces[piece] += n
            seen.clear()
            return batch_of(["piece", "n"], [pa.array([*pieces], pa.string()), pa.array([*pieces.values()], pa.int64())])

        for batch in batches:
            for value in batch.column(0):
                if (x := value.as_py()) is not None:
                    seen.update(words_of(x))
                    if len(seen) > COUNT_WORDS:
                        yield flush()
        yield flush()

    counted = cut(narrow(df, text=text).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    # Counts are graded first, so that no more than `most` pieces come to the driver, from however many tasks.
    grade = F.floor(F.log2("n") * 16)
    least, room = None, most
    for r in sorted(counted.groupBy(grade.alias("grade")).count().collect(), reverse=True):
        if (room := room - r["count"]) < 0:
            break
        least = r.grade
    return [] if least is None else sorted(r.piece for r in counted.where(grade >= least).select("piece").collect())


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers, which is also this machine's order."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _special_split(text: str, special: re.Pattern | None) -> list[str]:
    return special.split(text) if special and "<" in text else [text]


def bpe(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Each row's ids and the text that they decode to: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    The result is that of the tokenizers library for the file `tokenizer`, without added special tokens; their strings in
    a text become their ids. Null is the empty text: no ids, empty decoding. Rows come out one for one, repeated and null
    ids included; texts are encoded whole, of any length.
    """
    spark = df.sparkSession
    merges = Merges.load(tokenizer)
    entries = [(raw, tuple(merges.encode(raw))) for w in frequent_words(df, text, lexicon_words) if (raw := w.encode())]
    packed = transducer.build(entries)
    # The driver's file server hands the file to every executor, also to those that join later.
    name = f"lexicon-{hashlib.sha256(packed).hexdigest()[:24]}.bin"
    if not any(os.path.basename(path) == name for path in spark.sparkContext.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="kinweave-"), name)
        with open(path, "wb") as file:
            file.write(packed)
        spark.sparkContext.addFile(path)
    shared = spark.sparkContext.broadcast(merges)  # as large as the tokenizer file

    def encoder():
        own, lexicon = shared.value, transducer.Lexicon(SparkFiles.get(name))

        split: dict[str, list[str]] = {}
        ready: dict[str, bytes] = {}

        def one(piece: str) -> bytes:
            if (found := ready.get(piece)) is not None:
                return found
            raw = piece.encode("utf-8")
            return pack_ids(own.encode(raw)) if (found := lexicon.get(raw)) is None else found

        pieces = Memo(one, MEMO_PIECES)
        memo = Memo(lambda word: b"".join([pieces[p] for p in split.get(word) or pieces_of(word)]), MEMO_WORDS)

        def prepare(words: set[str]) -> None:
            """What words need that isn't remembered, merged together: they are looked up afterwards."""
            split.clear()
            ready.clear()
            split.update((w, pieces_of(w)) for w in words if w not in memo and w not in memo.older)
            rest, raws = [], []
            for piece in set(chain.from_iterable(split.values())):
                if piece not in pieces and piece not in pieces.older:
                    raw = piece.encode("utf-8")
                    if (found := lexicon.get(raw)) is not None:
                        ready[piece] = found
                    else:
                        rest.append(piece)
                        raws.append(raw)
            ready.update(zip(rest, own.encode_many(raws)))

        special = re.compile("(" + "|".join(map(re.escape, sorted(own.special, key=len, reverse=True))) + ")") if own.special else None
        names = [own.names.get(i, "") for i in range(max(own.names) + 1)]
        return prepare, memo, special, {k: pack_ids([v]) for k, v in own.special.items()}, names

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        prepare, memo, special, special_ids, names = kept(f"bpe {name} {tokenizer}", encoder)
        ids, decoded, texts = [], [], texts_of(batch.column("text"))
        for start, stop in in_portions([len(x) for x in texts], PORTION):
            # Every other part is a special token, which stands for itself.
            found = [[part if k % 2 else words_of(part) for k, part in enumerate(_special_split(x, special))] for x in texts[start:stop]]
            prepare(set(chain.from_iterable(words for parts in found for words in parts[::2])))
            for parts in found:
                packed = b"".join([special_ids[part] if k % 2 else b"".join([memo[w] for w in part]) for k, part in enumerate(parts)])
                ids.append(packed)
                decoded.append(" ".join([names[i] for i in memoryview(packed).cast("I").tolist()]))
        return batch_of(["doc_id", "n_tokens", "ids", "decoded"], [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())])

    kind = df.schema[doc_id].dataType.simpleString()
    return arrow_map(narrow(df, doc_id=doc_id, text=text), encode, f"doc_id {kind}, n_tokens long, ids binary, decoded string", rows=256, holds=True)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, decoded: packed ids (as bpe() returns them) to text; null ids decode to the empty text."""
    names = df.sparkSession.sparkContext.broadcast(Merges.load(tokenizer).names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = names.value
        out = [" ".join([table[i] for i in memoryview(x or b"").cast("I").tolist()]) for x in batch.column("ids").to_pylist()]
        return batch_of(["doc_id", "decoded"], [batch.column("doc_id"), pa.array(out, pa.string())])

    return arrow_map(narrow(df, doc_id=doc_id, ids=ids), run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, decoded string")
