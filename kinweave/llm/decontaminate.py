"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k is split into k+1 pieces. Wherever the item occurs with k edits at most, one piece occurs
unchanged, so exact hits of the pieces give every place to look at; Myers' bit-parallel distance decides there.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, kept, narrow, texts_of

#: Edits allowed as a share of an item's characters; items with fewer characters are in no text (1: all but empty ones are
#: looked for); characters of items in a block.
ERROR_RATE, MIN_CHARS, BLOCK_CHARS = 0.1, 1, 4_000_000
GRAM = 5


def normal(text: str) -> str:
    """Lower case, each run of white space one space, trimmed."""
    return " ".join(text.lower().split())


class Item:
    """A benchmark item: its pattern bits, budget and pieces."""

    def __init__(self, text: str, rate: float):
        self.text, self.size = text, len(text)
        self.budget = int(rate * self.size)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.grams = {text[i : i + GRAM] for i in range(self.size - GRAM + 1)}
        #: An edit touches GRAM n-grams at most, so a match keeps this many of the distinct ones.
        self.least = len(self.grams) - GRAM * self.budget

    def pieces(self) -> list[tuple[int, str]]:
        n = self.budget + 1
        edges = [i * self.size // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(edges, edges[1:])]

    def distance(self, window: str) -> int:
        """The least edit distance between the item and any part of the window (Myers 1999)."""
        size, masks = self.size, self.masks
        full, top = (1 << size) - 1, 1 << (size - 1)
        pv, mv, score, best = full, 0, size, size
        for c in window:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph = (ph << 1) & full
            pv = ((mh << 1) & full) | (full & ~(xv | ph))
            mv = ph & xv
        return best

    def may_match(self, window: str) -> bool:
        return self.least <= 0 or len(self.grams.intersection([window[i : i + GRAM] for i in range(len(window) - GRAM + 1)])) >= self.least


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[str], rate: float = ERROR_RATE):
        self.items = [Item(text, rate) for text in items]
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for offset, piece in item.pieces():
                pieces.setdefault(piece, []).append((k, offset))
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> dict[int, int]:
        """The number of each item that the normal form of a text holds, with its least distance."""
        if self.empty or not text:
            return {}
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                item = self.items[k]
                start = end + 1 - length - offset
                low, high = max(0, start - item.budget), start + item.size + item.budget
                # Hits come in the order of their ends: windows that touch become one.
                if (own := windows.setdefault(k, [])) and low <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(low, own[-1][0]), max(high, own[-1][1])
                else:
                    own.append([low, high])
        found = {}
        for k, own in windows.items():
            item, best = self.items[k], None
            for low, high in own:
                window = text[low:high]
                if len(window) >= item.size - item.budget and item.may_match(window):
                    d = item.distance(window)
                    if d <= item.budget and (best is None or d < best):
                        best = d
            if best is not None:
                found[k] = best
        return found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int, min_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about block_chars characters; blocks are what is broadcast, one at a time."""
    items = narrow(benchmark, item_id=item_id, text=text).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r.item_id, t) for r in items.where(block == k).collect() if len(t := normal(r.text)) >= max(1, min_chars)]


def _searched(rows: DataFrame, items: list[tuple], rate: float, per_text: Callable, schema) -> DataFrame:
    """rows, a batch at a time, through per_text(batch, matcher, items) with the matcher of one block of items.

    The items are broadcast; a worker makes their automaton once, not once a task.
    """
    shared, key = rows.sparkSession.sparkContext.broadcast(items), f"items {uuid.uuid4().hex}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return per_text(batch, kept(key, lambda: Matcher([t for _, t in shared.value], rate)), shared.value)

    return arrow_map(rows, run, schema, holds=True)


def matches(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, item_id, distance: every item that a text holds with int(error_rate * length) edits at most.

    Texts and items are compared in lower case with white space folded; distance is the least over all parts of the text.
    Null and empty texts hold nothing; null items, those without a character and those under min_chars are in no text, and items
    of few characters are found where they stand unchanged. Each row of df is searched
    whole, however long, and alone: repeated rows give repeated results. Items with equal texts are each reported. Empty
    tables give no rows, and other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = f"doc_id {df.schema[doc_id].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, distance int"
    rows, item_type = narrow(df, doc_id=doc_id, text=text), to_arrow_type(benchmark.schema[item_id].dataType)

    def search(batch: pa.RecordBatch, matcher: Matcher, items: list[tuple]) -> pa.RecordBatch:
        at, ids, distances = [], [], []
        for i, x in enumerate(texts_of(batch.column("text"))):
            for k, d in matcher.find(normal(x)).items():
                at.append(i)
                ids.append(items[k][0])
                distances.append(d)
        return batch_of(["doc_id", "item_id", "distance"], [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(ids, item_type), pa.array(distances, pa.int32())])

    return functools.reduce(DataFrame.unionByName, [_searched(rows, items, error_rate, search, kinds) for items in _blocks(benchmark, item_id, item_text, block_chars, min_chars)])


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """df without the rows whose text holds an item (see matches()); its columns, of whatever names, and other rows stay as they are."""
    at = df.columns.index(text)

    def search(batch: pa.RecordBatch, matcher: Matcher, items: list[tuple]) -> pa.RecordBatch:
        return batch.filter(pa.array([not matcher.find(normal(x)) for x in texts_of(batch.column(at))], pa.bool_()))

    for items in _blocks(benchmark, item_id, item_text, block_chars, min_chars):
        df = _searched(df, items, error_rate, search, df.schema)
    return df
