"""A minimal acyclic transducer from byte strings to sequences of ids, as a flat file that readers memory-map.

Words with a common beginning share states from the root, words with a common ending share states towards the end. Each
arc carries a part of the output, as near to the root as all words through it allow; a final state may add a rest.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable
from pathlib import Path

import numpy as np

MAGIC = 0x4B57_5431


class _Node:
    __slots__ = ("arcs", "final", "rest")

    def __init__(self):
        self.arcs: list[list] = []  # [label, output, target]; the last target is open while words are added
        self.final, self.rest = False, ()


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Builder:
    """Adds words in byte order, freezing what no later word can change (one state per distinct right language)."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []  # (final, rest, ((label, output, state), ...))
        self.path, self.last = [_Node()], None

    def _freeze(self, node: _Node) -> int:
        key = (node.final, node.rest, tuple((label, out, target) for label, out, target in node.arcs))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key]

    def _close(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            node = self.path.pop()
            self.path[-1].arcs[-1][2] = self._freeze(node)

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        if self.last is not None and word <= self.last:
            raise ValueError("words must come in byte order, each once")
        shared = _common(word, self.last or b"")
        self._close(shared)
        # The open path keeps only the output that the new word begins with; the rest moves down.
        for depth in range(shared):
            arc = self.path[depth].arcs[-1]
            keep = _common(arc[1], ids)
            pushed, below = arc[1][keep:], self.path[depth + 1]
            if pushed:
                arc[1] = arc[1][:keep]
                for other in below.arcs:
                    other[1] = pushed + other[1]
                if below.final:
                    below.rest = pushed + below.rest
            ids = ids[keep:]
        for label in word[shared:]:
            self.path[-1].arcs.append([label, ids, -1])
            ids = ()
            self.path.append(_Node())
        self.path[-1].final, self.path[-1].rest = True, ids
        self.last = word

    def pack(self) -> bytes:
        self._close(0)
        root = self._freeze(self.path[0])
        pool: dict[tuple, int] = {(): 0}
        flat: list[int] = []
        starts = [0]

        def place(ids: tuple) -> int:
            if ids not in pool:
                pool[ids] = len(starts)
                flat.extend(ids)
                starts.append(len(flat))
            return pool[ids]

        firsts, rests, labels, outs, targets = [0], [], [], [], []
        for final, rest, arcs in self.states:
            rests.append(place(rest) + 1 if final else 0)
            for label, out, target in arcs:
                labels.append(label)
                outs.append(place(out))
                targets.append(target)
            firsts.append(len(labels))
        # Output number n lies at starts[n-1] to starts[n] of flat; number 0 is the empty one.
        parts = [np.array(x, dtype=np.uint32) for x in (firsts, rests, outs, targets, starts, flat, labels)]
        head = np.array([MAGIC, root, *map(len, parts)], dtype=np.uint32)
        return b"".join(x.tobytes() for x in (head, *parts))


def build(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The packed transducer of (word, ids) entries, which may come in any order; words must differ."""
    builder = Builder()
    for word, ids in sorted(entries):
        builder.add(word, tuple(ids))
    return builder.pack()


class Lexicon:
    """A packed transducer, memory-mapped: tasks on a machine share its pages."""

    def __init__(self, path: str | Path):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map).cast("I")
        if view[0] != MAGIC:
            raise ValueError(f"{path} holds no transducer")
        self.root, sizes, at = view[1], view[2:9].tolist(), 9
        parts = []
        for n in sizes:
            parts.append(view[at : at + n])
            at += n
        self.firsts, self.rests, self.outs, self.targets, self.starts, self.flat, self.labels = parts

    def __len__(self) -> int:
        return len(self.rests)

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word, packed as 32-bit numbers of this machine's order, or None if it isn't in the lexicon."""
        state, ids = self.root, b""
        firsts, labels, outs, starts = self.firsts, self.labels, self.outs, self.starts
        for byte in word:
            low, end = firsts[state], firsts[state + 1]
            high = end
            while low < high:
                middle = (low + high) // 2
                if labels[middle] < byte:
                    low = middle + 1
                else:
                    high = middle
            if low == end or labels[low] != byte:
                return None
            if n := outs[low]:
                ids += self.flat[starts[n - 1] : starts[n]]
            state = self.targets[low]
        if not (rest := self.rests[state]):
            return None
        return ids + self.flat[starts[rest - 2] : starts[rest - 1]] if rest > 1 else ids
