"""Ids of texts through the distinct chunks of a task.

A text is cut, in the JVM, where a tokenizer never joins what stands on both sides. A task encodes each distinct chunk once and
puts the ids of whole batches together by indices. What it remembers is bounded; beyond that it starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

#: Chunks and ids that a task remembers before it starts anew, and the characters that an encoder gets in one call.
REMEMBERED, REMEMBERED_IDS, CALL = 400_000, 4_000_000, 1 << 18


def expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges first[k] .. first[k] + n[k] - 1, one after the other."""
    to = np.cumsum(n)
    return np.repeat(first - (to - n), n) + np.arange(to[-1] if len(to) else 0)


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over segments of lengths n, by prefix sums."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def calls(words: list[str]) -> Iterable[list[str]]:
    lo = size = 0
    for k, w in enumerate(words):
        size += len(w)
        if size >= CALL:
            yield words[lo : k + 1]
            lo, size = k + 1, 0
    if lo < len(words):
        yield words[lo:]


class Chunks:
    """Each encoder takes a list of chunks and gives a list of ids for each."""

    def __init__(self, *encoders: Callable[[list[str]], list[list[int]]]):
        self.encoders = encoders
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = [np.zeros(0, np.uint32) for _ in self.encoders]
        self.ends = [np.zeros(1, np.int64) for _ in self.encoders]

    def learn(self, words: list[str]) -> None:
        for k, encode in enumerate(self.encoders):
            n, found = [], []
            for part in calls(words):
                ids = encode(part)
                n.extend(map(len, ids))
                found.extend(chain.from_iterable(ids))
            self.ids[k] = np.concatenate([self.ids[k], np.array(found, np.uint32)])
            self.ends[k] = np.append(self.ends[k], self.ends[k][-1] + np.cumsum(n, dtype=np.int64))
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words)), strict=True))

    def __call__(self, lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each encoder the ids of all lists in order, and how many of them each list has."""
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        if len(self.slot) > REMEMBERED or max(map(len, self.ids)) > REMEMBERED_IDS:
            self.clear()
        if new := [w for w in words if w not in self.slot]:
            self.learn(new)
        slot = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        each = slot[flat.indices.to_numpy()] if len(flat) else slot
        chunks = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            n = np.diff(ends)[each]
            out.append((ids[expand(ends[each], n)], sums(n, chunks)))
        return out
