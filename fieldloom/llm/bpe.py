"""Byte-level BPE encoding and decoding.

The ranks of a public tokenizer file merge byte pairs, lowest rank first. `encode` cuts texts by the tokenizer's pattern
(in the JVM: Java's classes are written out where the public library's differ) and works through the documents of a
partition batch by batch. The distinct words that are no token as a whole are encoded once in a task, a batch's new ones
together: `Merges` holds them as rows of an array, and a round merges in each row the leftmost of its pairs of least rank and
looks up the two pairs beside it, so a task runs as many rounds as its longest word has merges. The documents are then put
together from their words' ids. Nothing is shuffled or collected, the pairs' ranks are broadcast, memory depends on a batch
and on `REMEMBERED` words alone, and a lost task repeats its own documents only.

Words are grouped by length, so that short rows aren't padded to long ones; words above `LONG` bytes (runs without a break,
not words of a language) are merged over a heap instead; ids are the same.

Null and empty texts have no ids. Special tokens are ordinary text. Rows are encoded one by one, so repeated rows, null
ids and ties are no matter, and an empty table stays empty. Columns besides the text pass through, whatever their names.
A vocabulary must hold all single bytes; `ranks` raises ValueError otherwise. Decoding concatenates the ids' bytes; null
ids give null, unknown ids fail.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that are put together at once, beyond the last document's, and the longest word that is merged in rows.
BLOCK, LONG = 2_000_000, 1_024
#: Words that a task remembers before it starts anew.
REMEMBERED = 1_000_000
#: The characters of the Unicode property White_Space, in Java's notation.
SPACES = r"\t-\r \x85\xa0  -     　"


def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 bytes and rank in each line."""
    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    if any(bytes([b]) not in found for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return found


def pieces(text: Column, pattern: str) -> Column:
    """A text's pieces in order. Java's \\s knows ASCII alone, so white space is written out."""
    java = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java), F.lit(0))


def merged(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of one word, with a heap over linked parts: a word may be as long as its text."""
    if word in table:
        return [table[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(table[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in table]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if not parts[i] or after[i] >= n or parts[i] + parts[after[i]] != pair:
            continue
        j = after[i]
        parts[i], parts[j], after[i] = pair, b"", after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (p := parts[a] + parts[b]) in table:
                heapq.heappush(heap, (table[p], a, p))
    return [table[p] for p in parts if p]


class Merges:
    """The ranks of all pairs of tokens that merge, sorted by pair."""

    def __init__(self, table: dict[bytes, int]):
        self.none = max(table.values()) + 1  # no token, and above every rank
        self.bytes = np.array([table[bytes([b])] for b in range(256)], np.int64)
        pairs = {table[p[:i]] * self.none + table[p[i:]]: rank for p, rank in table.items() for i in range(1, len(p)) if p[:i] in table and p[i:] in table}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], -1), np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], self.none)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, `none` without one."""
        key = np.where((left < self.none) & (right < self.none), left * self.none + right, -2)
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.values[at], self.none)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, found = np.zeros(len(words), np.int64), []
        text, ends = self.bytes[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(sizes)
        group = np.ceil(np.log2(np.maximum(sizes, 4)) * 2)
        for g in np.unique(group):
            of = np.flatnonzero(group == g)
            counts[of], ids = self._rows(text, ends[of] - sizes[of], sizes[of])
            found.append((of, ids))
        out, starts = np.zeros(counts.sum(), np.int32), np.cumsum(counts) - counts
        for of, ids in found:
            n = counts[of]
            out[np.repeat(starts[of] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return counts, out

    def _rows(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(sizes), int(sizes.max()) + 2  # a place without a token on both sides
        part = np.full((n, width), self.none)
        inside = np.arange(width - 2) < sizes[:, None]
        part[:, 1:-1][inside] = text[(starts[:, None] + np.arange(width - 2))[inside]]
        keys = np.full((n, width), self.none)
        keys[:, :-1] = self.rank(part[:, :-1], part[:, 1:])
        after, before = (np.tile(np.arange(width) + step, (n, 1)) for step in (1, -1))
        rows = np.arange(n)
        while len(rows):
            at = keys[rows].argmin(1)
            best = keys[rows, at]
            going = best < self.none
            rows, at, best = rows[going], at[going], best[going]
            gone = after[rows, at]
            to, back = after[rows, gone], before[rows, at]
            part[rows, at], part[rows, gone], keys[rows, gone] = best, self.none, self.none
            after[rows, at], before[rows, to] = to, at
            keys[rows, at], keys[rows, back] = self.rank(best, part[rows, to]), self.rank(part[rows, back], best)
        left = part < self.none
        return left.sum(1), part[left]


#: Words that are merged together, by their bytes with padding.
TOGETHER = 1 << 20


def merged_all(words: list[bytes], merges: Merges, table: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids in order) of words that are no token as a whole, or are."""
    counts, ids, lo, held = [], [], 0, 0
    for i, w in enumerate(words):
        held += min(len(w), LONG)
        if held < TOGETHER and i + 1 < len(words):
            continue
        some = words[lo : i + 1]
        whole = {k: [table[w]] if w in table else merged(w, table) for k, w in enumerate(some) if w in table or len(w) > LONG or not w}
        n, flat = merges.ids([w for k, w in enumerate(some) if k not in whole])
        if whole:
            rest = iter(np.split(flat, np.cumsum(n)[:-1]))
            each = [np.array(whole[k], np.int32) if k in whole else next(rest) for k in range(len(some))]
            n, flat = np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each)
        counts.append(n)
        ids.append(flat.astype(np.int32))
        lo, held = i + 1, 0
    return np.concatenate([np.zeros(0, np.int64), *counts]), np.concatenate([np.zeros(0, np.int32), *ids])


def encode_words(words: DataFrame, table: dict[bytes, int], word_col: str = "piece", out: str = "ids") -> DataFrame:
    """Adds the ids of each word."""
    shared = words.sparkSession.sparkContext.broadcast((table, Merges(table)))  # the vocabulary

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, merges = shared.value
        for b in batches:
            n, ids = merged_all([w if isinstance(w, bytes) else w.encode() for w in b.column(word_col).to_pylist()], merges, tokens)
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(np.append(0, np.cumsum(n)), pa.array(ids))], [*b.schema.names, out])

    return words.mapInArrow(added, T.StructType([*words.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


class _Slots(dict):
    """A piece's id, or -1 - k for the k-th distinct word of a block that is no token as a whole."""

    def __init__(self, tokens: dict[str, int]):
        self.tokens, self.words = tokens, []

    def __missing__(self, piece: str) -> int:
        slot = self.tokens.get(piece)
        if slot is None:
            self.words.append(piece)
            slot = -len(self.words)
        self[piece] = slot
        return slot


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(df: DataFrame, table: dict[bytes, int], pattern: str, text_col: str = "text", out: str = "ids", block: int = BLOCK) -> DataFrame:
    """df's columns besides the text, and array<int> of token ids, as the public library's ordinary encoding gives them."""
    others = [f for f in df.schema.fields if f.name not in (text_col, out)]
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)]
    cut = df.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)), pieces(F.col(f"`{text_col}`"), pattern).alias("pieces"))
    shared = df.sparkSession.sparkContext.broadcast((table, Merges(table)))  # the vocabulary

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, merges = shared.value
        tokens = {}
        for piece, rank in ranked.items():
            try:
                tokens[piece.decode()] = rank
            except UnicodeDecodeError:
                continue
        slots, ends, known = _Slots(tokens), np.zeros(1, np.int64), np.zeros(0, np.int32)  # ends and ids of the task's words so far

        def together(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal slots, ends, known
            if len(slots.words) > REMEMBERED:
                slots, ends, known = _Slots(tokens), ends[:1], known[:0]
            lists, told = b.column("pieces"), len(slots.words)
            flat = lists.flatten().dictionary_encode()
            slot = np.fromiter(map(slots.__getitem__, flat.dictionary.to_pylist()), np.int32, len(flat.dictionary))
            counts, ids = merged_all([w.encode() for w in slots.words[told:]], merges, ranked)
            ends, known = np.append(ends, ends[-1] + np.cumsum(counts)), np.append(known, ids)
            word = np.maximum(-1 - slot, 0)
            own = slot < 0
            n = np.where(own, np.diff(ends)[word], 1) if len(ends) > 1 else np.ones(len(slot), np.int64)
            first = np.where(own, ends[word], len(known) + np.arange(len(slot)))
            pool, at = np.append(known, slot), flat.indices.to_numpy()
            n, first = (n[at], first[at]) if len(at) else (np.zeros(0, np.int64),) * 2
            to = np.append(0, np.cumsum(n))
            done = pool[np.repeat(first - to[:-1], n) + np.arange(to[-1])]
            docs = to[np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))]
            return pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(docs, pa.array(done, pa.int32()))], [*b.schema.names[:-1], "ids"])

        for b in batches:
            run = np.cumsum(b.column("pieces").value_lengths().to_numpy(zero_copy_only=False)) // block
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                yield together(b.slice(lo, hi - lo))

    put = cut.mapInArrow(encoded, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return put.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(others)), F.col("ids").alias(out))


def decode(df: DataFrame, table: dict[bytes, int], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the binary that the ids' pieces make together. The pieces are a literal, in order of id."""
    found = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        found[rank] = piece
    literal = F.split(F.lit(",".join(p.hex() for p in found)), ",")
    digits = F.transform(ids_col, lambda i: F.element_at(literal, i + 1))
    return df.withColumn(out, F.unhex(F.array_join(digits, "")))
