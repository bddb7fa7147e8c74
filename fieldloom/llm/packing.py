"""Packing of documents into sequences of one length, by non-negative least squares over a histogram of lengths.

Each document is its ids and an end id. Whole windows are sequences of their own; what is left of a document is a piece below the
window. Combinations of one, two or three lengths that fill the window exactly are enumerated, and how often each is used is solved
against the histogram of pieces (an active-set method; both depend on the window alone, not on the data's size). The counts are
rounded and held to what there is. What remains is packed greedily: combinations of more lengths, each filled from the longest
length down and used as often as it can be; then the rest, longest first, one after the other, cut where a window is full. What the
last window doesn't fill is cut into powers of two, which need no padding.

Only the histogram reaches the driver, and only the plan goes out: at most three rows for each combination used. A piece finds its
place by its length and its rank among the pieces of that length. Tasks count ranks as they write pieces; sums over tasks give
each its base. So no length, however common, meets in one task, and a piece's rank stays the same when a task is repeated.

Null and empty texts are their end id alone. Rows are taken one by one, so null and repeated ids are no matter; equal lengths are
taken in order of tasks. An empty table gives no rows. Other columns pass through, but for those named like a result, which are
replaced.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import byte_symbols
from .chunks import Chunks, expand
from .common import batches_of, stored

RESULTS = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
#: Rounds of the active set, and the combinations that one round adds.
ROUNDS, ADDED = 32, 32
#: Rows of a batch of texts, whose bytes are bounded as well: a batch looks each of its distinct words up once.
ROWS = 4_096
#: Bits of a rank in the key of a place.
RANK = 45


#: A pattern by which tokenizer files of this kind cut lower-cased text, and what it says of ASCII without white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
#: Characters of Latin, Greek and Cyrillic words whose lower case is one character that doesn't depend on its neighbours.
EASY = r" -~\xa0-\u012f\u0131-\u02ff\u0370-\u03a2\u03a4-\u0482\u048a-\u052f"


class Words:
    """Ids of words by a tokenizer. If the file lower-cases and cuts by `PIECES`, words of `EASY` characters are cut so here, and the
    library's merges alone encode the pieces; words that may hold a special token, and all others, go through it as they are."""

    def __init__(self, tokenizer, remembered: int = 300_000):
        self.tokenizer, self.remembered = tokenizer, remembered
        spec = json.loads(tokenizer.to_str())
        lower = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.plain = lower == ["NFC", "Replace", "Lowercase"] and cut.get("type") == "Split" and cut["invert"] and cut["pattern"].get("Regex") == PIECES
        self.ascii, self.all = re.compile(ASCII_PIECES).findall, regex.compile(PIECES).findall
        marks = {re.escape(t.content[0]) for t in tokenizer.get_added_tokens_decoder().values()}
        self.plain = self.plain and not any(m.isalpha() for m in marks)
        self.odd = re.compile("|".join([f"[^{EASY}]", *sorted(marks)])).search
        self.symbols = {b: ord(c) for c, b in byte_symbols().items()}
        self.known: dict[str, list[int]] = {}

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, words: list[str]) -> list[list[int]]:
        if not self.plain:
            return self.encode(words)
        known, merge, odd, symbols = self.known, self.tokenizer.model.tokenize, self.odd, self.symbols
        if len(known) > self.remembered:
            known.clear()
        out: list = [None] * len(words)
        whole = []
        for k, w in enumerate(words):
            simple = w.isascii()
            if simple and w.isalpha():  # one piece, and no special token
                p = w.lower()
                if (ids := known.get(p)) is None:
                    ids = known[p] = [t.id for t in merge(p)]
                out[k] = ids
                continue
            if odd(w) or not (simple or is_normalized("NFC", w)):
                whole.append(k)
                continue
            found = []
            for p in self.ascii(w.lower()) if simple else self.all(w.lower()):
                if (ids := known.get(p)) is None:
                    ids = known[p] = [t.id for t in merge(p if simple or p.isascii() else p.encode().decode("latin-1").translate(symbols))]
                found.append(ids)
            out[k] = found[0] if len(found) == 1 else [*chain.from_iterable(found)]
        for k, ids in zip(whole, self.encode([words[k] for k in whole]), strict=True):
            out[k] = ids
        return out


@lru_cache(maxsize=2)
def known_words(file: str) -> tuple[Chunks, type]:
    """The words that a worker process has met, kept for its later tasks, and the type of the file's ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file)
    return Chunks(Words(tokenizer)), np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, longest first and 0 for none, that fill the window: all of one, two and three that are present."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    out = [np.array([[window, 0, 0]])] if has[window] else []
    for a in np.flatnonzero(has[:window])[::-1]:
        b = np.arange(max((window - a + 1) // 2, 1), min(a, window - a) + 1)
        b = b[has[b]]
        c = window - a - b
        ok = (c == 0) | (has[c] & (c > 0))
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def repeats(combos: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and how often each is used, x >= 0, so that |A x - counts| is least; A has how often each length stands in each.
    An active set: those with the steepest gradient and no length in common join together; those that come out negative leave."""
    padded = np.append(counts.astype(float), 0.0)
    padded[0] = 0.0  # no length
    held, x, rest = np.zeros(0, np.int64), np.zeros(0), padded.copy()
    norm = np.sqrt((combos > 0).sum(axis=1) + 2 * (combos[:, 0] == combos[:, 1]) + 2 * ((combos[:, 1] == combos[:, 2]) & (combos[:, 1] > 0)))

    def columns(which: np.ndarray) -> np.ndarray:
        a = np.zeros((len(padded), len(which)))
        for k in range(3):
            np.add.at(a, (combos[which, k], np.arange(len(which))), 1.0)
        a[0] = 0.0
        return a

    for _ in range(ROUNDS):
        gradient = rest[combos].sum(axis=1) / norm
        gradient[held] = 0.0
        top = np.argsort(-gradient, kind="stable")[: 64 * ADDED]
        picked, seen = [], set()
        for c in top:
            if gradient[c] <= 1e-6 or len(picked) == ADDED:
                break
            own = set(combos[c].tolist()) - {0}
            if not own & seen:
                picked.append(c)
                seen |= own
        if not picked:
            break
        held, x = np.append(held, picked), np.append(x, np.zeros(len(picked)))
        while len(held):
            a = columns(held)
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(held)), a.T @ padded)
            low = z <= 0
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            keep = ~(low & (x <= 1e-9))
            held, x = held[keep], np.maximum(x[keep], 0.0)
        rest = padded - columns(held) @ x if len(held) else padded
        rest[0] = 0.0
    return held, x


def greedy(counts: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Combinations of any number of lengths that fill the window exactly, and how often; from the longest length down. counts is
    reduced by what they take. Each step uses up a length or gives one up, so there are few, whatever the counts."""
    out, lengths = [], [int(k) for k in np.flatnonzero(counts) if k]
    open_ = lengths.copy()
    while open_:
        take: dict[int, int] = {}
        left = window
        most = open_[-1]
        while left and (at := bisect_right(lengths, min(most, left))):
            k = lengths[at - 1]
            n = min(int(counts[k]), left // k)
            take[k] = n
            left -= n * k
            most = k - 1
        if left:
            open_.pop()
            continue
        times = min(int(counts[k]) // n for k, n in take.items())
        out.append(([k for k, n in take.items() for _ in range(n)], times))
        for k, n in take.items():
            counts[k] -= n * times
            if not counts[k]:
                lengths.remove(k)
                if k in open_:
                    open_.remove(k)
    return out


@dataclass
class Plan:
    """Where the r-th piece of each length goes. keys: length << RANK | first rank, in order; and there its first sequence and the
    offset. Ranks from used on are laid one after the other from `before` on, counted from sequence `base`."""

    window: int
    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    before: np.ndarray
    base: int
    starts: np.ndarray  # of the sequences behind the last whole window, and the end

    def whole(self) -> int:
        return int(self.starts[0]) // self.window

    def start_of(self, s: np.ndarray) -> np.ndarray:
        n = self.whole()
        return np.where(s < n, s * self.window, self.starts[np.clip(s - n, 0, len(self.starts) - 1)])

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, start in it, length, sequence, offset) of each part."""
        first = rank < self.used[length]
        lone = np.flatnonzero(first)
        slot = np.searchsorted(self.keys, (length[lone] << RANK) | rank[lone], "right") - 1
        sequence = self.sequence[slot] + rank[lone] - (self.keys[slot] & ((1 << RANK) - 1)) if len(lone) else lone
        rest = np.flatnonzero(~first)
        t = self.before[length[rest]] + (rank[rest] - self.used[length[rest]]) * length[rest]
        end = t + length[rest]
        n = self.whole()
        of = lambda at: np.where(at < self.starts[0], at // self.window, n + np.searchsorted(self.starts, at, "right") - 1)
        lo = of(t)
        parts = of(end - 1) - lo + 1
        s = expand(lo, parts)
        here = np.repeat(np.arange(len(rest)), parts)
        a, b = np.maximum(t[here], self.start_of(s)), np.minimum(end[here], self.start_of(s + 1))
        piece = np.concatenate([lone, rest[here]])
        order = np.argsort(piece, kind="stable")
        join = lambda x, y: np.concatenate([x, y])[order].astype(np.int64)
        return piece[order], join(np.zeros(len(lone)), a - t[here]), join(length[lone], b - a), join(sequence, self.base + s), join(self.offset[slot] if len(lone) else lone, a - self.start_of(s))


def plan(counts: np.ndarray, window: int) -> Plan:
    """counts: pieces of each length, 0 to window."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(np.flatnonzero(left), window)
    held, x = repeats(combos, left) if len(combos) else (np.zeros(0, np.int64), np.zeros(0))
    used: list[tuple[list[int], int]] = []
    for c in np.argsort(-x, kind="stable"):
        lengths = [int(k) for k in combos[held[c]] if k]
        times = min(int(np.rint(x[c])), *(int(left[k]) // lengths.count(k) for k in lengths), int(left[lengths[0]]))
        if times > 0:
            used.append((lengths, times))
            for k in lengths:
                left[k] -= times
    used += greedy(left, window)
    taken = np.zeros(window + 1, np.int64)
    rows, base = [], 0
    for lengths, times in used:
        at = 0
        for k in lengths:
            rows.append(((k << RANK) | int(taken[k]), base, at))
            taken[k] += times
            at += k
        base += times
    rows.sort()
    keys, sequence, offset = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    each = left * np.arange(window + 1)
    before = np.concatenate(([0], np.cumsum(each[::-1])))[:-1][::-1]  # longest first
    total, starts = int(each.sum()), [int(each.sum()) // window * window]
    for b in range(window.bit_length(), -1, -1):
        if (total - starts[0]) >> b & 1:
            starts.append(starts[-1] + (1 << b))
    return Plan(window, keys, sequence, offset, taken, np.ascontiguousarray(before), base, np.array(starts, np.int64))


def pack(df: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, text_col: str = "text") -> DataFrame:
    """df's columns besides the text, and `RESULTS` of each piece: the document's ids before it, how many it has, the ids (binary,
    little-endian unsigned 32-bit), the document's ids in all, its sequence and the place there. The file is one of the tokenizers
    library whose ids never depend on what stands behind ASCII white space."""
    spark = df.sparkSession
    others = [f for f in df.schema.fields if f.name not in (text_col, *RESULTS)]
    keys = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)]
    file = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks, wide = known_words(file.value)
        if end_id >= 1 << 16:
            wide = np.uint32
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            ((found, n),) = chunks(batch.column("words"))
            total = n + 1
            ids = np.full(int(total.sum()), end_id, wide)
            ids[expand(np.cumsum(total) - total, n)] = found
            parts = -(-total // window)
            doc = np.repeat(np.arange(len(n)), parts)
            start = expand(np.zeros(len(n), np.int64), parts) * window
            length = np.minimum(total[doc] - start, window)
            # the rank of each piece among those of its length in this task
            order = np.argsort(length, kind="stable")
            inside = np.empty(len(length), np.int64)
            inside[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order])
            nth = seen[length] + inside
            seen += np.bincount(length, minlength=window + 1)
            ends = np.concatenate(([0], np.cumsum(length))) * ids.itemsize
            binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            take = pa.array(doc)
            out = [batch.column(k.name).take(take) for k in keys] + [pa.array(np.full(len(length), part), pa.int32()), pa.array(total[doc], pa.int64()), pa.array(start), pa.array(length.astype(np.int32)), pa.array(nth), binary]
            rows = pa.RecordBatch.from_arrays(out, [k.name for k in keys] + ["part", "total", "start", "length", "nth", "ids"])
            for lo in range(0, rows.num_rows, 1024):
                yield rows.slice(lo, 1024)

    kinds = (("part", T.IntegerType()), ("total", T.LongType()), ("start", T.LongType()), ("length", T.IntegerType()), ("nth", T.LongType()), ("ids", T.BinaryType()))
    words = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[ \t\n\x0B\f\r]+")
    cells = df.select(*(F.col(f"`{f.name}`").alias(k.name) for f, k in zip(others, keys, strict=True)), words.alias("words"))
    with batches_of(spark, ROWS):
        pieces = stored(cells.mapInArrow(cut, T.StructType([*keys, *(T.StructField(n, k) for n, k in kinds)])))

    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each task
    bases = stored(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = np.zeros(window + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length up to the window
        counts[r["length"]] = r["n"]
    sent = spark.sparkContext.broadcast(plan(counts, window))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy().astype(np.int64)
            piece, start, n, sequence, offset = where.place(length, batch.column("rank").to_numpy())
            raw = batch.column("ids").to_pylist()
            wide = np.uint16 if len(raw[0]) == 2 * length[0] else np.uint32
            ids = np.frombuffer(b"".join(raw), wide).astype("<u4")  # parts come in the pieces' order, so their ids do
            ends = np.concatenate(([0], np.cumsum(n))) * 4
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            take = pa.array(piece)
            out = [batch.column(k.name).take(take) for k in keys] + [pa.array(batch.column("start").to_numpy()[piece] + start), pa.array(n), binary, batch.column("total").take(take), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, [k.name for k in keys] + list(RESULTS))

    result = T.StructType([*keys, *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in RESULTS)])
    ranked = pieces.join(bases.select("length", "part", "base"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "base", "nth")
    return ranked.mapInArrow(placed, result).select(*(F.col(k.name).alias(f.name) for f, k in zip(others, keys, strict=True)), *RESULTS)
