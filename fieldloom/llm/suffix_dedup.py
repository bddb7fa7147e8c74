"""Suffix-array dedup: longest-previous-factor arrays over repeated passages.

A byte is removed if it lies in a string of `length` bytes that also starts elsewhere (keep="none"), or that started
earlier, in the order (id, position) (keep="first"; the first occurrence stays). Matches never cross documents.

`longest_factors` works on one buffer: it sorts suffixes, takes the common prefixes of neighbours, and finds for each
suffix the previous and next ones in suffix order that start earlier; the longer common prefix of the two is the longest
previous factor (reversed: the longest next factor). Whole corpora don't fit one suffix array, so only passages that can
match are sorted:

1. Winnowing picks anchors, `ANCHOR` bytes long, so that each string of `length` bytes holds one, at the same place in
   each copy. Anchors whose hash occurs once are dropped.
2. An anchor's context, all strings of `length` bytes around it, is hashed. Contexts that occur again are copies as a
   whole; one of them goes on for comparison with the others.
3. Distinct contexts of one anchor lie in one suffix array, several anchors at a time. An anchor with more than
   `HOT` distinct contexts (the edges of a passage that very many documents share) isn't gathered: its strings are
   compared by hash, which are the suffix array's classes of common prefix `length`, counted where they are.

Hashes have 64 bits; contexts and strings are told apart by theirs together with their anchor's. Null texts are empty; texts shorter than `length` lose nothing. Rows
that agree in id and text are one document. What remains is binary, since a cut may fall within a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, release, scratch, stored

LENGTH, ANCHOR, HOT = 200, 80, 256
#: Bytes that go into one suffix array, besides a last group.
CHUNK = 1 << 19
_SEGMENT = 1 << 22

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = np.random.default_rng(20_24).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


class _Powers:
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return cls.up[:n], cls.down[:n]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes."""
    up, down = _Powers.of(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])
    h = (sums[size:] - sums[:-size]) * down[: len(data) - size + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the least hash in each `length` bytes, the last of equal ones."""
    wide, low = length - size + 1, np.uint64((1 << 24) - 1)
    at, hashes = [], []
    for lo in range(0, max(0, len(data) - length + 1), _SEGMENT):
        h = rolling(data[lo : lo + _SEGMENT + length - 1], size)
        key = h & ~low | (low - np.arange(len(h), dtype=np.uint64))
        least, span = key, 1
        while span * 2 <= wide:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        n = len(h) - wide + 1
        least = np.minimum(least[:n], least[wide - span : wide - span + n])
        found = np.unique((low - (least & low)).astype(np.int64))
        at.append(found + lo)
        hashes.append(h[found])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, first = np.unique(np.concatenate(at), return_index=True)
    return p, np.concatenate(hashes)[first].view(np.int64)


def suffix_ranks(text: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(size, ranks of the first `size` symbols of each suffix): single symbols, then seven (four, if most is less), doubling
    while size is at most `most`. Symbols are 0 to 510; past the end is lowest. A rank is one more than the number of
    lower suffixes, so suffixes that are alone in their rank keep it, and only the others are sorted again."""
    n = len(text)
    ahead = lambda a, k: np.concatenate([a[k:], np.zeros(min(k, n), np.int64)])
    symbols = text.astype(np.int64) + 1
    levels, size, key = [(1, symbols)], 7 if most >= 7 else 4, symbols
    for k in range(1, size):
        key = key << 9 | ahead(symbols, k)
    at, before = np.arange(n), np.ones(n, np.int64)
    while size <= most:
        order = np.argsort(key)
        at, before, key = at[order], before[order], key[order]
        new = np.append(True, (key[1:] != key[:-1]) | (before[1:] != before[:-1]))[: len(key)]
        group = np.append(True, before[1:] != before[:-1])[: len(key)]
        first = lambda starts: np.flatnonzero(starts)[np.cumsum(starts) - 1]
        rank = levels[-1][1].copy() if len(levels) > 1 else np.zeros(n, np.int64)
        rank[at] = before + first(new) - first(group)
        levels.append((size, rank))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = at[tied]
        before = rank[at]
        key, size = before << 32 | ahead(rank, size)[at], size * 2
    return levels


def _common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to `most`."""
    got, n = np.zeros(len(a), np.int64), len(levels[0][1])
    while True:
        before = got.copy()
        for size, rank in reversed(levels):
            x, y = a + got, b + got
            inside = (np.maximum(x, y) + size <= n) & (got < most)
            got = got + np.where(inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]), size, 0)
        if (got == before).all() or (got >= most).all():
            return np.minimum(got, most)


def _towards(where: np.ndarray, lcp: np.ndarray, at_least: int) -> np.ndarray:
    """For each suffix in order, the common prefix with the nearest one before it in the order that starts earlier.

    lcp[i] belongs to i-1 and i. Links are followed together, each jump doubling; those that fall below at_least stop."""
    to, reach = np.arange(-1, len(where) - 1), lcp.copy()
    while True:
        later = (to >= 0) & (reach >= at_least)
        later[later] = where[to[later]] > where[later]
        if not later.any():
            break
        via = to[later]
        reach[later], to[later] = np.minimum(reach[later], reach[via]), to[via]
    return np.where(to >= 0, reach, 0)


def longest_factors(text: np.ndarray, starts: np.ndarray, order: np.ndarray, most: int, at_least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and next factors of the suffixes that begin at `starts`, in their order by `order` (distinct
    numbers that say which is earlier), as far as `most` symbols. Factors below at_least may come out as less."""
    previous, following = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if not len(starts):
        return previous, following
    levels = suffix_ranks(text, most)
    top, ranks = levels[-1]
    # The first `most` symbols are two overlapping strings of `top`; a smaller top means that most is below 4.
    tail = starts + (most - top) if top * 2 > most else starts
    second = np.where(tail < len(text), ranks[np.minimum(tail, len(text) - 1)], 0)
    suffix = np.lexsort((second, ranks[starts]))
    sa = starts[suffix]
    if at_least >= most:  # only whole strings count, and these are told apart by their ranks
        first, second = ranks[sa], second[suffix]
        lcp = np.append(0, np.where((first[1:] == first[:-1]) & (second[1:] == second[:-1]), most, 0))
    else:
        lcp = np.append(0, _common(levels, sa[:-1], sa[1:], most))
    back = np.concatenate([[0], lcp[:0:-1]])
    for out, where in ((previous, order[suffix]), (following, -order[suffix])):
        out[suffix] = np.maximum(_towards(where, lcp, at_least), _towards(where[::-1], back, at_least)[::-1])
    return previous, following


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Sorted starts of strings as covered intervals."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True)) if len(starts) else []


def _sort_chunk(rows: list[tuple], length: int, first_stays: bool) -> Iterator[tuple[int, int, int]]:
    """rows: (id, row, start of the context in its document, context). Yields (row, start, end) of what to remove."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]))
    sizes = np.array([len(r[3]) + 1 for r in rows])
    base = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(r[3] for r in rows) + b"\0", np.uint8).astype(np.int64)
    text[base + sizes - 1] = 256  # the end of a context is in no string that counts
    number = {row: k for k, row in enumerate(dict.fromkeys(r[1] for r in rows))}
    doc = np.repeat([number[r[1]] for r in rows], sizes)
    place = np.arange(len(text)) - np.repeat(base, sizes) + np.repeat([r[2] for r in rows], sizes)
    whole = np.arange(len(text)) + length <= np.repeat(base + sizes - 1, sizes)
    starts = np.flatnonzero(whole)
    key = doc[starts] << 40 | place[starts]
    key, one = np.unique(key, return_index=True)  # a place of a document once, though several anchors lead there
    previous, following = longest_factors(text, starts[one], np.arange(len(one)), length, length)
    hit = key[(previous if first_stays else np.maximum(previous, following)) >= length]
    names = list(number)
    for part in np.split(hit, np.flatnonzero(np.diff(hit >> 40)) + 1) if len(hit) else ():
        for a, b in _runs(part & (1 << 40) - 1, length):
            yield names[part[0] >> 40], a, b


def _columns(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names.split())


def repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(row, start, end) of bytes to remove, overlapping and unordered. docs: (id long, row long, text binary)."""
    around, first_stays = length - anchor, keep == "first"

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, at, prints, contexts = [], [], [], [], []
            for id_, row, text in zip(b.column("id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(text) < length:
                    continue
                p, h = anchors(np.frombuffer(text, np.uint8), length, anchor)
                ids += [id_] * len(p)
                rows += [row] * len(p)
                at.append(p)
                prints.append(h)
                contexts += [xxhash.xxh3_64_intdigest(text[max(0, x - around) : x + length], min(x, around)) - (1 << 63) for x in p.tolist()]
            join = lambda xs: pa.array(np.concatenate([*xs, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), join(at), join(prints), pa.array(contexts, pa.int64())], ["id", "row", "at", "print", "context"])

    # Anchors are read twice, to find what recurs and to keep it.
    with scratch() as once:
        found = stored(docs.mapInArrow(anchored, "id long, row long, at long, print long, context long"))
    again = found.groupBy("print").agg(F.min(F.struct("row", "at")).alias("a"), F.max(F.struct("row", "at")).alias("b")).where("a != b").select("print")
    shared = stored(found.join(again, "print"))
    release(docs.sparkSession, once)
    # A print and a context hash together tell contexts apart.
    kinds = stored(shared.groupBy("print", "context").agg(F.min(F.struct("id", "row", "at")).alias("first"), F.max(F.struct("id", "row", "at")).alias("last")))
    twice = kinds.where("first != last").select("print", "context", "first")
    whole = shared.join(twice, ["print", "context"])
    if first_stays:
        whole = whole.where(F.struct("id", "row", "at") != F.col("first"))
    whole = whole.select("row", F.greatest(F.lit(0), F.col("at") - around).alias("start"), (F.col("at") + length).alias("end"))

    many = kinds.groupBy("print").agg(F.count("*").alias("kinds")).where("kinds > 1")
    places = kinds.join(many, "print").select("first.row", F.struct("first.at", "print", (F.col("kinds") > hot).alias("hot")).alias("p")).groupBy("row").agg(F.collect_list("p").alias("places"))
    texts = docs.join(places, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, seen = [], set()
            for id_, row, text, places in zip(*(b.column(c).to_pylist() for c in ("id", "row", "text", "places")), strict=True):
                if row in seen:
                    continue
                seen.add(row)
                out += [(id_, row, lo := max(0, p["at"] - around), text[lo : p["at"] + length], p["print"], p["hot"]) for p in places]
                if len(out) > 8192:
                    yield _columns(out, "id row start context print hot", [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()])
                    out = []
            yield _columns(out, "id row start context print hot", [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()])

    contexts = stored(texts.select("id", "row", "text", "places").mapInArrow(cut, "id long, row long, start long, context binary, print long, hot boolean"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held, size, last = [pa.int64()] * 3, [], 0, None
        for b in batches:
            for id_, row, start, context, own in zip(*(b.column(c).to_pylist() for c in ("id", "row", "start", "context", "print")), strict=True):
                if size > CHUNK and own != last:
                    yield _columns(list(_sort_chunk(held, length, first_stays)), "row start end", kinds)
                    held, size = [], 0
                held.append((id_, row, start, context))
                size, last = size + len(context), own
        if held:
            yield _columns(list(_sort_chunk(held, length, first_stays)), "row start end", kinds)

    grouped = contexts.where("not hot").drop("hot").repartition("print").sortWithinPartitions("print")
    sorted_ = grouped.mapInArrow(sort, "row long, start long, end long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in range(0, b.num_rows, 256):
                out = []
                for id_, row, start, context, print_ in zip(*(b.column(c).slice(one, 256).to_pylist() for c in ("id", "row", "start", "context", "print")), strict=True):
                    out += [(print_, xxhash.xxh3_64_intdigest(context[i : i + length]) - (1 << 63), id_ if first_stays else None, row, start + i) for i in range(len(context) - length + 1)]
                yield _columns(out, "print string id row start", [pa.int64()] * 5)

    each = contexts.where("hot").mapInArrow(strings, "print long, string long, id long, row long, start long")
    place = F.struct("id", "row", "start")
    classes = each.groupBy("print", "string").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    hits = each.join(classes, ["print", "string"])
    if first_stays:
        hits = hits.where(place != F.col("first"))
    hits = hits.select("row", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(sorted_).unionByName(hits)


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none", **options) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept): spans are the maximal removed runs, kept the remaining bytes."""
    kind = dict(df.select(id_col).dtypes)[id_col]
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row"), bytes_of(text_col).alias("text"))
    gone = repeats(docs, length, keep, **options).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("gone"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for id_, text, gone in zip(*(b.column(c).to_pylist() for c in ("id", "text", "gone")), strict=True):
                spans: list[list[int]] = []
                for a, e in sorted((g["start"], min(g["end"], len(text))) for g in gone or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([a, e])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((id_, len(text), len(text) - len(kept), len(spans), [{"start": a, "end": e} for a, e in spans], kept))
            yield _columns(out, "id n_bytes n_removed n_spans spans kept", [pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.binary()])

    joined = docs.join(gone, "row", "left").select("id", "text", "gone")
    out = joined.mapInArrow(removed, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
