"""Ranked lexical search over a bit-sliced impact index.

A term's impact in a document is a whole number below 2 ** `SLICES` that rises with its count and falls with the document's
length. The index is one row for each term of a block of documents: the places of the documents that hold it and, for each bit of
the impact, a bitmap over these places. Blocks are made where documents are read, so nothing of a posting is shuffled to build it.

A search spreads a term's bitmaps over the block's documents, multiplies them by the term's weight with shifted additions, and adds
the terms of each item slice by slice with a rippled carry, for all items of a query block at once. The best k are found from the
most significant slice down: documents with the bit go first while there are too many of them, and are kept when there are not.
Each block reports its own best k; a window takes the best of all.

Queries come in blocks of bounded size, each sent to all tasks and answered by one pass over the rows of its terms. Rows go to
tasks by block, and a block has at most `DOCS` documents, so no term, however frequent, meets in one task. Tasks add `TERMS`
terms at a time, so long items cost time and not memory.

Null texts and texts without terms are in no result. Null and repeated ids: each row is a document of its own; equal scores come by
ascending id, nulls last, and rows equal in both in any order. Each row of items is an item of its own; one without known terms
gets no rows. Empty tables give no rows. Other columns aren't carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import expand
from .common import lower_ascii, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of an impact: it is below a million.
SLICES = 20
#: Documents and term occurrences of one block; the latter are exceeded by its last batch.
DOCS, OCCURRENCES = 8_192, 2_000_000
#: Items and distinct terms of one query block (one item at least), and terms that a task spreads at a time.
ITEMS, QUERY_TERMS, TERMS = 512, 16_384, 1_024
#: Fixed values of the impact.
GAIN, STEADY, LENGTH_PERCENT = 1_000_000_000, 20, 50


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Index:
    """rows: (block, term, n, places, slices), and for each block one row without a term that lists its documents."""

    rows: DataFrame
    n_docs: int
    id_type: T.DataType


def sliced(impacts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of segments of n postings, and how many bytes each segment has: all slices of eight postings stand together."""
    width = (n + 7) // 8
    start = np.cumsum(width) - width
    at = expand(start * 8, n)
    out = np.empty((int(width.sum()), SLICES), np.uint8)
    bits = np.zeros(len(out) * 8, np.uint8)
    for s in range(SLICES):
        bits[at] = (impacts >> s) & 1
        out[:, s] = np.packbits(bits)
    return out.ravel(), width * SLICES


def binaries(values: np.ndarray, n: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Reads the texts twice: for the number of documents and terms, on which impacts depend, and for the index, which is stored."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    counts = docs.select(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TERM)).cast("long").alias("n"))
    total = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    id_type = docs.schema[id_col].dataType
    ids_type = T.ArrayType(id_type)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by([("id", "ascending")]).combine_chunks()
            lists = table.column("terms").chunk(0)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().dictionary_encode()
            place = np.repeat(np.arange(len(n)), n)
            key, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * len(n) + place if len(flat) else place, return_counts=True)
            term, place = np.divmod(key, max(len(n), 1))
            m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * n_docs // n_terms
            slices, width = sliced(GAIN * tf // (1000 * tf + STEADY * m[place]), held_by := np.bincount(term, minlength=len(flat.dictionary)))
            known = len(flat.dictionary)
            ids = table.column("id").chunk(0)
            own = pa.ListArray.from_arrays(pa.array([0, len(ids)] + [len(ids)] * known, pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(known + 1, part + made), pa.int64()), pa.concat_arrays([pa.nulls(1, pa.string()), flat.dictionary]), pa.array(np.concatenate(([0], held_by)), pa.int64()), binaries(place.astype(np.uint16), np.concatenate(([0], held_by * 2))), binaries(slices, np.concatenate(([0], width))), own],
                ["block", "term", "n", "places", "slices", "docs"],
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS):
                piece = batch.slice(lo, DOCS)
                if held and sum(b.num_rows for b in held) + piece.num_rows > DOCS:
                    yield block()
                    made, held, size = made + 1, [], 0
                held.append(piece)
                size += pc.sum(pc.list_value_length(piece.column("terms"))).as_py() or 0
                if size >= OCCURRENCES:
                    yield block()
                    made, held, size = made + 1, [], 0
        if held:
            yield block()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("slices", T.BinaryType()), T.StructField("docs", ids_type)])
    cut = docs.select(F.col(f"`{id_col}`").alias("id"), terms(text).alias("terms")).where(F.size("terms") > 0)
    return Index(stored(cut.mapInArrow(indexed, schema)), n_docs, id_type)


def add(total: np.ndarray, more: Iterator[np.ndarray], rows: slice | np.ndarray, at: int = 0) -> None:
    """Adds bit slices, least significant first and shifted by at, to rows of total (slices, rows, words), with a rippled carry."""
    carry, s = None, at
    for b in more:
        a = total[s, rows]
        half = a ^ b
        if carry is None:
            total[s, rows], carry = half, a & b
        else:
            total[s, rows], carry = half ^ carry, (a & b) | (half & carry)
        s += 1
    while s < len(total) and carry.any():
        a = total[s, rows]
        total[s, rows], carry = a ^ carry, a & carry
        s += 1


def spread(places: list[bytes], slices: list[bytes], n: np.ndarray, weights: np.ndarray, words: int, bits: int) -> np.ndarray:
    """The weighted impacts of terms over all documents of a block: (bits, terms, words)."""
    place = np.frombuffer(b"".join(places), np.uint16)
    set_ = np.unpackbits(np.frombuffer(b"".join(slices), np.uint8).reshape(-1, SLICES), axis=0)
    width = (n + 7) // 8 * 8
    set_ = set_[expand(np.cumsum(width) - width, n)]
    of = np.repeat(np.arange(len(n)), n)
    plain = np.empty((SLICES, len(n), words), np.uint64)
    for s in range(SLICES):
        wide = np.zeros((len(n), words * 64), np.uint8)
        wide[of, place] = set_[:, s]
        plain[s] = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)
    out = np.zeros((bits, len(n), words), np.uint64)
    for b in range(int(weights.max()).bit_length()):
        rows = np.flatnonzero((weights >> b) & 1)
        if len(rows):
            add(out, (plain[s][rows] for s in range(SLICES)), rows, b)
    return out


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and sums of each row's k highest sums above 0, with all that tie with the last: from the highest slice down."""
    left = np.bitwise_or.reduce(total, axis=0)
    taken = np.zeros_like(left)
    for bits in total[::-1]:
        more = taken | (left & bits)
        many = (np.bitwise_count(more).sum(axis=1) > k)[:, None]
        taken, left = np.where(many, taken, more), np.where(many, left & bits, left & ~bits)
    full = (np.bitwise_count(taken).sum(axis=1) >= k)[:, None]
    found = np.where(full, taken, taken | left)
    row, place = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))
    value = np.zeros(len(row), np.int64)
    for s, bits in enumerate(total):
        value |= ((bits[row, place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
    order = np.lexsort((place, -value, row))
    row, place, value = row[order], place[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], place[rank < k], value[rank < k]


def query_blocks(items: DataFrame) -> Iterator[dict[int, list[str]]]:
    """Items' distinct terms, in blocks of bounded size; a partition of the items at a time is on the driver."""
    held: dict[int, list[str]] = {}
    known: set[str] = set()
    for r in items.where(F.size("terms") > 0).select("item", "terms").toLocalIterator():
        if held and (len(held) == ITEMS or len(known | set(r["terms"])) > QUERY_TERMS):
            yield held
            held, known = {}, set()
        held[r["item"]] = r["terms"]
        known |= set(r["terms"])
    if held:
        yield held


def answer(index: Index, queries: dict[int, list[str]], k: int) -> DataFrame:
    """(item, doc, score): the k best of each block of documents, for one query block."""
    spark = index.rows.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted({t for ts in queries.values() for t in ts})], "asked string")
    asked = F.broadcast(asked)  # at most QUERY_TERMS, or the terms of one item
    mine = index.rows.join(asked, F.col("term") == F.col("asked"), "left_semi")
    weights = {r["term"]: weight(index.n_docs, r["df"]) for r in mine.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    items = [(i, [t for t in ts if weights.get(t, 0) > 0]) for i, ts in queries.items()]
    sent = spark.sparkContext.broadcast((items, weights))
    bits = max([sum(weights[t] for t in ts) for _, ts in items], default=0) * (1 << SLICES)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        names = np.array([i for i, _ in items], np.int64)
        of_term: dict[str, list[int]] = {}
        for at, (_, ts) in enumerate(items):
            for t in ts:
                of_term.setdefault(t, []).append(at)
        worst = np.zeros(len(items), np.int64)  # a score that k documents of this task reach

        def search(ids: pa.Array, rows: list[tuple[str, int, bytes, bytes]]) -> pa.RecordBatch:
            words = (len(ids) + 63) // 64
            total = np.zeros((bits.bit_length(), len(items), words), np.uint64)
            for lo in range(0, len(rows), TERMS):
                part = rows[lo : lo + TERMS]
                w = np.array([weights[r[0]] for r in part], np.int64)
                dense = spread([r[2] for r in part], [r[3] for r in part], np.array([r[1] for r in part], np.int64), w, words, SLICES + int(w.max()).bit_length())
                own: list[list[int]] = [[] for _ in items]
                for t, r in enumerate(part):
                    for at in of_term[r[0]]:
                        own[at].append(t)
                for step in range(max(map(len, own))):
                    active = np.array([at for at, ts in enumerate(own) if len(ts) > step])
                    term = np.array([own[at][step] for at in active])
                    add(total, (s[term] for s in dense), active)
            row, place, value = best(total, k)
            good = value >= worst[row]
            row, place, value = row[good], place[good], value[good]
            at, n = np.unique(row, return_counts=True)
            last = np.cumsum(n) - 1
            worst[at[n >= k]] = np.maximum(worst[at[n >= k]], value[last[n >= k]])
            return pa.RecordBatch.from_arrays([pa.array(names[row]), ids.take(pa.array(place)), pa.array(value)], ["item", "doc", "score"])

        now, ids, rows = None, None, []
        for b in batches:
            blocks = b.column("block").to_numpy()
            for lo, hi in zip(starts := np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)), [*starts[1:], len(blocks)], strict=True):
                if blocks[lo] != now:
                    if rows:
                        yield search(ids, rows)
                    now, ids, rows = blocks[lo], None, []
                for t, n, places, slices, own in zip(*(b.column(c).slice(lo, hi - lo).to_pylist() if c != "docs" else b.column(c).slice(lo, hi - lo) for c in ("term", "n", "places", "slices", "docs")), strict=True):
                    if t is None:
                        ids = own.values
                    elif t in of_term:
                        rows.append((t, n, places, slices))
        if rows:
            yield search(ids, rows)

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc", index.id_type), T.StructField("score", T.LongType())])
    both = mine.unionByName(index.rows.where("term is null"))
    return both.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("term")).mapInArrow(searched, schema)


def search(index: Index, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_col, rank, doc_id, score): for each item its k best documents with a score above 0, highest first, ties by id."""
    asked = stored(items.select(F.col(f"`{item_col}`").alias("name"), F.array_distinct(terms(F.col(f"`{text_col}`"))).alias("terms"), F.monotonically_increasing_id().alias("item")))
    found = None
    for block in query_blocks(asked):
        part = answer(index, block, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        part = stored(part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame([], T.StructType([T.StructField("item", T.LongType()), T.StructField("doc", index.id_type), T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())]))
    return found.join(asked.select("item", "name"), "item").select(F.col("name").alias(item_col), "rank", F.col("doc").alias("doc_id"), "score")


ORACLE_SQL = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents
), s as (
  select count(*) filter (len(ts) > 0) as nd, sum(len(ts))::bigint as nl from d
), q as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark
), p as (
  select r, doc_id, any_value(n) as n, t, count(*) as tf from (select r, doc_id, len(ts) as n, unnest(ts) as t from d) where t in (select t from q) group by r, doc_id, t
), w as (
  select t, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s group by t
), x as (
  select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nl))))::bigint as score
  from q join p using (t) join w using (t), s group by item_id, doc_id, r
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from x where score > 0 qualify rank <= 50
"""
