"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often each pair of ids meets.

A is a byte-level BPE file of the tokenizers library and encodes a space and the text; B is a sentencepiece model, which adds
that space itself. The tokens of a block of documents are laid out over one run of bytes: the ends of A's tokens and of B's are
counted once for each byte (bincount), the block is cut where both end, and each run between neighbouring ends is one link,
a pair of tokens that overlap. Prefix sums over the run, taken at the documents' ends, give each document's groups and links.

Counts of id pairs cover the whole corpus: each block sends its distinct pairs once, with how often it holds them. The counts
go back to the blocks, so what a task holds is bounded by `BLOCK` bytes of text and one document; no document's links are
shuffled. The highest counts by B id, at most one row for each id of B's vocabulary, are broadcast.

Texts that are null, empty, or that A or B don't give back byte for byte have no tokens. Rows are taken one by one, so null and
repeated ids are no matter; equal texts count as often as they occur, and ties for the highest count all are best. An empty
table gives no rows. Other columns pass through, whatever their names, but for those named like a result, which are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Chunks, expand, sums
from .common import stored

#: Bytes of text in one block, beyond its last batch.
BLOCK = 4 << 20
#: Between a visible character and a space: neither tokenizer joins what stands there.
BETWEEN = r"(?<=[!-~\p{L}\p{N}])(?= )"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SPACE = "▁"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Pair:
    """The two tokenizers, by the contents of their files, so that tasks need no path of the driver."""

    a_json: str
    b_model: bytes

    @cached_property
    def a(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.a_json)
        made.encode_special_tokens = True
        return made

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    def a_ids(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]

    def b_ids(self, chunks: list[str]) -> list[list[int]]:
        alone = [self.b.piece_to_id(SPACE)]
        found = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if c != " " else alone for c, ids in zip(chunks, found, strict=True)]

    def a_bytes(self) -> list[bytes]:
        symbols = byte_symbols()
        plain = {t.content: t.content.encode() for t in self.a.get_added_tokens_decoder().values()}
        names = {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        of = lambda s: plain[s] if s in plain else bytes(symbols[c] for c in s)
        return [of(names[i]) if i in names else b"" for i in range(max(names) + 1)]

    def b_bytes(self) -> list[bytes]:
        b = self.b
        of = lambda i, s: bytes([int(s[3:5], 16)]) if b.is_byte(i) else s.replace(SPACE, " ").encode()
        return [of(i, b.id_to_piece(i)) for i in range(b.get_piece_size())]

    def cuts_at_spaces(self) -> bool:
        """Whether ids of a text are those of its chunks: A cuts by the byte-level pattern, and no piece of B has a space behind
        another character."""
        a = json.loads(self.a_json)
        level = a["pre_tokenizer"] or {}
        plain = a["normalizer"] is None and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space")
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        return bool(plain) and not self.b.is_unknown(self.b.piece_to_id(SPACE)) and all(SPACE not in p.lstrip(SPACE) for p in pieces)


class Pieces:
    """Bytes of ids, gathered for arrays of ids."""

    def __init__(self, pieces: list[bytes]):
        self.n = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.all = np.frombuffer(b"".join(pieces), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.all[expand(self.first[ids], self.n[ids])]


def whole(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each list's strings have together, and all their bytes in order."""
    raw = lists.flatten()
    if not len(raw):
        return np.zeros(len(lists), np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    return sums(np.diff(ends), lists.value_lengths().to_numpy(zero_copy_only=False)), np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


Side = tuple[np.ndarray, np.ndarray]


def agreeing(sides: list[Side], pieces: tuple[Pieces, Pieces], data: np.ndarray, doc_bytes: np.ndarray) -> list[Side]:
    """Both sides (ids, ids by document) without the documents that one of them doesn't give back byte for byte."""
    only = lambda sides, good: [(ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in sides]
    good = doc_bytes > 0
    for (ids, n), p in zip(sides, pieces, strict=True):
        good &= sums(p.n[ids], n) == doc_bytes
    sides, size = only(sides, good), np.where(good, doc_bytes, 0)
    want = data[expand(np.cumsum(doc_bytes) - doc_bytes, size)]
    for (ids, _), p in zip(sides, pieces, strict=True):
        good &= sums(p.bytes_of(ids) != want, size) == 0
    return only(sides, good)


@dataclass
class Laid:
    """A block's tokens over its bytes. links: the A and B token of each overlap; per document: groups and links."""

    cut_a: np.ndarray  # how many A tokens end up to each cut
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray


def lay_out(a_sizes: np.ndarray, b_sizes: np.ndarray, doc_bytes: np.ndarray) -> Laid:
    """Both cover the same bytes, document by document."""
    total = int(doc_bytes.sum())
    at_a = np.bincount(np.cumsum(a_sizes), minlength=total + 1).astype(np.int8)
    at_b = np.bincount(np.cumsum(b_sizes), minlength=total + 1).astype(np.int8)
    until_a, until_b = np.cumsum(at_a, dtype=np.int32), np.cumsum(at_b, dtype=np.int32)
    cut, end = np.flatnonzero(at_a & at_b), np.flatnonzero(at_a | at_b)
    docs = np.cumsum(doc_bytes)
    per_doc = lambda places: np.searchsorted(places, docs, "right") - np.searchsorted(places, docs - doc_bytes, "right")
    return Laid(until_a[cut], until_b[cut], until_a[end] - at_a[end], until_b[end] - at_b[end], per_doc(cut), per_doc(end))


def digests(a: np.ndarray, b: np.ndarray, laid: Laid, ids: int) -> list[str]:
    """Of each document's groups as text. Each id comes with the mark before it from one table of strings."""
    if not len(a):
        return [""] * len(laid.n_groups)
    table = pa.array([f"{mark}{i}" for mark in ("", ",", ";", "|") for i in range(ids)], pa.large_string())
    n_a, n_b = np.diff(laid.cut_a, prepend=0), np.diff(laid.cut_b, prepend=0)
    place_a = expand(np.cumsum(n_a + n_b) - n_a - n_b, n_a)
    place_b = expand(np.cumsum(n_a + n_b) - n_b, n_b)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    heads = np.cumsum(laid.n_groups) - laid.n_groups  # each document's first group
    mark_a, mark_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    mark_a[first_a], mark_b[first_b] = 2, 3
    mark_a[first_a[heads[laid.n_groups > 0]]] = 0
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a], code[place_b] = mark_a * ids + a, mark_b * ids + b
    text = table.take(pa.array(code))
    offsets, values = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1], memoryview(text.buffers()[2])
    until = np.concatenate(([0], np.cumsum(n_a + n_b)))
    to = offsets[until[heads + laid.n_groups]]
    return [hashlib.sha256(values[lo:hi]).hexdigest() if hi > lo else "" for lo, hi in zip(offsets[until[heads]], to, strict=True)]


def packed(ids: np.ndarray, wide: type) -> bytes:
    """A block's ids, compressed: they are stored once and shuffled once."""
    return pa.compress(ids.astype(wide).tobytes(), codec="zstd", asbytes=True)


def unpacked(column: pa.ChunkedArray, n: np.ndarray, wide: type) -> np.ndarray:
    """The ids of a block, which one of its rows holds, n of them for each row."""
    raw = next(x for x in column.to_pylist() if x is not None)
    return np.frombuffer(pa.decompress(raw, int(n.sum()) * np.dtype(wide).itemsize, codec="zstd", asbytes=True), wide).astype(np.int64)


def chunked(text: Column, at_spaces: bool) -> Column:
    led = F.concat(F.lit(" "), text)
    cut = F.split(led, BETWEEN) if at_spaces else F.array(led)
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def align(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", groups: bool = False, block: int = BLOCK) -> DataFrame:
    """df's columns besides the text, and `RESULTS`: the tokens of A and B, groups and links, links whose count is the highest of
    their B id, the sum of the links' counts, the digest of the groups' ids. With groups, also a_ids, b_ids (array<int>) and
    group_a, group_b: how many ids of each end up to each group's end."""
    spark = df.sparkSession
    pair = Pair(Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes())
    a_bytes, b_bytes = pair.a_bytes(), pair.b_bytes()
    wide = np.uint16 if max(len(a_bytes), len(b_bytes)) <= 1 << 16 else np.uint32
    n_b_ids, n_ids = len(b_bytes), max(len(a_bytes), len(b_bytes))
    extra = ("a_ids", "b_ids", "group_a", "group_b") if groups else ()
    others = [f for f in df.schema.fields if f.name not in (text_col, *RESULTS, *extra)]
    keys = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)]
    files = spark.sparkContext.broadcast((pair.a_json, pair.b_model))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both = Pair(*files.value)
        chunks = Chunks(both.a_ids, both.b_ids)
        pieces = Pieces(both.a_bytes()), Pieces(both.b_bytes())
        part, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("chunks").chunk(0)
            doc_bytes, data = whole(lists)
            sides = agreeing(chunks(lists), pieces, data, doc_bytes)
            (a, n_a), (b, n_b) = sides
            laid = lay_out(pieces[0].n[a], pieces[1].n[b], sums(pieces[0].n[a], n_a))
            found, times = np.unique(a[laid.link_a].astype(np.int64) * n_b_ids + b[laid.link_b], return_counts=True)
            first = np.zeros(table.num_rows, np.int64)
            first[0] = len(found)
            lists_of = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(first))), pa.int32()), pa.array(values, kind))
            columns = [table.column(k.name).chunk(0) for k in keys]
            once = lambda raw: pa.array([raw, *[None] * (table.num_rows - 1)], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(table.num_rows, part + made), pa.int64()), pa.array(np.arange(table.num_rows), pa.int64()), *columns, pa.array(n_a), pa.array(n_b), once(packed(a, wide)), once(packed(b, wide)), lists_of(found, pa.int64()), lists_of(times, pa.int64())],
                ["block", "at", *(k.name for k in keys), "n_a", "n_b", "a", "b", "pairs", "times"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("chunks").nbytes
            if size >= block:
                yield row()
                made, held, size = made + 1, [], 0
        if held:
            yield row()

    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([*long("block", "at"), *keys, *long("n_a", "n_b"), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])
    cut = df.select(*(F.col(f"`{f.name}`").alias(k.name) for f, k in zip(others, keys, strict=True)), chunked(F.col(f"`{text_col}`"), pair.cuts_at_spaces()).alias("chunks"))
    tokens = stored(cut.mapInArrow(encoded, schema))

    # counts over the corpus, and back to the blocks that hold the pair
    held = tokens.where(F.size("pairs") > 0).select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counted = stored(held.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b_id", F.col("pair") % n_b_ids))
    most = counted.groupBy("b_id").agg(F.max("n").alias("most"))  # at most one row for each id of B
    known = counted.join(F.broadcast(most), "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = held.select(F.col("block").alias("of"), "pair").join(known, "pair")
    sizes = spark.sparkContext.broadcast((np.array([len(p) for p in a_bytes], np.int64), np.array([len(p) for p in b_bytes], np.int64)))

    def finished(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        size_a, size_b = sizes.value
        docs = docs.sort_by("at")
        n_a, n_b = docs.column("n_a").to_numpy(), docs.column("n_b").to_numpy()
        a, b = unpacked(docs.column("a"), n_a, wide), unpacked(docs.column("b"), n_b, wide)
        laid = lay_out(size_a[a], size_b[b], sums(size_a[a], n_a))
        pair = pairs.column("pair").to_numpy()
        order = np.argsort(pair)
        at = order[np.searchsorted(pair, a[laid.link_a] * n_b_ids + b[laid.link_b], sorter=order)] if len(pair) else order
        n = pairs.column("n").to_numpy()[at].astype(np.int64)
        best = pairs.column("best").to_numpy()[at].astype(np.int64)
        out = [n_a, n_b, laid.n_groups, laid.n_links, sums(best, laid.n_links), sums(n, laid.n_links)]
        columns = [docs.column(k.name) for k in keys] + [pa.array(x, pa.int64()) for x in out] + [pa.array(digests(a, b, laid, n_ids), pa.string())]
        if groups:
            lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values, pa.int32()))
            until = lambda cuts, n: cuts - np.repeat(np.cumsum(n) - n, laid.n_groups)
            columns += [lists(a, n_a), lists(b, n_b), lists(until(laid.cut_a, n_a), laid.n_groups), lists(until(laid.cut_b, n_b), laid.n_groups)]
        return pa.Table.from_arrays(columns, [k.name for k in keys] + [*RESULTS, *extra])

    kinds = [T.LongType()] * (len(RESULTS) - 1) + [T.StringType()] + [T.ArrayType(T.IntegerType())] * len(extra)
    result = T.StructType(keys + [T.StructField(n, k) for n, k in zip((*RESULTS, *extra), kinds, strict=True)])
    done = tokens.drop("pairs", "times").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(finished, result)
    return done.select(*(F.col(k.name).alias(f.name) for f, k in zip(others, keys, strict=True)), *RESULTS, *extra)
