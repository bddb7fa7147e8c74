"""LM scoring with a probabilistic suffix tree over words.

States are contexts of up to `depth` preceding words, of variable length: a context grows by a word as long as it is
frequent, and is retained only if its next-word distribution diverges from its parent's (the context without its first
word) by `divergence` log10 units a token. Distributions are smoothed by absolute discounting: what a state takes from its
counts goes to its parent, the root's add-one estimate at last. A token is scored in the state of its longest retained
suffix.

What counts as frequent follows the corpus: words, contexts and entries (a next word with a probability of its own) need
WORD, CONTEXT and ENTRY times the root of the number of training tokens. So the tree grows with the root of the corpus
(twice the tree for four times the text), and what is broadcast has a bound, at most root / ENTRY entries of a depth.

Words rarer than that have no number in the tree; their probabilities differ from the parent's only by the states'
weights, so their root counts are joined in from the table of all words, and every count is exact.

Texts are lower-cased (A-Z) and cut at ASCII white space; one end token follows each, also each empty or null text, and
stands before the first word as its context. Without training rows all counts are 0. Rows are scored one by one, so
repeated rows, ties and null ids are no matter, and an empty table stays empty. A row is held out if `train` isn't true
for it. Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, stored

END = b""
WORD, CONTEXT, ENTRY, DIVERGENCE, DEPTH = 0.006, 0.2, 0.02, 0.02, 3
DISCOUNT = 0.75


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; bytes' own lower() and split() know ASCII alone."""
    return text.lower().split()


class _Numbers(dict):
    def __missing__(self, word):
        return -1


@dataclass
class Level:
    """Contexts of one length, by number. Of length 1 these are the words' numbers; longer ones have sorted keys, the
    number of the context without its last word times K plus that word."""

    contexts: np.ndarray | None  # None for length 1
    parent: np.ndarray  # the number, one level up, of the context without its first word
    count: np.ndarray
    entries: np.ndarray  # sorted, context * K + next word, of retained contexts
    share: np.ndarray  # each entry's discounted share
    weight: np.ndarray  # what a context leaves to its parent; 1 if it isn't retained


@dataclass
class Tree:
    numbers: _Numbers  # frequent words
    counts: np.ndarray  # of each number
    total: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.distinct + 1)

    def chance(self, length: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of numbered words after contexts of one length (0: none), by their numbers."""
        if not length:
            return self.root(self.counts)[word]
        level = self.levels[length - 1]
        at, hit = _find(level.entries, context * len(self.numbers) + word)
        own = np.where(hit, level.share[at], 0.0) if len(level.share) else 0.0
        return own + level.weight[context] * self.chance(length - 1, level.parent[context], word)

    def contexts_at(self, flat: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """The number of the context of each length that ends at each position, or -1: one row a length."""
        k, out = len(self.numbers), [flat]
        for level in self.levels[1:length]:
            before = np.append(-1, out[-1][:-1])
            before[starts[:-1]] = -1
            at, hit = _find(level.contexts, before * k + flat)
            out.append(np.where(hit & (before >= 0) & (flat >= 0), at, -1))
        return np.array(out)


def _flat(texts: list[bytes], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Numbers of end, words, end for each text, one after the other; where each text begins."""
    words = [tokens(t) for t in texts]
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.append(0, np.cumsum(sizes))
    flat = np.full(starts[-1], numbers[END], np.int64)
    for at, w in zip(starts, words, strict=False):
        flat[at + 1 : at + 1 + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
    return flat, starts, words


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def _counted(docs: DataFrame, keys_of, numbers) -> DataFrame:
    """(key, n) of the keys that keys_of finds in training texts, summed in each task before they are shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for b in batches:
            flat, starts, _ = _flat(b.column("text").to_pylist(), numbers.value)
            k, n = np.unique(keys_of(flat, starts), return_counts=True)
            keys, counts, held = [*keys, k], [*counts, n], held + len(k)
            if held > 2_000_000:
                k, n = _sums(keys, counts)
                keys, counts, held = [k], [n], 0
                if len(k) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
                    keys, counts = [], []
        if keys:
            k, n = _sums(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n)], ["key", "n"])

    return docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): all tokens of (text binary), ends included."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(tokens(text))
                seen[END] += 1
            if len(seen) > 300_000:
                yield out()
                seen.clear()
        yield out()

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _context(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of tokens that are predicted: all but each text's opening end."""
    at = np.ones(len(flat), bool)
    at[starts[:-1]] = False
    return np.flatnonzero(at)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def fit(docs: DataFrame, words: DataFrame, word: float = WORD, context: float = CONTEXT, entry: float = ENTRY, divergence: float = DIVERGENCE, depth: int = DEPTH) -> Tree:
    """docs: (text binary) of training rows; words: their word_counts. What comes to the driver is bounded, see above."""
    sc = docs.sparkSession.sparkContext
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    least = lambda times: max(2, int(np.ceil(times * total**0.5)))
    top = words.where((F.col("n") >= least(word)) | (F.col("word") == END)).orderBy(F.desc("n"), "word").toPandas()
    numbers = _Numbers((bytes(w), i) for i, w in enumerate(top["word"]))
    numbers.setdefault(END, len(numbers))
    counts = np.append(top["n"].to_numpy(np.int64), np.zeros(len(numbers) - len(top), np.int64))
    k = len(numbers)
    shared, usable = sc.broadcast(numbers), counts >= least(entry)
    tree = Tree(numbers, counts, total, distinct)
    contexts, parent, count, usual = None, np.zeros(k, np.int64), counts, counts >= least(context)
    while len(tree.levels) < depth and usual.any():
        length = len(tree.levels) + 1
        tree.levels.append(Level(contexts, parent, count, np.zeros(0, np.int64), np.zeros(0), np.ones(len(count))))
        known = sc.broadcast((tree, usual, usable))

        def keys(flat: np.ndarray, starts: np.ndarray, length: int = length, known=known) -> np.ndarray:
            tree, usual, usable = known.value
            at = _context(flat, starts)
            c, w = tree.contexts_at(flat, starts, length)[-1][at - 1], flat[at]
            ok = (c >= 0) & (w >= 0)
            c, w = c[ok], w[ok]
            ok = usual[c] & usable[w]
            return c[ok] * len(tree.numbers) + w[ok]

        got = _counted(docs, keys, shared).where(F.col("n") >= least(entry)).orderBy("key").toPandas()
        known.unpersist()
        found, n = got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
        c, w = found // k, found % k
        share = (n - DISCOUNT) / count[c]
        weight = 1 - np.bincount(c, share, len(count))
        below = tree.chance(length - 1, parent[c], w)
        gain = np.bincount(c, n * np.log10((share + weight[c] * below) / below), len(count)) + (count - np.bincount(c, n, len(count))) * np.log10(np.maximum(weight, 1e-12))
        kept = usual & (gain >= divergence * np.maximum(count, 1))
        level = tree.levels[-1]
        level.weight = np.where(kept, weight, 1.0)
        level.entries, level.share = found[kept[c]], share[kept[c]]
        # A frequent entry makes a longer context, whose parent is a context of this length.
        good = (n >= least(context)) & (w != numbers[END])
        contexts, count, c, w = found[good], n[good], c[good], w[good]
        parent = w if length == 1 else _find(level.contexts, parent[c] * k + w)[0]
        usual = np.ones(len(contexts), bool)
    return tree


def score_batch(texts: list[bytes], tree: Tree) -> tuple[dict[str, np.ndarray], list[dict[bytes, int]]]:
    """Sums over each text's tokens, rare words' root probabilities left out; the rare words of each text."""
    k = len(tree.numbers)
    flat, starts, words = _flat(texts, tree.numbers)
    at = _context(flat, starts)
    z = flat[at]
    known = z >= 0
    p0 = np.where(known, tree.root(tree.counts)[z], 1.0)
    p = p0
    for level, row in zip(tree.levels, tree.contexts_at(flat, starts, len(tree.levels)), strict=False):
        c = row[at - 1]
        i, hit = _find(level.entries, c * k + z)
        own = np.where(hit & known & (c >= 0), level.share[i] if len(level.share) else 0.0, 0.0)
        p = np.where(c >= 0, own + level.weight[c] * p, p)
    cut = starts[:-1] - np.arange(len(texts))
    add = lambda v: np.add.reduceat(v, cut) if len(texts) else v
    sums = {"n_tokens": np.diff(starts) - 1, "n_known": add((known & (tree.counts[z] > 0)).astype(np.int64)), "base_score": add(np.where(known, np.log10(p0), 0.0)), "score": add(np.log10(p))}
    rare = [Counter(w for w in ws if w not in tree.numbers) for ws in words]
    return sums, rare


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from the rows where train is true."""
    rows = df.select(F.col(id_col).alias("id"), (~F.coalesce(train, F.lit(False))).alias("held_out"), bytes_of(text_col).alias("text"))
    known = rows.where("not held_out").select("text")
    words = stored(word_counts(known))
    tree = df.sparkSession.sparkContext.broadcast(fit(known, words, **options))
    total, distinct = tree.value.total, tree.value.distinct
    schema = f"row long, id {dict(df.select(id_col).dtypes)[id_col]}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,n:long>>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            sums, rare = score_batch(b.column("text").to_pylist(), tree.value)
            ids = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            flat = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()), pa.array([n for r in rare for n in r.values()], pa.int64())], ["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rare])), pa.int32()), flat)
            names = ["row", "id", "held_out", *sums, "rare"]
            yield pa.RecordBatch.from_arrays([ids, b.column("id"), b.column("held_out"), *(pa.array(v) for v in sums.values()), lists], names)

    part = stored(rows.mapInArrow(scored, schema))
    each = part.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    c = F.coalesce(words["n"], F.lit(0))
    log = F.log10((c + 1) / F.lit(float(total + distinct + 1)))
    found = each.join(words, "word", "left").select("row", (each["n"] * log).alias("log"), F.when(c > 0, each["n"]).otherwise(0).alias("known"))
    more = found.groupBy("row").agg(F.sum("log").alias("log"), F.sum("known").alias("known"))
    zero = F.coalesce("log", F.lit(0.0))
    return part.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base_score") + zero).alias("base_score"), (F.col("score") + zero).alias("score"),
    )
