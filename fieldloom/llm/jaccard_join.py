"""N-gram Jaccard join: a grouped prefix join that gives each document its class of linked documents.

Documents link when the Jaccard similarity of their sets of word n-grams reaches `percent` / 100. Sets are of 64-bit
hashes. Each set is ordered by how many documents have an n-gram, rare ones first, then by hash; two sets that link share
one of their first n - ceil(percent * n / 100) + 1 n-grams, the prefix. The counts come from a table of `COUNTERS` sums by
hash, of fixed size; n-grams that fall together share a count. Any order that all sets agree on gives the same links, so
the table decides cost alone: n-grams of a passage that many documents share
stand last and don't make candidates of all of these.

* Documents with equal sets are linked at once. Documents with equal prefixes and sizes collapse into one group.
* Groups that share a prefix n-gram and fit in size and position are candidates: all that comes before the first n-gram
  that two sets share is in one of them only, so the two positions bound their difference from below. An n-gram's groups
  are in runs of sizes: between neighbours in a run, none is too large for the other. First each run's pivot, the group
  that has the n-gram foremost and so can link with most, meets all of its groups; each document is verified with the most alike of those it met, then with
  the others whose classes still differ. After that only pairs of one n-gram or one group whose classes differ are left, so
  a group of thousands of near copies costs a multiple of its size, and not its square. The classes are exact either way:
  every pair that can link either shares a class already or is looked at.
* Group pairs are expanded into members. A fixed share of both sets, the hashes divisible by `part`, rules out pairs
  whose symmetric difference in this share alone is too large; the rest is verified on whole sets.

Null and empty texts, and texts without words, have no set and link with nothing. Texts of fewer than n words have one
n-gram, all their words. Rows that agree in id and text are one document, told apart from others by two 64-bit hashes.
A null id is the greatest. An empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bytes_of, stored
from .components import components

#: Places of the table of counts. What falls together by chance varies by the root of its sum, so n-grams of very many
#: documents stand out at any size of the corpus.
COUNTERS = 1 << 20
#: Places of a set's parity: two sets differ in as many hashes at least as their parities do in places.
PARITY = 256
#: Bytes of texts whose words are hashed at once, in whole texts; words above so many bytes are hashed one by one.
_BLOCK, _LONG = 1 << 19, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What keeps the first bytes of eight, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of whole texts of about _BLOCK bytes; a longer text is in the last place of its run."""
    lo, size = 0, 0
    for hi, text in enumerate(texts, 1):
        size += len(text)
        if size >= _BLOCK or hi == len(texts):
            yield texts[lo:hi]
            lo, size = hi, 0


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, and where each text's words start and the last one's end. Words are those of bytes' own
    lower() and split(), which know ASCII alone."""
    run = b" ".join([b"", *texts, b" " * 8]).lower()
    raw = np.frombuffer(run, np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(run) - 7, "<u8", run, strides=(1,))
    out = _mix(size.astype(np.uint64) * _STEP + (eight[start] & _FIRST[np.minimum(size, 8)]))
    left, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(left):
        out[left] = _mix(out[left] * _STEP + (eight[start[left] + done] & _FIRST[np.minimum(size[left] - done, 8)]))
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(run[start[i] : start[i] + size[i]])
    return out, np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))


class Shingler:
    """Sets of hashed word n-grams. counts: of documents, by hash modulo their number."""

    def __init__(self, n: int, counts: np.ndarray | None = None):
        self.n, self.counts = n, counts

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's distinct hashes in order of hash, and where each text's start and the last one's end."""
        n, (words, at) = self.n, _word_hashes(texts)
        lo, many = at[:-1], np.diff(at)

        def grams(k: int, places: slice | np.ndarray) -> np.ndarray:
            out = np.full(1, k, np.uint64)
            for i in range(k):
                out = _mix(out * _STEP + ahead[i:][places])
            return out

        ahead = np.append(words, np.zeros(n, np.uint64))
        out, whole = grams(n, slice(0, len(words))), np.ones(len(words), bool)
        for k in range(1, n):  # the last words of a text start no n-gram; k words alone are one
            whole[(lo + many)[many >= k] - k] = False
        for k in range(1, n):
            short = lo[many == k]
            out[short], whole[short] = grams(k, short), True
        out, ends = out[whole], np.append(0, np.cumsum(np.where(many >= n, many - n + 1, np.minimum(many, 1))))
        for a, b in itertools.pairwise(ends.tolist()):
            out[a:b].sort()
        new = np.append(True, out[1:] != out[:-1])[: len(out)]
        new[ends[:-1][many > 0]] = True
        return out[new], np.append(0, np.cumsum(new))[ends]

    def ordered(self, hashes: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text's hashes the `first` rarest, by count, then by hash, and where they start and end."""
        # The place in the low half keeps the order of hashes: texts' hashes are sorted.
        rank = self.counts[hashes % np.uint64(len(self.counts))].astype(np.uint64) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
        parts = [np.zeros(0, np.uint64)]
        for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), first.tolist(), strict=True):
            part = rank[a:b]
            part.sort()
            parts.append(part[:k])
        return hashes[np.concatenate(parts) & np.uint64(0xFFFFFFFF)], np.append(0, np.cumsum(first))


def _counts(rows: DataFrame, n: int, counters: int) -> np.ndarray:
    """How many documents have n-grams of each place in the table. Tasks add up before they send, in cells of 4,096 places."""
    cell = 4_096

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, found = Shingler(n), np.zeros(counters, np.int32)
        for b in batches:
            for texts in _blocks(b.column("text").to_pylist()):
                np.add.at(found, (make(texts)[0] % np.uint64(counters)).astype(np.int64), 1)
        for lo in range(0, counters, 64 * cell):
            part = found[lo : lo + 64 * cell].reshape(-1, cell)
            some = np.flatnonzero(part.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some + lo // cell, pa.int32()), pa.array([part[i].tobytes() for i in some], pa.binary())], ["cell", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, raw in zip(b.column("cell").to_pylist(), b.column("n").to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(raw, np.int32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["cell", "n"])

    schema = "cell int, n binary"
    table = np.zeros((counters // cell, cell), np.int32)
    for r in rows.select("text").mapInArrow(counted, schema).repartition("cell").mapInArrow(added, schema).toLocalIterator():
        table[r["cell"]] = np.frombuffer(r["n"], np.int32)
    return table.reshape(-1)


def _key(*columns: str) -> Column:
    """16 bytes that tell the columns' values apart."""
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.unhex(F.concat(half(*columns), half(F.lit(1), *columns)))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def _signatures(rows: DataFrame, shingler, percent: int, part: int) -> DataFrame:
    """(row, n, set1, set2, prefix, sketch, parity) of (row, text binary). Parity: for each of PARITY places, whether an odd
    number of the set's hashes fall there."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingler.value
        for b in batches:
            done = 0
            for texts in _blocks(b.column("text").to_pylist()):
                h, at = make(texts)
                n, text = np.diff(at), np.repeat(np.arange(len(texts)), np.diff(at))
                digests = [xxhash.xxh3_128_digest(h[lo:hi].data) for lo, hi in itertools.pairwise(at.tolist())]
                keys = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                prefixes = make.ordered(h, at, np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0))
                own = h % np.uint64(part) == 0
                sketches = h[own], np.append(0, np.cumsum(own))[at]
                odd = np.bincount(text * PARITY + ((h >> np.uint64(32)) % np.uint64(PARITY)).astype(np.int64), minlength=len(texts) * PARITY) & 1
                parities = np.packbits(odd.astype(bool)).view(np.uint64), np.arange(len(texts) + 1) * (PARITY // 64)
                rows_ = b.column("row").slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([rows_, pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(*prefixes), _lists(*sketches), _lists(*parities)], ["row", "n", "set1", "set2", "prefix", "sketch", "parity"])

    return rows.mapInArrow(signed, "row binary, n long, set1 long, set2 long, prefix array<long>, sketch array<long>, parity array<long>")


#: Bits of the map of rows whose sets are wanted: eight for each, within these bounds.
_BITS = (1 << 16, 1 << 27)


def _sets(rows: DataFrame, wanted: DataFrame, shingler) -> DataFrame:
    """(row, hashes) of at least the wanted rows. A bit map of fixed greatest size goes to all tasks and spares most other
    rows; it decides nothing, since an exact join follows."""
    sc = rows.sparkSession.sparkContext
    n = wanted.count()
    bits = min(max(1 << (8 * n).bit_length(), _BITS[0]), _BITS[1])
    place = F.pmod(F.xxhash64("row"), F.lit(bits))
    words = wanted.groupBy(F.floor(place / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))).alias("mask")).toPandas()
    bitmap = np.zeros(bits // 32, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    known = sc.broadcast(bitmap.astype(np.uint32))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("place").to_numpy()
            b = b.filter(pa.array((known.value[at // 32] >> (at % 32).astype(np.uint32) & 1) == 1))
            done = 0
            for texts in _blocks(b.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column("row").slice(done, len(texts)), _lists(*shingler.value(texts))], ["row", "hashes"])
                done += len(texts)

    return rows.withColumn("place", place).mapInArrow(made, "row binary, hashes array<long>")


def _fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _near(x: str, y: str, percent: int) -> Column:
    """Whether sets of sizes n_* whose first common n-gram stands at pos_* can link."""
    n_x, at_x, n_y, at_y = (F.col(f"{c}_{s}") for s in (x, y) for c in ("n", "pos"))
    apart = at_x + at_y + F.abs((n_x - at_x) - (n_y - at_y))
    return apart * (100 + percent) <= (n_x + n_y) * (100 - percent)


def _even(x: str, y: str, percent: int) -> Column:
    """Whether sets of the parities parity_* can link; true where one isn't known."""
    apart = sum((F.bit_count(F.get(f"parity_{x}", F.lit(i)).bitwiseXOR(F.get(f"parity_{y}", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    return F.coalesce(apart * (100 + percent) <= (F.col(f"n_{x}") + F.col(f"n_{y}")) * (100 - percent), F.lit(True))


def _alike(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(a, b, total, apart) of distinct pairs (a, b), without those that sizes or sketches rule out."""
    side = lambda x: signs.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.size("s_a") + F.size("s_b") - 2 * F.size(F.array_intersect("s_a", "s_b"))
    total = F.col("n_a") + F.col("n_b")
    return stored(both.where(_fits(F.col("n_a"), F.col("n_b"), percent) & (apart * (100 + percent) <= total * (100 - percent))).select("a", "b", total.alias("total"), (apart / total).alias("apart")))


def _verified(left: DataFrame, rows: DataFrame, shingler, percent: int) -> DataFrame:
    """Of pairs (a, b, total, apart), those that link."""
    involved = stored(left.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    sets = stored(_sets(rows, involved, shingler).join(involved, "row", "left_semi"))
    whole = left.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("h_a")), "a").join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("h_b")), "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    return stored(whole.where(common * 100 >= (F.col("total") - common) * percent).select("a", "b"))


def _divided(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose labels differ; a row that has no label is its own."""
    for side in "ab":
        known = labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}"))
        pairs = pairs.join(known, side, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """df's id and row key with n_shingles, component_id, the least id that links lead to, and whether the row is that one."""
    part = 8 if percent >= 90 else 4
    docs = df.select(F.col(f"`{id_col}`").alias("id"), _key(f"`{id_col}`", f"`{text_col}`").alias("row"), bytes_of(F.col(f"`{text_col}`")).alias("text"))
    rows = docs.select("row", "text")
    shingler = df.sparkSession.sparkContext.broadcast(Shingler(words, _counts(rows, words, COUNTERS)))
    signs = stored(_signatures(rows, shingler, percent, part))
    light = signs.where("n > 0").select("row", "n", "set1", "set2", "parity", F.xxhash64("n", "prefix").alias("group"))
    copies = stored(light.groupBy("set1", "set2", "n", "group").agg(F.min("row").alias("row"), F.first("parity").alias("parity")))
    equal = light.join(copies.select("set1", "set2", "n", F.col("row").alias("a")), ["set1", "set2", "n"]).select("a", F.col("row").alias("b")).where("a != b")
    firsts = copies.select("row", "n", "group", "parity")
    heads = stored(firsts.groupBy("group").agg(F.min("row").alias("row"), (F.count("*") == 1).alias("alone")))
    prefixes = stored(signs.select("row", "n", "prefix").join(heads, "row").select("group", "n", "alone", "prefix"))
    grams = prefixes.select("group", "n", "alone", F.posexplode("prefix").alias("pos", "gram"))
    # N-grams that several groups share, by runs of sizes; the group of each run that has it foremost is its pivot.
    by_size, by_run = W.partitionBy("gram").orderBy("n"), W.partitionBy("gram", "run")
    gap = F.coalesce(F.lag("n").over(by_size) * 100 < F.col("n") * percent, F.lit(False))
    runs = grams.withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(by_size.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    shared = stored(
        runs.withColumns({"p": F.min(F.struct("pos", "group", "n", "alone")).over(by_run), "many": F.count("*").over(by_run)})
        .where("many > 1").select("gram", "run", "group", "n", "pos", "many", F.col("p.group").alias("pivot"), F.col("p.n").alias("n_p"), F.col("p.pos").alias("pos_p"), F.col("p.alone").alias("alone"))
    )
    met = shared.where("group != pivot").withColumnsRenamed({"n": "n_g", "pos": "pos_g"}).where(_near("g", "p", percent)).select("group", "pivot").distinct()
    first_of = heads.select(F.col("group").alias("pivot"), F.col("row").alias("a"))
    member = firsts.select("group", F.col("row").alias("b"))
    across = met.join(first_of, "pivot").join(member, "group").select("a", "b")
    within = heads.withColumnRenamed("row", "a").join(member, "group").select("a", "b").where("a != b")
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = stored(ordered(across.unionByName(within)))
    alike = _alike(tried, signs, percent)
    # One pair of each document; the others of it only if that leaves their classes apart.
    once = alike.groupBy("b").agg(F.min(F.struct("apart", "a", "total")).alias("p")).select("p.a", "b", "p.total")
    links = _verified(stored(once), rows, shingler, percent)
    others = stored(_divided(alike.join(once.select("a", "b"), ["a", "b"], "left_anti"), components(links)))
    links = stored(links.unionByName(_verified(others, rows, shingler, percent)))
    # What is left: pairs of one n-gram or of one group whose classes differ.
    so_far = components(links)
    placed = stored(firsts.join(so_far, firsts["row"] == so_far["node"], "left").select("row", "n", "group", "parity", F.coalesce("label", "row").alias("class")))
    # The parity of a group's members of one class, if they all have the same.
    alike_in = placed.groupBy("group", "class").agg(F.min("parity").alias("parity"), F.max("parity").alias("other")).select("group", "class", F.when(F.col("parity") == F.col("other"), F.col("parity")).alias("parity"))
    # A pivot that is one row has met all of its run.
    unmet = shared.where((F.col("many") > 2) & (F.col("group") != F.col("pivot")) | ~F.col("alone"))
    kinds = unmet.join(alike_in, "group").select("gram", "run", "group", "n", "pos", "class", "parity")
    mixed = kinds.groupBy("gram", "run").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("gram", "run")
    kinds = stored(kinds.join(mixed, ["gram", "run"]))
    x, y = (kinds.select("gram", "run", *(F.col(c).alias(f"{c}_{s}") for c in ("group", "n", "pos", "class", "parity"))) for s in "xy")
    apart = x.join(y, ["gram", "run"]).where((F.col("class_x") < F.col("class_y")) & (F.col("group_x") != F.col("group_y")) & _near("x", "y", percent) & _even("x", "y", percent)).select("group_x", "class_x", "group_y", "class_y").distinct()
    # Members of one group need no shared n-gram. Sets of one size that aren't equal differ in two n-grams at least.
    own = alike_in.join(placed.where(F.col("n") * (100 - percent) >= 100 + percent).select("group", "n").distinct(), "group")
    split = own.groupBy("group").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("group")
    own = stored(own.join(split, "group"))
    u, v = (own.select("group", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "parity"))) for s in "xy")
    inside = u.join(v, "group").where((F.col("class_x") < F.col("class_y")) & _even("x", "y", percent)).select(F.col("group").alias("group_x"), "class_x", F.col("group").alias("group_y"), "class_y")
    apart = apart.unionByName(inside)
    who = lambda s, out: placed.select(F.col("group").alias(f"group_{s}"), F.col("class").alias(f"class_{s}"), F.col("row").alias(out))
    rest = ordered(apart.join(who("x", "a"), ["group_x", "class_x"]).join(who("y", "b"), ["group_y", "class_y"]).select("a", "b"))
    more = _verified(_alike(rest.join(tried, ["a", "b"], "left_anti"), signs, percent), rows, shingler, percent)
    final = components(links.unionByName(more).unionByName(equal))
    ids = docs.select("id", "row").join(signs.select("row", "n").distinct(), "row").join(final, F.col("row") == F.col("node"), "left").select("id", "row", "n", F.coalesce("label", "row").alias("label"))
    first = ids.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return ids.join(first, "label").select(F.col("id").alias(id_col), "row", F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("is_first"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """df's rows with the least id of their class, one of each class; rows without a set are classes of their own."""
    kept = classes(df, id_col, text_col, words, percent).where("is_first").select("row").distinct()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"), _key(f"`{id_col}`", f"`{text_col}`").alias("row"))
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
