"""Boosted trees for several classes: softmax gradients, histograms of gradients summed by Spark, and Shapley values of the trees.

One level of a round's trees, for all classes at once, is one pass over the rows' bins that counts by (class, node, feature, bin) in
arrays, which tasks sum. Only these sums, whose number depends on the parameters alone, and the trees reach the driver. Gradients are summed as whole numbers of a fixed
fraction, so sums and trees don't depend on the order of rows or on partitions. Margins are stored every few rounds.

A row without a value for a feature goes the way that gained more in training. Attributions are the exact Shapley values of each
tree under its own covers: each leaf is a row of a path table (class, value, bounds and share of cover by feature), and sums over the
paths of a row's class give its values. They sum to the margin less the mean under the covers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import scratch, stored, summed


@dataclass(frozen=True)
class Boosting:
    rounds: int = 100
    depth: int = 3
    rate: float = 0.05
    l2: float = 1.0
    least_hessian: float = 1.0
    least_gain: float = 1e-6
    bins: int = 256
    store_every: int = 10


@dataclass
class Trees:
    """Complete binary trees as arrays (rounds, classes, nodes): node n has the children 2n and 2n + 1, the root is 1. A node
    without a split has split -1 and sends rows left. Rows with x < cut go left."""

    features: tuple[str, ...]
    split: np.ndarray
    cut: np.ndarray
    missing_right: np.ndarray
    value: np.ndarray  # of the leaves below the last level, left to right
    cover: np.ndarray  # hessian of nodes and leaves, 2n and 2n + 1 as above

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.split.shape


# --- trees as column expressions --------------------------------------------------------------------------------------
def _literal(values: np.ndarray, kind: str) -> str:
    """SQL: an array. It comes as one text, which is folded into a literal, so plans stay small and compiled code is used again."""
    return f"cast(split('{','.join(map(repr, values.ravel().tolist()))}', ',') as array<{kind}>)"


def vector(features: Sequence[str]) -> Column:
    """array<double>; null where a feature is null or not a number."""
    return F.array(*(F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")) for f in features))


# --- training ---------------------------------------------------------------------------------------------------------
def _cuts(data: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Values that begin a bin: quantiles, which of few rows are all values but the least."""
    share = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    row = data.agg(*(F.percentile_approx(F.col("x")[i], share, F.lit(10_000)).alias(str(i)) for i in range(n_features))).first()
    return [np.unique(np.array(row[i] or [], float))[1:] for i in range(n_features)]


def _bin(x: Column, cuts: np.ndarray) -> Column:
    """0 for null, else 1 and one more for each cut up to x."""
    reached = F.size(F.filter(F.expr(_literal(cuts, "double")), lambda c: c <= x)) if len(cuts) else F.lit(0)
    return F.when(x.isNull(), 0).otherwise(1 + reached)


def _best(g: np.ndarray, h: np.ndarray, p: Boosting) -> tuple[int, int, bool, np.ndarray] | None:
    """(feature, bin from which rows go right, whether missing go right, sums (2, 2): g and h left and right) of the best split.
    g, h: whole numbers (features, bins), bin 0 for missing."""
    total = np.stack([g[0].sum(), h[0].sum()])
    left = np.stack([np.cumsum(g[:, 1:], axis=1)[:, :-1], np.cumsum(h[:, 1:], axis=1)[:, :-1]])  # missing right
    left = np.stack([left, left + np.stack([g[:, :1], h[:, :1]])])  # and left
    right = total[None, :, None, None] - left
    unit = 2.0**-_BITS
    score = lambda s: (s[:, 0] * unit) ** 2 / (s[:, 1] * unit + p.l2)
    gain = 0.5 * (score(left) + score(right) - (total[0] * unit) ** 2 / (total[1] * unit + p.l2))
    ok = (left[:, 1] * unit >= p.least_hessian) & (right[:, 1] * unit >= p.least_hessian)
    gain = np.where(ok, gain, -1.0)
    at = int(np.argmax(gain)) if gain.size else -1
    if at < 0 or gain.ravel()[at] <= p.least_gain:
        return None
    side, f, b = np.unravel_index(at, gain.shape)
    return int(f), int(b) + 2, side == 0, np.stack([left[side, :, f, b], right[side, :, f, b]])


#: Rows of a task in training.
ROWS = 50_000
#: Gradients are whole numbers of 2 ** -_BITS: sums of 2 ** 29 weighted rows of weight 1 fit into a long.
_BITS = 32


def fit(rows: DataFrame, features: Sequence[str], label: str = "label", weight: str = "weight", classes: int = 3, params: Boosting = Boosting()) -> Trees:
    """Rows without a label take no part; a missing weight is 1. Without rows all margins are 0."""
    with scratch(rows.sparkSession):
        return _fit(rows, tuple(features), label, weight, classes, params)


def _fit(rows: DataFrame, features: tuple[str, ...], label: str, weight: str, classes: int, p: Boosting) -> Trees:
    size, n = 1 << p.depth, len(features)
    data = stored(rows.where(F.col(label).isNotNull()).select(vector(features).alias("x"), F.col(label).cast("int").alias("y"), F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("w")))
    cuts = _cuts(data, n, p.bins)
    width = max((len(c) for c in cuts), default=0) + 2
    bins = F.array(*(_bin(F.col("x")[i], c) for i, c in enumerate(cuts)))
    parts = -(-data.count() // ROWS)
    data = stored(data.select("y", "w", bins.alias("bins"), F.array_repeat(F.lit(0.0), classes).alias("m")).repartition(max(1, parts)))
    made: list[tuple[np.ndarray, ...]] = []
    done = 0

    def trees(part: list[tuple[np.ndarray, ...]]) -> Trees:
        if not part:
            empty = np.zeros((0, classes, size))
            return Trees(features, empty.astype(int), empty, empty.astype(bool), empty, np.zeros((0, classes, 2 * size)))
        return Trees(features, *(np.stack([t[i] for t in part]) for i in range(5)))

    def added() -> DataFrame:
        """The rows with the margins of the trees that they lack."""
        new = tuple(made[done:])

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _moved(b, new, n, classes)
                ends = pa.array(np.arange(len(m) + 1) * classes, pa.int32())
                yield b.set_column(b.schema.get_field_index("m"), "m", pa.ListArray.from_arrays(ends, pa.array(m.ravel())))

        return data.mapInArrow(moved, data.schema)

    for r in range(p.rounds):
        if r - done == p.store_every:
            data, done = stored(added()), r
        now = tuple(np.full((classes, size), v) for v in (-1, 0.0, False, 0.0)) + (np.zeros((classes, 2 * size)), np.zeros((classes, size), int))
        split, cut, miss, value, cover, bound = now
        sums = np.zeros((classes, 2 * size, 2))
        open_ = {(k, 1) for k in range(classes)}
        for level in range(p.depth):
            if not open_:
                break
            g, h = _histograms(data, tuple(made[done:]), now, level, sorted(open_), classes, n, width)
            grown = set()
            for i, (k, node) in enumerate(sorted(open_)):
                if level == 0:
                    sums[k, 1] = g[i, 0].sum(), h[i, 0].sum()
                if (found := _best(g[i], h[i], p)) is None:
                    continue
                f, b, right, parts = found
                split[k, node], cut[k, node], miss[k, node], bound[k, node] = f, cuts[f][b - 2], right, b
                sums[k, 2 * node], sums[k, 2 * node + 1] = parts
                grown |= {(k, 2 * node), (k, 2 * node + 1)}
            open_ = grown
        unit = 2.0**-_BITS
        for k in range(classes):
            for node in range(1, size):  # a node without a split is its own left child
                if split[k, node] < 0:
                    sums[k, 2 * node] = sums[k, node]
            leaves = sums[k, size:] * unit
            value[k] = -p.rate * leaves[:, 0] / (leaves[:, 1] + p.l2)
            cover[k] = sums[k, :, 1] * unit
        made.append(now)
        if (split < 0).all() and not np.abs(value).any():
            break  # no rows
    return trees(made)


def _bins(b: pa.RecordBatch, n_features: int) -> np.ndarray:
    return b.column("bins").flatten().to_numpy().reshape(-1, n_features)


def _reached(bins: np.ndarray, tree: tuple[np.ndarray, ...], k: int, steps: int) -> np.ndarray:
    """The node that each row reaches in `steps` steps of class k's tree, by bins: those of a cut and above begin at its bound."""
    split, _, miss, _, _, bound = (part[k] for part in tree)
    node = np.ones(len(bins), np.int64)
    for _ in range(steps):
        f = split[node].astype(int)
        at = bins[np.arange(len(bins)), np.maximum(f, 0)]
        node = 2 * node + ((f >= 0) & np.where(at == 0, miss[node].astype(bool), at >= bound[node]))
    return node


def _moved(b: pa.RecordBatch, new: Sequence[tuple[np.ndarray, ...]], n_features: int, classes: int) -> np.ndarray:
    """(rows, classes): margins with those of new trees."""
    m, bins = b.column("m").flatten().to_numpy().reshape(-1, classes).copy(), _bins(b, n_features)
    for tree in new:
        size = tree[0].shape[1]
        for k in range(classes):
            m[:, k] += tree[3][k][_reached(bins, tree, k, size.bit_length() - 1) - size]
    return m


def _histograms(data: DataFrame, new: tuple, now: tuple[np.ndarray, ...], level: int, nodes: list[tuple[int, int]], classes: int, n_features: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and hessians (nodes, features, bins) as whole numbers."""
    slot = np.full((classes, now[0].shape[1]), -1)
    for i, (k, node) in enumerate(nodes):
        slot[k, node] = i
    scale, low, cells = float(1 << _BITS), 20, len(nodes) * n_features * width

    def counted(b: pa.RecordBatch) -> np.ndarray:
        m, bins, y, w = _moved(b, new, n_features, classes), _bins(b, n_features), b.column("y").to_numpy(), b.column("w").to_numpy()
        e = np.exp(m - m.max(1, keepdims=True))
        chance = e / e.sum(1, keepdims=True)
        out = np.zeros((2, cells), np.int64)
        for k in range(classes):
            own = slot[k, _reached(bins, now, k, level)]
            at = ((own[:, None] * n_features + np.arange(n_features)) * width + bins)[own >= 0].ravel()
            p = chance[:, k]
            for i, v in enumerate(((p - (y == k)) * w, np.maximum(2 * p * (1 - p), 1e-16) * w)):
                whole = np.repeat(np.rint(v * scale).astype(np.int64)[own >= 0], n_features)
                # Sums of doubles, exact since both halves stay short.
                for part, shift in ((whole >> low, low), (whole & (1 << low) - 1, 0)):
                    out[i] += np.bincount(at, part, cells).astype(np.int64) << shift
        return out.ravel()

    found = summed(data, counted, np.int64)
    shape = (2, len(nodes), n_features, width)
    g, h = np.zeros(shape, np.int64) if found is None else found.reshape(shape)
    return g, h


# --- use --------------------------------------------------------------------------------------------------------------
def chances(rows: DataFrame, trees: Trees) -> DataFrame:
    """Adds m (array of margins) and p0, p1, ...: their softmax."""
    classes = trees.shape[1]
    depth = trees.shape[2].bit_length() - 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            m, every = np.zeros((len(x), classes)), np.arange(len(x))
            for split, cut, miss, value in zip(trees.split, trees.cut, trees.missing_right, trees.value, strict=True):
                for k in range(classes):
                    node = np.ones(len(x), np.int64)
                    for _ in range(depth):
                        f = split[k][node].astype(int)
                        v = x[every, np.maximum(f, 0)]
                        node = 2 * node + ((f >= 0) & np.where(np.isnan(v), miss[k][node].astype(bool), v >= cut[k][node]))
                    m[:, k] += value[k][node - len(value[k])]
            ends = pa.array(np.arange(len(m) + 1) * classes, pa.int32())
            yield b.set_column(b.schema.get_field_index("_x"), "m", pa.ListArray.from_arrays(ends, pa.array(m.ravel())))

    kept = [f for f in rows.schema.fields if f.name != "m"]
    with_x = rows.select(*(F.col(f"`{f.name}`") for f in kept), vector(trees.features).alias("_x"))
    out = with_x.mapInArrow(scored, T.StructType([*kept, T.StructField("m", T.ArrayType(T.DoubleType()))]))
    soft = F.transform("m", lambda z: F.exp(z - F.array_max("m")))
    total = F.aggregate(soft, F.lit(0.0), lambda s, z: s + z)
    return out.withColumns({f"p{k}": soft[k] / total for k in range(classes)})


def paths(trees: Trees) -> list[tuple]:
    """A row for each leaf: class, value, and for each of `depth` features: index, bounds [lo, hi), whether missing values pass, and
    the share of cover that stays on the path. Features that come twice are one; index -1 fills up and changes nothing."""
    rounds, classes, size = trees.shape
    depth, out = size.bit_length() - 1, []
    for r, k, leaf in itertools.product(range(rounds), range(classes), range(size)):
        found: dict[int, list] = {}
        node, there = 1, True
        for step in range(depth - 1, -1, -1):
            right, f = leaf >> step & 1, int(trees.split[r, k, node])
            if f < 0:
                there &= not right
            else:
                cut, miss = float(trees.cut[r, k, node]), bool(trees.missing_right[r, k, node])
                share = trees.cover[r, k, 2 * node + right] / trees.cover[r, k, node]
                lo, hi, passes, z = found.get(f, (-math.inf, math.inf, True, 1.0))
                found[f] = [max(lo, cut) if right else lo, hi if right else min(hi, cut), passes and miss == bool(right), z * share]
            node = 2 * node + right
        if there:
            filled = [(f, *v) for f, v in sorted(found.items())] + [(-1, -math.inf, math.inf, True, 1.0)] * (depth - len(found))
            out.append((k, float(trees.value[r, k, leaf]), *(x for cell in filled for x in (int(cell[0]), float(cell[1]), float(cell[2]), bool(cell[3]), float(cell[4])))))
    return out


def base_values(trees: Trees) -> list[float]:
    """Each class's mean margin under the covers."""
    depth, out = trees.shape[2].bit_length() - 1, [0.0] * trees.shape[1]
    for row in paths(trees):
        out[row[0]] += row[1] * math.prod(row[6 + 5 * i] for i in range(depth))
    return out


#: Rows of a class whose paths are held at once.
ATTRIBUTED = 256


def attributions(rows: DataFrame, trees: Trees, keys: Sequence[str], class_col: str = "class") -> DataFrame:
    """(keys, class_col, phi: array<double> by feature): Shapley values of the margin of each row's class, row by row; the path table,
    which the parameters bound, goes to the tasks."""
    n, depth = len(trees.features), trees.shape[2].bit_length() - 1
    table = paths(trees)
    by_class = {k: np.array([r[1:] for r in table if r[0] == k], float) for k in range(trees.shape[1])}
    terms = [[(math.factorial(len(inside)) * math.factorial(depth - len(inside) - 1) / math.factorial(depth), inside) for size in range(depth) for inside in itertools.combinations([j for j in range(depth) if j != i], size)] for i in range(depth)]

    def values(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        value, (f, lo, hi, miss, z) = cells[:, 0], (cells[:, 1 + c :: 5] for c in range(5))
        v = x[:, np.maximum(f.astype(int), 0)]
        here = np.where(f < 0, 1.0, np.where(np.isnan(v), miss, (v >= lo) & (v < hi)))
        phi = np.zeros(x.shape)
        for i in range(depth):
            share = 0.0
            for part, inside in terms[i]:
                product = np.full(here.shape[:2], part)
                for j in range(depth):
                    if j != i:
                        product = product * (here[:, :, j] if j in inside else z[:, j])
                share = share + product
            phi += value * (here[:, :, i] - z[:, i]) * share @ (f[:, i][:, None] == np.arange(n))
        return phi

    def attributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            of, phi = np.array([-1 if k is None else k for k in b.column(class_col).to_pylist()], int), np.zeros(x.shape)
            for k, cells in by_class.items():
                own = np.flatnonzero(of == k)
                for lo in range(0, len(own) if len(cells) else 0, ATTRIBUTED):
                    phi[own[lo : lo + ATTRIBUTED]] = values(x[own[lo : lo + ATTRIBUTED]], cells)
            ends = pa.array(np.arange(len(x) + 1) * n, pa.int32())
            yield b.set_column(b.schema.get_field_index("_x"), "phi", pa.ListArray.from_arrays(ends, pa.array(phi.ravel())))

    own = rows.select(*keys, F.col(class_col), vector(trees.features).alias("_x"))
    return own.mapInArrow(attributed, T.StructType([*own.schema.fields[:-1], T.StructField("phi", T.ArrayType(T.DoubleType()))]))


def top_two(df: DataFrame, features: Sequence[str], phi: str = "phi") -> DataFrame:
    """Adds top1, value1, top2, value2: the features of the highest attributions, the later one if tied."""
    order = F.array_sort(F.transform(phi, lambda v, i: F.struct((-v).alias("v"), (-i).alias("i"))))
    name = lambda n: F.get(_names(features), -order[n]["i"])
    return df.withColumns({"top1": name(0), "value1": -order[0]["v"], "top2": name(1), "value2": -order[1]["v"]})


def _names(features: Sequence[str]) -> Column:
    return F.array(*map(F.lit, features))
