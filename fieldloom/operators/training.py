"""Masked reconstruction of feature panels, trained by two nets that teach each other, and the scan that scores parcels by it.

The panel is standardised by a scaler that is fitted once and kept. Parcels are packed once into batches by a hash of their id, a row
for each batch. A step is one pass over the batches: some months of each parcel are hidden by a seeded ranking that depends on the id
alone; both nets reconstruct them; within a batch each net learns from the parcels that the other one reconstructs best. Gradients are
summed in tasks, then by a few tasks, and only their sum, of the nets' size, reaches the driver, which keeps the moments of the descent
and the nets. The net is an encoder and decoder of one hidden layer each way; it stands for a larger network behind the same inputs,
losses and schedule, and its numbers are its own.

A quality that is missing counts as 1 and is held within [0.05, 1]. Null or infinite features count as 0 before scaling. Ids tell
parcels apart. An empty panel trains nothing and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clip_quality
from ..functions.shared import scratch, stored, summed
from .scoring import forget_rate


@dataclass(frozen=True)
class Training:
    mask_ratio: float = 0.25
    noise_rate: float = 0.35
    gradual: int = 30
    epochs: int = 100
    batch: int = 256
    rate: float = 0.01
    decay: float = 1e-5
    hidden: int = 16
    seed: int = 42


# --- scaler and masks -------------------------------------------------------------------------------------------------
def fit_scaler(panel: DataFrame, tensor: str = "t") -> DataFrame:
    """(feature, mean, std) over all parcels and months, with population deviations; a deviation of 0 counts as 1e-8."""
    cells = panel.select(F.explode(tensor).alias("row")).select(F.posexplode("row").alias("feature", "x")).select("feature", _finite(F.col("x")).alias("x"))
    stats = cells.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") == 0, 1e-8).otherwise(F.col("std")))


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(0.0)


def scaled(panel: DataFrame, scaler: DataFrame, tensor: str = "t") -> DataFrame:
    """The panel in standard scores by a scaler, whose rows are one for each feature."""
    rows = sorted(scaler.collect(), key=lambda r: r["feature"])
    mean, std = (F.array(*(F.lit(r[c]) for r in rows)) for c in ("mean", "std"))
    return panel.withColumn(tensor, F.transform(tensor, lambda row: F.transform(row, lambda x, i: (_finite(x) - F.get(mean, i)) / F.get(std, i))))


def hidden_months(key: Column, months: int, ratio: float, seed: int, epoch: int = 0) -> Column:
    """Indices of the max(1, int(months * ratio)) months of a parcel that are hidden: the first by a hash of id, month, seed and
    epoch. None if the ratio is 0."""
    if ratio <= 0:
        return F.array().cast("array<int>")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda m: F.struct(F.xxhash64(key, m, F.lit(seed), F.lit(epoch)).alias("h"), m.cast("int").alias("m"))))
    return F.transform(F.slice(order, 1, max(1, int(months * ratio))), lambda s: s["m"])


# --- nets -------------------------------------------------------------------------------------------------------------
@dataclass
class Net:
    """Weights (inputs, hidden), (hidden,), (hidden, inputs), (inputs,)."""

    parts: list[np.ndarray]

    @classmethod
    def fresh(cls, inputs: int, hidden: int, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        a, b = 1 / np.sqrt(inputs), 1 / np.sqrt(hidden)
        return cls([rng.uniform(-a, a, (inputs, hidden)), np.zeros(hidden), rng.uniform(-b, b, (hidden, inputs)), np.zeros(inputs)])

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.parts[0] + self.parts[1])

    def decoded(self, z: np.ndarray) -> np.ndarray:
        return z @ self.parts[2] + self.parts[3]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def filled(self, values: np.ndarray) -> Net:
        ends = np.cumsum([p.size for p in self.parts])
        return Net([v.reshape(p.shape) for v, p in zip(np.split(values, ends[:-1]), self.parts, strict=True)])


def losses(net: Net, x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each parcel's weighted mean squared error where weight (hidden cells by quality) is above 0, the code and the reconstruction."""
    z = net.encoded(np.where(weight > 0, 0.0, x))
    y = net.decoded(z)
    return ((y - x) ** 2 * weight).sum(1) / (weight.sum(1) + 1e-8), z, y


def gradient(net: Net, x: np.ndarray, weight: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of the mean loss of the chosen parcels, by the net's flat parameters."""
    x, weight = x[chosen], weight[chosen]
    _, z, y = losses(net, x, weight)
    by_y = 2 * (y - x) * weight / (weight.sum(1, keepdims=True) + 1e-8) / max(len(chosen), 1)
    by_z = by_y @ net.parts[2].T * (1 - z**2)
    seen = np.where(weight > 0, 0.0, x)
    return np.concatenate([(seen.T @ by_z).ravel(), by_z.sum(0), (z.T @ by_y).ravel(), by_y.sum(0)])


def exchange(a: Net, b: Net, x: np.ndarray, weight: np.ndarray, forget: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One batch: gradients of both nets, each over the parcels that the other finds easy, and their losses there."""
    loss_a, loss_b = losses(a, x, weight)[0], losses(b, x, weight)[0]
    keep = max(1, int((1 - forget) * len(x)))
    easy_a, easy_b = np.argsort(loss_a, kind="stable")[:keep], np.argsort(loss_b, kind="stable")[:keep]
    return gradient(a, x, weight, easy_b), gradient(b, x, weight, easy_a), float(loss_a[easy_b].mean()), float(loss_b[easy_a].mean())


@dataclass
class Descent:
    """Adam with decoupled weight decay."""

    rate: float
    decay: float
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0
    t: int = 0

    def step(self, values: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        move = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return values * (1 - self.rate * self.decay) - self.rate * move


@dataclass
class Trained:
    net: Net
    months: int
    features: int
    losses: list[tuple[float, float]] = field(default_factory=list)


# --- training ---------------------------------------------------------------------------------------------------------
def batches(panel: DataFrame, size: int, seed: int, key: str = "parcel_id") -> DataFrame:
    """(ids, x, q): about `size` parcels in a row, as 32-bit floats. A batch meets in one task, and nothing larger does."""
    n = max(1, round(panel.count() / size))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        cell = lambda c: np.asarray(group.column(c).combine_chunks().flatten(), "<f4").tobytes()
        return pa.table({"ids": pa.array([group.column("id").to_pylist()], pa.list_(pa.string())), "x": pa.array([cell("x")], pa.binary()), "q": pa.array([cell("q")], pa.binary())})

    flat = panel.select(F.col(key).cast("string").alias("id"), F.flatten("t").alias("x"), F.transform("q", lambda v: clip_quality(v)).alias("q"))
    placed = flat.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)))
    return placed.groupBy("batch").applyInArrow(packed, "ids array<string>, x binary, q binary")


def _weights(hidden: list[list[int]], q: np.ndarray, features: int) -> np.ndarray:
    mask = np.zeros(q.shape)
    for i, months in enumerate(hidden):
        mask[i, months] = 1.0
    return np.repeat(mask * q, features, axis=1)


def _epoch(table: DataFrame, a: Net, b: Net, months: int, features: int, p: Training, epoch: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Means over batches of gradients and losses."""
    forget = forget_rate(epoch, p.noise_rate, p.gradual)
    sent = table.sparkSession.sparkContext.broadcast((a, b))

    def stepped(part: pa.RecordBatch) -> np.ndarray:
        net_a, net_b = sent.value
        total = 0.0
        for x, q, hidden in zip(part.column("x").to_pylist(), part.column("q").to_pylist(), part.column("hidden").to_pylist(), strict=True):
            x = np.frombuffer(x, "<f4").reshape(-1, months * features).astype(float)
            weight = _weights(hidden, np.frombuffer(q, "<f4").reshape(-1, months).astype(float), features)
            grad_a, grad_b, loss_a, loss_b = exchange(net_a, net_b, x, weight, forget)
            total = total + np.concatenate([[1.0, loss_a, loss_b], grad_a, grad_b])
        return total

    hide = F.transform("ids", lambda i: hidden_months(i, months, p.mask_ratio, p.seed, epoch))
    sums = summed(table.select("x", "q", hide.alias("hidden")), stepped)
    sent.unpersist()
    grad_a, grad_b = np.split(sums[3:] / sums[0], 2)
    return grad_a, grad_b, float(sums[1] / sums[0]), float(sums[2] / sums[0])


def train(panel: DataFrame, params: Training = Training(), key: str = "parcel_id") -> Trained | None:
    """The first net as it was when its loss was least. panel: (key, t: months of features in standard scores, q: quality by month)."""
    p = params
    first = panel.select(F.size("t").alias("m"), F.size(F.col("t")[0]).alias("f")).head()
    if first is None:
        return None
    months, features = first
    with scratch(panel.sparkSession):
        table = stored(batches(panel, p.batch, p.seed, key))
        a, b = (Net.fresh(months * features, p.hidden, p.seed + k) for k in (0, 1))
        down_a, down_b = Descent(p.rate, p.decay), Descent(p.rate, p.decay)
        best, seen = a, []
        for epoch in range(p.epochs):
            grad_a, grad_b, loss_a, loss_b = _epoch(table, a, b, months, features, p, epoch)
            if not seen or loss_a < min(x for x, _ in seen):
                best = a
            seen.append((loss_a, loss_b))
            a, b = a.filled(down_a.step(a.flat(), grad_a)), b.filled(down_b.step(b.flat(), grad_b))
    return Trained(best, months, features, seen)


# --- scan -------------------------------------------------------------------------------------------------------------
def scan(panel: DataFrame, model: Trained | None, zeroed: tuple[int, int] = (43, 46), low_quality: float = 0.5, key: str = "parcel_id") -> DataFrame:
    """(key, mse, mean_quality, low_quality_months): the error of reconstructing a whole panel whose features in `zeroed` (first, end)
    are 0 in the input and still count in the error, weighted by quality. Without a model mse is null."""
    if model is None:
        q = F.transform("q", lambda v: clip_quality(v))
        mean = F.aggregate(q, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("q"), F.lit(0))
        return panel.select(key, F.lit(None).cast("double").alias("mse"), mean.alias("mean_quality"), F.size(F.filter(q, lambda v: v < low_quality)).cast("long").alias("low_quality_months"))
    sent = panel.sparkSession.sparkContext.broadcast(model)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in it:
            x = np.asarray(part.column("x").flatten(), float).reshape(-1, m.months, m.features)
            q = np.asarray(part.column("q").flatten(), float).reshape(-1, m.months)
            seen = x.copy()
            seen[:, :, zeroed[0] : zeroed[1]] = 0.0
            y = m.net.decoded(m.net.encoded(seen.reshape(len(x), -1))).reshape(x.shape)
            mse = ((y - x) ** 2 * q[:, :, None]).sum((1, 2)) / (q.sum(1) * m.features + 1e-8)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(mse), pa.array(q.mean(1)), pa.array((q < low_quality).sum(1), pa.int64())], [key, "mse", "mean_quality", "low_quality_months"])

    flat = panel.select(F.col(key).alias("key"), F.flatten("t").alias("x"), F.transform("q", lambda v: clip_quality(v)).alias("q"))
    kind = panel.schema[key].dataType.simpleString()
    return flat.mapInArrow(scored, f"`{key}` {kind}, mse double, mean_quality double, low_quality_months long")


# --- as tables --------------------------------------------------------------------------------------------------------
def as_table(spark: SparkSession, model: Trained) -> DataFrame:
    """(part, shape, values, months, features): the nets' weights, for `sources.models.save`."""
    rows = [(i, list(map(int, w.shape)), w.ravel().tolist(), model.months, model.features) for i, w in enumerate(model.net.parts)]
    return spark.createDataFrame(rows, "part int, shape array<int>, values array<double>, months int, features int")


def from_table(table: DataFrame) -> Trained:
    rows = sorted(table.collect(), key=lambda r: r["part"])
    return Trained(Net([np.array(r["values"]).reshape(r["shape"]) for r in rows]), rows[0]["months"], rows[0]["features"])


