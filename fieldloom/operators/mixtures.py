"""Gaussian mixtures by expectation and maximisation, with all numbers of components and all starts in one aggregate a step.

A step sums, for each component of each run that hasn't converged, the soft counts, the weighted means and the weighted outer
products of the points, in one pass over the table; the driver gets these sums alone and sets the parameters. Runs begin with hard
steps from points chosen by a seeded hash of their key, which doesn't depend on partitions. Responsibilities come from log densities
by log-sum-exp, covariances get a ridge, the number of components is the one of least BIC, and it is fitted again with more starts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import scratch, stored, summed

#: Steps that move centres alone before covariances are fitted.
HARD = 5


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    bound: float = -math.inf  # mean log likelihood of the points
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.weights)

    def whitening(self) -> np.ndarray:
        """(k, d, d): P with P P' the inverse covariance; it turns a component into a standard normal one."""
        return np.stack([np.linalg.inv(np.linalg.cholesky(c)).T for c in self.covariances])

    def parameters(self) -> int:
        d = self.means.shape[1]
        return self.k * d * (d + 1) // 2 + self.k * d + self.k - 1

    def bic(self, n: int) -> float:
        return self.parameters() * math.log(n) - 2 * self.bound * n


def _literal(values: Iterable[float], kind: str = "double") -> Column:
    return F.split(F.lit(",".join(map(repr, map(float, values) if kind == "double" else map(int, values)))), ",").cast(f"array<{kind}>")


def _affine(runs: Sequence[Mixture], hard: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each run: matrices (k, d, d) and shifts (k, d) that make its components standard normal ones, and log levels (k)."""
    d = runs[0].means.shape[1]
    white = [np.broadcast_to(np.eye(d), (m.k, d, d)) if hard else m.whitening() for m in runs]
    shift = [np.einsum("ki,kij->kj", m.means, p) for m, p in zip(runs, white, strict=True)]
    level = [np.zeros(m.k) if hard else np.log(np.maximum(m.weights, 1e-300)) + np.log(np.diagonal(p, axis1=1, axis2=2)).sum(1) - d / 2 * math.log(2 * math.pi) for m, p in zip(runs, white, strict=True)]
    return white, shift, level


def with_responsibilities(df: DataFrame, vector: str, runs: Sequence[Mixture], hard: bool = False) -> DataFrame:
    """Adds runs: array<struct<q, lse, r>>, for each run the log density of the point and the responsibility of each component; if
    hard, 1 for the nearest centre and 0 for the others."""
    d = runs[0].means.shape[1]
    white, shift, level = _affine(runs, hard)
    first = np.concatenate(([0], np.cumsum([m.k for m in runs])))
    tables = {"_p": np.concatenate(white).ravel(), "_b": np.concatenate(shift).ravel(), "_l": np.concatenate(level)}
    cell = f"aggregate(sequence(0, {d - 1}), -get(_b, c * {d} + j), (u, i) -> u + get(`{vector}`, i) * get(_p, (c * {d} + i) * {d} + j))"
    squares = f"aggregate(transform(sequence(0, {d - 1}), j -> {cell}), 0D, (s, y) -> s + y * y)"
    density = f"transform(sequence(get(_first, q), get(_first, q + 1) - 1), c -> get(_l, c) - 0.5D * {squares})"
    total = "array_max(z) + ln(aggregate(transform(z, y -> exp(y - array_max(z))), 0D, (s, e) -> s + e))"
    share = "transform(z, (y, i) -> if(i + 1 = array_position(z, array_max(z)), 1D, 0D))" if hard else "transform(z, y -> exp(y - lse))"
    run = f"element_at(transform(array({density}), z -> element_at(transform(array({total}), lse -> named_struct('q', q, 'lse', lse, 'r', {share})), 1)), 1)"
    out = df.withColumns({k: _literal(v) for k, v in tables.items()}).withColumn("_first", _literal(first, "int"))
    return out.withColumn("runs", F.expr(f"transform(sequence(0, {len(runs) - 1}), q -> {run})")).drop("_p", "_b", "_l", "_first")


#: Points whose densities under all components are held at once.
POINTS = 2_048


def sums(df: DataFrame, vector: str, runs: Sequence[Mixture], hard: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each run: soft counts (k), sums (k, d), sums of outer products (k, d, d), and the sum of log densities. Batches of points
    are arrays, and a task sends one sum."""
    d = runs[0].means.shape[1]
    white, shift, level = map(np.concatenate, _affine(runs, hard))
    sizes = np.array([m.k for m in runs])
    first, run = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(runs)), sizes)
    matrix = white.transpose(1, 0, 2).reshape(d, -1)

    def part(b: pa.RecordBatch) -> np.ndarray:
        every = np.asarray(b.column("x").flatten(), float).reshape(-1, d)
        total = 0.0
        for lo in range(0, len(every), POINTS):
            x = every[lo : lo + POINTS]
            z = level - 0.5 * (((x @ matrix).reshape(len(x), -1, d) - shift) ** 2).sum(2)
            top = np.maximum.reduceat(z, first, axis=1)
            lse = top + np.log(np.add.reduceat(np.exp(z - top[:, run]), first, axis=1))
            if hard:  # the first of the nearest
                r = np.zeros_like(z)
                for q, k in enumerate(sizes):
                    r[np.arange(len(x)), first[q] + z[:, first[q] : first[q] + k].argmax(1)] = 1.0
            else:
                r = np.exp(z - lse[:, run])
            square = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            total = total + np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ square).ravel(), lse.sum(0)])
        return total

    n = int(sizes.sum())
    found = summed(df.select(F.col(vector).cast("array<double>").alias("x")), part)
    if found is None:
        found = np.zeros(n * (1 + d + d * d) + len(runs))
    count, mean, outer, lse = np.split(found, np.cumsum([n, n * d, n * d * d]))
    mean, outer = mean.reshape(n, d), outer.reshape(n, d, d)
    return [(count[i : i + k], mean[i : i + k], outer[i : i + k], float(v)) for i, k, v in zip(first, sizes, lse, strict=True)]


def updated(before: Mixture, n: np.ndarray, mean: np.ndarray, outer: np.ndarray, ridge: float, least: float = 1e-9) -> Mixture:
    """Parameters of most likelihood for these sums; a component that gets less than `least` points stays where it was."""
    held = n + 10 * np.finfo(float).eps
    centers = mean / held[:, None]
    spread = outer / held[:, None, None] - np.einsum("ki,kj->kij", centers, centers) + ridge * np.eye(mean.shape[1])
    lone = n < least
    centers[lone], spread[lone] = before.means[lone], before.covariances[lone]
    return Mixture(n / n.sum(), centers, spread)


def _starts(points: DataFrame, key: str, vector: str, most: int, starts: Iterable[int], seed: int) -> dict[int, np.ndarray]:
    """For each start its first points, by a hash of the key."""
    out = {}
    for s in starts:
        rows = points.select(vector).orderBy(F.xxhash64(F.lit(seed + s), F.col(key)), key).limit(most).collect()
        out[s] = np.array([r[0] for r in rows], float)
    return out


def fit_all(points: DataFrame, key: str, vector: str, runs: Sequence[tuple[int, int]], seed: int = 42, tolerance: float = 1e-3, steps: int = 100, ridge: float = 1e-6) -> list[Mixture]:
    """runs: (components, start). A run stops when its mean log likelihood moves less than the tolerance."""
    first = _starts(points, key, vector, max(k for k, _ in runs), sorted({s for _, s in runs}), seed)
    now = [Mixture(np.full(k, 1 / k), first[s][:k], np.broadcast_to(np.eye(first[s].shape[1]), (k, first[s].shape[1], first[s].shape[1]))) for k, s in runs]
    for _ in range(HARD):
        for q, (n, mean, outer, _lse) in enumerate(sums(points, vector, now, hard=True)):
            now[q] = updated(now[q], n, mean, outer, ridge)
    open_ = list(range(len(runs)))
    for _ in range(steps):
        if not open_:
            break
        for q, (n, mean, outer, lse) in zip(open_, sums(points, vector, [now[q] for q in open_]), strict=True):
            bound = lse / n.sum()
            moved = updated(now[q], n, mean, outer, ridge)
            moved.bound, moved.converged = bound, abs(bound - now[q].bound) < tolerance
            now[q] = moved
        open_ = [q for q in open_ if not now[q].converged]
    for m, (n, _, _, lse) in zip(now, sums(points, vector, now), strict=True):
        m.bound = lse / n.sum()
    return now


def fit_best(points: DataFrame, key: str, vector: str, ks: range = range(3, 9), starts: int = 5, refit: int = 10, seed: int = 42, **more: float) -> Mixture | None:
    """The mixture of least BIC over ks, each with the best of its starts, fitted again with `refit` starts. Numbers of components
    above the number of points aren't tried; None without points."""
    with scratch(points.sparkSession):
        rows = stored(points.select(key, vector))
        n = rows.count()
        ks = [k for k in ks if k <= n]
        if not ks:
            return None
        tried = fit_all(rows, key, vector, [(k, s) for k in ks for s in range(starts)], seed, **more)
        best = {k: max((m for m in tried if m.k == k), key=lambda m: m.bound) for k in ks}
        k = min(ks, key=lambda k: best[k].bic(n))
        return max([best[k], *fit_all(rows, key, vector, [(k, s) for s in range(starts, refit)], seed, **more)] if refit > starts else [best[k]], key=lambda m: m.bound)


def assign(points: DataFrame, vector: str, mixture: Mixture | None) -> DataFrame:
    """Adds cluster and confidence, the responsibility of the likeliest component to four places; nulls without a mixture. Components
    are in order of their means, so that equal fits have equal numbers."""
    if mixture is None:
        return points.withColumns({"cluster": F.lit(None).cast("int"), "confidence": F.lit(None).cast("double")})
    order = np.lexsort(np.round(mixture.means, 6).T[::-1])
    same = Mixture(mixture.weights[order], mixture.means[order], mixture.covariances[order])
    r = F.col("runs")[0]["r"]
    out = with_responsibilities(points, vector, [same])
    return out.withColumns({"cluster": (F.array_position(r, F.array_max(r)) - 1).cast("int"), "confidence": F.rint(F.array_max(r) * 1e4) / 1e4}).drop("runs")
