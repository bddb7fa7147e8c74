"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r: how often the mix takes it. Among all rates up to `cap` that meet the constraints, the mix
takes those nearest to 1 in entropy, sum of size * (r log r - r + 1). The constraints are the tokens of each source (its
target) and the length of documents: the mean of log size over the mix's tokens stays the corpus's, so that a source of
short documents doesn't shorten the mix. Rates are then exponentially tilted, r = min(cap, exp(lambda of the source + mu *
g)), g being the log size less its mean. The dual is convex in all lambdas and mu together. Each Newton step is one
distributed aggregation over the classes of documents that agree in source and size (gradient, and the Hessian's
diagonal and border); only these sums, one row a source, reach the driver. The length constraint is softened by `ridge`,
so the dual has a solution where sizes leave no room; tokens of a source hold to `tolerance`.

Rates are rounded into whole copies by carrying the rounding error from the largest documents of a source to the
smallest, so a source's words miss its target by no more than about half of its smallest documents.

Sources are ordered by code point, null last, and weigh `weights`, repeating. Targets share all tokens by weight, none
above `cap` times its source's tokens, the excess shared again by weight among the others. A null text has size 0 and
takes 0; a source without words has target 0; an empty table stays empty. Each row is a document of its own: repeated
rows and null ids are rounded one by one. Rounding depends on the id's hash, so it is the same in each run; rows that
agree in id, source and size are interchangeable. Column names of the input may be any; those of `carry` are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3.0
#: Documents of one source and size are dealt to so many parts before they are ranked.
SALTS = 64


def with_size(df: DataFrame, text_col: str = "text", out: str = "size") -> DataFrame:
    """Adds the number of words."""
    return df.withColumn(out, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: Iterable[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> list[tuple[str | None, int, float]]:
    """(source, tokens, target) of each source, in order. Water-filling: who would be above the cap stops there."""
    rows = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = [float(weights[k % len(weights)]) for k in range(len(rows))]
    target, free, left = [0.0] * len(rows), {k for k, r in enumerate(rows) if r[1]}, float(sum(r[1] for r in rows))
    while free:
        unit = left / sum(weight[k] for k in free)
        over = {k for k in free if unit * weight[k] > cap * rows[k][1]}
        for k in over or free:
            target[k] = cap * rows[k][1] if over else unit * weight[k]
        if not over:
            break
        left, free = max(0.0, left - sum(target[k] for k in over)), free - over
    return [(*r, t) for r, t in zip(rows, target, strict=True)]


def _tilt(cap: float):
    free = F.exp(F.col("lambda") + F.col("mu") * F.col("g"))
    return F.least(free, F.lit(cap)), free < cap


def rates(classes: DataFrame, aims: DataFrame, cap: float = CAP, ridge: float = 0.1, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """Adds rate to classes (key, size above 0, n), given aims (key, tokens, target). Steps are damped."""
    spark = classes.sparkSession
    known = aims.where("tokens > 0").orderBy("key").toPandas()  # one row a source
    keys, target = known["key"].tolist(), known["target"].to_numpy(float)
    total = float(known["tokens"].sum())
    mean = classes.agg(F.sum(F.col("n") * F.col("size") * F.log("size"))).head()[0] or 0.0
    sized = classes.withColumn("g", F.log("size") - F.lit(mean / max(total, 1.0)))
    # A source whose target is its cap takes all it can: no tilt moves it.
    full = target >= cap * known["tokens"].to_numpy(float) * (1 - 1e-12)
    at, mu = np.where(full, 60.0, np.log(np.maximum(target, 1e-300) / known["tokens"].to_numpy(float))), 0.0

    def tilted() -> DataFrame:
        found = spark.createDataFrame([(k, float(x), mu) for k, x in zip(keys, at, strict=True)], "key int, `lambda` double, mu double")
        return sized.join(found, "key")

    for _ in range(steps if keys else 0):
        rate, inside = _tilt(cap)
        w = F.col("n") * F.col("size") * rate
        free = F.when(inside, w).otherwise(0.0)
        sums = tilted().groupBy("key").agg(F.sum(w).alias("a"), F.sum(free).alias("h"), F.sum(w * F.col("g")).alias("b"), F.sum(free * F.col("g")).alias("c"), F.sum(free * F.col("g") ** 2).alias("d"))
        s = sums.orderBy("key").toPandas()
        h, c = s["h"].to_numpy(float), s["c"].to_numpy(float)
        up = np.where(full, 0.0, target - s["a"].to_numpy(float))
        up_mu = -s["b"].sum() - ridge * total * mu
        if (np.abs(up) <= tolerance * target).all() and abs(up_mu) <= 1e-6 * total:
            break
        inverse = np.where(h > 0, 1 / np.maximum(h, 1e-300), 0.0)
        step_mu = (up_mu - (c * inverse * up).sum()) / max(s["d"].sum() + ridge * total - (c * c * inverse).sum(), 1e-12)
        step = np.where(h > 0, (up - c * step_mu) * inverse, np.where(up < 0, -1.0, 0.0))
        damp = min(1.0, 2.0 / max(1e-12, np.abs(step).max(), abs(step_mu)))
        at, mu = at + np.where(full, 0.0, damp * step), float(mu + damp * step_mu)
    return tilted().withColumn("rate", _tilt(cap)[0]).drop("lambda", "mu", "g")


def _carry(group: pd.DataFrame) -> pd.DataFrame:
    """Copies beyond the whole ones, for each size of one source, largest first; what is missed goes on to the next."""
    group = group.sort_values("size", ascending=False)
    missed, extra = 0.0, []
    for size, n, part in zip(group["size"], group["n"], group["part"], strict=True):
        want = missed + part * size * n
        take = min(n, max(0, round(want / size)))
        missed = want - take * size
        extra.append(take)
    return group.assign(extra=extra)[["key", "size", "extra"]]


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: Sequence[float] = WEIGHTS, cap: float = CAP, carry: Sequence[str] = ()) -> DataFrame:
    """Returns (id, size, source_size, target, rate, copies, taken), or with carry these columns of df and copies; one row
    for each row of df.

    The sources' sums go through the driver: one row for each source. Groups given to one task hold one row for each
    distinct size of a source, not its documents."""
    spark = df.sparkSession
    name = lambda c: F.col(f"`{c}`")
    docs = df.select(
        name(id_col).alias("id"), name(source_col).alias("source"), name(size_col).alias("size"),
        F.xxhash64(name(id_col).cast("string")).alias("hash"), F.struct(*map(name, carry or [id_col])).alias("doc"),
    )
    docs = (docs if carry else stored(docs)).withColumn("salt", F.pmod("hash", F.lit(SALTS)))
    parts = stored(docs.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    sums = parts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens")).toPandas()
    aims = targets([(None if pd.isna(s) else s, int(t)) for s, t in zip(sums["source"], sums["tokens"], strict=True)], weights, cap)
    aims = stored(spark.createDataFrame([(k, *a) for k, a in enumerate(aims)], "key int, of string, tokens long, target double"))
    keyed = lambda rows: rows.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    sized = stored(keyed(parts).where("size > 0").select("key", "size", "salt", "n"))
    classes = stored(rates(sized.groupBy("key", "size").agg(F.sum("n").alias("n")), aims, cap))
    extra = classes.withColumn("part", F.col("rate") - F.floor("rate")).groupBy("key").applyInPandas(_carry, "key int, size long, extra long")
    # The extra copies of one size go to its parts in order of salt, then to the smallest hashes of a part.
    before = W.partitionBy("key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    quota = (
        sized.join(classes.select("key", "size", "rate").join(extra, ["key", "size"]), ["key", "size"])
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("key", "size", "salt", "rate", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota"))
    )
    rank = F.row_number().over(W.partitionBy("key", "size", "salt").orderBy("hash", "id"))
    placed = keyed(docs).withColumn("rank", rank).join(quota, ["key", "size", "salt"], "left")
    copies = F.floor("rate") + (F.col("rank") <= F.col("quota")).cast("long")
    out = placed.withColumns({"rate": F.coalesce("rate", F.lit(0.0)), "copies": F.least(F.coalesce(copies, F.lit(0)), F.lit(int(cap))).cast("int")})
    if carry:
        return out.select(*(F.col(f"doc.`{c}`").alias(c) for c in carry), "copies")
    return out.select(F.col("id").alias(id_col), F.col("size").alias(size_col), F.col("tokens").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
