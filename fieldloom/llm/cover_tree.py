"""Exact top-k by inner product with dual cover trees.

Rows go to the nearest of at most `centers` centres, a greedy covering of a bounded sample; that is the top of the
candidates' tree, and it only decides which rows lie together: every row is indexed. Rows of one centre are cut by hash
into blocks of about `block_rows`, so a centre that draws a third of all rows becomes many blocks. Queries are blocked
the same way, but centres of few queries share a block: each block of queries reads all candidates once. Each task holds one block of queries and meets candidate blocks one after the other. Both sides have a
cover tree: a node is a centre, its covering radius and children of smaller radius. A pair of nodes is left out when

    q.c + |q| r_c + |c| r_q + r_q r_c

(q, c: centres, r: radii) is below the worst k-th score so far of all queries in the query node. Scores are integers,
ties go to the smaller id; nothing is approximate.

Isotropic vectors of many dimensions lie about as far from each other as from any centre; no ball bound can rule out much
there, and the cost is queries times rows (README has figures). Tasks stay bounded all the same: one holds a block of
queries and about `task_rows` candidates, whatever the numbers of either.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a null id. Shorter
vectors count as padded with zeros. A row never finds rows of its own id. Rows with equal ids are candidates each, and a
repeated query is answered once. With fewer candidates than k all are returned; without queries the result is empty.
Scores are exact: in doubles while they stay below 2**53, in 64-bit integers beyond; vectors whose scores could pass 2**63
raise ValueError, since a long can't hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CENTERS, SAMPLE_ROWS = 48, 4_096
BLOCK_ROWS, QUERY_ROWS, LEAF, TASK_ROWS = 4_096, 256, 64, 65_536
SHRINK = 0.7
#: Parts of a node after which parts of fewer than four rows, on average, end the covering.
PROBED = 8


def _matrix(cells: pd.Series, dim: int, kind: type = np.int64) -> np.ndarray:
    out = np.zeros((len(cells), dim), kind)
    for row, cell in zip(out, cells, strict=True):
        row[: len(cell)] = cell
    return out


@dataclass
class Node:
    center: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node]

    def leaves(self) -> bool:
        return not self.children


def grow(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A cover tree over points (float64): children cover their parent's rows within SHRINK of its radius."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    center = own[np.argmin(((own - own.mean(0)) ** 2).sum(1))]
    radius = float(np.sqrt(((own - center) ** 2).sum(1).max()))
    node = Node(center, float(np.sqrt(center @ center)), radius, rows, [])
    if len(rows) <= leaf or radius == 0:
        return node
    left, parts = np.arange(len(rows)), []
    while len(left):
        near = ((own[left] - own[left[0]]) ** 2).sum(1) <= (SHRINK * radius) ** 2
        parts.append(rows[left[near]])
        left = left[~near]
        # Points too far from each other to cover: a larger leaf. Later parts are seldom larger, so the first ones tell.
        if len(parts) >= PROBED and len(rows) - len(left) < 4 * len(parts) or len(parts) > len(rows) // 4:
            return node
    if len(parts) > 1:
        node.children = [grow(points, p, leaf) for p in parts]
    return node


class Search:
    """The k best of each query so far; meets candidate blocks one by one."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, doubles: bool = True):
        self.kind = np.float64 if doubles else np.int64
        self.ids, self.points, self.k = ids, points.astype(self.kind), k
        self.root = grow(points.astype(np.float64))
        self.none = -np.inf if doubles else np.iinfo(np.int64).min + 1
        self.score = np.full((len(ids), k), self.none, self.kind)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.pairs = self.pruned = self.scored = 0

    def meet(self, ids: np.ndarray, points: np.ndarray) -> None:
        stack, points = [(self.root, grow(points.astype(np.float64)))], points.astype(self.kind)
        while stack:
            q, c = stack.pop()
            self.pairs += 1
            bound = q.center @ c.center + q.norm * c.radius + c.norm * q.radius + q.radius * c.radius
            if bound * (1 + 1e-9 * np.sign(bound)) + 1 < self.score[q.rows, -1].min():
                self.pruned += 1
            elif q.leaves() and c.leaves():
                self._scored(q.rows, ids[c.rows], points[c.rows])
            elif c.leaves() or (not q.leaves() and q.radius > c.radius):
                stack += [(child, c) for child in q.children]
            else:  # the most promising child is met first
                order = np.argsort([q.center @ child.center + q.norm * child.radius for child in c.children])
                stack += [(q, c.children[i]) for i in order]

    def _scored(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        score = self.points[rows] @ points.T
        self.scored += score.size
        score[self.ids[rows][:, None] == ids[None]] = self.none
        worst = self.score[rows, -1:]
        if score.shape[1] > self.k:
            worst = np.maximum(worst, np.partition(score, -self.k, axis=1)[:, -self.k, None])
        better = score >= worst
        keep, some = better.any(1), better.any(0)
        rows, score, ids = rows[keep], score[keep][:, some], ids[some]
        score = np.concatenate([self.score[rows], score], 1)
        found = np.concatenate([self.found[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
        best = np.lexsort((found, -score), axis=-1)[:, : self.k]
        self.score[rows], self.found[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)

    def results(self) -> pd.DataFrame:
        at = self.score != self.none
        q = np.broadcast_to(self.ids[:, None], at.shape)
        return pd.DataFrame({"query_id": q[at], "vec_id": self.found[at], "score": self.score[at].astype(np.int64)})


def _top_level(points: np.ndarray, centers: int) -> np.ndarray:
    """Greedy covering: the next centre is the point farthest from all centres so far."""
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(centers, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each usable vector."""
    usable = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(F.coalesce(vector_col, F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _blocks(rows: DataFrame, top: np.ndarray, dim: int, size: int, kind: type, together: bool = False) -> DataFrame:
    """(block, ids, points): rows of one centre and hash part, packed; together: centres that fill no block share one."""
    shared = rows.sparkSession.sparkContext.broadcast(top)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = shared.value
        for b in batches:
            m = _matrix(b["v"], dim, kind).astype(np.float64)
            near = ((top**2).sum(1)[None] - 2 * m @ top.T).argmin(1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "center": near})

    near = stored(rows.mapInPandas(placed, "vec_id long, v array<long>, center int"))
    parts, base, room = [], 0, size  # at most one row for each centre
    for r in near.groupBy("center").count().orderBy("center").collect():
        if not together or r["count"] > room:
            base, room = base + 1, size
        n = -(-r["count"] // size)
        parts.append((r["center"], base, n))
        base, room = base + n - 1, 0 if n > 1 else room - r["count"]
    split = rows.sparkSession.createDataFrame(parts, "center int, base int, parts int")
    cut = near.join(F.broadcast(split), "center").withColumn("part", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id")
        m = _matrix(b["v"], dim, kind)
        return pd.DataFrame({"block": [b["part"].iat[0]], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "points": [m.tobytes()]})

    return cut.groupBy("part").applyInPandas(packed, "block int, ids binary, points binary")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, centers: int = CENTERS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Both sides: (vec_id, v). Returns (query_id, rank, vec_id, score)."""
    spark = candidates.sparkSession
    largest = lambda rows: rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).head()
    shape, asked = largest(candidates), largest(queries)
    schema = "query_id long, rank int, vec_id long, score long"
    if not shape["n"] or not asked["n"]:
        return spark.createDataFrame([], schema)
    dim, most = max(shape["dim"], asked["dim"]), shape["most"] * asked["most"] * max(shape["dim"], asked["dim"])
    if most >= 1 << 63:
        raise ValueError("a score could exceed a long")
    doubles, kind = most < 1 << 53, np.int32 if max(shape["most"], asked["most"]) < 1 << 31 else np.int64
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    top = _top_level(_matrix(sample["v"], dim).astype(np.float64), centers)
    packed = stored(_blocks(candidates, top, dim, block_rows, kind))
    groups = _blocks(queries.groupBy("vec_id").agg(F.min("v").alias("v")), top, dim, query_rows, kind, together=True)
    asked_blocks = stored(groups.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("points").alias("q_points")))
    # Each candidate block meets each query block once, in one of `lanes` tasks of that query block.
    names = asked_blocks.groupBy().agg(F.collect_list("q_block").alias("q_blocks"))  # one name for each block of queries
    lanes = -(-shape["n"] // task_rows)
    sent = packed.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")).crossJoin(F.broadcast(names)).withColumn("q_block", F.explode("q_blocks")).drop("q_blocks")
    left = asked_blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def searched(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        search = Search(np.frombuffer(q["q_ids"].iat[0], np.int64), np.frombuffer(q["q_points"].iat[0], kind).reshape(-1, dim), k, doubles)
        for i in range(len(c)):
            search.meet(np.frombuffer(c["ids"].iat[i], np.int64), np.frombuffer(c["points"].iat[i], kind).reshape(-1, dim))
        return search.results()

    found = left.groupBy("q_block", "lane").cogroup(sent.groupBy("q_block", "lane")).applyInPandas(searched, "query_id long, vec_id long, score long")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("id")))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))  # k rows a lane and query
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
