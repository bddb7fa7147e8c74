"""Connected components of links, by spreading the least label and jumping to labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links (a, b) of any order and with repetitions; returns (node, label) with the least node of each component.

    Each round takes the least label among a node and its neighbours, then that label's own label; a component of
    diameter d needs about log(d) rounds. Only linked nodes are returned. Raises RuntimeError if it doesn't settle."""
    both = stored(links.select("a", "b").where("a != b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a != b")).distinct())
    state = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    for _ in range(rounds):
        state = stored(state)
        near = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("label").alias("least"))
        spread = state.join(near, state["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = state.select(F.col("node").alias("via"), F.col("label").alias("next"))
        moved = stored(spread.join(jump, spread["label"] == jump["via"], "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        state = moved.select("node", "label")
        if moved.where("label != old").isEmpty():
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
