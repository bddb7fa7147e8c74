"""Labels: golden over pseudo labels, exclusions, semantics of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a semantic label, and their class.
SEMANTIC = (("果树", 1), ("撂荒", 2))
GOLDEN_WEIGHT, PSEUDO_WEIGHT = 10.0, 0.1
UNREVIEWED = -9999
#: Fixed value: the reason of a parcel whose class the floor decides.
UNSURE = "模型置信度偏低，执行安全兜底"


def true_labels(raw: DataFrame) -> DataFrame:
    """(parcel_id, label) of reviewed parcels; the label's column may be misspelt, and -9999 is no label."""
    name = "true_label" if "true_label" in raw.columns else "ture_label"
    return raw.where(F.col(name).isNotNull() & (F.col(name) != UNREVIEWED)).select("parcel_id", F.col(name).cast("int").alias("label"))


def merge(golden: DataFrame, pseudo: DataFrame) -> DataFrame:
    """(parcel_id, label, weight): golden labels go before pseudo labels."""
    g, p = golden.select("parcel_id", F.col("label").alias("g")), pseudo.select("parcel_id", F.col("label").alias("p"))
    return g.join(p, "parcel_id", "full").select("parcel_id", F.coalesce("g", "p").alias("label"), F.when(F.col("g").isNotNull(), GOLDEN_WEIGHT).otherwise(PSEUDO_WEIGHT).alias("weight"))


def pseudo_labels(ledger: DataFrame, least: float = 0.95) -> DataFrame:
    """(parcel_id, label) of sure parcels by their semantic label."""
    label = F.coalesce(*(F.when(F.contains("semantic", F.lit(w)), k) for w, k in SEMANTIC), F.lit(0))
    return ledger.where(F.col("confidence") > least).select("parcel_id", label.alias("label"))


def without(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select("parcel_id"), "parcel_id", "left_anti")


def reasons(df: DataFrame) -> DataFrame:
    """Adds reason, from top1, value1, top2, value2: attributions in words."""
    last = lambda c: F.element_at(F.split(c, "_"), -1)
    first = F.concat(F.lit("首要依据: ["), last("top1"), F.lit("]特征显著"))
    second = F.when(F.col("value2") > 0, F.concat(F.lit("；次要依据: ["), last("top2"), F.lit("]协同判定"))).otherwise("")
    return df.withColumn("reason", F.when(F.col("value1") <= 0, "依据不足，模型置信度偏低").otherwise(F.concat(first, second)))
