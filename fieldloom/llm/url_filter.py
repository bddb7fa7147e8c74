"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule `host/path` fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's; the
longest fitting rule wins. Urls that no rule fits are judged by boosted trees over the url's own characters and over what
the labelled urls say of its suffix (how many there are, which share is blocked), trained on labelled urls. `fit` learns
from about `max_rows` distinct labelled urls, those with the smallest hash, so its cost is bounded.

A url without `://`, and a null one, have an empty host and path: no rule fits them and all features are 0. Training
with one label only, or none, gives a constant model: that label, or allow. Repeated urls are one in training and get the
same verdict; an empty table stays empty. Columns of the input pass through; host, path, rule and by_rule are set anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
FEATURES = ("length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_parameters", "has_fragment", "hyphens", "suffix_length", "suffix_vowels", "suffix_blocked", "suffix_seen", "label_entropy", "is_secure")


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumn("host", lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).withColumn("path", F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def rule_of(rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits host and path, or null."""
    def fits(rule: str) -> Column:
        host, _, path = rule.partition("/")
        return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + path))

    ordered = sorted(rules, key=lambda r: -len(r[0]))
    return F.coalesce(*(F.when(fits(r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for r, v in ordered))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and by_rule, its verdict; host and path must be there."""
    return df.withColumn("by_rule", rule_of(rules)).withColumns({"rule": F.col("by_rule.rule"), "by_rule": F.col("by_rule.verdict")})


def _count(col: Column, characters: str) -> Column:
    return F.regexp_count(col, F.lit(characters)).cast("double")


def _entropy(col: Column) -> Column:
    def of(letters: Column) -> Column:
        n = F.size(letters).cast("double")
        # Sorted letters fold into runs of equal ones: (sum of k log k of the runs so far, last letter, its run).
        plus = lambda s: s["sum"] + s["k"] * F.log2(F.greatest(s["k"], F.lit(1.0)))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("c"), F.lit(0.0).alias("k"))
        step = lambda s, c: F.when(s["c"] == c, F.struct(s["sum"].alias("sum"), c.alias("c"), (s["k"] + 1).alias("k"))).otherwise(F.struct(plus(s).alias("sum"), c.alias("c"), F.lit(1.0).alias("k")))
        return F.when(n > 0, F.log2(n) - F.aggregate(letters, start, step, plus) / n).otherwise(0.0)

    return F.element_at(F.transform(F.array(F.array_sort(F.filter(F.split(col, ""), lambda c: c != ""))), of), 1)


def _suffix() -> Column:
    return F.substring_index(F.col("host"), ".", -1)


def with_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the lexical features, one double column each; host and path must be there, and blocked and seen, what is known
    of the suffix."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    suffix, label = _suffix(), F.substring_index(host, ".", 1)
    found = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "host_depth": _count(host, r"\."), "path_depth": _count(path, "/"),
        "digit_ratio": ratio(_count(url, "[0-9]"), F.length(url)), "entropy": _entropy(url),
        "n_parameters": _count(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "[^&]+"), "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "hyphens": _count(host, "-"), "suffix_length": F.length(suffix), "suffix_vowels": ratio(_count(suffix, "[aeiou]"), F.length(suffix)),
        "suffix_blocked": F.coalesce("blocked", F.lit(0.5)), "suffix_seen": F.log1p(F.coalesce("seen", F.lit(0))),
        "label_entropy": _entropy(label), "is_secure": F.startswith(F.lower(url), F.lit("https:")).cast("double"),
    }
    return df.withColumns({f"f_{k}": v.cast("double") for k, v in found.items()})


def _with_suffix(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    known = suffixes.withColumnRenamed("suffix", "known_suffix")  # at most max_rows rows
    return df.join(F.broadcast(known), _suffix() == F.col("known_suffix"), "left").drop("known_suffix")


@dataclass
class UrlModel:
    trees: object = None
    suffixes: DataFrame | None = None
    constant: str = "allow"

    def judge(self, df: DataFrame, url_col: str = "url", out: str = "verdict") -> DataFrame:
        """df, which has host and path, with a verdict. Columns of other names pass through."""
        names = [c for c in df.columns if c != out]
        if self.trees is None:
            return df.withColumn(out, F.lit(self.constant))
        rows = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.col(f"`{url_col}`").alias("url"), "host", "path")
        assembled = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(with_features(_with_suffix(rows, self.suffixes)))
        judged = self.trees.transform(assembled.select("doc", "features"))
        return judged.select("doc.*", F.when(F.col("is_blocked") >= 0.5, "block").otherwise("allow").alias(out))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_rows: int = 20_000, rounds: int = 12, depth: int = 4, seed: int = 7) -> UrlModel:
    """labelled: host, path, url and a label allow or block; null labels don't count. Learns from about max_rows distinct
    urls, those of least hash, and twice that at most."""
    rows = labelled.where(F.col(label_col).isin("allow", "block")).select(F.col(f"`{url_col}`").alias("url"), "host", "path", (F.col(label_col) == "block").cast("double").alias("is_label")).distinct()
    rows = stored(rows)
    share = min(1.0, max_rows / max(1, rows.count()))
    rows = stored(rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * max_rows).repartition(8))
    kinds = {r["is_label"] for r in rows.select("is_label").distinct().collect()}  # two at most
    if len(kinds) < 2:
        return UrlModel(constant="block" if 1.0 in kinds else "allow")
    suffixes = stored(rows.groupBy(_suffix().alias("suffix")).agg(((F.sum("is_label") + 1) / (F.count("*") + 2)).alias("blocked"), F.count("*").alias("seen")))
    vectors = stored(VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(with_features(_with_suffix(rows, suffixes))).select("features", "is_label"))
    trees = GBTClassifier(featuresCol="features", labelCol="is_label", predictionCol="is_blocked", maxIter=rounds, maxDepth=depth, seed=seed)
    trees.setRawPredictionCol("raw").setProbabilityCol("chance")
    return UrlModel(trees.fit(vectors.repartition(8)), suffixes)
