"""Scalar helpers: ids, lenient numbers, quality clipping, rounding, and names of columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a key column is looked for, in this order.
KEYS = ("parcel_id", "id", "objectid", "fid")
GIS_KEYS = (*KEYS, "dkm")


def clean_id(col: Column, strip_first: bool = False) -> Column:
    """An id as text: without a final `.0` and without white space around it. Null stays null."""
    text = col.cast("string")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    cut = lambda c: F.regexp_replace(c, r"\.0$", "")
    return cut(strip(text)) if strip_first else strip(cut(text))


def key_column(columns: Iterable[str], names: Iterable[str] = KEYS) -> str:
    """The first column that has one of the names, in any case; else the first column."""
    columns = list(columns)
    lower = {c.lower(): c for c in reversed(columns)}
    return next((lower[n] for n in names if n in lower), columns[0])


def require(df: DataFrame, names: Iterable[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def number(col: Column) -> Column:
    """A number, null if the text is none or not finite."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip_quality(col: Column, least: float = 0.05) -> Column:
    """Quality within [least, 1]; missing counts as 1."""
    x = F.when(~F.isnan(col), col)
    return F.greatest(F.least(F.coalesce(x, F.lit(1.0)), F.lit(1.0)), F.lit(least))


def round4(col: Column) -> Column:
    return F.rint(col * 1e4) / 1e4


def month_weight(month: Column, weights: Mapping[int, float]) -> Column:
    """A month's weight; 1 if it has none."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (int(k), float(v))))
    return F.coalesce(F.try_element_at(table, month.cast("int")), F.lit(1.0))


def short_names(names: Iterable[str], known: Mapping[str, str] | None = None, most: int = 10) -> dict[str, str]:
    """Names of at most `most` characters; known ones first, the rest cut, with a number where two would be the same."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for name in names:
        base = (known or {}).get(name, re.sub(r"\W", "_", name))[:most]
        short, k = base, 0
        while short.lower() in used:
            k += 1
            short = base[: most - len(str(k))] + str(k)
        used.add(short.lower())
        out[name] = short
    return out


def by_prefix(columns: Iterable[str], prefix: str) -> list[str]:
    """Columns `{prefix}_M{month}`, in order of month."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(re.escape(prefix) + r"_M(\d+)", c))]
    return [c for _, c in sorted(found)]


def without_conflicts(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns of these names, in any case: a join then brings in its own."""
    gone = {n.lower() for n in names}
    return df.drop(*(F.col(f"`{c}`") for c in df.columns if c.lower() in gone))


def fill_by_type(df: DataFrame, number: float = -9999, text: str = "", keep: Iterable[str] = ("geometry",)) -> DataFrame:
    """Nulls, and numbers that are none, become the number in numeric columns and the text in text columns; others stay null."""
    def filled(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if name in keep or kind not in ("string", "tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
            return c
        if kind in ("float", "double"):
            c = F.when(~F.isnan(c), c)
        return F.coalesce(c, F.lit(text) if kind == "string" else F.lit(number).cast(kind)).alias(name)

    return df.select(*(filled(c, k) for c, k in df.dtypes))


def export_join(layer: DataFrame, ledger: DataFrame, names: Mapping[str, str], keep: Iterable[str], key: str = "parcel_id") -> DataFrame:
    """A layer with what a ledger says of its parcels, for a shapefile: keys of both are cleaned, columns of the layer that the
    ledger brings too are dropped, short names given, columns in `keep` that are there kept in that order, and nulls filled by type.

    The layer's key column is found by its name. Parcels that the ledger lacks go; a key that a side repeats comes as often."""
    own = key_column(layer.columns, GIS_KEYS)
    left = layer.withColumnRenamed(own, key) if own != key else layer
    brought = [c for c in ledger.columns if c != key]
    left = without_conflicts(left, brought).withColumn(key, clean_id(F.col(key)))
    joined = left.join(require(ledger, [key]).withColumn(key, clean_id(F.col(key))), key).withColumnsRenamed(dict(names))
    return fill_by_type(joined.select(*(c for c in keep if c in joined.columns)))
