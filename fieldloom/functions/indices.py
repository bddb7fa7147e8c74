"""Spectral indices of blue, green, red and near-infrared digital numbers; 0 in all four bands is no data.

Values outside an index's range become null, and so does a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Index and the range in which it counts, ends included.
RANGES = {"NDVI": (-0.2, 1.0), "EVI": (-0.2, 1.5), "GCVI": (-1.0, 5.0), "SAVI": (-0.2, 1.0), "ISI": (-1.0, 1.0), "UBI": (-5.0, 5.0), "NDWI": (-1.0, 1.0)}
VEGETATION = ("NDVI", "EVI", "GCVI", "SAVI")
#: Digital numbers are reflectance times this.
SCALE = 10_000.0


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def formulas(blue: Column, green: Column, red: Column, nir: Column) -> dict[str, Column]:
    return {
        "NDVI": _ratio(nir - red, nir + red),
        "EVI": _ratio(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0),
        "GCVI": _ratio(nir, green) - 1.0,
        "SAVI": _ratio(1.5 * (nir - red), nir + red + 0.5),
        "ISI": 0.8192 * blue - 0.5735 * nir + 0.0750,
        "UBI": 1.34 * blue - 2.24 * green,
        "NDWI": _ratio(green - nir, green + nir),
    }


def with_indices(pixels: DataFrame, raw: bool = False) -> DataFrame:
    """Adds the seven indices and NIR. raw: all but ISI and UBI on unscaled numbers, and no-data pixels take part."""
    bands = [F.col(c) for c in ("blue", "green", "red", "nir")]
    if not raw:
        empty = (F.col("blue") == 0) & (F.col("green") == 0) & (F.col("red") == 0) & (F.col("nir") == 0)
        bands = [F.when(~empty, b) for b in bands]
    scaled = formulas(*(b / SCALE for b in bands))
    values = formulas(*bands) | {k: scaled[k] for k in ("ISI", "UBI")} if raw else scaled
    kept = {k: F.when(v.between(*RANGES[k]), v) for k, v in values.items()}
    return pixels.withColumns(kept | {"NIR": bands[3]})
