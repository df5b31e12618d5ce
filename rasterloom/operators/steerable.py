"""Oriented pyramids: an image as a highpass rest, oriented bands of several scales, and a lowpass rest.

Filters are small kernels, which are parameters. An image is filtered window by window, with a margin as wide as the kernel reaches;
pixels beyond an edge are those mirrored at the edge's pixel. Each scale is stored, and the next is made from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.storage import checkpointed

SMOOTH = np.array([1, 4, 6, 4, 1]) / 16
SLOPE = np.array([0, 1, 0, -1, 0]) / 2


@dataclass(frozen=True)
class Filters:
    """Kernels of odd size: low0 and high0 part the image at first; bands and low each scale."""

    low0: np.ndarray
    high0: np.ndarray
    low: np.ndarray
    bands: tuple[np.ndarray, ...]


def filters(order: int = 0) -> Filters:
    """Binomial lowpass filters and what they leave. order 0: one band without direction; 1: bands of the slope down and across, from
    which that of any direction is combined by its sine and cosine."""
    low, point = np.outer(SMOOTH, SMOOTH), np.zeros((5, 5))
    point[2, 2] = 1
    if order not in (0, 1):
        raise ValueError("order must be 0 or 1")
    bands = (point - low,) if order == 0 else (np.outer(SLOPE, SMOOTH), np.outer(SMOOTH, SLOPE))
    return Filters(low, point - low, low, bands)


def filtered(px: DataFrame, value: str, height: int, width: int, kernels: dict[str, np.ndarray], step: int = 1, window: int = 256) -> DataFrame:
    """name, row, col and value of a whole raster (row, col, value) under each kernel, of every `step`th row and column, which are
    numbered anew. What is missing counts as 0; the window's size changes no result."""
    reach = max(max(k.shape) // 2 for k in kernels.values())
    window = max(window, reach + 1)  # mirrored pixels must be in the window
    cells = px.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v"))
    for c, n in (("row", height), ("col", width)):
        last = (n - 1) // window
        cells = cells.withColumn(f"w{c}", F.explode(F.sequence(F.greatest(F.floor((F.col(c) - reach) / window), F.lit(0)), F.least(F.floor((F.col(c) + reach) / window), F.lit(last)))))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        spans = []
        for c, n in (("wrow", height), ("wcol", width)):
            first = int(df[c].iloc[0]) * window
            spans.append((first, min(first + window, n), max(first - reach, 0), min(first + window + reach, n)))
        (r0, r1, top, bottom), (c0, c1, left, right) = spans
        image = np.zeros((bottom - top, right - left))
        image[df["row"].to_numpy() - top, df["col"].to_numpy() - left] = np.nan_to_num(df["v"].to_numpy(dtype=float))
        beyond = [(reach - (r0 - top), reach - (bottom - r1)), (reach - (c0 - left), reach - (right - c1))]
        image = np.pad(image, beyond, "reflect")
        row, col = np.mgrid[r0:r1, c0:c1]
        kept = (row % step == 0) & (col % step == 0)
        out = []
        for name, kernel in kernels.items():
            down, across = (n // 2 for n in kernel.shape)
            total = np.zeros(row.shape)
            for i in range(-down, down + 1):
                for j in range(-across, across + 1):
                    if kernel[i + down, j + across]:
                        total += kernel[i + down, j + across] * image[reach + i : reach + i + r1 - r0, reach + j : reach + j + c1 - c0]
            out.append(pd.DataFrame({"name": name, "row": row[kept] // step, "col": col[kept] // step, value: total[kept]}))
        return pd.concat(out)

    return cells.groupBy("wrow", "wcol").applyInPandas(run, f"name string, row long, col long, `{value}` double")


def steerable_pyramid(px: DataFrame, value: str, height: int, width: int, levels: int = 3, order: int = 0, window: int = 256, by: Filters | None = None) -> DataFrame:
    """level, name (highpass, band0, band1, ..., lowpass), row, col and value of a whole raster's pyramid: the highpass rest at level 0,
    the bands of levels 0 to levels - 1, each of half the size of the one before, and the lowpass rest at level `levels`. A raster of
    fewer rows or columns than 2 ** levels has as many of them as there are; an empty one has no rows."""
    by = by or filters(order)
    first = checkpointed(filtered(px, value, height, width, {"highpass": by.high0, "low": by.low0}, 1, window))
    out = first.where("name = 'highpass'").select(F.lit(0).alias("level"), "name", "row", "col", value)
    image = first.where("name = 'low'")
    for level in range(levels):
        bands = filtered(image, value, height, width, {f"band{k}": b for k, b in enumerate(by.bands)}, 1, window)
        out = out.unionByName(bands.select(F.lit(level).alias("level"), "name", "row", "col", value))
        image = checkpointed(filtered(image, value, height, width, {"lowpass": by.low}, 2, window))
        height, width = (height + 1) // 2, (width + 1) // 2
    return out.unionByName(image.select(F.lit(levels).alias("level"), "name", "row", "col", value))
