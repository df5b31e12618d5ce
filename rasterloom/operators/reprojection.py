"""Rasters in other reference systems and grids, block by block.

A block of the target is mapped back to the source. What it needs there is bounded by the places of its own rim, as such a map
keeps insides inside, so a block asks for the source's blocks that this box (and the kernel's reach around it) meets: an equi-join
on source blocks, in which a source pixel is repeated only for target blocks near it. A task then holds one target block and
its window of the source, whatever the size of either raster. Methods that sum up what falls into a target pixel need
no window: source pixels go forward to their target pixel and are aggregated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import projections as P

#: Pixels from a target place on which a kernel draws.
REACH = {"nearest": 0, "bilinear": 1, "cubic": 2, "cubicspline": 2, "lanczos": 3, "spline": 32}
#: What a sample counts in the coefficients of a spline falls to this share from one pixel to the next.
POLE = 3**0.5 - 2
AGGREGATES = {"average": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "med": lambda v: F.percentile(v, 0.5), "q1": lambda v: F.percentile(v, 0.25), "q3": lambda v: F.percentile(v, 0.75), "mode": lambda v: F.mode(v, True)}


@dataclass(frozen=True)
class Grid:
    """A raster's system, upper left corner, size of a pixel (downwards and to the right) and numbers of pixels."""

    epsg: int
    ulx: float
    uly: float
    xres: float
    yres: float
    width: int
    height: int

    def xy(self, row, col):
        """Place of a fractional row and column, counted from the upper left corner."""
        return self.ulx + col * self.xres, self.uly - row * self.yres

    def rc(self, x, y):
        return (self.uly - y) / self.yres, (x - self.ulx) / self.xres


def rim(n: int = 50) -> list[np.ndarray]:
    """Shares along and down of n places on each side of a raster: top, right, bottom, left."""
    t, zero, one = np.linspace(0, 1, n), np.zeros(n), np.ones(n)
    return [np.array(p) for p in ((t, zero), (one, t), (t, one), (zero, t))]


def target_grid(source: Grid, epsg: int, spacing: float | None = None, n: int = 50) -> Grid:
    """The grid in another system that holds a raster: its box by n places on each side (the upper side gives the upper edge, and so
    on); pixels of `spacing`, or else such that its diagonal has as many as the source's."""
    box = []
    for side, (take, axis) in zip(rim(n), ((max, 1), (max, 0), (min, 1), (min, 0))):
        x, y = source.xy(side[1] * source.height, side[0] * source.width)
        box.append(float(take(P.transform(source.epsg, epsg, x, y, np)[axis])))
    top, right, bottom, left = box
    if spacing is None:
        spacing = math.hypot(right - left, top - bottom) / math.hypot(source.width, source.height)
    return Grid(epsg, left, top, spacing, spacing, math.ceil((right - left) / spacing), math.ceil((top - bottom) / spacing))


def kernel(t: np.ndarray, kind: str) -> np.ndarray:
    """Weights at distances in pixels."""
    a = np.abs(t)
    if kind == "bilinear":
        return np.maximum(1 - a, 0)
    if kind == "cubic":
        return np.where(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1, np.where(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2, 0))
    if kind == "cubicspline":
        return np.where(a < 1, (4 - 6 * a**2 + 3 * a**3) / 6, np.where(a < 2, (2 - a) ** 3 / 6, 0))
    if kind == "lanczos":
        return np.where(a < 3, np.sinc(a) * np.sinc(a / 3), 0)
    raise ValueError("kind must be nearest, bilinear, cubic, cubicspline or lanczos")


def spline_coefficients(window: np.ndarray, far: int = 30) -> np.ndarray:
    """Coefficients of the cubic spline that goes through all pixels, which are mirrored at the edges. A recursive filter would carry what
    is before and after a pixel without end; as that falls below rounding within `far` pixels, its weights are summed up that
    far, so a window with as wide a margin has the coefficients of the whole image."""
    weights = POLE ** np.abs(np.arange(-far, far + 1)) * (-6 * POLE / (1 - POLE**2))
    for axis in (0, 1):
        n = window.shape[axis]
        padded = np.pad(window, [(far, far) if a == axis else (0, 0) for a in (0, 1)], "reflect")
        window = sum(w * np.take(padded, range(k, k + n), axis) for k, w in enumerate(weights))
    return window


def sampled(window: np.ndarray, r: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """Values at fractional rows and columns of a window (NaN: no pixel). Weights are those of the pixels there are; without the
    pixel that a place is in, there is none."""
    tall, wide = window.shape
    at = lambda i, j: np.where((i >= 0) & (i < tall) & (j >= 0) & (j < wide), window[np.clip(i, 0, tall - 1), np.clip(j, 0, wide - 1)], np.nan)
    own = at(np.floor(r).astype(np.int64), np.floor(c).astype(np.int64))
    if kind == "nearest":
        return own
    if kind == "spline":
        c0 = np.pad(spline_coefficients(np.nan_to_num(window)), 2, "reflect")
        top, left = np.floor(r - 0.5).astype(np.int64), np.floor(c - 0.5).astype(np.int64)
        total = np.zeros(r.shape)
        for i in range(-1, 3):
            down = kernel(r - 0.5 - (top + i), "cubicspline")
            for j in range(-1, 3):
                total += down * kernel(c - 0.5 - (left + j), "cubicspline") * c0[np.clip(top + i + 2, 0, tall + 3), np.clip(left + j + 2, 0, wide + 3)]
        return np.where(np.isnan(own), np.nan, total)
    reach = REACH[kind]
    top, left = np.floor(r - 0.5).astype(np.int64), np.floor(c - 0.5).astype(np.int64)
    total, weights = np.zeros(r.shape), np.zeros(r.shape)
    for i in range(1 - reach, reach + 1):
        down = kernel(r - 0.5 - (top + i), kind)
        for j in range(1 - reach, reach + 1):
            v, w = at(top + i, left + j), down * kernel(c - 0.5 - (left + j), kind)
            there = ~np.isnan(v)
            total += np.where(there, w * np.where(there, v, 0), 0)
            weights += np.where(there, w, 0)
    return np.where(np.isnan(own) | (np.abs(weights) < 1e-9), np.nan, total / np.where(weights == 0, 1, weights))


def block_needs(target: Grid, source: Grid, block: int, side: int, reach: int, spark) -> DataFrame:
    """by, bx of every target block, the box of source rows and columns that it needs (r0, r1, c0, c1, both ends in), and the source
    blocks sy, sx that the box meets, a row for each."""
    across, down = -(-target.width // block), -(-target.height // block)
    steps, zeros = np.arange(block + 1), np.zeros(block + 1, int)
    rim_rows, rim_cols = np.concatenate([zeros, zeros + block, steps, steps]), np.concatenate([steps, steps, zeros, zeros + block])
    margin = reach + 1  # and a pixel, as a rim's places lie a target pixel apart

    def run(batches):
        for df in batches:
            for at in range(0, len(df), 256):
                by, bx = np.divmod(df["id"].to_numpy()[at : at + 256], across)
                x, y = target.xy(np.minimum(by[:, None] * block + rim_rows, target.height), np.minimum(bx[:, None] * block + rim_cols, target.width))
                places = source.rc(*P.transform(target.epsg, source.epsg, x, y, np))
                (r0, c0), (r1, c1) = ([np.clip(np.floor(np.nan_to_num(f(p, axis=1), nan=-margin - 1)) + m, -1, n).astype(np.int64) for p, n in zip(places, (source.height, source.width))] for f, m in ((np.nanmin, -margin), (np.nanmax, margin)))
                boxes = pd.DataFrame({"by": by, "bx": bx, "r0": np.maximum(r0, 0), "r1": np.minimum(r1, source.height - 1), "c0": np.maximum(c0, 0), "c1": np.minimum(c1, source.width - 1)})
                yield boxes[(boxes["r0"] <= boxes["r1"]) & (boxes["c0"] <= boxes["c1"])]

    met = spark.range(across * down).mapInPandas(run, "by long, bx long, r0 long, r1 long, c0 long, c1 long")
    met = met.withColumn("sy", F.explode(F.sequence(F.floor(F.col("r0") / side), F.floor(F.col("r1") / side))))
    return met.withColumn("sx", F.explode(F.sequence(F.floor(F.col("c0") / side), F.floor(F.col("c1") / side))))


def block_for(target: Grid, source: Grid, most: int = 1024) -> int:
    """Sides of target blocks: 256 pixels, or fewer where so many span over `most` of the source's."""
    row, col = target.height / 2, target.width / 2
    x, y = np.array([target.xy(row + i, col + j) for i, j in ((0, 0), (1, 0), (0, 1))]).T
    r, c = source.rc(*P.transform(target.epsg, source.epsg, x, y, np))
    ratio = max(np.ptp(r), np.ptp(c), 1e-9)
    return int(max(8, min(256, 2 ** math.floor(math.log2(max(most / ratio, 1))))))


def reprojected_blocks(px: DataFrame, bands: list[str], source: Grid, target: Grid, kind: str = "nearest", block: int | None = None, side: int = 256) -> DataFrame:
    """by, bx, values of the target's blocks that have a value: of each band, block * block values by rows, null where there is none."""
    if kind not in REACH:
        raise ValueError(f"kind must be one of {', '.join(REACH)}")
    block = block or block_for(target, source)
    needs = block_needs(target, source, block, side, REACH[kind], px.sparkSession)
    cells = px.select(*[F.col(c).cast("long").alias(c) for c in ("row", "col")], *[F.nanvl(F.col(b).cast("double"), F.lit(None)).alias(f"v{i}") for i, b in enumerate(bands)])
    cells = cells.where(F.coalesce(*[f"v{i}" for i in range(len(bands))]).isNotNull()).withColumns({"sy": F.floor(F.col("row") / side), "sx": F.floor(F.col("col") / side)})
    wanted = cells.join(needs, ["sy", "sx"]).where("row between r0 and r1 and col between c0 and c1").drop("sy", "sx")

    def fill(df: pd.DataFrame) -> pd.DataFrame:
        by, bx, r0, r1, c0, c1 = (int(df[c].iloc[0]) for c in ("by", "bx", "r0", "r1", "c0", "c1"))
        row, col = np.mgrid[by * block : (by + 1) * block, bx * block : (bx + 1) * block]
        r, c = source.rc(*P.transform(target.epsg, source.epsg, *target.xy(row + 0.5, col + 0.5), np))
        inside = (row < target.height) & (col < target.width) & (r >= 0) & (r < source.height) & (c >= 0) & (c < source.width)
        out = []
        for i in range(len(bands)):
            window = np.full((r1 - r0 + 1, c1 - c0 + 1), np.nan)
            window[df["row"].to_numpy() - r0, df["col"].to_numpy() - c0] = df[f"v{i}"].to_numpy()
            out.append(np.where(inside, sampled(window, np.where(inside, r, 0) - r0, np.where(inside, c, 0) - c0, kind), np.nan).ravel())
        return pd.DataFrame({"by": [by], "bx": [bx], "values": [out]})[[bool((~np.isnan(out)).any())]]

    return wanted.groupBy("by", "bx").applyInPandas(fill, "by long, bx long, values array<array<double>>")


def block_pixels(blocks: DataFrame, value: str, block: int) -> DataFrame:
    """The first band of blocks in long form (row, col, value), without pixels that have no value."""
    flat = blocks.select("by", "bx", F.posexplode(F.get("values", 0)).alias("__at", value)).where(F.col(value).isNotNull())
    return flat.select((F.col("by") * block + F.expr(f"__at div {block}")).alias("row"), (F.col("bx") * block + F.col("__at") % block).alias("col"), value)


def reproject(px: DataFrame, value: str, source: Grid, target: Grid, kind: str = "nearest", block: int | None = None, side: int = 256) -> DataFrame:
    """A raster (row, col, value) in the target's grid, sampled by a kernel at the centres of pixels: nearest, bilinear, cubic, cubicspline, lanczos
    or spline (which goes through all pixels; missing ones count as 0 there); or, of the source's pixels whose centres lie in a target pixel, their average, sum, min, max, med, q1, q3 or mode (the
    least of ties).

    Pixels beyond the source, or in a pixel without a value, are left out. block and side (of target and source blocks) change
    the work, never the result. A pixel of the source must not come twice; with aggregates it may.
    """
    if kind in AGGREGATES:
        x, y = source.xy(F.col("row") + 0.5, F.col("col") + 0.5)
        r, c = target.rc(*P.transform(source.epsg, target.epsg, x, y))
        inside = (r >= 0) & (r < target.height) & (c >= 0) & (c < target.width)
        return px.where(F.col(value).isNotNull() & inside).select(F.floor(r).alias("row"), F.floor(c).alias("col"), F.col(value)).groupBy("row", "col").agg(AGGREGATES[kind](F.col(value)).alias(value))
    block = block or block_for(target, source)
    return block_pixels(reprojected_blocks(px, [value], source, target, kind, block, side), value, block)


@dataclass(frozen=True)
class Stretched:
    """An image whose first and last pixels' centres are laid to those of a grid of another size (tall, wide)."""

    height: int
    width: int
    tall: int
    wide: int
    epsg: int = 4326

    def rc(self, x, y):
        step = lambda n, m: (n - 1) / (m - 1) if m > 1 else 0.0
        return (-y - 0.5) * step(self.height, self.tall) + 0.5, (x - 0.5) * step(self.width, self.wide) + 0.5


def zoom(px: DataFrame, value: str, height: int, width: int, down: float, across: float, order: int = 3, block: int | None = None, side: int = 256) -> DataFrame:
    """A whole raster (row, col, value) with `down` and `across` times as many rows and columns (rounded), by splines of order 0 (nearest),
    1 (linear) or 3 (cubic, through all pixels, mirrored at the edges): corner pixels stay corner pixels."""
    kinds = {0: "nearest", 1: "bilinear", 3: "spline"}
    if order not in kinds:
        raise ValueError("order must be 0, 1 or 3")
    tall, wide = round(height * down), round(width * across)
    return reproject(px, value, Stretched(height, width, tall, wide), Grid(4326, 0.0, 0.0, 1.0, 1.0, wide, tall), kinds[order], block, side)
