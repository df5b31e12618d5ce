"""Keypoints of images and their descriptors, window by window, and matches between two images.

A window takes the pixels of a margin around it along, as wide as the widest smoothing and the largest descriptor reach, and gives
only the keypoints that lie in itself; its results thus don't depend on where windows lie. Smoothing is that of the pixels there
are, divided by their weights, so edges of the image and missing pixels need no rule of their own. Matches are looked for in
blocks, among the keypoints of the other image within a buffer, as images are registered to begin with.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells across and bins of direction of a descriptor, the width of a cell in scales, and what a normalised entry counts at most.
CELLS, TURNS, CELL_WIDTH, MOST_ENTRY = 4, 8, 3.0, 0.2
FOUND = "row double, col double, scale double, angle double, response double, descriptor array<float>"


@dataclass(frozen=True)
class Scales:
    """Smoothings, `per_octave` for each doubling from `first` on, in all `count`; keypoints differ from their surroundings by at least
    `contrast` and aren't edges, whose one curvature is over `edge` times the other."""

    first: float = 1.6
    per_octave: int = 3
    count: int = 9
    contrast: float = 1.0
    edge: float = 10.0

    @property
    def sigmas(self) -> np.ndarray:
        return self.first * 2.0 ** (np.arange(self.count) / self.per_octave)

    @property
    def margin(self) -> int:
        return int(np.ceil(4 * self.sigmas[-1] + CELL_WIDTH * self.sigmas[-1] * (CELLS + 1) / 2 * 2**0.5)) + 3


def smoothed(image: np.ndarray, there: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means of the pixels that there are."""
    reach = int(np.ceil(4 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)

    def along(a: np.ndarray, axis: int) -> np.ndarray:
        n = a.shape[axis]
        padded = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)])
        return sum(w * np.take(padded, range(k, k + n), axis) for k, w in enumerate(weights))

    total, weight = (along(along(a, 0), 1) for a in (np.where(there, image, 0.0), there.astype(float)))
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), 0.0)


def extrema(stack: np.ndarray, least: float, edge: float) -> np.ndarray:
    """Places (level, row, col) that exceed all 26 neighbours of a stack of differences, or fall below them, and aren't edges."""
    inner = stack[1:-1, 1:-1, 1:-1]
    around = [stack[1 + a : stack.shape[0] - 1 + a, 1 + b : stack.shape[1] - 1 + b, 1 + c : stack.shape[2] - 1 + c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    top = (inner > np.maximum.reduce(around)) | (inner < np.minimum.reduce(around))
    at = np.argwhere(top & (np.abs(inner) >= least)) + 1
    k, r, c = at.T
    d = stack
    rr, cc = d[k, r + 1, c] + d[k, r - 1, c] - 2 * d[k, r, c], d[k, r, c + 1] + d[k, r, c - 1] - 2 * d[k, r, c]
    rc = (d[k, r + 1, c + 1] - d[k, r + 1, c - 1] - d[k, r - 1, c + 1] + d[k, r - 1, c - 1]) / 4
    det = rr * cc - rc * rc
    return at[(det > 0) & ((rr + cc) ** 2 * edge < (edge + 1) ** 2 * det)]


def between(low: float, mid: float, high: float) -> float:
    """Where, from the middle one, a parabola through three values has its top; half a step at most."""
    bend = low - 2 * mid + high
    return float(np.clip((low - high) / (2 * bend), -0.5, 0.5)) if bend else 0.0


def gradients(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = np.clip(rows, 1, image.shape[0] - 2), np.clip(cols, 1, image.shape[1] - 2)
    down, across = image[rows + 1, cols] - image[rows - 1, cols], image[rows, cols + 1] - image[rows, cols - 1]
    return np.hypot(down, across), np.arctan2(down, across)


def main_angle(image: np.ndarray, row: int, col: int, scale: float, bins: int = 36) -> float:
    """The direction of most gradient around a place."""
    reach = int(round(4.5 * scale))
    i, j = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    size, turn = gradients(image, row + i, col + j)
    weight = size * np.exp(-(i**2 + j**2) / (2 * (1.5 * scale) ** 2)) * (i**2 + j**2 <= reach**2)
    counts = np.bincount((np.floor(turn / (2 * np.pi) * bins).astype(int) % bins).ravel(), weight.ravel(), bins)
    best = int(counts.argmax())
    return 2 * np.pi * (best + 0.5 + between(counts[best - 1], counts[best], counts[(best + 1) % bins])) / bins


def described(image: np.ndarray, row: int, col: int, scale: float, angle: float) -> np.ndarray:
    """Histograms of gradients in CELLS x CELLS cells around a place, turned by its angle."""
    width = CELL_WIDTH * scale
    reach = int(np.ceil(width * (CELLS + 1) / 2 * 2**0.5))
    i, j = (a.ravel() for a in np.mgrid[-reach : reach + 1, -reach : reach + 1])
    c, s = np.cos(angle), np.sin(angle)
    u, v = (c * j + s * i) / width, (-s * j + c * i) / width
    near = (np.abs(u) < (CELLS + 1) / 2) & (np.abs(v) < (CELLS + 1) / 2)
    i, j, u, v = i[near], j[near], u[near], v[near]
    size, turn = gradients(image, row + i, col + j)
    size = size * np.exp(-(u**2 + v**2) / (2 * (CELLS / 2) ** 2))
    place = [u + CELLS / 2 - 0.5, v + CELLS / 2 - 0.5, ((turn - angle) % (2 * np.pi)) / (2 * np.pi) * TURNS]
    out = np.zeros((CELLS + 2, CELLS + 2, TURNS))
    low = [np.floor(p).astype(int) for p in place]
    for a in (0, 1):
        for b in (0, 1):
            for t in (0, 1):
                w = size * np.prod([1 - np.abs(p - (n + d)) for p, n, d in zip(place, low, (a, b, t))], axis=0)
                x, y = low[0] + a, low[1] + b
                inside = (x >= -1) & (x <= CELLS) & (y >= -1) & (y <= CELLS)
                np.add.at(out, (x[inside] + 1, y[inside] + 1, (low[2][inside] + t) % TURNS), w[inside])
    entries = out[1:-1, 1:-1].ravel()
    for most in (MOST_ENTRY, np.inf):
        entries = np.minimum(entries / max(np.linalg.norm(entries), 1e-12), most)
    return (entries / max(np.linalg.norm(entries), 1e-12)).astype(np.float32)


def found_in(image: np.ndarray, there: np.ndarray, scales: Scales, core: tuple[int, int, int, int]) -> list[tuple]:
    """Keypoints of an image whose pixel lies in its rows and columns `core` (first and one beyond the last of each)."""
    sigmas = scales.sigmas
    levels = [smoothed(image, there, s) for s in sigmas]
    stack = np.stack([b - a for a, b in zip(levels, levels[1:])])
    out = []
    for k, r, c in extrema(stack, scales.contrast, scales.edge):
        if not (core[0] <= r < core[1] and core[2] <= c < core[3] and there[r, c]):
            continue
        sides = [between(*stack[[k - 1, k, k + 1], r, c]), between(*stack[k, [r - 1, r, r + 1], c]), between(*stack[k, r, [c - 1, c, c + 1]])]
        # a difference stands for the scale midway between its two
        scale = float(sigmas[0] * 2 ** ((k + sides[0] + 0.5) / scales.per_octave))
        angle = main_angle(levels[k], r, c, sigmas[k])
        out.append((r + sides[1], c + sides[2], scale, angle, float(stack[k, r, c]), described(levels[k], r, c, sigmas[k], angle)))
    return out


def keypoints(px: DataFrame, value: str, scales: Scales | None = None, window: int = 256) -> DataFrame:
    """row, col, scale, angle, response and descriptor (128 numbers, of length 1) of the keypoints of an image (row, col, value): places
    whose differences of smoothings exceed those around them and at the next scales, or fall below. Null and NaN are missing
    pixels. An empty image has none, and the window's size changes no result."""
    scales = scales or Scales()
    margin = scales.margin
    cells = px.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    for c in ("row", "col"):
        cells = cells.withColumn(f"w{c}", F.explode(F.sequence(F.floor((F.col(c) - margin) / window), F.floor((F.col(c) + margin) / window))))

    def find(df: pd.DataFrame) -> pd.DataFrame:
        top, left = int(df["wrow"].iloc[0]) * window - margin, int(df["wcol"].iloc[0]) * window - margin
        image = np.full((window + 2 * margin, window + 2 * margin), np.nan)
        image[df["row"].to_numpy() - top, df["col"].to_numpy() - left] = df["v"].to_numpy()
        there = ~np.isnan(image)
        core = (margin, margin + window, margin, margin + window)
        if not there[core[0] : core[1], core[2] : core[3]].any():
            return pd.DataFrame([], columns=["row", "col", "scale", "angle", "response", "descriptor"])
        rows = [(r + top, c + left, *rest) for r, c, *rest in found_in(image, there, scales, core)]
        return pd.DataFrame(rows, columns=["row", "col", "scale", "angle", "response", "descriptor"])

    return cells.groupBy("wrow", "wcol").applyInPandas(find, FOUND)


def matched(a: DataFrame, b: DataFrame, block: int = 512, buffer: int = 250, ratio: float = 0.7) -> DataFrame:
    """row, col, row_b, col_b, distance: keypoints of one image and those of another that are most like them, if these are within `ratio`
    of the distance of the next. Of both images, places are in the same system; a block's keypoints are compared with those of
    the other image in the block and a buffer around it, each once."""
    from_a = a.withColumns({"by": F.floor(F.col("row") / block), "bx": F.floor(F.col("col") / block)})
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - buffer) / block), F.floor((F.col(c) + buffer) / block)))
    from_b = b.withColumn("by", span("row")).withColumn("bx", span("col"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["row", "col", "row_b", "col_b", "distance"]
        if left.empty or len(right) < 2:
            return pd.DataFrame([], columns=columns)
        right = right.sort_values(["row", "col"]).reset_index(drop=True)
        d = np.stack(right["descriptor"].to_numpy()).astype(float)
        out = []
        for at in range(0, len(left), 1024):
            part = left.iloc[at : at + 1024]
            far = np.sqrt(np.maximum(2 - 2 * np.stack(part["descriptor"].to_numpy()).astype(float) @ d.T, 0))
            first, second = np.partition(far, 1, axis=1)[:, :2].T
            good = first < ratio * second
            to = far.argmin(1)[good]
            out.append(pd.DataFrame({"row": part["row"].to_numpy()[good], "col": part["col"].to_numpy()[good], "row_b": right["row"].to_numpy()[to], "col_b": right["col"].to_numpy()[to], "distance": first[good]}))
        return pd.concat(out)[columns]

    return from_a.groupBy("by", "bx").cogroup(from_b.groupBy("by", "bx")).applyInPandas(pair, "row double, col double, row_b double, col_b double, distance double")
