"""Images with rational polynomial coefficients: places of their pixels on the ground, and images made upright.

The model gives the line and sample of a place, so an image made upright needs it forwards only, block by block, as any other
source of a reprojection; the corners of an image need it backwards, by Newton steps for a batch of images at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rasterloom.operators.reprojection import Grid, reproject, rim


def terms(lat: np.ndarray, lon: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The twenty terms of the model, in the last axis, of normalised places."""
    lat, lon, h = np.broadcast_arrays(lat, lon, h)
    # Fixed order: powers of longitude, latitude and height in each term.
    powers = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 1), (3, 0, 0), (1, 2, 0), (1, 0, 2), (2, 1, 0), (0, 3, 0), (0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 3)]
    return np.stack([lon**a * lat**b * h**c for a, b, c in powers], axis=-1)


def normalised_image(model: dict[str, np.ndarray], lat: np.ndarray, lon: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Line and sample, in the first axis, of normalised places; a model's coefficients broadcast against places."""
    t = terms(lat, lon, h)
    ratio = lambda a, b: (t * model[a]).sum(-1) / (t * model[b]).sum(-1)
    return np.stack([ratio("line_num", "line_den"), ratio("samp_num", "samp_den")])


def normalised_ground(model: dict[str, np.ndarray], line: np.ndarray, sample: np.ndarray, h: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Latitude and longitude, in the first axis, of normalised lines and samples at a height."""
    want = np.stack(np.broadcast_arrays(line, sample)).astype(float)
    at, step = np.zeros_like(want), 1e-6
    for _ in range(rounds):
        miss = want - normalised_image(model, *at, h)
        if not (np.abs(miss) >= 1e-12).any():
            break
        along = [(normalised_image(model, at[0] + dp, at[1] + dl, h) - normalised_image(model, at[0] - dp, at[1] - dl, h)) / (2 * step) for dp, dl in ((step, 0), (0, step))]
        (a, c), (b, d) = along
        det = a * d - b * c
        at = at + np.stack([(d * miss[0] - b * miss[1]) / det, (a * miss[1] - c * miss[0]) / det])
    return at


@dataclass(frozen=True)
class RpcImage:
    """An image of a number of columns and rows: offsets and scales of line, sample, latitude, longitude and height, coefficients, and the
    height that its ground is taken to have. Its places are longitudes and latitudes."""

    width: int
    height: int
    offsets: tuple
    scales: tuple
    line_num: tuple
    line_den: tuple
    samp_num: tuple
    samp_den: tuple
    ground: float = 0.0
    epsg: int = 4326

    @property
    def model(self) -> dict[str, np.ndarray]:
        return {c: np.asarray(getattr(self, c), float) for c in ("line_num", "line_den", "samp_num", "samp_den")}

    def rc(self, lon, lat):
        o, s = self.offsets, self.scales
        line, sample = normalised_image(self.model, (lat - o[2]) / s[2], (lon - o[3]) / s[3], np.asarray((self.ground - o[4]) / s[4]))
        return line * s[0] + o[0], sample * s[1] + o[1]

    def xy(self, row, col):
        o, s = self.offsets, self.scales
        lat, lon = normalised_ground(self.model, (np.asarray(row, float) - o[0]) / s[0], (np.asarray(col, float) - o[1]) / s[1], np.asarray((self.ground - o[4]) / s[4]))
        return lon * s[3] + o[3], lat * s[2] + o[2]


def upright_grid(image: RpcImage, spacing: float, n: int = 50) -> Grid:
    """The grid of longitude and latitude that holds an image, by n places on each of its sides."""
    across, down = (np.concatenate([s[i] for s in rim(n)]) for i in (0, 1))
    lon, lat = image.xy(down * image.height, across * image.width)
    left, top = float(lon.min()), float(lat.max())
    return Grid(4326, left, top, spacing, spacing, math.ceil((float(lon.max()) - left) / spacing), math.ceil((top - float(lat.min())) / spacing))


def orthorectify(px: DataFrame, value: str, image: RpcImage, target: Grid, kind: str = "nearest", block: int | None = None) -> DataFrame:
    """An image (row, col, value) in a grid on the ground, at the image's ground height; as `reproject` in all else."""
    return reproject(px, value, image, target, kind, block)


def rpc_corners(scenes: DataFrame) -> DataFrame:
    """Box of the four corners (at height 0) of scenes with rational polynomial coefficients.

    Columns: id, width, height, and arrays offsets, scales (line, sample, latitude, longitude, height), line_num, line_den,
    samp_num, samp_den (20 each).
    """
    columns = ["line_num", "line_den", "samp_num", "samp_den"]

    def run(batches):
        for df in batches:
            if df.empty:
                continue
            o, s = (np.stack(df[c].to_numpy())[:, None, :].astype(float) for c in ("offsets", "scales"))
            model = {c: np.stack(df[c].to_numpy())[:, None, :].astype(float) for c in columns}
            line = df["height"].to_numpy(float)[:, None] * np.array([0, 1, 1, 0])
            sample = df["width"].to_numpy(float)[:, None] * np.array([0, 0, 1, 1])
            lat, lon = normalised_ground(model, (line - o[..., 0]) / s[..., 0], (sample - o[..., 1]) / s[..., 1], -o[..., 4] / s[..., 4])
            lat, lon = lat * s[..., 2] + o[..., 2], lon * s[..., 3] + o[..., 3]
            yield pd.DataFrame({"id": df["id"], "xmin": lon.min(1), "ymin": lat.min(1), "xmax": lon.max(1), "ymax": lat.max(1)})

    return scenes.select("id", "width", "height", "offsets", "scales", *columns).mapInPandas(run, "id long, xmin double, ymin double, xmax double, ymax double")
