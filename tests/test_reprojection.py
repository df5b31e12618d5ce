"""Reference systems against their defining properties, and reprojection by blocks against a plain version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import projections as P
from rasterloom.operators import reprojection as W


def test_known_places():
    x, y = P.project(32631, 2.2945, 48.8582, np)
    assert abs(x - 448251.8) < 1 and abs(y - 5411932.7) < 1
    assert np.allclose(P.project(32756, 153.0, -30.0, np), (500000, 1e7 - P.project(32656, 153.0, 30.0, np)[1]))
    assert np.allclose(P.project(3857, 180.0, 0.0, np), (20037508.342789244, 0))
    assert np.allclose(P.project(32632, 9.0, 0.0, np), (500000, 0))


def test_the_central_meridian_has_its_length():
    """Northings on the central meridian are the meridian's arc, here by numerical integration, times the scale."""
    e2 = P.FLATTENING * (2 - P.FLATTENING)
    lat = np.radians(np.linspace(0, 60, 600_001))
    f = P.SEMI_MAJOR * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5
    arc = float((f[:-1] + f[1:]).sum() / 2 * (lat[1] - lat[0]))
    assert abs(P.project(32632, 9.0, 60.0, np)[1] - arc * P.SCALE) < 1e-4


def test_utm_is_conformal():
    """With the last test, this tells the projection: on the ellipsoid, a step north and one east are right-angled and scaled alike."""
    e2 = P.FLATTENING * (2 - P.FLATTENING)
    lon, lat = np.meshgrid(np.linspace(6.1, 11.9, 15), np.linspace(-79, 83, 25))
    h = 1e-5
    at = lambda a, b: np.stack(P.project(32632, a, b, np))
    east, north = (at(lon + h, lat) - at(lon - h, lat)) / (2 * math.radians(h)), (at(lon, lat + h) - at(lon, lat - h)) / (2 * math.radians(h))
    s = np.sin(np.radians(lat))
    east /= P.SEMI_MAJOR * np.cos(np.radians(lat)) / np.sqrt(1 - e2 * s**2)
    north /= P.SEMI_MAJOR * (1 - e2) / (1 - e2 * s**2) ** 1.5
    assert np.abs((east * north).sum(0)).max() < 1e-7
    assert np.abs(np.hypot(*east) - np.hypot(*north)).max() < 1e-7


@pytest.mark.parametrize("epsg", [4326, 3857, 32601, 32632, 32660, 32755])
def test_there_and_back(epsg, spark):
    centre = P.zone(epsg)[0] if epsg > 32600 else 0.0
    lon, lat = (a.ravel() for a in np.meshgrid(centre + np.linspace(-3, 3, 13), np.linspace(-80, 80, 21)))
    x, y = P.project(epsg, lon, lat, np)
    back = P.unproject(epsg, x, y, np)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
    df = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist(), x.tolist(), y.tolist())), "lon double, lat double, x double, y double")
    px, py = P.project(epsg, F.col("lon"), F.col("lat"))
    ux, uy = P.unproject(epsg, F.col("x"), F.col("y"))
    far = df.select(F.max(F.abs(px - F.col("x"))), F.max(F.abs(py - F.col("y"))), F.max(F.abs(ux - F.col("lon"))), F.max(F.abs(uy - F.col("lat")))).first()
    assert far[0] < 1e-6 and far[1] < 1e-6 and far[2] < 1e-9 and far[3] < 1e-9


def test_unknown_systems():
    for epsg in (2056, 32600, 32661):
        with pytest.raises(ValueError, match="no such reference system"):
            P.project(epsg, 1.0, 2.0, np)


def plain(image, source, target, kind):
    out = {}
    for row in range(target.height):
        for col in range(target.width):
            r, c = source.rc(*P.transform(target.epsg, source.epsg, *target.xy(row + 0.5, col + 0.5), np))
            if not (0 <= r < source.height and 0 <= c < source.width) or np.isnan(image[int(r), int(c)]):
                continue
            if kind == "nearest":
                out[row, col] = image[int(r), int(c)]
                continue
            total = weight = 0.0
            for i in range(int(r) - 4, int(r) + 5):
                for j in range(int(c) - 4, int(c) + 5):
                    if 0 <= i < source.height and 0 <= j < source.width and not np.isnan(image[i, j]):
                        w = float(W.kernel(np.array(r - 0.5 - i), kind) * W.kernel(np.array(c - 0.5 - j), kind))
                        total, weight = total + w * image[i, j], weight + w
            if abs(weight) >= 1e-9:
                out[row, col] = total / weight
    return out


@pytest.fixture(scope="module")
def image(spark):
    values = np.random.default_rng(3).uniform(0, 100, (40, 30)).round(2)
    values[5:9, 10:14] = np.nan
    rows = [(r, c, None if np.isnan(values[r, c]) else float(values[r, c])) for r in range(40) for c in range(30) if (r, c) != (20, 20)]
    values[20, 20] = np.nan
    return values, spark.createDataFrame(rows, "row long, col long, v double")


@pytest.mark.parametrize("kind", ["nearest", "bilinear", "cubic", "cubicspline", "lanczos"])
@pytest.mark.parametrize(("block", "side"), [(None, 256), (7, 5)])
def test_blocks_change_nothing(image, kind, block, side):
    values, px = image
    source = W.Grid(4326, 8.0, 50.0, 0.01, 0.01, 30, 40)
    target = W.target_grid(source, 32632, 900.0)
    want = plain(values, source, target, kind)
    got = {(r.row, r.col): r.v for r in W.reproject(px, "v", source, target, kind, block, side).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_smooth_field_comes_back(spark):
    """A slowly varying field, taken to UTM and back with a cubic kernel, is itself but near the edges."""
    source = W.Grid(4326, 8.0, 50.0, 0.01, 0.01, 60, 60)
    field = lambda r, c: F.sin(r / 9.0) + F.cos(c / 11.0)
    px = spark.range(3600).select(F.expr("id div 60").alias("row"), (F.col("id") % 60).alias("col")).withColumn("v", field(F.col("row"), F.col("col")))
    there = W.target_grid(source, 32632, 500.0)
    back = W.reproject(W.reproject(px, "v", source, there, "cubic"), "v", there, source, "cubic")
    inner = back.where("row between 6 and 53 and col between 6 and 53")
    assert inner.count() == 48 * 48
    assert inner.agg(F.max(F.abs(F.col("v") - field(F.col("row"), F.col("col"))))).first()[0] < 2e-3


def test_aggregates_count_every_pixel_once(image):
    values, px = image
    source = W.Grid(4326, 8.0, 50.0, 0.01, 0.01, 30, 40)
    target = W.target_grid(source, 3857, 5000.0)
    sums = W.reproject(px, "v", source, target, "sum").agg(F.sum("v")).first()[0]
    assert abs(sums - np.nansum(values)) < 1e-6
    low, mid, high = (W.reproject(px, "v", source, target, k).orderBy("row", "col").collect() for k in ("min", "med", "max"))
    assert all(a.v <= b.v <= c.v for a, b, c in zip(low, mid, high))


def test_spacing_keeps_the_diagonal():
    source = W.Grid(32632, 400000.0, 6000000.0, 30.0, 30.0, 3000, 4000)
    target = W.target_grid(source, 32632)
    assert abs(target.xres - 30) < 1e-9 and abs(target.width - 3000) <= 1 and abs(target.height - 4000) <= 1


def test_odd_rasters(spark):
    source = W.Grid(4326, 8.0, 50.0, 0.01, 0.01, 30, 40)
    target = W.target_grid(source, 32632, 900.0)
    empty = spark.createDataFrame([], "row long, col long, v double")
    assert W.reproject(empty, "v", source, target, "cubic").collect() == [] == W.reproject(empty, "v", source, target, "average").collect()
    with pytest.raises(ValueError, match="kind"):
        W.reproject(empty, "v", source, target, "median")
    assert W.block_for(W.Grid(4326, 8.0, 50.0, 1.0, 1.0, 30, 40), W.Grid(4326, 8.0, 50.0, 0.001, 0.001, 30000, 40000)) == 8


@pytest.mark.parametrize(("block", "side"), [(None, 256), (11, 9)])
def test_splines_go_through_their_pixels(spark, block, side):
    values = np.random.default_rng(6).uniform(0, 100, (30, 25))
    px = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(30) for c in range(25)], "row long, col long, v double")
    got = {(r.row, r.col): r.v for r in W.zoom(px, "v", 30, 25, 59 / 30, 49 / 25, 3, block, side).collect()}
    assert len(got) == 59 * 49
    assert all(abs(got[2 * r, 2 * c] - values[r, c]) < 1e-9 for r in range(30) for c in range(25))


def test_spline_coefficients_solve_the_spline():
    """(c[i - 1] + 4 c[i] + c[i + 1]) / 6 is the pixel, with mirrored neighbours at the edges."""
    values = np.random.default_rng(7).uniform(-5, 5, (9, 1))
    c = np.pad(W.spline_coefficients(values), ((1, 1), (0, 0)), "reflect")
    assert np.abs((c[:-2] + 4 * c[1:-1] + c[2:]) / 6 - values).max() < 1e-12


@pytest.mark.parametrize(("order", "want"), [(0, [0.0, 0.0, 10.0, 10.0, 20.0]), (1, [0.0, 5.0, 10.0, 15.0, 20.0])])
def test_lower_orders(spark, order, want):
    px = spark.createDataFrame([(0, c, 10.0 * c) for c in range(3)], "row long, col long, v double")
    got = [r.v for r in W.zoom(px, "v", 1, 3, 1, 5 / 3, order).orderBy("col").collect()]
    assert got[1::2] == want[1::2] if order else got[0] == 0 and got[-1] == 20
    with pytest.raises(ValueError, match="order"):
        W.zoom(px, "v", 1, 3, 1, 2, 2)
