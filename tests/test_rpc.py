"""Rational polynomial models there and back, and images made upright."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import rpc
from rasterloom.operators.reprojection import Grid


def image(width=60, height=50, **extra):
    fill = lambda **at: tuple(at.get(f"t{i}", 0.0) for i in range(20))
    shape = {"line_num": fill(t2=-1.0, t1=0.02, t4=0.01, t7=0.004), "line_den": fill(t0=1.0, t2=0.01), "samp_num": fill(t1=1.0, t2=0.03, t8=-0.006, t11=0.002), "samp_den": fill(t0=1.0, t1=-0.02)}
    return rpc.RpcImage(width, height, (height / 2, width / 2, 40.0, 10.0, 100.0), (height / 2, width / 2, 1.0, 1.0, 500.0), **(shape | extra))


def test_there_and_back():
    scene = image()
    row, col = np.mgrid[0:51:5, 0:61:5]
    lon, lat = scene.xy(row, col)
    r, c = scene.rc(lon, lat)
    assert np.abs(r - row).max() < 1e-9 and np.abs(c - col).max() < 1e-9


def test_height_moves_places():
    lifted = image(samp_num=tuple({1: 1.0, 3: 0.5}.get(i, 0.0) for i in range(20)))
    flat, high = lifted.rc(10.0, 40.0), rpc.RpcImage(**{**lifted.__dict__, "ground": 600.0}).rc(10.0, 40.0)
    assert high[1] - flat[1] == pytest.approx(0.5 * (600 / 500) * 30)


def test_terms_are_in_order():
    p, l, h = 2.0, 3.0, 5.0
    assert rpc.terms(np.array(p), np.array(l), np.array(h)).tolist() == [1, l, p, h, l * p, l * h, p * h, l * l, p * p, h * h, p * l * h, l**3, l * p * p, l * h * h, l * l * p, p**3, p * h * h, l * l * h, p * p * h, h**3]


@pytest.mark.parametrize("block", [None, 9])
def test_upright(spark, block):
    scene = image()
    values = np.random.default_rng(1).uniform(0, 9, (50, 60))
    px = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(50) for c in range(60)], "row long, col long, v double")
    grid = rpc.upright_grid(scene, 0.05)
    want = {}
    for row in range(grid.height):
        for col in range(grid.width):
            x, y = grid.xy(row + 0.5, col + 0.5)
            r, c = scene.rc(x, y)
            if 0 <= r < 50 and 0 <= c < 60:
                want[row, col] = values[int(r), int(c)]
    got = {(r.row, r.col): r.v for r in rpc.orthorectify(px, "v", scene, grid, block=block).collect()}
    assert got == want and len(want) > 1000


def test_affine_scenes_come_back(spark):
    """Where the model is a plain shift and scale, the image is itself."""
    one = lambda i, v=1.0: tuple(v if j == i else 0.0 for j in range(20))
    scene = rpc.RpcImage(60, 50, (25.0, 30.0, 40.0, 10.0, 0.0), (25.0, 30.0, 1.0, 1.0, 500.0), one(2, -1.0), one(0), one(1), one(0))
    px = spark.range(3000).select(F.expr("id div 60").alias("row"), (F.col("id") % 60).alias("col"), F.col("id").cast("double").alias("v"))
    got = rpc.orthorectify(px, "v", scene, Grid(4326, 9.0, 41.0, 2 / 60, 2 / 50, 60, 50))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, px.collect()))
    for kind in ("bilinear", "cubic"):
        far = rpc.orthorectify(px, "v", scene, Grid(4326, 9.0, 41.0, 2 / 60, 2 / 50, 60, 50), kind).withColumnRenamed("v", "w").join(px, ["row", "col"]).agg(F.max(F.abs(F.col("v") - F.col("w"))), F.count("*")).first()
        assert far[0] < 1e-6 and far[1] == 3000
