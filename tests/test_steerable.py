"""Oriented pyramids: windows change nothing, parts sum up, directions are told."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import steerable as S


def table(spark, image):
    return spark.createDataFrame([(r, c, float(image[r, c])) for r in range(image.shape[0]) for c in range(image.shape[1])], "row long, col long, v double").repartition(3)


def plain(image, kernel):
    n = kernel.shape[0] // 2
    padded = np.pad(image, n, "reflect")
    return sum(kernel[i, j] * padded[i : i + image.shape[0], j : j + image.shape[1]] for i in range(2 * n + 1) for j in range(2 * n + 1))


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize("window", [256, 9, 1])
def test_pyramid(spark, order, window):
    image = np.random.default_rng(2).integers(0, 256, (21, 34)).astype(float)
    got = {}
    for r in S.steerable_pyramid(table(spark, image), "v", 21, 34, 2, order, window).collect():
        got[r.level, r.name, r.row, r.col] = r.v
    f = S.filters(order)
    want, low = {(0, "highpass"): plain(image, f.high0)}, plain(image, f.low0)
    for level in range(2):
        want |= {(level, f"band{k}"): plain(low, b) for k, b in enumerate(f.bands)}
        low = plain(low, f.low)[::2, ::2]
    want[2, "lowpass"] = low
    flat = {(*k, r, c): v[r, c] for k, v in want.items() for r in range(v.shape[0]) for c in range(v.shape[1])}
    assert set(got) == set(flat) and all(abs(got[k] - flat[k]) < 1e-9 for k in flat)


def test_rests_sum_up_and_slopes_have_directions(spark):
    ramp = np.add.outer(np.arange(20) * 3.0, np.arange(20) * 5.0)
    rows = S.steerable_pyramid(table(spark, ramp), "v", 20, 20, 1, 1).where("level = 0 and row between 5 and 14 and col between 5 and 14").groupBy("name").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()
    assert {(r.name, round(r.a, 6), round(r.b, 6)) for r in rows} == {("highpass", 0.0, 0.0), ("band0", -3.0, -3.0), ("band1", -5.0, -5.0)}
    assert S.steerable_pyramid(table(spark, np.zeros((0, 0))), "v", 0, 0).collect() == []
    with pytest.raises(ValueError, match="order"):
        S.filters(3)
