"""Keypoints at planted places and scales, the same for all windows, and matches of a shifted and turned image."""

import numpy as np
import pytest

from rasterloom.operators import keypoints as K

SCALES = K.Scales(count=7)
BLOBS = [(40.0, 30.0, 2.5, 90), (42.3, 75.6, 4.0, -70), (90.0, 60.0, 3.2, 80), (95.5, 20.25, 2.2, 60), (20.0, 100.0, 3.0, 75)]


def painted(blobs, shape=(120, 130)):
    r, c = np.mgrid[: shape[0], : shape[1]]
    return sum(h * np.exp(-((r - y) ** 2 + (c - x) ** 2) / (2 * s * s)) for y, x, s, h in blobs)


def table(spark, image):
    return spark.createDataFrame([(r, c, float(image[r, c])) for r in range(image.shape[0]) for c in range(image.shape[1])], "row long, col long, v double").repartition(3)


def test_blobs_are_found_at_their_scale(spark):
    got = K.keypoints(table(spark, painted(BLOBS)), "v", K.Scales(count=7, contrast=4.0), window=64).collect()
    assert len(got) == len(BLOBS)
    for y, x, s, h in BLOBS:
        best = min(got, key=lambda k: (k.row - y) ** 2 + (k.col - x) ** 2)
        assert abs(best.row - y) < 0.35 and abs(best.col - x) < 0.35
        assert abs(best.scale / s - 1) < 0.2
        assert (best.response < 0) == (h > 0)  # a bright blob gets darker by smoothing


def test_windows_change_nothing(spark):
    image = np.random.default_rng(1).normal(0, 40, (90, 110))
    image = K.smoothed(image, np.ones(image.shape, bool), 1.0)
    image[30:40, 50:55] = np.nan
    wide = np.pad(image, m := SCALES.margin, constant_values=np.nan)
    whole = K.found_in(wide, ~np.isnan(wide), SCALES, (m, m + 90, m, m + 110))
    want = sorted((round(r - m, 6), round(c - m, 6), round(s, 6), round(a, 6)) for r, c, s, a, _, _ in whole)
    assert len(want) > 15
    for window in (256, 37):
        got = K.keypoints(table(spark, image), "v", SCALES, window).collect()
        assert np.allclose(sorted((round(k.row, 6), round(k.col, 6), round(k.scale, 6), round(k.angle, 6)) for k in got), want, atol=1e-5)
        assert all(abs(np.linalg.norm(k.descriptor) - 1) < 1e-5 for k in got)


@pytest.mark.parametrize("block", [512, 40])
def test_matches_of_a_shifted_image(spark, block):
    image = K.smoothed(np.random.default_rng(4).normal(0, 60, (150, 150)), np.ones((150, 150), bool), 1.2)
    a, b = (K.keypoints(table(spark, part), "v", SCALES, 100) for part in (image[:130, :130], image[9:139, 5:135]))
    got = K.matched(a, b, block, 60, 0.7).collect()
    right = [m for m in got if abs(m.row - m.row_b - 9) < 0.5 and abs(m.col - m.col_b - 5) < 0.5]
    assert len(right) > 20 and len(right) > 0.95 * len(got)


def test_descriptors_turn_with_the_image():
    image = K.smoothed(np.random.default_rng(5).normal(0, 60, (121, 121)), np.ones((121, 121), bool), 2.0)
    turned = np.rot90(image)
    whole = [K.found_in(x, np.ones(x.shape, bool), SCALES, (45, 76, 45, 76)) for x in (image, turned)]
    assert len(whole[0]) > 2
    for r, c, *_, d in whole[0]:
        # a quarter turn takes (r, c) to (120 - c, r)
        y, x, *_, e = min(whole[1], key=lambda k: (k[0] - (120 - c)) ** 2 + (k[1] - r) ** 2)
        assert abs(y - (120 - c)) < 1e-6 and abs(x - r) < 1e-6
        assert float(d @ e) > 0.9


def test_nothing_to_find(spark):
    assert K.keypoints(table(spark, np.zeros((0, 0))), "v").collect() == []
    assert K.keypoints(table(spark, np.full((20, 20), 7.0)), "v", SCALES).collect() == []
    empty = K.keypoints(table(spark, np.zeros((0, 0))), "v")
    assert K.matched(empty, empty).collect() == []
