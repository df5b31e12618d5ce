"""Known values and properties of functions and operators."""

import datetime
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import geometry as Y
from rasterloom.functions import metadata as M
from rasterloom.functions import radiometry as R
from rasterloom.functions import tiling as T
from rasterloom.functions import times as D
from rasterloom.operators import fitting, grids, rasters, regions, spatial
from rasterloom.operators import statistics as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_bilinear(spark):
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(v)).alias("value")) for x, y, v in ((10, 4, 100), (20, 4, 200), (10, 6, 150), (20, 6, 300))])
    assert one(spark, Y.bilinear(F.lit(12.0), F.lit(5.5), corners))[0] == pytest.approx(165.0)
    with pytest.raises(Exception, match="outside"):
        one(spark, Y.bilinear(F.lit(30.0), F.lit(5.5), corners))


def test_distance_matrix_and_disk(spark):
    m = {(r.i, r.j): r.d for r in grids.distance_matrix(spark, 4).collect()}
    assert m[0, 0] == 0 and m[2, 0] == 2 and m[3, 3] == pytest.approx(math.sqrt(2))
    disk = {(r.i, r.j): r.v for r in grids.disk(spark, 2).collect()}
    assert [sum(disk[i, j] for j in range(5)) for i in range(5)] == [1, 3, 5, 3, 1]


def test_inverse_distance_weights(spark):
    n = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, 2.0), (0, 0.0, 3.0)], "q long, z double, d double")
    assert spatial.inverse_distance(n, 1).first().value == pytest.approx(0.55, abs=0.01)
    assert spatial.inverse_distance(n, 2).first().value == pytest.approx(0.74, abs=0.01)
    exact = spark.createDataFrame([(0, 7.0, 0.0), (0, 1.0, 2.0)], "q long, z double, d double")
    assert spatial.inverse_distance(exact, 1).first().value == 7.0


def test_dates(spark):
    d = F.lit("2017-03-12").cast("date")
    got = one(spark, D.to_iso(D.next_date(d)), D.to_iso(D.prev_date(d)), D.day_of_year_date(F.lit(2018093)), F.size(D.date_range(d, F.date_sub(d, 1))))
    assert got == ("2017-03-13", "2017-03-11", "20180403", 0)


def test_mercator_constants(spark):
    m = T.Mercator()
    assert one(spark, m.resolution(F.lit(0)))[0] == pytest.approx(156543.03392804062)
    assert T.SHIFT == pytest.approx(20037508.342789244)
    assert one(spark, T.quadkey(F.lit(0), F.lit(0), F.lit(0)))[0] == ""


def test_fishnet(spark):
    box = spark.createDataFrame([(36570535.0, 3797003.0, 36575818.0, 3800370.0)], "xmin double, ymin double, xmax double, ymax double")
    cells = grids.fishnet(box, 2000.0, 2000.0)
    assert cells.count() == 6 and cells.agg(F.max("name")).first()[0] == "grid_0003_0002"


@settings(max_examples=15, deadline=None)
@given(st.floats(0.1, 30), st.sampled_from(sorted(R.MODIS_BANDS)))
def test_temperature_inverts(spark, radiance, band):
    t = R.brightness_temperature(F.lit(radiance), band)
    assert one(spark, R.emissive_radiance(t, band))[0] == pytest.approx(radiance, rel=1e-6)


@settings(max_examples=15, deadline=None)
@given(st.floats(-179, 179), st.floats(-84, 84), st.integers(0, 18))
def test_tile_holds_its_point(spark, lon, lat, zoom):
    x, y = T.slippy_tile(F.lit(lon), F.lit(lat), F.lit(zoom))
    west, north = T.tile_corner(x, y, F.lit(zoom))
    east, south = T.tile_corner(x + 1, y + 1, F.lit(zoom))
    w, n, e, s = one(spark, west, north, east, south)
    assert w - 1e-9 <= lon <= e + 1e-9 and s - 1e-9 <= lat <= n + 1e-9


def test_nearest_percentile_is_half_to_even(spark):
    for n in (4, 6, 7):
        px = spark.range(n).select(F.col("id").alias("v"))
        want = np.arange(n)[int(np.rint(0.5 * (n - 1)))]
        assert S.nearest_percentiles(px, "v", {"p": 50}).first().p == want


def test_byte_scale_edges(spark):
    v = spark.createDataFrame([(0,), (10,), (35,), (60,), (65535,), (None,)], "v int")
    got = [r[0] for r in v.select(R.byte_scale(F.col("v"), 10, 60, nodata=65535)).collect()]
    assert got == [0, 0, 127, 255, 255, None]
    with pytest.raises(ValueError):
        R.byte_scale(F.col("v"), 5, 5)


def test_mosaic_orders(spark):
    px = spark.createDataFrame([(0, 0, 1, -1.0), (0, 0, 2, 5.0), (0, 0, 3, -1.0), (0, 1, 1, -1.0)], "row int, col int, ord int, v double")
    first = {r.col: r.v for r in rasters.mosaic(px, "v", "ord", "first", -1.0).collect()}
    last = {r.col: r.v for r in rasters.mosaic(px.repartition(3), "v", "ord", "last").collect()}
    assert first == {0: 5.0, 1: -1.0} and last == {0: -1.0, 1: -1.0}


def test_polynomial_fit_recovers_a_plane(spark):
    p = spark.range(60).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y")).withColumn("z", 3 + 2 * F.col("x") - F.col("y"))
    assert fitting.polynomial_fit(p, "z").first()[0] == pytest.approx([3, 2, -1])


def test_helmert_fit_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    a = [1.0, 2.0, 3.0, 1e-4, 2e-4, 3e-4, 1e-5]
    pts = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(-100, 100, (4, 3))], "x double, y double, z double")
    u, v, w = T.helmert(F.col("x"), F.col("y"), F.col("z"), a)
    got = fitting.helmert_fit(pts.withColumns({"u": u, "v": v, "w": w})).first()
    assert [got.rx, got.ry, got.rz, got.scale] == pytest.approx(a[3:], abs=1e-9) and got.sigma < 1e-8


def test_kriging_goes_through_its_points(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 2.0), (2, 0.0, 1.0, 4.0)], "id long, x double, y double, z double")
    got = {r.q: r.value for r in fitting.krige(p, p.withColumnRenamed("id", "q"), "exponential", 0.0, 1.0, 5.0).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([1, 2, 4])


def test_ransac_drops_outliers(spark):
    rng = np.random.default_rng(3)
    s = rng.uniform(0, 100, (40, 2))
    rows = [(1, float(x), float(y), float(2 * x + 1 + (50 if i < 6 else 0)), float(y - 3)) for i, (x, y) in enumerate(s)]
    kept = fitting.ransac(spark.createDataFrame(rows, "g int, x double, y double, xr double, yr double"), 1e-6, ["g"])
    assert kept.count() == 34


@pytest.mark.parametrize("window", [64, 3, 2])
def test_regions_are_four_connected(spark, window):
    grid = ["##..#", "#..##", "..#..", "###.."]
    px = spark.createDataFrame([(r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)], "row long, col long, v string")
    got = regions.regions(px, F.col("v") == "#", window).collect()
    assert sorted(r.cells for r in got) == [3, 3, 4]
    assert any(r.wkt == "POLYGON ((0 0, 2 0, 2 1, 1 1, 1 2, 0 2, 0 0))" for r in got)


@pytest.mark.parametrize("window", [100, 7])
def test_regions_are_whole_across_windows(spark, window):
    """Against labels of the whole raster; outlines less holes cover as much as the cells, and a sieve goes by whole regions."""
    rng = np.random.default_rng(12)
    there = rng.random((40, 33)) < 0.6
    rows, cols = np.nonzero(there)
    label = regions.label_cells(rows, cols)
    want = {(int(rows[k]), int(cols[k])): int((label == k).sum()) for k in np.unique(label)}
    px = spark.createDataFrame([(r, c, bool(v)) for (r, c), v in np.ndenumerate(there)], "row long, col long, v boolean")
    found = regions.regions(px, F.col("v"), window)
    got = found.collect()
    assert {(r.row, r.col): r.cells for r in got} == want
    for r in got:
        rings = [[tuple(map(int, p.split())) for p in ring.split(", ")] for ring in re.findall(r"\(([^()]+)\)", r.wkt)]
        areas = [sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) / 2 for ring in rings]
        assert sum(areas) == r.cells and areas[0] > 0 and all(a < 0 for a in areas[1:])
    assert regions.sieve(found, 5).count() == sum(n >= 5 for n in want.values())


def test_rows_are_numbered_in_order(spark):
    ids = sorted({int(x) for x in np.random.default_rng(1).integers(-3000, 5_000_000, 4000)})
    got = S.numbered(spark.createDataFrame([(i,) for i in ids], "k long").repartition(5), "k", "n", 10).collect()
    assert sorted((r.k, r.n) for r in got) == [(k, n) for n, k in enumerate(ids, 1)]


def test_percentiles_of_far_values_and_groups(spark):
    """Against numpy's nearest ranks, with values that are far off, infinite and NaN, and in no task all values of a group."""
    rng = np.random.default_rng(3)
    values = {"a": np.concatenate((rng.normal(0, 5, 3000), [1e38, -1e30, np.inf, -np.inf, np.nan])), None: np.array([7.0] * 5), "b": rng.integers(0, 4, 500).astype(float)}
    rows = [(g, float(v)) for g, x in values.items() for v in x]
    got = S.nearest_percentiles(spark.createDataFrame(rows, "g string, v double"), "v", {"p2": 2, "p50": 50, "p100": 100}, by=["g"]).collect()
    for r in got:
        x = np.sort(values[r.g])
        for name, p in (("p2", 2), ("p50", 50), ("p100", 100)):
            assert r[name] == x[int(np.rint(p / 100 * (len(x) - 1)))] or (np.isnan(r[name]) and np.isnan(x[-1]))
    assert len(got) == 3


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = rng.uniform(-50, 50, (300, 2))
    rows = [(i, float(x), float(y), float(i)) for i, (x, y) in enumerate(pts)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    queries = spark.createDataFrame([(0, 0.0, 0.0), (1, 49.0, -49.0), (2, 500.0, 500.0)], "q long, x double, y double")
    got = {}
    for r in spatial.nearest(queries, points, 4, 3.0).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    for q, at in ((0, (0, 0)), (1, (49, -49)), (2, (500, 500))):
        assert got[q] == np.argsort(np.hypot(*(pts - at).T))[:4].tolist()


def test_nearest_goes_on_until_all_are_found(spark):
    """Points far apart against the cells, on their edges and in one place, fewer than wanted, and none at all."""
    rows = [(0, 0.0, 0.0, 0.0), (1, 3.0, 0.0, 1.0), (2, -3.0, 0.0, 2.0), (3, -3.0, 0.0, 3.0), (4, 4000.0, 0.0, 4.0)]
    schema = "id long, x double, y double, z double"
    queries = spark.createDataFrame([(7, 0.0, 0.0), (8, 3999.0, 1.0)], "q long, x double, y double")
    ids = lambda k, points: {q: [r.id for r in sorted(rs, key=lambda r: r.rank)] for q, rs in ((q, [r for r in spatial.nearest(queries, points, k, 3.0).collect() if r.q == q]) for q in (7, 8))}
    assert ids(3, spark.createDataFrame(rows, schema)) == {7: [0, 1, 2], 8: [4, 1, 0]}
    assert ids(9, spark.createDataFrame(rows, schema)) == {7: [0, 1, 2, 3, 4], 8: [4, 1, 0, 2, 3]}
    assert ids(2, spark.createDataFrame([], schema)) == {7: [], 8: []}


def test_partitions_do_not_matter(spark):
    px = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), ((F.col("id") * 37) % 101).alias("v"))
    runs = [sorted(map(tuple, S.linear_stretch(px.repartition(n), "v").select("row", "col", "out").collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("kind", ["cubic", "cubicspline", "lanczos"])
def test_kernels_keep_constants_and_match_numpy(spark, kind):
    rng = np.random.default_rng(2)
    v = rng.uniform(0, 9, (12, 12))
    px = spark.createDataFrame([(r, c, float(v[r, c]), 3.0) for r in range(12) for c in range(12)], "row long, col long, v double, k double")
    t = spark.createDataFrame([(0, 5.3, 6.8), (1, 0.2, 11.0)], "id long, r double, c double")
    assert [x.value for x in rasters.kernel_resample(px, "k", t, kind).collect()] == pytest.approx([3.0, 3.0])

    def weight(d):
        a = abs(d)
        if kind == "cubic":
            return 1.5 * a**3 - 2.5 * a**2 + 1 if a < 1 else -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2 if a < 2 else 0
        if kind == "cubicspline":
            return (4 - 6 * a**2 + 3 * a**3) / 6 if a < 1 else (2 - a) ** 3 / 6 if a < 2 else 0
        return float(np.sinc(a) * np.sinc(a / 3)) if a < 3 else 0

    w = np.array([[weight(5.3 - r) * weight(6.8 - c) for c in range(12)] for r in range(12)])
    got = {x.id: x.value for x in rasters.kernel_resample(px, "v", t, kind).collect()}
    assert got[0] == pytest.approx((w * v).sum() / w.sum())


def test_smoothing_keeps_the_sum(spark):
    cells = spark.createDataFrame([(5, 5, 2.0), (9, 5, 1.0)], "x int, y int, n double")
    out = rasters.smoothed(cells, "x", "y", "n")
    assert out.agg(F.sum("n")).first()[0] == pytest.approx(3.0)
    assert out.orderBy(F.desc("n")).first().x == 5


def test_helmert_fit_is_over_all_pairs(spark):
    """Two halves of a table, moved by different amounts: the fit is that of least squares over both."""
    rng = np.random.default_rng(4)
    s = rng.uniform(-50, 50, (60, 3))
    t = s * 1.001 + [1, 2, 3] + rng.normal(0, 0.01, (60, 3)) + (np.arange(60) >= 30)[:, None] * 0.5
    pts = spark.createDataFrame([tuple(map(float, [*a, *b])) for a, b in zip(s, t)], "x double, y double, z double, u double, v double, w double")
    got = fitting.helmert_fit(pts.repartition(5)).first()
    k, r = 1 + got.scale, np.array([[1, got.rz, -got.ry], [-got.rz, 1, got.rx], [got.ry, -got.rx, 1]])
    left = t - t.mean(0) - [got.dx, got.dy, got.dz] - k * (s - s.mean(0)) @ r.T
    assert got.sigma == pytest.approx(np.sqrt((left**2).sum() / (180 - 7)))
    for column, step in ((0, 1e-3), (1, 1e-3), (2, 1e-3)):
        moved = r.copy()
        i, j = [(1, 2), (2, 0), (0, 1)][column]
        moved[i, j] += step
        moved[j, i] -= step
        assert ((t - t.mean(0) - k * (s - s.mean(0)) @ moved.T) ** 2).sum() > (left**2).sum()


def test_kriging_beyond_a_dense_system(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p = [(i, float(x), float(y), float(x + 2 * y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (200, 2)))]
    points = spark.createDataFrame(p, "id long, x double, y double, z double")
    queries = spark.createDataFrame([(500, 5.0, 5.0), (501, 1.0, 9.0), (502, p[3][1], p[3][2])], "q long, x double, y double")
    got = {r.q: (r.value, r.variance) for r in fitting.krige(points, queries, "spherical", 0.0, 2.0, 6.0, near=12).collect()}
    place = np.array([r[1:3] for r in p])
    for q, x, y in queries.collect():
        d = np.hypot(*(place - [x, y]).T)
        at = np.argsort(d)[:12]
        cov = lambda h: np.where(h == 0, 2.0, 2.0 * (1 - np.minimum(h / 6, 1) * (1.5 - 0.5 * np.minimum(h / 6, 1) ** 2)))
        a, b = np.ones((13, 13)), np.ones(13)
        a[:12, :12] = cov(np.hypot(*(place[at][:, None] - place[at][None]).transpose(2, 0, 1)))
        a[12, 12], b[:12] = 0, cov(d[at])
        w = np.linalg.solve(a, b)
        assert got[q] == pytest.approx((w[:12] @ [p[i][3] for i in at], 2.0 - w @ b))


def test_ransac_judges_every_point_and_small_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(x), float(y), float(2 * x + 1 + (50 if i % 5 == 0 else 0)), float(y - 3)) for g in (1, 2) for i, (x, y) in enumerate(rng.uniform(0, 100, (3000, 2)))]
    few = [(3, 0.0, 0.0, 9.0, 9.0), (3, 1.0, 0.0, 3.0, 4.0)]
    kept = fitting.ransac(spark.createDataFrame(rows + few, "g int, x double, y double, xr double, yr double").repartition(3), 1e-6, ["g"])
    assert {r.g: r["count"] for r in kept.groupBy("g").count().collect()} == {1: 2400, 2: 2400, 3: 2}


def test_fits_use_the_whole_table(spark):
    from rasterloom.plans import catalogue, views

    sf = "/root/testdata/sf0.01"
    ids = {r.id for r in views.pt_cust(spark, sf).select("id").collect()}
    assert {r.q for r in catalogue.QUERIES["krige_solve"](spark, sf).collect()} == ids
    kept = {r.part: r.kept for r in catalogue.QUERIES["ransac_gcps"](spark, sf).collect()}
    assert kept == {k: sum(i % 2 == k and i % 9 != 0 for i in ids) for k in (0, 1)}
    helmert = catalogue.QUERIES["helmert_solve"](spark, sf).first()
    assert list(helmert) == pytest.approx([1e-4, 2e-4, 3e-4, 1e-5, 0], abs=2e-6)


def test_current_date_is_one_day_for_all_rows(spark):
    before = datetime.date.today().isoformat()
    found = [r.d for r in spark.range(3).select(D.current_date().alias("d")).collect()]
    assert len(set(found)) == 1 and before <= found[0] <= datetime.date.today().isoformat()


def test_listing_patterns(spark):
    keys = ["gs://b/50/S/MJ/a202010b", "gs://b/50/S/MJ/a202010b/GRANULE", "gs://b/50/S/MJ/a202011b", "gs://b/50/S/MJ/x.SAFE/TCI.jp2", "gs://b/50/S/MJ/xSAFE/TCI.jp2"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    shown = lambda pattern: [keys.index(r.k) for r in df.where(M.is_listed(F.col("k"), pattern)).collect()]
    assert shown("gs://b/50/S/MJ/*202010*") == [0] and shown("gs://b/50/S/MJ/*202010**") == [0, 1]
    assert shown("gs://b/50/S/MJ/*.SAFE/*TCI.jp2") == [3] and shown("gs://b/50/S/MJ/**") == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(("few", "bins"), [(200_000, 65_536), (40, 64), (5, 256)])
def test_percentiles_of_crowded_values(spark, few, bins):
    """Values close together beside far, endless and equal ones: refinement finds the same ranks as sorting."""
    import random

    r = random.Random(3)
    groups = {
        "crowded": [1000 + r.random() / 100 for _ in range(400)] + [1e9],
        "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-12, 300) for _ in range(300)] + [0.0, -0.0, 5e-324, -5e-324],
        "ends": [float("inf"), float("-inf"), float("nan"), 1.7e308, -1.7e308, 1.0, 1.0, 2.0] * 3,
        "one": [4.0] * 9,
        None: [1.0, 2.0, 3.0],
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None)]
    r.shuffle(rows)
    percents = {"p0": 0, "p2": 2, "p50": 50, "p97": 97.5, "p100": 100}
    got = {x.g: x for x in S.nearest_percentiles(spark.createDataFrame(rows, "g string, v double"), "v", percents, by=["g"], few=few, bins=bins).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        order = sorted(vs, key=lambda v: (v != v, v))
        for name, p in percents.items():
            want = order[round(p / 100 * (len(order) - 1))]
            assert got[g][name] == want or (want != want and got[g][name] != got[g][name]), (g, name)


def test_percentiles_order_few_values_in_a_task(spark):
    """200,000 values within a hundredth and a far one: at the end no interval holds more values than asked for."""
    px = spark.range(200_001).select(F.when(F.col("id") == 200_000, 1e9).otherwise(1000 + F.col("id") * 5e-8).alias("v"))
    counts = px.groupBy(F.col("v").alias("__v")).agg(F.count("*").alias("__n"))
    rows = S.intervals(counts, [], {"a": 1, "b": 50, "c": 99}, 500, 1024).collect()
    assert len(rows) == 3 and all(r["__rows"] <= 500 for r in rows)
    found = S.nearest_percentiles(px, "v", {"a": 1, "b": 50, "c": 99}, few=500, bins=1024).first()
    assert [found.a, found.b, found.c] == [1000 + k * 5e-8 for k in (2000, 100_000, 198_000)]


def test_kriging_has_one_method_at_all_sizes(spark):
    """With all points near, the system is that of all points, however many there are; without points there are no rows."""
    rng = np.random.default_rng(5)
    p = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rng.uniform(0, 10, (40, 3)))]
    points = spark.createDataFrame(p, "id long, x double, y double, z double")
    queries = spark.createDataFrame([(0, 1.0, 2.0), (1, 9.5, 9.0), (2, -5.0, 40.0)], "q long, x double, y double")
    got = {r.q: r.value for r in fitting.krige(points, queries, "exponential", 0.1, 2.0, 6.0, near=100).collect()}
    place, z = np.array([r[1:3] for r in p]), np.array([r[3] for r in p])
    cov = lambda h: np.where(h == 0, 2.1, 2.0 * np.exp(-3 * h / 6))
    a = np.ones((41, 41))
    a[:40, :40], a[40, 40] = cov(np.hypot(*(place[:, None] - place[None]).transpose(2, 0, 1))), 0
    for q, x, y in queries.collect():
        w = np.linalg.solve(a, np.append(cov(np.hypot(*(place - [x, y]).T)), 1))
        assert got[q] == pytest.approx(w[:40] @ z)
    assert fitting.krige(points.where("false"), queries).collect() == []


def test_ransac_without_broadcast(spark, monkeypatch):
    from rasterloom import storage

    rng = np.random.default_rng(3)
    rows = [(g, float(x), float(y), float(2 * x + 1 + (50 if i < 6 else 0)), float(y - 3)) for g in (1, 2) for i, (x, y) in enumerate(rng.uniform(0, 100, (40, 2)))]
    rows += [(3, 0.0, 0.0, 1.0, 1.0)] * 2
    pairs = spark.createDataFrame(rows, "g int, x double, y double, xr double, yr double")
    kept = [sorted(map(tuple, fitting.ransac(pairs, 1e-6, ["g"]).collect()))]
    monkeypatch.setattr(storage, "MOST_BROADCAST", 0)
    kept.append(sorted(map(tuple, fitting.ransac(pairs, 1e-6, ["g"]).collect())))
    assert kept[0] == kept[1] and len(kept[0]) == 70
