"""That work grows with rows and results, not with what a task or row would have to hold."""

import math
import random

from pyspark.sql import functions as F

from rasterloom.functions import geometry as Y
from rasterloom.operators import grids, spatial
from rasterloom.plans import catalogue, space_queries
from tests.parity import connect

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_points_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(space_queries, "PAIRS", 100)
    found = catalogue.QUERIES["variogram_cov"](spark, SF)
    assert found.rdd.getNumPartitions() == math.ceil(150 * 8 / 100)
    assert "Cartesian" not in plan(found)


def test_rounded_as_sql(spark):
    values = [0.0, 0.0000005, 0.0000015, 1.0000005, 2.5, 2.4999995, 0.49999949999999997, 1.2345675, 123.4567885]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", Y.rounded(F.col("v"), 6).alias("r"))
    assert [r.r for r in got.orderBy("i").collect()] == [connect(SF).execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]


def test_sizes_of_regions_draw_no_outlines(spark):
    for name in ("sieve_regions", "region_cells"):
        assert "Pandas" not in plan(catalogue.QUERIES[name](spark, SF))


def test_semi_join_makes_no_pairs(spark):
    for name in ("semi_images_in_region", "anti_missing"):
        found = plan(catalogue.QUERIES[name](spark, SF))
        assert "Inner" not in found and "LeftSemi" in found and "NestedLoop" not in found


def test_close_points_have_small_cells(spark):
    """40,000 points in one of the cells that a query asks for: it meets only those around it, and finds the nearest."""
    points = spark.range(40000).select("id", (F.col("id") % 200 / 100).alias("x"), (F.expr("id div 200") / 100).alias("y"), F.col("id").cast("double").alias("z"))
    assert 0.01 < spatial.close_size(points, 6) < 0.1
    queries = points.where("id % 4003 = 0").select(F.col("id").alias("q"), (F.col("x") + 0.003).alias("x"), (F.col("y") + 0.001).alias("y"))
    got = {(r.q, r["rank"]): r.id for r in spatial.nearest(queries, points, 3, 5.0).collect()}
    at = {r.id: (r.x, r.y) for r in points.collect()}
    for q, x, y in queries.collect():
        want = sorted(at, key=lambda i: (math.sqrt((at[i][0] - x) ** 2 + (at[i][1] - y) ** 2), i))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == want


def test_cells_of_odd_points(spark):
    line = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert spatial.close_size(line, 5) == 99 * 2 * 5 / 100
    assert spatial.close_size(line.where("x = 3"), 5) == spatial.close_size(line.where("false"), 5) == math.inf


def test_matches_by_blocks(spark, monkeypatch):
    """Vectors with copies, over several blocks, against all distances; ties go by the id."""
    monkeypatch.setattr(spatial, "QUERY_BLOCK", 7)
    monkeypatch.setattr(spatial, "BLOCK", 11)
    r = random.Random(5)
    vectors = {i: [r.choice([0.0, 1.0, 0.1, 2.5]) for _ in range(4)] for i in range(90)}
    vectors |= {1000: [1e6, 1e6, 1e6, 1e6], 1001: [1e6, 1e6, 1e6, 1e6 + 1e-3], 1002: [1e6, 1e6, 1e6, 1e6 - 3e-3]}
    e = spark.createDataFrame(list(vectors.items()), "id long, v array<double>").repartition(3)
    found = spatial.ratio_matches(e.where("id % 3 <> 1").withColumnRenamed("id", "q"), e.unionByName(spark.createDataFrame([(5000, None)], e.schema)), 0.95)
    want = {}
    for q in vectors:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(vectors[q], v))), i) for i, v in vectors.items() if i != q)
        if q % 3 != 1 and near[0][0] < 0.95 * near[1][0]:
            want[q] = (near[0][1], near[0][0], near[1][0])
    assert {x.q: (x.id, x.d1, x.d2) for x in found.collect()} == want and len(want) > 3


def test_equal_distances_lie_together(spark):
    for n in (1, 2, 7, 8):
        got = [(r.i, r.j, r.d) for r in grids.distance_matrix(spark, n).collect()]
        near = lambda k, n=n: min(k, n - k)
        assert sorted(got) == [(i, j, math.sqrt(near(i) ** 2 + near(j) ** 2)) for i in range(n) for j in range(n)]
        places = [(near(i), near(j)) for i, j, _ in got]
        assert sum(a != b for a, b in zip(places, places[1:])) == len(set(places)) - 1
    assert grids.distance_matrix(spark, 0).collect() == []
