"""Queries on boxes, points, neighbours and fits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.functions import geometry as Y
from rasterloom.functions import tiling as T
from rasterloom.operators import fitting, polygons, regions, rpc, spatial
from rasterloom.operators import statistics as S
from rasterloom.plans import views as V
from rasterloom.plans.catalogue import register
from rasterloom.storage import broadcast_few, checkpointed

#: Pairs of points for a task.
PAIRS = 4_000_000
_MEET = "a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin"


@register("bbox_intersect_join", f"SELECT a.id AS a_id, b.id AS b_id FROM {V.BB_ORD} a JOIN {V.BB_SUPP} b ON {_MEET}")
def _(spark, d):
    return spatial.box_join(V.boxes(spark, d), V.boxes(spark, d, "suppliers"), 10.0).select("a_id", "b_id")


@register("bbox_touching_open", f"SELECT a.id AS a_id, b.id AS b_id FROM {V.BB_ORD} a JOIN {V.BB_SUPP} b ON {_MEET.replace('=', '')}")
def _(spark, d):
    return spatial.box_join(V.boxes(spark, d), V.boxes(spark, d, "suppliers"), 10.0, closed=False).select("a_id", "b_id")


@register("semi_images_in_region", f"SELECT a.id FROM {V.BB_ORD} a WHERE EXISTS (SELECT 1 FROM {V.BB_SUPP} b WHERE {_MEET})")
def _(spark, d):
    return spatial.box_semi(V.boxes(spark, d), V.boxes(spark, d, "suppliers"), 10.0, "id").select("id")


@register("anti_missing", f"SELECT a.id FROM {V.BB_ORD} a WHERE NOT EXISTS (SELECT 1 FROM {V.BB_SUPP} b WHERE {_MEET})")
def _(spark, d):
    return spatial.box_semi(V.boxes(spark, d), V.boxes(spark, d, "suppliers"), 10.0, "id", anti=True).select("id")


@register("layer_bounds", f"SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM {V.BB_SUPP}")
def _(spark, d):
    return spatial.layer_box(V.boxes(spark, d, "suppliers"))


def _knn(power: int) -> str:
    return f"WITH p AS (SELECT id, lon AS x, lat AS y, z FROM {V.PT_CUST}), q AS (SELECT id AS q, lon + 0.05::DOUBLE AS x, lat + 0.05::DOUBLE AS y FROM {V.PT_CUST} WHERE id % 20 = 0), n AS (SELECT q.q, p.id, p.z, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d, row_number() OVER (PARTITION BY q.q ORDER BY sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), p.id) AS r FROM q, p) SELECT q, round(sum(z / pow(d, {power})) / sum(1 / pow(d, {power})), 4) AS value FROM n WHERE r <= 6 GROUP BY q"


def _neighbours(spark, d, k=6):
    pts = V.pt_cust(spark, d)
    points = pts.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "z")
    queries = pts.where("id % 20 = 0").select(F.col("id").alias("q"), (F.col("lon") + 0.05).alias("x"), (F.col("lat") + 0.05).alias("y"))
    return spatial.nearest(queries, points, k, 5.0)


for _power in (1, 2):

    @register(f"knn_idw_p{_power}", _knn(_power))
    def _(spark, d, p=_power):
        return spatial.inverse_distance(_neighbours(spark, d), p).select("q", F.round("value", 4).alias("value"))


@register(
    "ratio_match_2nn",
    "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT q.id AS q, t.id, list_distance(q.v, t.v) AS d FROM e q JOIN e t ON q.id <> t.id WHERE q.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM p), w AS (SELECT q, max(CASE WHEN r = 1 THEN id END) AS id, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM r WHERE r <= 2 GROUP BY q) SELECT q, id, round(d1, 5) AS d1, round(d2, 5) AS d2 FROM w WHERE d1 < 0.95::DOUBLE * d2",
)
def _(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return spatial.ratio_matches(e.where("id % 20 = 0").withColumnRenamed("id", "q"), e, 0.95).select("q", "id", F.round("d1", 5).alias("d1"), F.round("d2", 5).alias("d2"))


@register("bilinear_point", "SELECT id, round((a * (10 - fx) * (5 - fy) + c * fx * (5 - fy) + b * (10 - fx) * fy + e * fx * fy) / 50, 6) AS value FROM (SELECT p_partkey AS id, p_partkey % 11 AS fx, p_partkey % 6 AS fy, p_size::DOUBLE AS a, p_size + 1.0::DOUBLE AS b, p_size * 2.0::DOUBLE AS c, p_retailprice AS e FROM part)")
def _(spark, d):
    p = V.table(spark, d, "part")
    corner = lambda x, y, v: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), v.cast("double").alias("value"))
    s = F.col("p_size")
    corners = F.array(corner(10, 5, F.col("p_retailprice")), corner(0, 0, s), corner(10, 0, s * 2.0), corner(0, 5, s + 1.0))
    return p.select(F.col("p_partkey").alias("id"), F.round(Y.bilinear(F.col("p_partkey") % 11, F.col("p_partkey") % 6, corners), 6).alias("value"))


_H = "d / 40.0::DOUBLE"
_SHAPES = {"exponential": f"exp(-3.0::DOUBLE * {_H})", "spherical": f"1 - least({_H}, 1) * (1.5::DOUBLE - 0.5::DOUBLE * least({_H}, 1) * least({_H}, 1))", "gaussian": f"exp(-3.0::DOUBLE * ({_H}) * ({_H}))", "linear": f"1 - least({_H}, 1)"}


_D = "sqrt(pow(p.lon - q.lon, 2) + pow(p.lat - q.lat, 2))"


@register("variogram_cov", "SELECT a, b, " + ", ".join(f"round(CASE WHEN d = 0 THEN 2.5::DOUBLE ELSE 2.0::DOUBLE * ({e}) END, 6) AS {n}" for n, e in _SHAPES.items()) + f" FROM (SELECT p.id AS a, q.id AS b, {_D} AS d FROM {V.PT_CUST} p, {V.PT_CUST} q WHERE q.id % 20 = 0)")
def _(spark, d):
    """All points against the stated ones, which are broadcast if they are few; otherwise Spark pairs the partitions of the two."""
    p = V.pt_cust(spark, d)
    stated = checkpointed(p.where("id % 20 = 0").select(F.col("id").alias("b"), F.col("lon").alias("u"), F.col("lat").alias("w")))
    # a small table is one task, whose pairs are many
    tasks = math.ceil(p.count() * stated.count() / PAIRS)
    points = p.select(F.col("id").alias("a"), F.col("lon").alias("x"), F.col("lat").alias("y")).repartition(max(tasks, 1))
    x, y = F.col("x") - F.col("u"), F.col("y") - F.col("w")
    dist = points.crossJoin(broadcast_few(stated)).withColumn("d", F.sqrt(x * x + y * y))
    return dist.select("a", "b", *[Y.rounded(Y.covariance(m, F.col("d"), 0.5, 2.0, 40.0), 6).alias(m) for m in _SHAPES])


@register("helmert_apply", f"SELECT id, round(10 + 1.5::DOUBLE * (lon + 0.3::DOUBLE * lat - 0.2::DOUBLE * z), 6) AS x, round(20 + 1.5::DOUBLE * (-0.3::DOUBLE * lon + lat + 0.1::DOUBLE * z), 6) AS y, round(30 + 1.5::DOUBLE * (0.2::DOUBLE * lon - 0.1::DOUBLE * lat + z), 6) AS h FROM {V.PT_CUST}")
def _(spark, d):
    x, y, h = T.helmert(F.col("lon"), F.col("lat"), F.col("z"), [10.0, 20.0, 30.0, 0.1, 0.2, 0.3, 0.5])
    return V.pt_cust(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(h, 6).alias("h"))


@register("helmert_design", f"SELECT id, round(-1.5::DOUBLE * z, 6) AS a05, round(1.5::DOUBLE * lat, 6) AS a06, round(lon + 0.3::DOUBLE * lat - 0.2::DOUBLE * z, 6) AS a07 FROM {V.PT_CUST}")
def _(spark, d):
    m = T.helmert_design(F.col("lon"), F.col("lat"), F.col("z"), [10.0, 20.0, 30.0, 0.1, 0.2, 0.3, 0.5])
    return V.pt_cust(spark, d).select("id", *[F.round(m[0][i], 6).alias(f"a0{i + 1}") for i in (4, 5, 6)])


@register("poly_design", f"SELECT id, 1.0::DOUBLE AS t0, lon AS t1, lat AS t2, round(lon * lon, 6) AS t3, round(lon * lat, 6) AS t4, round(lat * lat, 6) AS t5 FROM {V.PT_CUST}")
def _(spark, d):
    t = Y.polynomial_terms(F.col("lon"), F.col("lat"), 2)
    return V.pt_cust(spark, d).select("id", *[(F.round(t[i], 6) if i > 2 else t[i]).alias(f"t{i}") for i in range(6)])


_SUMS = "SELECT count(*)::DOUBLE AS n, sum(lon) AS sx, sum(lat) AS sy, sum(lon*lon) AS sxx, sum(lon*lat) AS sxy, sum(lat*lat) AS syy, sum(z) AS sz, sum(lon*z) AS sxz, sum(lat*z) AS syz FROM " + V.PT_CUST
_DET = "(n*(sxx*syy-sxy*sxy) - sx*(sx*syy-sxy*sy) + sy*(sx*sxy-sxx*sy))"


@register(
    "poly_residual",
    f"WITH s AS ({_SUMS}), c AS (SELECT (sz*(sxx*syy-sxy*sxy) - sx*(sxz*syy-sxy*syz) + sy*(sxz*sxy-sxx*syz))/{_DET} AS a, (n*(sxz*syy-sxy*syz) - sz*(sx*syy-sxy*sy) + sy*(sx*syz-sxz*sy))/{_DET} AS b, (n*(sxx*syz-sxz*sxy) - sx*(sx*syz-sxz*sy) + sz*(sx*sxy-sxx*sy))/{_DET} AS e FROM s) SELECT id, round(z - (a + b*lon + e*lat), 3) AS residual FROM {V.PT_CUST}, c",
)
def _(spark, d):
    p = V.pt_cust(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "z")
    return fitting.residuals(p, "z", fitting.polynomial_fit(p, "z", 1), 1).select("id", F.round("residual", 3).alias("residual"))


@register("poly_residual_degree2")
def _(spark, d):
    p = V.pt_cust(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "z")
    r = fitting.residuals(p, "z", fitting.polynomial_fit(p, "z", 2), 2)
    return r.agg(F.round(F.avg(F.abs("residual")), 4).alias("mean_abs"), F.round(F.sqrt(F.avg(F.col("residual") * F.col("residual"))), 4).alias("rms"))


@register("helmert_solve")
def _(spark, d):
    p = V.pt_cust(spark, d)
    x, y, h = T.helmert(F.col("lon"), F.col("lat"), F.col("z") / 100, [1.0, 2.0, 3.0, 1e-4, 2e-4, 3e-4, 1e-5])
    pairs = p.select(F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("z") / 100).alias("z"), x.alias("u"), y.alias("v"), h.alias("w"))
    fit = fitting.helmert_fit(pairs)
    return fit.select(*[F.round(c, 6).alias(c) for c in ("rx", "ry", "rz", "scale", "sigma")])


@register("krige_solve")
def _(spark, d):
    p = V.pt_cust(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "z")
    return fitting.krige(p, p.withColumnRenamed("id", "q"), "spherical", 0.0, 2.0, 60.0).select("q", F.round("value", 3).alias("value"))


@register("ransac_gcps")
def _(spark, d):
    p = V.pt_cust(spark, d).select((F.col("id") % 2).alias("part"), F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("lon") * 1.5 + 2 + F.when(F.col("id") % 9 == 0, 40).otherwise(0)).alias("xr"), (F.col("lat") * 1.5 - 1).alias("yr"))
    return fitting.ransac(p, 1e-3, ["part"]).groupBy("part").agg(F.count("*").alias("kept"))


@register("rpc_corners", f"SELECT id, round(xmin, 6) AS xmin, round(ymin + 5 - 5.1::DOUBLE, 6) AS ymin, round(xmin + 10, 6) AS xmax, round(ymin + 5 + 5.1::DOUBLE, 6) AS ymax FROM {V.BB_SUPP}")
def _(spark, d):
    e = lambda i: F.array(*[F.lit(1.0 if j == i else 0.0) for j in range(20)])
    line = F.array(*[F.lit({2: -1.0, 1: 0.02}.get(j, 0.0)) for j in range(20)])
    s = V.boxes(spark, d, "suppliers").select("id", F.lit(1000).alias("width"), F.lit(800).alias("height"), F.array(F.lit(400.0), F.lit(500.0), F.col("ymin") + 5, F.col("xmin") + 5, F.lit(0.0)).alias("offsets"), F.array(*[F.lit(v) for v in (400.0, 500.0, 5.0, 5.0, 500.0)]).alias("scales"), line.alias("line_num"), e(0).alias("line_den"), e(1).alias("samp_num"), e(0).alias("samp_den"))
    return rpc.rpc_corners(s).select("id", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@register("area_intersection", f"SELECT a.id * 100000 + b.id AS id, round(greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0), 6) AS area FROM {V.BB_ORD} a JOIN {V.BB_SUPP} b ON {_MEET}")
def _(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    shapes = lambda t: t.select("id", F.array(F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"))).alias("rings"))
    areas = polygons.intersection_areas(shapes(V.boxes(spark, d)), shapes(V.boxes(spark, d, "suppliers")), 10.0, 5.0, touching=True)
    return areas.select((F.col("a_id") * 100000 + F.col("b_id")).alias("id"), F.round("area", 6).alias("area"))


@register("ring_area", f"SELECT id, round((xmax - xmin) * (ymax - ymin), 6) AS area FROM {V.BB_ORD}")
def _(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"))
    return V.boxes(spark, d).select("id", F.round(Y.ring_area(ring), 6).alias("area"))


@register("histogram2d_log", f"SELECT CAST(least(floor((lon + 180) / 3.6::DOUBLE), 99) AS INTEGER) AS xbin, CAST(least(floor((lat + 90) / 1.8::DOUBLE), 99) AS INTEGER) AS ybin, round(ln(count(*)), 6) AS log_n FROM {V.PT_CUST} GROUP BY 1, 2")
def _(spark, d):
    return S.histogram2d(V.pt_cust(spark, d), "lon", "lat", (-180.0, 180.0), (-90.0, 90.0)).select("xbin", "ybin", F.round("log_n", 6).alias("log_n"))


@register("latest_calibration", "SELECT o_custkey AS key, CAST(max(year(o_orderdate)) AS INTEGER) AS y, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS gain FROM orders WHERE year(o_orderdate) <= 1996 GROUP BY o_custkey")
def _(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("gain"))
    o = o.where(F.col("y") <= 1996)
    return o.groupBy("key").agg(F.max("y").alias("y"), F.max_by("gain", "at").alias("gain"))


@register("calibration_asof", "SELECT o_custkey AS sensor, CAST(max(year(o_orderdate)) AS INTEGER) AS y, max(o_orderkey) FILTER (year(o_orderdate) = last) AS gain FROM (SELECT *, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS last FROM orders WHERE year(o_orderdate) <= 1995) GROUP BY o_custkey")
def _(spark, d):
    facts = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("sensor"), F.year("o_orderdate").alias("y")).agg(F.max("o_orderkey").alias("gain"))
    return spatial.latest_before(facts, "sensor", "y", 1995)


@register("footprint_parts", f"SELECT id, CAST(k AS INTEGER) AS part, round(xmin + k, 6) AS x FROM {V.BB_SUPP}, range(0, 3) t(k)")
def _(spark, d):
    f = V.boxes(spark, d, "suppliers").select("id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("xmin") + k).alias("rings"))
    return regions.parts(f).select("id", "part", F.round("ring", 6).alias("x"))
