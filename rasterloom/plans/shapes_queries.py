"""Queries on polygons with holes: intersections, masks and unions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.operators import polygons as G
from rasterloom.operators.reprojection import Grid
from rasterloom.plans import views as V
from rasterloom.plans.catalogue import register


def ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return ring((x1, y1), (x2, y1), (x2, y2), (x1, y2))


def corners_of(boxes):
    """Boxes as L-shapes: without their upper right quarter."""
    x1, y1, x2, y2 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    return boxes.select("id", F.array(ring((x1, y1), (x2, y1), (x2, my), (mx, my), (mx, y2), (x1, y2))).alias("rings"))


def windows_of(boxes):
    """Boxes with a hole from 3 to 6 across and 2 to 7 up."""
    x, y = F.col("xmin"), F.col("ymin")
    return boxes.select("id", F.array(rectangle(x, y, F.col("xmax"), F.col("ymax")), rectangle(x + 3, y + 2, x + 6, y + 7)).alias("rings"))


_OVER = "greatest(least(a.{0}2, b.{0}2) - greatest(a.{0}1, b.{0}1), 0)"
_OVERLAP = f"{_OVER.format('x')} * {_OVER.format('y')}"
_MEET = "a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin"


@register(
    "intersection_holes",
    f"""WITH a AS (SELECT id, xmin AS x1, ymin AS y1, xmax AS x2, (ymin + ymax) / 2 AS y2 FROM {V.BB_ORD} UNION ALL SELECT id, xmin, (ymin + ymax) / 2, (xmin + xmax) / 2, ymax FROM {V.BB_ORD}),
    b AS (SELECT id, 1 AS sign, xmin AS x1, ymin AS y1, xmax AS x2, ymax AS y2 FROM {V.BB_SUPP} UNION ALL SELECT id, -1, xmin + 3, ymin + 2, xmin + 6, ymin + 7 FROM {V.BB_SUPP}),
    pairs AS (SELECT a.id AS a_id, b.id AS b_id FROM {V.BB_ORD} a JOIN {V.BB_SUPP} b ON {_MEET})
    SELECT a_id, b_id, round(sum(sign * ({_OVERLAP})), 6) AS area FROM pairs JOIN a ON a.id = a_id JOIN b ON b.id = b_id GROUP BY a_id, b_id""",
)
def _(spark, d):
    found = G.intersection_areas(corners_of(V.boxes(spark, d)), windows_of(V.boxes(spark, d, "suppliers")), 10.0, 5.0)
    return found.select("a_id", "b_id", F.round("area", 6).alias("area"))


#: Diamonds of the orders on the events' raster (a pixel is one wide, its lower left corner at 0, 0), with holes of half their size.
_DIAMONDS = "SELECT o_orderkey AS id, (o_orderkey * 37 % 1000) / 10.0::DOUBLE + 0.013 AS cx, (o_orderkey * 91 % (10 * h)) / 10.0::DOUBLE + 0.017 AS cy, (1 + o_orderkey % 4) / 4.0::DOUBLE AS w, (1 + o_orderkey % 3) / 4.0::DOUBLE AS t FROM orders, h"


@register(
    "burn_polygon_table",
    f"""WITH h AS (SELECT max(row) + 1 AS h FROM {V.PX_EV}), d AS ({_DIAMONDS}),
    near AS (SELECT d.*, h - 1 - CAST(floor(cy) AS BIGINT) + i AS row, CAST(floor(cx) AS BIGINT) + j AS col, h FROM d, h, range(-1, 2) a(i), range(-2, 3) b(j)),
    hit AS (SELECT DISTINCT row, col FROM (SELECT row, col, abs(col + 0.5 - cx) / w + abs(h - row - 0.5 - cy) / t AS far FROM near) WHERE far < 1 AND NOT far < 0.5)
    SELECT p.row, p.col, CASE WHEN hit.row IS NULL THEN 1 ELSE 0 END AS mask FROM {V.PX_EV} p LEFT JOIN hit ON hit.row = p.row AND hit.col = p.col""",
)
def _(spark, d):
    px = V.px_ev(spark, d)
    h = (px.agg(F.max("row")).first()[0] or 0) + 1
    k = F.col("o_orderkey")
    cx, cy, w, t = (k * 37 % 1000) / F.lit(10.0) + 0.013, (k * 91 % (10 * h)) / F.lit(10.0) + 0.017, (1 + k % 4) / F.lit(4.0), (1 + k % 3) / F.lit(4.0)
    diamond = lambda s: ring((cx - w * s, cy), (cx, cy - t * s), (cx + w * s, cy), (cx, cy + t * s))
    shapes = V.table(spark, d, "orders").select(k.alias("id"), F.array(diamond(F.lit(1.0)), diamond(F.lit(0.5))).alias("rings"))
    return G.burn_table(px, shapes, Grid(0, 0.0, float(h), 1.0, 1.0, 100, h)).select("row", "col", "mask")


_CELLS = f"(SELECT DISTINCT dn % 5 AS class, row // 3 AS row, col // 3 AS col FROM {V.PX_EV})"
_PAIRS = f"(SELECT a.class, count(b.class) AS n FROM {_CELLS} a LEFT JOIN {_CELLS} b ON a.class = b.class AND b.row = a.row + {{0}} AND b.col = a.col + {{1}} GROUP BY a.class)"
_QUADS = f"(SELECT class, count(*) FILTER (n = 4) AS n FROM (SELECT class, row - i AS r, col - j AS c, count(*) AS n FROM {_CELLS}, range(0, 2) x(i), range(0, 2) y(j) GROUP BY ALL) GROUP BY class)"


@register(
    "dissolve_shapes",
    f"SELECT class, CAST(count(*) AS DOUBLE) AS area, count(*) - any_value(e.n) - any_value(s.n) + any_value(q.n) AS parts_less_holes, min(col)::DOUBLE AS xmin, min(row)::DOUBLE AS ymin, max(col) + 1.0::DOUBLE AS xmax, max(row) + 1.0::DOUBLE AS ymax FROM {_CELLS} c JOIN {_PAIRS.format(0, 1)} e USING (class) JOIN {_PAIRS.format(1, 0)} s USING (class) JOIN {_QUADS} q USING (class) GROUP BY class",
)
def _(spark, d):
    cells = V.px_ev(spark, d).select((F.col("dn") % 5).alias("class"), F.expr("row div 3").alias("row"), F.expr("col div 3").alias("col")).distinct()
    at = lambda c, n: (F.col(c) + n).cast("double")
    shapes = cells.select("class", F.array(rectangle(at("col", 0), at("row", 0), at("col", 1), at("row", 1))).alias("rings"))
    found = G.dissolve_polygons(shapes, "class")
    return found.groupBy("class").agg(F.sum("area").alias("area"), (F.count("*") - F.sum("holes")).alias("parts_less_holes"), *[f(c).alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])
