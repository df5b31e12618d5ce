"""Queries on oriented pyramids and on clips by a table of polygons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import polygons as G
from rasterloom.operators import steerable
from rasterloom.operators.reprojection import Grid
from rasterloom.plans import views as V
from rasterloom.plans.catalogue import register
from rasterloom.plans.shapes_queries import rectangle


def height(px) -> int:
    return (px.agg(F.max("row")).first()[0] or 0) + 1


def _filtered(source: str, size: str, kernel: np.ndarray, step: int = 1) -> str:
    """A CTE's rows (row, col, v) of another under a kernel; `size` has h and w of the other. Mirrored at the edges' pixels."""
    taps = ", ".join(f"({i - 2}, {j - 2}, {kernel[i, j]!r}::DOUBLE)" for i in range(5) for j in range(5) if kernel[i, j]).replace("np.float64", "")
    mirror = "CASE WHEN p.{0} + {1} < 0 THEN -(p.{0} + {1}) WHEN p.{0} + {1} >= {2} THEN 2 * ({2} - 1) - (p.{0} + {1}) ELSE p.{0} + {1} END"
    near = f"SELECT p.row, p.col, k, {mirror.format('row', 'i', 'h')} AS r, {mirror.format('col', 'j', 'w')} AS c FROM {source} p, {size}, (VALUES {taps}) t(i, j, k)"
    where = f" WHERE n.row % {step} = 0 AND n.col % {step} = 0" if step > 1 else ""
    return f"SELECT n.row // {step} AS row, n.col // {step} AS col, sum(n.k * q.v) AS v FROM ({near}) n JOIN {source} q ON q.row = n.r AND q.col = n.c{where} GROUP BY ALL"


_F = steerable.filters(1)
_SIZE = "SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM {}"
_PYRAMID = f"""WITH p AS MATERIALIZED (SELECT row, col, CAST(dn AS DOUBLE) AS v FROM {V.PX_EV}), s0 AS ({_SIZE.format('p')}),
    high AS ({_filtered('p', 's0', _F.high0)}), l0 AS MATERIALIZED ({_filtered('p', 's0', _F.low0)}), l1 AS MATERIALIZED ({_filtered('l0', 's0', _F.low, 2)}), s1 AS ({_SIZE.format('l1')}), l2 AS MATERIALIZED ({_filtered('l1', 's1', _F.low, 2)})
    SELECT 0 AS level, 'highpass' AS name, * FROM high UNION ALL """ + " UNION ALL ".join(f"SELECT {k}, 'band{b}', * FROM ({_filtered(f'l{k}', f's{k}', _F.bands[b])})" for k in (0, 1) for b in (0, 1)) + " UNION ALL SELECT 2, 'lowpass', * FROM l2"


@register("steerable_pyramid", _PYRAMID)
def _(spark, d):
    px = V.px_ev(spark, d)
    return steerable.steerable_pyramid(px.select("row", "col", F.col("dn").cast("double").alias("v")), "v", height(px), 100, 2, 1)


@register(
    "clip_by_sheets",
    f"WITH h AS (SELECT max(row) + 1 AS h FROM {V.PX_EV}), b AS (SELECT id, xmin / 3.6 + 50 + 0.011 AS x1, xmax / 3.6 + 50 + 0.011 AS x2, (ymin + 90) / 180 * h + 0.017 AS y1, (ymax + 90) / 180 * h + 0.017 AS y2, h FROM {V.BB_SUPP}, h) SELECT id, row, col, v FROM b JOIN {V.PX_EV} p ON col + 0.5 > x1 AND col + 0.5 < x2 AND h - row - 0.5 > y1 AND h - row - 0.5 < y2",
)
def _(spark, d):
    """The raster under the sheet of each supplier."""
    px = V.px_ev(spark, d)
    h = height(px)
    x, y = (lambda c: F.col(c) / 3.6 + 50 + 0.011), (lambda c: (F.col(c) + 90) / 180 * h + 0.017)
    sheets = V.boxes(spark, d, "suppliers").select("id", F.array(rectangle(x("xmin"), y("ymin"), x("xmax"), y("ymax"))).alias("rings"))
    return G.clip_by_table(px.select("row", "col", "v"), sheets, Grid(0, 0.0, float(h), 1.0, 1.0, 100, h)).select("id", "row", "col", "v")
