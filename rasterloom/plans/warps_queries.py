"""Queries on rasters in other reference systems, tile trees, and shapes made of rasters' cells and rings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rasterloom.functions import projections as P
from rasterloom.operators import keypoints as K
from rasterloom.operators import reprojection as W
from rasterloom.operators import rpc
from rasterloom.operators import tile_tree as T
from rasterloom.plans import views as V
from rasterloom.plans.catalogue import register
from rasterloom.sources import codecs, tiles

#: Upper left corner and pixel of the events' raster in degrees, and in metres of UTM zone 32.
DEGREES, METRES, UTM = (7.0, 55.0, 0.01), (400000.0, 6100000.0, 1000.0), 32632


def height(px) -> int:
    return (px.agg(F.max("row")).first()[0] or 0) + 1


def degrees_grid(px) -> W.Grid:
    lon, lat, step = DEGREES
    return W.Grid(4326, lon, lat, step, step, 100, height(px))


def _terms(rows, f: str, g: str, up: str, across: str, sign: str) -> str:
    return " ".join(f"{sign} {c!r}::DOUBLE * {f}({2 * j} * {up}) * {g}({2 * j} * {across})" for j, c in enumerate(P.series(rows), 1))


_K = f"{P.SCALE * P.RECTIFYING!r}::DOUBLE"
#: Columns lon and lat (in degrees) of columns x and y of UTM zone 32, and the other way round; later columns use earlier ones.
TO_DEGREES = (
    f"y / {_K} AS u_, (x - 500000.0::DOUBLE) / {_K} AS w_, u_ {_terms(P.FROM_GRID, 'sin', 'cosh', 'u_', 'w_', '-')} AS a_, w_ {_terms(P.FROM_GRID, 'cos', 'sinh', 'u_', 'w_', '-')} AS b_, asin(sin(a_) / cosh(b_)) AS k_, "
    f"degrees(k_ {' '.join(f'+ {c!r}::DOUBLE * sin({2 * j} * k_)' for j, c in enumerate(P.series(P.TO_LATITUDE), 1))}) AS lat, 9.0::DOUBLE + degrees(atan2(sinh(b_), cos(a_))) AS lon"
)
TO_UTM = (
    f"radians(lon - 9.0::DOUBLE) AS l_, sin(radians(lat)) AS s_, sinh(atanh(s_) - {P.ECCENTRICITY!r}::DOUBLE * atanh({P.ECCENTRICITY!r}::DOUBLE * s_)) AS t_, atan2(t_, cos(l_)) AS u_, atanh(sin(l_) / sqrt(1 + t_ * t_)) AS w_, "
    f"500000.0::DOUBLE + {_K} * (w_ {_terms(P.TO_GRID, 'cos', 'sinh', 'u_', 'w_', '+')}) AS x, {_K} * (u_ {_terms(P.TO_GRID, 'sin', 'cosh', 'u_', 'w_', '+')}) AS y"
)


def _box(corner: tuple, to: str, x: str, y: str) -> str:
    """One row: left, top, right, bot of a raster of 100 columns in the other system, by 50 places on each side; h rows."""
    ulx, uly, step = corner
    side = "SELECT s, h, CASE s WHEN 'r' THEN 1 WHEN 'l' THEN 0 ELSE t / 49.0::DOUBLE END AS e, CASE s WHEN 't' THEN 0 WHEN 'b' THEN 1 ELSE t / 49.0::DOUBLE END AS d FROM range(0, 50) q(t), (VALUES ('t'), ('r'), ('b'), ('l')) v(s), h"
    placed = f"SELECT s, h, {ulx}::DOUBLE + e * 100 * {step}::DOUBLE AS {'lon' if to == TO_UTM else 'x'}, {uly}::DOUBLE - d * h * {step}::DOUBLE AS {'lat' if to == TO_UTM else 'y'} FROM ({side})"
    return f"SELECT any_value(h) AS h, min({x}) FILTER (s = 'l') AS lef, max({y}) FILTER (s = 't') AS top, max({x}) FILTER (s = 'r') AS rig, min({y}) FILTER (s = 'b') AS bot FROM (SELECT *, {to} FROM ({placed}))"


def _targets(corner: tuple, spacing: float, back: str, x: str, y: str, box: str) -> str:
    """CTEs h, g and t: target pixels row, col within the source, and the places r, c of their centres there."""
    ulx, uly, step = corner
    grid = f"SELECT row, col, h, lef + (col + 0.5::DOUBLE) * {spacing} AS {x}, top - (row + 0.5::DOUBLE) * {spacing} AS {y} FROM g, range(0, CAST(ceil((rig - lef) / {spacing}) AS BIGINT)) a(col), range(0, CAST(ceil((top - bot) / {spacing}) AS BIGINT)) b(row)"
    sx, sy = ("lon", "lat") if x == "x" else ("x", "y")
    return (
        f"h AS (SELECT max(row) + 1 AS h FROM {V.PX_EV}), g AS ({box}), t AS (SELECT row, col, r, c FROM (SELECT row, col, h, ({uly}::DOUBLE - {sy}) / {step}::DOUBLE AS r, ({sx} - {ulx}::DOUBLE) / {step}::DOUBLE AS c "
        f"FROM (SELECT *, {back} FROM ({grid}))) WHERE r >= 0 AND r < h AND c >= 0 AND c < 100)"
    )


_UTM_TARGETS = _targets(DEGREES, 1000.0, TO_DEGREES, "x", "y", _box(DEGREES, TO_UTM, "x", "y"))
_BACK_TARGETS = _targets(METRES, 0.01, TO_UTM, "lon", "lat", _box(METRES, TO_DEGREES, "lon", "lat"))
_NEAREST = f"SELECT t.row, t.col, v FROM t JOIN {V.PX_EV} p ON p.row = CAST(floor(r) AS BIGINT) AND p.col = CAST(floor(c) AS BIGINT)"


def _taps(weight, low: int, high: int) -> str:
    """Weighted mean of the pixels around each place of t that is in a pixel that there is."""
    far = f"SELECT t.row, t.col, r, c, CAST(floor(r - 0.5) AS BIGINT) + i AS pr, CAST(floor(c - 0.5) AS BIGINT) + j AS pc FROM t, range({low}, {high}) a(i), range({low}, {high}) b(j) WHERE EXISTS (SELECT 1 FROM {V.PX_EV} o WHERE o.row = CAST(floor(r) AS BIGINT) AND o.col = CAST(floor(c) AS BIGINT))"
    w = f"({weight('abs(r - 0.5 - pr)')}) * ({weight('abs(c - 0.5 - pc)')})"
    return f"SELECT k.row, k.col, round(sum({w} * v) / sum({w}), 4) AS v FROM ({far}) k JOIN {V.PX_EV} p ON p.row = pr AND p.col = pc GROUP BY k.row, k.col"


def _cubic(a: str) -> str:
    return f"CASE WHEN {a} < 1 THEN 1.5 * {a}*{a}*{a} - 2.5 * {a}*{a} + 1 WHEN {a} < 2 THEN -0.5 * {a}*{a}*{a} + 2.5 * {a}*{a} - 4 * {a} + 2 ELSE 0 END"


def to_utm(spark, d, kind):
    px = V.px_ev(spark, d)
    source = degrees_grid(px)
    return W.reproject(px, "v", source, W.target_grid(source, UTM, 1000.0), kind).select("row", "col", F.round("v", 4).alias("v"))


@register("reproject_utm", f"WITH {_UTM_TARGETS} SELECT row, col, round(v, 4) AS v FROM ({_NEAREST})")
def _(spark, d):
    return to_utm(spark, d, "nearest")


@register("reproject_utm_bilinear", f"WITH {_UTM_TARGETS} {_taps(lambda a: f'greatest(1 - {a}, 0)', 0, 2)}")
def _(spark, d):
    return to_utm(spark, d, "bilinear")


@register("reproject_utm_cubic", f"WITH {_UTM_TARGETS} {_taps(_cubic, -1, 3)}")
def _(spark, d):
    return to_utm(spark, d, "cubic")


def from_utm(spark, d, kind):
    px = V.px_ev(spark, d)
    x, y, step = METRES
    source = W.Grid(UTM, x, y, step, step, 100, height(px))
    return W.reproject(px, "v", source, W.target_grid(source, 4326, 0.01), kind).select("row", "col", F.round("v", 4).alias("v"))


@register("reproject_from_utm", f"WITH {_BACK_TARGETS} SELECT row, col, round(v, 4) AS v FROM ({_NEAREST})")
def _(spark, d):
    return from_utm(spark, d, "nearest")


@register("reproject_from_utm_cubic", f"WITH {_BACK_TARGETS} {_taps(_cubic, -1, 3)}")
def _(spark, d):
    return from_utm(spark, d, "cubic")


_FORWARD = f"SELECT v, {TO_UTM} FROM (SELECT v, {DEGREES[0]}::DOUBLE + (col + 0.5::DOUBLE) * {DEGREES[2]} AS lon, {DEGREES[1]}::DOUBLE - (row + 0.5::DOUBLE) * {DEGREES[2]} AS lat FROM {V.PX_EV})"


@register(
    "reproject_utm_average",
    f"WITH h AS (SELECT max(row) + 1 AS h FROM {V.PX_EV}), g AS ({_box(DEGREES, TO_UTM, 'x', 'y')}) SELECT CAST(floor((top - y) / 4000) AS BIGINT) AS row, CAST(floor((x - lef) / 4000) AS BIGINT) AS col, round(avg(v), 6) AS v, count(*) AS n FROM ({_FORWARD}), g WHERE x >= lef AND (x - lef) / 4000 < ceil((rig - lef) / 4000) AND top >= y AND (top - y) / 4000 < ceil((top - bot) / 4000) GROUP BY 1, 2",
)
def _(spark, d):
    px = V.px_ev(spark, d).withColumn("one", F.lit(1))
    source = degrees_grid(px)
    target = W.target_grid(source, UTM, 4000.0)
    mean, n = (W.reproject(px, c, source, target, how) for c, how in (("v", "average"), ("one", "sum")))
    return mean.join(n, ["row", "col"]).select("row", "col", F.round("v", 6).alias("v"), F.col("one").alias("n"))


#: Tiles of 32 pixels, whose zoom 10 has about the resolution of the raster in degrees.
SIZE, LOW, HIGH = 32, 8, 10
_EDGE = f"{T.EDGE!r}::DOUBLE"
_RES = f"({_EDGE} * 2 / {SIZE} / {2**HIGH})"
_DOWN = lambda lat: f"CAST(floor(({_EDGE} - asinh(tan(radians({lat}))) * {P.SEMI_MAJOR}) / {_RES}) AS BIGINT)"
_LEVEL = "SELECT {z} AS tz, gx // 2 AS gx, gy // 2 AS gy, (2 * sum(v) + count(*)) // (2 * count(*)) AS v, (sum(alpha) + 2) // 4 AS alpha FROM {below} GROUP BY ALL"


@register(
    "tile_tree",
    f"""WITH h AS (SELECT max(row) + 1 AS h FROM {V.PX_EV}),
    g AS (SELECT gx, gy, degrees((-{_EDGE} + (gx + 0.5::DOUBLE) * {_RES}) / {P.SEMI_MAJOR}) AS lon, degrees(atan(sinh(({_EDGE} - (gy + 0.5::DOUBLE) * {_RES}) / {P.SEMI_MAJOR}))) AS lat
        FROM h, range(CAST(187 / 360.0 * {SIZE * 2**HIGH} AS BIGINT) - 2, CAST(188 / 360.0 * {SIZE * 2**HIGH} AS BIGINT) + 2) a(gx), range({_DOWN(DEGREES[1])} - 2, {_DOWN(f'{DEGREES[1]} - h * {DEGREES[2]}')} + 2) b(gy)),
    z10 AS (SELECT 10 AS tz, gx, gy, CAST(dn AS BIGINT) AS v, 255 AS alpha FROM g JOIN {V.PX_EV} p ON p.row = CAST(floor(({DEGREES[1]} - lat) / {DEGREES[2]}) AS BIGINT) AND p.col = CAST(floor((lon - {DEGREES[0]}) / {DEGREES[2]}) AS BIGINT)),
    z9 AS ({_LEVEL.format(z=9, below='z10')}), z8 AS ({_LEVEL.format(z=8, below='z9')})
    SELECT CAST(tz AS INTEGER) AS tz, CAST(gx // {SIZE} AS INTEGER) AS tx, CAST(2 ** tz - 1 - gy // {SIZE} AS INTEGER) AS ty, count(*) AS seen, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (gx % {SIZE} + 1)) AS BIGINT) AS across, CAST(sum(v * (gy % {SIZE} + 1)) AS BIGINT) AS down, CAST(sum(alpha) AS BIGINT) AS alpha
    FROM (SELECT * FROM z10 UNION ALL SELECT * FROM z9 UNION ALL SELECT * FROM z8) GROUP BY ALL""",
)
def _(spark, d):
    """Every tile by sums over the pixels of its image: of values, and of values times places."""
    px = V.px_ev(spark, d)
    images = tiles.encoded(T.tile_tree(px, ["dn"], degrees_grid(px), LOW, HIGH, SIZE), SIZE)
    place = np.arange(1, SIZE + 1)

    def sums(batches):
        for df in batches:
            rows = []
            for tz, tx, ty, png in zip(df["tz"], df["tx"], df["ty"], df["png"]):
                v, alpha = codecs.decode_png(png).astype(np.int64)
                rows.append((tz, tx, ty, int((alpha > 0).sum()), int(v.sum()), int((v * place).sum()), int((v * place[:, None]).sum()), int(alpha.sum())))
            yield pd.DataFrame(rows, columns=["tz", "tx", "ty", "seen", "total", "across", "down", "alpha"])

    return images.mapInPandas(sums, "tz int, tx int, ty int, seen long, total long, across long, down long, alpha long")


#: A model of the events' raster that bends: shares of the image by shares l and p of a degree east of 10 and north of 40.
_LINE, _SAMPLE = "(-p + 0.02 * l + 0.01 * l * p + 0.004 * l * l) / (1 + 0.01 * p)", "(l + 0.03 * p - 0.006 * p * p + 0.002 * l * l * l) / (1 - 0.02 * l)"


def tilted(px) -> rpc.RpcImage:
    rows = height(px)
    fill = lambda **at: tuple(at.get(f"t{i}", 0.0) for i in range(20))
    return rpc.RpcImage(100, rows, (rows / 2, 50.0, 40.0, 10.0, 0.0), (rows / 2, 50.0, 1.0, 1.0, 500.0), fill(t2=-1.0, t1=0.02, t4=0.01, t7=0.004), fill(t0=1.0, t2=0.01), fill(t1=1.0, t2=0.03, t8=-0.006, t11=0.002), fill(t0=1.0, t1=-0.02))


@register(
    "rpc_orthorectify",
    f"WITH h AS (SELECT max(row) + 1 AS h FROM {V.PX_EV}), g AS (SELECT row, col, h, 41.2::DOUBLE - (row + 0.5::DOUBLE) * 0.02 - 40 AS p, 8.8::DOUBLE + (col + 0.5::DOUBLE) * 0.02 - 10 AS l FROM h, range(0, 120) a(row), range(0, 120) b(col)), t AS (SELECT row, col, h, {_LINE} * (h / 2.0::DOUBLE) + h / 2.0::DOUBLE AS r, {_SAMPLE} * 50 + 50 AS c FROM g) SELECT t.row, t.col, v FROM t JOIN {V.PX_EV} p ON p.row = CAST(floor(r) AS BIGINT) AND p.col = CAST(floor(c) AS BIGINT) WHERE r >= 0 AND r < h AND c >= 0 AND c < 100",
)
def _(spark, d):
    px = V.px_ev(spark, d)
    return rpc.orthorectify(px, "v", tilted(px), W.Grid(4326, 8.8, 41.2, 0.02, 0.02, 120, 120))


_MIRROR = "least(abs({0}) % (2 * ({1})), 2 * ({1}) - abs({0}) % (2 * ({1})))"
_WEIGHT = f"power({W.POLE!r}::DOUBLE, abs(k)) * {-6 * W.POLE / (1 - W.POLE**2)!r}::DOUBLE"
_ZOOMED = f"""h AS (SELECT max(row) + 1 AS h FROM {V.PX_EV}), p AS MATERIALIZED (SELECT row, col, v FROM {V.PX_EV}), a AS (SELECT h.h, k, row, col, {_MIRROR.format('row + k', 'h - 1')} AS far FROM p, h, range(-20, 21) q(k)),
    b AS MATERIALIZED (SELECT a.row, a.col, sum(p.v * {_WEIGHT}) AS v FROM a JOIN p ON p.row = far AND p.col = a.col GROUP BY ALL), c AS (SELECT k, row, col, {_MIRROR.format('col + k', '99')} AS far FROM p, range(-20, 21) q(k)),
    d AS MATERIALIZED (SELECT c.row, c.col, sum(b.v * {_WEIGHT}) AS v FROM c JOIN b ON b.col = far AND b.row = c.row GROUP BY ALL),
    t AS (SELECT row, col, h, row * (h - 1) / (2 * h - 1) AS r, col * 99 / 199.0::DOUBLE AS c FROM h, range(0, 2 * h) x(row), range(0, 200) y(col)),
    e AS (SELECT row, col, h, r, c, CAST(floor(r) AS BIGINT) + i AS pr, CAST(floor(c) AS BIGINT) + j AS pc FROM t, range(-1, 3) x(i), range(-1, 3) y(j))"""


def _spline(a: str) -> str:
    return f"CASE WHEN {a} < 1 THEN (4 - 6 * {a}*{a} + 3 * {a}*{a}*{a}) / 6 WHEN {a} < 2 THEN (2 - {a})*(2 - {a})*(2 - {a}) / 6 ELSE 0 END"


@register("zoom_spline", f"WITH {_ZOOMED} SELECT e.row, e.col, round(sum(d.v * ({_spline('abs(r - pr)')}) * ({_spline('abs(c - pc)')})), 4) AS v FROM e JOIN d ON d.row = {_MIRROR.format('pr', 'h - 1')} AND d.col = {_MIRROR.format('pc', '99')} GROUP BY ALL")
def _(spark, d):
    px = V.px_ev(spark, d)
    return W.zoom(px, "v", height(px), 100, 2, 2).select("row", "col", F.round("v", 4).alias("v"))


@register("keypoints")
def _(spark, d):
    return K.keypoints(V.px_ev(spark, d), "v", K.Scales(first=0.8, count=8, contrast=0.2, edge=20.0)).select("row", "col", "scale", "angle", "response")


@register("keypoint_matches")
def _(spark, d):
    """The raster and itself, moved by 7 rows and 4 columns."""
    px = V.px_ev(spark, d)
    a, b = (K.keypoints(p, "v", K.Scales(first=0.8, count=8, contrast=0.2, edge=20.0)) for p in (px, px.select((F.col("row") + 7).alias("row"), (F.col("col") + 4).alias("col"), "v")))
    return K.matched(a, b, 512, 60)
