"""Queries on tiles, windows and georeferencing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.functions import tiling as T
from rasterloom.functions.geometry import rounded
from rasterloom.operators import grids as G
from rasterloom.operators import rasters as X
from rasterloom.plans import views as V
from rasterloom.plans.catalogue import register

PI, SHIFT, R0 = f"{math.pi!r}::DOUBLE", f"{T.SHIFT!r}::DOUBLE", f"{T.WEB_MERCATOR_R!r}::DOUBLE"
INIT = f"{2 * T.SHIFT / 256!r}::DOUBLE"


def z(n: int):
    return F.lit(n)


def slippy_sql(zoom: int) -> str:
    return f"CAST(trunc((lon + 180.0::DOUBLE) / 360.0::DOUBLE * {2 ** zoom}) AS INTEGER) AS x, CAST(trunc((1 - asinh(tan(radians(lat))) / {PI}) / 2 * {2 ** zoom}) AS INTEGER) AS y"


@register("slippy_tile", f"SELECT id, {slippy_sql(10)} FROM {V.PT_CUST}")
def _(spark, d):
    x, y = T.slippy_tile(F.col("lon"), F.col("lat"), z(10))
    return V.pt_cust(spark, d).select("id", x.alias("x"), y.alias("y"))


@register("tile_corner", f"SELECT DISTINCT x, y, round(x / 1024.0::DOUBLE * 360.0::DOUBLE - 180, 8) AS lon, round(degrees(atan(sinh({PI} * (1 - 2 * y / 1024.0::DOUBLE)))), 8) AS lat FROM (SELECT {slippy_sql(10)} FROM {V.PT_CUST})")
def _(spark, d):
    x, y = T.slippy_tile(F.col("lon"), F.col("lat"), z(10))
    lon, lat = T.tile_corner(F.col("x"), F.col("y"), z(10))
    return V.pt_cust(spark, d).select(x.alias("x"), y.alias("y")).distinct().select("x", "y", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


_WM = f"lon * ({R0} / 180) AS mx, ln(tan((90 + lat) * ({PI} / 360))) / ({PI} / 180) * ({R0} / 180) AS my"


@register("mercator_xy", f"SELECT id, round(mx, 4) AS mx, round(my, 4) AS my FROM (SELECT id, {_WM} FROM {V.PT_CUST})")
def _(spark, d):
    mx, my = T.web_mercator(F.col("lon"), F.col("lat"))
    return V.pt_cust(spark, d).select("id", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"))


@register("mercator_res", f"SELECT DISTINCT c_nationkey AS z, round({R0} * 2 / 256 / pow(2, c_nationkey), 9) AS res FROM customer")
def _(spark, d):
    """Of the zooms that customers name."""
    zooms = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("z")).distinct()
    return zooms.select("z", F.round(T.mercator_resolution(F.col("z")), 9).alias("res"))


_MXY = f"SELECT id, lon * {SHIFT} / 180.0::DOUBLE AS mx, ln(tan((90 + lat) * {PI} / 360.0::DOUBLE)) / ({PI} / 180.0::DOUBLE) * {SHIFT} / 180.0::DOUBLE AS my FROM {V.PT_CUST}"


def tms_sql(zoom: int) -> str:
    return f"SELECT id, CAST(ceil((mx + {SHIFT}) / ({INIT} / {2 ** zoom}) / 256.0::DOUBLE) - 1 AS INTEGER) AS tx, CAST(ceil((my + {SHIFT}) / ({INIT} / {2 ** zoom}) / 256.0::DOUBLE) - 1 AS INTEGER) AS ty FROM ({_MXY})"


def tms(spark, d, zoom: int):
    m = T.Mercator()
    tx, ty = m.tile_of_metres(*m.metres(F.col("lat"), F.col("lon")), z(zoom))
    return V.pt_cust(spark, d).select("id", tx.alias("tx"), ty.alias("ty"))


@register("tms_tile", tms_sql(11))
def _(spark, d):
    return tms(spark, d, 11)


def _edge(c: str, zoom: int, k: int) -> str:
    return f"round(({c} + {k}) * 256 * ({INIT} / {2 ** zoom}) - {SHIFT}, 4)"


@register("tms_tile_bounds", f"SELECT DISTINCT tx, ty, {_edge('tx', 11, 0)} AS minx, {_edge('ty', 11, 0)} AS miny, {_edge('tx', 11, 1)} AS maxx, {_edge('ty', 11, 1)} AS maxy FROM ({tms_sql(11)})")
def _(spark, d):
    b = T.Mercator().bounds(F.col("tx"), F.col("ty"), z(11))
    return tms(spark, d, 11).select("tx", "ty").distinct().select("tx", "ty", *[F.round(c, 4).alias(n) for c, n in zip(b, ("minx", "miny", "maxx", "maxy"))])


def _lat(c: str) -> str:
    return f"round(180 / {PI} * (2 * atan(exp(({c} * 256 * ({INIT} / 2048) - {SHIFT}) / {SHIFT} * {PI})) - {PI} / 2), 7)"


def _lon(c: str) -> str:
    return f"round(({c} * 256 * ({INIT} / 2048) - {SHIFT}) / {SHIFT} * 180, 7)"


@register("tms_latlon_bounds", f"SELECT DISTINCT tx, ty, {_lat('ty')} AS south, {_lon('tx')} AS west, {_lat('(ty + 1)')} AS north, {_lon('(tx + 1)')} AS east FROM ({tms_sql(11)})")
def _(spark, d):
    b = T.Mercator().lat_lon_bounds(F.col("tx"), F.col("ty"), z(11))
    return tms(spark, d, 11).select("tx", "ty").distinct().select("tx", "ty", *[F.round(c, 7).alias(n) for c, n in zip(b, ("south", "west", "north", "east"))])


_QUAD = " || ".join(f"CAST(((tx >> {i}) & 1) + 2 * (((2047 - ty) >> {i}) & 1) AS VARCHAR)" for i in range(10, -1, -1))


@register("tms_quadkey", f"SELECT id, tx, ty, {_QUAD} AS quadkey FROM ({tms_sql(11)})")
def _(spark, d):
    return tms(spark, d, 11).withColumn("quadkey", T.quadkey(F.col("tx"), F.col("ty"), z(11)))


@register("google_flip", f"SELECT id, tx, 2047 - ty AS y FROM ({tms_sql(11)})")
def _(spark, d):
    return tms(spark, d, 11).select("id", "tx", T.flipped_row(F.col("ty"), z(11)).alias("y"))


@register("raster_pixel_flip", f"SELECT id, round((mx + {SHIFT}) / ({INIT} / 32), 4) AS px, round(8192 - (my + {SHIFT}) / ({INIT} / 32), 4) AS py FROM ({_MXY})")
def _(spark, d):
    m = T.Mercator()
    px, py = m.raster_pixel(*m.pixel(*m.metres(F.col("lat"), F.col("lon")), z(5)), z(5))
    return V.pt_cust(spark, d).select("id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@register("mercator_roundtrip", f"SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM {V.PT_CUST}")
def _(spark, d):
    m = T.Mercator()
    px = m.metres_of_pixel(*m.pixel(*m.metres(F.col("lat"), F.col("lon")), z(9)), z(9))
    lat, lon = m.lat_lon(*px)
    return V.pt_cust(spark, d).select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


def _zoom_sql(size: str, init: str) -> str:
    return f"coalesce((SELECT greatest(0, min(i) - 1) FROM range(0, 32) t(i) WHERE {size} > {init} / pow(2, i)), 31)"


@register("zoom_for_pixel", f"SELECT id, CAST({_zoom_sql('s', INIT)} AS INTEGER) AS zoom, CAST({_zoom_sql('s / 100000.0::DOUBLE', '0.703125::DOUBLE')} AS INTEGER) AS gzoom FROM (SELECT id, abs(z) + 0.01::DOUBLE AS s FROM {V.PT_CUST})")
def _(spark, d):
    p = V.pt_cust(spark, d).select("id", (F.abs("z") + 0.01).alias("s"))
    return p.select("id", T.Mercator().zoom_for(F.col("s")).alias("zoom"), T.Geodetic().zoom_for(F.col("s") / 100000.0).alias("gzoom"))


def _geo(res: str) -> str:
    return f"CAST(ceil((180 + lon) / {res} / 256.0::DOUBLE) - 1 AS INTEGER) AS tx, CAST(ceil((90 + lat) / {res} / 256.0::DOUBLE) - 1 AS INTEGER) AS ty"


@register("geodetic_tile", f"SELECT id, {_geo('(180.0::DOUBLE / 256 / 64)')} FROM {V.PT_CUST}")
def _(spark, d):
    tx, ty = T.Geodetic().tile_of(F.col("lon"), F.col("lat"), z(6))
    return V.pt_cust(spark, d).select("id", tx.alias("tx"), ty.alias("ty"))


@register("geodetic_tile_wide", f"SELECT id, {_geo('(360.0::DOUBLE / 256 / 64)')} FROM {V.PT_CUST}")
def _(spark, d):
    tx, ty = T.Geodetic(False).tile_of(F.col("lon"), F.col("lat"), z(6))
    return V.pt_cust(spark, d).select("id", tx.alias("tx"), ty.alias("ty"))


@register("geodetic_bounds", f"SELECT DISTINCT tx, ty, ty * 2.8125::DOUBLE - 90 AS south, tx * 2.8125::DOUBLE - 180 AS west, (ty + 1) * 2.8125::DOUBLE - 90 AS north, (tx + 1) * 2.8125::DOUBLE - 180 AS east FROM (SELECT {_geo('(180.0::DOUBLE / 256 / 64)')} FROM {V.PT_CUST})")
def _(spark, d):
    g = T.Geodetic()
    tx, ty = g.tile_of(F.col("lon"), F.col("lat"), z(6))
    b = g.lat_lon_bounds(F.col("tx"), F.col("ty"), z(6))
    return V.pt_cust(spark, d).select(tx.alias("tx"), ty.alias("ty")).distinct().select("tx", "ty", *[c.alias(n) for c, n in zip(b, ("south", "west", "north", "east"))])


def _tiers(w: int, h: int) -> list[tuple[int, int, int, int]]:
    sizes = [(w, h)]
    while max(sizes[-1]) > 256:
        sizes.append((sizes[-1][0] // 2, sizes[-1][1] // 2))
    return [(i, a, b, 0) for i, (a, b) in enumerate(reversed(sizes))]


@register(
    "zoomify_group",
    "WITH t AS (SELECT *, (width + 255) // 256 AS nx, (height + 255) // 256 AS ny FROM (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, a, b, _ in _tiers(5000, 3000)) + ") v(tier, width, height)), u AS (SELECT *, coalesce(sum(nx * ny) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT CAST(tier AS INTEGER) AS tier, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, printf('TileGroup%d/%d-%d-%d.jpg', CAST((x + y * nx + before) // 256 AS BIGINT), tier, x, y) AS path FROM u, range(0, 20) a(x), range(0, 12) b(y) WHERE x < nx AND y < ny",
)
def _(spark, d):
    return G.zoomify_paths(G.zoomify_tiers(spark, 5000, 3000))


def _axis_sql(lo: str, hi: str, org: float, step: float, size: int, q: int) -> tuple[str, str, str, str]:
    r = f"CAST(trunc(({lo} - ({org})) / {step}::DOUBLE + 0.001::DOUBLE) AS INTEGER)"
    n = f"CAST(trunc(({hi} - {lo}) / {step}::DOUBLE + 0.5::DOUBLE) AS INTEGER)"
    before = f"greatest(-({r}), 0)"
    cut = lambda base: f"CAST(trunc({base} * (CAST({before} AS DOUBLE) / {n})) AS INTEGER)"
    w = cut(str(q))
    w2, n2, r2 = f"({q} - {w})", f"({n} - {cut(n)})", f"greatest({r}, 0)"
    beyond = f"{r2} + {n2} > {size}"
    return r2, f"CASE WHEN {beyond} THEN {size} - {r2} ELSE {n2} END", w, f"CASE WHEN {beyond} THEN CAST(trunc({w2} * (CAST({size} - {r2} AS DOUBLE) / {n2})) AS INTEGER) ELSE {w2} END"


_AX, _AY = _axis_sql("xmin", "xmax", -170.0, 0.1, 3400, 256), _axis_sql("ymax", "ymin", 80.0, -0.1, 1600, 256)


@register("geo_query_window", "SELECT id, " + ", ".join(f"{e} AS {n}" for e, n in zip([x for p in zip(_AX, _AY) for x in p], ["rx", "ry", "rxsize", "rysize", "wx", "wy", "wxsize", "wysize"])) + f" FROM {V.BB_ORD}")
def _(spark, d):
    c = T.query_window(F.col("xmin"), F.col("ymax"), F.col("xmax"), F.col("ymin"), F.lit(-170.0), F.lit(80.0), F.lit(0.1), F.lit(-0.1), 3400, 1600, 256)
    return V.boxes(spark, d).select("id", *[x.cast("int").alias(n) for x, n in zip(c, ["rx", "ry", "rxsize", "rysize", "wx", "wy", "wxsize", "wysize"])])


_WF = f"WITH t AS (SELECT id, {slippy_sql(10)} FROM {V.PT_CUST}), c AS (SELECT id, x / 1024.0::DOUBLE * 360.0::DOUBLE - 180 AS lon, degrees(atan(sinh({PI} * (1 - 2 * y / 1024.0::DOUBLE)))) AS lat FROM t), m AS (SELECT id, {_WM} FROM c) SELECT id, printf('%16.7f', {T.WEB_MERCATOR_R * 2 / 256 / 1024!r}::DOUBLE) || chr(10) || printf('%16.7f', 0.0::DOUBLE) || chr(10) || printf('%16.7f', 0.0::DOUBLE) || chr(10) || printf('%16.7f', {-T.WEB_MERCATOR_R * 2 / 256 / 1024!r}::DOUBLE) || chr(10) || printf('%16.7f', mx) || chr(10) || printf('%16.7f', my) AS world FROM m"


_CORNER = f"(SELECT id, x / 1024.0::DOUBLE * 360 - 180 AS lon, degrees(atan(sinh({PI} * (1 - 2 * y / 1024.0::DOUBLE)))) AS lat FROM (SELECT id, {slippy_sql(10)} FROM {V.PT_CUST}))"
_RES = f"{R0} * 2 / 256 / 1024.0::DOUBLE"


@register("world_file_text", f"SELECT id, round({_RES}, 3) AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, round(-({_RES}), 3) AS w3, round(mx, 3) AS w4, round(my, 3) AS w5 FROM (SELECT id, {_WM} FROM {_CORNER})")
def _(spark, d):
    """The six numbers that the text of a world file holds."""
    x, y = T.slippy_tile(F.col("lon"), F.col("lat"), z(10))
    t = V.pt_cust(spark, d).select("id", x.alias("x"), y.alias("y")).select("id", T.world_file(F.col("x"), F.col("y"), z(10)).alias("world"))
    return t.select("id", *[F.round(F.trim(F.split("world", "\n")[i]).cast("double"), 3).alias(f"w{i}") for i in range(6)])


@register("tile_urls", f"SELECT id, 'http://mt' || CAST((x + y) % 4 AS VARCHAR) || '.example.org/vt?x=' || x || '&y=' || y || '&z=10' AS url, '10/' || x || '/' || y || '.png' AS path FROM (SELECT id, {slippy_sql(10)} FROM {V.PT_CUST})")
def _(spark, d):
    x, y = T.slippy_tile(F.col("lon"), F.col("lat"), z(10))
    t = V.pt_cust(spark, d).select("id", x.alias("x"), y.alias("y"))
    return t.select("id", T.tile_url("http://mt{server}.example.org/vt?", F.col("x"), F.col("y"), z(10)).alias("url"), T.tile_path(F.col("x"), F.col("y"), z(10)).alias("path"))


def rows_of(spark, d) -> int:
    """Rows of the events' raster."""
    return (V.px_ev(spark, d).agg(F.max("row")).first()[0] or 0) + 1


@register("tile_cover", f"WITH b AS (SELECT CAST(floor((min(xmin) + 180) / 2) AS BIGINT) AS x0, CAST(floor((max(xmax) + 180) / 2) AS BIGINT) AS x1, CAST(floor((min(ymin) + 90) / 2) AS BIGINT) AS y0, CAST(floor((max(ymax) + 90) / 2) AS BIGINT) AS y1 FROM {V.BB_SUPP}) SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, 8 AS z FROM b, range(x0, x1 + 1) a(x), range(y0, y1 + 1) c(y)")
def _(spark, d):
    """Tiles of two degrees over the box of all suppliers."""
    place = lambda f, c, low: F.floor((f(c) + low) / 2)
    box = V.boxes(spark, d, "suppliers").agg(place(F.min, "xmin", 180), place(F.min, "ymin", 90), place(F.max, "xmax", 180), place(F.max, "ymax", 90)).first()
    return G.tile_cover(spark, *box, 8)


for _name, _sign, _compat in (("world2pixel", -1, False), ("world2pixel_compat", 1, True)):

    @register(_name, f"SELECT id, CAST(trunc((lon + 180) / 0.25::DOUBLE) AS INTEGER) AS px, CAST(trunc({_sign} * ((85.0::DOUBLE - lat) / -0.25::DOUBLE)) AS INTEGER) AS line FROM {V.PT_CUST}")
    def _(spark, d, compat=_compat):
        px, line = T.world_to_pixel(F.col("lon"), F.col("lat"), -180.0, 85.0, 0.25, -0.25, compat)
        return V.pt_cust(spark, d).select("id", px.alias("px"), line.alias("line"))


@register("raster_extent", "SELECT p_partkey AS id, -180.0::DOUBLE + (p_size + 1) * 0.5::DOUBLE AS llx, 85.0::DOUBLE + (p_size + 1) * -0.25::DOUBLE AS lly, -180.0::DOUBLE + p_size * 0.25::DOUBLE AS urx, 85.0::DOUBLE + p_size * 0.125::DOUBLE AS ury FROM part")
def _(spark, d):
    e = T.raster_extent(-180.0, 0.25, 0.5, 85.0, 0.125, -0.25, F.col("p_size"), F.col("p_size") + 1)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[c.alias(n) for c, n in zip(e, ("llx", "lly", "urx", "ury"))])


@register("window_grid", f"WITH h AS (SELECT max(row) + 1 AS h FROM {V.PX_EV}) SELECT CAST(r AS INTEGER) AS win_row, CAST(c AS INTEGER) AS win_col, CAST(c * 32 AS INTEGER) AS col_off, CAST(r * 32 AS INTEGER) AS row_off, CAST(least(32, 100 - c * 32) AS INTEGER) AS width, CAST(least(32, h - r * 32) AS INTEGER) AS height FROM h, range(0, (h + 31) // 32) a(r), range(0, 4) b(c)")
def _(spark, d):
    return G.windows(spark, 100, rows_of(spark, d), 32)


@register("window_of_pixel", f"SELECT CAST(row // 16 AS INTEGER) AS win_row, CAST(col // 16 AS INTEGER) AS win_col, count(*) AS n, round(sum(v), 4) AS s FROM {V.PX_EV} GROUP BY 1, 2")
def _(spark, d):
    return G.in_windows(V.px_ev(spark, d), 16).groupBy("win_row", "win_col").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("s"))


@register("fishnet", f"SELECT id, printf('grid_%04d_%04d', c, r) AS name, xmin + (c - 1) * 4 AS l, ymax - (r - 1) * 3 AS t FROM {V.BB_SUPP}, range(1, 4) a(c), range(1, 5) b(r) WHERE c <= ceil((xmax - xmin) / 4) AND r <= ceil((ymax - ymin) / 3)")
def _(spark, d):
    return G.fishnet(V.boxes(spark, d, "suppliers"), 4.0, 3.0).select("id", "name", F.col("left").alias("l"), F.col("top").alias("t"))


@register("dist_matrix", f"WITH h AS (SELECT max(row) + 1 AS n FROM {V.PX_EV}) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sqrt(CAST(least(i, n - i) AS DOUBLE) * least(i, n - i) + CAST(least(j, n - j) AS DOUBLE) * least(j, n - j)), 9) AS d FROM h, range(0, n) a(i), range(0, n) b(j)")
def _(spark, d):
    return G.distance_matrix(spark, rows_of(spark, d)).select("i", "j", rounded(F.col("d"), 9).alias("d"))


@register("disk_kernel", "WITH r AS (SELECT max(l_linenumber) AS r FROM lineitem) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST((i - r) * (i - r) + (j - r) * (j - r) <= r * r AS INTEGER) AS v FROM r, range(0, 2 * r + 1) a(i), range(0, 2 * r + 1) b(j)")
def _(spark, d):
    """As wide as an order has lines at most."""
    return G.disk(spark, V.table(spark, d, "lineitem").agg(F.max("l_linenumber")).first()[0])


@register("value_range", "SELECT CAST(id // 300 AS INTEGER) AS row, CAST(id % 300 AS INTEGER) AS col, CAST(id % 256 AS INTEGER) AS v FROM range(0, (SELECT count(*) FROM events)) t(id)")
def _(spark, d):
    return G.value_range(spark, V.table(spark, d, "events").count(), 300)


@register("triangle_wave", f"WITH h AS (SELECT max(row) + 1 AS n FROM {V.PX_EV}) SELECT CAST(id // n AS INTEGER) AS row, CAST(id % n AS INTEGER) AS col, CAST(-2000 + CASE WHEN id % 24000 <= 12000 THEN id % 24000 ELSE 24000 - id % 24000 END AS INTEGER) AS v FROM h, range(0, n * n) t(id)")
def _(spark, d):
    return G.triangle_wave(spark, rows_of(spark, d))


@register("xyz_base_tiles", f"SELECT tx, ty, count(*) AS n, round(avg(z), 4) AS mean FROM (SELECT t.*, p.z FROM ({tms_sql(7)}) t JOIN {V.PT_CUST} p USING (id)) GROUP BY tx, ty")
def _(spark, d):
    m = T.Mercator()
    tx, ty = m.tile_of_metres(*m.metres(F.col("lat"), F.col("lon")), z(7))
    return V.pt_cust(spark, d).select(tx.alias("tx"), ty.alias("ty"), "z").groupBy("tx", "ty").agg(F.count("*").alias("n"), F.round(F.avg("z"), 4).alias("mean"))


@register("tile_pyramid", f"SELECT DISTINCT CAST(9 - u AS INTEGER) AS tz, CAST(tx >> u AS INTEGER) AS tx, CAST(ty >> u AS INTEGER) AS ty FROM ({tms_sql(9)}), (SELECT CAST(u AS INTEGER) AS u FROM range(0, 10) r(u))")
def _(spark, d):
    return X.tile_pyramid(tms(spark, d, 9).withColumn("tz", z(9)).select("tz", "tx", "ty"), 0)


@register("data_band_count", "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 OR p_size % 5 IN (2, 4) THEN p_size % 5 - 1 ELSE p_size % 5 END AS bands FROM part")
def _(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.data_bands(F.col("p_size") % 5, F.col("p_size") % 7 == 0).alias("bands"))


@register("srs_choice", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'EPSG:1' WHEN p_size % 3 = 1 THEN 'EPSG:2' ELSE 'EPSG:3' END AS input, CASE WHEN p_size % 4 = 0 THEN 'EPSG:3857' WHEN p_size % 4 = 1 THEN 'EPSG:4326' ELSE 'own' END AS output FROM part")
def _(spark, d):
    s = F.col("p_size")
    got = T.input_srs(F.when(s % 3 == 0, "EPSG:1"), F.when(s % 3 == 1, "EPSG:2").otherwise(""), F.lit("EPSG:3"))
    out = T.output_srs(F.when(s % 4 == 0, "mercator").when(s % 4 == 1, "geodetic").otherwise("raster"), F.lit("own"))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), got.alias("input"), out.alias("output"))


@register("nodata_list", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '1,1,1' WHEN 1 THEN '1,2,1' ELSE '1,2,3,4' END AS nodata FROM part")
def _(spark, d):
    s = F.col("p_size") % 3
    option = F.when(s == 0, F.array(F.lit(1))).when(s == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(",", T.nodata_list(option, F.lit(3)).cast("array<string>")).alias("nodata"))
