"""Tile and georeferencing arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
SHIFT = math.pi * EARTH
WEB_MERCATOR_R = 20037508.3427892
TILE = 256
MAX_ZOOM = 32


def two_to(zoom) -> Column:
    return F.pow(F.lit(2.0), zoom)


def slippy_tile(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    n = two_to(zoom)
    y = (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n
    return ((lon + 180.0) / 360.0 * n).cast("int"), y.cast("int")


def tile_corner(x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the upper left corner."""
    n = two_to(zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * (WEB_MERCATOR_R / 180), F.log(F.tan((90 + lat) * (math.pi / 360))) / (math.pi / 180) * (WEB_MERCATOR_R / 180)


def mercator_resolution(zoom: Column) -> Column:
    return WEB_MERCATOR_R * 2 / 256 / two_to(zoom)


def tile_url(template: str, x: Column, y: Column, zoom: Column, servers: int = 4, chinese: bool = False) -> Column:
    """A tile's URL; the server follows from x and y, so that a tile has one URL."""
    server = F.pmod(x + y, F.lit(servers)).cast("string")
    tail = F.format_string("x=%d&y=%d&z=%d", x, y, zoom)
    return F.concat(F.replace(F.lit(template), F.lit("{server}"), server), F.lit("hl=zh-CN&gl=cn&" if chinese else ""), tail)


def world_file(x: Column, y: Column, zoom: Column) -> Column:
    lon, lat = tile_corner(x, y, zoom)
    mx, my = web_mercator(lon, lat)
    res = mercator_resolution(zoom)
    return F.format_string("\n".join(["%16.7f"] * 6), res, F.lit(0.0), F.lit(0.0), -res, mx, my)


def tile_path(x: Column, y: Column, zoom: Column, suffix: str = "png") -> Column:
    return F.concat_ws("/", zoom.cast("string"), x.cast("string"), F.concat(y.cast("string"), F.lit("." + suffix)))


class Mercator:
    """Tiles of the global mercator profile (rows count from the south)."""

    def __init__(self, tile: int = TILE):
        self.tile, self.initial = tile, 2 * SHIFT / tile

    def metres(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return lon * SHIFT / 180.0, F.log(F.tan((90 + lat) * math.pi / 360.0)) / (math.pi / 180.0) * SHIFT / 180.0

    def lat_lon(self, mx: Column, my: Column) -> tuple[Column, Column]:
        lat = my / SHIFT * 180.0
        return 180 / math.pi * (2 * F.atan(F.exp(lat * math.pi / 180.0)) - math.pi / 2.0), mx / SHIFT * 180.0

    def resolution(self, zoom: Column) -> Column:
        return self.initial / two_to(zoom)

    def metres_of_pixel(self, px: Column, py: Column, zoom: Column) -> tuple[Column, Column]:
        res = self.resolution(zoom)
        return px * res - SHIFT, py * res - SHIFT

    def pixel(self, mx: Column, my: Column, zoom: Column) -> tuple[Column, Column]:
        res = self.resolution(zoom)
        return (mx + SHIFT) / res, (my + SHIFT) / res

    def tile_of_pixel(self, px: Column, py: Column) -> tuple[Column, Column]:
        return tuple((F.ceil(p / float(self.tile)) - 1).cast("int") for p in (px, py))

    def raster_pixel(self, px: Column, py: Column, zoom: Column) -> tuple[Column, Column]:
        return px, two_to(zoom) * self.tile - py

    def tile_of_metres(self, mx: Column, my: Column, zoom: Column) -> tuple[Column, Column]:
        return self.tile_of_pixel(*self.pixel(mx, my, zoom))

    def bounds(self, tx: Column, ty: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
        low = self.metres_of_pixel(tx * self.tile, ty * self.tile, zoom)
        return *low, *self.metres_of_pixel((tx + 1) * self.tile, (ty + 1) * self.tile, zoom)

    def lat_lon_bounds(self, tx: Column, ty: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
        """South, west, north, east."""
        a, b, c, d = self.bounds(tx, ty, zoom)
        return *self.lat_lon(a, b), *self.lat_lon(c, d)

    def zoom_for(self, pixel_size: Column) -> Column:
        return zoom_for(pixel_size, self.initial)


class Geodetic:
    """Tiles of the global geodetic profile; compatible: two tiles at zoom 0, else one."""

    def __init__(self, compatible: bool = True, tile: int = TILE):
        self.tile, self.factor = tile, (180.0 if compatible else 360.0) / tile

    def resolution(self, zoom: Column) -> Column:
        return self.factor / two_to(zoom)

    def pixel(self, lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
        res = self.resolution(zoom)
        return (180 + lon) / res, (90 + lat) / res

    def tile_of(self, lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
        return Mercator.tile_of_pixel(self, *self.pixel(lon, lat, zoom))

    def bounds(self, tx: Column, ty: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
        """West, south, east, north."""
        res = self.resolution(zoom) * self.tile
        return tx * res - 180, ty * res - 90, (tx + 1) * res - 180, (ty + 1) * res - 90

    def lat_lon_bounds(self, tx: Column, ty: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
        w, s, e, n = self.bounds(tx, ty, zoom)
        return s, w, n, e

    def zoom_for(self, pixel_size: Column) -> Column:
        return zoom_for(pixel_size, self.factor)


def zoom_for(pixel_size: Column, initial: float) -> Column:
    """The zoom before the first one with a finer resolution than the pixel size (0 at least, 31 if there is none)."""
    finer = F.filter(F.sequence(F.lit(0), F.lit(MAX_ZOOM - 1)), lambda z: pixel_size > initial / F.pow(F.lit(2.0), z))
    return F.when(F.size(finer) == 0, MAX_ZOOM - 1).otherwise(F.greatest(F.lit(0), F.try_element_at(finer, F.lit(1)) - 1))


def flipped_row(ty: Column, zoom: Column) -> Column:
    return (two_to(zoom) - 1 - ty).cast("int")


def quadkey(tx: Column, ty: Column, zoom: Column) -> Column:
    row = flipped_row(ty, zoom)
    bit = lambda v, i: F.pmod(F.floor(v / F.pow(F.lit(2.0), i - 1)), F.lit(2))
    digits = F.transform(F.sequence(zoom, F.lit(1), F.lit(-1)), lambda i: (bit(tx, i) + 2 * bit(row, i)).cast("int").cast("string"))
    return F.when(zoom <= 0, F.lit("")).otherwise(F.concat_ws("", digits))


def world_to_pixel(x: Column, y: Column, ulx, uly, xres, yres, compat: bool = False) -> tuple[Column, Column]:
    """Column and line of a point. compat: the line's sign as divided by the signed vertical resolution."""
    line = (F.lit(uly) - y) / F.lit(yres)
    return ((x - ulx) / F.lit(xres)).cast("int"), (line if compat else -line).cast("int")


def raster_extent(ulx, xres, xskew, uly, yskew, yres, cols: Column, rows: Column) -> tuple[Column, Column, Column, Column]:
    """Left, low, right, high of a geotransform's grid."""
    return F.lit(ulx) + rows * F.lit(xskew), F.lit(uly) + rows * F.lit(yres), F.lit(ulx) + cols * F.lit(xres), F.lit(uly) + cols * F.lit(yskew)


def _axis(start: Column, end: Column, origin, step, size, query) -> tuple[Column, Column, Column, Column]:
    """Read offset, read size, write offset and write size along one axis, cut to the raster."""
    read = ((start - origin) / step + 0.001).cast("int")
    length = ((end - start) / step + 0.5).cast("int")
    width = F.lit(query) if query else length
    before = F.when(read < 0, -read).otherwise(0)
    write = F.when(before > 0, (width * F.try_divide(before.cast("double"), length)).cast("int")).otherwise(0)
    width = width - write
    length = length - F.when(before > 0, (length * F.try_divide(before.cast("double"), length)).cast("int")).otherwise(0)
    read = F.greatest(read, F.lit(0))
    beyond = read + length > size
    width = F.when(beyond, (width * F.try_divide((F.lit(size) - read).cast("double"), length)).cast("int")).otherwise(width)
    return read, F.when(beyond, F.lit(size) - read).otherwise(length), write, width


def query_window(left: Column, top: Column, right: Column, bottom: Column, ulx, uly, xres, yres, xsize: int, ysize: int, query: int = 0) -> list[Column]:
    """rx, ry, rxsize, rysize, wx, wy, wxsize, wysize: what to read of a raster for a box, and where it goes."""
    rx, rw, wx, ww = _axis(left, right, ulx, xres, xsize, query)
    ry, rh, wy, wh = _axis(top, bottom, uly, yres, ysize, query)
    return [rx, ry, rw, rh, wx, wy, ww, wh]


def data_bands(count: Column, alpha_flag: Column) -> Column:
    return F.when(alpha_flag | count.isin(2, 4), count - 1).otherwise(count)


def has_georeference(transform: Column, gcps: Column) -> Column:
    identity = F.array(*[F.lit(v) for v in (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    return (transform != identity) | (gcps > 0)


def nodata_list(option: Column, bands: Column) -> Column:
    """An option list repeated up to the number of bands; a longer one as it is."""
    n = F.size(option)
    return F.when(n >= bands, option).otherwise(F.slice(F.flatten(F.array_repeat(option, bands)), F.lit(1), bands))


def input_srs(option: Column, dataset: Column, gcps: Column) -> Column:
    return F.coalesce(option, F.nullif(dataset, F.lit("")), gcps)


def output_srs(profile: Column, own: Column) -> Column:
    return F.when(profile == "mercator", "EPSG:3857").when(profile == "geodetic", "EPSG:4326").otherwise(own)


def helmert(x: Column, y: Column, z: Column, a: list) -> tuple[Column, Column, Column]:
    """Seven-parameter transformation: shifts a0..a2, rotations a3..a5, scale a6."""
    k = 1 + a[6]
    return a[0] + k * (x + a[5] * y - a[4] * z), a[1] + k * (-a[5] * x + y + a[3] * z), a[2] + k * (a[4] * x - a[3] * y + z)


def helmert_design(x: Column, y: Column, z: Column, a: list) -> Column:
    """The three rows of the design matrix of a point."""
    k, zero, one = 1 + a[6], F.lit(0.0), F.lit(1.0)
    return F.array(
        F.array(one, zero, zero, zero, -k * z, k * y, x + a[5] * y - a[4] * z),
        F.array(zero, one, zero, k * z, zero, -k * x, -a[5] * x + y + a[3] * z),
        F.array(zero, zero, one, -k * y, k * x, zero, a[4] * x - a[3] * y + z),
    )
