"""Sinks of tile trees: images, paths, KML and TMS documents."""

from __future__ import annotations

from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.sources import codecs


#: What KML viewers are told of a list of tiles.
STYLE = '<Style><ListStyle id="hideChildren"><listItemType>checkHideChildren</listItemType></ListStyle></Style>'
SWNE = ["south", "west", "north", "east"]


def box(kind: str, swne: list[Column]) -> Column:
    south, west, north, east = swne
    return F.format_string(f"<{kind}><north>%.14f</north><south>%.14f</south><east>%.14f</east><west>%.14f</west></{kind}>", north, south, east, west)


def region(swne: list[Column], low: Column, high: Column) -> Column:
    lod = F.format_string("<Lod><minLodPixels>%d</minLodPixels><maxLodPixels>%d</maxLodPixels></Lod>", low, high)
    return F.concat(F.lit("<Region>"), box("LatLonAltBox", swne), lod, F.lit("</Region>"))


def kml(tx: Column, ty: Column, tz: Column, swne: list[Column], children: Column, suffix: str = "png", size: int = 256, url: str = "../../") -> Column:
    """KML of a tile: its name, region, overlay with its box, and links to its children, each with its own region (array of
    structs tz, tx, ty, south, west, north, east)."""
    low = F.lit(size // 2)
    own = region(swne, low, F.when(F.size(children) > 0, size * 8).otherwise(-1))
    overlay = F.concat(F.format_string(f"<GroundOverlay><drawOrder>%d</drawOrder><Icon><href>%d.{suffix}</href></Icon>", F.when(tx == 0, 2 * tz + 1).otherwise(2 * tz), ty), box("LatLonBox", swne), F.lit("</GroundOverlay>"))
    link = lambda c: F.concat(F.format_string(f"<NetworkLink><name>%d/%d/%d.{suffix}</name>", c.tz, c.tx, c.ty), region([c[x] for x in SWNE], low, F.lit(-1)), F.format_string(f"<Link><href>{url}%d/%d/%d.kml</href><viewRefreshMode>onRegion</viewRefreshMode><viewFormat/></Link></NetworkLink>", c.tz, c.tx, c.ty))
    head = F.format_string(f'<?xml version="1.0" encoding="utf-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>%d/%d/%d.kml</name><description></description>{STYLE}', tz, tx, ty)
    return F.concat(head, own, overlay, F.concat_ws("", F.transform(children, link)), F.lit("</Document></kml>"))


def root_kml(title: str, children: Column, suffix: str = "png", size: int = 256) -> Column:
    """KML of a whole tree: a name and links to the tiles of its least zoom."""
    link = lambda c: F.concat(F.format_string(f"<NetworkLink><name>%d/%d/%d.{suffix}</name>", c.tz, c.tx, c.ty), region([c[x] for x in SWNE], F.lit(size // 2), F.lit(-1)), F.format_string("<Link><href>%d/%d/%d.kml</href><viewRefreshMode>onRegion</viewRefreshMode><viewFormat/></Link></NetworkLink>", c.tz, c.tx, c.ty))
    head = f'<?xml version="1.0" encoding="utf-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(title)}</name><description></description>{STYLE}'
    return F.concat(F.lit(head), F.concat_ws("", F.transform(children, link)), F.lit("</Document></kml>"))


def children(tiles: DataFrame) -> DataFrame:
    """Each tile (tz, tx, ty, south, west, north, east) with its children that exist."""
    child = F.struct("tz", "tx", "ty", *SWNE)
    below = tiles.select((F.col("tz") - 1).alias("tz"), F.floor(F.col("tx") / 2).cast("int").alias("tx"), F.floor(F.col("ty") / 2).cast("int").alias("ty"), child.alias("c"))
    kids = below.groupBy("tz", "tx", "ty").agg(F.array_sort(F.collect_list("c")).alias("children"))  # four at most
    none = F.array().cast("array<struct<tz: int, tx: int, ty: int, south: double, west: double, north: double, east: double>>")
    return tiles.join(kids, ["tz", "tx", "ty"], "left").withColumn("children", F.coalesce("children", none))


def tilemap(title: str, profile: str, low: int, high: int, bounds: tuple[float, float, float, float], suffix: str = "png", size: int = 256, url: str = "", srs: str = "", pixel: float = 1.0) -> str:
    """The TMS resource document. Of the profile raster, srs and the size of a pixel at the highest zoom are given."""
    srs = {"mercator": "EPSG:3857", "geodetic": "EPSG:4326"}.get(profile, srs)
    units = lambda z: {"mercator": 156543.0339 / 2**z, "geodetic": 0.703125 / 2**z}.get(profile, pixel * 2 ** (high - z))
    sets = "".join(f'<TileSet href="{escape(url)}{z}" units-per-pixel="{units(z):.14f}" order="{z}"/>' for z in range(low, high + 1))
    west, south, east, north = bounds
    corner = f'<BoundingBox minx="{west:.14f}" miny="{south:.14f}" maxx="{east:.14f}" maxy="{north:.14f}"/><Origin x="{west:.14f}" y="{south:.14f}"/>'
    kind = f'<TileFormat width="{size}" height="{size}" mime-type="image/{suffix}" extension="{suffix}"/>'
    return f'<?xml version="1.0" encoding="utf-8"?><TileMap version="1.0.0" tilemapservice="http://tms.osgeo.org/1.0.0"><Title>{escape(title)}</Title><Abstract></Abstract><SRS>{escape(srs)}</SRS>{corner}{kind}<TileSets profile="{profile}">{sets}</TileSets></TileMap>'


def encoded(tiles: DataFrame, size: int = 256) -> DataFrame:
    """tz, tx, ty, path (zoom/x/y.png) and png of tiles (tz, tx, ty, data, alpha) of one or three bands."""

    def run(batches):
        for df in batches:
            images = [codecs.encode_png(np.frombuffer(d + a, np.uint8).reshape(-1, size, size)) for d, a in zip(df["data"], df["alpha"])]
            paths = [f"{z}/{x}/{y}.png" for z, x, y in zip(df["tz"], df["tx"], df["ty"])]
            yield pd.DataFrame({"tz": df["tz"], "tx": df["tx"], "ty": df["ty"], "path": paths, "png": images})

    return tiles.mapInPandas(run, "tz int, tx int, ty int, path string, png binary")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes images (path, png) below a folder, each from the task that has it: path and bytes. The folder is an address that pyarrow's
    file systems know (a mounted folder, or that of a store), and must be one that executors share. A tile that is written again
    is whole either way, as it is put in place by renaming."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for df in batches:
            for path, png in zip(df["path"], df["png"]):
                place = f"{root.rstrip('/')}/{path}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place + ".part") as out:
                    out.write(png)
                store.move(place + ".part", place)
            yield pd.DataFrame({"path": df["path"], "bytes": df["png"].map(len)})

    return images.select("path", "png").mapInPandas(run, "path string, bytes long")
