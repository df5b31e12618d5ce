"""Names, URLs, XML, JSON and report texts of scenes as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key words of file names by kind of image.
PAN_WORDS = ["navp_", "_nad_", "NAD", "PAN", "pan", "DOMP", "_P_"]
MSS_WORDS = ["favm_", "_mux_", "MUX", "MSS", "DOMM", "_MS_", "_MS1_"]
LIST_MSS = ["favm_", "_mux_", "MUX", "_MS_", "MSS", "M2AS"]
LIST_PAN = ["navp_", "_nad_", "NAD", "PAN", "_P_", "pan", "P2AS"]
LIST_DSM = ["navp_", "_nad_", "NAD", "favp_", "_fwd_", "-FWD", "_FWD_", "_bwd_", "-BWD", "_BWD_", "P2AS"]

# Satellites and sensors that have calibration settings.
SATELLITES = ["GF1", "GF1B", "GF1C", "GF1D", "GF2", "GF6", "ZY3_01", "ZY3_02", "ZY3_03", "GFDM", "GF7", "GF4", "CBERS_04A", "CBERS_04", "HJ_1B", "HJ_1A", "ZY1_02D", "ZY1_02C"]
SENSORS = ["GF1_MSS1", "GF1_MSS2", "GF1_WFV1", "GF1_WFV2", "GF1_WFV3", "GF1_WFV4", "GF2_MSS1", "GF2_MSS2", "GF6_MSS", "GF6_WFV", "CBERS_04A_WPM", "CBERS_04A_MUX", "CBERS_04A_WFI", "CBERS_04_P5M", "CBERS_04_MUX", "CBERS_04_WFI", "CBERS_04_P10", "HJ_1B_CCD1", "HJ_1B_CCD2", "HJ_1A_CCD1", "HJ_1A_CCD2"]

# Tags of a scene's metadata file.
SCENE_TAGS = ["SatelliteID", "SensorID", "ReceiveTime", "SolarAzimuth", "SolarZenith", "SatelliteAzimuth", "SatelliteZenith", "TopLeftLatitude", "TopLeftLongitude", "TopRightLatitude", "TopRightLongitude", "BottomRightLatitude", "BottomRightLongitude", "BottomLeftLatitude", "BottomLeftLongitude"]


def has_any(name: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(w) for w in words])


def image_type(name: Column) -> Column:
    """pan, mss or null, by ordered rules on the file name."""
    return (
        F.when(name.endswith("browser.tif"), F.lit(None))
        .when(name.startswith("SV"), F.when(name.rlike(r"P[12]\.img$"), "pan").when(name.rlike(r"M[12]\.img$"), "mss"))
        .when(name.endswith("TIL"), F.when(name.contains("P2AS"), "pan").when(name.contains("M2AS"), "mss"))
        .when(F.upper(name).startswith("GF7"), F.when(name.contains("BWD"), "pan").when(name.contains("MUX"), "mss"))
        .otherwise(F.when(has_any(name, PAN_WORDS), "pan").when(has_any(name, MSS_WORDS), "mss"))
    )


def is_image(name: Column, kind: str = "all") -> Column:
    """Whether a file belongs to a listing of images of a kind: all, mss, pan or dsm."""
    if kind not in ("all", "mss", "pan", "dsm"):
        raise ValueError("kind must be all, mss, pan or dsm")
    listed = name.rlike(r"\.(tif|img|tiff|TIF|IMG|TIFF)$") & ~(F.lower(name).rlike("^(bj3|triplesat)") & name.endswith("browser.tif"))
    wanted = {
        "all": F.lit(True),
        "mss": has_any(name, LIST_MSS),
        "pan": F.when(name.startswith("GF7"), name.contains("_BWD_")).otherwise(has_any(name, LIST_PAN)),
        "dsm": F.when(name.startswith("SV"), name.rlike(r"PAN[12]\.tiff$")).otherwise(has_any(name, LIST_DSM)),
    }
    return listed & wanted[kind]


def mgrs_tile(product: Column) -> Column:
    """Tile of a Sentinel-2 product name: the part before the last, without its first letter."""
    return F.substring(F.element_at(F.split(product, "_"), -2), 2, 100)


def unpacked_folder(archive: Column) -> Column:
    """S2_<tile>_<date>_<id> of a product archive's name."""
    parts = F.split(archive, "_")
    return F.concat_ws("_", F.lit("S2"), F.element_at(parts, 6), F.substring(F.element_at(parts, 3), 1, 8), F.element_at(parts, 4))


def band_file(member: Column) -> Column:
    return F.right(member, F.lit(7))


def preview_name(product: Column, cloud: Column) -> Column:
    return F.format_string("S2_C%02d_T%s_D%s.jpg", cloud.cast("int"), F.substring(product, 40, 5), F.substring(product, 12, 8))


def preview_fields(name: Column) -> tuple[Column, Column, Column]:
    """Stem, tile and date of a preview's name."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return stem, F.substring(stem, 9, 5), F.substring(stem, 16, 8)


def epsg_of_gml(gml: Column) -> Column:
    """EPSG:<n> of the srsName of a GML text; null where there is none."""
    code = F.regexp_extract(gml, r'srsName="[^"]*:(\d+)"', 1)
    return F.when(code != "", F.concat(F.lit("EPSG:"), code))


def tag(xml: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(xml, rf"<{name}>([^<]*)</{name}>", 1), F.lit(""))


def scene_fields(xml: Column) -> list[Column]:
    return [tag(xml, t).alias(t) for t in SCENE_TAGS]


def scene_kind(name: Column) -> Column:
    return F.when(F.lower(name).rlike("^gf[12]"), F.upper(F.substring(name, 1, 3)))


def scene_box(xml: Column, gf7: bool = False) -> tuple[Column, Column, Column, Column]:
    """Least longitude and latitude, greatest longitude and latitude of a scene's four corners."""
    if gf7:  # the files spell it Longtitude
        points = [F.regexp_extract(xml, rf"(?s)<{p}Point>(.*?)</{p}Point>", 1) for p in ("LeftTop", "RightTop", "RightBottom", "LeftBottom")]
        lons, lats = [tag(p, "Longtitude").cast("double") for p in points], [tag(p, "Latitude").cast("double") for p in points]
    else:
        corners = ["TopLeft", "TopRight", "BottomRight", "BottomLeft"]
        lons, lats = ([tag(xml, c + n).cast("double") for c in corners] for n in ("Longitude", "Latitude"))
    return F.least(*lons), F.least(*lats), F.greatest(*lons), F.greatest(*lats)


def metadata_path(path: Column) -> Column:
    """The XML file beside an image file."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    wide = F.concat(folder, F.element_at(F.split(name, "-"), 1), F.lit(".xml"))
    return F.when(F.upper(name).startswith("GF6_WFV"), wide).when(F.lower(name).startswith("gf7"), F.replace(path, F.lit(".tif"), F.lit(".xml"))).otherwise(F.replace(path, F.lit(".tiff"), F.lit(".xml")))


def only_rgb(xml: Column) -> Column:
    return F.regexp_replace(xml, "<OnlyRGB>[^<]*</OnlyRGB>", "<OnlyRGB>true</OnlyRGB>")


def atmosphere(report: Column) -> tuple[Column, Column, Column]:
    """Transmission, upwelling and downwelling radiance (its first four characters) of a report."""
    number = lambda label, n="[^<]*": F.trim(F.regexp_extract(report, rf"{label}[^<:]*:\s*({n})", 1))
    return (
        number("Band average atmospheric transmission").cast("double"),
        F.substring(number("Effective bandpass upwelling radiance"), 1, 4).cast("double"),
        F.substring(number("Effective bandpass downwelling radiance"), 1, 4).cast("double"),
    )


def aws_scene_url(scene: Column, band: Column) -> Column:
    root = F.lit("https://landsat-pds.s3.amazonaws.com/c1/L8/")
    return F.concat(root, F.substring(scene, 11, 3), F.lit("/"), F.substring(scene, 14, 3), F.lit("/"), scene, F.lit("/"), scene, F.lit("_"), band, F.lit(".TIF"))


def aws_tile_url(tile: Column, date: Column, member: Column, index: str = "0") -> Column:
    """Object of a Sentinel-2 tile on a day; month and day aren't padded."""
    root = F.lit("http://sentinel-s2-l1c.s3.amazonaws.com/tiles")
    parts = [F.substring(tile, 1, 2), F.substring(tile, 3, 1), F.substring(tile, 4, 3), F.year(date), F.month(date), F.dayofmonth(date)]
    return F.concat_ws("/", root, *[p.cast("string") for p in parts], F.lit(index), member)


def path_row(path: Column, row: Column) -> Column:
    """Padded path and row inside the covered region, else null."""
    return F.when(path.between(113, 151) & row.between(23, 49), F.concat(F.lpad(path.cast("string"), 3, "0"), F.lpad(row.cast("string"), 3, "0")))


def byte_ranges(length: Column, parts: int = 5, least: int = 100_000) -> Column:
    """Array of `bytes=a-b` ranges of a download in parts of at least `least` bytes; one part is null (no range)."""
    n = F.when(length / float(parts) < least, (length / float(least)).cast("int")).otherwise(parts)
    ranges = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda i: F.concat(F.lit("bytes="), F.when(i == 0, F.lit("0")).otherwise(((length / n * i).cast("long") + 1).cast("string")), F.lit("-"), F.when(i == n - 1, length.cast("string")).otherwise((length / n * (i + 1)).cast("long").cast("string"))),
    )
    return F.when(n > 1, ranges)


def basic_authorization(user: Column, word: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.concat(user, F.lit(":"), word).cast("binary")))


def group_key(name: Column) -> Column:
    """The date part of a name like product.A2018001.h26v04."""
    return F.get(F.split(name, r"\."), 1)


def longitude_token(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"[EW](\d+\.?\d*)[NS]", 1), F.lit(""))


def tile_of_name(name: Column) -> tuple[Column, Column, Column]:
    """x, y, z of `x=<x>&y=<y>&z=<z>` (z: all digits)."""
    return tuple(F.regexp_extract(name, r"x=(\d+)&y=(\d+)&z=(\d+)", i).cast("int") for i in (1, 2, 3))


def listed_files(page: Column, year: Column, day: Column, product: str, collection: int, cells: str, characters: int) -> Column:
    """Paths of a day's files of a product in a page that lists them: those of the cells (a pattern), with so many characters
    from the cell to the suffix."""
    folder = F.concat(F.lit(f"/archive/allData/{collection}/{product}/"), year.cast("string"), F.lit("/"), day.cast("string"), F.lit("/"))
    start = F.concat(folder, F.lit(product + ".A"), year.cast("string"), day.cast("string"))
    return F.regexp_extract_all(page, F.concat(F.lit("("), F.replace(start, F.lit("."), F.lit("\\.")), F.lit(f"{cells}.{{{characters}}}hdf)")), F.lit(1))


def aerosol_files(page: Column, year: Column, day: Column) -> Column:
    return listed_files(page, year, day, "MYD04_3K", 61, "", 24)


def temperature_files(page: Column, year: Column, day: Column, aqua: bool = False) -> Column:
    return listed_files(page, year, day, "MYD11A1" if aqua else "MOD11A1", 6, r"\.h2[6-7]v04", 19)


def of_tile(display_id: Column, tile: Column) -> Column:
    """Whether a found scene (its second part, without the leading letter) is of the tile that was asked for."""
    return F.substring(F.element_at(F.split(display_id, "_"), 2), 2, 100) == tile


def scene_archive(base: Column, product: Column) -> Column:
    return F.concat(base, product, F.lit(".SAFE.zip"))


def stated_extent(abstract: Column) -> Column:
    """Numbers of the text in which a product's record states its extent."""
    return F.transform(F.filter(F.split(abstract, " "), lambda x: x != ""), lambda x: x.cast("double"))


def scene_folder(scene: Column, store: str = "s3") -> Column:
    """Where a Landsat scene's files are in the public stores of Amazon (s3) and Google (gs)."""
    root = {"s3": "s3://landsat-pds/c1/L8/", "gs": "gs://gcp-public-data-landsat/LC08/01/"}[store]
    return F.concat(F.lit(root), F.substring(scene, 11, 3), F.lit("/"), F.substring(scene, 14, 3), F.lit("/"), scene, F.lit("/"))


def is_listed(key: Column, pattern: str) -> Column:
    """Whether a listing of `pattern` shows the key: * stands for anything within a folder, ** for anything at all."""
    anything = {"*": "[^/]*", "**": ".*"}
    return key.rlike("(?s)^" + "".join(anything.get(x) or re.escape(x) for x in re.split(r"(\*\*?)", pattern)) + "$")
