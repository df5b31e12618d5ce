import io
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import codecs, rasters, tiles, vectors


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32", "float64"])
@pytest.mark.parametrize("compress", [True, False])
def test_tiff_round_trip(dtype, compress):
    bands = (np.arange(2 * 5 * 7).reshape(2, 5, 7) * 3).astype(dtype)
    got = codecs.decode_tiff(codecs.encode_tiff(codecs.Raster(bands, (10.0, 0.5, 0.0, 20.0, 0.0, -0.25), -1.0), compress))
    assert (got.bands == bands).all() and got.transform == (10.0, 0.5, 0.0, 20.0, 0.0, -0.25) and got.nodata == -1


def tiff(width, height, samples, chunks, entries, order="<"):
    """A TIFF file of such chunks; entries: tag, kind, values; of the chunks' places only the tags are given."""
    fixed = [(256, 4, [width]), (257, 4, [height]), (258, 3, [16] * samples), (277, 3, [samples]), (339, 3, [1] * samples)]
    head = b"II*\0" if order == "<" else b"MM\0*"
    at, places, body = 8, [], b""
    for c in chunks:
        places.append(at + len(body))
        body += c + b"\0" * (len(c) % 2)
    all_ = sorted(fixed + [(t, k, places if v == "places" else [len(c) for c in chunks] if v == "sizes" else v) for t, k, v in entries])
    sizes, table, tail = {3: "H", 4: "I"}, b"", b""
    start = at + len(body)
    after = start + 2 + 12 * len(all_) + 4
    for tag, kind, values in all_:
        raw = struct.pack(order + sizes[kind] * len(values), *values)
        table += struct.pack(order + "HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", after + len(tail)))
        tail += raw if len(raw) > 4 else b""
    return head + struct.pack(order + "I", start) + body + struct.pack(order + "H", len(all_)) + table + b"\0" * 4 + tail


def pack_lzw(data):
    table, codes, word, width = {bytes([i]): i for i in range(256)}, [(256, 9)], b"", 9
    for i in range(len(data)):
        x = data[i : i + 1]
        if word + x in table:
            word += x
            continue
        codes.append((table[word], width))
        table[word + x] = len(table) + 2
        width = min(12, (len(table) + 2).bit_length())
        if len(table) + 2 >= 4094:
            codes.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = x
    codes += [(table[word], width), (257, min(12, (len(table) + 3).bit_length()))]
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def pack_runs(data):
    return b"".join(bytes([257 - n if n > 1 else 0]) + data[i : i + 1] for i, n in ((i, 1) for i in range(len(data))))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed,pack", [(1, bytes), (8, zlib.compress), (5, pack_lzw), (32773, pack_runs)])
@pytest.mark.parametrize("planar,predictor", [(1, 1), (1, 2), (2, 2)])
def test_tiled_and_packed_tiffs(order, packed, pack, planar, predictor):
    bands = np.random.default_rng(packed).integers(0, 700, (2, 37, 50)).astype(np.uint16)
    for high, wide in ((16, 32), (10, None)):
        padded = np.pad(bands, ((0, 0), (0, -37 % high), (0, -50 % (wide or 50)))) if wide else bands
        chunks = []
        for group in ([padded] if planar == 1 else [padded[:1], padded[1:]]):
            for top in range(0, group.shape[1], high):
                for left in range(0, group.shape[2], wide or 50):
                    part = group[:, top : top + high, left : left + (wide or 50)].transpose(1, 2, 0).copy()
                    if predictor == 2:
                        part[:, 1:] = np.diff(part, axis=1)
                    chunks.append(pack(part.astype(f"{order}u2").tobytes()))
        shape = [(322, 4, [wide]), (323, 4, [high]), (324, 4, "places"), (325, 4, "sizes")] if wide else [(278, 4, [high]), (273, 4, "places"), (279, 4, "sizes")]
        keys = [(34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32650])]
        got = codecs.decode_tiff(tiff(50, 37, 2, chunks, [*shape, *keys, (259, 3, [packed]), (284, 3, [planar]), (317, 3, [predictor])], order))
        assert (got.bands == bands).all() and got.meta["epsg"] == 32650 and got.meta["dtype"] == "uint16"


def test_packbits_runs_and_reference_systems():
    assert codecs.unpack_runs(b"\xfe\xaa\x02\x80\x00\x2a\x80\xfd\xaa") == b"\xaa\xaa\xaa\x80\x00\x2a\xaa\xaa\xaa\xaa"
    for code in (4326, 3857, 32650, None):
        assert codecs.decode_tiff(codecs.encode_tiff(codecs.Raster(np.zeros((1, 2, 2), np.uint8), meta={"epsg": code}))).meta["epsg"] == code
    with pytest.raises(ValueError):
        codecs.unpacked(b"", 7)


def test_png_and_npy_round_trip():
    bands = np.random.default_rng(1).integers(0, 256, (3, 6, 9), dtype=np.uint8)
    assert (codecs.decode_png(codecs.encode_png(bands)) == bands).all()
    assert (codecs.decode_npy(codecs.encode_npy(bands)) == bands).all()


def test_jp2_depth():
    assert codecs.jp2_bit_depth(b"\0" * 8 + b"ihdr" + b"\0" * 10 + bytes([14])) == 15
    with pytest.raises(ValueError):
        codecs.jp2_bit_depth(b"nothing")


@pytest.mark.parametrize("kind", ["tiff", "png", "npy"])
def test_files_round_trip(spark, tmp_path, kind):
    px = spark.range(60).select(F.lit("a").alias("name"), F.lit(1).alias("band"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), (F.col("id") * 4 % 256).cast("double").alias("v"))
    assert rasters.write_rasters(rasters.lines(px, ["name", "band"]), str(tmp_path), "name", kind).count() == 1
    suffix = {"tiff": "*.tif", "png": "*.png", "npy": "*.npy"}[kind]
    back = rasters.pixels(rasters.read_lines(spark, str(tmp_path), suffix, kind))
    assert sorted(back.select("row", "col", "v").collect()) == sorted(px.select("row", "col", "v").collect())
    if kind == "tiff":
        assert rasters.read_metadata(spark, str(tmp_path)).first().width == 10


def test_shapes_and_text(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    (tmp_path / "a.shp").write_bytes(vectors.encode_polygons([[ring], [ring, ring]]))
    got = vectors.read_shapes(spark, str(tmp_path)).orderBy("feature").collect()
    assert [len(r.rings) for r in got] == [1, 2] and tuple(got[0].rings[0][1]) == (0.0, 2.0)
    text = vectors.read_shapes(spark, str(tmp_path)).where("feature = 0").select(vectors.wkt(F.col("rings"))).first()[0]
    assert text.startswith("POLYGON ((0.0 0.0, 0.0 2.0")


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("p/a_TCI.jp2", b"1")
        z.writestr("p/b_TCI.jp2", b"2")
        z.writestr("p/MTD_TL.xml", b"<x/>")
    (tmp_path / "s.zip").write_bytes(buffer.getvalue())
    assert vectors.zip_members(spark, str(tmp_path), "_TCI.jp2").count() == 2
    assert vectors.zip_members(spark, str(tmp_path), "_TCI.jp2", first=True).first().content == b"1"


def test_tables_and_points(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", "y;z")], "a string, b string")
    vectors.write_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, vectors.read_table(spark, str(tmp_path / "t")).collect())) == [("1", "x"), ("2", "y;z")]
    gcps = spark.createDataFrame([(1.5, 2.5, 3.5, 4.5)], "x double, y double, xr double, yr double")
    vectors.write_gcps(gcps, str(tmp_path / "g"))
    assert tuple(vectors.read_gcps(spark, str(tmp_path / "g")).first()) == (1.5, 2.5, 3.5, 4.5)


def test_tile_documents(spark):
    t = spark.createDataFrame([(1, 0, 0, -1.0, -2.0, 0.5, 1.5), (0, 0, 0, -1.0, -2.0, 1.0, 2.0)], "tz int, tx int, ty int, south double, west double, north double, east double")
    swne = [F.col(c) for c in tiles.SWNE]
    docs = tiles.children(t).select("tz", tiles.kml(F.col("tx"), F.col("ty"), F.col("tz"), swne, F.col("children")).alias("kml"), tiles.root_kml("a & b", F.col("children")).alias("root"))
    got = {r.tz: ElementTree.fromstring(r.kml.encode()) for r in docs.collect()}
    k = "{http://www.opengis.net/kml/2.2}"
    text = lambda e, path: e.findtext("/".join(k + x for x in path.split("/")))
    top, leaf = got[0].find(k + "Document"), got[1].find(k + "Document")
    assert text(top, "name") == "0/0/0.kml" and text(leaf, "name") == "1/0/0.kml"
    assert [float(text(top, f"GroundOverlay/LatLonBox/{x}")) for x in ("north", "south", "east", "west")] == [1, -1, 2, -2]
    assert text(top, "GroundOverlay/drawOrder") == "1" and text(leaf, "GroundOverlay/drawOrder") == "3" and text(leaf, "GroundOverlay/Icon/href") == "0.png"
    links = top.findall(k + "NetworkLink")
    assert len(links) == 1 and not leaf.findall(k + "NetworkLink")
    assert text(links[0], "name") == "1/0/0.png" and text(links[0], "Link/href") == "../../1/0/0.kml" and float(text(links[0], "Region/LatLonAltBox/north")) == 0.5
    assert text(links[0], "Link/viewRefreshMode") == "onRegion" and text(top, "Region/Lod/maxLodPixels") == "2048" and text(leaf, "Region/Lod/maxLodPixels") == "-1"
    root = ElementTree.fromstring(docs.where("tz = 0").first().root.encode()).find(k + "Document")
    assert text(root, "name") == "a & b" and text(root, "NetworkLink/Link/href") == "1/0/0.kml"
    tms = ElementTree.fromstring(tiles.tilemap("t", "geodetic", 0, 3, (-180, -90, 180, 90), url="http://x/").encode())
    assert [s.get("href") for s in tms.iter("TileSet")] == [f"http://x/{z}" for z in range(4)] and float(tms.find("Origin").get("x")) == -180 and tms.find("TileFormat").get("mime-type") == "image/png"
    raster = ElementTree.fromstring(tiles.tilemap("t", "raster", 1, 3, (0, 0, 8, 8), srs="EPSG:32650", pixel=2.5).encode())
    assert [float(s.get("units-per-pixel")) for s in raster.iter("TileSet")] == [10, 5, 2.5] and raster.findtext("SRS") == "EPSG:32650"


def test_features_round_trip(spark, tmp_path):
    ring = lambda x: [(x, 0.0), (x, 2.0), (x + 2, 2.0), (x, 0.0)]
    rows = [("a", [[{"x": x, "y": y} for x, y in ring(float(i))]], i, i / 4 if i else None, f"né {i}" if i != 2 else None, i % 2 == 0) for i in range(4)]
    df = spark.createDataFrame(rows, "layer string, rings array<array<struct<x: double, y: double>>>, n long, share double, label string, even boolean")
    assert vectors.write_features(df, f"{tmp_path}/out", "layer").collect()[0].features == 4
    got = vectors.read_features(spark, f"{tmp_path}/out").orderBy("feature").collect()
    assert [r.attributes for r in got] == [{"n": str(i), "share": f"{i / 4:.15g}" if i else None, "label": f"né {i}" if i != 2 else None, "even": "T" if i % 2 == 0 else "F"} for i in range(4)]
    assert [r.rings[0][0].x for r in got] == [0, 1, 2, 3]
    shp, shx = ((tmp_path / "out" / f"a.{x}").read_bytes() for x in ("shp", "shx"))
    places = struct.unpack_from(">8I", shx, 100)
    assert len(shx) == 132 and [struct.unpack_from(">I", shp, 2 * at)[0] for at in places[::2]] == [1, 2, 3, 4]


def test_json_and_xml_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & b"), (2, None)], "id long, name string")
    vectors.write_json(df, f"{tmp_path}/j")
    assert sorted(map(tuple, vectors.read_json(spark, f"{tmp_path}/j", "id long, name string", whole=False).collect())) == [(1, "a & b"), (2, None)]
    vectors.write_xml(df, f"{tmp_path}/x", "scene", "scenes")
    assert sorted(map(tuple, vectors.read_scenes(spark, f"{tmp_path}/x", "scene", "id long, name string").collect())) == [(1, "a & b"), (2, None)]
