"""Vector files, archives and delimited texts as DataFrames, and back."""

from __future__ import annotations

import io
import os
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shape types of shapefiles.
POINT, POLYLINE, POLYGON = 1, 3, 5


def decode_shapes(data: bytes) -> list[tuple[int, list[list[tuple[float, float]]]]]:
    """Type and rings (or lines, or one point) of each shape of a .shp file."""
    out, at = [], 100
    while at + 12 <= len(data):
        words = struct.unpack_from(">I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack_from("<I", body)[0]
        if kind == POINT:
            out.append((kind, [[struct.unpack_from("<dd", body, 4)]]))
        elif kind in (POLYLINE, POLYGON):
            n, m = struct.unpack_from("<II", body, 36)
            starts = [*struct.unpack_from(f"<{n}I", body, 44), m]
            flat = struct.unpack_from(f"<{2 * m}d", body, 44 + 4 * n)
            points = list(zip(flat[::2], flat[1::2]))
            out.append((kind, [points[a:b] for a, b in zip(starts, starts[1:])]))
        else:
            out.append((kind, []))
        at += 8 + 2 * words
    return out


def encode_polygons(shapes: list[list[list[tuple[float, float]]]]) -> bytes:
    """A .shp file of polygons."""
    records, boxes = b"", []
    for i, rings in enumerate(shapes, 1):
        points = [p for r in rings for p in r]
        xs, ys = zip(*points)
        boxes.append((min(xs), min(ys), max(xs), max(ys)))
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        body = struct.pack("<I4dII", POLYGON, *boxes[-1], len(rings), len(points)) + struct.pack(f"<{len(rings)}I", *starts) + b"".join(struct.pack("<dd", *p) for p in points)
        records += struct.pack(">II", i, len(body) // 2) + body
    whole = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4
    return struct.pack(">I20xI", 9994, (100 + len(records)) // 2) + struct.pack("<II8d", 1000, POLYGON, *whole, 0, 0, 0, 0) + records


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """path, feature, kind, rings (arrays of structs x, y) of all shapefiles under a path."""

    def run(batches):
        for df in batches:
            rows = [(p, i, kind, [[{"x": x, "y": y} for x, y in r] for r in rings]) for p, c in zip(df["path"], df["content"]) for i, (kind, rings) in enumerate(decode_shapes(c))]
            yield pd.DataFrame(rows, columns=["path", "feature", "kind", "rings"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.shp").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, feature int, kind int, rings array<array<struct<x: double, y: double>>>")


def decode_attributes(data: bytes, encoding: str = "utf-8") -> list[dict[str, str | None]]:
    """Rows of a .dbf file as texts by field name (blanks are null); rows that are marked as deleted are left out."""
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 32 <= head and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, place, values = data[head + i * width : head + (i + 1) * width], 1, {}
        for name, size in fields:
            values[name] = row[place : place + size].decode(encoding, "replace").strip("\0 ") or None
            place += size
        if row[:1] != b"*":
            out.append(values)
    return out


def encode_attributes(fields: dict[str, str], rows: list[tuple]) -> bytes:
    """A .dbf file. fields: name and kind (string, long, double, boolean or date); a text has as many bytes as its longest."""
    kinds = {"string": "C", "long": "N", "double": "F", "boolean": "L", "date": "D"}
    show = {"C": str, "N": str, "F": lambda v: f"{v:.15g}", "L": lambda v: "T" if v else "F", "D": lambda v: str(v).replace("-", "")}
    codes = [kinds[k] for k in fields.values()]
    columns = [[b"" if r[i] is None else show[c](r[i]).encode() for r in rows] for i, c in enumerate(codes)]
    sizes = [{"N": 19, "F": 24, "L": 1, "D": 8}.get(c) or min(254, max([1, *map(len, column)])) for c, column in zip(codes, columns)]
    described = b"".join(struct.pack("<11sc4xBB14x", name.encode()[:10], c.encode(), size, 0) for name, c, size in zip(fields, codes, sizes))
    head = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(rows), 33 + len(described), 1 + sum(sizes)) + described + b"\r"
    fit = lambda v, c, size: v[:size].rjust(size) if c in "NF" else v[:size].ljust(size)
    return head + b"".join(b" " + b"".join(fit(column[i], c, size) for column, c, size in zip(columns, codes, sizes)) for i in range(len(rows))) + b"\x1a"


def encode_index(shapes: bytes) -> bytes:
    """The .shx file of a .shp file."""
    records, at = b"", 100
    while at + 8 <= len(shapes):
        words = struct.unpack_from(">I", shapes, at + 4)[0]
        records += struct.pack(">II", at // 2, words)
        at += 8 + 2 * words
    return shapes[:24] + struct.pack(">I", (100 + len(records)) // 2) + shapes[28:100] + records


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """path (without suffix), feature, kind, rings and attributes (a map of texts; null without a .dbf file) of all shapefiles."""
    stem = lambda df: df.withColumn("path", F.regexp_replace("path", r"\.[^./]*$", ""))

    def run(batches):
        for df in batches:
            rows = [(p, i, values) for p, c in zip(df["path"], df["content"]) for i, values in enumerate(decode_attributes(c))]
            yield pd.DataFrame(rows, columns=["path", "feature", "attributes"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.dbf").load(path).select("path", "content")
    attributes = files.mapInPandas(run, "path string, feature int, attributes map<string,string>")
    return stem(read_shapes(spark, path)).join(stem(attributes), ["path", "feature"], "left")


def write_features(features: DataFrame, folder: str, by: str) -> DataFrame:
    """A shapefile (.shp, .shx, .dbf) of polygons for each value of `by`: name, features. Columns: by, rings (arrays of structs x,
    y), and attributes, in the order of rows' first corners. `folder` must be one that executors share; a group is one file,
    which its format holds as a whole."""
    kinds = {"bigint": "long", "int": "long", "smallint": "long", "double": "double", "float": "double", "boolean": "boolean", "date": "date"}
    fields = {f.name: kinds.get(f.dataType.simpleString(), "string") for f in features.schema if f.name not in (by, "rings")}

    def run(df: pd.DataFrame) -> pd.DataFrame:
        shapes = [[[(p["x"], p["y"]) for p in ring] for ring in rings] for rings in df["rings"]]
        order = sorted(range(len(df)), key=lambda i: shapes[i])
        rows = [tuple(None if pd.isna(v) else int(v) if k == "long" else v for v, k in zip(r, fields.values())) for r in df[list(fields)].itertuples(index=False)]
        shp = encode_polygons([shapes[i] for i in order])
        name = os.path.join(folder, str(df[by].iloc[0]))
        os.makedirs(os.path.dirname(name), exist_ok=True)
        for suffix, data in (("shp", shp), ("shx", encode_index(shp)), ("dbf", encode_attributes(fields, [rows[i] for i in order]))):
            with open(f"{name}.{suffix}.part", "wb") as f:
                f.write(data)
            os.replace(f"{name}.{suffix}.part", f"{name}.{suffix}")  # a task that runs again leaves whole files
        return pd.DataFrame({"name": [name], "features": [len(df)]})

    return features.groupBy(by).applyInPandas(run, "name string, features long")


def wkt(rings: Column) -> Column:
    """A polygon's well-known text from an array of rings."""
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(", ", F.transform(r, lambda p: F.concat(p.x.cast("string"), F.lit(" "), p.y.cast("string")))), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.concat_ws(", ", F.transform(rings, ring)), F.lit(")"))


def read_geojson(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """properties and geometry of the features of GeoJSON files."""
    schema = f"features array<struct<properties: {properties}, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def read_json(spark: SparkSession, path: str, schema: str | None = None, whole: bool = True) -> DataFrame:
    """JSON files, each one document (whole) or one to a line. Without a schema, Spark draws it from the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=whole)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """A document to a line."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str, append: bool = False) -> None:
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).mode("append" if append else "overwrite").save(path)


def zip_members(spark: SparkSession, path: str, suffix: str = "", first: bool = False) -> DataFrame:
    """path, member, content of the members of zip archives whose names end in `suffix`; first: one of each archive."""

    def run(batches):
        for df in batches:
            for p, c in zip(df["path"], df["content"]):
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    names = [n for n in z.namelist() if n.endswith(suffix) and not n.endswith("/")]
                    for name in names[:1] if first else names:
                        yield pd.DataFrame({"path": [p], "member": [name], "content": [z.read(name)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, member string, content binary")


def read_table(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Delimited text without header and types."""
    return spark.read.csv(path, sep=sep, header=False, inferSchema=False)


def write_table(df: DataFrame, path: str, sep: str = ";", append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, sep=sep)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").text(path)


def read_gcps(spark: SparkSession, path: str) -> DataFrame:
    """Control points x, y, xr, yr of tab-separated files."""
    return spark.read.csv(path, sep="\t", schema="x double, y double, xr double, yr double")


def write_gcps(df: DataFrame, path: str) -> None:
    df.select(F.format_string("%10.6f\t%10.6f\t%10.6f\t%10.6f", "x", "y", "xr", "yr").alias("value")).write.mode("overwrite").text(path)


def read_scenes(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Scene metadata of XML files."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
