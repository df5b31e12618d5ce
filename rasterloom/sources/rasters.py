"""Raster files as DataFrames, and back. Files are read with Spark's binary reader, one row of pixels to a record."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import codecs

META = "path string, width int, height int, count int, dtype string, nodata double, transform array<double>, epsg int"
LINES = "path string, band int, row int, values array<double>"


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")


def read_metadata(spark: SparkSession, path: str, glob: str = "*.tif*") -> DataFrame:
    """One row for each GeoTIFF."""

    def run(batches):
        for df in batches:
            rows = []
            for p, c in zip(df["path"], df["content"]):
                r = codecs.decode_tiff(c)
                rows.append((p, r.meta["width"], r.meta["height"], r.meta["count"], r.meta["dtype"], r.nodata, list(r.transform), r.meta["epsg"]))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "count", "dtype", "nodata", "transform", "epsg"]).astype({"epsg": "Int32"})

    return _files(spark, path, glob).mapInPandas(run, META)


def read_lines(spark: SparkSession, path: str, glob: str = "*.tif*", kind: str = "tiff") -> DataFrame:
    """Rows of pixels of GeoTIFF, PNG or NPY files: path, band (from 1), row, values."""
    decode = {"tiff": lambda c: codecs.decode_tiff(c).bands, "png": codecs.decode_png, "npy": lambda c: np.atleast_3d(codecs.decode_npy(c)).transpose(2, 0, 1) if codecs.decode_npy(c).ndim < 3 else codecs.decode_npy(c)}[kind]

    def run(batches):
        for df in batches:
            for p, c in zip(df["path"], df["content"]):
                for k, band in enumerate(decode(c), 1):
                    for start in range(0, len(band), 256):
                        part = band[start : start + 256].astype(float)
                        yield pd.DataFrame({"path": p, "band": k, "row": range(start, start + len(part)), "values": list(part)})

    return _files(spark, path, glob).mapInPandas(run, LINES)


def pixels(lines: DataFrame) -> DataFrame:
    """Lines in long form: path, band, row, col, v."""
    return lines.select("path", "band", "row", F.posexplode("values").alias("col", "v"))


def lines(px: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Long form as lines again, in the order of columns."""
    return px.groupBy(*by, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.col(value).cast("double").alias("v")))), lambda s: s.v).alias("values"))


def write_rasters(rows: DataFrame, folder: str, by: str, kind: str = "tiff", dtype: str = "uint8", transform: tuple = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), nodata: float | None = None, epsg: int | None = None) -> DataFrame:
    """A file for each value of `by` from lines (by, band, row, values): name, bytes. `folder` must be one that executors
    share. A group is one raster, which its file format holds as a whole."""
    suffix = {"tiff": "tif", "png": "png", "npy": "npy"}[kind]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["band", "row"])
        bands = np.array([np.vstack(g["values"].to_list()) for _, g in df.groupby("band")])
        bands = bands.astype(dtype) if dtype.startswith("float") else np.trunc(bands).astype(dtype)
        data = {"tiff": lambda: codecs.encode_tiff(codecs.Raster(bands, transform, nodata, {"epsg": epsg})), "png": lambda: codecs.encode_png(bands), "npy": lambda: codecs.encode_npy(bands)}[kind]()
        name = os.path.join(folder, f"{df[by].iloc[0]}.{suffix}")
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name + ".part", "wb") as f:
            f.write(data)
        os.replace(name + ".part", name)  # a task that runs again leaves a whole file
        return pd.DataFrame({"name": [name], "bytes": [len(data)]})

    return rows.groupBy(by).applyInPandas(run, "name string, bytes long")
