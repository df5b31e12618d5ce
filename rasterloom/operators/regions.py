"""Connected regions of cells and their outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.grids import in_windows
from rasterloom.storage import checkpointed


def label_cells(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Component (4-connected) of each cell: the least place of a cell in it, by repeated minima and pointer jumping."""
    place = {(r, c): i for i, (r, c) in enumerate(zip(rows.tolist(), cols.tolist()))}
    a, b = [], []
    for (r, c), i in place.items():
        for step in ((r, c + 1), (r + 1, c)):
            if (j := place.get(step)) is not None:
                a.append(i), b.append(j)
    a, b, label = np.array(a, np.int64), np.array(b, np.int64), np.arange(len(rows))
    while True:
        before = label.copy()
        if len(a):
            least = np.minimum(label[a], label[b])
            for end in (a, b):
                np.minimum.at(label, label[end], least)
        label = label[label]
        if (label == before).all():
            return label


#: Sides of a cell, clockwise from the top: the neighbour beyond, and where the side starts and leads to, as (row, col) steps and
#: corner points (x, y) from the cell's own.
SIDES = [((-1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0))]


def rings(starts: list[tuple[int, int]], ends: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Rings of the directed sides of a region's cells (the cells are to the right), the outer one first, then its holes. Where
    four sides meet, a ring turns right, so that cells which touch at a corner alone aren't joined there."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for start, end in zip(starts, ends):
        after.setdefault(start, []).append(end)
    found = []
    for first in sorted(after, key=lambda p: (p[1], p[0])):
        while after[first]:
            to = min(after[first])
            after[first].remove(to)
            ring, at, step = [first], to, (to[0] - first[0], to[1] - first[1])
            while at != first:
                right, left = (-step[1], step[0]), (step[1], -step[0])
                turn = next(t for t in (right, step, left) if (at[0] + t[0], at[1] + t[1]) in after[at])
                to = (at[0] + turn[0], at[1] + turn[1])
                after[at].remove(to)
                if turn != step:
                    ring.append(at)
                at, step = to, turn
            found.append([*ring, first])
    area = lambda r: sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:]))
    return sorted(found, key=lambda r: area(r) < 0)


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id that links a, b reach) of every id of the links, by minima over neighbours and jumps to
    the label's own label; the number of rounds grows with the logarithm of a component's length, but for odd shapes."""
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        after = labels.join(near, "id").join(jump, "component").select("id", F.least("component", "m", "up").alias("component"), F.col("component").alias("before"))
        after = checkpointed(after)
        labels = after.select("id", "component")
        if after.where("component < before").isEmpty():
            return labels


def labelled(px: DataFrame, wanted: Column, window: int) -> DataFrame:
    """row, col, region and sides of every wanted cell. region: row and column of its first cell in one number (row * 2**32 + col);
    sides: bits of the sides beyond which no wanted cell lies. Cells are labelled within windows, and labels that meet at an
    edge of windows are made one."""
    cells = in_windows(px.where(wanted).select("row", "col"), window)

    def find(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["row", "col"]).reset_index(drop=True)
        label = label_cells(df["row"].to_numpy(), df["col"].to_numpy())
        code = df["row"].to_numpy(np.int64) * 2**32 + df["col"].to_numpy(np.int64)
        sides = sum((~np.isin(code + (r * 2**32 + c), code)).astype(np.int32) << i for i, ((r, c), _, _) in enumerate(SIDES))
        return pd.DataFrame({"row": df["row"], "col": df["col"], "piece": code[label], "sides": sides})

    pieces = checkpointed(cells.groupBy("win_row", "win_col").applyInPandas(find, "row long, col long, piece long, sides int"))
    # cells at a window's edge and their neighbours beyond it
    beyond = F.array(*[F.struct(F.lit(1 << i).alias("side"), (F.col("row") + r).alias("r"), (F.col("col") + c).alias("c")) for i, ((r, c), _, _) in enumerate(SIDES)])
    at_edge = F.pmod("row", F.lit(window)).isin(0, window - 1) | F.pmod("col", F.lit(window)).isin(0, window - 1)
    edge = pieces.where(at_edge)
    asked = edge.select("row", "col", "piece", "sides", F.explode(beyond).alias("n")).where(F.col("sides").bitwiseAND(F.col("n.side")) > 0)
    met = checkpointed(asked.select("row", "col", "piece", "n.side", "n.r", "n.c").join(edge.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("piece").alias("other")), ["r", "c"]))
    if met.isEmpty():
        return pieces.withColumnRenamed("piece", "region")
    whole = components(met.select(F.col("piece").alias("a"), F.col("other").alias("b")).where("a <> b").distinct())
    closed = met.groupBy("row", "col").agg(F.sum("side").cast("int").alias("closed"))
    out = pieces.join(whole.withColumnRenamed("id", "piece"), "piece", "left").join(closed, ["row", "col"], "left")
    return out.select("row", "col", F.coalesce("component", "piece").alias("region"), (F.col("sides") - F.coalesce("closed", F.lit(0))).alias("sides"))


def measured(cells: DataFrame) -> DataFrame:
    """region, cells and box of the regions of labelled cells; nothing of a region comes together."""
    return cells.groupBy("region").agg(F.count("*").alias("cells"), F.min("col").alias("xmin"), F.min("row").alias("ymin"), (F.max("col") + 1).alias("xmax"), (F.max("row") + 1).alias("ymax"))


#: Row and column of a region's first cell.
FIRST = ["region div 4294967296L AS row", "region % 4294967296L AS col"]


def region_sizes(px: DataFrame, wanted: Column, window: int = 1024) -> DataFrame:
    """What regions() gives, but for the outlines, which needn't be drawn then."""
    return measured(labelled(px, wanted, window)).selectExpr(*FIRST, "cells", "xmin", "ymin", "xmax", "ymax")


def regions(px: DataFrame, wanted: Column, window: int = 1024) -> DataFrame:
    """Regions (4-connected) of wanted cells, over the whole raster: row and col of the first cell, cells, box, and outline in WKT
    with its holes.

    A task labels one window at a time. Of a region, only the sides of its outline come together, which is what its row holds.
    """
    cells = labelled(px, wanted, window)

    def draw(df: pd.DataFrame) -> pd.DataFrame:
        starts, ends = [], []
        for row, col, sides in zip(df["row"].tolist(), df["col"].tolist(), df["sides"].tolist()):
            for i, (_, (x1, y1), (x2, y2)) in enumerate(SIDES):
                if sides >> i & 1:
                    starts.append((col + x1, row + y1)), ends.append((col + x2, row + y2))
        text = ", ".join("(" + ", ".join(f"{x} {y}" for x, y in ring) + ")" for ring in rings(starts, ends))
        return pd.DataFrame({"region": [df["region"].iloc[0]], "wkt": [f"POLYGON ({text})"]})

    drawn = cells.where("sides > 0").groupBy("region").applyInPandas(draw, "region long, wkt string")
    return measured(cells).join(drawn, "region").selectExpr(*FIRST, "cells", "xmin", "ymin", "xmax", "ymax", "wkt")


def sieve(found: DataFrame, least: int = 10) -> DataFrame:
    return found.where(F.col("cells") >= least)


def footprint(px: DataFrame, valid: Column) -> DataFrame:
    """Box of the valid cells."""
    return px.where(valid).agg(F.min("col").alias("xmin"), F.min("row").alias("ymin"), (F.max("col") + 1).alias("xmax"), (F.max("row") + 1).alias("ymax"))


def dissolve(cells: DataFrame, field: str) -> DataFrame:
    """Cells (row, col) that share a field, made distinct, as one shape each: field, cells and area box."""
    return cells.select(field, "row", "col").distinct().groupBy(field).agg(F.count("*").alias("cells"), F.min("col").alias("xmin"), F.min("row").alias("ymin"), (F.max("col") + 1).alias("xmax"), (F.max("row") + 1).alias("ymax"))


def parts(features: DataFrame, rings: str = "rings") -> DataFrame:
    """A row for each part of features of several parts, numbered."""
    return features.select("*", F.posexplode(rings).alias("part", "ring")).drop(rings)
