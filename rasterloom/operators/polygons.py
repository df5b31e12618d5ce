"""Polygons with holes as tables of edges: areas of intersections, masks, and unions by a field.

A polygon is a row (id, rings): rings of structs (x, y), the first the outer one, the others its holes, closed or not, in either
direction. Everything is worked out on edges, which are joined, folded and summed like other rows; what comes together in one row
is a ring at most, where the result holds it anyway.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rasterloom.operators.reprojection import Grid
from rasterloom.operators.spatial import box_join
from rasterloom.storage import checkpointed


def signed_area(ring: Column) -> Column:
    """Area of a ring of structs (x, y), positive if it runs counter-clockwise."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i).x * F.get(ring, F.pmod(i + 1, n)).y - F.get(ring, F.pmod(i + 1, n)).x * F.get(ring, i).y)
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def edges(polygons: DataFrame, *keys: str) -> DataFrame:
    """keys, x1, y1, x2, y2 of the edges, run so that the inside is to the left; edges without length are left out."""
    rings = polygons.where(F.size("rings") > 0).select(*keys, F.posexplode("rings").alias("__nth", "__ring")).where(F.size("__ring") > 2)
    rings = rings.withColumn("__turn", F.signum(signed_area(F.col("__ring"))) * F.when(F.col("__nth") == 0, 1).otherwise(-1))
    n = F.size("__ring")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(F.col("__ring"), i).alias("a"), F.get(F.col("__ring"), F.pmod(i + 1, n)).alias("b")))
    out = rings.select(*keys, "__turn", F.explode(pairs).alias("__e"))
    ahead = F.col("__turn") >= 0
    a, b = F.when(ahead, F.col("__e.a")).otherwise(F.col("__e.b")), F.when(ahead, F.col("__e.b")).otherwise(F.col("__e.a"))
    ends = out.select(*keys, a.alias("__a"), b.alias("__b"))
    return ends.select(*keys, *[F.col(f"{p}.{c}").cast("double").alias(f"{c}{i}") for i, p in ((1, "__a"), (2, "__b")) for c in "xy"]).where("x1 <> x2 or y1 <> y2")


def boxed(polygons: DataFrame, *others: str) -> DataFrame:
    """id and box of polygons, and other columns."""
    outer = F.get(F.col("rings"), 0)
    side = lambda f, c: f(F.transform(outer, lambda p: p[c].cast("double")))
    return polygons.select("id", side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax"), *others)


def slabs(lines: DataFrame, key: str, prefix: str, width: float) -> DataFrame:
    """Edges cut at the multiples of a width in x: key, slab, and with a prefix l, r (ends), yl, yr (there) and way (1 for upper edges,
    whose inside is below, -1 for lower ones). Vertical edges have no area below them."""
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    cut = lines.where("x1 <> x2").withColumn("slab", F.explode(F.sequence(F.floor(left / width), F.floor(right / width))))
    low, high = F.greatest(left, F.col("slab") * width), F.least(right, (F.col("slab") + 1) * width)
    at = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) * ((x - F.col("x1")) / (F.col("x2") - F.col("x1")))
    out = cut.select(F.col(key), "slab", low.alias(prefix + "l"), high.alias(prefix + "r"), at(low).alias(prefix + "yl"), at(high).alias(prefix + "yr"), F.when(F.col("x2") < F.col("x1"), 1).otherwise(-1).alias(prefix + "way"))
    return out.where(F.col(prefix + "l") < F.col(prefix + "r"))


class Line:
    """Ends and heights (l, r, yl, yr) of a piece of an edge, in columns of a prefix."""

    def __init__(self, prefix: str):
        self.l, self.r, self.yl, self.yr = (F.col(prefix + c) for c in ("l", "r", "yl", "yr"))


def below_both(a, b, floor: Column) -> Column:
    """Area under the lower of two lines (l, r, yl, yr), over the x that both have and above a floor; negative or null: none."""
    low, high = F.greatest(a.l, b.l), F.least(a.r, b.r)
    at = lambda p, x: p.yl + (p.yr - p.yl) * ((x - p.l) / (p.r - p.l)) - floor
    a1, a2, b1, b2 = at(a, low), at(a, high), at(b, low), at(b, high)
    d1, d2, wide = a1 - b1, a2 - b2, high - low
    t = F.try_divide(d1, d1 - d2)
    crossing = (F.least(a1, b1) + a1 + t * (a2 - a1)) * t + (F.least(a2, b2) + a1 + t * (a2 - a1)) * (1 - t)
    return F.when(high > low, wide / 2 * F.when((d1 <= 0) & (d2 <= 0), a1 + a2).when((d1 >= 0) & (d2 >= 0), b1 + b2).otherwise(crossing)).otherwise(0.0)


#: Points of a polygon up to which its edges go with it into a join.
FEW = 64


def pieces(rings: Column) -> Column:
    """Edges of a polygon that aren't vertical, as structs: ends l, r in x, heights yl, yr there, and way as in slabs()."""
    x, y = (lambda p: p.x.cast("double")), (lambda p: p.y.cast("double"))

    def turned(ring: Column, nth: Column) -> Column:
        return F.struct(ring.alias("ring"), (F.signum(signed_area(ring)) * F.when(nth == 0, 1).otherwise(-1) >= 0).alias("ahead"))

    def of_ring(t: Column) -> Column:
        n = F.size(t.ring)

        def piece(i: Column) -> Column:
            a, b = F.get(t.ring, i), F.get(t.ring, F.pmod(i + 1, n))
            back = x(b) < x(a)
            return F.struct(F.least(x(a), x(b)).alias("l"), F.greatest(x(a), x(b)).alias("r"), F.when(back, y(b)).otherwise(y(a)).alias("yl"), F.when(back, y(a)).otherwise(y(b)).alias("yr"), F.when(back == t.ahead, 1.0).otherwise(-1.0).alias("way"))

        return F.filter(F.transform(F.sequence(F.lit(0), n - 1), piece), lambda e: e.l < e.r)

    long = F.transform(F.transform(rings, turned), lambda t: F.when(F.size(t.ring) > 2, t))
    return F.flatten(F.transform(F.filter(long, lambda t: t.isNotNull()), of_ring))


def is_box(rings: Column) -> Column:
    """Whether a polygon is its own box: one ring, through the box's four corners alone (columns xmin to ymax)."""
    ring = F.transform(F.get(rings, 0), lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y")))
    corner = lambda p: ((p.x == F.col("xmin")) | (p.x == F.col("xmax"))) & ((p.y == F.col("ymin")) | (p.y == F.col("ymax")))
    return (F.size(rings) == 1) & F.size(ring).isin(4, 5) & (F.size(F.array_distinct(ring)) == 4) & F.forall(ring, corner)


def joint_area(a: Column, b: Column, floor: Column) -> Column:
    """Area that two polygons' pieces have in common, above a floor that neither goes below."""

    def both(p: Column, q: Column) -> Column:
        low, high = F.greatest(p.l, q.l), F.least(p.r, q.r)
        level = (p.yl == p.yr) & (q.yl == q.yr)
        return F.when(high <= low, 0.0).when(level, (high - low) * (F.least(p.yl, q.yl) - floor)).otherwise(below_both(p, q, floor))

    return F.aggregate(a, F.lit(0.0), lambda s, p: s + F.aggregate(b, F.lit(0.0), lambda t, q: t + p.way * q.way * both(p, q)))


def intersection_areas(a: DataFrame, b: DataFrame, cell: float, slab: float, touching: bool = False) -> DataFrame:
    """a_id, b_id and area of what polygons of two tables (id, rings) have in common, of pairs whose boxes have (or, with `touching`,
    that touch, too).

    A polygon is the sum of the areas below its upper edges less those below its lower ones, so what two polygons share is that of the
    areas below the lower of two edges, one of each, over all pairs of edges. Pairs of polygons come from cells of their boxes
    (`cell` wide), and polygons of up to FEW points bring their edges along, so that a pair's area is known where the pair is made (that
    of two boxes is their overlap's). Edges of larger ones are joined to the pairs by slabs of x (`slab` wide), which have few edges of
    a polygon each; neither width changes the result. Polygons of any shape with holes will do, if their rings don't cross.
    """
    points = F.aggregate(F.transform("rings", lambda r: F.size(r)), F.lit(0), lambda s, n: s + n)
    few, many = F.coalesce(points <= FEW, F.lit(True)), F.coalesce(points > FEW, F.lit(False))

    def with_pieces(t: DataFrame) -> DataFrame:
        placed = boxed(t, "rings")
        return placed.withColumn("pieces", F.when(~is_box(F.col("rings")), pieces(F.col("rings")))).drop("rings")

    def over(c: str) -> Column:
        return F.greatest(F.least(f"a_{c}max", f"b_{c}max") - F.greatest(f"a_{c}min", f"b_{c}min"), F.lit(0.0))

    def of_box(p: str) -> Column:
        side = lambda y, way: F.struct(F.col(p + "xmin").alias("l"), F.col(p + "xmax").alias("r"), F.col(p + y).alias("yl"), F.col(p + y).alias("yr"), F.lit(way).alias("way"))
        return F.coalesce(F.col(p + "pieces"), F.array(side("ymax", 1.0), side("ymin", -1.0)))

    near = box_join(with_pieces(a.where(few)), with_pieces(b.where(few)), cell, touching)
    boxes = F.col("a_pieces").isNull() & F.col("b_pieces").isNull()
    area = F.when(boxes, over("x") * over("y")).otherwise(joint_area(of_box("a_"), of_box("b_"), F.least("a_ymin", "b_ymin")))
    out = near.select("a_id", "b_id", F.greatest(area, F.lit(0.0)).alias("area"))
    for mine, theirs in ((a.where(many), b), (a.where(few), b.where(many))):
        if mine.isEmpty() or theirs.isEmpty():
            continue
        pairs = box_join(boxed(mine), boxed(theirs), cell, touching).select("a_id", "b_id", F.least("a_ymin", "b_ymin").alias("floor"))
        sides = [slabs(edges(t, "id"), "id", p, slab).withColumnRenamed("id", p + "_id") for t, p in ((mine, "a"), (theirs, "b"))]
        met = pairs.join(sides[0], "a_id").join(sides[1], ["b_id", "slab"])
        areas = met.groupBy("a_id", "b_id").agg(F.sum(F.col("away") * F.col("bway") * below_both(Line("a"), Line("b"), F.col("floor"))).alias("area"))
        out = out.unionByName(pairs.join(areas, ["a_id", "b_id"], "left").select("a_id", "b_id", F.greatest(F.coalesce("area", F.lit(0.0)), F.lit(0.0)).alias("area")))
    return out


#: Columns of a raster whose spans are merged in one group.
SPAN = 1024


def runs_of(polygons: DataFrame, grid: Grid) -> DataFrame:
    """id, row, first, last: the runs of columns whose centres each polygon (id, rings) covers.

    An edge crosses the scanlines (centres of rows) between its ends; along a scanline, the crossings of a polygon in order of x are by
    turns where it begins and where it ends, whatever the directions of its rings."""
    lines = edges(polygons, "id").where("y1 <> y2")
    place = lambda y: (F.lit(grid.uly) - y) / grid.yres - 0.5
    low, high = F.greatest(F.floor(place(F.greatest("y1", "y2"))), F.lit(0)), F.least(F.ceil(place(F.least("y1", "y2"))), F.lit(grid.height - 1))
    y = F.lit(grid.uly) - (F.col("row") + 0.5) * grid.yres
    crossed = lines.where(low <= high).withColumn("row", F.explode(F.sequence(low, high))).where((F.col("y1") > y) != (F.col("y2") > y))
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    order = Window.partitionBy("id", "row").orderBy("x")  # the edges of a polygon that cross one scanline
    turns = crossed.select("id", "row", x.alias("x")).select("id", "row", "x", F.lead("x").over(order).alias("end"), F.row_number().over(order).alias("nth")).where("nth % 2 = 1")
    column = lambda x: F.ceil((x - grid.ulx) / grid.xres - 0.5)
    return turns.select("id", "row", F.greatest(column(F.col("x")), F.lit(0)).alias("first"), F.least(column(F.col("end")) - 1, F.lit(grid.width - 1)).alias("last")).where("first <= last")


def spans(polygons: DataFrame, grid: Grid) -> DataFrame:
    """row, first, last: the runs of columns whose centres some polygon (id, rings) covers, without overlaps, cut at multiples of SPAN."""
    runs = runs_of(polygons, grid)
    cut = runs.withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN))))
    cut = cut.select("row", "part", F.greatest("first", F.col("part") * SPAN).alias("first"), F.least("last", F.col("part") * SPAN + SPAN - 1).alias("last"))
    cut = cut.groupBy("row", "part", "first").agg(F.max("last").alias("last"))  # SPAN rows of a part at most
    line = Window.partitionBy("row", "part").orderBy("first")
    before = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.withColumn("__new", F.when(F.col("first") <= before + 1, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("row", "part", "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("row", "first", "last")


def covered_cells(polygons: DataFrame, grid: Grid) -> DataFrame:
    """row, col of the pixels whose centre some polygon covers, each once."""
    return spans(polygons, grid).select("row", F.explode(F.sequence("first", "last")).alias("col"))


def burn_table(px: DataFrame, polygons: DataFrame, grid: Grid, inside: int = 0, outside: int = 1) -> DataFrame:
    """The raster with a mask: `inside` where some polygon of a table (id, rings) covers a pixel's centre. A point on an edge belongs to
    what is to its right or above it."""
    found = covered_cells(polygons, grid).withColumn("mask", F.lit(inside))
    return px.join(found, ["row", "col"], "left").withColumn("mask", F.coalesce("mask", F.lit(outside)))


#: Rows of a raster that are clipped in one group, with SPAN columns.
BAND = 16


def cells_under(ids: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, grid: Grid, band: range, part: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polygon, row and col of the cells of some rows and columns whose centres are within polygons, by all their edges (numbers ids) in
    these rows: as runs_of(), for a window."""
    rows = np.arange(max(band.start, 0), min(band.stop, grid.height))
    y = grid.uly - (rows + 0.5) * grid.yres
    edge, at = np.nonzero((y1[:, None] > y) != (y2[:, None] > y))
    x = (x2[edge] - x1[edge]) * (y[at] - y1[edge]) / (y2[edge] - y1[edge]) + x1[edge]
    order = np.lexsort((x, at, ids[edge]))
    of, at, x = ids[edge][order], at[order], x[order]
    # rings are closed, so crossings of a polygon and row come in pairs
    column = lambda v: np.ceil((v - grid.ulx) / grid.xres - 0.5)
    low, high = max(part.start, 0), min(part.stop, grid.width) - 1
    first, last = np.clip(column(x[0::2]), low, high + 1).astype(np.int64), np.clip(column(x[1::2]) - 1, low - 1, high).astype(np.int64)
    wide = np.maximum(last - first + 1, 0)
    step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    return np.repeat(of[0::2], wide), np.repeat(rows[at[0::2]], wide), np.repeat(first, wide) + step


def clip_by_table(px: DataFrame, polygons: DataFrame, grid: Grid) -> DataFrame:
    """The raster (row, col, ...) under each polygon of a table (id, rings): a row for each polygon that covers a pixel's centre.

    Edges go to the bands of rows that they cross, in each part that their polygon's box has, and meet the pixels there, so neither
    runs nor cells of polygons are rows before the result."""
    placed = edges(boxed(polygons, "rings"), "id", "xmin", "xmax").where("y1 <> y2")
    place = lambda y: (F.lit(grid.uly) - y) / grid.yres - 0.5
    low, high = F.greatest(F.floor(place(F.greatest("y1", "y2"))), F.lit(0)), F.least(F.ceil(place(F.least("y1", "y2"))), F.lit(grid.height - 1))
    banded = placed.where(low <= high).withColumn("__band", F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND))))
    column = lambda c: (F.col(c) - grid.ulx) / grid.xres
    left, right = F.greatest(F.floor(column("xmin")), F.lit(0)), F.least(F.floor(column("xmax")), F.lit(grid.width - 1))
    parted = banded.where(left <= right).withColumn("__part", F.explode(F.sequence(F.floor(left / SPAN), F.floor(right / SPAN)))).drop("xmin", "xmax")
    inside = F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)
    cells = px.where(inside).withColumns({"__band": F.floor(F.col("row") / BAND), "__part": F.floor(F.col("col") / SPAN)})
    names, tall, wide = px.columns, BAND, SPAN

    def clip(pixels: pa.Table, lines: pa.Table) -> pa.Table:
        coded = lines.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
        number = lambda t, c: t.column(c).to_numpy()
        if not (pixels.num_rows and lines.num_rows):
            return pixels.select(names).slice(0, 0).append_column("id", coded.dictionary.slice(0, 0))
        of, row, col = cells_under(coded.indices.to_numpy(zero_copy_only=False), *[number(lines, c) for c in ("x1", "y1", "x2", "y2")], grid, *[range(k * n, k * n + n) for k, n in ((int(number(pixels, "__band")[0]), tall), (int(number(pixels, "__part")[0]), wide))])
        code = number(pixels, "row").astype(np.int64) * grid.width + number(pixels, "col").astype(np.int64)
        order = np.argsort(code, kind="stable")
        asked, code = row * grid.width + col, code[order]
        begin = np.searchsorted(code, asked, "left")
        n = np.searchsorted(code, asked, "right") - begin
        take = order[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return pixels.select(names).take(pa.array(take)).append_column("id", coded.dictionary.take(pa.array(np.repeat(of, n))))

    schema = StructType([*px.schema.fields, StructField("id", polygons.schema["id"].dataType)])
    return cells.groupBy("__band", "__part").cogroup(parted.groupBy("__band", "__part")).applyInArrow(clip, schema)


def gml_polygons(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """id (position in the text), rings and other columns of the polygons of GML texts: positions `x y x y ...`, the first list of a
    polygon its outer ring. A text without polygons gives no rows."""
    found = texts.select("*", F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)(<(?:\w+:)?Polygon\b.*?</(?:\w+:)?Polygon>)"), 1)).alias("id", "__polygon")).drop(xml)
    lists = F.regexp_extract_all("__polygon", F.lit(r"(?s)<(?:\w+:)?posList\b[^>]*>\s*(.*?)\s*</"), 1)
    dimension = F.coalesce(F.nullif(F.regexp_extract("__polygon", r'srsDimension="(\d)"', 1), F.lit("")).cast("int"), F.lit(2))

    def ring(text: Column) -> Column:
        v = F.transform(F.split(text, r"\s+"), lambda s: s.cast("double"))
        return F.transform(F.sequence(F.lit(0), (F.size(v) / dimension - 1).cast("int")), lambda i: F.struct(F.get(v, i * dimension).alias("x"), F.get(v, i * dimension + 1).alias("y")))

    return found.withColumn("rings", F.transform(lists, ring)).drop("__polygon")


# unions by a field


def boundary(polygons: DataFrame, field: str) -> DataFrame:
    """field, x1, y1, x2, y2: edges of polygons (field, rings) that no polygon of the same field has on the other side."""
    lines = edges(polygons, field)
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    folded = lines.groupBy(field, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(F.when(a < b, 1).otherwise(0)).alias("up"), F.max(F.when(a < b, 0).otherwise(1)).alias("down"))
    left = folded.where("up <> down")  # copies of a polygon count once
    start, end = F.when(F.col("up") == 1, F.col("a")).otherwise(F.col("b")), F.when(F.col("up") == 1, F.col("b")).otherwise(F.col("a"))
    return left.select(field, start.alias("s"), end.alias("e")).select(field, F.col("s.x").alias("x1"), F.col("s.y").alias("y1"), F.col("e.x").alias("x2"), F.col("e.y").alias("y2"))


def followed(lines: DataFrame, field: str) -> DataFrame:
    """Edges with an id and that of the next edge of their ring (after). Where several begin, a ring turns left as far as it can, so
    that shapes which touch at a corner alone aren't joined there."""
    known = checkpointed(lines.withColumn("id", F.monotonically_increasing_id()))
    begins = known.select(field, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("id").alias("next"))
    ax, ay, bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    met = known.join(begins, [field, "x2", "y2"]).groupBy("id").agg(F.max_by("next", turn).alias("after"))
    return known.join(met, "id")


def ranked(chain: DataFrame) -> DataFrame:
    """ring (least id of the ring) and place (from 0, from that id on) of each id of a chain (id, after) of rings.

    Each id knows the least id of as many as it has looked at, itself included, how far that is, and which comes after it. That
    number is doubled in each round, so rounds grow with the logarithm of a ring's length. A ring is done when the id after its
    least one sees that one around the ring; short rings don't take part in the rounds of long ones."""
    state = checkpointed(chain.select("id", "after", F.struct(F.col("id").alias("ring"), F.lit(0).cast("long").alias("far"), F.col("after").alias("second")).alias("best")))
    out, reach, turn = None, 1, 0
    while True:
        far = state.select(F.col("id").alias("after"), F.col("after").alias("further"), F.col("best").alias("theirs"))
        passed = F.struct(F.col("theirs.ring").alias("ring"), (F.col("theirs.far") + reach).alias("far"), F.col("theirs.second").alias("second"))
        state = checkpointed(state.join(far, "after").select("id", F.col("further").alias("after"), F.when(F.col("theirs.ring") < F.col("best.ring"), passed).otherwise(F.col("best")).alias("best")))
        reach, turn = reach * 2, turn + 1
        if turn % 3:
            continue
        closed = state.where(F.col("id") == F.col("best.second")).select(F.col("best.ring").alias("ring"), (F.col("best.far") + 1).alias("size"))
        marked = checkpointed(state.withColumn("ring", F.col("best.ring")).join(closed, "ring", "left"))
        done = marked.where("size is not null").select("id", "ring", F.when(F.col("best.far") == 0, 0).otherwise(F.col("size") - F.col("best.far")).alias("place"))
        out = done if out is None else out.unionByName(done)
        state = marked.where("size is null").select("id", "after", "best")
        if state.isEmpty():
            return out


def ring_text(points: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", F.transform(F.concat(points, F.slice(points, 1, 1)), lambda p: F.concat(p.x.cast("string"), F.lit(" "), p.y.cast("string")))), F.lit(")"))


def without_straights(points: Column) -> Column:
    """Points of a ring at which it turns."""
    n = F.size(points)

    def turns(p: Column, i: Column) -> Column:
        a, b = F.get(points, F.pmod(i - 1, n)), F.get(points, F.pmod(i + 1, n))
        return (p.x - a.x) * (b.y - p.y) != (p.y - a.y) * (b.x - p.x)

    return F.filter(points, turns)


def owners_of(lines: DataFrame, holes: DataFrame) -> DataFrame:
    """hole and ring (the shell around it) of the rings that are holes, by the edges (__key, ring, x1, y1, x2, y2) of all rings.

    To the left of a hole's leftmost corner is the part that it lies in, up to the first edge there, which belongs to that part's
    shell or to a hole of it further to the left; so holes are followed from one to the next. An edge stands in the cells that
    it crosses; a corner looks in its own cell and the one to the left, and where these have no edge that is certain to be the
    first, in cells four times as wide. Only edges move, never a ring.
    """
    mine = lines.join(holes, "ring").select("__key", "ring", *[F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")).alias(f"p{i}") for i in (1, 2)])
    # whether the hole goes up from its first corner, or down only
    ends = mine.select("__key", "ring", F.explode(F.array(*[F.struct(F.col(f"p{i}").alias("at"), (F.col(f"p{3 - i}.y") > F.col(f"p{i}.y")).alias("up")) for i in (1, 2)])).alias("e"))
    first = ends.groupBy("__key", "ring").agg(F.max_by("e", F.struct(-F.col("e.at.x"), -F.col("e.at.y"), F.col("e.up"))).alias("e"))
    left = checkpointed(first.select("__key", F.col("ring").alias("hole"), F.col("e.at.x").alias("x"), F.col("e.at.y").alias("y"), F.col("e.up").alias("up")))
    steep = lines.where("y1 <> y2")
    size, low, high = steep.agg(F.avg(F.abs(F.col("y2") - F.col("y1"))), F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2"))).first()
    tall = wide = 2.0 ** math.ceil(math.log2(size))
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    at = lambda y: F.when(y == F.col("y1"), F.col("x1")).when(y == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (y - F.col("y1")) * slope)
    banded = steep.withColumn("__cy", F.explode(F.sequence(F.floor(bottom / tall), F.floor(top / tall))))
    ends_x = [at(F.greatest(bottom, F.col("__cy") * tall)), at(F.least(top, (F.col("__cy") + 1) * tall))]
    banded = checkpointed(banded.select("__key", "__cy", F.col("ring").alias("hit"), bottom.alias("bottom"), top.alias("top"), "x1", "y1", "x2", "y2", F.least(*ends_x).alias("from"), F.greatest(*ends_x).alias("to")))
    hits = None
    while True:
        cell = lambda c, wide=wide: F.floor(F.col(c) / wide)
        stood = banded.withColumn("__cx", F.explode(F.sequence(cell("from"), cell("to"))))
        asked = left.withColumns({"__cy": F.floor(F.col("y") / tall), "own": cell("x")}).withColumn("__cx", F.explode(F.array(F.col("own") - 1, F.col("own"))))
        near = asked.join(stood, ["__key", "__cy", "__cx"]).where(F.when(F.col("up"), (F.col("bottom") <= F.col("y")) & (F.col("y") < F.col("top"))).otherwise((F.col("bottom") < F.col("y")) & (F.col("y") <= F.col("top"))))
        near = near.select("hole", "hit", "own", F.col("x").alias("mine"), at(F.col("y")).alias("x"), F.when(F.col("up"), slope).otherwise(-slope).alias("lean")).where("x < mine")
        last = wide > high - low
        nearest = near.groupBy("hole").agg(F.max_by("hit", F.struct("x", "lean")).alias("hit"), F.max("x").alias("x"), F.first("own").alias("own"))
        if not last:
            nearest = nearest.where(F.col("x") >= (F.col("own") - 1) * wide)
        nearest = checkpointed(nearest.select("hole", "hit"))
        hits = nearest if hits is None else hits.unionByName(nearest)
        if last:
            break
        left = checkpointed(left.join(nearest, "hole", "left_anti"))
        if left.isEmpty():
            break
        wide *= 4
    # from hole to hole, twice as far each time, up to a shell
    while True:
        step = hits.join(hits.select(F.col("hole").alias("hit"), F.col("hit").alias("further")), "hit", "left")
        moved = checkpointed(step.select("hole", F.coalesce("further", "hit").alias("hit"), F.col("further").isNotNull().alias("moved")))
        hits = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return hits.select("hole", F.col("hit").alias("ring"))


def dissolve_polygons(polygons: DataFrame, field: str) -> DataFrame:
    """The union of polygons (field, rings) that share a field, a row for each of its parts: field, area, holes, xmin, ymin, xmax, ymax
    and outline in WKT with its holes.

    Polygons of a field meet in whole edges or not at all, as cells, parcels and other coverages do; copies count once. Edges that two
    of them share cancel in one grouping; what is left is followed from edge to edge, ring by ring, over all partitions, and
    holes are laid to the part around them by the edges to their left. Null is a field of its own.
    """
    null_safe = polygons.select(F.to_json(F.struct(F.col(field).alias("f"))).alias("__key"), F.col(field).alias("__field"), "rings")
    names = null_safe.groupBy("__key").agg(F.first("__field").alias(field))
    lines = checkpointed(followed(boundary(null_safe.select("__key", "rings"), "__key"), "__key"))
    placed = checkpointed(lines.join(ranked(lines.select("id", "after")), "id").select("__key", "ring", "place", "x1", "y1", "x2", "y2"))
    corner = F.struct("place", F.col("x1").alias("x"), F.col("y1").alias("y"))
    rings = placed.groupBy("__key", "ring").agg(F.transform(F.array_sort(F.collect_list(corner)), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("points"), (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))
    rings = checkpointed(rings.withColumn("points", without_straights(F.col("points"))))
    side = lambda f, c: f(F.transform("points", lambda p: p[c]))
    shells = rings.where("area > 0").select("__key", "ring", "area", "points", side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax"))
    holes = rings.where("area < 0").select(F.col("ring").alias("hole"), F.col("area").alias("minus"), ring_text(F.col("points")).alias("text"))
    if holes.isEmpty():
        found = shells.withColumns({"holes": F.lit(0).cast("long"), "minus": F.lit(0.0), "inner": F.array().cast("array<string>")})
    else:
        owners = owners_of(placed, rings.where("area < 0").select("ring"))
        inner = holes.join(owners, "hole").groupBy("ring").agg(F.count("*").alias("holes"), F.sum("minus").alias("minus"), F.array_sort(F.collect_list("text")).alias("inner"))
        none = F.array().cast("array<string>")
        found = shells.join(inner, "ring", "left").withColumns({"holes": F.coalesce("holes", F.lit(0)), "minus": F.coalesce("minus", F.lit(0.0)), "inner": F.coalesce("inner", none)})
    wkt = F.concat(F.lit("POLYGON ("), F.concat_ws(", ", F.concat(F.array(ring_text(F.col("points"))), F.col("inner"))), F.lit(")"))
    return found.join(names, "__key").select(field, (F.col("area") + F.col("minus")).alias("area"), "holes", "xmin", "ymin", "xmax", "ymax", wkt.alias("wkt"))
