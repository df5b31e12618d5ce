"""Operations on rasters in long form (row, col, value): masks, clips, mosaics, resampling, pyramids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.geometry import in_polygon

CELL = ["row", "col"]


def apply_mask(px: DataFrame, mask: DataFrame, value: str = "v", masked: int = 0, fill: float = 0) -> DataFrame:
    """Fills pixels where the mask (row, col, mask) has the masked value."""
    return px.join(mask.select(*CELL, "mask"), CELL).withColumn(value, F.when(F.col("mask") == masked, fill).otherwise(F.col(value))).drop("mask")


def clip(px: DataFrame, x: Column, y: Column, ring: list[tuple[float, float]], value: str = "v", nodata: float = 0, crop: bool = True) -> DataFrame:
    """Keeps pixels whose centre is in a polygon; outside is nodata. crop: to the polygon's box, whose test is pushed to the scan."""
    xs, ys = zip(*ring)
    boxed = px.where(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))) if crop else px
    return boxed.withColumn(value, F.when(in_polygon(x, y, ring), F.col(value)).otherwise(nodata))


def burn(cells: DataFrame, x: Column, y: Column, rings: list[list[tuple[float, float]]], inside: int = 0, outside: int = 1) -> DataFrame:
    """A mask of cells: `inside` where some polygon covers the centre."""
    covered = F.lit(False)
    for ring in rings:
        covered = covered | in_polygon(x, y, ring)
    return cells.withColumn("mask", F.when(covered, inside).otherwise(outside))


def row_fill(px: DataFrame, valid: Column, by: list[str] = ()) -> DataFrame:
    """1 from the first valid column of a row up to (not with) the last, and where a pixel is valid."""
    rows = Window.partitionBy(*by, "row")
    first, last = (f(F.when(valid, F.col("col"))).over(rows) for f in (F.min, F.max))
    inside = (F.col("col") >= first) & (F.col("col") < last)
    return px.withColumn("filled", F.when(valid | F.coalesce(inside, F.lit(False)), 1).otherwise(0))


def mosaic(px: DataFrame, value: str, order: str, how: str = "first", nodata: float | None = None, cell: list[str] = CELL) -> DataFrame:
    """One value for each cell of overlapping datasets, which are ordered by a unique column.

    first: the first value that isn't nodata. last: the last, whatever it is. fill: as first, if there is a nodata, else last.
    The choice is an aggregate, so overlaps are folded before the shuffle.
    """
    good = F.col(value) if nodata is None else F.when(F.col(value) != nodata, F.col(value))
    if how == "last" or (how == "fill" and nodata is None):
        chosen = F.max_by(F.col(value), F.col(order))
    elif how in ("first", "fill"):
        chosen = F.min_by(good, F.when(good.isNotNull(), F.col(order)))
        chosen = chosen if nodata is None else F.coalesce(chosen, F.lit(nodata))
    else:
        raise ValueError("how must be first, last or fill")
    return px.groupBy(*cell).agg(chosen.alias(value))


def points_to_grid(points: DataFrame, left: float, top: float, cols: int, rows: int, res: float, fill: float = -1.0, order: str = "id") -> DataFrame:
    """Points (x, y, z) in a grid; the last by `order` wins, other cells are filled. A point on the lower or right edge is in the last cell."""
    row = F.least(F.floor((top - F.col("y")) / res), F.lit(rows - 1)).cast("int")
    col = F.least(F.floor((F.col("x") - left) / res), F.lit(cols - 1)).cast("int")
    inside = points.where((F.col("x") >= left) & (F.col("x") <= left + cols * res) & (F.col("y") <= top) & (F.col("y") >= top - rows * res))
    won = inside.select(row.alias("row"), col.alias("col"), "z", order).groupBy("row", "col").agg(F.max_by("z", order).alias("v"))
    spark = points.sparkSession
    grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return grid.join(won, CELL, "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def antimeridian_parts(points: DataFrame, x: str = "x") -> DataFrame:
    """Part 1 (east) and 2 (west) of points that span more than 180 degrees, else part 0; at 0 degrees a point is in the east."""
    span = points.agg((F.max(x) - F.min(x)).alias("__span"))
    return points.crossJoin(F.broadcast(span)).withColumn("part", F.when(F.col("__span") <= 180, 0).when(F.col(x) >= 0, 1).otherwise(2)).drop("__span")


def resample(px: DataFrame, value: str, factor: int, method: str = "average") -> DataFrame:
    """A raster at a `factor` times coarser resolution: nearest (the centre's pixel), average, min, max, mode (least of ties), med, q1, q3, sum."""
    coarse = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in CELL]
    if method == "nearest":
        half = factor // 2
        return px.where((F.col("row") % factor == half) & (F.col("col") % factor == half)).select(*coarse, value)
    cells = px.select(*coarse, value)
    simple = {"average": F.avg(value), "min": F.min(value), "max": F.max(value), "sum": F.sum(value), "rms": F.sqrt(F.avg(F.col(value) * F.col(value)))}
    if method in simple:
        return cells.groupBy(*CELL).agg(simple[method].alias(value))
    if method == "mode":
        counts = cells.groupBy(*CELL, value).agg(F.count("*").alias("n"))
        return counts.groupBy(*CELL).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))
    share = {"q1": 0.25, "med": 0.5, "q3": 0.75}[method]
    return cells.groupBy(*CELL).agg(F.percentile(value, share).alias(value))


def refine(px: DataFrame, factor: int) -> DataFrame:
    """A raster at a `factor` times finer resolution, by the nearest pixel: each pixel is repeated, nothing is joined."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = px.withColumn("__r", F.explode(steps)).withColumn("__c", F.explode(steps))
    return out.withColumn("row", F.col("row") * factor + F.col("__r")).withColumn("col", F.col("col") * factor + F.col("__c")).drop("__r", "__c")


def bilinear_resample(px: DataFrame, value: str, targets: DataFrame) -> DataFrame:
    """Values at fractional places (id, r, c) from the four pixels around; places beyond the last pixel use it."""
    t = targets.select("id", F.floor("r").alias("r0"), F.floor("c").alias("c0"), (F.col("r") - F.floor("r")).alias("fr"), (F.col("c") - F.floor("c")).alias("fc"))
    corners = F.array(*[F.struct((F.col("r0") + i).alias("row"), (F.col("c0") + j).alias("col"), ((F.col("fr") if i else 1 - F.col("fr")) * (F.col("fc") if j else 1 - F.col("fc"))).alias("w")) for i in (0, 1) for j in (0, 1)])
    wanted = t.select("id", F.explode(corners).alias("k")).select("id", "k.row", "k.col", "k.w").where("w > 0")
    return wanted.join(px.select(*CELL, F.col(value).alias("v")), CELL).groupBy("id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))


def kernel_weight(t: Column, kind: str) -> Column:
    """Weight of a pixel at a distance t in pixels: cubic (reach 2), cubicspline (reach 2) or lanczos (reach 3)."""
    a = F.abs(t)
    if kind == "cubic":
        near, far = 1.5 * a * a * a - 2.5 * a * a + 1, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2
        return F.when(a < 1, near).when(a < 2, far).otherwise(0.0)
    if kind == "cubicspline":
        return F.when(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)
    if kind == "lanczos":
        pi = 3.141592653589793
        return F.when(a == 0, 1.0).when(a < 3, F.try_divide(3 * F.sin(pi * a) * F.sin(pi * a / 3), pi * pi * a * a)).otherwise(0.0)
    raise ValueError("kind must be cubic, cubicspline or lanczos")


def kernel_resample(px: DataFrame, value: str, targets: DataFrame, kind: str = "cubic") -> DataFrame:
    """Values at fractional places (id, r, c) by a kernel over the pixels around; weights are normalised over those there are."""
    reach = 3 if kind == "lanczos" else 2
    steps = F.sequence(F.lit(1 - reach), F.lit(reach))
    t = targets.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    row, col = F.floor("r") + F.col("__i"), F.floor("c") + F.col("__j")
    wanted = t.select("id", row.alias("row"), col.alias("col"), (kernel_weight(F.col("r") - row, kind) * kernel_weight(F.col("c") - col, kind)).alias("w"))
    joined = wanted.join(px.select(*CELL, F.col(value).alias("v")), CELL)
    return joined.groupBy("id").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("value"))


def smoothed(cells: DataFrame, x: str, y: str, value: str, sigma: float = 1.3) -> DataFrame:
    """Gaussian smoothing of sparse cells: each is spread over its neighbourhood, and what arrives is summed."""
    reach = int(4 * sigma + 0.5)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    line = lambda d: F.exp(-0.5 * (d / sigma) * (d / sigma))
    total = F.aggregate(F.transform(steps, lambda d: line(d.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    spread = cells.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    w = line(F.col("__i").cast("double")) * line(F.col("__j").cast("double")) / (total * total)
    return spread.select((F.col(x) + F.col("__i")).alias(x), (F.col(y) + F.col("__j")).alias(y), (F.col(value) * w).alias(value)).groupBy(x, y).agg(F.sum(value).alias(value))


def pyramid(px: DataFrame, value: str, levels: int) -> DataFrame:
    """Levels 1..levels of 2 x 2 means (of the pixels there are), each from the one before: level, row, col, value."""
    out, level = None, px.select(*CELL, F.col(value).cast("double").alias(value))
    for k in range(1, levels + 1):
        level = level.groupBy(F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.avg(value).alias(value))
        named = level.select(F.lit(k).alias("level"), *CELL, value)
        out = named if out is None else out.unionByName(named)
    return out


def tile_pyramid(tiles: DataFrame, low: int) -> DataFrame:
    """All tiles (tz, tx, ty) from a base zoom down to `low`: a parent wherever it has a child."""
    ups = tiles.select("tx", "ty", F.explode(F.sequence(F.lit(0), F.col("tz") - low)).alias("up"), "tz")
    scale = F.pow(F.lit(2.0), F.col("up"))
    return ups.select((F.col("tz") - F.col("up")).alias("tz"), F.floor(F.col("tx") / scale).cast("int").alias("tx"), F.floor(F.col("ty") / scale).cast("int").alias("ty")).distinct()


def year_difference(stack: DataFrame, key: str, value: str, this: Column, last: Column, nodata: float = -3000, missing: float = -999) -> DataFrame:
    """Difference (times 1e-4) and relative change of this year's and last year's values; what can't be computed is `missing`."""
    good = F.when(F.col(value) != nodata, F.col(value))
    t = stack.where(this).select(key, good.alias("t"))
    b = stack.where(last).select(key, good.alias("l"))
    return t.join(b, key).select(key, F.coalesce((F.col("t") - F.col("l")) * 1e-4, F.lit(missing)).alias("diff"), F.coalesce(F.try_divide(F.col("t") - F.col("l"), F.col("l")), F.lit(missing)).alias("change"))


def temporal_mean(stack: DataFrame, cell: list[str], value: str, nodata: float) -> DataFrame:
    return stack.groupBy(*cell).agg(F.avg(F.when(F.col(value) != nodata, F.col(value))).alias(value))


def destripe(px: DataFrame, value: str, first: int, n: int) -> DataFrame:
    """Rows first..first+n-1 anew, by integer steps between the rows around them."""
    low, high = first - 1, first + n
    ends = px.where(F.col("row").isin(low, high)).groupBy("col").agg(F.max(F.when(F.col("row") == low, F.col(value))).alias("__a"), F.max(F.when(F.col("row") == high, F.col(value))).alias("__d"))
    joined = px.join(ends, "col", "left")
    step = F.floor((F.col("__d") - F.col("__a")) / (n + 1))
    new = F.col("__a") + step * (F.col("row") - low)
    return joined.withColumn(value, F.when(F.col("row").between(first, first + n - 1), new).otherwise(F.col(value))).drop("__a", "__d")


def mercator_rows(height: int, south: float, north: float, row: Column) -> Column:
    """Source row (of equal steps of latitude) of a target row of equal mercator steps between two latitudes."""
    y = lambda lat: math.log(math.tan(math.radians(45 + lat / 2)))
    step = (y(north) - y(south)) / height
    lat = F.degrees(2 * F.atan(F.exp(F.lit(y(north)) - (row + 0.5) * step)) - math.pi / 2)
    return F.floor((F.lit(north) - lat) / ((north - south) / height)).cast("long")


def to_mercator(px: DataFrame, value: str, height: int, south: float, north: float) -> DataFrame:
    """Reprojects a raster of longitude and latitude to mercator by the nearest pixel. A source row goes to the target rows whose centres
    are in it: one too many on either side are tried, so that rounding loses none, and nothing is joined."""
    y = lambda lat: math.log(math.tan(math.radians(45 + lat / 2)))
    step = (y(north) - y(south)) / height
    at = lambda r: (F.lit(y(north)) - F.log(F.tan(F.radians(45 + (F.lit(north) - r * ((north - south) / height)) / 2)))) / step
    source = F.col("row").cast("double")
    wanted = F.sequence(F.floor(at(source)) - 1, F.floor(at(source + 1)) + 1)
    tried = px.where(F.col("row").between(0, height - 1)).withColumn("__row", F.explode(wanted)).where(F.col("__row").between(0, height - 1))
    return tried.where(mercator_rows(height, south, north, F.col("__row")) == F.col("row")).select(F.col("__row").alias("row"), "col", value)
