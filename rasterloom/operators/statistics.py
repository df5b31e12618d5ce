"""Statistics of pixels that flow back to the pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import radiometry as R
from rasterloom.storage import checkpointed

#: Bins of a histogram over which ranks are found, and distinct values of a group that one task puts in order.
BINS, FEW = 65_536, 200_000


def joined_by(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """`df` with the rows of `small` of its group (null is a group). There are as many rows as groups, or percentiles of groups."""
    if not by:
        return df.crossJoin(F.broadcast(small))
    names = {c: f"__by_{i}" for i, c in enumerate(by)}
    same = [df[c].eqNullSafe(F.col(n)) for c, n in names.items()]
    return df.join(F.broadcast(small.withColumnsRenamed(names)), same).drop(*names.values())


def bin_of(v: Column, low: Column, high: Column, bins: int, curved: bool) -> Column:
    """Place of a value among even bins between two finite values, or, curved, among those even in the signed logarithm; endless values
    and NaN, which comes after all others, have bins of their own. The two ends lie in different bins if they differ."""
    v = v.cast("double")
    level = (lambda x: F.signum(x) * F.log1p(F.abs(x))) if curved else (lambda x: x / 2)
    share = F.try_divide(level(v) - level(low), level(high) - level(low))
    place = F.coalesce(F.least(F.greatest(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)), F.lit(0))
    return F.when(F.abs(v) < F.lit(float("inf")), place).when(F.isnan(v), bins + 1).when(v > 0, bins).otherwise(-1)


def intervals(counts: DataFrame, by: list[str], percents: dict[str, float], few: int, bins: int) -> DataFrame:
    """For each group and percentile the interval of values (__from, __to) that holds its rank, and the rank counted from there, such
    that no interval has more than `few` distinct values: a histogram tells the rank's bin, whose own least and greatest value are the
    next one's ends, until the bin is small."""
    v, finite = F.col("__v").cast("double"), F.abs(F.col("__v").cast("double")) < F.lit(float("inf"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in percents.items()])
    ends = [F.min("__v").alias("__from"), F.max("__v").alias("__to"), F.min(F.when(finite, v)).alias("__low"), F.max(F.when(finite, v)).alias("__high"), F.sum("__n").alias("__all"), F.count("*").alias("__rows")]
    state = counts.groupBy(*by).agg(*ends).withColumn("__t", F.explode(ranks))
    state = checkpointed(state.select(*by, F.col("__t.name").alias("__name"), F.rint(F.col("__t.p") / 100.0 * (F.col("__all") - 1)).alias("__rank"), "__from", "__to", "__low", "__high", "__rows"))
    curved, done = True, None
    while True:
        small = state.where(F.col("__rows") <= few)
        done = small if done is None else done.unionByName(small)
        large = state.where(F.col("__rows") > few)
        if large.isEmpty():
            return done
        inside = joined_by(counts, large.select(*by, "__name", "__from", "__to", "__low", "__high"), by).where(F.col("__v").between(F.col("__from"), F.col("__to")))
        binned = inside.withColumn("__bin", bin_of(F.col("__v"), F.col("__low"), F.col("__high"), bins, curved)).groupBy(*by, "__name", "__bin").agg(*ends)
        ranked = joined_by(binned, large.select(*by, F.col("__name").alias("__its"), "__rank"), by).where("__name = __its").drop("__its")
        before = F.coalesce(F.sum("__all").over(Window.partitionBy(*by, "__name").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most bins + 3 rows
        found = ranked.withColumn("__before", before).where((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__all")))
        state = checkpointed(found.select(*by, "__name", (F.col("__rank") - F.col("__before")).alias("__rank"), "__from", "__to", "__low", "__high", "__rows"))
        curved = not curved  # far values part by logarithms, near ones evenly


def nearest_percentiles(px: DataFrame, value: str, percents: dict[str, float], by: list[str] = (), where: Column | None = None, few: int = FEW, bins: int = BINS) -> DataFrame:
    """Values at the nearest ranks rint(p / 100 * (n - 1)), a row for each group.

    Pixels are folded to distinct values with their counts before they are shuffled. Where a group has more than `few` of those,
    the interval that holds a rank is narrowed by histograms until it has no more, so no task puts more than `few` values in order,
    however they are spread. few and bins change the work, never the result.
    """
    by = list(by)
    used = px.where(F.col(value).isNotNull())
    counts = (used if where is None else used.where(where)).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    most = counts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= few:
        order = Window.partitionBy(*by).orderBy("__v")
        placed = counts.select(*by, "__v", F.sum("__n").over(order).alias("__end"), F.sum("__n").over(Window.partitionBy(*by)).alias("__all"))
        reached = lambda p: F.min(F.when(F.col("__end") > F.rint(F.lit(float(p)) / 100.0 * (F.col("__all") - 1)), F.col("__v")))
        return placed.groupBy(*by).agg(*[reached(p).alias(name) for name, p in percents.items()])
    counts = checkpointed(counts)
    wanted = intervals(counts, by, percents, few, bins).select(*by, "__name", "__rank", "__from", "__to")
    inside = joined_by(counts, wanted, by).where(F.col("__v").between(F.col("__from"), F.col("__to")))
    order = Window.partitionBy(*by, "__name").orderBy("__v")
    reached = inside.withColumn("__last", F.sum("__n").over(order) - 1).where("__last >= __rank")
    return reached.groupBy(*by).agg(*[F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in percents])


def range_of(key: str, width: int) -> Column:
    return F.expr(f"(`{key}` - pmod(`{key}`, {width}L)) div {width}L")


def numbered(df: DataFrame, key: str, out: str, fold: int = 1000) -> DataFrame:
    """The place, from 1, of each row in the order of a whole number `key` (unique). Rows are put in order within ranges of
    `fold` keys; counts of ranges, and of ranges of ranges, are folded alike until one range is left, so no task orders more
    than `fold` rows and what is joined back is a row for each range."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or low == high:
        return df.withColumn(out, F.lit(1).cast("long"))
    keyed = df.withColumn("__key", (F.col(key) - F.lit(low)).cast("long"))  # from 0, so that all keys meet in one range at last
    placed = keyed.withColumn("__before", F.row_number().over(Window.partitionBy(range_of("__key", fold)).orderBy("__key")).cast("long"))
    width = fold
    while (high - low) // width:
        counts = keyed.groupBy(range_of("__key", width).alias("__range")).agg(F.count("*").alias("__n"))
        within = Window.partitionBy(range_of("__range", fold)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.select("__range", F.coalesce(F.sum("__n").over(within), F.lit(0)).alias("__more"))
        placed = placed.withColumn("__range", range_of("__key", width)).join(sums, "__range").withColumn("__before", F.col("__before") + F.col("__more")).drop("__range", "__more")
        width *= fold
    return placed.drop("__key").withColumnRenamed("__before", out)


def subsampled(px: DataFrame, row: str = "row", col: str = "col", step: int = 2) -> DataFrame:
    """Every `step`th row and column, from which the display statistics are taken."""
    return px.where((F.col(row) % step == 0) & (F.col(col) % step == 0))


def with_statistics(px: DataFrame, stats: DataFrame, by: list[str] = ()) -> DataFrame:
    """Statistics joined back: one row, or one for each band; broadcast, as there are as many rows as bands."""
    return px.join(F.broadcast(stats), list(by)) if by else px.crossJoin(F.broadcast(stats))


def masked_stretch(px: DataFrame, value: str, mask: Column, left: float = 2, right: float = 2, gamma: float | None = None, out: str = "out") -> DataFrame:
    """Percentile stretch over unmasked pixels; masked ones become 0."""
    stats = nearest_percentiles(px, value, {"__low": left, "__high": 100 - right}, where=~mask)
    scaled = R.byte_scale(F.when(mask, 0.0).otherwise(F.col(value)), F.col("__low"), F.col("__high"))
    joined = with_statistics(px, stats)
    return joined.withColumn(out, scaled if gamma is None else R.gamma(scaled, gamma)).drop("__low", "__high")


def linear_stretch(px: DataFrame, value: str, left: float = 2, right: float = 2, nodata=None, sample: bool = True, out: str = "out") -> DataFrame:
    where = None if nodata is None else F.col(value) != nodata
    stats = nearest_percentiles(subsampled(px) if sample else px, value, {"__low": left, "__high": 100 - right}, where=where)
    return with_statistics(px, stats).withColumn(out, R.byte_scale(F.col(value), F.col("__low"), F.col("__high"), nodata)).drop("__low", "__high")


def minmax_stretch(px: DataFrame, value: str, nodata=None, out: str = "out") -> DataFrame:
    used = px if nodata is None else px.where(F.col(value) != nodata)
    stats = used.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    return with_statistics(px, stats).withColumn(out, R.byte_scale(F.col(value), F.col("__low"), F.col("__high"), nodata)).drop("__low", "__high")


def std_stretch(px: DataFrame, value: str, n: float = 3, nodata=None, out: str = "out", digits: int = 6) -> DataFrame:
    """Stretch of mean less and plus n population standard deviations (rounded, as sums depend on their order)."""
    used = px if nodata is None else px.where(F.col(value) != nodata)
    stats = used.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).select(F.round(F.col("m") - n * F.col("s"), digits).alias("__low"), F.round(F.col("m") + n * F.col("s"), digits).alias("__high"))
    return with_statistics(px, stats).withColumn(out, R.byte_scale(F.col(value), F.col("__low"), F.col("__high"), nodata)).drop("__low", "__high")


def auto_gamma(px: DataFrame, value: str, target: float = 0.45, nodata=None, sample: bool = True) -> DataFrame:
    """One row: the gamma that brings the mean (of every second row and column) to the target."""
    used = subsampled(px) if sample else px
    used = used if nodata is None else used.where(F.col(value) != nodata)
    return used.agg(R.auto_gamma(F.avg(value), target).alias("gamma"))


def shared_stretch(px: DataFrame, band: str, value: str, percent: float = 0.25, target: float = 0.5, out: str = "out") -> DataFrame:
    """All bands stretched by the mean of their percentiles, with the least of their gammas."""
    stats = nearest_percentiles(px, value, {"low": percent, "high": 100 - percent}, by=[band]).agg(F.avg("low").alias("__low"), F.avg("high").alias("__high"))
    scaled = with_statistics(px, stats).withColumn("__s", R.byte_scale(F.col(value), F.col("__low"), F.col("__high")))
    gammas = scaled.groupBy(band).agg(R.auto_gamma(F.avg("__s"), target).alias("g")).agg(F.min("g").alias("__g"))
    return with_statistics(scaled, gammas).withColumn(out, R.gamma(F.col("__s"), F.col("__g"))).drop("__low", "__high", "__s", "__g")


def histogram2d(points: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 100) -> DataFrame:
    """Log counts of a grid of bins; the upper edge belongs to the last bin."""
    place = lambda c, low, high: F.least(F.floor((F.col(c) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    inside = points.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.select(place(x, *x_range).alias("xbin"), place(y, *y_range).alias("ybin")).groupBy("xbin", "ybin").agg(F.log(F.count("*")).alias("log_n"))
