"""Queries on single pixels and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import radiometry as R
from rasterloom.operators import statistics as S
from rasterloom.plans import views as V
from rasterloom.plans.catalogue import register


def rank_sql(src: str, p: float, value: str = "v") -> str:
    """Value at the nearest rank of a subquery."""
    return f"(SELECT {value} FROM (SELECT {value}, row_number() OVER (ORDER BY {value}) AS rn, count(*) OVER () AS n FROM {src}) WHERE rn - 1 = round_even({p}::DOUBLE / 100.0::DOUBLE * (n - 1), 0))"


def scale_sql(v: str, low: str, high: str, nodata: str | None = None, top: int = 255) -> str:
    middle = f" WHEN {v} = {nodata} THEN 0" if nodata else ""
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} < {low} THEN 0 WHEN {v} > {high} THEN {top}{middle} ELSE CAST(trunc(({v} - {low}) * {float(top)}::DOUBLE / ({high} - {low})) AS INTEGER) END"


def gamma_sql(v: str, g: str) -> str:
    return f"CAST(trunc(pow(CAST({v} AS DOUBLE) / 256.0::DOUBLE, 1.0::DOUBLE / {g}::DOUBLE) * 255.0::DOUBLE) AS INTEGER)"


_CLEAR = f"(SELECT v FROM {V.PX_EV} WHERE NOT masked)"


@register(
    "stretch_masked_gamma",
    f"WITH s AS (SELECT {rank_sql(_CLEAR, 2)} AS low, {rank_sql(_CLEAR, 98)} AS high), p AS (SELECT row, col, CASE WHEN masked THEN 0.0::DOUBLE ELSE v END AS v FROM {V.PX_EV}), b AS (SELECT row, col, {scale_sql('v', 'low', 'high')} AS b FROM p, s) SELECT row, col, {gamma_sql('b', '1.5')} AS out FROM b",
)
def _(spark, d):
    px = V.px_ev(spark, d)
    return S.masked_stretch(px, "v", F.col("masked"), 2, 2, gamma=1.5).select("row", "col", "out")


@register("gamma_correct", f"SELECT r, {gamma_sql('r', '1.7')} AS out, count(*) AS n FROM {V.PX_LI} GROUP BY r")
def _(spark, d):
    return V.px_li(spark, d).groupBy("r").agg(F.count("*").alias("n")).select("r", R.gamma(F.col("r"), 1.7).alias("out"), "n")


@register("bytscl_minmax", f"WITH s AS (SELECT min(v) AS low, max(v) AS high FROM {V.PX_EV}) SELECT row, col, {scale_sql('v', 'low', 'high')} AS out FROM {V.PX_EV}, s")
def _(spark, d):
    return S.minmax_stretch(V.px_ev(spark, d), "v").select("row", "col", "out")


@register("bytscl_nodata", f"WITH s AS (SELECT min(dn) AS low, max(dn) AS high FROM {V.PX_EV} WHERE dn <> 20) SELECT row, col, dn, {scale_sql('dn', 'low::DOUBLE', 'high::DOUBLE', '20')} AS out FROM {V.PX_EV}, s")
def _(spark, d):
    return S.minmax_stretch(V.px_ev(spark, d), "dn", nodata=20).select("row", "col", "dn", "out")


@register("bytscl_outside_nodata", f"SELECT row, col, dn, {scale_sql('dn', '10.0::DOUBLE', '60.0::DOUBLE', '5')} AS out FROM {V.PX_EV}")
def _(spark, d):
    return V.px_ev(spark, d).select("row", "col", "dn", R.byte_scale(F.col("dn"), 10, 60, nodata=5).alias("out"))


_SAMPLED = f"(SELECT v FROM {V.PX_EV} WHERE row % 2 = 0 AND col % 2 = 0)"


@register("linear_stretch_2pct", f"WITH s AS (SELECT {rank_sql(_SAMPLED, 2)} AS low, {rank_sql(_SAMPLED, 98)} AS high) SELECT row, col, {scale_sql('v', 'low', 'high')} AS out FROM {V.PX_EV}, s")
def _(spark, d):
    return S.linear_stretch(V.px_ev(spark, d), "v").select("row", "col", "out")


@register("linear_stretch_asymmetric", f"WITH s AS (SELECT {rank_sql(f'(SELECT v FROM {V.PX_EV})', 0.5)} AS low, {rank_sql(f'(SELECT v FROM {V.PX_EV})', 97)} AS high) SELECT row, col, {scale_sql('v', 'low', 'high')} AS out FROM {V.PX_EV}, s")
def _(spark, d):
    return S.linear_stretch(V.px_ev(spark, d), "v", 0.5, 3, sample=False).select("row", "col", "out")


@register(
    "percentiles_by_band",
    f"SELECT band, max(CASE WHEN rn - 1 = round_even(0.01::DOUBLE * (n - 1), 0) THEN v END) AS low, max(CASE WHEN rn - 1 = round_even(97.5::DOUBLE / 100.0::DOUBLE * (n - 1), 0) THEN v END) AS high FROM (SELECT band, v, row_number() OVER (PARTITION BY band ORDER BY v) AS rn, count(*) OVER (PARTITION BY band) AS n FROM (SELECT unnest(['r','g','b']) AS band, unnest([r, g, b]) AS v FROM {V.PX_LI}) WHERE v <> 0) GROUP BY band",
)
def _(spark, d):
    px = V.px_li(spark, d).select(F.explode(F.create_map(F.lit("r"), "r", F.lit("g"), "g", F.lit("b"), "b")).alias("band", "v"))
    return S.nearest_percentiles(px, "v", {"low": 1, "high": 97.5}, by=["band"], where=F.col("v") != 0)


@register("std_stretch", f"WITH s AS (SELECT round(avg(v) - 3 * stddev_pop(v), 6) AS low, round(avg(v) + 3 * stddev_pop(v), 6) AS high FROM {V.PX_EV}) SELECT row, col, {scale_sql('v', 'low', 'high')} AS out FROM {V.PX_EV}, s")
def _(spark, d):
    return S.std_stretch(V.px_ev(spark, d), "v").select("row", "col", "out")


@register("std_stretch_nodata", f"WITH s AS (SELECT round(avg(dn) - 2 * stddev_pop(dn), 6) AS low, round(avg(dn) + 2 * stddev_pop(dn), 6) AS high FROM {V.PX_EV} WHERE dn <> 0) SELECT row, col, {scale_sql('dn', 'low', 'high', '0')} AS out FROM {V.PX_EV}, s")
def _(spark, d):
    return S.std_stretch(V.px_ev(spark, d), "dn", 2, nodata=0).select("row", "col", "out")


_CIRA = "CASE WHEN v <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (log10(v) - log10(0.0223::DOUBLE)) / ((1 - log10(0.0223::DOUBLE)) * 0.75::DOUBLE)) END"


@register("cira_stretch", f"SELECT row, col, round({_CIRA}, 6) AS out FROM {V.PX_EMB}")
def _(spark, d):
    return V.px_emb(spark, d).select("row", "col", F.round(R.cira_stretch(F.col("v")), 6).alias("out"))


@register("green_boost", f"SELECT g, ir, CAST(trunc(g * (1 - 0.07::DOUBLE) + ir * 0.07::DOUBLE) AS INTEGER) AS out, count(*) AS n FROM {V.PX_LI} GROUP BY g, ir")
def _(spark, d):
    return V.px_li(spark, d).groupBy("g", "ir").agg(F.count("*").alias("n")).select("g", "ir", R.green_boost(F.col("g"), F.col("ir"), 0.07).alias("out"), "n")


@register("gray_luma", f"SELECT r, g, b, CAST(trunc(r * 0.2125::DOUBLE + g * 0.7154::DOUBLE + b * 0.0721::DOUBLE) AS INTEGER) AS gray FROM {V.PX_LI}")
def _(spark, d):
    return V.px_li(spark, d).select("r", "g", "b", R.luma(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


_RATIO = "(CAST(ir AS DOUBLE) / nullif((r + g + b * 0.2::DOUBLE) / 2.2::DOUBLE, 0))"


@register("brovey_sharpen", f"SELECT r, g, b, ir, round({_RATIO}, 6) AS ratio, CAST(trunc(round(least(greatest({_RATIO} * r, 0.0::DOUBLE), 255.0::DOUBLE), 9)) AS INTEGER) AS sharp_r FROM {V.PX_LI}")
def _(spark, d):
    ratio = R.brovey_ratio(F.col("r"), F.col("g"), F.col("b"), F.col("ir"))
    sharp = F.round(F.least(F.greatest(ratio * F.col("r"), F.lit(0.0)), F.lit(255.0)), 9).cast("int")
    return V.px_li(spark, d).select("r", "g", "b", "ir", F.round(ratio, 6).alias("ratio"), F.when(ratio.isNotNull(), sharp).alias("sharp_r"))


@register("auto_gamma_value", f"SELECT round(1.0::DOUBLE / (log10(0.45::DOUBLE) / log10(avg(dn) / 256.0::DOUBLE)), 6) AS gamma FROM {V.PX_EV} WHERE row % 2 = 0 AND col % 2 = 0 AND dn <> 0")
def _(spark, d):
    return S.auto_gamma(V.px_ev(spark, d), "dn", nodata=0).select(F.round("gamma", 6).alias("gamma"))


@register("qa_cloud_class", f"SELECT qa, CASE WHEN qa IN {tuple(R.QA_CLOUD)} THEN 1 WHEN qa IN {tuple(R.QA_SHADOW)} THEN 2 WHEN qa IN {tuple(R.QA_CIRRUS)} THEN 3 ELSE 0 END AS class, count(*) AS n FROM {V.QA_LI} GROUP BY qa")
def _(spark, d):
    return V.qa_li(spark, d).groupBy("qa").agg(F.count("*").alias("n")).select("qa", R.cloud_class(F.col("qa")).alias("class"), "n")


_LEN, _SLOPE, _CUT = R.modis_band("31")
_BT = f"(({R.C2!r}::DOUBLE / ({_LEN!r}::DOUBLE * ln({R.C1!r}::DOUBLE / (1e6::DOUBLE * rad * {_LEN ** 5!r}::DOUBLE) + 1)) - {_CUT!r}::DOUBLE) / {_SLOPE!r}::DOUBLE)"


@register("modis_bt", f"SELECT row, col, round({_BT}, 4) AS bt FROM (SELECT row, col, 1 + v / 100.0::DOUBLE AS rad FROM {V.PX_EV})")
def _(spark, d):
    return V.px_ev(spark, d).select("row", "col", F.round(R.brightness_temperature(1 + F.col("v") / 100.0, "31"), 4).alias("bt"))


@register("modis_bt_inverse", f"SELECT row, col, round({R.C1!r}::DOUBLE / (1e6::DOUBLE * {_LEN ** 5!r}::DOUBLE * (exp({R.C2!r}::DOUBLE / ({_LEN!r}::DOUBLE * (t * {_SLOPE!r}::DOUBLE + {_CUT!r}::DOUBLE))) - 1)), 6) AS rad FROM (SELECT row, col, 200 + dn / 2.0::DOUBLE AS t FROM {V.PX_EV})")
def _(spark, d):
    return V.px_ev(spark, d).select("row", "col", F.round(R.emissive_radiance(200 + F.col("dn") / 2.0, "31"), 6).alias("rad"))


@register("modis_roundtrip", f"SELECT row, col, round(1 + v / 100.0::DOUBLE, 6) AS rad FROM {V.PX_EV}")
def _(spark, d):
    return V.px_ev(spark, d).select("row", "col", F.round(R.emissive_radiance(R.brightness_temperature(1 + F.col("v") / 100.0, "31"), "31"), 6).alias("rad"))


_BAND_TABLE = "(VALUES " + ", ".join(f"('{b}', {w!r}::DOUBLE, {s!r}::DOUBLE, {i!r}::DOUBLE)" for b, (w, s, i) in R.MODIS_BANDS.items()) + ") t(band, wavenumber, slope, intercept)"


@register("modis_band_table", f"SELECT band, wavenumber, slope, intercept, count(*) AS n FROM {_BAND_TABLE} JOIN lineitem ON band = CAST(20 + l_orderkey % 17 AS VARCHAR) GROUP BY ALL")
def _(spark, d):
    """The bands that rows name, and how many do."""
    bands = spark.createDataFrame([(b, *v) for b, v in R.MODIS_BANDS.items()], "band string, wavenumber double, slope double, intercept double")
    named = V.table(spark, d, "lineitem").groupBy((20 + F.col("l_orderkey") % 17).cast("string").alias("band")).agg(F.count("*").alias("n"))
    return F.broadcast(bands).join(named, "band")


_NAMES = "CASE dn % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '17' ELSE '99' END"


@register("dn_to_reflectance", f"SELECT row, col, {_NAMES} AS band, CASE dn % 4 WHEN 0 THEN (dn - 1.0::DOUBLE) * 0.5::DOUBLE WHEN 1 THEN (dn - 2.0::DOUBLE) * 0.25::DOUBLE WHEN 2 THEN (dn - 4.0::DOUBLE) * 2.0::DOUBLE END AS reflectance FROM {V.PX_EV}")
def _(spark, d):
    px = V.px_ev(spark, d).withColumn("band", F.expr(_NAMES))
    arrays = [F.array(*[F.lit(x) for x in xs]) for xs in ((0.5, 0.25, 2.0), (1.0, 2.0, 4.0))]
    return px.select("row", "col", "band", R.calibrated(F.col("dn"), F.col("band"), F.lit("1,2,17"), *arrays).alias("reflectance"))


@register("class_symbol", f"SELECT row, col, CASE WHEN s = -3000 THEN 255 ELSE CAST(floor((s + 2000) / 120.000001::DOUBLE) AS INTEGER) END AS class FROM (SELECT row, col, CASE WHEN masked THEN -3000 ELSE CAST((dn * 47) % 12001 - 2000 AS INTEGER) END AS s FROM {V.PX_EV})")
def _(spark, d):
    s = F.when(F.col("masked"), -3000).otherwise((F.col("dn") * 47) % 12001 - 2000)
    return V.px_ev(spark, d).select("row", "col", R.symbol_class(s).alias("class"))


@register("symbol_lookup", f"SELECT row, col, (CAST(floor((dn * 40) / 120.000001::DOUBLE) AS INTEGER) * 2) % 256 AS red FROM {V.PX_EV} WHERE CAST(floor((dn * 40) / 120.000001::DOUBLE) AS INTEGER) < 100")
def _(spark, d):
    table = spark.range(100).select(F.col("id").cast("int").alias("class"), ((F.col("id") * 2) % 256).cast("int").alias("red"))
    return V.px_ev(spark, d).withColumn("class", R.symbol_class(F.col("dn") * 40 - 2000)).join(F.broadcast(table), "class").select("row", "col", "red")


@register("seafog_index", f"SELECT r, g, b, ir, b1 > b2 AND b1 < 0.2::DOUBLE AND b2 < 0.2::DOUBLE AS sea, ir < 273 AND b1 > 0.55::DOUBLE AND b2 > 0.55::DOUBLE AS high, round((b1 - b2) / nullif(CAST(ir AS DOUBLE), 0), 6) AS ifc FROM (SELECT *, r / 255.0::DOUBLE AS b1, g / 255.0::DOUBLE AS b2 FROM {V.PX_LI})")
def _(spark, d):
    px = V.px_li(spark, d).withColumn("b1", F.col("r") / 255.0).withColumn("b2", F.col("g") / 255.0)
    return px.select("r", "g", "b", "ir", R.sea_surface(F.col("b1"), F.col("b2")).alias("sea"), R.high_cloud(F.col("ir"), F.col("b1"), F.col("b2")).alias("high"), F.round(R.fog_index(F.col("b1"), F.col("b2"), F.col("ir").cast("double")), 6).alias("ifc"))


@register("band_log10_safe", f"SELECT row, col, round(CASE WHEN v > 0 THEN log10(v) ELSE 0.0::DOUBLE END, 6) AS out FROM {V.PX_EMB}")
def _(spark, d):
    return V.px_emb(spark, d).select("row", "col", F.round(R.safe_log10(F.col("v")), 6).alias("out"))


@register("bit_depth_fix", f"SELECT dn, CASE WHEN dn % 2 = 0 THEN dn ELSE dn >> 1 END AS out, count(*) AS n FROM {V.PX_EV} GROUP BY dn")
def _(spark, d):
    return V.px_ev(spark, d).groupBy("dn").agg(F.count("*").alias("n")).select("dn", R.fix_bit_depth(F.col("dn"), F.when(F.col("dn") % 2 == 0, 8).otherwise(15)).alias("out"), "n")


@register("to_byte_recode", f"SELECT row, col, CASE WHEN w = 255 THEN 254 WHEN w > 255 THEN 255 ELSE w END AS out FROM (SELECT row, col, dn * 2 AS w FROM {V.PX_EV})")
def _(spark, d):
    return V.px_ev(spark, d).select("row", "col", R.to_byte(F.col("dn") * 2).alias("out"))


@register("raster_recolour", f"SELECT row, col, CASE WHEN k = 255 THEN 0 WHEN k = 1 THEN 255 ELSE k END AS red, CASE WHEN k = 255 THEN 0 ELSE k END AS green FROM (SELECT row, col, CASE WHEN dn % 3 = 0 THEN 255 ELSE dn % 3 END AS k FROM {V.PX_EV})")
def _(spark, d):
    red, green, _blue = R.recolour(F.when(F.col("dn") % 3 == 0, 255).otherwise(F.col("dn") % 3))
    return V.px_ev(spark, d).select("row", "col", red.alias("red"), green.alias("green"))


@register("change_dtype", f"SELECT row, col, CAST(v AS FLOAT) AS f, CAST(trunc(v) AS INTEGER) AS i FROM {V.PX_EV}")
def _(spark, d):
    return V.px_ev(spark, d).select("row", "col", F.col("v").cast("float").alias("f"), F.col("v").cast("int").alias("i"))


@register(
    "decibel_stretch",
    f"WITH p AS MATERIALIZED (SELECT row, col, round(CASE WHEN v > 0 THEN log10(v) END, 6) AS l FROM {V.PX_EMB}), k AS (SELECT l, sum(count(*)) OVER (ORDER BY l) AS upto, sum(count(*)) OVER () - 1 AS last FROM p WHERE l IS NOT NULL GROUP BY l), s AS (SELECT min(l) FILTER (upto > round_even(0.01::DOUBLE * last, 0)) AS low, min(l) FILTER (upto > round_even(0.99::DOUBLE * last, 0)) AS high FROM k) SELECT row, col, {scale_sql('l', 'low', 'high')} AS out FROM p, s",
)
def _(spark, d):
    px = V.px_emb(spark, d).withColumn("l", F.round(R.decibel(F.col("v")), 6))
    return S.linear_stretch(px, "l", 1, 1, sample=False).select("row", "col", "out")


@register("band_minmax_of_rasters", f"SELECT min(row) AS rmin, max(row) AS rmax, min(col) AS cmin, max(col) AS cmax, count(*) AS n FROM {V.PX_EV}")
def _(spark, d):
    return V.px_ev(spark, d).agg(F.min("row").alias("rmin"), F.max("row").alias("rmax"), F.min("col").alias("cmin"), F.max("col").alias("cmax"), F.count("*").alias("n"))


_BANDS = f"(SELECT unnest(['r','g','b']) AS band, unnest([r, g, b]) AS v FROM {V.PX_LI})"


@register(
    "shared_stretch",
    f"WITH q AS (SELECT band, v, row_number() OVER (PARTITION BY band ORDER BY v) AS rn, count(*) OVER (PARTITION BY band) AS n FROM {_BANDS}), s AS (SELECT avg(low) AS low, avg(high) AS high FROM (SELECT band, max(CASE WHEN rn - 1 = round_even(0.25::DOUBLE / 100.0::DOUBLE * (n - 1), 0) THEN v END) AS low, max(CASE WHEN rn - 1 = round_even(99.75::DOUBLE / 100.0::DOUBLE * (n - 1), 0) THEN v END) AS high FROM q GROUP BY band)), t AS (SELECT band, v, {scale_sql('v', 'low', 'high')} AS s FROM {_BANDS}, s), g AS (SELECT min(g) AS g FROM (SELECT 1.0::DOUBLE / (log10(0.5::DOUBLE) / log10(avg(s) / 256.0::DOUBLE)) AS g FROM t GROUP BY band)) SELECT band, v, {gamma_sql('s', 'g')} AS out, count(*) AS n FROM t, g GROUP BY band, v, out",
)
def _(spark, d):
    px = V.px_li(spark, d).select(F.explode(F.create_map(F.lit("r"), "r", F.lit("g"), "g", F.lit("b"), "b")).alias("band", "v"))
    return S.shared_stretch(px, "band", "v").groupBy("band", "v", "out").agg(F.count("*").alias("n"))
