"""Whole chains, as the scene scripts run them: lazy plans whose only barriers are statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import radiometry as R
from rasterloom.operators import rasters as X
from rasterloom.operators import statistics as S
from rasterloom.plans import views as V
from rasterloom.plans.catalogue import register
from rasterloom.plans.radiometry_queries import gamma_sql, rank_sql, scale_sql

_NZ = f"(SELECT g FROM {V.PX_LI} WHERE g <> 0)"


@register("planet_pipeline", f"WITH s AS (SELECT {rank_sql(_NZ, 0.5, 'g')} AS low, {rank_sql(_NZ, 98, 'g')} AS high), p AS (SELECT g, {scale_sql('g', 'low::DOUBLE', 'high::DOUBLE', '0')} AS b FROM {V.PX_LI}, s) SELECT g, {gamma_sql('b', '1.5')} AS out, count(*) AS n FROM p GROUP BY g, out")
def _(spark, d):
    px = V.px_li(spark, d)
    stats = S.nearest_percentiles(px, "g", {"low": 0.5, "high": 98}, where=F.col("g") != 0)
    out = S.with_statistics(px, stats).withColumn("out", R.gamma(R.byte_scale(F.col("g"), F.col("low"), F.col("high"), 0), 1.5))
    return out.groupBy("g", "out").agg(F.count("*").alias("n"))


_SHARP = "CAST(trunc(round(least(greatest(CAST(ir AS DOUBLE) / nullif((r + g + b * 0.2::DOUBLE) / 2.2::DOUBLE, 0) * r, 0.0::DOUBLE), 255.0::DOUBLE), 9)) AS INTEGER)"
_L8 = f"(SELECT CASE WHEN ir % 4 = 3 THEN 0 ELSE {_SHARP} END AS s, ir % 4 = 3 AS cloud FROM {V.PX_LI})"


@register("landsat_pipeline", f"WITH p AS (SELECT * FROM {_L8} WHERE s IS NOT NULL), s AS (SELECT {rank_sql('(SELECT s FROM p WHERE NOT cloud)', 1, 's')} AS low, {rank_sql('(SELECT s FROM p WHERE NOT cloud)', 97.5, 's')} AS high), q AS (SELECT s, cloud, {scale_sql('s', 'low::DOUBLE', 'high::DOUBLE')} AS b FROM p, s) SELECT s, cloud, {gamma_sql('b', '1.5')} AS out, count(*) AS n FROM q GROUP BY s, cloud, out")
def _(spark, d):
    ratio = R.brovey_ratio(F.col("r"), F.col("g"), F.col("b"), F.col("ir"))
    sharp = F.when(ratio.isNotNull(), F.round(F.least(F.greatest(ratio * F.col("r"), F.lit(0.0)), F.lit(255.0)), 9).cast("int"))
    px = V.px_li(spark, d).select((F.col("ir") % 4 == 3).alias("cloud"), sharp.alias("s")).where("s is not null").withColumn("s", F.when(F.col("cloud"), 0).otherwise(F.col("s")))
    stats = S.nearest_percentiles(px, "s", {"low": 1, "high": 97.5}, where=~F.col("cloud"))
    out = S.with_statistics(px, stats).withColumn("out", R.gamma(R.byte_scale(F.col("s"), F.col("low"), F.col("high")), 1.5))
    return out.groupBy("s", "cloud", "out").agg(F.count("*").alias("n"))


_GREEN = "CAST(trunc(g * (1 - 0.07::DOUBLE) + ir * 0.07::DOUBLE) AS INTEGER)"


@register("truecolor_pipeline", f"SELECT g2, out, count(*) AS n FROM (SELECT g2, {gamma_sql(scale_sql('g2', '10.0::DOUBLE', '200.0::DOUBLE'), '1.5')} AS out FROM (SELECT CASE WHEN CASE WHEN ir % 4 IN (2, 3) THEN 0 ELSE 1 END = 0 THEN 0 ELSE {_GREEN} END AS g2 FROM {V.PX_LI})) GROUP BY g2, out")
def _(spark, d):
    px = V.px_li(spark, d)
    green = F.when(R.cloud_recode(F.col("ir") % 4) == 0, 0).otherwise(R.green_boost(F.col("g"), F.col("ir"), 0.07))
    return px.select(green.alias("g2")).withColumn("out", R.gamma(R.byte_scale(F.col("g2"), 10, 200), 1.5)).groupBy("g2", "out").agg(F.count("*").alias("n"))


_CIRA = "CASE WHEN w <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (log10(w) - log10(0.0223::DOUBLE)) / ((1 - log10(0.0223::DOUBLE)) * 0.75::DOUBLE)) END"


@register("l2a_pipeline", f"SELECT g, out, count(*) AS n FROM (SELECT g, {scale_sql('c', '0.0::DOUBLE', '1.0::DOUBLE')} AS out FROM (SELECT g, round({_CIRA}, 9) AS c FROM (SELECT g, g * 40 * 0.0001::DOUBLE AS w FROM {V.PX_LI}))) GROUP BY g, out")
def _(spark, d):
    c = F.round(R.cira_stretch(F.col("g") * 40 * 0.0001), 9)
    return V.px_li(spark, d).select("g", R.byte_scale(c, 0, 1).alias("out")).groupBy("g", "out").agg(F.count("*").alias("n"))


@register("preview_pipeline", f"SELECT band, v, CASE WHEN band = 2 THEN {gamma_sql(scale_sql('v', '0.0::DOUBLE', '155.0::DOUBLE'), '1.4')} ELSE {gamma_sql(scale_sql('v', '0.0::DOUBLE', '160.0::DOUBLE'), '1.3')} END AS out, count(*) AS n FROM (SELECT unnest([1, 2, 3]) AS band, unnest([r, g, b]) AS v FROM {V.PX_LI}) GROUP BY band, v")
def _(spark, d):
    px = V.px_li(spark, d).select(F.explode(F.create_map(F.lit(1), "r", F.lit(2), "g", F.lit(3), "b")).alias("band", "v")).groupBy("band", "v").agg(F.count("*").alias("n"))
    scaled = lambda top, g: R.gamma(R.byte_scale(F.col("v"), 0, top), g)
    return px.select("band", "v", F.when(F.col("band") == 2, scaled(155, 1.4)).otherwise(scaled(160, 1.3)).alias("out"), "n")


@register("masked_pyramid_pipeline", f"WITH p AS (SELECT row, col, CASE WHEN masked THEN 0.0::DOUBLE ELSE v END AS v FROM {V.PX_EV}) SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, round(avg(v), 7) AS v FROM p GROUP BY 1, 2")
def _(spark, d):
    px = V.px_ev(spark, d).withColumn("v", F.when(F.col("masked"), 0.0).otherwise(F.col("v")))
    return X.pyramid(px, "v", 1).select("row", "col", F.round("v", 7).alias("v"))
