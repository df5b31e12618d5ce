"""Deterministic raster and vector views over the driver's tables, in Spark and as DuckDB subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.radiometry import QA_CIRRUS, QA_CLOUD, QA_SHADOW

QA_VALUES = sorted({*QA_CLOUD, *QA_SHADOW, *QA_CIRRUS, 0, 1, 2720, 9999})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.expr("event_id div 100").alias("row"), (F.col("event_id") % 100).alias("col"), F.col("value").alias("v"), F.expr("cast(value as bigint) % 256").cast("int").alias("dn"), (F.col("event_type") == "error").alias("masked"))


def px_emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))


def px_li(spark: SparkSession, d: str) -> DataFrame:
    byte = lambda e: F.expr(f"cast({e} as bigint) % 256").cast("int")
    return table(spark, d, "lineitem").select(byte("l_extendedprice").alias("r"), byte("l_quantity*5").alias("g"), byte("l_discount*1000").alias("b"), byte("l_tax*1000").alias("ir"))


def qa_li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.element_at(F.array(*[F.lit(v) for v in QA_VALUES]), (1 + F.col("l_orderkey") % len(QA_VALUES)).cast("int")).alias("qa"))


def pt_cust(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("(c_custkey*7919 % 36000)/100.0D - 180").alias("lon"), F.expr("(c_custkey*104729 % 17000)/100.0D - 85").alias("lat"), F.col("c_acctbal").alias("z"))


def boxes(spark: SparkSession, d: str, of: str = "orders") -> DataFrame:
    name, key, w, h = {"orders": ("orders", "o_orderkey", "1 + k % 3", "1 + k % 2"), "suppliers": ("supplier", "s_suppkey", "10", "10")}[of]
    t = table(spark, d, name).select(F.col(key).alias("k")).select(F.col("k").alias("id"), F.expr("(k*37 % 3600)/10.0D - 180").alias("xmin"), F.expr("(k*91 % 1700)/10.0D - 85").alias("ymin"), F.expr(w).alias("w"), F.expr(h).alias("h"))
    return t.select("id", "xmin", "ymin", (F.col("xmin") + F.col("w")).alias("xmax"), (F.col("ymin") + F.col("h")).alias("ymax"))


def name_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat_ws("_", "p_brand", "p_type", "p_partkey").alias("name"), F.col("p_partkey").alias("id"))


def stack_ord(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), (F.col("o_custkey") % 500).alias("cell"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("ord"))


PX_EV = "(SELECT event_id // 100 AS row, event_id % 100 AS col, value AS v, CAST(CAST(trunc(value) AS BIGINT) % 256 AS INTEGER) AS dn, event_type = 'error' AS masked FROM events)"
PX_EMB = "(SELECT vec_id AS row, CAST(p - 1 AS INTEGER) AS col, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p))"
PX_LI = "(SELECT CAST(CAST(trunc(l_extendedprice) AS BIGINT) % 256 AS INTEGER) AS r, CAST(CAST(trunc(l_quantity*5) AS BIGINT) % 256 AS INTEGER) AS g, CAST(CAST(trunc(l_discount*1000) AS BIGINT) % 256 AS INTEGER) AS b, CAST(CAST(trunc(l_tax*1000) AS BIGINT) % 256 AS INTEGER) AS ir FROM lineitem)"
QA_LI = f"(SELECT list_extract({QA_VALUES}, 1 + l_orderkey % {len(QA_VALUES)}) AS qa FROM lineitem)"
PT_CUST = "(SELECT c_custkey AS id, (c_custkey*7919 % 36000)/100.0::DOUBLE - 180 AS lon, (c_custkey*104729 % 17000)/100.0::DOUBLE - 85 AS lat, c_acctbal AS z FROM customer)"
_BOX = "(SELECT k AS id, (k*37 % 3600)/10.0::DOUBLE - 180 AS xmin, (k*91 % 1700)/10.0::DOUBLE - 85 AS ymin, (k*37 % 3600)/10.0::DOUBLE - 180 + ({w}) AS xmax, (k*91 % 1700)/10.0::DOUBLE - 85 + ({h}) AS ymax FROM (SELECT {key} AS k FROM {t}))"
BB_ORD = _BOX.format(w="1 + k % 3", h="1 + k % 2", key="o_orderkey", t="orders")
BB_SUPP = _BOX.format(w="10", h="10", key="s_suppkey", t="supplier")
NAME_PART = "(SELECT concat_ws('_', p_brand, p_type, p_partkey) AS name, p_partkey AS id FROM part)"
STACK_ORD = "(SELECT CAST(o_orderdate AS DATE) AS date, o_custkey % 500 AS cell, o_totalprice AS v, o_orderkey AS ord FROM orders)"
