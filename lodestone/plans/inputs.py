"""Inputs of the registered queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v1, v2: users of consecutive events, as often as they follow each other."""
    e = read(spark, sf_dir, "events")
    name = lambda c: F.concat(F.lit("u"), F.col(c))
    a = e.select(F.col("event_id"), name("user_id").alias("v1"))
    b = e.select((F.col("event_id") - 1).alias("event_id"), name("user_id").alias("v2"))
    return a.join(b, "event_id").select("v1", "v2")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_edges(spark, sf_dir).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x1, x2: the first two numbers of each embedding."""
    return read(spark, sf_dir, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x1"), F.get("embedding", F.lit(1)).cast("double").alias("x2"))


def _coded(spark: SparkSession, sf_dir: str, lng: str, lat: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.expr(lng).cast("double").alias("lng"), F.expr(lat).cast("double").alias("lat"))


def wide_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lng, lat over the whole map."""
    return _coded(spark, sf_dir, "cast(c_custkey * 37 % 3600 as double) / 10 - 180", "cast(c_custkey * 53 % 1600 as double) / 10 - 80")


def near_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lng, lat in a small area, so that fine tiles hold several."""
    return _coded(spark, sf_dir, "cast(c_custkey * 37 % 997 as double) / 200000 - 97", "cast(c_custkey * 53 % 991 as double) / 200000 + 30")


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y: quantity and price of each line item, scaled."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, count of orders."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(F.count("o_orderkey").cast("int").alias("count"))
