"""The driver's tables, and the point views over them: coordinates in whole millimetres, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, label): the first three numbers of each vector, in tenths of a thousandth."""
    mm = lambda k: F.floor(F.get("embedding", F.lit(k)).cast("double") * 10000).alias("xyz"[k])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *map(mm, range(3)), F.col("label").cast("long").alias("label"))


def points_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, line, x, y, z, refl, tag, ret, day): one return a line item."""
    tag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    ret = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("long").alias("line"), F.floor(F.col("l_quantity") * 200).alias("x"), (F.col("l_partkey") % 10000).alias("y"),
        F.floor(F.col("l_extendedprice") / 20).alias("z"), (F.col("l_suppkey") * 37 % 256).alias("refl"), tag.cast("long").alias("tag"), ret.cast("long").alias("ret"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("day"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, us, user, type, value): events with their time in microseconds."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), us.alias("us"), F.col("user_id").alias("user"), F.col("event_type").alias("type"), "value")


#: The same views for DuckDB, as common table expressions.
SQL_EMBEDDED = """emb AS (SELECT vec_id AS id, CAST(floor(CAST(embedding[1] AS DOUBLE) * 10000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE) * 10000) AS BIGINT) AS y,
  CAST(floor(CAST(embedding[3] AS DOUBLE) * 10000) AS BIGINT) AS z, CAST(label AS BIGINT) AS label FROM embeddings)"""
SQL_ITEMS = """li AS (SELECT l_orderkey AS "order", CAST(l_linenumber AS BIGINT) AS line, CAST(floor(l_quantity * 200) AS BIGINT) AS x, l_partkey % 10000 AS y, CAST(floor(l_extendedprice / 20) AS BIGINT) AS z,
  l_suppkey * 37 % 256 AS refl, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS BIGINT) AS tag, CAST(CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS BIGINT) AS ret,
  CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS BIGINT) AS day FROM lineitem)"""
SQL_EVENTS = """ev AS (SELECT event_id AS id, epoch_us(ts) AS us, user_id AS "user", event_type AS type, value FROM events)"""
