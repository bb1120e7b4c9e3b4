"""Clouds over the star-schema tables, and the same as SQL for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.schema import cloud

#: Each cloud as a query of point_id, x, y, z (and more) over the tables.
SQL = {
    "pc_orders": """SELECT CAST(o_orderkey AS BIGINT) AS point_id, o_totalprice / CAST(10000 AS DOUBLE) AS x, o_custkey * CAST(0.1 AS DOUBLE) AS y,
 CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / CAST(100 AS DOUBLE) AS z FROM orders""",
    "pc_lineitem": """SELECT CAST(l_orderkey AS BIGINT) AS point_id, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / CAST(1000 AS DOUBLE) AS y,
 l_discount * CAST(100 AS DOUBLE) AS z FROM lineitem""",
    "pc_emb": """SELECT CAST(vec_id AS BIGINT) AS point_id, CAST(embedding[1] AS DOUBLE) * CAST(10 AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) * CAST(10 AS DOUBLE) AS y,
 CAST(embedding[3] AS DOUBLE) * CAST(10 AS DOUBLE) AS z, embedding AS features, label FROM embeddings""",
    "pc_frames": """SELECT CAST(0 AS BIGINT) AS sensor_id, CAST(date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) AS BIGINT) AS frame_id,
 CAST(event_id AS BIGINT) AS point_id, value / CAST(10 AS DOUBLE) AS x, CAST(user_id AS DOUBLE) / CAST(10 AS DOUBLE) AS y,
 CAST(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS DOUBLE) / CAST(3600 AS DOUBLE) AS z FROM events""",
    "pc_part": """SELECT CAST(p_partkey AS BIGINT) AS point_id, CAST(p_size AS DOUBLE) AS x, p_retailprice - CAST(900 AS DOUBLE) AS y,
 CAST(p_partkey % 100 AS DOUBLE) AS z FROM part""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / F.lit(100.0)
    return cloud(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice") / F.lit(10000.0), F.col("o_custkey") * F.lit(0.1), z)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", F.col("l_extendedprice") / F.lit(1000.0), F.col("l_discount") * F.lit(100.0))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") * F.lit(10.0) for i in range(3)]
    return cloud(table(spark, sf_dir, "embeddings"), "vec_id", *e, features="embedding", label="label")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("ts").cast("date").alias("first"))  # one row
    ts = F.col("ts")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    day = F.datediff(ts.cast("date"), F.col("first")).cast("long")
    rows = events.join(F.broadcast(first), F.lit(True))
    out = cloud(rows, "event_id", F.col("value") / F.lit(10.0), F.col("user_id").cast("double") / F.lit(10.0), seconds.cast("double") / F.lit(3600.0), frame_id=day)
    return out.select(F.lit(0).cast("long").alias("sensor_id"), "frame_id", "point_id", "x", "y", "z")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(table(spark, sf_dir, "part"), "p_partkey", "p_size", F.col("p_retailprice") - F.lit(900.0), F.col("p_partkey") % 100)
