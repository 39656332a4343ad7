"""The graph projected from the test tables.

Parts are nodes; a line item runs from its part to the part numbered by its order, with the least
quantity as weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.session import materialize, parts_for, settings
from arcwright.sources.edgelist import edges_from_table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges before cleaning: self-loops and duplicates are still there."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    return items.select(
        F.col("l_partkey").alias("src"),
        (F.col("l_orderkey") % F.lit(parts)).alias("dst"),
        F.floor("l_quantity").cast("long").alias("weight"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_from_table(raw_edges(spark, sf_dir), "src", "dst", F.col("weight"))


def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges written once, for queries that read them again and again."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    with settings(spark, {"spark.sql.shuffle.partitions": str(parts_for(spark, rows))}):
        return materialize(edges(spark, sf_dir), "graph-edges")


#: The same graph as DuckDB common table expressions.
SQL = """
raw AS (SELECT l_partkey AS src, l_orderkey % (SELECT count(*) FROM part) AS dst, CAST(floor(l_quantity) AS BIGINT) AS weight
        FROM lineitem),
n AS (SELECT p_partkey AS node FROM part),
dense AS (SELECT src, dst, min(weight) AS weight FROM raw WHERE src <> dst GROUP BY 1, 2)"""
