"""Global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwright.session import materialize

#: Ids per block of a running sum over a dense id space.
BLOCK = 1 << 16


def number_rows(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with a 1-based row number in ``order``.

    Rows are dealt by range, numbered within their range, and shifted by the sizes of the ranges
    before it: a table with one row per range, at most the number of shuffle partitions.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        dealt.join(F.broadcast(shifts), "_part")
        .withColumn(name, (within + F.col("_shift")).cast("long"))
        .drop("_part", "_shift")
    )


def running_sum(df: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums by a dense integer ``key``: ``{new column: summed column}``.

    Blocks of keys are summed, the block sums are accumulated (one row per 65,536 ids), and each
    block accumulates within itself.
    """
    block = F.floor(F.col(key) / BLOCK).cast("long")
    rows = df.withColumn("_block", block)
    totals = rows.groupBy("_block").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, "_block")
    for k, v in sums.items():
        out = out.withColumn(k, (F.col(f"_s_{k}") + F.coalesce(F.sum(v).over(within), F.lit(0))).cast("long"))
    return out.drop("_block", *[f"_s_{k}" for k in sums])
