"""Edges laid out once for loops that send something along them in every round."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.session import discard, materialize

#: Edges of one node that stay together; a hub with more has them dealt over several parts.
HUB_EDGES = 1_000_000
#: Spark's switch for plans that change while they run.
_ADAPTS = "spark.sql.adaptive.enabled"


class Links:
    """``edges`` hash-dealt by their end ``by``, kept on the executors' disks across rounds.

    A round shuffles only what it sends: the kept table has the join's partitioning already. The
    edges of a hub lie in several parts, and what is sent to a hub is copied to each of them. A lost
    executor costs its partitions, which come again from the edges.
    """

    def __init__(self, edges: DataFrame, by: str = "src", to: str = "dst", hub_edges: int = HUB_EDGES):
        self.by = by
        counts = edges.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > hub_edges)
        self.hubs = materialize(counts.select(F.col(by).alias("_hub"), F.ceil(F.col("n") / hub_edges).cast("int").alias("_parts")), "hubs")
        dealt = edges.join(self.hubs, F.col(by) == F.col("_hub"), "left").withColumn(
            "_part", F.coalesce(F.pmod(F.xxhash64(to), F.col("_parts").cast("long")).cast("int"), F.lit(0))
        )
        conf = edges.sparkSession.conf
        kept = dealt.select(*edges.columns, "_part").repartition(int(conf.get("spark.sql.shuffle.partitions")), by, "_part")
        # A kept plan that adapts has no partitioning that a join could rely on.
        before = conf.get(_ADAPTS)
        conf.set(_ADAPTS, "false")
        try:
            self.table = kept.persist(StorageLevel.DISK_ONLY)
        finally:
            conf.set(_ADAPTS, before)

    def send(self, rows: DataFrame, node: str = "node") -> DataFrame:
        """The edges joined to ``rows`` whose ``node`` is their end."""
        parts = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        spread = rows.join(self.hubs, F.col(node) == F.col("_hub"), "left").select(*rows.columns, F.explode(parts).alias("_to"))
        return self.table.join(spread, (F.col(self.by) == F.col(node)) & (F.col("_part") == F.col("_to"))).drop("_part", "_to")

    def close(self) -> None:
        self.table.unpersist()
        discard(self.hubs)
