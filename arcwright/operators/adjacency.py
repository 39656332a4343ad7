"""Degrees, CSR offsets, adjacency and edge probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwright.operators.order import running_sum
from arcwright.session import materialize, parts_for, settings


def node_range(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, in_deg, out_deg)``: one pass over the edges counts both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                          F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy("e.node").agg(F.sum("e.i").alias("in_deg"), F.sum("e.o").alias("out_deg"))
    return nodes.join(counts, "node", "left").select(
        "node",
        F.coalesce("in_deg", F.lit(0)).cast("long").alias("in_deg"),
        F.coalesce("out_deg", F.lit(0)).cast("long").alias("out_deg"),
    )


def csr_offsets(degs: DataFrame, stride: int = 1) -> DataFrame:
    """Start of each node's run in the outgoing and incoming adjacency; ``stride`` ints per neighbour."""
    sized = degs.withColumns({"_o": F.col("out_deg") * stride, "_i": F.col("in_deg") * stride})
    return running_sum(sized, "node", {"out_start": "_o", "in_start": "_i"}).drop("_o", "_i")


def adjacency_positions(edges: DataFrame, order: str = "ord") -> DataFrame:
    """``edges`` with their 1-based positions in the runs of their source and target."""
    return edges.withColumns(
        {
            "out_pos": F.row_number().over(Window.partitionBy("src").orderBy(order, "dst")).cast("long"),
            "in_pos": F.row_number().over(Window.partitionBy("dst").orderBy(order, "src")).cast("long"),
        }
    )


def out_neighbors(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("neighbor"), "weight")


def in_neighbors(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("dst") == node).select(F.col("src").alias("neighbor"), "weight")


def adjacency_lists(edges: DataFrame, by: str = "src") -> DataFrame:
    """``(node, neighbors)``: the sorted run of ``(neighbor, weight)`` of every node with one."""
    other = "dst" if by == "src" else "src"
    return edges.groupBy(F.col(by).alias("node")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(other).alias("neighbor"), "weight"))).alias("neighbors")
    )


def probe_edges(probes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``probes`` (src, dst) with ``exists`` and ``weight``: one equi-join on both keys.

    With ``rows``, about as many as both tables have, they are dealt to partitions counted by rows; no key
    is frequent, as an edge is there once.
    """
    found = edges.select("src", "dst", "weight", F.lit(True).alias("exists"))
    if rows is not None:
        parts = parts_for(edges.sparkSession, rows)
        probes, found = (x.repartition(parts, "src", "dst") for x in (probes, found))
    return probes.join(found, ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("exists", F.lit(False)).alias("exists"), F.coalesce("weight", F.lit(0).cast("long")).alias("weight")
    )


def probe_edges_by_scan(probes: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """The same answer from the whole adjacency run of each probed source.

    The runs are picked by source, then met edge by edge: a hub's run is neither gathered into one
    row nor copied for each of its probes.
    """
    sources = probes.select("src").distinct()
    if rows is None:
        return probe_edges(probes, edges.join(sources, "src", "left_semi"))
    spark = edges.sparkSession
    # Partitions are counted by rows here too, and adaptive execution splits those of a hub.
    with settings(spark, {"spark.sql.shuffle.partitions": str(parts_for(spark, rows))}):
        sources = materialize(sources, "sources")
        runs = materialize(edges.join(sources, "src", "left_semi"), "runs")
    return probe_edges(probes, runs, rows)
