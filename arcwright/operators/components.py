"""Connected components of an undirected link table, in logarithmically many rounds in practice.

Large-star / small-star (Kiveris et al., 2014). Each star step is a partial-aggregated minimum per
node joined back to the links, so the links of a hub stay spread over tasks: the join has a plain
shuffled side that adaptive execution can split, and no task gathers a neighbourhood.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.session import discard, materialize

#: Residual link tables of at most this many rows are finished by union-find in one task.
FINISH_ROWS = 15_000


def connected_components(links: DataFrame, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """``(a, b)`` links -> ``(node, component)`` with the smallest reachable node as component.

    Only nodes with a link to another node are returned. Nulls in ``a`` or ``b`` and self links
    are ignored; repeated links and either direction of one link count once. An empty table
    gives an empty result.
    """
    links = materialize(_oriented(links.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    state = None
    while True:
        row = links.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        now = (row["n"], row["h"])
        if now == state or row["n"] == 0:
            break
        if row["n"] <= finish_rows:
            return _finish(links)
        state = now
        following = materialize(_small_star(_large_star(links)), "links")
        discard(links)
        links = following
    # Every link now runs from a node to the smallest node of its component.
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _oriented(links: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return (
        links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Connect each strictly larger neighbour of a node to the least node of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them."""
    links = _oriented(links)
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    return _oriented(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b")))


def _finish(links: DataFrame) -> DataFrame:
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:  # the smaller node is always the root
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"]
        )

    return links.coalesce(1).mapInArrow(unite, "node long, component long")
