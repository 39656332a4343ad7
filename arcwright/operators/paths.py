"""Single-source distances: breadth-first and weighted, and the nearest nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.operators.blocks import Blocks, dense_ids
from arcwright.operators.local import FINISH_EDGES, Csr, dijkstra, in_one_task
from arcwright.session import discard, materialize

#: Farther than any node; a weight on top of it still fits.
FAR = 1 << 62
#: Ids up to so many times the edges are taken as they are; with larger ones, the nodes are numbered.
SPARE = 4


def distances(
    edges: DataFrame,
    source: int,
    weighted: bool = False,
    target: int | None = None,
    finish_edges: int = FINISH_EDGES,
    nearest_k: int | None = None,
) -> DataFrame:
    """``(node, distance)`` of every node that ``source`` reaches along out-edges, itself at 0.

    The edges beyond ``finish_edges`` are relaxed in rounds: each is a product of the blocks of edges with the
    distances that just fell, and the least sum per node is kept where it is an improvement. A round is
    the last if ``target`` can no longer improve, or if ``nearest_k`` nodes besides the source are
    nearer than what just fell, and so final. Fewer edges go to one task.
    """
    weight = F.col("weight") if weighted else F.lit(1).cast("long")
    edges = edges.select("src", "dst", weight.alias("weight"))
    many = edges.count()
    if many <= finish_edges:

        def run(src, dst, weight):
            top = max([source, *(int(a.max()) for a in (src, dst) if len(a))])
            return dijkstra(Csr(top + 1, src, dst, weight), source)

        return in_one_task(edges, ["src", "dst", "weight"], run, "node long, distance long")
    spark = edges.sparkSession
    ends = edges.agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high")).first()
    low, high = (f(x for x in (source, bound) if x is not None) for f, bound in ((min, ends["low"]), (max, ends["high"])))
    if low >= 0 and high <= SPARE * max(many, 1000):
        n, ids = high + 1, None
    else:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).union(spark.createDataFrame([(source,)], "node long")).distinct()
        n, edges, ids = dense_ids(materialize(nodes, "ends"), edges)
        if ids is not None:
            own = {r["node"]: r["id"] for r in ids.filter(F.col("node").isin(source, source if target is None else target)).collect()}
            source, target = own[source], None if target is None else own.get(target)
    blocks = Blocks(edges, n, weighted)

    def values(dist, fell, first):
        here = target is not None and first <= target < first + len(dist)
        front = int(dist[fell].min()) if fell.any() else FAR
        return {"dist": dist, "sent": np.where(fell, dist, FAR), "moved": int(fell.sum()), "front": front, "at": int(dist[target - first]) if here else FAR}

    def begin(first, size):
        dist = np.where(np.arange(first, first + size) == source, 0, FAR)
        return values(dist, dist == 0, first)

    def relax(first, at, flow):
        fell = np.zeros(len(at["dist"]), bool) if flow is None else flow < at["dist"]
        return values(np.where(fell, flow, at["dist"]) if fell.any() else at["dist"], fell, first)

    seen = {"moved": F.sum("moved"), "front": F.min("front"), "at": F.min("at")}
    state = blocks.start({"dist": "i8", "sent": "i8"}, {"moved": "long", "front": "long", "at": "long"}, begin)
    now = {"moved": 1, "front": 0, "at": FAR}
    while now["moved"] and not (target is not None and now["at"] <= now["front"]):
        if nearest_k is not None and _nearer(blocks, state, now["front"]) > nearest_k:
            break
        state, now = blocks.round(state, ["sent"], _through, np.minimum, relax, only=F.col("moved") > 0, seen=seen)
    blocks.close()
    found = blocks.table_of(state, _reached, "node long, distance long")
    discard(state)
    if ids is not None:
        found = found.withColumnRenamed("node", "id").join(ids, "id").select("node", "distance")
    return found


def _through(start: np.ndarray, end: np.ndarray, weight: np.ndarray | None, size: int, sent: np.ndarray) -> np.ndarray | None:
    through = sent[start]
    own = np.flatnonzero(through < FAR)
    if not len(own):
        return None
    out = np.full(size, FAR)
    np.minimum.at(out, end[own], through[own] + (1 if weight is None else weight[own]))
    return out


def _reached(first: int, at: dict) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(at["dist"] < FAR)
    return own + first, at["dist"][own]


def _nearer(blocks: Blocks, state: DataFrame, front: int) -> int:
    """Nodes nearer than ``front``: sums through what just fell are ``front`` at least."""
    counts = blocks.table_of(state, lambda first, at: (np.array([(at["dist"] < front).sum()]),), "n long")
    n = counts.agg(F.sum("n")).first()[0]
    discard(counts)
    return n


def shortest_distance(edges: DataFrame, source: int, target: int, weighted: bool = False, **options) -> int:
    """Hops or summed weight; 0 if the nodes are one, -1 without a path."""
    if source == target:
        return 0
    row = distances(edges, source, weighted, target, **options).filter(F.col("node") == target).first()
    return -1 if row is None else row["distance"]


def nearest(edges: DataFrame, source: int, k: int, weighted: bool = False, **options) -> DataFrame:
    """The ``k`` nodes nearest to ``source``, itself left out, by distance, then node."""
    found = distances(edges, source, weighted, nearest_k=k, **options)
    return found.filter(F.col("node") != source).orderBy("distance", "node").limit(k)
