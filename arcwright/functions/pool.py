"""What a buffer pool of a given size would have read for a distance query.

The query's block requests in order - a node's record, then the blocks of its adjacency run, for
each node it expands - are replayed against least-recently-used pools. One task does it up to the
finisher's bound; beyond, the order of a breadth-first query comes level by level.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import OrderedDict, deque
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions.geometry import INTS_PER_BLOCK, NODES_PER_BLOCK
from arcwright.operators.links import Links
from arcwright.operators.local import FINISH_EDGES, Csr, in_one_task
from arcwright.operators.order import number_rows, running_sum
from arcwright.session import discard, materialize, scratch_path

CAPACITIES = (1, 4, 16, 64, 256, 1024)
#: Nodes of the trace that are replayed in one go.
PART_NODES = 1 << 15


def expanded(graph: Csr, source: int, target: int, weighted: bool) -> Iterator[int]:
    """Nodes in the order in which the query reads their neighbours."""
    if source == target:
        return
    if not weighted:
        seen, queue = {source}, deque([source])
        while queue:
            u = queue.popleft()
            yield u
            for v in graph.dst[graph.start[u] : graph.start[u + 1]]:
                if v == target:
                    return
                if v not in seen:
                    seen.add(v)
                    queue.append(v)
        return
    dist, done, heap = {source: 0}, set(), [(0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        if u == target:
            return
        done.add(u)
        yield u
        for k in range(graph.start[u], graph.start[u + 1]):
            v, through = graph.dst[k], d + graph.more[0][k]
            if through < dist.get(v, through + 1):
                dist[v] = through
                heapq.heappush(heap, (through, v))


def requests(graph: Csr, nodes: Iterator[int], stride: int) -> Iterator[tuple[str, int]]:
    for u in nodes:
        yield from blocks_of(u, graph.start[u] * stride, graph.start[u + 1] * stride)


def blocks_of(node: int, first: int, end: int) -> Iterator[tuple[str, int]]:
    """A node's record, and the blocks of its run of ints."""
    yield "node", node // NODES_PER_BLOCK
    for block in range(first // INTS_PER_BLOCK, (end - 1) // INTS_PER_BLOCK + 1) if end > first else ():
        yield "run", block


def replay(trace: list[tuple[str, int]], capacity: int) -> int:
    """Requests that a least-recently-used pool of ``capacity`` blocks does not hold."""
    pool: OrderedDict[tuple[str, int], None] = OrderedDict()
    read = 0
    for block in trace:
        if block in pool:
            pool.move_to_end(block)
            continue
        read += 1
        pool[block] = None
        if len(pool) > capacity:
            pool.popitem(last=False)
    return read


def breadth_first_order(edges: DataFrame, source: int, target: int) -> DataFrame:
    """``(node, at)``: the nodes that a distance query expands, in order from 0, by rounds over all edges.

    A level's nodes come in the order of the first node that found them, then of that edge in its run. The
    query ends at the first node with an edge to ``target``.
    """
    spark = edges.sparkSession
    path, schema = scratch_path(spark, "order"), "node long, at long"
    if source == target:
        return spark.createDataFrame([], schema)
    links = Links(edges.select("src", "dst", "ord"))
    frontier, placed = spark.createDataFrame([(source, 0)], schema), 1
    for number in count():
        frontier.write.parquet(f"{path}/round={number}")
        found = spark.read.schema(schema).parquet(path)
        frontier = spark.read.schema(schema).parquet(f"{path}/round={number}")
        reached = links.send(frontier).groupBy("dst").agg(F.min(F.struct("at", "ord")).alias("by"))
        reached = materialize(reached.select(F.col("dst").alias("node"), "by.at", "by.ord"), "reached")
        last = reached.filter(F.col("node") == target).select("at").first()
        fresh = reached.join(found.select("node"), "node", "left_anti")
        if last is not None or fresh.isEmpty():
            links.close()
            discard(reached)
            return found if last is None else found.filter(F.col("at") <= last["at"])
        ordered = number_rows(fresh, F.col("at").asc(), F.col("ord").asc(), name="place")
        frontier = materialize(ordered.select("node", (F.col("place") + (placed - 1)).alias("at")), "level")
        placed += frontier.count()
    raise AssertionError("the rounds have no end of their own")


def replay_in_parts(trace: DataFrame, stride: int, capacities: tuple[int, ...], part_nodes: int = PART_NODES) -> DataFrame:
    """``(capacity, requested, read)`` of a ``trace`` (at, node, first, degree), part by part.

    A pool holds the blocks asked for last, whatever was asked for before those: a part is replayed behind
    the part before it, whose nodes lie in more blocks than any pool holds.
    """
    part_nodes = max(part_nodes, NODES_PER_BLOCK * max(capacities))
    part = F.floor(F.col("at") / part_nodes)
    dealt = trace.withColumn("part", F.explode(F.array(part, part + 1)))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        at, node, first, degree = (rows.column(k).to_pylist() for k in ("at", "node", "first", "degree"))
        own = bisect_left(at, key[0].as_py() * part_nodes)
        out = []
        for c in capacities if own < len(at) else ():
            pool: OrderedDict[tuple[str, int], None] = OrderedDict()
            asked = read = 0
            for k in range(len(at)):
                for block in blocks_of(node[k], first[k] * stride, (first[k] + degree[k]) * stride):
                    asked += k >= own
                    if block in pool:
                        pool.move_to_end(block)
                        continue
                    read += k >= own
                    pool[block] = None
                    if len(pool) > c:
                        pool.popitem(last=False)
            out.append((c, asked, read))
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["capacity", "requested", "read"])

    counted = dealt.groupBy("part").applyInArrow(run, "capacity long, requested long, read long")
    every = trace.sparkSession.createDataFrame([(c,) for c in capacities], "capacity long")
    sums = counted.groupBy("capacity").agg(F.sum("requested").alias("requested"), F.sum("read").alias("read"))
    zero = F.lit(0).cast("long")
    return every.join(sums, "capacity", "left").select("capacity", *[F.coalesce(k, zero).alias(k) for k in ("requested", "read")])


def pool_sweep(
    n: int,
    edges: DataFrame,
    source: int,
    target: int,
    weighted: bool = False,
    capacities: tuple[int, ...] = CAPACITIES,
    finish_edges: int = FINISH_EDGES,
    part_nodes: int = PART_NODES,
) -> DataFrame:
    """``(capacity, requested, read)`` of a distance query for each pool size.

    One task does it for at most ``finish_edges`` edges. Beyond, breadth-first order goes by rounds and the
    replay by parts; the order of a weighted query is that of its queue, which one task has to keep.
    """
    if not weighted and edges.count() > finish_edges:
        order = breadth_first_order(edges, source, target)
        degs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
        nodes = edges.sparkSession.range(n).select(F.col("id").alias("node"))
        sized = nodes.join(degs, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
        starts = running_sum(sized, "node", {"first": "degree"})
        trace = materialize(order.join(starts, "node").select("at", "node", "first", "degree"), "trace")
        return materialize(replay_in_parts(trace, 1, capacities, part_nodes), "swept")

    def run(src, dst, weight, ord_):
        order = np.argsort(ord_, kind="stable")
        graph = Csr(n, src[order], dst[order], weight[order])
        trace = list(requests(graph, expanded(graph, source, target, weighted), 2 if weighted else 1))
        return list(capacities), [len(trace)] * len(capacities), [replay(trace, c) for c in capacities]

    return in_one_task(edges, ["src", "dst", "weight", "ord"], run, "capacity long, requested long, read long")
