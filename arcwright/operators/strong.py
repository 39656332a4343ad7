"""Strongly connected components and cycle statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.operators.blocks import Blocks, dense_ids
from arcwright.operators.components import FINISH_ROWS, connected_components
from arcwright.operators.local import ARRAY_EDGES, depth_first, in_one_task, least_member
from arcwright.operators.order import number_rows
from arcwright.session import discard, materialize, parts_for, settings


def weak_components(nodes: DataFrame, edges: DataFrame, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """``(node, wcc_id)``: components are numbered by their smallest node; lone nodes are components."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), finish_rows)
    rooted = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    numbers = number_rows(rooted.filter("node = root").select("root"), F.col("root").asc(), name="n")
    return rooted.join(numbers, "root").select("node", (F.col("n") - 1).alias("wcc_id"))


def strong_roots(nodes: DataFrame, edges: DataFrame, finish_edges: int = ARRAY_EDGES) -> DataFrame:
    """``(node, scc_root)``: the smallest node of each node's strongly connected component.

    While the edges are many: nodes without an in- or out-edge are components of their own and go;
    the least node that reaches a node becomes its colour; what a colour's own node is reached from
    within its colour is that node's component. Edges inside the rest go round again. A round is a
    product with the blocks of edges. A residue of at most ``finish_edges`` edges goes to one
    depth-first task.
    """
    n, edges, ids = dense_ids(nodes, edges.select("src", "dst").filter("src <> dst"))
    edges = materialize(edges.select("src", "dst"), "scc-edges")
    settled: list[DataFrame] = []
    while (many := edges.count()) > finish_edges and many:
        blocks = Blocks(edges, n)
        state = _reached_back(blocks, _coloured(blocks))
        settled.append(blocks.table_of(state, _marked, "node long, scc_root long"))
        # Only edges within one colour can lie on a cycle.
        left = blocks.edges_where(state, "left", lambda a, b: (a == b) & (a >= 0))
        for done in (state, edges):
            discard(done)
        blocks.close()
        edges = left
    if many:

        def run(src, dst):
            used, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
            src, dst = ends[: len(src)], ends[len(src) :]
            start = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=len(used)))))
            comp, _ = depth_first(start, dst[np.argsort(src, kind="stable")])
            return used, used[least_member(comp)]

        settled.append(in_one_task(edges, ["src", "dst"], run, "node long, scc_root long"))
    out = nodes.select("node")
    if not settled:
        return out.select("node", F.col("node").alias("scc_root"))
    found = settled[0]
    for more in settled[1:]:
        found = found.union(more)
    if ids is not None:
        root = ids.toDF("_root", "_id")
        found = found.toDF("id", "_id").join(ids, "id").join(root, "_id").select("node", F.col("_root").alias("scc_root"))
    return out.join(found, "node", "left").select("node", F.coalesce("scc_root", "node").alias("scc_root"))


#: No colour yet.
NONE = np.iinfo(np.int64).max


def _coloured(blocks: Blocks) -> DataFrame:
    """A vector with the ``colour`` of each ``inner`` node, one with edges in and out: the least inner node that reaches it."""

    def values(inner, colour, moved, marked=None):
        marked = np.zeros(len(inner), bool) if marked is None else marked
        return _values(inner, colour, marked, moved)

    def ends(start, end, weight, size):
        return np.bincount(end, minlength=size)

    def with_out(first, at, flow):
        return values(at["inner"] if flow is None else flow > 0, at["colour"], 0)

    def with_in(first, at, flow):
        inner = (at["inner"] > 0) & (False if flow is None else flow > 0)
        own = np.arange(first, first + len(inner))
        return values(inner, np.where(inner, own, NONE), inner.sum())

    def fallen(first, at, flow):
        falls = (at["inner"] > 0) & (False if flow is None else flow < at["colour"])
        return values(at["inner"], np.where(falls, at["colour"] if flow is None else flow, at["colour"]), falls.sum())

    state = blocks.start(
        {"colour": "i8", "inner": "i1", "reach": "i8", "left": "i8"}, {"moved": "long"},
        lambda first, size: values(np.zeros(size, bool), np.full(size, NONE), 0),
    )
    seen = {"moved": F.sum("moved")}
    state, _ = blocks.round(state, [], ends, np.add, with_out, back=True)
    state, moved = blocks.round(state, [], ends, np.add, with_in, seen=seen)
    while moved["moved"]:
        state, moved = blocks.round(state, ["colour"], _least, np.minimum, fallen, only=F.col("moved") > 0, seen=seen)
    return state


def _values(inner, colour, marked, moved) -> dict:
    """``reach`` has the colour of marked nodes, ``left`` that of the inner rest."""
    inner = np.asarray(inner) > 0
    reach, left = np.where(marked, colour, -1), np.where(inner & ~marked, colour, -1)
    return {"colour": colour, "inner": inner, "reach": reach, "left": left, "moved": int(moved)}


def _least(start: np.ndarray, end: np.ndarray, weight: None, size: int, colour: np.ndarray) -> np.ndarray:
    out = np.full(size, NONE)
    np.minimum.at(out, end, colour[start])
    return out


def _greatest(start: np.ndarray, end: np.ndarray, weight: None, size: int, reach: np.ndarray) -> np.ndarray:
    out = np.full(size, -1)
    np.maximum.at(out, end, reach[start])
    return out


def _reached_back(blocks: Blocks, state: DataFrame) -> DataFrame:
    """The vector with those inner nodes marked from which their colour's own node is reached within the colour.

    A node's colour is none below that of the nodes that it has edges to; so the greatest colour of the marked
    ones among them tells whether one has its own.
    """

    def mark(first, at, flow):
        inner, marked = at["inner"] > 0, at["reach"] >= 0
        met = (np.arange(first, first + len(inner)) if flow is None else flow) == at["colour"]
        fresh = inner & ~marked & met
        return _values(inner, at["colour"], marked | fresh, fresh.sum())

    def begin(first, at, flow):
        return mark(first, at, None)

    def go_on(first, at, flow):
        return mark(first, at, np.full(len(at["inner"]), -1) if flow is None else flow)

    seen = {"moved": F.sum("moved")}
    nothing = lambda start, end, weight, size: None
    state, moved = blocks.round(state, [], nothing, np.add, begin, seen=seen)
    while moved["moved"]:
        state, moved = blocks.round(state, ["reach"], _greatest, np.maximum, go_on, back=True, only=F.col("moved") > 0, seen=seen)
    return state


def _marked(first: int, at: dict) -> tuple[np.ndarray, np.ndarray]:
    own = np.flatnonzero(at["reach"] >= 0)
    return own + first, at["reach"][own]


def number_strong(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, scc_id)`` in reverse topological order, for a graph above the one-task bound.

    A component's level is the longest way to a sink; ids rise by level, then by smallest node, so
    an edge between components runs from the higher id to the lower. One round per level.
    """
    across = materialize(
        edges.join(roots.toDF("src", "a"), "src").join(roots.toDF("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct(),
        "condensation",
    )
    level = materialize(roots.select(F.col("scc_root").alias("root"), F.lit(0).alias("level")).distinct(), "level")
    while True:
        need = across.join(level, F.col("b") == F.col("root")).groupBy("a").agg((F.max("level") + 1).alias("need"))
        following = materialize(
            level.join(need, F.col("root") == F.col("a"), "left").select(
                "root", F.greatest("level", "need").alias("level"), (F.coalesce("need", "level") > F.col("level")).alias("moved")
            ),
            "level",
        )
        discard(level)
        level = following.drop("moved")
        if following.filter("moved").isEmpty():
            break
    numbers = number_rows(level, F.col("level").asc(), F.col("root").asc(), name="n")
    return roots.join(numbers, F.col("scc_root") == F.col("root")).select("node", (F.col("n") - 1).alias("scc_id"))


def depth_first_forest(n: int, edges: DataFrame) -> DataFrame:
    """``(node, scc_id, back_edges)`` of the sequential forest over ``ord``-sorted edges.

    Depth-first order is sequential, so one task walks; the edges are sorted by source and ``ord``, and packed
    to four bytes each, in many tasks before. The one task holds those and some numbers per node.
    """
    spark = edges.sparkSession
    kind = np.dtype(np.int32 if n < 1 << 31 else np.int64)
    parts = parts_for(spark, edges.count())
    width = max(1, -(-n // parts))

    def pack(batches):
        held = list(batches)
        if not held:
            return
        src, dst, ord_ = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in range(3))
        order = np.lexsort((ord_, src))
        src, dst = src[order], dst[order].astype(kind)
        at, first = np.unique(src // width, return_index=True)
        for b, x, y in zip(at.tolist(), first.tolist(), [*first[1:].tolist(), len(src)], strict=True):
            counts = np.bincount(src[x:y] - b * width, minlength=width)
            columns = [pa.array([b]), pa.array([y - x]), pa.array([counts.tobytes()], pa.binary()), pa.array([dst[x:y].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "edges", "counts", "dst"])

    rows = edges.select("src", "dst", "ord").repartition(parts, F.floor(F.col("src") / width))
    packed = materialize(rows.mapInArrow(pack, "block long, edges long, counts binary, dst binary"), "runs")
    sizes = {r["block"]: r["edges"] for r in packed.select("block", "edges").collect()}
    first, total = {}, 0
    for b in sorted(sizes):
        first[b], total = total, total + sizes[b]

    def walk(batches):
        dst, start = np.empty(total, kind), np.zeros(n + 1, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.column(0)[k].as_py()
                dst[first[b] : first[b] + sizes[b]] = np.frombuffer(batch.column(2)[k].as_buffer(), kind)
                own = start[b * width + 1 : (b + 1) * width + 1]
                own[:] = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)[: len(own)]
        np.cumsum(start, out=start)
        comp, back = depth_first(start, dst)
        for a in range(0, n, 1 << 20):
            part = comp[a : a + (1 << 20)]
            columns = [np.arange(a, a + len(part)), part, np.full(len(part), back)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "scc_id", "back_edges"])

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        forest = packed.select("block", "counts", "dst").coalesce(1).mapInArrow(walk, "node long, scc_id long, back_edges long")
        forest = materialize(forest, "forest")
    discard(packed)
    return forest


def component_sizes(labels: DataFrame, label: str) -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("size"))


def size_summary(sizes: DataFrame) -> DataFrame:
    """``(components, largest)``; 0 and 0 without any."""
    return sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("size"), F.lit(0).cast("long")).alias("largest"))


def cycle_stats(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(nodes_on_cycles, is_dag)``: nodes in components of two or more, plus self-loops."""
    on = component_sizes(roots, "scc_root").agg(F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).alias("n"))
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    return on.crossJoin(loops).select(
        (F.col("n") + F.col("loops")).cast("long").alias("nodes_on_cycles"), (F.col("n") + F.col("loops") == 0).alias("is_dag")
    )
