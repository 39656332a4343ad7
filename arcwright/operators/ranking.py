"""PageRank with dangling mass, rank order, score ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.operators.blocks import Blocks, dense_ids
from arcwright.operators.local import ARRAY_EDGES, in_one_task
from arcwright.operators.order import number_rows
from arcwright.session import discard, materialize

#: Digits on which scores are ordered; sums in another order differ only below them.
SCORE_DIGITS = 12


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    damping: float = 0.85,
    max_iterations: int = 100,
    tolerance: float = 1e-9,
    finish_edges: int = ARRAY_EDGES,
) -> tuple[DataFrame, int]:
    """``((node, pagerank), iterations)``; mass of nodes without out-edges is spread over all nodes.

    The edges are laid out once as blocks, and an iteration multiplies them by the vector of scores: what
    a task reads and holds is bounded, and only parts of vectors are shuffled. Mass of nodes without
    out-edges and the L1 change are summed block by block. At most ``finish_edges`` edges over as many
    dense ids are iterated on in one task.
    """
    n, own, ids = dense_ids(nodes, edges)
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("pagerank")), 0
    if ids is None and n <= finish_edges and edges.count() <= finish_edges:

        def run(src, dst):
            scores, k = power_iteration(n, src, dst, damping, max_iterations, tolerance)
            return np.arange(n), scores, np.full(n, k)

        done = in_one_task(edges, ["src", "dst"], run, "node long, pagerank double, rounds long")
        done = materialize(done, "pr-scores")
        return done.drop("rounds"), done.first()["rounds"]
    blocks = Blocks(own, n)

    def scored(score, out, old=None):
        share = np.divide(score, out, out=np.zeros(len(score)), where=out > 0)
        delta = 0.0 if old is None else float(np.abs(score - old).sum())
        return {"score": score, "out": out, "share": share, "held": float(score[out == 0].sum()), "total": float(score.sum()), "delta": delta}

    def degrees(first, at, flow):
        return scored(at["score"], at["out"] if flow is None else flow)

    state = blocks.start(
        {"score": "f8", "out": "i8", "share": "f8"},
        {"held": "double", "total": "double", "delta": "double"},
        lambda first, size: scored(np.full(size, 1.0 / n), np.zeros(size, np.int64)),
    )
    seen = {x: F.sum(x) for x in ("held", "total", "delta")}
    state, sums = blocks.round(state, [], lambda start, end, w, size: np.bincount(end, minlength=size), np.add, degrees, back=True, seen=seen)
    iterations = 0
    for iterations in range(1, max_iterations + 1):
        base = (1.0 - damping) / n + damping / n * sums["held"]

        def update(first, at, flow, base=base):
            return scored(np.full(len(at["out"]), base) if flow is None else base + damping * flow, at["out"], at["score"])

        state, sums = blocks.round(state, ["share"], _flow_along, np.add, update, seen=seen)
        if sums["delta"] < tolerance:
            break
    blocks.close()
    total = sums["total"]
    scores = blocks.table_of(state, lambda first, at: (np.arange(first, first + len(at["out"])), at["score"] / total), "node long, pagerank double")
    discard(state)
    if ids is not None:
        scores = ids.join(scores.withColumnRenamed("node", "id"), "id").select("node", "pagerank")
    return scores, iterations


def _flow_along(start: np.ndarray, end: np.ndarray, weight: None, size: int, share: np.ndarray) -> np.ndarray:
    return np.bincount(end, weights=share[start], minlength=size)


def power_iteration(
    n: int, src: np.ndarray, dst: np.ndarray, damping: float, max_iterations: int, tolerance: float
) -> tuple[np.ndarray, int]:
    """The same iteration over arrays."""
    out = np.bincount(src, minlength=n)
    share = 1.0 / out[src]
    scores, k = np.full(n, 1.0 / n), 0
    for k in range(1, max_iterations + 1):
        flow = np.bincount(dst, weights=scores[src] * share, minlength=n)
        following = (1.0 - damping) / n + damping / n * scores[out == 0].sum() + damping * flow
        delta, scores = np.abs(following - scores).sum(), following
        if delta < tolerance:
            break
    return scores / scores.sum(), k


def rounded(score: str | Column = "pagerank") -> Column:
    return F.round(score, SCORE_DIGITS)


def rank_order(scores: DataFrame) -> DataFrame:
    """``scores`` with a 1-based ``rank``: by falling score, ties by rising node."""
    return number_rows(scores, rounded().desc(), F.col("node").asc(), name="rank")


def rank_list(ranked: DataFrame, first: int, last: int) -> DataFrame:
    return ranked.filter(F.col("rank").between(first, last)).select("rank", "node", "pagerank").orderBy("rank")


def score_range(scores: DataFrame, low: float, high: float, limit: int = 1000) -> DataFrame:
    """The ``limit`` lowest scores in the closed range, listed from the highest down."""
    kept = scores.filter(F.col("pagerank").between(low, high)).orderBy("pagerank", "node").limit(limit)
    return kept.select("node", "pagerank").orderBy(F.col("pagerank").desc(), F.col("node").desc())


def join_ranges(ranges: DataFrame, scores: DataFrame, width: float) -> DataFrame:
    """``ranges`` (low, high) joined to the ``scores`` (pagerank) with low <= score < high.

    Both sides go to bins of ``width``, a range to every bin that it meets, so the join is an
    equi-join on bins; the bounds decide within one. Null bounds or scores meet nothing.
    """

    def bin_of(x: str) -> Column:
        return F.floor(F.col(x) / width)

    binned = ranges.filter("low < high").withColumn("_bin", F.explode(F.sequence(bin_of("low"), bin_of("high"))))
    placed = scores.withColumn("_score_bin", bin_of("pagerank"))
    met = binned.join(placed, F.col("_bin") == F.col("_score_bin"))
    return met.filter((F.col("pagerank") >= F.col("low")) & (F.col("pagerank") < F.col("high"))).drop("_bin", "_score_bin")
