import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright.operators import paths, ranking, strong
from arcwright.operators.blocks import Blocks
from tests.test_graph import bellman, frame, plain_pagerank, random_graph


def total(got, flow):
    return got if flow is None else got + flow


@pytest.mark.parametrize("back", [False, True])
def test_a_round_is_a_product_with_the_matrix(spark, back):
    """Over many blocks, with a hub whose cell is cut into parts."""
    n = 1000
    edges = random_graph(n, 3000, 4) + [((7, k), k % 300) for k in range(300, 520)]
    edges = list(dict(edges).items())
    blocks = Blocks(frame(spark, [(a, b, w) for (a, b), w in edges]), n, weighted=True, bits=7, cell_edges=20)
    assert blocks.count == 8 and blocks.layout.agg(F.max("parts")).first()[0] > 1
    x = np.arange(n) % 17 + 1.0
    state = blocks.start({"x": "f8"}, {"most": "double"}, lambda first, size: {"x": x[first : first + size], "most": 0.0})
    state, seen = blocks.round(
        state, ["x"], lambda a, b, w, size, x: np.bincount(b, weights=x[a] * w, minlength=size), np.add,
        lambda first, at, flow: {"x": total(0 * at["x"], flow), "most": float(total(0 * at["x"], flow).max())},
        back=back, seen={"most": F.max("most")},
    )
    want = np.zeros(n)
    for (a, b), w in edges:
        want[a if back else b] += x[b if back else a] * w
    got = {r["node"]: r["x"] for r in blocks.table_of(state, lambda first, at: (np.arange(first, first + len(at["x"])), at["x"]), "node long, x double").collect()}
    blocks.close()
    assert got == dict(enumerate(want)) and seen["most"] == want.max()


def test_rounds_shuffle_parts_of_vectors_not_edges(spark):
    """What a round exchanges has a row per cell or block, and nothing lies between the kept cells and their join."""
    blocks = Blocks(frame(spark, [e for e, _ in random_graph(400, 5000, 1)]), 400, bits=8)
    assert blocks.table.count() == blocks.parts.count() == 4
    with_vector = blocks._sent(spark.range(2).select(F.col("id").cast("int").alias("block"), F.lit(b"").alias("x")), ["x"], False, None)
    plan = with_vector._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan
    blocks.close()


def test_pagerank_of_nodes_with_gaps(spark):
    edges = [e for e, _ in random_graph(12, 20, 3)]
    far = lambda v: 10 + v * 10**9
    nodes = spark.range(12).select((F.col("id") * 10**9 + 10).alias("node"))
    scores, _ = ranking.pagerank(nodes, frame(spark, [(far(a), far(b)) for a, b in edges]), max_iterations=12)
    want, _ = plain_pagerank(12, edges, rounds=12)
    assert {r["node"]: r["pagerank"] for r in scores.collect()} == pytest.approx({far(v): s for v, s in enumerate(want)}, abs=1e-12)


@pytest.mark.parametrize("gap", [1, 10**9])
def test_distances_over_several_blocks(spark, gap):
    """Ids as they are, and ids too far apart for blocks of their own."""
    edges = random_graph(700, 2500, 8)
    df = frame(spark, [(a * gap, b * gap, w) for (a, b), w in edges])
    got = {r["node"]: r["distance"] for r in paths.distances(df, 5 * gap, True, finish_edges=0).collect()}
    assert got == {v * gap: d for v, d in bellman(edges, 5).items()}
    assert paths.shortest_distance(df, 5 * gap, 6 * gap, True, finish_edges=0) == bellman(edges, 5).get(6, -1)


def test_strong_components_over_several_blocks(spark):
    """Two rounds at least: a source-only node below, a small component behind another's colour, gaps between ids."""
    rng = np.random.default_rng(2)
    edges = [(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 3)] + [(int(a), int(b)) for a, b in rng.integers(5, 600, (650, 2)) if a != b]
    far = strong.strong_roots(spark.range(600).select((F.col("id") * 5).alias("node")), frame(spark, [(a * 5, b * 5) for a, b in edges]), 0)
    near = strong.strong_roots(spark.range(600).select(F.col("id").alias("node")), frame(spark, edges))
    want = {r["node"]: r["scc_root"] for r in near.collect()}
    assert {r["node"] // 5: r["scc_root"] // 5 for r in far.collect()} == want and want[4] == 3 and want[2] == 1
