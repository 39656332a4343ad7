import numpy as np
import pytest

from arcwright.functions.pool import breadth_first_order, expanded, pool_sweep
from arcwright.operators.local import Csr
from tests.test_graph import frame, random_graph


@pytest.mark.parametrize("target", [199, 0, 250])
def test_sweep_by_rounds_is_that_of_one_task(spark, target):
    """Runs are in an order of their own; the last target is never reached."""
    edges = [e for e, _ in random_graph(200, 700, 2)]
    edges.sort(key=lambda e: (e[0] * 31 + e[1] * 17) % 101)
    df = frame(spark, edges)
    small, large = ((2, 8), {"finish_edges": 0, "part_nodes": 64})
    want = {tuple(r) for r in pool_sweep(260, df, 0, target, capacities=small).collect()}
    assert {tuple(r) for r in pool_sweep(260, df, 0, target, capacities=small, **large).collect()} == want


def test_breadth_first_order_by_rounds(spark):
    edges = [e for e, _ in random_graph(80, 200, 7)]
    graph = Csr(80, *(np.array(x) for x in zip(*edges, strict=True)))
    for target in (79, 40, 33):
        got = [r["node"] for r in breadth_first_order(frame(spark, edges), 0, target).orderBy("at").collect()]
        assert got == list(expanded(graph, 0, target, False))
