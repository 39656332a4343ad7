from arcwright.operators import adjacency
from arcwright.session import TASK_ROWS, parts_for
from tests.test_graph import frame


def test_probes_are_dealt_by_rows(spark):
    """A task's rows stay as many when the tables grow: partitions follow the rows, not the session's number."""
    rows = 9 * TASK_ROWS
    assert parts_for(spark, rows) == 9 and parts_for(spark, 1) == 4
    edges = frame(spark, [(0, 1, 7), (0, 2, 8), (2, 1, 9), (40, 41, 5)])
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "src long, dst long")
    want = {(a, b): {(0, 1): (True, 7), (0, 2): (True, 8), (2, 1): (True, 9)}.get((a, b), (False, 0)) for a in range(4) for b in range(4)}
    for found in (adjacency.probe_edges(pairs, edges, rows), adjacency.probe_edges_by_scan(pairs, edges, rows)):
        assert {(r["src"], r["dst"]): (r["exists"], r["weight"]) for r in found.collect()} == want
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
