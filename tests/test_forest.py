import random

import numpy as np

from arcwright.operators import strong
from arcwright.operators.local import depth_first
from tests.test_graph import frame


def recursive(n, out):
    """The forest as written in books: entries, the path, components in the order in which they close."""
    entered, on, comp, low, waiting, state = {}, set(), {}, {}, [], {"back": 0, "closed": 0}

    def go(u):
        entered[u] = low[u] = len(entered)
        on.add(u)
        waiting.append(u)
        for v in out.get(u, ()):
            if v not in entered:
                go(v)
                low[u] = min(low[u], low[v])
            else:
                state["back"] += v in on
                if v not in comp:
                    low[u] = min(low[u], entered[v])
        on.discard(u)
        if low[u] == entered[u]:
            while True:
                v = waiting.pop()
                comp[v] = state["closed"]
                if v == u:
                    break
            state["closed"] += 1

    for v in range(n):
        if v not in entered:
            go(v)
    return [comp[v] for v in range(n)], state["back"]


def test_forest_over_arrays_is_the_recursive_one():
    for seed in range(60):
        rng = random.Random(seed)
        n, m = rng.randint(1, 60), rng.randint(0, 150)
        out = {}
        for _ in range(m):
            out.setdefault(rng.randrange(n), []).append(rng.randrange(n))
        start = np.concatenate(([0], np.cumsum([len(out.get(v, ())) for v in range(n)])))
        dst = np.array([w for v in range(n) for w in out.get(v, ())], np.int32)
        comp, back = depth_first(start, dst)
        assert (comp.tolist(), back) == recursive(n, out)


def test_forest_holds_four_bytes_an_edge(spark):
    """Runs come sorted and packed from many tasks, in any order of the files."""
    rng = random.Random(5)
    edges = list({(rng.randrange(300), rng.randrange(300)): 1 for _ in range(900)})
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, []).append(b)
    df = frame(spark, [(a, b) for a, b in edges if a != b]).repartition(7)
    comp, back = recursive(300, out)
    rows = strong.depth_first_forest(300, df).collect()
    assert {r["node"]: r["scc_id"] for r in rows} == dict(enumerate(comp)) and {r["back_edges"] for r in rows} == {back}
