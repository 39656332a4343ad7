import random

import numpy as np
import pytest

from arcwright.functions.geometry import hash_capacity
from arcwright.functions.hashing import edge_hashes, probe_table
from tests.test_graph import frame


def one_by_one(edges, capacity):
    taken, out = set(), {}
    homes = edge_hashes(np.array([a for a, _ in edges]), np.array([b for _, b in edges])).tolist()
    for (a, b), home in zip(edges, homes, strict=True):
        at, n = home & (capacity - 1), 1
        while at in taken:
            at, n = (at + 1) & (capacity - 1), n + 1
        taken.add(at)
        out[a, b] = (at, n)
    return out


@pytest.mark.parametrize("slots", [4, 16, 1 << 20])
def test_runs_across_blocks_fill_as_one_by_one(spark, slots):
    """Many blocks are whole runs of taken slots, and some runs go round the end."""
    rng = random.Random(slots)
    # A load of 0.75 to the last edge, crowded at the end, in an order that is not that of the keys.
    pairs = list({(rng.randrange(9000), rng.randrange(9000)): 1 for _ in range(3000)})
    home = edge_hashes(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])) & 511
    edges = [e for e, h in zip(pairs, home.tolist(), strict=True) if h >= 500][:40]
    edges = rng.sample(edges + [e for e in pairs if e not in edges][: 383 - len(edges)], 383)
    assert hash_capacity(383) == 512
    rows = probe_table(frame(spark, edges), 383, slots).collect()
    assert {(r["src"], r["dst"]): (r["slot"], r["probes"]) for r in rows} == one_by_one(edges, 512)


def test_no_edges(spark):
    assert probe_table(frame(spark, [(1, 2)]).limit(0), 0).count() == 0
