import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwright.functions.geometry import hash_capacity, hash_capacity_column, index_geometry
from arcwright.functions.hashing import edge_hashes, lookup_probes, murmur3, probe_table
from arcwright.operators import adjacency, paths, ranking, strong
from arcwright.operators.components import connected_components
from arcwright.operators.links import Links


def frame(spark, edges):
    rows = [(a, b, w[0] if w else 1, k) for k, (a, b, *w) in enumerate(edges)]
    return spark.createDataFrame(rows, "src long, dst long, weight long, ord long")


def nodes(spark, n):
    return adjacency.node_range(spark, n)


def random_graph(n, m, seed, top=9):
    rng = random.Random(seed)
    return sorted({(a, b): rng.randint(0, top) for _ in range(m) if (a := rng.randrange(n)) != (b := rng.randrange(n))}.items())


def reach(n, edges):
    out = {v: {v} for v in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for seen in out.values():
                if a in seen and b not in seen:
                    seen.add(b)
                    changed = True
    return out


def bellman(edges, source):
    dist = {source: 0}
    for _ in range(len(edges) + 1):
        for (a, b), w in edges:
            if a in dist and dist[a] + w < dist.get(b, 1 << 60):
                dist[b] = dist[a] + w
    return dist


@pytest.mark.parametrize("finish", [0, 10**6])
def test_components_against_closure(spark, finish):
    for seed in range(2):
        edges = [e for e, _ in random_graph(40, 30, seed)]
        links = spark.createDataFrame(edges, "a long, b long")
        got = {r["node"]: r["component"] for r in connected_components(links, finish).collect()}
        near = reach(40, edges + [(b, a) for a, b in edges])
        assert got == {v: min(near[v]) for v in range(40) if len(near[v]) > 1}


def test_components_ignore_nulls_loops_and_empty(spark):
    links = spark.createDataFrame([(1, None), (2, 2), (5, 4), (4, 5)], "a long, b long")
    assert {tuple(r) for r in connected_components(links).collect()} == {(4, 4), (5, 4)}
    assert connected_components(links.limit(0)).count() == 0


@pytest.mark.parametrize("finish", [0, 10**6])
def test_strong_components_against_closure(spark, finish):
    edges = [e for e, _ in random_graph(18, 30, 5)]
    far = reach(18, edges)
    want = {v: min(u for u in far[v] if v in far[u]) for v in range(18)}
    roots = strong.strong_roots(nodes(spark, 18), frame(spark, edges), finish)
    assert {r["node"]: r["scc_root"] for r in roots.collect()} == want


def test_component_ids_are_reverse_topological(spark):
    edges = [e for e, _ in random_graph(18, 30, 6)]
    df, ns = frame(spark, edges), nodes(spark, 18)
    roots = strong.strong_roots(ns, df)
    for ids in (strong.number_strong(roots, df), strong.depth_first_forest(18, df)):
        got = {r["node"]: r["scc_id"] for r in ids.collect()}
        root = {r["node"]: r["scc_root"] for r in roots.collect()}
        assert all(got[a] > got[b] for a, b in edges if root[a] != root[b])
        assert all((got[a] == got[b]) == (root[a] == root[b]) for a in range(18) for b in range(18))


def test_triangle_and_pair(spark):
    df, ns = frame(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 3)]), nodes(spark, 5)
    roots = strong.strong_roots(ns, df)
    assert strong.size_summary(strong.component_sizes(roots, "scc_root")).first() == (2, 3)
    assert strong.size_summary(strong.component_sizes(strong.weak_components(ns, df), "wcc_id")).first() == (2, 3)


@pytest.mark.parametrize("edges, stats, back", [([(0, 1), (1, 2), (2, 0), (0, 2)], (3, False), 1), ([(0, 1), (1, 2), (2, 3)], (0, True), 0)])
def test_cycles(spark, edges, stats, back):
    df, ns = frame(spark, edges), nodes(spark, 4)
    assert tuple(strong.cycle_stats(strong.strong_roots(ns, df), df).first()) == stats
    assert strong.depth_first_forest(4, df).first()["back_edges"] >= back
    assert (strong.depth_first_forest(4, df).first()["back_edges"] == 0) == stats[1]


@pytest.mark.parametrize("finish", [0, 10**6])
def test_weighted_distances(spark, finish):
    edges = random_graph(25, 60, 9)
    df = frame(spark, [(a, b, w) for (a, b), w in edges])
    got = {r["node"]: r["distance"] for r in paths.distances(df, 0, True, finish_edges=finish).collect()}
    assert got == bellman(edges, 0)
    hops = {r["node"]: r["distance"] for r in paths.distances(df, 0, finish_edges=finish).collect()}
    assert hops == bellman([(e, 1) for e, _ in edges], 0)


@pytest.mark.parametrize("finish", [0, 10**6])
def test_distance_and_nearest(spark, finish):
    fan = frame(spark, [(0, k) for k in range(1, 30)] + [(k, 30) for k in range(1, 30)])
    assert paths.shortest_distance(fan, 0, 30, finish_edges=finish) == 2
    assert paths.shortest_distance(fan, 30, 0, finish_edges=finish) == -1
    assert paths.shortest_distance(fan, 4, 4, finish_edges=finish) == 0
    line = frame(spark, [(k, k + 1) for k in range(4)])
    assert [tuple(r) for r in paths.nearest(line, 0, 3, finish_edges=finish).collect()] == [(1, 1), (2, 2), (3, 3)]


def test_long_path(spark):
    n = 50_000
    df = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("weight"), F.col("id").alias("ord"))
    assert paths.shortest_distance(df, 0, n - 1) == n - 1
    assert strong.strong_roots(nodes(spark, n), df).filter("node = scc_root").count() == n
    assert strong.weak_components(nodes(spark, n), df).agg(F.max("wcc_id")).first()[0] == 0


def plain_pagerank(n, edges, damping=0.85, rounds=100, tol=1e-9):
    out = {v: [b for a, b in edges if a == v] for v in range(n)}
    p = [1 / n] * n
    for k in range(1, rounds + 1):
        q = [(1 - damping) / n + damping * sum(p[v] for v in range(n) if not out[v]) / n] * n
        for v in range(n):
            for b in out[v]:
                q[b] += damping * p[v] / len(out[v])
        delta, p = sum(abs(x - y) for x, y in zip(p, q, strict=True)), q
        if delta < tol:
            break
    return p, k


@pytest.mark.parametrize("finish", [0, 10**6])
def test_pagerank(spark, finish):
    edges = [e for e, _ in random_graph(12, 20, 3)]
    scores, rounds = ranking.pagerank(nodes(spark, 12), frame(spark, edges), max_iterations=12, finish_edges=finish)
    want, k = plain_pagerank(12, edges, rounds=12)
    got = {r["node"]: r["pagerank"] for r in scores.collect()}
    assert rounds == k and got == pytest.approx(dict(enumerate(want)), abs=1e-12)
    assert sum(got.values()) == pytest.approx(1, abs=1e-9)


def test_pagerank_of_nothing(spark):
    assert ranking.pagerank(nodes(spark, 0), frame(spark, [(0, 1)]).limit(0))[0].count() == 0


def test_rank_order_and_ranges(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (2, 0.1), (3, 0.4)], "node long, pagerank double")
    ranked = ranking.rank_order(df)
    assert {r["node"]: r["rank"] for r in ranked.collect()} == {1: 1, 3: 2, 0: 3, 2: 4}
    assert [r["node"] for r in ranking.rank_list(ranked, 2, 3).collect()] == [3, 0]
    # The limit keeps the lowest scores, then lists them from the highest, ties by falling node.
    assert [r["node"] for r in ranking.score_range(df, 0.1, 0.4, limit=3).collect()] == [1, 2, 0]
    assert ranking.score_range(df, 0.5, 0.9).count() == 0


def test_degrees_offsets_and_probes(spark):
    edges = [(0, 1, 7), (0, 2, 8), (2, 1, 9)]
    df = frame(spark, edges)
    degs = adjacency.degrees(nodes(spark, 4), df)
    rows = {r["node"]: r for r in adjacency.csr_offsets(degs, 2).collect()}
    assert [(rows[v]["out_start"], rows[v]["in_start"], rows[v]["out_deg"], rows[v]["in_deg"]) for v in range(4)] == [
        (0, 0, 2, 0), (4, 0, 0, 2), (4, 4, 1, 1), (6, 6, 0, 0)
    ]
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "src long, dst long")
    want = {(a, b): (True, w) for a, b, w in edges}
    for found in (adjacency.probe_edges(pairs, df), adjacency.probe_edges_by_scan(pairs, df)):
        assert {(r["src"], r["dst"]): (r["exists"], r["weight"]) for r in found.collect()} == {
            (a, b): want.get((a, b), (False, 0)) for a in range(4) for b in range(4)
        }
    assert [tuple(r) for r in adjacency.in_neighbors(df, 1).orderBy("neighbor").collect()] == [(0, 7), (2, 9)]


@pytest.mark.parametrize(
    "data, seed, expected",
    [
        (b"", 0, 0), (b"", 1, 0x514E28B7), (b"", 0xFFFFFFFF, 0x81F16F39), (b"test", 0, 0xBA6BD213),
        (b"Hello, world!", 0, 0xC0363E43), (b"aaaa", 0x9747B28C, 0x5A97808A), (b"abcd", 0x9747B28C, 0xF0478627),
    ],
)
def test_murmur_vectors(data, seed, expected):
    assert murmur3(data, seed) == expected


def test_edge_hash_is_the_hash_of_the_key():
    import struct

    import numpy as np

    pairs = [(0, 1), (7, 2**31), (123456, 654321)]
    got = edge_hashes(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [murmur3(struct.pack("<II", a, b), 0x9747B28C) for a, b in pairs]


def test_geometry(spark):
    assert [hash_capacity(n) for n in (0, 1, 23, 24, 25, 48, 100)] == [32, 32, 32, 64, 64, 128, 256]
    df = spark.range(500).select("id", hash_capacity_column(F.col("id")).alias("c"))
    assert all(r["c"] == hash_capacity(r["id"]) for r in df.collect())
    assert index_geometry(0) == (1, 2) and index_geometry(41) == (1, 2) and index_geometry(42) == (2, 4)
    assert index_geometry(1200) == (2, 32)


def test_probe_table_slots_are_distinct(spark):
    edges = frame(spark, [(k, 3 * k + 1) for k in range(400)])
    rows = probe_table(edges, 400).collect()
    assert len({r["slot"] for r in rows}) == 400 and min(r["probes"] for r in rows) == 1


def test_links_split_hubs_and_send_once(spark):
    edges = [(0, k) for k in range(1, 60)] + [(k, 0) for k in range(1, 20)]
    links = Links(frame(spark, edges).select("src", "dst"), hub_edges=10)
    parts = links.table.groupBy("src", "_part").count().collect()
    assert len({r["_part"] for r in parts if r["src"] == 0}) > 3 and max(r["count"] for r in parts) < 30
    sent = links.send(spark.createDataFrame([(0, 1.5), (3, 2.5), (77, 3.5)], "node long, score double"))
    got = sorted((r["src"], r["dst"], r["score"]) for r in sent.collect())
    assert got == sorted([(0, k, 1.5) for k in range(1, 60)] + [(3, 0, 2.5)])
    links.close()


def test_pagerank_rounds_do_not_shuffle_edges(spark):
    """With broadcasts off, no exchange lies between the kept edges and the join that a round begins with."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = Links(frame(spark, [(a, (a * 7 + 1) % 50) for a in range(50)]).select("src", "dst"))
        sent = links.send(spark.range(50).select(F.col("id").alias("node"), F.rand(1).alias("score")))
        plan = sent._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(k for k, line in enumerate(plan) if "InMemoryTableScan" in line)
        join = max(k for k, line in enumerate(plan[:scan]) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in plan[join:scan])
        links.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nearest_stops_early_and_is_exact(spark):
    edges = [(k, k + 1, 1 + k % 3) for k in range(40)] + [(0, 20, 50), (3, 9, 2)]
    want = sorted(bellman({(a, b): w for a, b, w in edges}.items(), 0).items(), key=lambda x: (x[1], x[0]))[1:6]
    assert [tuple(r) for r in paths.nearest(frame(spark, edges), 0, 5, True, finish_edges=0).collect()] == want


def test_ranges_join_against_all_pairs(spark):
    rng = random.Random(3)
    ranges = [(k, low := rng.random(), low + rng.random() / 5) for k in range(30)] + [(90, 0.5, 0.5), (91, None, 0.4)]
    scores = [(k, rng.random()) for k in range(80)] + [(99, None)]
    met = ranking.join_ranges(
        spark.createDataFrame(ranges, "range_id long, low double, high double"),
        spark.createDataFrame(scores, "node long, pagerank double"), 0.05,
    )
    want = {(r, n) for r, a, b in ranges if a is not None for n, s in scores if s is not None and a <= s < b}
    got = [(r["range_id"], r["node"]) for r in met.collect()]
    assert set(got) == want and len(got) == len(want)


def test_lookup_looks_past_long_runs(spark):
    """A table whose every slot but one is taken: the probe goes round to the free one."""
    capacity = hash_capacity(3000)
    home = int(edge_hashes(np.array([5]), np.array([6]))[0]) & (capacity - 1)
    free = (home - 3) % capacity
    table = spark.range(capacity).filter(F.col("id") != free).select(
        F.lit(-1).alias("src"), F.lit(-1).alias("dst"), F.col("id").alias("slot"), F.lit(1).alias("probes")
    )
    assert lookup_probes(table, 3000, 5, 6) == capacity - 2
