import pytest

from arcwright.model import GraphError, GraphMeta, StorageError
from arcwright.plans.engine import GraphEngine

EDGES = "# sample\n8 9\n0 1\n1 2\n2 0\n3 4\n4 3\n5 5\n2 3\n2 3\n5 6\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    (root / "sample.txt").write_text(EDGES)
    (root / "bad.txt").write_text("0 x\n")
    (root / "heavy.txt").write_text("0 1 1\n1 2 2\n0 2 10\n")
    made = GraphEngine(spark, str(root / "data"))
    made.root = root
    said = []
    made.meta = made.build(str(root / "sample.txt"), progress=said.append)
    assert said[-1] == "done"
    return made


@pytest.fixture(scope="module")
def graph(engine):
    with engine.open("sample") as g:
        yield g


def test_meta(engine, graph):
    m = graph.meta
    assert m == engine.meta and engine.list() == ["sample"]
    assert (m.nodes, m.edges, m.had_header, m.self_loops_removed, m.duplicates_removed) == (8, 7, True, 1, 1)
    assert (m.num_scc, m.largest_scc, m.num_wcc, m.largest_wcc) == (5, 3, 3, 5)
    assert (m.nodes_on_cycles, m.is_dag, m.back_edges) == (5, False, 2)
    assert m.pagerank_total == pytest.approx(1, abs=1e-9) and len(m.warnings) == 2
    assert (m.hash_capacity, m.btree_height, m.btree_blocks) == (32, 1, 2) and m.hash_longest_probe >= 1


def test_point_queries(graph):
    assert graph.in_degree(3).value == 2 and graph.out_degree("2").value == 2
    assert graph.out_neighbors(2).value == [(0, 1), (3, 1)] and graph.in_neighbors(3).value == [(4, 1), (2, 1)]
    assert graph.same_components(0, 2).value["same_scc"] and not graph.same_components(0, 3).value["same_scc"]
    assert graph.same_components(0, 3).value["same_wcc"] and not graph.same_components(0, 7).value["same_wcc"]
    assert graph.same_components(4, 4).value["same_scc"]
    assert graph.pagerank_of(3).value["rank"] >= 1 and graph.pagerank_of(3).logical_blocks == 1


def test_paths(graph):
    assert graph.shortest_distance(0, 4).value == 4 and graph.shortest_distance(4, 0).value == -1
    assert graph.shortest_distance(6, 6).value == 0
    assert graph.knn(0, 3).value == [(1, 1), (2, 2), (3, 3)] and len(graph.knn(0, 99).value) == 4


def test_pool_sweep(graph):
    rows = graph.pool_sweep(0, 4).value
    # Four nodes are expanded; all records are in one block, all runs in another.
    assert [(r["capacity"], r["requested"], r["read"]) for r in rows] == [(1, 8, 8)] + [(c, 8, 2) for c in (4, 16, 64, 256, 1024)]
    assert graph.pool_sweep(4, 4).value[0]["requested"] == 0


def test_ranks_and_scores(graph):
    rows = graph.rank_list(1, 99).value
    assert [r["rank"] for r in rows] == list(range(1, 9))
    scores = [r["pagerank"] for r in rows]
    assert scores == sorted(scores, reverse=True)
    assert graph.rank_list(2, 3).logical_blocks == 3
    every = graph.nodes_by_score(0, 1).value
    assert [r["node"] for r in every[-2:]] != [] and len(every) == 8
    assert len(graph.nodes_by_score(0, 1, 3).value) == 3 and graph.nodes_by_score(0.9, 1).value == []
    assert graph.has_score(every[0]["pagerank"], every[0]["node"]) and not graph.has_score(2.0, 0)


def test_edges_both_ways(graph):
    stored = {(0, 1), (1, 2), (2, 0), (3, 4), (4, 3), (2, 3), (5, 6)}
    for pair in [*stored, (1, 0), (6, 5), (5, 5), (7, 7)]:
        found = graph.has_edge(*pair).value
        assert found["exists"] == (pair in stored) and found["weight"] == int(pair in stored) and found["probes"] >= 1
        assert graph.has_edge_by_scan(*pair).value == {"exists": pair in stored, "weight": int(pair in stored)}


@pytest.mark.parametrize(
    "call",
    [
        lambda g: g.in_degree(8), lambda g: g.in_degree(-1), lambda g: g.in_degree("x"), lambda g: g.knn(0, 0), lambda g: g.knn(0, "k"),
        lambda g: g.rank_list(0, 1), lambda g: g.rank_list(3, 2), lambda g: g.rank_list(9, 9), lambda g: g.rank_list("a", 2),
        lambda g: g.nodes_by_score(1, 0), lambda g: g.nodes_by_score("a", 1), lambda g: g.nodes_by_score(float("nan"), 1),
        lambda g: g.nodes_by_score(0, 1, "all"), lambda g: g.same_components(0, 9),
    ],
)
def test_bad_arguments(graph, call):
    with pytest.raises(GraphError):
        call(graph)


def test_weighted(engine):
    engine.build(str(engine.root / "heavy.txt"), "weights", weighted=True)
    g = engine.open("weights")
    assert g.shortest_distance(0, 2).value == 3 and g.has_edge(0, 2).value["weight"] == 10
    assert engine.list() == ["sample", "weights"]
    engine.delete("weights")
    engine.delete("weights")
    assert engine.list() == ["sample"]
    with pytest.raises(GraphError):
        engine.open("weights")


def test_failed_build_keeps_the_earlier_graph(engine):
    with pytest.raises(Exception, match="line 1"):
        engine.build(str(engine.root / "bad.txt"), "sample")
    assert engine.list() == ["sample"] and engine.open("sample").meta.edges == 7


def test_failed_publish_keeps_the_earlier_graph(engine, monkeypatch):
    real = engine.store.rename

    def rename(old, new):
        if "/." in old and not old.rpartition("/")[2].startswith(".old"):
            raise StorageError("no")
        real(old, new)

    monkeypatch.setattr(engine.store, "rename", rename)
    with pytest.raises(StorageError):
        engine.build(str(engine.root / "sample.txt"), "sample")
    assert "sample" in engine.list() and engine.open("sample").meta.edges == 7


def test_meta_json():
    meta = GraphMeta("g", 1, 0, False)
    assert GraphMeta.from_json(meta.to_json()) == meta
    assert GraphMeta.from_json('{"name": "g", "nodes": 1, "edges": 0, "weighted": false}') == meta
    with pytest.raises(StorageError):
        GraphMeta.from_json('{"name": "g", "nodes": 1, "edges": 0, "weighted": false, "odd": 1}')
