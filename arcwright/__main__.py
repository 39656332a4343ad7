"""Command line: build, list, info, query, delete, bench, bench-index."""

from __future__ import annotations

import argparse
import random
import sys
from dataclasses import asdict
from statistics import mean

from pyspark.sql import functions as F

from arcwright.model import EngineError
from arcwright.plans.engine import Graph, GraphEngine
from arcwright.session import get_session

#: Nodes of a score window.
WINDOW = 50
#: kind -> (method, fewest arguments, most arguments)
QUERIES = {
    "indegree": ("in_degree", 1, 1),
    "outdegree": ("out_degree", 1, 1),
    "pagerank": ("pagerank_of", 1, 1),
    "distance": ("shortest_distance", 2, 2),
    "knn": ("knn", 2, 2),
    "components": ("same_components", 2, 2),
    "ranklist": ("rank_list", 2, 2),
    "edge": ("has_edge", 2, 2),
    "edgescan": ("has_edge_by_scan", 2, 2),
    "scorerange": ("nodes_by_score", 2, 3),
}


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="arcwright")
    parser.add_argument("--data", default="data", help="folder of built graphs")
    sub = parser.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("source")
    build.add_argument("--name")
    build.add_argument("--weighted", action="store_true")
    build.add_argument("--quiet", action="store_true")
    sub.add_parser("list")
    for name in ("info", "delete", "bench-index"):
        sub.add_parser(name).add_argument("name")
    sub.choices["bench-index"].add_argument("--samples", type=int, default=10, help="random edges, and random score windows")
    sub.choices["bench-index"].add_argument("--seed", type=int, default=7)
    query = sub.add_parser("query")
    query.add_argument("name")
    query.add_argument("kind", choices=QUERIES)
    query.add_argument("args", nargs="*")
    bench = sub.add_parser("bench")
    for name in ("name", "source", "target"):
        bench.add_argument(name)
    return parser.parse_args(argv)


def show(result) -> None:
    rows = result.value if isinstance(result.value, list) else [result.value]
    for row in rows:
        print("  ".join(f"{k}={v}" for k, v in row.items()) if isinstance(row, dict) else row)
    blocks = "" if result.logical_blocks is None else f", {result.logical_blocks:,} blocks requested"
    print(f"{result.elapsed_ms:,.3f} ms{blocks}")


def summary(label: str, results: list) -> None:
    times = sorted(r.elapsed_ms for r in results)
    blocks = [r.logical_blocks for r in results if r.logical_blocks is not None]
    print(f"{label}: mean {mean(times):,.3f} ms, p95 {times[int(0.95 * len(times))]:,.3f} ms, max {times[-1]:,.3f} ms"
          + (f", {mean(blocks):.2f} blocks" if blocks else ""))


def bench_index(graph: Graph, samples: int, seed: int) -> None:
    """Random edges of the whole graph by both lookups, the hash table's figures, and windows of the ordered index."""
    pairs = [tuple(r) for r in graph.edges.select("src", "dst").orderBy(F.rand(seed)).limit(samples).collect()]
    if pairs:
        found = [graph.has_edge(*p) for p in pairs]
        summary("filter on both keys", found)
        summary("adjacency scan", [graph.has_edge_by_scan(*p) for p in pairs])
        probes = sorted(r.value["probes"] for r in found if r.value["probes"] is not None)
        if probes:
            print(f"probes: mean {mean(probes):.2f}, p95 {probes[int(0.95 * len(probes))]}, max {probes[-1]}, "
                  f"load factor {graph.load_factor():.2f}")  # fmt: skip
    draw, windows = random.Random(seed), []
    for _ in range(samples):
        first = draw.randint(1, max(1, graph.meta.nodes - WINDOW + 1))
        rows = graph.rank_list(first, min(first + WINDOW - 1, graph.meta.nodes)).value
        windows.append(graph.nodes_by_score(rows[-1]["pagerank"], rows[0]["pagerank"], WINDOW))
    summary(f"score range of {WINDOW} nodes", windows)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if a.command == "query":
        method, fewest, most = QUERIES[a.kind]
        if not fewest <= len(a.args) <= most:
            print(f"{a.kind} takes {fewest} to {most} arguments", file=sys.stderr)
            return 1
    engine = GraphEngine(get_session(), a.data)
    try:
        if a.command == "build":
            meta = engine.build(a.source, a.name, a.weighted, progress=None if a.quiet else lambda m: print(f"  {m}..."))
            print(f"Built {meta.name} in {meta.build_ms:,} ms: {meta.nodes:,} nodes, {meta.edges:,} edges")
            for warning in meta.warnings:
                print(f"  note: {warning}")
        elif a.command == "list":
            print("\n".join(engine.list()) or "No graphs built yet")
        elif a.command == "delete":
            engine.delete(a.name)
        elif a.command == "info":
            meta = engine.open(a.name).meta
            for field, value in asdict(meta).items():
                if field != "warnings":
                    print(f"{field.replace('_', ' '):<22} {value:,}" if type(value) is int else f"{field.replace('_', ' '):<22} {value}")
            for warning in meta.warnings:
                print(f"  note: {warning}")
        elif a.command == "query":
            args = [*a.args, 100] if a.kind == "scorerange" and len(a.args) == 2 else a.args
            show(getattr(engine.open(a.name), method)(*args))
        elif a.command == "bench":
            graph = engine.open(a.name)
            summary("distance", [graph.shortest_distance(a.source, a.target) for _ in range(5)])
            for row in graph.pool_sweep(a.source, a.target).value:
                hits = 1 - row["read"] / row["requested"] if row["requested"] else 0
                print(f"{row['capacity']:>6,} blocks: {row['read']:,} read of {row['requested']:,}, {hits:.1%} hit")
        else:
            bench_index(engine.open(a.name), max(1, a.samples), a.seed)
    except EngineError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
