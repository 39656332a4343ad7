"""Schemas, errors, graph metadata and query results."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import types as T


class EngineError(Exception):
    """Base of every error that the engine raises for its input."""


class GraphError(EngineError):
    """An invalid graph name, a missing graph, or a bad query argument."""


class EdgeListError(EngineError):
    """An edge list that cannot be parsed."""


class StorageError(EngineError):
    """A stored graph that cannot be read."""


EDGES = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("weight", T.LongType()),
        T.StructField("ord", T.LongType()),
    ]
)

NODES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("node", "out_start", "in_start", "in_deg", "out_deg", "scc_id", "wcc_id", "rank")]
    + [T.StructField("pagerank", T.DoubleType())]
)


@dataclass
class GraphMeta:
    """What is known of a built graph as a whole."""

    name: str
    nodes: int
    edges: int
    weighted: bool
    num_scc: int = 0
    largest_scc: int = 0
    num_wcc: int = 0
    largest_wcc: int = 0
    back_edges: int = 0
    nodes_on_cycles: int = 0
    is_dag: bool = False
    pagerank_iterations: int = 0
    pagerank_total: float = 0.0
    hash_capacity: int = 0
    hash_longest_probe: int = 0
    btree_height: int = 0
    btree_blocks: int = 0
    build_ms: int = 0
    on_disk_bytes: int = 0
    total_blocks: int = 0
    had_header: bool = False
    self_loops_removed: int = 0
    duplicates_removed: int = 0
    warnings: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> GraphMeta:
        """Fields that the text lacks get their defaults; an unknown field is an error."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise StorageError(f"unknown metadata fields: {sorted(unknown)}")
        return cls(**given)


@dataclass
class QueryResult:
    """An answer and what it cost: wall time, and the block requests of the paged layout."""

    value: object
    elapsed_ms: float
    logical_blocks: int | None = None
