"""Sizes of the paged layout that answers are priced in: blocks, hash table, ordered index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout's constants.
BLOCK_BYTES = 512
INTS_PER_BLOCK = 128
NODES_PER_BLOCK = 8
MIN_CAPACITY = 32
MAX_LOAD = 0.75
BUCKET_BYTES = 16
LEAF_ENTRIES = 41
FANOUT = 31


def hash_capacity(entries: int) -> int:
    """The smallest power of two, 32 at least, that keeps the load factor at most 0.75."""
    return max(MIN_CAPACITY, 1 << (int(entries / MAX_LOAD)).bit_length())


def hash_capacity_column(entries: Column) -> Column:
    """As :func:`hash_capacity`: a number's binary digits give the next power of two, exactly."""
    needed = F.floor(entries / F.lit(MAX_LOAD)).cast("long")
    bits = F.when(needed > 0, F.length(F.bin(needed))).otherwise(F.lit(0))
    return F.greatest(F.lit(MIN_CAPACITY).cast("long"), F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), bits).cast("long"))


def index_geometry(entries: int) -> tuple[int, int]:
    """``(height, blocks)`` of the ordered index over ``entries`` scores, header block included."""
    level = max(1, -(-entries // LEAF_ENTRIES))
    height, blocks = 1, 1 + level
    while level > 1:
        level = -(-level // FANOUT)
        height += 1
        blocks += level
    return height, blocks


def blocks_of_run(start: Column, length: Column) -> Column:
    """Blocks that a run of ints touches."""
    size = F.lit(INTS_PER_BLOCK)
    return F.when(length == 0, F.lit(0).cast("long")).otherwise(
        (F.floor((start + length - 1) / size) - F.floor(start / size) + 1).cast("long")
    )


def run_blocks(start: int, length: int) -> int:
    return 0 if length == 0 else (start + length - 1) // INTS_PER_BLOCK - start // INTS_PER_BLOCK + 1


def disk_blocks(nodes: int, edges: int, weighted: bool) -> int:
    """Blocks of a stored graph: node records, two adjacencies, rank list, hash table, ordered index."""
    stride = 2 if weighted else 1
    ints = lambda n: max(1, -(-n // INTS_PER_BLOCK))
    return (
        -(-nodes // NODES_PER_BLOCK)
        + 2 * ints(edges * stride)
        + ints(nodes)
        + 1
        + hash_capacity(edges) * BUCKET_BYTES // BLOCK_BYTES
        + index_geometry(nodes)[1]
    )
