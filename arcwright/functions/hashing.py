"""MurmurHash3 (x86, 32 bits), and the linear-probing cost of an edge table built with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions.geometry import hash_capacity
from arcwright.session import discard, materialize, settings

# The constants of the published algorithm, and the seed of edge keys.
C1, C2 = 0xCC9E2D51, 0x1B873593
MIX1, MIX2 = 0x85EBCA6B, 0xC2B2AE35
EDGE_SEED = 0x9747B28C
ROUND_ADD = 0xE6546B64
#: Home slots whose keys lie together.
BLOCK_SLOTS = 1 << 20


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _scramble(k: np.ndarray) -> np.ndarray:
    return _rotl(k * np.uint32(C1), 15) * np.uint32(C2)


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    h = h ^ np.uint32(length)
    for shift, by in ((16, MIX1), (13, MIX2)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return h ^ (h >> np.uint32(16))


def murmur3(data: bytes, seed: int = 0) -> int:
    """The hash of one byte string."""
    whole = len(data) // 4
    h = np.array([seed], np.uint32)
    for word in np.frombuffer(data[: whole * 4], "<u4"):
        h = _rotl(h ^ _scramble(np.array([word], np.uint32)), 13) * np.uint32(5) + np.uint32(ROUND_ADD)
    rest = data[whole * 4 :]
    if rest:
        h = h ^ _scramble(np.array([int.from_bytes(rest, "little")], np.uint32))
    return int(_finish(h, len(data))[0])


def edge_hashes(src: np.ndarray, dst: np.ndarray, seed: int = EDGE_SEED) -> np.ndarray:
    """The hashes of the 8-byte keys ``(src, dst)``, as unsigned 32-bit little-endian pairs."""
    h = np.full(len(src), seed, np.uint32)
    for part in (src, dst):
        word = (part & 0xFFFFFFFF).astype(np.uint32)
        h = _rotl(h ^ _scramble(word), 13) * np.uint32(5) + np.uint32(ROUND_ADD)
    return _finish(h, 8)


def with_edge_hash(edges: DataFrame) -> DataFrame:
    """``(src, dst, edge_hash)``, batch by batch: as columns the nested steps would double at every use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = edge_hashes(np.asarray(b.column(0)), np.asarray(b.column(1))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h)], ["src", "dst", "edge_hash"])

    return edges.select("src", "dst").mapInArrow(run, "src long, dst long, edge_hash long")


def probe_table(edges: DataFrame, n_edges: int, block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """``(src, dst, slot, probes)`` of a linear-probing table filled in ``ord``.

    Which slots are taken at last doesn't depend on the order, and an empty one parts the keys before it
    from those behind: a run of taken slots is filled by the keys at home in it, in their order, whatever
    the others do. So keys go by blocks of home slots; from the number of keys that each block passes on
    follows where its first empty slot lies, and the keys before that join the block where their run begins.
    """
    spark, capacity = edges.sparkSession, hash_capacity(n_edges)
    mask, size = capacity - 1, min(block_slots, capacity)
    blocks = capacity // size

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = (edge_hashes(np.asarray(b.column(0)), np.asarray(b.column(1))) & np.uint32(mask)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home)], ["src", "dst", "ord", "home"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = np.stack([np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (3, 2, 0, 1)])
            del held
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            at, first = np.unique(rows[0] // size, return_index=True)
            for b, x, y in zip(at.tolist(), first.tolist(), [*first[1:].tolist(), rows.shape[1]], strict=True):
                yield _keys(b, rows[:, x:y])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, rows in _read_keys(batch):
                s = _balance(rows[0] - b * size, size)
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (b, s[-1], s.min())], ["block", "net", "least"])

    plain = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
    hashed = edges.select("src", "dst", "ord").mapInArrow(homes, "src long, dst long, ord long, home long")
    packed = materialize(hashed.repartition(blocks, F.floor(F.col("home") / size)).mapInArrow(pack, "block long, keys binary"), "homes")
    with settings(spark, plain):
        sums = materialize(packed.mapInArrow(passed, "block long, net long, least long"), "passed")
    # Three numbers for a million slots. A block without keys takes one in each slot.
    net, least = np.full(blocks, -size), np.full(blocks, -size)
    for r in sums.collect():
        net[r["block"]], least[r["block"]] = r["net"], r["least"]
    taken_in, q = np.zeros(blocks, np.int64), 0
    for _ in range(2):  # what the last block passes on is right after one turn, as some slot stays empty
        for b in range(blocks):
            taken_in[b] = q
            q = max(net[b] + q, net[b] - least[b])
    open_ = least <= -1 - taken_in
    begins, last = np.zeros(blocks, np.int64), 0
    for k in range(2 * blocks):  # the nearest block before with an empty slot; below 0 it lies before the turn
        begins[k % blocks] = last
        if open_[k % blocks]:
            last = k
    begins -= blocks
    discard(sums)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, rows in _read_keys(batch):
                own = rows[0] - b * size
                s = _balance(own, size)
                empty = int(np.argmax(s == -1 - taken_in[b])) if open_[b] else size
                head = int(np.searchsorted(own, empty))
                if head:
                    to = int(begins[b])
                    moved = rows[:, :head].copy()
                    moved[0] += capacity if to < 0 else 0
                    yield _keys(to % blocks, moved)
                if head < len(own):
                    yield _keys(b, rows[:, head:])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for b, rows in _read_keys(batch):
                if b != group and held:
                    yield _filled(np.concatenate(held, axis=1), mask)
                    held = []
                group = b
                held.append(rows)
        if held:
            yield _filled(np.concatenate(held, axis=1), mask)

    with settings(spark, plain):
        runs = packed.mapInArrow(split, "block long, keys binary").repartition(blocks, "block").sortWithinPartitions("block")
        table = materialize(runs.mapInArrow(fill, "src long, dst long, slot long, probes long"), "probes")
    discard(packed)
    return table


def _keys(block: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([rows.tobytes()], pa.binary())], ["block", "keys"])


def _read_keys(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Block and keys, as rows of home, ord, src and dst."""
    for k in range(batch.num_rows):
        yield batch.column(0)[k].as_py(), np.frombuffer(batch.column(1)[k].as_buffer(), np.int64).reshape(4, -1)


def _balance(home: np.ndarray, size: int) -> np.ndarray:
    """At each slot, the keys at home up to it less the slots up to it: at a new least value, without keys from before, it is empty."""
    return np.cumsum(np.bincount(home, minlength=size) - 1)


def _filled(rows: np.ndarray, mask: int) -> pa.RecordBatch:
    """The keys of whole runs, put in in their order."""
    home, _, src, dst = rows = rows[:, np.argsort(rows[1], kind="stable")]
    low = int(home.min())
    taken = bytearray(int(home.max()) - low + len(home) + 1)
    slots = np.empty(len(home), np.int64)
    for k, at in enumerate((home - low).tolist()):
        while taken[at]:
            at += 1
        taken[at] = 1
        slots[k] = at
    slots += low
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (src, dst, slots & mask, slots - home + 1)], ["src", "dst", "slot", "probes"])


def lookup_probes(table: DataFrame, n_edges: int, src: int, dst: int) -> int:
    """Buckets that a lookup of an edge, stored or not, reads until it finds it or an empty one."""
    capacity = hash_capacity(n_edges)
    home = int(edge_hashes(np.array([src]), np.array([dst]))[0]) & (capacity - 1)
    stored = table.filter((F.col("src") == src) & (F.col("dst") == dst)).first()
    if stored is not None:
        return stored["probes"]
    # The first slot at or after home that is not taken, around the end: look ever further ahead.
    away = F.pmod(F.col("slot") - home, F.lit(capacity))
    ahead = 1024
    while True:
        near = table.select(away.alias("a")).filter(F.col("a") < ahead)
        run = near.agg(F.sort_array(F.collect_set("a")).alias("s")).first()["s"]
        n = next((k for k, a in enumerate(run) if a != k), len(run))
        if n < ahead or ahead >= capacity:
            return n + 1
        ahead *= 4
