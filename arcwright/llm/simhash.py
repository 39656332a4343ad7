"""SimHash near-dedup with pigeonring filtering.

Two 64-bit fingerprints link at ``max_bits`` = t or fewer differing bits. Cut the 64 bits into a
ring of t + 1 segments. If two fingerprints link, then by the pigeonring principle some start
segment i exists whose chain stays within its proportional budget at every length: the first l
segments from i together differ in at most floor(l * t / (t + 1)) = l - 1 bits (Qin and Xiao,
2018). The first segment of such a chain is equal; over the next two, halved, at most one half of
the first and two halves in all can differ. Every way to place those differences leaves two halves
equal, which gives five exact keys of about 26 bits for each start: the index. In a bucket, the
chain of that start is tested length by length, the last length being the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm.text import Shelf, text_or_empty
from arcwright.operators.components import connected_components
from arcwright.session import materialize

#: Buckets above this size are cut by further exact keys before they are compared.
REFINE_ABOVE = 4096


def fingerprint(text: bytes, width: int) -> int:
    """The unsigned 64-bit SimHash over word shingles of ``text``, A-Z lower-cased."""
    words = text.lower().split()  # on bytes: exactly A-Z, and exactly the six white-space bytes
    n = len(words)
    if n == 0:
        return 0
    xx = xxhash.xxh64_intdigest
    if n <= width:
        hashes = [xx(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [
            xx(joined[i:j], 42)
            for i, j in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        ]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """``docs`` with the fingerprint, as a signed long, for its last column ``_fp``; the others pass through."""
    shelf = Shelf(docs, ("_fp",))
    made = shelf.table.select(*shelf.columns, text_or_empty(shelf.of(text)).cast("binary").alias("whole"))
    schema = made.withColumn("whole", F.lit(0).cast("long")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64), pa.int64())], batch.schema.names)

    return shelf.back(made.mapInArrow(add, schema).withColumnRenamed("whole", "_fp"))


def ring(max_bits: int) -> list[list[int]]:
    """Masks of the ring's segments, each as a list of its two halves."""
    m = max_bits + 1
    edges = [round(64 * k / m) for k in range(m + 1)]

    def mask(a: int, b: int) -> int:
        return ((1 << b) - 1) ^ ((1 << a) - 1)

    return [[mask(a, (a + b) // 2), mask((a + b) // 2, b)] for a, b in zip(edges, edges[1:], strict=False)]


def index_keys(max_bits: int, depth: int = 3) -> list[tuple[int, int]]:
    """``(start segment, mask)`` of each exact key; see the module's text."""
    segments = ring(max_bits)
    m = len(segments)
    depth = min(depth, m)
    halves = [(k, h) for k in range(1, depth) for h in (0, 1)]
    allowed = [
        set(bad)
        for n in range(len(halves) + 1)
        for bad in combinations(halves, n)
        if all(sum(1 for k, _ in bad if k <= top) <= top for top in range(1, depth))
    ]
    largest = [bad for bad in allowed if not any(bad < other for other in allowed)]
    keys = []
    for start in range(m):
        for bad in largest:
            mask = segments[start][0] | segments[start][1]
            for k, h in halves:
                if (k, h) not in bad:
                    mask |= segments[(start + k) % m][h]
            keys.append((start, mask))
    return keys


def _chains(max_bits: int) -> list[list[np.uint64]]:
    """By start segment, the masks of its chains by length."""
    whole = [a | b for a, b in ring(max_bits)]
    m = len(whole)
    out = []
    for start in range(m):
        masks, mask = [], 0
        for k in range(m):
            mask |= whole[(start + k) % m]
            masks.append(np.uint64(mask))
        out.append(masks)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _linked(x: np.uint64, others: np.ndarray, chain: list[np.uint64]) -> np.ndarray:
    """Which of ``others`` keep the whole chain with ``x``: at most l - 1 bits over length l."""
    alive = np.arange(len(others))
    for length, mask in enumerate(chain, 1):
        if length == 1:
            continue  # equal by the key
        alive = alive[np.bitwise_count((others[alive] ^ x) & mask) < length]
        if not len(alive):
            break
    return alive


def _spanning(fps: np.ndarray, chain: list[np.uint64]) -> list[tuple[int, int]]:
    """A spanning forest of a bucket's links: each member leaves the unreached set once."""
    if len(fps) > REFINE_ABOVE:
        # Linked members differ in at most t bits, so they agree on one of t + 1 parts of what the
        # bucket does not share; members are compared only within equal parts.
        varying = int(~(np.bitwise_and.reduce(fps) | np.bitwise_and.reduce(~fps)))
        free = [b for b in range(64) if varying >> b & 1]
        out = []
        for part in np.array_split(np.array(free), len(chain)):
            mask = np.uint64(sum(1 << int(b) for b in part))
            order = np.argsort(fps & mask, kind="stable")
            cut = np.flatnonzero(np.diff(fps[order] & mask)) + 1
            for group in np.split(order, cut):
                if len(group) > 1:
                    out += _forest(fps[group], chain)
        return out
    return _forest(fps, chain)


def _forest(fps: np.ndarray, chain: list[np.uint64]) -> list[tuple[int, int]]:
    out, left = [], fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            hit = _linked(x, left, chain)
            if len(hit):
                found = left[hit]
                out += [(x, o) for o in found]
                frontier += list(found)
                left = np.delete(left, hit)
    return out


def _bucket_links(max_bits: int):
    by_start = _chains(max_bits)
    chains = [by_start[start] for start, _ in index_keys(max_bits)]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> list[tuple[int, int]]:
            fps = np.concatenate(parts)
            return _spanning(fps.view(np.uint64), chains[now[0]]) if len(fps) > 1 else []

        for batch in batches:
            kind, key, fps = (np.asarray(batch.column(i)) for i in range(3))
            new = np.flatnonzero((np.diff(kind) != 0) | (np.diff(key) != 0)) + 1
            cuts = [0, *new.tolist(), len(key)] if len(key) else []
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                bucket = (kind[a], key[a])
                if bucket != now:
                    out += close() if parts else []
                    now, parts = bucket, []
                parts.append(fps[a:b])  # a bucket may go on in the next batch
            if out:
                yield _link_batch(out)
        out = close() if parts else []
        if out:
            yield _link_batch(out)

    return links


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def near_duplicates(fps: DataFrame, id_col: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """``(id, _fp)`` -> ``(_fp, component_id)`` over distinct fingerprints.

    The nodes are the fingerprints, whatever ids their rows have: a fingerprint whose ids are all
    null still bridges others, and an id on two texts does not fuse them.
    """
    fps = fps.groupBy("_fp").agg(F.min(id_col).alias("_rep"))
    keys = F.array(
        *[
            F.struct(
                F.lit(kind).alias("s"),
                F.col("_fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("k"),
            )
            for kind, (_, mask) in enumerate(index_keys(max_bits))
        ]
    )
    exploded = fps.select(F.explode(keys).alias("e"), "_fp").select("e.s", "e.k", "_fp")
    dealt = exploded.repartition(F.col("s"), F.col("k")).sortWithinPartitions("s", "k")
    found = materialize(connected_components(dealt.mapInArrow(_bucket_links(max_bits), "a long, b long")), "simhash-classes")
    owners = (
        found.join(fps, F.col("node") == F.col("_fp")).groupBy("component").agg(F.min("_rep").alias("_owner"))
    )
    linked = found.join(owners, "component").select("node", "_owner", F.lit(True).alias("_linked"))
    return fps.join(linked, F.col("_fp") == F.col("node"), "left").select(
        "_fp", F.when(F.col("_linked"), F.col("_owner")).otherwise(F.col("_rep")).alias("component_id")
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4
) -> DataFrame:
    """``(id, fingerprint, component_id)`` of each row of ``docs``.

    A null text counts as empty; a text without words has fingerprint zero and is linked like any
    other; a text of fewer words than ``width`` is one shingle; a text of any length is read whole.
    Rows with equal fingerprints are one node, so copies cost nothing in the search. A null id is a
    component's id only where all ids of the component are null; such a row links like any other.
    Repeated rows get equal results; an empty table gives an empty result. Other columns are left
    out, so their names cannot clash.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_t"))
    fps = materialize(with_fingerprint(narrow, "_t", width).select("_id", "_fp"), "simhash-fp")
    return fps.join(near_duplicates(fps, "_id", max_bits), "_fp").select(
        F.col("_id").alias(id_col), _hex("_fp").alias("fingerprint"), "component_id"
    )


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4
) -> DataFrame:
    """``docs`` with ``fingerprint`` and ``component_id``, as :func:`simhash_components` defines them.

    A column of ``docs`` that clashes with a result column gives way to it.
    """
    shelf = Shelf(docs, ("fingerprint", "component_id"))
    ident = F.col(shelf.of(id_col)).cast("long").alias("_id")
    fps = with_fingerprint(shelf.table.select(*shelf.columns, ident, F.col(shelf.of(text)).alias("_t")), "_t", width)
    narrow = materialize(fps.select("_id", "_fp"), "simhash-fp")
    out = fps.join(near_duplicates(narrow, "_id", max_bits), "_fp").select(
        *shelf.columns, _hex("_fp").alias("fingerprint"), "component_id"
    )
    return shelf.back(out)


def _hex(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def simhash_query(spark, sf_dir):
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
