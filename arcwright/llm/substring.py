"""Substring dedup: paragraphs that repeat across documents, whole or inside other text.

Paragraphs are lines of at least ``MIN_WORDS`` words. Each gets a MinHash of its five-word shingles,
cut into bands tuned for high recall at the threshold (8 bands of 3: 99.7 % at 0.8). Paragraphs that
collide in a band are joined, first each to the smallest of its bucket; one that this does not link
meets every other of the bucket. Exact Jaccard decides.

A passage pasted into a longer line has no line of its own. Its paragraphs are windows of 41 words
around anchors, shingles whose hash is the least of 11 neighbours: any passage of 51 words holds an
anchor whose window lies inside it, and which shingles are anchors depends on the passage alone.
Of these windows, 37 shingles each, an edit away from the edge leaves less than 0.8 in common, so
equal windows are the candidates that count, and their word sequences' hashes decide.

Documents that share a passage are linked to the smallest that has it, and removals are clustered
by components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwright.llm.text import text_or_empty
from arcwright.operators.components import connected_components
from arcwright.session import materialize

MIN_WORDS = 50
WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 8, 3
#: Words of 64 bits in a paragraph's sketch.
SKETCH = 8
#: Neighbours an anchor is the least of, and shingles on either side of it in its window.
WINNOW, REACH = 11, 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BIG = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Multipliers and offsets of the permutations, from a fixed seed.
_PERMS = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Stream:
    """The words of several texts in a row: their hashes, and where texts and lines end."""

    def __init__(self, texts: list[bytes]):
        ids: dict[bytes, int] = {}
        stream: list[int] = []
        ends: list[int] = []
        line_ends: list[int] = []
        line_doc: list[int] = []
        for k, text in enumerate(texts):
            for line in text.lower().split(b"\n"):
                words = line.split()
                if words:
                    stream += [ids.setdefault(w, len(ids)) for w in words]
                    line_ends.append(len(stream))
                    line_doc.append(k)
            ends.append(len(stream))
        table = np.array([xxhash.xxh64_intdigest(w, 7) for w in ids] or [0], np.uint64)
        self.h = table[np.array(stream, np.int64)] if stream else np.zeros(0, np.uint64)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.line_ends = np.array(line_ends, np.int64)
        self.line_starts = np.concatenate(([0], self.line_ends[:-1])).astype(np.int64)
        self.line_doc = np.array(line_doc, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.ends - self.starts)

    def shingles(self) -> np.ndarray:
        """The hash of the WIDTH words from each position; the last ones run on into what follows."""
        n = len(self.h)
        padded = np.concatenate([self.h, np.zeros(WIDTH, np.uint64)])
        out = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            out = out * _ODD + padded[k : k + n]
        return _mix(out)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words in ``[start, end)`` for each pair: differences of prefix hashes."""
        n = len(self.h)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_mix(self.h) * _power(_ODD, n), dtype=np.uint64)))
        # Back to the weights of a span that starts at 0: the multiplier is odd, so it has an inverse.
        back = _power(np.uint64(pow(int(_ODD), -1, 1 << 64)), n)
        return _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of a number, modulo 2**64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64))), dtype=np.uint64)[:n]


def _anchors(stream: Stream, s: np.ndarray) -> np.ndarray:
    """Positions whose shingle is the least of some WINNOW neighbours, and whose window fits its text."""
    n = len(s)
    if n < WINNOW:
        return np.zeros(0, np.int64)
    s = s.copy()
    tail = stream.ends[:, None] - np.arange(1, WIDTH)[None, :]
    tail = tail[(tail >= stream.starts[:, None])]
    s[tail] = _BIG  # these run into the next text
    least = np.lib.stride_tricks.sliding_window_view(s, WINNOW).min(axis=1)
    wide = np.concatenate([np.zeros(WINNOW - 1, np.uint64), least, np.zeros(WINNOW - 1, np.uint64)])
    most = np.lib.stride_tricks.sliding_window_view(wide, WINNOW).max(axis=1)
    at = np.flatnonzero(most == s)
    doc = stream.doc[at]
    fits = (at - REACH >= stream.starts[doc]) & (at + REACH + WIDTH <= stream.ends[doc])
    return at[fits]


def _lines(stream: Stream) -> np.ndarray:
    return np.flatnonzero(stream.line_ends - stream.line_starts >= MIN_WORDS)


def _bands(stream: Stream, s: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The band keys of each line: ROWS minima folded together."""
    starts, ends = stream.line_starts[lines], stream.line_ends[lines] - WIDTH + 1
    lengths = ends - starts
    flat = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    mine, cuts = s[flat], np.concatenate(([0], np.cumsum(lengths)[:-1]))
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        minima = np.minimum.reduceat(mine * _PERMS[0, k] + _PERMS[1, k], cuts)
        keys[:, k // ROWS] = _mix(keys[:, k // ROWS] ^ minima) + np.uint64(k // ROWS)
    return keys


def _sketches(stream: Stream, s: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A bitmap of each line's shingles, SKETCH words of 64 bits."""
    starts, ends = stream.line_starts[lines], stream.line_ends[lines] - WIDTH + 1
    lengths = ends - starts
    cuts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    mine = s[np.repeat(starts - cuts, lengths) + np.arange(lengths.sum())]
    bit, word = np.uint64(1) << (mine & np.uint64(63)), (mine >> np.uint64(6)) % np.uint64(SKETCH)
    return np.stack([np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), cuts) for k in range(SKETCH)], axis=1)


_UNITS = "kind int, key long, doc long, start int, stop int, bands array<long>, sketch array<long>"


def _find_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stream = Stream(batch.column(0).to_pylist())
        ids = np.asarray(batch.column(1).fill_null(-1))
        s = stream.shingles()
        at = _anchors(stream, s)
        if len(at):
            keys = stream.spans(at - REACH, at + REACH + WIDTH)
            doc = stream.doc[at]
            offset = stream.starts[doc]
            yield _units(0, keys, ids[doc], at - REACH - offset, at + REACH + WIDTH - offset, None, None)
        lines = _lines(stream)
        if len(lines):
            starts, ends = stream.line_starts[lines], stream.line_ends[lines]
            doc = stream.line_doc[lines]
            offset = stream.starts[doc]
            bands = _bands(stream, s, lines).view(np.int64)
            sketches = _sketches(stream, s, lines).view(np.int64)
            yield _units(1, stream.spans(starts, ends), ids[doc], starts - offset, ends - offset, bands, sketches)


def _units(kind: int, keys, docs, start, stop, *lists) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind, np.int32)),
            pa.array(keys.view(np.int64)),
            pa.array(docs),
            pa.array(start.astype(np.int32)),
            pa.array(stop.astype(np.int32)),
            *[pa.nulls(n, pa.list_(pa.int64())) if x is None else pa.array(list(x), pa.list_(pa.int64())) for x in lists],
        ],
        ["kind", "key", "doc", "start", "stop", "bands", "sketch"],
    )


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, shingles)`` of every paragraph: its distinct shingle hashes."""
    for batch in batches:
        stream = Stream(batch.column(0).to_pylist())
        s, lines = stream.shingles(), _lines(stream)
        if len(lines):
            starts, ends = stream.line_starts[lines], stream.line_ends[lines]
            sets = [np.unique(s[a : b - WIDTH + 1]).view(np.int64) for a, b in zip(starts, ends, strict=True)]
            keys = stream.spans(starts, ends).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])


def _may_be_similar(a: str, b: str):
    """What the sketches of two paragraphs allow, as a condition on struct columns ``a`` and ``b``.

    A bit that one sketch has and the other lacks is a shingle that only one has. A similarity of
    t needs t / (1 + t) of both sizes in common; sizes lie between the bits set and the words.
    """
    share = THRESHOLD / (1 + THRESHOLD)

    def only(x: str, y: str):
        missing = [F.bit_count(F.get(f"{x}.sketch", F.lit(k)).bitwiseAND(F.bitwise_not(F.get(f"{y}.sketch", F.lit(k))))) for k in range(SKETCH)]
        set_bits = [F.bit_count(F.get(f"{y}.sketch", F.lit(k))) for k in range(SKETCH)]
        return sum(missing[1:], missing[0]) <= (1 - share) * F.col(f"{x}.n") - share * sum(set_bits[1:], set_bits[0])

    return only(a, b) & only(b, a)


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of Jaccard THRESHOLD or more that span each bucket's classes; rows come sorted by bucket.

    Paragraphs that are not open are one class already, their centre's. An open one is compared
    with what its sketch allows and its class does not hold yet, and only pairs that join two
    classes are returned, at most one per paragraph.
    """
    share = THRESHOLD / (1 + THRESHOLD)

    def pairs(key, n, open_, sketch, shingles):
        bits = np.bitwise_count(sketch).sum(axis=1)
        sets = [frozenset(x) for x in shingles]
        group = np.where(open_, np.arange(len(key)) + 1, 0)
        for k in np.flatnonzero(open_).tolist():
            here = np.bitwise_count(sketch[k] & ~sketch).sum(axis=1) <= (1 - share) * n[k] - share * bits
            there = np.bitwise_count(sketch & ~sketch[k]).sum(axis=1) <= (1 - share) * n - share * bits[k]
            for j in np.flatnonzero(here & there).tolist():
                if group[j] == group[k]:
                    continue
                common = len(sets[k] & sets[j])
                if common >= THRESHOLD * (len(sets[k]) + len(sets[j]) - common):
                    group[group == group[k]] = group[j]
                    yield key[k], key[j]

    def emit(columns):
        found = list(pairs(*columns))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["key", "other"])

    band, held = None, None
    for batch in batches:
        bands = np.asarray(batch.column(0))
        sketches = np.asarray(batch.column(4).flatten()).reshape(-1, SKETCH).view(np.uint64)
        shingles = np.empty(len(bands), object)
        for k, x in enumerate(batch.column(5).to_pylist()):
            shingles[k] = x
        columns = [np.asarray(batch.column(1)), np.asarray(batch.column(2)), np.array(batch.column(3).to_pylist()), sketches, shingles]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bands)) + 1, [len(bands)]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = [c[a:b] for c in columns]
            if held is not None and bands[a] == band:
                held = [np.concatenate(x) for x in zip(held, part, strict=True)]
                continue
            if held is not None:
                yield from emit(held)
            band, held = bands[a], part
    if held is not None:
        yield from emit(held)


def _shared_bands(lines: DataFrame) -> DataFrame:
    """``(band, key, centre)`` of the paragraphs that share a band, by band."""
    # The commonest paragraph of a bucket is its centre: what was changed differs least from it.
    narrow = lines.select("key", "rare", F.explode("bands").alias("band"))
    centre = narrow.groupBy("band").agg(F.min(F.struct("rare", "key")).alias("c"), F.count("*").alias("m")).filter("m > 1")
    return narrow.drop("rare").join(centre.select("band", F.col("c.key").alias("centre")), "band")


def _similar_lines(
    units: DataFrame, rows: DataFrame, sets_of=_line_sets, columns: tuple = ("_t",), members_of=_shared_bands
) -> DataFrame:
    """``(key, other)``: pairs of different paragraphs of Jaccard THRESHOLD or more, enough to span each class.

    Sketches are part of the condition on which paragraphs meet, so that many that were each
    changed elsewhere do not become pairs.
    """
    lines = materialize(
        units.filter("kind = 1")
        .groupBy("key")
        .agg(
            F.min("doc").alias("doc"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
            F.first(F.col("stop") - F.col("start") - (WIDTH - 1)).alias("n"),
            (-F.count("*")).alias("rare"),
        ),
        "sub-lines",
    )
    members = materialize(members_of(lines), "sub-bands")
    # Sketches and owners only of what collides.
    colliding = lines.join(members.select("key").distinct(), "key", "left_semi")
    colliding = materialize(colliding.select("key", "doc", F.struct("key", "n", "sketch").alias("p")), "sub-sketches")
    others = members.filter("key <> centre").join(colliding.select("key", "p"), "key")
    others = others.join(colliding.select(F.col("key").alias("centre"), F.col("p").alias("c")), "centre")
    starred = others.filter(_may_be_similar("p", "c")).select("key", F.col("centre").alias("other"))
    owners = colliding.select("doc").distinct()
    sets = (
        rows.join(owners, F.col("_i") == F.col("doc"), "left_semi")
        .select(*columns)
        .mapInArrow(sets_of, "key long, shingles array<long>")
        .join(colliding.select("key"), "key", "left_semi")
        .dropDuplicates(["key"])
    )
    sets = materialize(sets, "sub-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(sets.toDF("key", "_a"), "key").join(sets.toDF("other", "_b"), "other")
        common = F.size(F.array_intersect("_a", "_b"))
        return joined.filter(common >= THRESHOLD * (F.size("_a") + F.size("_b") - common)).select("key", "other")

    first = materialize(verified(starred.distinct()), "sub-pairs")
    # What its bucket's smallest did not link meets the others of the bucket.
    open_ = members.filter("key <> centre").join(first.toDF("key", "centre"), ["key", "centre"], "left_anti")
    flags = open_.select("band", "key", F.lit(True).alias("open"))
    dealt = members.filter("key <> centre").join(flags, ["band", "key"], "left")
    dealt = dealt.select("band", "key", F.coalesce("open", F.lit(False)).alias("open"))
    # Buckets in which everything is linked are done.
    unsettled = dealt.join(flags.select("band").distinct(), "band", "left_semi")
    buckets = unsettled.join(colliding.select("key", "p").join(sets, "key"), "key")
    buckets = buckets.select("band", "key", "p.n", "open", "p.sketch", "shingles")
    rest = buckets.repartition("band").sortWithinPartitions("band").mapInArrow(_bucket_pairs, "key long, other long")
    return first.union(rest)


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, start, stop, owner)``: word spans of a document that a smaller one has too.

    ``owner`` is the smallest document with the passage or one similar to it.
    """
    rows = docs.select(text_or_empty(text).cast("binary").alias("_t"), F.col(id_col).cast("long").alias("_i"))
    rows = rows.filter(F.col("_i").isNotNull())
    units = materialize(rows.mapInArrow(_find_units, _UNITS), "sub-units")
    # Windows and lines that several documents have as they are.
    exact = units.groupBy("kind", "key").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
    exact = materialize(exact.filter("kind = 1 OR owner <> last").select("kind", "key", "owner"), "sub-owners")
    # Similar lines: classes of line keys, owned by the smallest document of any of them.
    classes = connected_components(_similar_lines(units, rows).toDF("a", "b"))
    line_owner = exact.filter("kind = 1").join(classes.withColumnRenamed("node", "key"), "key", "left")
    by_class = line_owner.filter("component IS NOT NULL").groupBy("component").agg(F.min("owner").alias("class_owner"))
    line_owner = line_owner.join(by_class, "component", "left").select(
        "kind", "key", F.least("owner", F.coalesce("class_owner", "owner")).alias("owner")
    )
    owners = exact.filter("kind = 0").union(line_owner)
    return (
        units.drop("bands", "sketch")
        .join(owners, ["kind", "key"])
        .filter("doc <> owner")
        .select(F.col("doc").alias(id_col), "start", "stop", "owner")
        .distinct()
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id: ``component_id``, ``n_links``, ``dup_words``, ``spans``.

    ``spans`` are the word spans to remove, ``[start, stop)``, merged where they touch; the smallest
    document with a passage keeps it. ``n_links`` counts the documents that own them, ``dup_words``
    the words. ``component_id`` is the smallest document reachable by shared passages, itself
    included. A null, empty or short text shares nothing. Rows that repeat an id are read as one
    document; a null id gets a row without links. Texts of any length are read whole. An empty
    table gives an empty result.
    """
    passages = materialize(shared_passages(docs, id_col, text), "sub-passages")
    found = connected_components(passages.select(F.col(id_col).alias("a"), F.col("owner").alias("b")))
    by_start = Window.partitionBy(id_col).orderBy("start", "stop")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = passages.withColumn("new", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    numbered = opened.withColumn("run", F.sum("new").over(by_start))
    merged = numbered.groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = merged.groupBy(id_col).agg(
        F.sum(F.col("stop") - F.col("start")).alias("dup_words"),
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"),
    )
    links = passages.groupBy(id_col).agg(F.countDistinct("owner").alias("n_links"))
    ids = docs.select(F.col(id_col).cast("long").alias(id_col)).distinct()
    return (
        ids.join(found.withColumnRenamed("node", id_col), id_col, "left")
        .join(links, id_col, "left")
        .join(spans, id_col, "left")
        .select(
            id_col,
            F.coalesce("component", id_col).alias("component_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("dup_words", F.lit(0).cast("long")).alias("dup_words"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
        )
    )


def substring_query(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
