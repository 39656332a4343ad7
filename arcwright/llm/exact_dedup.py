"""Exact dedup by Patricia-trie owners.

Texts meet by byte length and content hash. Before that exchange, each input partition merges its
own copies in a trie, so a text that a third of all rows share reaches its owner once per input
partition. The owner inserts whole byte strings into a compressed radix trie, whose terminal nodes
hold the smallest id and the number of rows. Documents then look their owner up by the digest of
the normalised text; the copies of a text stay spread over that join's document side, which
adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.llm.text import Shelf, collapsed, text_or_empty
from arcwright.llm.trie import PatriciaOwners

#: Bytes of trie that a task holds before it passes copies on (combiner) or spills (owner).
TRIE_BYTES = 48 << 20

_SCHEMA = "key binary, digest binary, id long, n long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    key, digest, ident, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.binary()), pa.array(digest, pa.binary()), pa.array(ident, pa.int64()), pa.array(n, pa.int64())],
        ["key", "digest", "id", "n"],
    )


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within one batch become one row; what is held is one batch, whatever the input."""
    for batch in batches:
        trie = PatriciaOwners(budget=1 << 62)
        for key, digest, ident, n in _rows(batch):
            trie.insert(key, ident, n, (key, digest))
        out, size = [], 0
        for ident, n, (key, digest) in trie.owners():
            out.append((key, digest, ident, n))
            size += len(key)
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaOwners(budget=TRIE_BYTES)
    for batch in batches:
        for key, digest, ident, n in _rows(batch):
            trie.insert(key, ident, n, digest)
    out = []
    for ident, n, digest in trie.owners():
        out.append((digest, ident, n))
        if len(out) == 10_000:
            yield _owners(out)
            out = []
    if out:
        yield _owners(out)


def _owners(rows: list[tuple]) -> pa.RecordBatch:
    digest, ident, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(digest, pa.binary()), pa.array(ident, pa.int64()), pa.array(n, pa.int64())],
        ["_digest", "keep_id", "group_size"],
    )


def _digest(key: Column) -> Column:
    """SHA-256; never null, so that no join adds a null test that computes it once more."""
    return F.coalesce(F.unhex(F.sha2(key, 256)), F.lit(b""))


def text_owners(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct normalised text: ``_digest`` (SHA-256), ``keep_id``, ``group_size``."""
    whole = collapsed(text_or_empty(text)).cast("binary")
    local = docs.select(
        whole.alias("key"),
        _digest(whole).alias("digest"),
        F.col(id_col).cast("long").alias("id"),
        F.lit(1).cast("long").alias("n"),
    ).mapInArrow(_combine, _SCHEMA)
    return local.repartition(F.length("key"), F.xxhash64("key")).mapInArrow(
        _own, "_digest binary, keep_id long, group_size long"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are after each run of white space became one space. A null text
    counts as empty, and empty texts are copies of each other. Of equal texts the smallest id
    stays; rows that repeat that id all count as kept. A null id never owns a text that a row
    with an id has. Texts of any length are compared whole. An empty table gives an empty result.
    A column of ``docs`` that clashes with a result column gives way to it.
    """
    shelf = Shelf(docs, ("keep_id", "group_size", "kept", "text_sha256"))
    ident, whole = shelf.of(id_col), shelf.of(text)
    digest = _digest(collapsed(text_or_empty(whole)).cast("binary"))
    out = (
        shelf.table.select(*shelf.columns, F.col(ident).alias("_id"), digest.alias("_digest"))
        .join(text_owners(shelf.table, ident, whole), "_digest")
        .select(
            *shelf.columns,
            "keep_id",
            "group_size",
            F.col("_id").cast("long").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )
    )
    return shelf.back(out)


def exact_dedup_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, CAST(min(doc_id) OVER w AS BIGINT) AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""
