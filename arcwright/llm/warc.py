"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` stores the bytes of each distinct payload once, under its
SHA-256, which is computed again and compared whenever they are read. ``headers`` keeps, for every
record, the exact bytes that stand before its payload. A join of the two by digest gives the
original records back, byte for byte. Copies merge before the exchange (a partial aggregate per
input partition), so a payload that many pages share crosses it once per partition.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.session import discard, materialize, scratch_path

#: Payloads of fewer bytes are always written as responses.
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the profile that the WARC 1.1 standard names for equal payload digests.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def _sha256(payload: Column) -> Column:
    return F.coalesce(F.sha2(payload, 256), F.lit(""))


def _urn(record: Column) -> Column:
    """``<urn:page:ID:SERIAL>``; the id is left empty if null. The serial is the record's own."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(record["id"].cast("string"), F.lit("")), F.lit(":"), record["serial"].cast("string"), F.lit(">"))


def _header(kind: Column, refers: Column, record: Column, url: Column, sha1: Column, n: Column) -> Column:
    """Everything of a record that precedes its payload: the WARC header and the HTTP header."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(_END)
    )
    # A control character in a URL would end the header line.
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    block = F.octet_length(http) + F.when(kind == "response", n).otherwise(F.lit(0))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _urn(record)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(kind == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(refers))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    )
    return F.concat(lines, F.lit(_END), http).cast("binary")


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
    min_revisit: int = MIN_REVISIT_BYTES,
) -> str:
    """Write a record per row of ``pages`` to the archive at ``path``.

    Of records with equal payloads of at least ``min_revisit`` bytes, that with the largest id is
    a response and the others revisit it; rows that repeat the largest id are all responses. A
    null html is an empty payload, a null url an empty one, and a null id counts as smaller than
    any. Every row gets a record id of its own, also if its page id is null or repeats. A payload
    of any length is stored whole. An empty table makes an empty archive. Other columns of
    ``pages`` are not archived, so their names cannot clash.
    """
    payload = _payload(html)
    # Serials differ from run to run, so the rows that carry them are written before they are used.
    rows = materialize(
        pages.select(
            F.struct(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("serial")).alias("record"),
            F.col(url).alias("url"),
            _sha256(payload).alias("digest"),
            F.sha1(payload).alias("sha1"),
            F.octet_length(payload).cast("long").alias("n"),
        ),
        "warc-rows",
    )
    (
        pages.select(payload.alias("payload"))
        .groupBy(_sha256(F.col("payload")).alias("digest"))
        .agg(
            F.first("payload").alias("payload"),
            # A second digest and the length must agree before bytes count as stored.
            (
                (F.min(F.sha1("payload")) == F.max(F.sha1("payload")))
                & (F.min(F.octet_length("payload")) == F.max(F.octet_length("payload")))
            ).alias("verified"),
        )
        .withColumn("payload", F.when(F.col("verified"), F.col("payload")).otherwise(_clash()))
        .drop("verified")
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )
    # Structs order by id, nulls first, then serial.
    owners = rows.groupBy("digest").agg(F.max("record").alias("owner"))
    revisits = (F.col("n") >= min_revisit) & ~F.col("record.id").eqNullSafe(F.col("owner.id"))
    kind = F.when(revisits, "revisit").otherwise("response")
    header = _header(kind, F.col("owner"), F.col("record"), F.col("url"), F.col("sha1"), F.col("n"))
    (
        rows.join(owners, "digest")
        .select(header.alias("header"), "digest")
        .write.option("compression", "zstd")
        .parquet(f"{path}/headers")
    )
    discard(rows)
    return path


def _clash() -> Column:
    return F.raise_error(F.lit("two payloads have one digest")).cast("binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, put together again: what they say, their payload, and their bytes.

    ``payload_digest`` is what the record's header declares, and must be that of the stored bytes,
    which is computed once per distinct payload. ``payload_bytes`` of a response are counted in the
    record itself, whose block must be as long as the header declares; a revisit has those of the
    payload that it refers to. Whatever does not agree ends the read.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(
        "digest",
        F.when(_sha256(F.col("payload")) == F.col("digest"), F.sha1("payload"))
        .otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("string"))
        .alias("sha1"),
        "payload",
    )
    text = F.col("header").cast("string")

    def ident(name: str) -> Column:
        found = F.regexp_extract(text, rf"\r\n{name}: <urn:page:(-?\d*):\d+>\r\n", 1)
        return F.when(found != "", found).cast("long")

    parsed = spark.read.parquet(f"{path}/headers").select(
        "digest",
        "header",
        ident("WARC-Record-ID").alias("page_id"),
        F.regexp_extract(text, r"\r\nWARC-Record-ID: (<[^>]*>)\r\n", 1).alias("record_id"),
        F.regexp_extract(text, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        ident("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n", 1).alias("payload_digest"),
        # Of the record's own header, which ends at the first empty line.
        F.regexp_extract(F.substring_index(text, _END, 1), r"\r\nContent-Length: (\d+)$", 1).cast("long").alias("declared"),
        (F.octet_length("header") - F.octet_length(F.substring_index(text, _END, 1)) - len(_END)).alias("http"),
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header"), body, F.lit(_END.encode()))
    built = parsed.join(stored, "digest").select("*", record.alias("record"))
    in_record = F.octet_length("record") - F.octet_length("header") - len(_END)
    agrees = (F.col("payload_digest") == F.col("sha1")) & (F.col("declared") == F.col("http") + in_record)
    size = F.when(F.col("record_type") == "response", in_record).otherwise(F.octet_length("payload")).cast("long")
    return built.select(
        "page_id",
        F.when(agrees, size).otherwise(F.raise_error(F.lit("a record is not what its header declares")).cast("long")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        "record_id",
        "payload",
        "record",
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Write the records' bytes as WARC files, one per partition, each gzipped as a whole."""
    bare = F.expr(f"substring(record, 1, octet_length(record) - {len(_END)})").cast("string")
    records.select(bare.alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(header, block)`` of every record in the WARC files below ``path``, gzipped or plain.

    A file is one cell, so it may have 2 GB at most as it lies there; it is unpacked as a stream.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                plain = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                for header, block in _records(plain):
                    yield pa.RecordBatch.from_arrays([pa.array([header]), pa.array([block])], ["header", "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "header binary, block binary")


def _records(stream) -> Iterator[tuple[bytes, bytes]]:
    while True:
        line = stream.readline()
        if not line:
            return
        lines, length = [line], 0
        while line not in (b"\r\n", b""):
            line = stream.readline()
            lines.append(line)
            name, _, value = line.partition(b":")
            if name.lower() == b"content-length":
                length = int(value)
        block = stream.read(length)
        stream.read(len(_END))
        yield b"".join(lines), block


def warc_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = write_archive(pages, scratch_path(spark, "warc"))
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner, CAST(strlen(html) AS BIGINT) AS n FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> owner THEN owner END AS refers_to
FROM o"""
