"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame and SQL terms only.

Equal-token blocks are dealt to sources by highest quotients ``v / (2 s + 1)``, then within each
source to its seeded hash shards, again by highest quotients. In a shard the documents lie in
seeded order, as one stream of tokens cut into equal blocks; a quota takes whole passes over the
blocks and, for the rest, a circular run of blocks from a seeded start. So every number a document
needs follows from its offset in its shard, and no block is ever a row.

Quotients are not enumerated either. Seats that any divisor near the quota gives are taken at
once; the at most two or so contested seats per party are ranked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm.text import Shelf, text_or_empty, words
from arcwright.session import materialize

#: Words of a block.
BLOCK_WORDS = 32
#: Documents that a shard of the whole corpus has on average, and the most shards there are.
SHARD_DOCS, MAX_SHARDS = 256, 8192
#: Weights by position of the source, repeating.
WEIGHTS = (3, 1, 2)

_TARGETS = """
WITH s AS (
  SELECT source, sum(size) AS source_size FROM {shards} GROUP BY source),
w AS (
  SELECT *, element_at(array({weights}), CAST((pos - 1) % {n_weights} + 1 AS INT)) AS weight,
         sum(source_size) OVER () AS total
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM s)),
filled AS (
  SELECT *, {cap} * source_size / weight AS full_at,
         CAST({share_num} * total - {share_den} * {cap} * coalesce(sum(source_size) OVER before, 0) AS DOUBLE)
           / ({share_den} * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))) AS level,
         row_number() OVER (ORDER BY {cap} * source_size / weight, pos) AS k
  FROM w WINDOW before AS (
    ORDER BY {cap} * source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT min_by(level, k) AS level FROM filled WHERE level <= full_at)
SELECT filled.source, pos, source_size,
       least(CAST({cap} * source_size AS DOUBLE), water.level * weight) AS target
FROM filled CROSS JOIN water"""

#: Sainte-Laguë: ``seats`` of each house go to the parties with the highest quotients.
_SEATS = """
WITH v AS (
  SELECT *, sum(votes) OVER (PARTITION BY house) AS all_votes, count(*) OVER (PARTITION BY house) AS parties
  FROM {parties}),
bounds AS (
  SELECT *,
    CASE WHEN all_votes > 0 THEN greatest(0, CAST(floor(votes * (seats - parties / 2D - 1) / all_votes + 0.5D) AS BIGINT))
         ELSE 0 END AS sure,
    CASE WHEN all_votes > 0 THEN CAST(floor(votes * (seats + parties / 2D + 1) / all_votes + 0.5D) AS BIGINT) + 1
         ELSE 0 END AS most
  FROM v),
contested AS (
  SELECT house, party, sure, free, seat, votes / (2D * seat - 1) AS quotient
  FROM (SELECT *, seats - sum(sure) OVER (PARTITION BY house) AS free FROM bounds)
  LATERAL VIEW explode(CASE WHEN most > sure THEN sequence(sure + 1, most) ELSE array(sure + 1) END) AS seat),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY house ORDER BY quotient DESC, party, seat) AS place FROM contested)
SELECT house, party, max(sure) + count_if(quotient > 0 AND place <= free) AS quota
FROM ranked GROUP BY house, party"""


def _targets_sql(share: tuple[int, int], cap: int) -> str:
    return (
        _TARGETS.replace("{weights}", ", ".join(map(str, WEIGHTS)))
        .replace("{n_weights}", str(len(WEIGHTS)))
        .replace("{cap}", f"{cap}L")
        .replace("{share_num}", f"{share[0]}L")
        .replace("{share_den}", f"{share[1]}L")
    )


def _run(sql: str, name: str, table: DataFrame) -> DataFrame:
    """The query with ``{name}`` standing for ``table``."""
    view = f"{name}_{uuid.uuid4().hex}"
    table.createOrReplaceTempView(view)
    out = table.sparkSession.sql(sql.replace("{" + name + "}", view))
    table.sparkSession.catalog.dropTempView(view)  # the plan has it by now
    return out


def word_count(text: str):
    return F.size(words(text_or_empty(text))).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: str | None = None,
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: int = 42,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``.

    ``share`` of all words (a fraction) goes to the sources by weight, none above ``cap`` times its
    own words; what is above goes to the rest by weight. Sources are ordered by code point; a null
    source is one source, the last. ``taken`` is the number of the document's words in the mix,
    repeats counted, at most ``cap`` times its size. A null, empty or blank text has size 0 and
    nothing taken; a text of any length is counted whole. Ties in the seeded order fall to id, then size; repeated rows are documents of
    their own. An empty table gives an empty result. ``size`` names a column that already holds
    the word count. A column of ``docs`` that clashes with a result column gives way to it.
    """
    shelf = Shelf(docs, ("size", "source_size", "target", "taken"))
    docs, id_col, source = shelf.table, shelf.of(id_col), shelf.of(source)
    counted = F.col(shelf.of(size)) if size else word_count(shelf.of(text))
    n_docs = docs.count()
    shards = max(1, min(MAX_SHARDS, -(-n_docs // SHARD_DOCS)))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))))
    rows = docs.select(
        *shelf.columns,
        counted.alias("size"),
        F.col(source).alias("_source"),
        F.struct(key.alias("k"), F.col(id_col).alias("i"), counted.alias("s")).alias("_order"),
        F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(shards)).alias("_shard"),
    )
    # One row per source and shard: all that the apportionment reads.
    totals = materialize(
        rows.groupBy(F.col("_source").alias("source"), F.col("_shard").alias("shard")).agg(F.sum("size").alias("size")),
        "mix-shards",
    )
    targets = materialize(_run(_targets_sql(share, cap), "shards", totals), "mix-targets")
    by_source = _run(
        _SEATS,
        "parties",
        targets.select(
            F.lit(0).alias("house"),
            F.col("pos").alias("party"),
            F.col("target").alias("votes"),
            F.round(F.sum("target").over(_whole()) / block_words).cast("long").alias("seats"),
        ),
    )
    quotas = targets.drop("weight").join(by_source, F.col("party") == F.col("pos")).select(
        "source", "pos", "source_size", "target", F.col("quota").alias("seats")
    )
    by_shard = _run(
        _SEATS,
        "parties",
        totals.withColumnRenamed("source", "_s")
        .join(quotas, F.col("_s").eqNullSafe(F.col("source")))
        .select(
            F.col("pos").alias("house"), F.col("shard").alias("party"), F.col("size").cast("double").alias("votes"), "seats"
        ),
    )
    blocks = F.greatest(F.lit(1), F.round(F.col("size") / block_words)).cast("long")
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("pos"), F.col("shard"))), 1, 8), 16, 10)
    plan = (
        totals.join(quotas.withColumnRenamed("source", "_s").drop("seats"), F.col("source").eqNullSafe(F.col("_s")))
        .join(by_shard, (F.col("house") == F.col("pos")) & (F.col("party") == F.col("shard")))
        .select(
            F.col("source").alias("_ps"),
            F.col("shard").alias("_psh"),
            "source_size",
            "target",
            F.col("size").alias("_len"),
            blocks.alias("_n"),
            F.least(F.col("quota"), cap * blocks).alias("_quota"),
            F.pmod(first.cast("long"), blocks).alias("_first"),
        )
    )
    plan = materialize(plan, "mix-plan")
    placed = rows.withColumn(
        "_end", F.expr("sum(size) OVER (PARTITION BY _source, _shard ORDER BY _order ROWS UNBOUNDED PRECEDING)")
    ).join(plan, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_shard") == F.col("_psh")))
    taken = F.expr(_TAKEN)
    return shelf.back(placed.select(*shelf.columns, "size", "source_size", "target", taken.alias("taken")))


#: Whole passes, then the overlap with the run of blocks and with what of it wraps around.
_TAKEN = """
(_quota div _n) * size
+ greatest(0L, least(_end, least(_first + _quota % _n, _n) * _len div _n) - greatest(_end - size, _first * _len div _n))
+ greatest(0L, least(_end, greatest(0L, _first + _quota % _n - _n) * _len div _n) - (_end - size))"""


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy()


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it, whole.

    A document that a run of blocks cuts is in the run if at least half of its words are. Rows
    with no words are never taken.
    """
    shelf = Shelf(docs)
    named = {key: shelf.of(options.pop(key, default)) for key, default in (("id_col", "doc_id"), ("source", "source"), ("text", "text"))}
    mixed = mix(shelf.table, **named, **options)
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = mixed.filter(F.col("size") > 0).withColumn("_times", times).filter(F.col("_times") > 0)
    copies = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return shelf.back(copies.select(*shelf.columns))


def mixture_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    return mix(sized.withColumnRenamed("size", "_words"), size="_words").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


#: The same mix with every quotient written out and every block overlap as a plain interval.
MIXTURE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(concat('42|', coalesce(CAST(doc_id AS VARCHAR), '-'))) AS k
  FROM documents),
n AS (SELECT least({MAX_SHARDS}, greatest(1, (count(*) + {SHARD_DOCS - 1}) // {SHARD_DOCS})) AS shards FROM d),
r AS (
  SELECT d.*, CAST(('0x' || k[1:8]) AS BIGINT) % shards AS shard FROM d, n),
src AS (
  SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, sum(source_size) OVER () AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM r GROUP BY source)),
levels AS (
  SELECT a.pos, CAST(3 * any_value(a.total) - 4 * coalesce(sum(b.source_size) FILTER (b.full_at < a.full_at
             OR b.full_at = a.full_at AND b.pos < a.pos), 0) AS DOUBLE)
           / (2 * (sum(b.weight) FILTER (b.full_at > a.full_at OR b.full_at = a.full_at AND b.pos >= a.pos))) AS level,
         any_value(a.full_at) AS full_at
  FROM (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS full_at FROM src) a,
       (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS full_at FROM src) b GROUP BY a.pos),
t AS (
  SELECT src.*, least(CAST(2 * source_size AS DOUBLE),
           (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at) * weight) AS target FROM src),
house AS (SELECT CAST(round(sum(target) / {BLOCK_WORDS}) AS BIGINT) AS seats FROM t),
q1 AS (
  SELECT pos, row_number() OVER (ORDER BY target / (2 * s - 1) DESC, pos, s) AS place
  FROM t, house, unnest(range(1, CAST(ceil(2 * target / {BLOCK_WORDS}) AS BIGINT) + 3)) AS u(s) WHERE target > 0),
sq AS (SELECT t.*, coalesce(c, 0) AS seats FROM t LEFT JOIN (
  SELECT pos, count(*) AS c FROM q1, house WHERE place <= seats GROUP BY pos) USING (pos)),
sh AS (
  SELECT sq.pos, sq.source, sq.source_size, sq.target, seats, shard, CAST(sum(size) AS BIGINT) AS len,
         CAST(greatest(1, round(sum(size) / {BLOCK_WORDS})) AS BIGINT) AS n
  FROM r JOIN sq ON r.source IS NOT DISTINCT FROM sq.source GROUP BY ALL),
q2 AS (
  SELECT pos, shard, seats, row_number() OVER (PARTITION BY pos ORDER BY len / (2 * s - 1) DESC, shard, s) AS place
  FROM sh, unnest(range(1, 2 * n + 4)) AS u(s) WHERE len > 0),
plan AS (
  SELECT sh.*, least(coalesce(c, 0), 2 * n) AS quota,
         CAST('0x' || md5(concat_ws('|', 42, pos, shard))[1:8] AS BIGINT) % n AS first
  FROM sh LEFT JOIN (SELECT pos, shard, count(*) AS c FROM q2 WHERE place <= seats GROUP BY 1, 2) USING (pos, shard)),
placed AS (
  SELECT r.doc_id, r.size, p.*, CAST(sum(r.size) OVER (PARTITION BY p.pos, p.shard ORDER BY k, doc_id, r.size
           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source AND r.shard = p.shard)
SELECT doc_id, size, source_size, target,
       CAST((quota // n) * size
         + greatest(0, least(e, least(first + quota % n, n) * len // n) - greatest(e - size, first * len // n))
         + greatest(0, least(e, greatest(0, first + quota % n - n) * len // n) - (e - size)) AS BIGINT) AS taken
FROM placed"""
