"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.llm.text import WS, Shelf, text_or_empty, words

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "a an and are as at be by for from has he in is it of on or re that the this to was with",
    "de": "auf das dem den der des die ein eine er für ist im in mit nicht sich sie und von zu zum",
    "fr": "au aux ce dans de des du elle en est et il la le les on ou par pas pour que qui un une",
    "es": "con de del el en es la las lo los más no o para por que se su un una y",
}


@dataclass(frozen=True)
class Rule:
    """A measured value must lie in ``[low, high]``; an open end is None."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word or per line, so they hold for texts of any length.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _measures() -> dict[str, Column]:
    """Ratios over the counted columns; a ratio over nothing is 0."""

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression: every rule holds."""
    measures = _measures()
    tests = [F.lit(True)]
    for rule in rules:
        if rule.low is not None:
            tests.append(measures[rule.measure] >= rule.low)
        if rule.high is not None:
            tests.append(measures[rule.measure] <= rule.high)
    return reduce(lambda a, b: a & b, tests)


def _pinned(column: Column) -> Column:
    """The same values, evaluated once per row where they stand.

    A filter on a result is otherwise pushed below, with the expressions written out in place of
    their names; an array named inside a lambda would then be made anew for each element.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def _window_hash(*three: Column) -> Column:
    return F.xxhash64(*three)


def _repeated_words(words_col: Column, packed: Column, bits: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    ``packed`` holds one long per window, its hash above the ``bits`` of its position, in sorted
    order, so equal windows are neighbours unless another window has their hash. Neighbours with one
    hash are compared word by word; a window that differs from both is compared with all of its
    hash. What remains is the measure of a union of ``[p, p + 3)`` over the repeated positions ``p``.
    """
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def at(x: Column) -> Column:
        return x.bitwiseAND(mask).cast("int")

    def one_hash(x: Column, other: Column) -> Column:
        return F.coalesce(F.call_function("shiftright", x.bitwiseXOR(other), bits) == 0, F.lit(False))

    def same(x: Column, other: Column) -> Column:
        equal = one_hash(x, other)
        for k in range(3):
            equal = equal & (F.get(words_col, at(x) + k) == F.get(words_col, at(other) + k))
        return F.coalesce(equal, F.lit(False))

    def found(x: Column, k: Column) -> Column:
        after, before = F.get(packed, k + 1), F.get(packed, k - 1)
        clash = one_hash(x, after) | one_hash(x, before)
        return F.when(same(x, after) | same(x, before), F.lit(True)).when(
            clash, F.exists(packed, lambda y: (y != x) & same(x, y))
        ).otherwise(F.lit(False))

    repeated = F.filter(packed, found)
    positions = F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(mask)))
    covered = F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last")),
        lambda acc, p: F.struct(
            (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"), p.alias("last")
        ),
        lambda acc: acc["sum"],
    )
    return covered


def score_quality(
    docs: DataFrame,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``.

    A null or empty text counts as no words and fails the base rule. Texts of any length are read
    whole. Repeated rows are judged alike, each on its own; an empty table gives an empty result.
    Columns of ``docs`` keep their names; a clashing name gives way to the computed column.
    """
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    made = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_stop_words", "n_lines", "base_failed", "kept",
    ]
    shelf = Shelf(docs, tuple(made))
    whole = text_or_empty(shelf.of(text))
    split = shelf.table.select(
        *shelf.columns,
        whole.alias("_text"),
        _pinned(words(whole)).alias("_words"),
        F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{WS}]")).alias("_lines"),
    )
    # As many bits as positions of this text need, so the hash gets all others.
    split = split.withColumn("_bits", _pinned(F.ceil(F.log2(F.size("_words") + 2)).cast("int")))
    hashed = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.call_function(
            "shiftleft", _window_hash(w, F.get("_words", i + 1), F.get("_words", i + 2)), F.col("_bits")
        ).bitwiseOR(i.cast("long")),
    )
    sorted_ = split.select("*", _pinned(F.sort_array(hashed)).alias("_packed"))
    counted = sorted_.select(
        *shelf.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", f"[{WS}]+", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", "")))
        .cast("long")
        .alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _pinned(_repeated_words(F.col("_words"), F.col("_packed"), F.col("_bits"))).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    judged = counted.select("*", failed.alias("base_failed"))
    return shelf.back(judged.select("*", (~F.col("base_failed") & compile_rules(rules)).alias("kept")))


def quality_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_stop_words", "n_lines",
    )


def _sql() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for line in STOP_WORDS.values() for w in line.split()}))
    tests = []
    for rule in RULES:
        value = {
            "mean_word_chars": "word_chars / n_words",
            "symbol_ratio": "n_symbols / n_words",
            "stop_ratio": "n_stop_words / n_words",
            "dup_line_ratio": "n_dup_lines / n_lines",
        }[rule.measure]
        if rule.low is not None:
            tests.append(f"coalesce({value}, 0) >= {rule.low}")
        if rule.high is not None:
            tests.append(f"coalesce({value}, 0) <= {rule.high}")
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
r AS (
  SELECT row_number() OVER () AS row_id, * FROM t),
windows AS (
  SELECT row_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS p FROM r)),
found AS (
  SELECT row_id, p, count(*) OVER (PARTITION BY row_id, a, b, c) AS times FROM windows),
covered AS (
  SELECT row_id, count(DISTINCT p + k) AS n_repeat_words
  FROM found, (SELECT unnest([0, 1, 2]) AS k) WHERE times >= 2 GROUP BY row_id),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(l) AS BIGINT) AS n_lines
  FROM r LEFT JOIN covered USING (row_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE WHEN n_words = 0 THEN false ELSE {" AND ".join(tests)} END AS kept,
       n_stop_words, n_lines
FROM judged"""


QUALITY_SQL = _sql()
