"""Text edge lists: ``src dst [weight]`` per line, with an optional ``nodes edges`` header."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwright.model import EdgeListError
from arcwright.session import materialize


@dataclass
class ParsedGraph:
    """Edges in file order (``ord``), and what parsing found."""

    num_nodes: int
    edges: DataFrame
    num_edges: int
    weighted: bool
    had_header: bool
    self_loops_removed: int
    duplicates_removed: int


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, ord)`` of a text file, or of a folder's files in the order of their names.

    ``ord`` rises with the lines, across splits and files: the files' sizes are added up by name,
    and a split counts from where it starts. A line takes a byte at least, so no two lines meet.
    """
    meta = {"file": "file_path", "size": "file_size", "at": "file_block_start"}
    lines = spark.read.text(path).select("value", *[F.col(f"_metadata.{field}").alias(name) for name, field in meta.items()])
    # Within a split the generated id rises with the line; a split's first line has its least one.
    numbered = materialize(lines.withColumn("id", F.monotonically_increasing_id()), "lines")
    splits = numbered.groupBy("file", "at").agg(F.min("id").alias("first"))
    by_name = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = numbered.groupBy("file").agg(F.max("size").alias("size")).select(
        "file", F.coalesce(F.sum("size").over(by_name), F.lit(0)).alias("before")
    )
    starts = splits.join(files, "file").select("file", "at", (F.col("before") + F.col("at") - F.col("first")).alias("shift"))
    return numbered.join(starts, ["file", "at"]).select("value", (F.col("id") + F.col("shift")).alias("ord"))


def tokenize(lines: DataFrame) -> DataFrame:
    """``(tokens, ord)`` of the lines that are neither blank nor a comment (``#`` or ``%``)."""
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.select(text.alias("t"), "ord").filter(~F.col("t").rlike("^[#%]") & (F.col("t") != "")).select(
        F.split("t", r"(?U)\s+").alias("tokens"), "ord"
    )


def integer(token: Column) -> Column:
    """A token as a long, or null; a sign and single underscores between digits are allowed."""
    return F.when(token.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(token, "_", "").try_cast("long"))


def _at(k: int) -> Column:
    return integer(F.get("tokens", k))


def has_header(tokens: DataFrame, weighted: bool) -> bool:
    """Whether the first row declares nodes and edges that the other rows bear out."""
    first = tokens.agg(F.min_by("tokens", "ord").alias("tokens"), F.min("ord").alias("ord"), F.count("*").alias("n")).select(
        "ord", "n", F.size("tokens").alias("width"), _at(0).alias("nodes"), _at(1).alias("edges")
    ).first()
    if first["n"] == 0:
        raise EdgeListError("no rows in the edge list")
    nodes, edges = first["nodes"], first["edges"]
    if first["width"] != 2 or nodes is None or edges is None or nodes <= 0 or edges != first["n"] - 1:
        return False
    width = 3 if weighted else 2
    body = tokens.filter(F.col("ord") > first["ord"]).agg(
        F.coalesce(F.every((F.size("tokens") >= width) & _at(0).isNotNull() & _at(1).isNotNull()), F.lit(True)).alias("sound"),
        F.coalesce(F.max(F.greatest(_at(0), _at(1))), F.lit(0)).alias("max_id"),
    ).first()
    return bool(body["sound"]) and max(body["max_id"], 0) < nodes


def parse_lines(
    lines: DataFrame, weighted: bool = False, drop_self_loops: bool = True, drop_duplicates: bool = True
) -> ParsedGraph:
    """Cast, validate and clean. Self-loops go first; of duplicates the first in file order stays."""
    tokens = materialize(tokenize(lines), "tokens")
    header = has_header(tokens, weighted)
    declared = 0
    body = tokens
    if header:
        first = tokens.agg(F.min("ord").alias("o"), F.min_by(_at(0), "ord").alias("n")).first()
        body, declared = tokens.filter(F.col("ord") > first["o"]), first["n"]
    width = 3 if weighted else 2
    rows = body.select(
        "ord",
        "tokens",
        _at(0).alias("src"),
        _at(1).alias("dst"),
        (_at(2) if weighted else F.lit(1).cast("long")).alias("weight"),
    )
    problem = (
        F.when(F.size("tokens") < width, F.concat(F.lit(f"a row has {width} columns at least, this one "), F.size("tokens").cast("string")))
        .when(F.col("src").isNull() | F.col("dst").isNull() | F.col("weight").isNull(), F.lit("a column that is no whole number"))
        .when((F.col("src") < 0) | (F.col("dst") < 0), F.lit("a node id below zero"))
        .when(F.col("weight") < 0, F.lit("a weight below zero"))
    )
    loop = (F.col("src") == F.col("dst")) if drop_self_loops else F.lit(False)
    seen = rows.agg(
        F.min_by("ord", F.when(problem.isNotNull(), F.col("ord"))).alias("bad"),
        F.min_by(problem, F.when(problem.isNotNull(), F.col("ord"))).alias("why"),
        F.count_if(loop).alias("loops"),
        F.count("*").alias("n"),
    ).first()
    if seen["why"] is not None:
        line = body.filter(F.col("ord") <= seen["bad"]).count() + header
        raise EdgeListError(f"line {line}: {seen['why']}")
    edges = rows.filter(~loop).select("src", "dst", "weight", "ord")
    if drop_duplicates:
        edges = edges.groupBy("src", "dst").agg(F.min_by("weight", "ord").alias("weight"), F.min("ord").alias("ord"))
    edges = materialize(edges, "edges")
    total = edges.agg(F.count("*").alias("n"), F.max(F.greatest("src", "dst")).alias("max_id")).first()
    num_nodes = max(declared, (-1 if total["max_id"] is None else total["max_id"]) + 1)
    if num_nodes <= 0:
        raise EdgeListError("no edge is left after cleaning")
    return ParsedGraph(
        num_nodes, edges, total["n"], weighted, header, seen["loops"], seen["n"] - seen["loops"] - total["n"]
    )


def parse_edge_list(spark: SparkSession, path: str, weighted: bool = False, **options: bool) -> ParsedGraph:
    return parse_lines(read_lines(spark, path), weighted, **options)


def edges_from_table(df: DataFrame, src: str, dst: str, weight: Column | None = None) -> DataFrame:
    """Distinct edges of any table, without self-loops; the least weight of equal edges stays."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    return (
        df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("weight"))
        .filter(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.min("weight").alias("weight"))
    )
