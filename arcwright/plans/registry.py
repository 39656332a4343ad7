"""Registered graph queries, each with the same result in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.functions.geometry import (
    FANOUT,
    LEAF_ENTRIES,
    blocks_of_run,
    hash_capacity_column,
    index_geometry,
)
from arcwright.functions.hashing import C1, C2, EDGE_SEED, MIX1, MIX2, ROUND_ADD, probe_table, with_edge_hash
from arcwright.functions.names import sanitize_name_column
from arcwright.functions.pool import pool_sweep as sweep
from arcwright.operators import adjacency, paths, ranking, strong
from arcwright.plans import graphs
from arcwright.session import materialize, parts_for
from arcwright.sources.edgelist import parse_lines

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: PageRank iterations of the registered queries; no early stop, so that SQL can follow.
ROUNDS = 20
SOURCE = 0
NEAREST = 25
RANKS = (11, 60)
SCORES = (0.0002, 0.001)
SCORE_LIMIT = 500


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _with(body: str, recursive: bool = False, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{graphs.SQL.strip()}{more}\n{body}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    degs = degrees(spark, sf_dir)
    return degs.orderBy((F.col("in_deg") + F.col("out_deg")).desc(), "node").limit(100)


# Degrees.

_DEGREES = """, deg AS (
  SELECT node, CAST(coalesce(i, 0) AS BIGINT) AS in_deg, CAST(coalesce(o, 0) AS BIGINT) AS out_deg
  FROM n LEFT JOIN (SELECT src, count(*) AS o FROM dense GROUP BY 1) ON node = src
         LEFT JOIN (SELECT dst, count(*) AS i FROM dense GROUP BY 1) ON node = dst)"""


@query(_with("SELECT node, in_deg, out_deg FROM deg", more=_DEGREES))
def degrees(spark, sf_dir):
    return adjacency.degrees(graphs.nodes(spark, sf_dir), graphs.edges(spark, sf_dir))


@query(_with("SELECT node, out_deg FROM deg", more=_DEGREES))
def out_degree(spark, sf_dir):
    return degrees(spark, sf_dir).select("node", "out_deg")


@query(_with("SELECT node, in_deg FROM deg", more=_DEGREES))
def in_degree(spark, sf_dir):
    return degrees(spark, sf_dir).select("node", "in_deg")


@query(_with("SELECT node FROM deg WHERE out_deg = 0", more=_DEGREES))
def dangling_nodes(spark, sf_dir):
    return graphs.nodes(spark, sf_dir).join(graphs.edges(spark, sf_dir), F.col("node") == F.col("src"), "left_anti")


# Cleaning and ingest.


@query(_with("SELECT src, dst, weight FROM dense"))
def edge_dedup(spark, sf_dir):
    return graphs.edges(spark, sf_dir)


@query(_with("SELECT src, dst, weight FROM raw WHERE src <> dst"))
def self_loop_filter(spark, sf_dir):
    return graphs.raw_edges(spark, sf_dir).filter("src <> dst")


@query(
    _with(
        """SELECT count(*) AS edges_read, count(*) FILTER (src = dst) AS self_loops_removed,
       (SELECT count(*) FROM dense) AS edges,
       count(*) FILTER (src <> dst) - (SELECT count(*) FROM dense) AS duplicates_removed FROM raw"""
    )
)
def build_stats(spark, sf_dir):
    """One pass: partial counts by (src, dst), then totals; no distinct over the raw rows."""
    pairs = graphs.raw_edges(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))
    loop = F.col("src") == F.col("dst")
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("edges_read"),
        F.coalesce(F.sum(F.when(loop, F.col("n"))), F.lit(0)).alias("self_loops_removed"),
        F.count_if(~loop).alias("edges"),
        F.coalesce(F.sum(F.when(~loop, F.col("n") - 1)), F.lit(0)).alias("duplicates_removed"),
    )


def _rendered(spark, sf_dir) -> DataFrame:
    """DENSE as an edge-list text with a comment, blanks, a self-loop and a repeated line each."""
    edges = graphs.edges(spark, sf_dir)
    line = F.concat_ws(" ", "src", "dst", "weight")
    lines = edges.select(
        F.explode(
            F.array(
                F.concat(F.lit("# from "), F.col("src").cast("string")),
                F.concat(F.lit("  "), F.concat_ws("\t", "src", "dst", "weight"), F.lit(" extra ")),
                F.lit("   "),
                F.concat_ws(" ", "src", "src", "weight"),
                line,
            )
        ).alias("value")
    )
    return lines.withColumn("ord", F.monotonically_increasing_id())


@query(_with("SELECT src, dst, weight FROM dense"))
def edgelist_parse(spark, sf_dir):
    text = materialize(_rendered(spark, sf_dir), "edge-text")
    return parse_lines(text, weighted=True).edges.select("src", "dst", "weight")


@query(
    _with(
        """SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM dense) AS edges, true AS had_header,
       CAST(0 AS BIGINT) AS self_loops_removed, CAST(0 AS BIGINT) AS duplicates_removed"""
    )
)
def edgelist_header(spark, sf_dir):
    edges = graphs.kept_edges(spark, sf_dir)
    n = graphs.nodes(spark, sf_dir).count()
    head = spark.createDataFrame([(f"{n} {edges.count()}", -1)], "value string, ord long")
    body = edges.select(F.concat_ws(" ", "src", "dst", "weight").alias("value"), F.monotonically_increasing_id().alias("ord"))
    found = parse_lines(materialize(head.union(body), "edge-text"), weighted=True)
    row = (found.num_nodes, found.num_edges, found.had_header, found.self_loops_removed, found.duplicates_removed)
    return spark.createDataFrame(
        [row], "nodes long, edges long, had_header boolean, self_loops_removed long, duplicates_removed long"
    )


# Layout.

_CSR = (
    _DEGREES
    + """, csr AS (
  SELECT *, CAST(2 * coalesce(sum(out_deg) OVER before, 0) AS BIGINT) AS out_start,
         CAST(2 * coalesce(sum(in_deg) OVER before, 0) AS BIGINT) AS in_start
  FROM deg WINDOW before AS (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
)


@query(_with("SELECT node, in_deg, out_deg, out_start, in_start FROM csr", more=_CSR))
def csr_offsets(spark, sf_dir):
    return adjacency.csr_offsets(degrees(spark, sf_dir), stride=2)


@query(
    _with(
        """SELECT node, CAST(1 + CASE WHEN out_deg = 0 THEN 0
         ELSE (out_start + 2 * out_deg - 1) // 128 - out_start // 128 + 1 END AS BIGINT) AS expand_blocks FROM csr""",
        more=_CSR,
    )
)
def block_cost(spark, sf_dir):
    """Block requests of expanding each node: its record and its outgoing run."""
    return csr_offsets(spark, sf_dir).select(
        "node", (1 + blocks_of_run(F.col("out_start"), F.col("out_deg") * 2)).alias("expand_blocks")
    )


@query(
    _with(
        """SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS out_pos,
       row_number() OVER (PARTITION BY dst ORDER BY weight, src) AS in_pos FROM dense"""
    )
)
def adj_position(spark, sf_dir):
    placed = adjacency.adjacency_positions(graphs.edges(spark, sf_dir), order="weight")
    return placed.select("src", "dst", "out_pos", "in_pos")


@query(_with("SELECT dst AS neighbor, weight FROM dense WHERE src = 7"))
def out_neighbors(spark, sf_dir):
    return adjacency.out_neighbors(graphs.edges(spark, sf_dir), 7)


@query(_with("SELECT src AS neighbor, weight FROM dense WHERE dst = 7"))
def in_neighbors(spark, sf_dir):
    return adjacency.in_neighbors(graphs.edges(spark, sf_dir), 7)


@query(
    _with(
        """SELECT src AS node, count(*) AS degree,
       string_agg(concat(dst, ':', weight), ',' ORDER BY dst) AS neighbors FROM dense GROUP BY src"""
    )
)
def adjacency_list(spark, sf_dir):
    lists = adjacency.adjacency_lists(graphs.edges(spark, sf_dir))
    shown = F.transform("neighbors", lambda x: F.concat_ws(":", x["neighbor"], x["weight"]))
    return lists.select("node", F.size("neighbors").cast("long").alias("degree"), F.concat_ws(",", shown).alias("neighbors"))


_PROBES = """, probes AS (
  SELECT src, dst FROM dense UNION SELECT dst, src FROM dense UNION SELECT node, (node * 7 + 3) % (SELECT count(*) FROM n) FROM n)"""


def _probe_set(spark, sf_dir, edges) -> tuple[DataFrame, int]:
    """Every edge, every edge reversed, and one arbitrary pair per node; and rows enough for them and the edges."""
    nodes = graphs.nodes(spark, sf_dir)
    n = nodes.count()
    rows = n + 3 * edges.count()
    other = nodes.select(F.col("node").alias("src"), ((F.col("node") * 7 + 3) % n).alias("dst"))
    probes = edges.select("src", "dst").union(edges.select("dst", "src")).union(other)
    return probes.repartition(parts_for(spark, rows), "src", "dst").distinct(), rows


_HAS_EDGE = _with(
    """SELECT p.src, p.dst, weight IS NOT NULL AS exists, coalesce(weight, 0) AS weight
FROM probes p LEFT JOIN dense d ON p.src = d.src AND p.dst = d.dst""",
    more=_PROBES,
)


@query(_HAS_EDGE)
def has_edge(spark, sf_dir):
    edges = graphs.kept_edges(spark, sf_dir)
    probes, rows = _probe_set(spark, sf_dir, edges)
    return adjacency.probe_edges(probes, edges, rows)


@query(_HAS_EDGE)
def has_edge_by_scan(spark, sf_dir):
    edges = graphs.kept_edges(spark, sf_dir)
    probes, rows = _probe_set(spark, sf_dir, edges)
    return adjacency.probe_edges_by_scan(probes, edges, rows)


# PageRank and ranks.


def _pagerank_sql() -> str:
    steps = [
        ", links AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM dense)",
        ", p0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS s FROM n)",
    ]
    for k in range(1, ROUNDS + 1):
        steps.append(f"""
, f{k} AS MATERIALIZED (SELECT dst, sum(s * share) AS f FROM links JOIN p{k - 1} ON src = node GROUP BY dst)
, p{k} AS MATERIALIZED (
  SELECT node, 0.15 / (SELECT count(*) FROM n)
    + 0.85 / (SELECT count(*) FROM n) * coalesce((SELECT sum(s) FROM p{k - 1} WHERE node NOT IN (SELECT src FROM links)), 0)
    + 0.85 * coalesce(f, 0) AS s
  FROM p{k - 1} LEFT JOIN f{k} ON node = dst)""")
    return "".join(steps) + f"""
, pr AS MATERIALIZED (SELECT node, s / (SELECT sum(s) FROM p{ROUNDS}) AS pagerank FROM p{ROUNDS})
, ranked AS MATERIALIZED (
  SELECT node, round(pagerank, 10) AS pagerank,
         row_number() OVER (ORDER BY round(pagerank, 12) DESC, node) AS rank FROM pr)"""


_PR = _pagerank_sql()


def _scores(spark, sf_dir) -> DataFrame:
    scores, _ = ranking.pagerank(
        graphs.nodes(spark, sf_dir), graphs.kept_edges(spark, sf_dir), max_iterations=ROUNDS, tolerance=0.0
    )
    return scores


def _ranked(spark, sf_dir) -> DataFrame:
    return ranking.rank_order(_scores(spark, sf_dir))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("pagerank", F.round("pagerank", 10))


@query(_with("SELECT node, round(pagerank, 10) AS pagerank FROM pr", more=_PR))
def pagerank(spark, sf_dir):
    return _shown(_scores(spark, sf_dir))


@query(_with("SELECT round(sum(pagerank), 9) AS mass FROM pr", more=_PR))
def pagerank_mass(spark, sf_dir):
    return _scores(spark, sf_dir).agg(F.round(F.sum("pagerank"), 9).alias("mass"))


@query(_with("SELECT node, rank FROM ranked", more=_PR))
def rank_order(spark, sf_dir):
    return _ranked(spark, sf_dir).select("node", "rank")


@query(_with(f"SELECT rank, node, pagerank FROM ranked WHERE rank BETWEEN {RANKS[0]} AND {RANKS[1]}", more=_PR))
def rank_list(spark, sf_dir):
    return _shown(ranking.rank_list(_ranked(spark, sf_dir), *RANKS))


@query(_with("SELECT node, pagerank, rank FROM ranked", more=_PR))
def pagerank_of(spark, sf_dir):
    """Score and rank of every node: the bulk form of the point query."""
    return _shown(_ranked(spark, sf_dir)).select("node", "pagerank", "rank")


@query(
    _with(
        f"""SELECT node, pagerank FROM ranked WHERE pagerank BETWEEN {SCORES[0]} AND {SCORES[1]}
ORDER BY pagerank, node LIMIT {SCORE_LIMIT}""",
        more=_PR,
    )
)
def score_range(spark, sf_dir):
    """The range's lowest scores up to the limit, which is the query's own."""
    return ranking.score_range(_shown(_scores(spark, sf_dir)), *SCORES, limit=SCORE_LIMIT)


@query(
    _with(
        """SELECT *, CASE WHEN leaf < max(leaf) OVER () THEN leaf + 1 ELSE -1 END AS next_leaf
FROM (SELECT CAST(floor((pos - 1) / 41) AS BIGINT) AS leaf, count(*) AS entries, min(pagerank) AS first_score
      FROM (SELECT pagerank, row_number() OVER (ORDER BY pagerank, node) AS pos FROM ranked) GROUP BY 1)""",
        more=_PR,
    )
)
def index_leaves(spark, sf_dir):
    """Leaves of the ordered index: entries and first score of each, and the leaf that follows (-1 after the last)."""
    from arcwright.operators.order import number_rows

    placed = number_rows(_shown(_scores(spark, sf_dir)), F.col("pagerank").asc(), F.col("node").asc(), name="pos")
    leaves = placed.groupBy(F.floor((F.col("pos") - 1) / LEAF_ENTRIES).alias("leaf")).agg(
        F.count("*").alias("entries"), F.min("pagerank").alias("first_score")
    )
    last = (graphs.nodes(spark, sf_dir).count() - 1) // LEAF_ENTRIES
    return leaves.withColumn("next_leaf", F.when(F.col("leaf") < last, F.col("leaf") + 1).otherwise(F.lit(-1).cast("long")))


#: Ranges of the bulk form: a hundred windows of a hundredth of the top score each.
WINDOWS = 100


@query(
    _with(
        f"""SELECT w AS range_id, count(node) AS nodes, min(pagerank) AS lowest, max(pagerank) AS highest
FROM (SELECT unnest(range({WINDOWS})) AS w) LEFT JOIN ranked ON pagerank >= w * 0.00001 AND pagerank < (w + 5) * 0.00001 GROUP BY 1""",
        more=_PR,
    )
)
def score_ranges(spark, sf_dir):
    """A table of overlapping score ranges joined to the scores in them."""
    ranges = spark.range(WINDOWS).select(
        F.col("id").alias("range_id"), (F.col("id") * 0.00001).alias("low"), ((F.col("id") + 5) * 0.00001).alias("high")
    )
    met = ranking.join_ranges(ranges, _shown(_scores(spark, sf_dir)), width=0.00005)
    found = met.groupBy("range_id").agg(F.count("*").alias("nodes"), F.min("pagerank").alias("lowest"), F.max("pagerank").alias("highest"))
    return ranges.select("range_id").join(found, "range_id", "left").select(
        "range_id", F.coalesce("nodes", F.lit(0).cast("long")).alias("nodes"), "lowest", "highest"
    )


# Components and cycles.

_WCC = """, und AS (SELECT src AS a, dst AS b FROM dense UNION SELECT dst, src FROM dense),
lab(node, root) USING KEY (node) AS (
  SELECT node, node FROM n
  UNION
  SELECT b, min(l.root) FROM lab l JOIN und ON l.node = a JOIN recurring.lab AS r ON r.node = b
  WHERE l.root < r.root GROUP BY b),
wcc AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS wcc_id FROM lab)"""


def _weak(spark, sf_dir) -> DataFrame:
    return strong.weak_components(graphs.nodes(spark, sf_dir), graphs.edges(spark, sf_dir))


@query(_with("SELECT node, wcc_id FROM wcc", recursive=True, more=_WCC))
def wcc(spark, sf_dir):
    return _weak(spark, sf_dir)


@query(_with("SELECT wcc_id, count(*) AS size FROM wcc GROUP BY 1", recursive=True, more=_WCC))
def wcc_sizes(spark, sf_dir):
    return strong.component_sizes(_weak(spark, sf_dir), "wcc_id")


@query(
    _with(
        "SELECT count(*) AS components, max(size) AS largest FROM (SELECT count(*) AS size FROM wcc GROUP BY wcc_id)",
        recursive=True,
        more=_WCC,
    )
)
def wcc_summary(spark, sf_dir):
    return strong.size_summary(strong.component_sizes(_weak(spark, sf_dir), "wcc_id"))


#: Reach as one bit string a node: who reaches it (fwd turned around, so bwd) and whom it reaches, or-ed to a fixed point.
_SCC = """, bits AS MATERIALIZED (
  SELECT node, set_bit(bitstring('0', (SELECT count(*) FROM n)::INT), node::INT, 1) AS b FROM n),
fwd(node, b) USING KEY (node) AS (
  SELECT node, b FROM bits
  UNION
  SELECT e.src, bit_or(f.b) | any_value(r.b) FROM fwd f JOIN dense e ON f.node = e.dst JOIN recurring.fwd r ON r.node = e.src
  GROUP BY e.src HAVING (bit_or(f.b) | any_value(r.b)) <> any_value(r.b)),
bwd(node, b) USING KEY (node) AS (
  SELECT node, b FROM bits
  UNION
  SELECT e.dst, bit_or(f.b) | any_value(r.b) FROM bwd f JOIN dense e ON f.node = e.src JOIN recurring.bwd r ON r.node = e.dst
  GROUP BY e.dst HAVING (bit_or(f.b) | any_value(r.b)) <> any_value(r.b)),
roots AS MATERIALIZED (
  SELECT node, CAST(bit_position('1'::BIT, f.b & w.b) - 1 AS BIGINT) AS scc_root FROM fwd f JOIN bwd w USING (node))"""


def _strong(spark, sf_dir) -> DataFrame:
    return strong.strong_roots(graphs.nodes(spark, sf_dir), graphs.kept_edges(spark, sf_dir))


@query(_with("SELECT node, scc_root FROM roots", recursive=True, more=_SCC))
def scc(spark, sf_dir):
    return _strong(spark, sf_dir)


@query(_with("SELECT scc_root, count(*) AS size FROM roots GROUP BY 1", recursive=True, more=_SCC))
def scc_sizes(spark, sf_dir):
    return strong.component_sizes(_strong(spark, sf_dir), "scc_root")


@query(
    _with(
        """SELECT CAST(coalesce(sum(size) FILTER (size > 1), 0) AS BIGINT) AS nodes_on_cycles, max(size) = 1 AS is_dag
FROM (SELECT count(*) AS size FROM roots GROUP BY scc_root)""",
        recursive=True,
        more=_SCC,
    )
)
def cycle_stats(spark, sf_dir):
    return strong.cycle_stats(_strong(spark, sf_dir), graphs.edges(spark, sf_dir))


@query(
    _with(
        """SELECT e.a, e.b, x.scc_root = y.scc_root AS same_scc, u.wcc_id = v.wcc_id AS same_wcc,
       x.scc_root AS scc_a, y.scc_root AS scc_b, u.wcc_id AS wcc_a, v.wcc_id AS wcc_b
FROM (SELECT node AS a, (node * 7 + 3) % (SELECT count(*) FROM n) AS b FROM n) e
JOIN roots x ON x.node = a JOIN roots y ON y.node = b JOIN wcc u ON u.node = a JOIN wcc v ON v.node = b""",
        recursive=True,
        more=_WCC + _SCC,
    )
)
def same_components(spark, sf_dir):
    nodes = graphs.nodes(spark, sf_dir)
    n, edges = nodes.count(), graphs.kept_edges(spark, sf_dir)
    labels = strong.strong_roots(nodes, edges).join(strong.weak_components(nodes, edges), "node")
    labels = materialize(labels, "labels")
    pairs = nodes.select(F.col("node").alias("a"), ((F.col("node") * 7 + 3) % n).alias("b"))
    joined = pairs.join(labels.toDF("a", "scc_a", "wcc_a"), "a").join(labels.toDF("b", "scc_b", "wcc_b"), "b")
    return joined.select(
        "a", "b", (F.col("scc_a") == F.col("scc_b")).alias("same_scc"), (F.col("wcc_a") == F.col("wcc_b")).alias("same_wcc"),
        "scc_a", "scc_b", "wcc_a", "wcc_b",
    )


@query()
def back_edges(spark, sf_dir):
    """Back edges of the depth-first forest; its order is sequential, which SQL cannot express."""
    edges = graphs.kept_edges(spark, sf_dir).withColumn("ord", F.col("src") * (1 << 31) + F.col("dst"))
    n = graphs.nodes(spark, sf_dir).count()
    return strong.depth_first_forest(n, edges).agg(
        F.max("back_edges").alias("back_edges"), F.countDistinct("scc_id").alias("components")
    )


# Distances.


def _distance_sql(weight: str, table: str) -> str:
    return f""", dist(node, distance) USING KEY (node) AS (
  SELECT CAST({SOURCE} AS BIGINT), CAST(0 AS BIGINT)
  UNION
  SELECT e.dst, min(d.distance + {weight}) FROM dist d JOIN {table} e ON d.node = e.src
         LEFT JOIN recurring.dist r ON r.node = e.dst
  WHERE r.node IS NULL OR d.distance + {weight} < r.distance GROUP BY e.dst)"""


@query(_with("SELECT node, distance FROM dist", recursive=True, more=_distance_sql("1", "dense")))
def bfs_distances(spark, sf_dir):
    return paths.distances(graphs.kept_edges(spark, sf_dir), SOURCE)


@query(_with("SELECT node, distance FROM dist", recursive=True, more=_distance_sql("e.weight", "dense")))
def sssp_weighted(spark, sf_dir):
    return paths.distances(graphs.kept_edges(spark, sf_dir), SOURCE, weighted=True)


@query(
    _with(
        "SELECT node, coalesce(distance, -1) AS distance FROM n LEFT JOIN dist USING (node)",
        recursive=True,
        more=_distance_sql("1", "dense"),
    )
)
def shortest_distance(spark, sf_dir):
    """Hops from the source to every node, -1 without a path: the bulk form of the pair query."""
    found = paths.distances(graphs.kept_edges(spark, sf_dir), SOURCE)
    return graphs.nodes(spark, sf_dir).join(found, "node", "left").select(
        "node", F.coalesce("distance", F.lit(-1).cast("long")).alias("distance")
    )


@query(
    _with(
        f"SELECT node, distance FROM dist WHERE node <> {SOURCE} ORDER BY distance, node LIMIT {NEAREST}",
        recursive=True,
        more=_distance_sql("e.weight", "dense"),
    )
)
def knn(spark, sf_dir):
    return paths.nearest(graphs.kept_edges(spark, sf_dir), SOURCE, NEAREST, weighted=True)


# The same queries with every round distributed: no graph is small enough for the one-task finishers.


@query(_SQL["pagerank"])
def pagerank_rounds(spark, sf_dir):
    nodes, edges = graphs.nodes(spark, sf_dir), graphs.kept_edges(spark, sf_dir)
    scores, _ = ranking.pagerank(nodes, edges, max_iterations=ROUNDS, tolerance=0.0, finish_edges=0)
    return _shown(scores)


@query(_SQL["scc"])
def scc_rounds(spark, sf_dir):
    return strong.strong_roots(graphs.nodes(spark, sf_dir), graphs.kept_edges(spark, sf_dir), finish_edges=0)


@query(_SQL["wcc"])
def wcc_rounds(spark, sf_dir):
    return strong.weak_components(graphs.nodes(spark, sf_dir), graphs.edges(spark, sf_dir), finish_rows=0)


@query(_SQL["bfs_distances"])
def bfs_rounds(spark, sf_dir):
    return paths.distances(graphs.kept_edges(spark, sf_dir), SOURCE, finish_edges=0)


@query(_SQL["sssp_weighted"])
def sssp_rounds(spark, sf_dir):
    return paths.distances(graphs.kept_edges(spark, sf_dir), SOURCE, weighted=True, finish_edges=0)


@query(_SQL["knn"])
def knn_rounds(spark, sf_dir):
    return paths.nearest(graphs.kept_edges(spark, sf_dir), SOURCE, NEAREST, weighted=True, finish_edges=0)


# Functions and metadata.


@query(
    f"""SELECT n AS entries, CAST(greatest(32, pow(2, length(to_base(CAST(floor(n / 0.75) AS BIGINT), 2)))) AS BIGINT) AS capacity
FROM (SELECT p_partkey + 1 AS n FROM part)"""
)
def hash_geometry(spark, sf_dir):
    """Capacity of a hash table over 1, 2, ... entries."""
    n = graphs.nodes(spark, sf_dir).select((F.col("node") + 1).alias("entries"))
    return n.select("entries", hash_capacity_column(F.col("entries")).alias("capacity"))


@query(
    f"""WITH a AS (SELECT count(*) AS n, greatest(1, CAST(ceil(count(*) / {LEAF_ENTRIES}) AS BIGINT)) AS l0 FROM part),
b AS (SELECT *, CASE WHEN l0 > 1 THEN CAST(ceil(l0 / {FANOUT}) AS BIGINT) ELSE 0 END AS l1 FROM a),
c AS (SELECT *, CASE WHEN l1 > 1 THEN CAST(ceil(l1 / {FANOUT}) AS BIGINT) ELSE 0 END AS l2 FROM b),
d AS (SELECT *, CASE WHEN l2 > 1 THEN CAST(ceil(l2 / {FANOUT}) AS BIGINT) ELSE 0 END AS l3 FROM c)
SELECT n AS entries, CAST(1 + (l1 > 0)::INT + (l2 > 0)::INT + (l3 > 0)::INT AS BIGINT) AS height,
       CAST(1 + l0 + l1 + l2 + l3 AS BIGINT) AS blocks FROM d"""
)
def index_geometry_of_parts(spark, sf_dir):
    n = graphs.nodes(spark, sf_dir).count()
    return spark.createDataFrame([(n, *index_geometry(n))], "entries long, height long, blocks long")


def _edge_hash_sql() -> str:
    """The hash written out, each word mixed in a step of its own."""
    low = "({} & 4294967295)".format

    def times(x, by):
        return low(f"({x} * {by & 0xFFFF} + ((({x} * {by >> 16}) & 65535) << 16))")

    def rotated(x, r):
        return low(f"(({x} << {r}) | ({x} >> {32 - r}))")

    steps, names = [], iter(f"s{k}" for k in range(99))
    last = "dense"

    def step(expression: str) -> str:
        nonlocal last
        name = next(names)
        steps.append(f", {name} AS MATERIALIZED (SELECT src, dst, {expression} AS h FROM {last})")
        last = name
        return "h"

    def word(column: str, seed: str) -> None:
        carry = f", {seed} AS seed"
        nonlocal last
        for k, expression in enumerate((times(low(column), C1), rotated("k", 15), times("k", C2))):
            name = next(names)
            steps.append(f", {name} AS MATERIALIZED (SELECT src, dst, {expression} AS k{carry if k == 0 else ', seed'} FROM {last})")
            last = name
        step("xor(seed, k)")
        step(rotated("h", 13))
        step(low(f"(h * 5 + {ROUND_ADD})"))

    word("src", str(EDGE_SEED))
    word("dst", "h")
    step("xor(h, 8)")
    for shift, by in ((16, MIX1), (13, MIX2)):
        step(f"xor(h, h >> {shift})")
        step(times("h", by))
    step("xor(h, h >> 16)")
    return _with(f"SELECT src, dst, h AS edge_hash FROM {last}", more="".join(steps))


@query(_edge_hash_sql())
def edge_hash(spark, sf_dir):
    """MurmurHash3 of every edge key; tests hold it against published vectors too."""
    return with_edge_hash(graphs.edges(spark, sf_dir))


@query()
def probe_lengths(spark, sf_dir):
    """How many edges take how many probes; the table's fill is sequential."""
    edges = graphs.kept_edges(spark, sf_dir).withColumn("ord", F.col("src") * (1 << 31) + F.col("dst"))
    return probe_table(edges, edges.count()).groupBy("probes").agg(F.count("*").alias("edges"))


@query()
def pool_sweep(spark, sf_dir):
    """Blocks that pools of several sizes read for a distance query; expansion order is sequential."""
    edges = graphs.kept_edges(spark, sf_dir).withColumn("ord", F.col("src") * (1 << 31) + F.col("dst"))
    n = graphs.nodes(spark, sf_dir).count()
    return sweep(n, edges, SOURCE, n - 1)


_NAMES = ["graph.txt", "/etc/passwd", "my graph!.CSV", "../..//name", "a.b.edges", "--x__.tsv", "é", "///", "x" * 80, " p2p.txt "]


@query(
    "SELECT raw, nullif(left(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(raw, '^.*/', '')), "
    "'(?i)\\.(txt|csv|edges|tsv)$', ''), '[^A-Za-z0-9_.-]', '', 'g'), '^[._-]+|[._-]+$', '', 'g'), 64), '') AS name FROM (VALUES "
    + ", ".join(f"('{x}')" for x in _NAMES)
    + ") t(raw)"
)
def sanitize_name(spark, sf_dir):
    raw = spark.createDataFrame([(x,) for x in _NAMES], "raw string")
    return raw.select("raw", sanitize_name_column(F.col("raw")).alias("name"))


@query(
    _with(
        """SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM dense) AS edges,
       (SELECT count(DISTINCT scc_root) FROM roots) AS num_scc,
       (SELECT max(c) FROM (SELECT count(*) AS c FROM roots GROUP BY scc_root)) AS largest_scc,
       (SELECT count(DISTINCT wcc_id) FROM wcc) AS num_wcc,
       (SELECT max(c) FROM (SELECT count(*) AS c FROM wcc GROUP BY wcc_id)) AS largest_wcc,
       CAST((SELECT coalesce(sum(c) FILTER (c > 1), 0) FROM (SELECT count(*) AS c FROM roots GROUP BY scc_root)) AS BIGINT)
         AS nodes_on_cycles""",
        recursive=True,
        more=_WCC + _SCC,
    )
)
def graph_meta(spark, sf_dir):
    """The order-independent figures of a graph, as one row."""
    nodes, edges = graphs.nodes(spark, sf_dir), graphs.kept_edges(spark, sf_dir)
    scc_sizes_ = strong.component_sizes(strong.strong_roots(nodes, edges), "scc_root")
    strong_part = scc_sizes_.agg(
        F.count("*").alias("num_scc"),
        F.max("size").alias("largest_scc"),
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).alias("nodes_on_cycles"),
    )
    weak_part = strong.size_summary(strong.component_sizes(strong.weak_components(nodes, edges), "wcc_id"))
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    return counts.crossJoin(strong_part).crossJoin(weak_part.toDF("num_wcc", "largest_wcc")).select(
        "nodes", "edges", "num_scc", "largest_scc", "num_wcc", "largest_wcc", "nodes_on_cycles"
    )
