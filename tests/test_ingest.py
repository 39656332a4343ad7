import pytest

from arcwright.functions.names import sanitize_name
from arcwright.model import EdgeListError, GraphError
from arcwright.sources.edgelist import edges_from_table, parse_edge_list


def parse(spark, tmp_path, text, **options):
    path = tmp_path / "g.txt"
    path.write_text(text)
    found = parse_edge_list(spark, str(path), **options)
    rows = [(r["src"], r["dst"], r["weight"]) for r in found.edges.orderBy("ord").collect()]
    return found, rows


def test_header_is_recognised(spark, tmp_path):
    found, rows = parse(spark, tmp_path, "5 2\n0 1\n1 2\n")
    assert found.had_header and found.num_nodes == 5 and rows == [(0, 1, 1), (1, 2, 1)]


def test_headerless_when_counts_disagree(spark, tmp_path):
    found, rows = parse(spark, tmp_path, "5 3\n0 1\n1 2\n")
    assert not found.had_header and found.num_nodes == 6 and len(rows) == 3


def test_header_alone_is_an_edgeless_graph(spark, tmp_path):
    found, rows = parse(spark, tmp_path, "5 0\n")
    assert found.num_nodes == 5 and rows == []


def test_comments_blanks_extra_columns_and_number_forms(spark, tmp_path):
    _, rows = parse(spark, tmp_path, "# c\n\n % d\n  0\t+1  x\n1_0 2\n")
    assert rows == [(0, 1, 1), (10, 2, 1)]


def test_loops_and_duplicates(spark, tmp_path):
    found, rows = parse(spark, tmp_path, "9 9 1\n0 1 7\n0 1 3\n1 0 2\n", weighted=True)
    assert rows == [(0, 1, 7), (1, 0, 2)]
    assert (found.self_loops_removed, found.duplicates_removed, found.num_nodes) == (1, 1, 2)


def test_loops_and_duplicates_can_stay(spark, tmp_path):
    found, rows = parse(spark, tmp_path, "7 7\n0 1\n0 1\n", drop_self_loops=False, drop_duplicates=False)
    assert len(rows) == 3 and found.num_nodes == 8


@pytest.mark.parametrize(
    "text, weighted, line",
    [("0 1\n2\n", False, 2), ("0 x\n", False, 1), ("0 -1\n", False, 1), ("0 1\n", True, 1), ("0 1 -3\n", True, 1), ("3 2\n0 1\n0 b\n", False, 3)],
)
def test_bad_rows_name_their_line(spark, tmp_path, text, weighted, line):
    with pytest.raises(EdgeListError, match=f"line {line}:"):
        parse(spark, tmp_path, text, weighted=weighted)


@pytest.mark.parametrize("text", ["", "# only\n\n", "3 3\n"])
def test_nothing_usable(spark, tmp_path, text):
    with pytest.raises(EdgeListError):
        parse(spark, tmp_path, text)


def test_order_across_splits(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("".join(f"{i} {i + 1} {i}\n{i} {i + 1} 999999\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = parse_edge_list(spark, str(path), weighted=True)
        assert found.num_edges == 3000 and found.edges.filter("weight <> src").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_edges_from_table(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "a int, b int")
    assert [tuple(r) for r in edges_from_table(df, "a", "b").collect()] == [(1, 2, 1)]


@pytest.mark.parametrize("raw, name", [("graph.txt", "graph"), ("/etc/passwd", "passwd"), ("my graph!.CSV", "mygraph"), ("../..//name", "name")])
def test_names(raw, name):
    assert sanitize_name(raw) == name


@pytest.mark.parametrize("raw", ["///", "", "...", "é"])
def test_empty_names(raw):
    with pytest.raises(GraphError):
        sanitize_name(raw)


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    from arcwright.sources.edgelist import parse_edge_list, read_lines

    for name, rows in (("b.txt", ["0 1 9", "4 5 5"]), ("a.txt", ["# first", "0 1 7", "2 3 4"])):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    lines = read_lines(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["value"] for r in lines] == ["# first", "0 1 7", "2 3 4", "0 1 9", "4 5 5"]
    assert len({r["ord"] for r in lines}) == 5
    found = {(r["src"], r["dst"]): r["weight"] for r in parse_edge_list(spark, str(tmp_path), weighted=True).edges.collect()}
    assert found == {(0, 1): 7, (2, 3): 4, (4, 5): 5}
