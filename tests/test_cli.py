import re

import pytest

from arcwright import __main__ as cli


@pytest.fixture
def run(spark, monkeypatch, tmp_path, capsys):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    (tmp_path / "path.txt").write_text("0 1 2\n1 2 3\n2 3 1\n")

    def call(*args):
        code = cli.main(["--data", str(tmp_path / "data"), *[str(a) for a in args]])
        said = capsys.readouterr()
        return code, said.out, said.err

    call.root = tmp_path
    return call


def test_commands(run):
    assert run("list")[1] == "No graphs built yet\n"
    code, out, _ = run("build", run.root / "path.txt", "--weighted", "--quiet")
    assert code == 0 and "4 nodes, 3 edges" in out
    assert run("list")[1] == "path\n"
    assert re.search(r"nodes +4\n", run("info", "path")[1])
    assert run("query", "path", "distance", 0, 3)[1].startswith("6\n")
    assert "exists=True" in run("query", "path", "edge", 0, 1)[1]
    assert run("query", "path", "scorerange", 0, 1)[1].count("pagerank=") == 4
    assert run("query", "path", "knn", 0, 0)[0] == 1
    assert run("query", "path", "knn", 0)[0] == 1
    assert "hit" in run("bench", "path", 0, 3)[1]
    out = run("bench-index", "path", "--samples", 2, "--seed", 3)[1]
    assert "adjacency scan" in out and "load factor" in out and "score range of 50 nodes" in out
    assert run("delete", "path")[0] == 0 and run("info", "path")[0] == 1
    assert run("build", run.root / "none.txt")[0] == 1
