import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.plans import methods as M


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, f"d{i % 3}/f{i}.py", f"symbol{i}", f"word{i} common text about topic{i % 5} symbol{(i + 1) % 12}", 20 + i, i % 4 != 0, "decision" if i % 4 == 0 else "code") for i in range(12)]
    chunks = spark.createDataFrame(rows, "idx long, path string, symbol string, text string, tokens int, is_code boolean, kind string")
    queries = spark.createDataFrame([(1, "topic1 word6", 100), (2, "symbol3 topic3", 100)], "qid int, query string, ts int")
    dense = queries.crossJoin(chunks).select("qid", "idx", F.round(F.sin(F.col("qid") * F.col("idx") * 1.0), 6).alias("score"))
    files = spark.createDataFrame([("d0/f0.py", "d1/f1.py")], "a string, b string")
    commits = spark.createDataFrame([(1, 50, "touch topic1 now", ["d1/f1.py", "gone.py"]), (2, 150, "topic1 later", ["d2/f2.py"])], "cid int, ts int, subject string, files array<string>")
    gold = spark.createDataFrame([(1, "d0/f6.py"), (2, "d0/f3.py")], "qid int, path string")
    external = {"tool": spark.createDataFrame([(1, "d0/f6.py", 0), (2, "d1/f1.py", 0)], "qid int, path string, pos int")}
    return M.Methods(chunks, queries, dense, graph.ref_edges(chunks), files, commits, dense, external, gold)


ALL = ["bm25", "bm25n", "dense", "hybrid", "expand", "ppr?block=1&beta=0.3&qid=1&siblings=1&imports=1", "commits", "only:code:hybrid", "mix:2:1:hybrid", "rerank:bm25"]


def test_rankings(made):
    for name in ALL:
        rows = made.ranking(name).collect()
        for q in (1, 2):
            got = sorted((r.pos, r.idx) for r in rows if r.qid == q)
            assert [p for p, _ in got] == list(range(len(got))) and len({i for _, i in got}) == len(got)
            assert len(got) == (9 if name.startswith("only") else 12), name
    assert made.ranking("commits").where("qid = 1").orderBy("pos").first().idx == 1  # the later commit is invisible


def test_scores(made):
    names = ["bm25", "channel:0.34:hybrid", "gate:3:0.3:hybrid", "ptr:1:20:bm25", "ext:tool", "oracle:bm25:ext:tool"]
    got = made.per_case(names[:-1] + ["oracle:bm25:ext"], (60, 300), (1, 5)).collect()
    assert all(0 <= r.score <= 1 for r in got)
    cell = {(r.cell, r.method, r.case_id): r.score for r in got}
    assert cell["files@1", "ext:tool", 1] == 1 and cell["files@1", "ext:tool", 2] == 0 and cell["files@5", "bm25", 1] == 1
    assert {m for _, m, _ in cell} == {*names[:-1], "oracle:bm25:ext"}


def test_options_and_samples(spark, made):
    assert M.parse("ppr?beta=0.5&block=1") == ("ppr", [], {"beta": "0.5", "block": "1"})
    assert M.parse("gate:3:0.3:only:dec:bm25") == ("gate", ["3", "0.3", "only:dec:bm25"], {})
    with pytest.raises(ValueError):
        made.ranking("unknown")
    assert M.prefixes("multilingual-e5-small")[:2] == ("query: ", "passage: ")
    long = made.chunks.withColumn("text", F.repeat("text", 20))
    assert M.sample_decisions(long, 2, batch=1).select("batch").distinct().count() <= 2
    a = spark.createDataFrame([(1, "see d1/f1.py, then d0/f0.py and d1/f1.py or none.py")], "qid int, answer string")
    assert [r.path for r in M.paths_in(a, made.chunks).orderBy("pos").collect()] == ["d1/f1.py", "d0/f0.py"]


def test_command_line(spark, tmp_path, capsys):
    from quarry.__main__ import main

    root = tmp_path / "r"
    (root / "docs/adr").mkdir(parents=True)
    (root / "a.py").write_text("def alphaBeta():\n    pass\n")
    (root / "b.py").write_text("import a\nalphaBeta()\n")
    (root / "docs/adr/1.md").write_text("# One\nabout `gone/x.py` and `a.py`\n")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "feat(core): add the alpha beta function")
    main(["stats", str(root)])
    assert "3 files" in capsys.readouterr().out
    main(["explore", str(root), "--out", str(tmp_path)])
    assert "gone/x.py" in (tmp_path / "REPORT.md").read_text() and "a.py" in (tmp_path / "graph.html").read_text()
    main(["cases-from-git", str(root), "--out", str(tmp_path)])
    assert "core: add the alpha beta function" in (tmp_path / "cases.json").read_text()
