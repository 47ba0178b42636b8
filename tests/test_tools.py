"""Judged heads, symbol recall, gates, roots, stems, notes in the index and streamed hints, on tables made by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import query_tokens
from quarry.operators import evaluate as E
from quarry.operators import events as V
from quarry.operators import lexical
from quarry.operators import ranking as R
from quarry.plans import tools
from quarry.streaming import journal as J


def test_judge_head(spark):
    ranking = spark.createDataFrame([(1, i, i) for i in range(6)], "qid long, idx long, pos int")
    chunks = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, "d")], "idx long, path string")
    scores = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (1, 5, 1.0)], "qid long, idx long, score double")
    got = R.judge_head(ranking, chunks, scores, 3).orderBy("pos").collect()
    assert [r.idx for r in got] == [2, 3, 0, 1, 4, 5]  # d isn't among the first three files; a has no score


def test_gate_counts(spark):
    fused = spark.createDataFrame([(q, i, i) for q in (1, 2, 3) for i in range(4)] + [(3, 9, 4)], "qid long, idx long, pos int")
    got = R.gate_counts(fused, spark.createDataFrame([(9,)], "idx long"), (1, 5))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 0), (5, 3, 1)]


def test_recall_symbols(spark):
    gold = spark.createDataFrame([(1, "a", "f"), (1, "a", "g"), (1, "b", ""), (1, "c", None), (2, "a", "f")], "qid long, path string, symbol string")
    picked = spark.createDataFrame([(1, "a", "f~2"), (1, "b", "x"), (1, "c", None), (1, "a", None)], "qid long, path string, symbol string")
    assert {r.qid: r.recall for r in E.recall_symbols(picked, gold).collect()} == {1: 0.75, 2: 0.0}
    assert E.recall_symbols(picked, gold.limit(0)).count() == 0


def test_significance(spark):
    rows = [("files", m, i, s) for i in range(40) for m, s in (("a", 0.0), ("b", 1.0), ("c", float(i % 2) * 0.0))]
    cases = spark.createDataFrame(rows, "cell string, method string, case_id int, score double")
    won, same = (E.significance(cases, "a", m, 50).first() for m in "bc")
    assert (won.n, won.diff, won.lo, won.hi, won.significant) == (40, 1.0, 1.0, 1.0, True)
    assert not same.significant


def test_roots(spark):
    events = spark.createDataFrame([(1, "C:/Work"), (2, "c:/other"), (3, None)], "event_id long, root string")
    roots = spark.createDataFrame([("c:/work",), ("C:/WORK",), (None,)], "root string")
    assert [r.event_id for r in V.of_roots(events, roots).collect()] == [1]


def test_stems(spark):
    q = spark.createDataFrame([("Почему ошибками", "Errors")], "a string, b string").select(query_tokens("a", True, True), query_tokens("b", False, True)).first()
    assert q[1] == ["errors"] and q[0][-1] == "ошибк"
    chunks = spark.createDataFrame([(0, "a.md", "", "ошибка сети"), (1, "b.md", "", "сервер")], "idx long, path string, symbol string, text string")
    asked = spark.createDataFrame([(1, "ошибками")], "qid long, query string")
    assert [r.idx for r in lexical.bm25(chunks, asked, stem=True).collect()] == [0]
    assert lexical.bm25(chunks, asked).count() == 0
    assert lexical.bm25(chunks.limit(0), asked).count() == 0


def test_note_is_searchable(spark, tmp_path):
    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    name = tools.add_note(str(tmp_path), "Arrow_first: batches!", "Because.", now=now)
    assert name.startswith("docs/notes/2024-01-02-arrow-first-batches-")
    text = (tmp_path / name).read_text(encoding="utf-8")
    assert text.startswith("---\ntype: decision\ncreated: '2024-01-02T03:04:05'\ntags: []\nsummary: ")
    with pytest.raises(ValueError):
        tools.add_note(str(tmp_path), "x", kind="letter")
    chunks = spark.createDataFrame([(7, "a.py", "f", "def f", True, "code", "own")], "idx long, path string, symbol string, text string, is_code boolean, kind string, extra string")
    whole = tools.with_notes(chunks, spark.createDataFrame([(name, text)], "path string, text string"))
    assert whole.columns == chunks.columns
    new = whole.where("idx > 7").collect()
    assert new and {(r.path, r.kind, r.is_code, r.extra) for r in new} == {(name, "decision", False, None)}
    found = lexical.bm25(whole, spark.createDataFrame([(1, "because")], "qid long, query string"))
    assert {r.idx for r in found.collect()} <= {r.idx for r in new} and found.count()


def test_streamed_hints(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    rows = [(1, at(0), 1, False), (1, at(5), 2, False), (1, at(11), 3, False), (1, at(20), 4, True), (1, at(30), 5, False), (1, at(35), 6, False), (2, at(0), 7, True), (2, at(0), 8, False)]
    spark.createDataFrame(rows, "root long, ts timestamp, event_id long, is_call boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("root long, ts timestamp, event_id long, is_call boolean").parquet(str(tmp_path / "in"))
    for ttl in (None, "60000"):
        out, name = J.hints(stream, "root", 15, 10, ttl), f"hints_{ttl}"
        # with a time-out of its own a query always has another batch, so it would never be done with all that is there
        once = {"availableNow": True} if ttl is None else {"once": True}
        assert out.writeStream.format("memory").queryName(name).trigger(**once).start().awaitTermination(60)
        # 2 is within the cooldown, 5 within the quiet time after the call, 8 at the call's own time
        assert sorted(r.event_id for r in spark.table(name).select(F.col("event_id")).collect()) == [1, 3, 6]
