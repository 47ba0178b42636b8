import json
import subprocess

from pyspark.sql import functions as F

from quarry.operators.events import usage
from quarry.sources import files, records
from quarry.streaming import journal


def test_folder(spark, tmp_path):
    (tmp_path / "src/node_modules/m").mkdir(parents=True)
    (tmp_path / ".git2").mkdir()
    for name, body in {"src/a.py": b"x\r\ny", "src/b.bin": b"1", "src/bad.py": b"\xff\xfe", "src/node_modules/m/c.js": b"1", ".git2/d.py": b"1", "e.lock": b"1", "big.txt": b"1" * 500, "keep.lock.md": b"# k"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path: r.text for r in files.read_folder(spark, str(tmp_path), max_bytes=400).collect()}
    assert got == {"src/a.py": "x\ny", "keep.lock.md": "# k"}


def test_project(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "web").mkdir()
    (tmp_path / "app/pubspec.yaml").write_text("name: shop\n")
    (tmp_path / "web/tsconfig.json").write_text('{ // c\n "compilerOptions": {"paths": {"@/*": ["./src/*"], "x": ["y"],}, /* d */ "baseUrl": "."},}')
    (tmp_path / "web/a.ts").write_text("let a = 1")
    (tmp_path / ".quarry.toml").write_text("[corpus]\nmax_bytes = 10\n[graph]\ndart_root = 'own'\n")
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "feat: first commit of all")
    made = files.load_config(spark, str(tmp_path))
    assert made["corpus"]["max_bytes"] == 10 and made["corpus"]["exclude"]
    assert made["graph"] == {"dart_package": "shop", "dart_root": "own", "aliases": {"@/": "web/src/"}}
    assert files.decision_globs(made)[-1] == "docs/notes/*"
    assert {r.path for r in files.read_repository(spark, str(tmp_path), max_bytes=12).collect()} == {"app/pubspec.yaml", "web/a.ts"}
    log = records.read_log(spark, str(tmp_path)).collect()
    assert len(log) == 1 and log[0].subject == "feat: first commit of all" and "web/a.ts" in log[0].files and log[0].ts > 0


def test_log_file(spark, tmp_path):
    (tmp_path / "log").write_text("\0abc\t100\tsubject\twith tab\n\na.py\nb.py\n\0def\t50\tother\n")
    got = {r.sha: (r.ts, r.subject, r.files) for r in records.read_log_file(spark, str(tmp_path / "log")).collect()}
    assert got == {"abc": (100, "subject\twith tab", ["a.py", "b.py"]), "def": (50, "other", [])}


def test_journal_and_cases(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"ts": "2024-01-01T00:00:00", "event": "start", "pid": 1}\nbroken\n{"event": "call", "args": {"q": "é"}}\n')
    rows = records.read_journal(spark, str(tmp_path / "j.jsonl")).orderBy(F.col("pid").desc_nulls_last()).collect()
    assert [r.event for r in rows] == ["start", "call"] and rows[1].args == {"q": "é"}
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "query": "q", "gold": [{"path": "a"}]}]))
    assert records.read_cases(spark, str(tmp_path / "c.json")).first().gold[0].path == "a"
    (tmp_path / "x.json").write_text(json.dumps({"1": {"order": ["b", "a"], "files": {"4000": ["b"]}}}))
    assert [(r.qid, r.path, r.pos) for r in records.read_external(spark, str(tmp_path / "x.json")).orderBy("pos").collect()] == [("1", "b", 0), ("1", "a", 1)]


def test_tail(spark):
    lines = spark.createDataFrame([(i, "x" * i) for i in range(10)], "n int, value string")
    assert sorted(r.n for r in records.last_lines(lines, 20).collect()) == [8, 9]


def test_transcript(spark, tmp_path):
    use = lambda i, name, **k: {"timestamp": "t", "message": {"content": [{"type": "tool_use", "id": i, "name": name, "input": k}]}}
    lines = [use("c1", "x__search_code", query="q"), {"message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "### a.py:3  f\nbody\n\n### b.py:1\n### a.py:9"}]}}, use("e1", "Edit", file_path="/r/a.py"), use("e2", "Edit", file_path="/other/b.py")]
    (tmp_path / "t.jsonl").write_text("\n".join(["not json", *map(json.dumps, lines)]))
    calls, edits = records.transcript_usage(records.read_transcript(spark, str(tmp_path / "t.jsonl")), "/r", "__search_")
    got = usage(calls, edits).collect()
    assert [(r.call, r.shown, r.used) for r in got] == [("c1", ["a.py", "b.py"], ["a.py"])]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:05:00", 2), (1, "2024-01-01 00:10:50", 3), (2, "2024-01-01 00:00:10", 4), (2, "2024-01-03 00:00:10", 5)]
    spark.createDataFrame(rows, "root long, ts string, event_id long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.json(str(tmp_path / "ev"))
    read = lambda: journal.read_events(spark, str(tmp_path / "ev"), "root long, ts timestamp, event_id long")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.event_id for r in run(journal.throttled(read(), "root"), "hints")) == [1, 3, 4, 5]
    assert sum(r.n for r in run(journal.event_windows(read(), "1 hour"), "closed")) == 4  # the last hour is still open
    assert {(r.root, r.n) for r in run(journal.idle_sessions(read(), "root"), "sessions")} == {(1, 3), (2, 1)}
    spark.createDataFrame([("a", "", "x"), ("b", "", "y"), ("c", "", "x")], "path string, symbol string, text string").coalesce(1).write.json(str(tmp_path / "ch"))
    chunks = journal.read_events(spark, str(tmp_path / "ch"), "path string, symbol string, text string")
    journal.refresh(chunks, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(120)
    assert records.read_store(spark, str(tmp_path / "store")).count() == 3
