"""Golden facts of single operators on small inline tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, dense, evaluate, events, explore, graph, history, lexical, pairs
from quarry.operators import ranking as R
from quarry.plans import tools

DART = "// header comment\nimport 'x';\n\nconst int kVersion = 3;\n\nclass RepCounter {\n  void run() {}\n}\n\nenum Phase { a, b }\n\nvoid main() {\n  if (x) {}\n}\n"
CHUNK = "idx long, path string, symbol string, text string"


def chunks_of(spark, rows, schema=CHUNK):
    return spark.createDataFrame(rows, schema)


def test_code_chunks(spark):
    c = {r.symbol: r for r in chunking.chunk_files(spark.createDataFrame([("lib/a.dart", DART)], "path string, text string")).collect()}
    assert set(c) == {"", "kVersion", "RepCounter", "Phase", "main"}
    assert c["RepCounter"].id == "lib/a.dart::RepCounter" and c["RepCounter"].line == 6 and c[""].id == "lib/a.dart"
    assert "".join(r.text for r in sorted(c.values(), key=lambda r: r.line)) == DART


def test_markdown_and_other_chunks(spark):
    md = "preface\n\n## Setup\nx\n## Usage\ny\n## Setup\nz\n"
    files = spark.createDataFrame([("d.md", md), ("t.txt", "a\n" * 4000), ("e.txt", ""), ("n.py", "x = 1\n\n\ndef f():\n  pass\n\ndef f():\n  pass\n"), ("long.py", "def g():\n" + "  y\n" * 3000)], "path string, text string")
    ids = [r.id for r in chunking.chunk_files(files).orderBy("path", "line", "id").collect()]
    assert {"d.md", "d.md#setup", "d.md#usage", "d.md#setup-1", "long.py::g@0", "long.py::g@2", "n.py::f", "n.py::f~1", "t.txt", "t.txt@1", "t.txt@2"} <= set(ids)
    assert not any(i.startswith("e.txt") for i in ids)
    with_idx = chunking.with_position(chunking.chunk_files(files), ["path", "line", "id"]).orderBy("idx").collect()
    assert [r.idx for r in with_idx] == list(range(len(ids))) and [r.id for r in with_idx] == ids


def test_interleave_and_alternate(spark):
    ranking = spark.createDataFrame([(1, i, i) for i in range(7)], "qid int, idx long, pos int")
    c = spark.createDataFrame([(i, i >= 3) for i in range(7)], "idx long, is_code boolean")
    assert [r.idx for r in R.interleave(ranking, c, 3, 1).orderBy("pos").collect()] == [3, 4, 5, 0, 6, 1, 2]
    rank = lambda xs: spark.createDataFrame([(1, x, i) for i, x in enumerate(xs)], "qid int, idx string, pos int")
    assert [r.idx for r in R.alternate(rank("abcd"), rank("xby")).orderBy("pos").collect()] == list("axbcyd")


@pytest.mark.parametrize("budget", [40, 300, 520, 5000])
def test_budget(spark, budget):
    sizes = [100, 400, 60, 90, 500, 10, 30, 700, 45]
    want, left = [], budget
    for i, t in enumerate(sizes):
        if t <= left:
            want.append(i)
            left -= t
            if left < 50:
                break
    ranking = spark.createDataFrame([(1, i, i) for i in range(len(sizes))], "qid int, idx long, pos int")
    c = spark.createDataFrame(list(enumerate(sizes)), "idx long, tokens int")
    got = [r.idx for r in R.select_budget(ranking, c, budget).orderBy("pos").collect()]
    assert got == want and sum(sizes[i] for i in got) <= budget


def test_channel(spark):
    c = spark.createDataFrame([(i, 100) for i in range(10)], "idx long, tokens int")
    main = spark.createDataFrame([(1, i, i) for i in range(10)], "qid int, idx long, pos int")
    side = spark.createDataFrame([(1, 9, 0)], "qid int, idx long, pos int")
    got = [r.idx for r in R.select_channel(side, main, c, 300, 0.34).orderBy("part", "pos").collect()]
    assert got == [9, 0, 1]


def test_reference_weights(spark):
    c = chunks_of(spark, [(0, "a.py", "parseJsonValue", "def parseJsonValue"), (1, "b.py", "", "parseJsonValue parseJsonValue"), (2, "c.py", "_hidden", "x"), (3, "d.py", "", "_hidden")])
    w = {(r.i, r.j): r.w for r in graph.ref_edges(c, "long").collect()}
    assert w[0, 1] == pytest.approx(10 * 2**0.5) and w[2, 3] == pytest.approx(0.1)
    assert {(r.i, r.j): r.w for r in graph.ref_edges(c).collect()}[0, 1] == pytest.approx(2**0.5)
    many = chunks_of(spark, [(i, f"{i}.py", "thing", "") for i in range(4)] + [(9, "u.py", "", "thing")])
    assert graph.ref_edges(many).count() == 0


@pytest.mark.parametrize("rows", [1 << 20, 40])
def test_uncapped_references_by_blocks(spark, monkeypatch, rows):
    """No pair is moved (only packed blocks are dealt out), and one block or many give what brute force does."""
    monkeypatch.setattr(pairs, "_ROWS", rows)
    rng = random.Random(5)
    names = ["thing", "parseJson", "_private", "long_snake_name", "common"]
    held = [(i, f"{i % 17 if i % 3 else i}.py", rng.choice([*names, "", "abc"]) + "~1" * (i % 4 == 0), " ".join(rng.choice([*names, "w", "abcd"]) for _ in range(rng.randrange(9)))) for i in range(70)]
    held += [(70, "n.py", "thing", None), (71, "n.py", None, "thing thing"), (None, "o.py", "thing", "thing"), (72, None, "thing", "thing"), (5, "5.py", "common", "thing thing thing")]
    got = graph.ref_edges(spark.createDataFrame(held, "idx long, path string, symbol string, text string"), "long", digits=4)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    defs = [(s.split("~")[0], i, p) for i, p, s, _ in held if s and len(s.split("~")[0]) >= 4 and i is not None and p]
    want = {}
    for (u, path), texts in {(i, p): [t for a, b, _, t in held if (a, b) == (i, p)] for i, p, *_ in held if i is not None and p}.items():
        for name, d, p in defs:
            n = " ".join(t or "" for t in texts).split(" ").count(name)
            if n and u != d and path != p:
                factor = (10 if name in ("parseJson", "_private", "long_snake_name")[::2] else 1) * (0.1 if name[0] == "_" else 1) * (0.1 if len({x for a, _, x in defs if a == name}) > 5 else 1)
                want[min(u, d), max(u, d)] = max(want.get((min(u, d), max(u, d)), 0), round(factor * n**0.5, 4))
    found = [(r.i, r.j) for r in got.collect()]
    assert len(found) == len(set(found)) and {(r.i, r.j): r.w for r in got.collect()} == pytest.approx(want)


def test_pairs_of_two_blocks_are_made_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    block = lambda at: pairs._Block(pairs._packed(pa.table({"block": [0] * 400, "idx": rng.integers(at, at + 60, 400), "path": rng.integers(0, 9, 400), "name": rng.integers(0, 5, 400), "w": np.where(rng.random(400) < 0.5, np.nan, rng.integers(1, 6, 400) / 2)}))["rows"][0].as_buffer())
    x, y = block(0), block(1000)
    for a, b in ((x, y), (x, x)):
        whole, parts = [], []
        for most, out in ((1 << 21, whole), (50, parts)):
            monkeypatch.setattr(pairs, "_PAIRS", most)
            met = list(pairs._met(a, b, a is b))
            assert (len(met) > 1) == (most == 50)
            out += sorted(zip(*(np.concatenate(c).tolist() for c in zip(*met, strict=True)), strict=True))
        assert whole == parts and len({r[:2] for r in whole}) == len(whole) and all(i < j for i, j, _ in whole)


def star(spark, n):
    """Seed 0 and its private neighbour 1, both sides of a hub 2 with n leaves."""
    edges = [(0, 1), (0, 2)] + [(2, 3 + k) for k in range(n)]
    adj = graph.adjacency(spark.createDataFrame([(i,) for i in range(3 + n)], "idx long").withColumn("path", F.col("idx").cast("string")), spark.createDataFrame([(a, b, 1.0) for a, b in edges], "i long, j long, w double"))
    return adj, spark.createDataFrame([(i,) for i in range(3 + n)], "idx long"), spark.createDataFrame([(1, 0, 1.0)], "qid int, idx long, score double")


def reference_rank(adj, n, seeds, stop=(), damping=0.85, rounds=30):
    m = np.zeros((n, n))
    for r in adj.collect():
        m[r.src, r.dst] = r.w
    p = np.zeros(n)
    for r in seeds.collect():
        p[r.idx] = max(r.score, 1e-9)
    p /= p.sum()
    hub = np.zeros(n, bool)
    hub[list(stop)] = True
    pi = p.copy()
    for _ in range(rounds):
        pi = (1 - damping) * p + damping * (m.T @ (pi * ~hub) + pi[hub].sum() * p)
    return pi


@pytest.mark.parametrize("blocked", [False, True])
def test_rank_propagation(spark, blocked, monkeypatch):
    adj, node, seeds = star(spark, 60)
    hub = graph.hubs(graph.nodes(node, adj)) if blocked else None
    want = reference_rank(adj, 63, seeds, (2,) if blocked else ())
    for most in (5_000_000, 1):  # arrays, then joins
        monkeypatch.setattr(graph, "BROADCAST_EDGES", most)
        pi = graph.ppr(seeds, adj, hub, iterations=30 if most > 1 else 10)
        got = {r.idx: r.pi for r in pi.collect()}
        expected = want if most > 1 else reference_rank(adj, 63, seeds, (2,) if blocked else (), rounds=10)
        assert all(abs(got.get(i, 0.0) - expected[i]) < 1e-12 for i in range(63)) and sum(got.values()) <= 1 + 1e-9
    if blocked:
        ranked = [r.idx for r in graph.ppr_ranking(graph.ppr(seeds, adj, hub), seeds).orderBy("pos").collect()]
        assert ranked[:3] in ([0, 1, 2], [0, 2, 1]) and 3 not in ranked


@pytest.mark.parametrize("blocked", [False, True])
def test_rank_from_pieces(spark, blocked, monkeypatch):
    """Links that no task holds are packed and dealt out once, whatever the number of iterations, and read in pieces."""
    adj, node, seeds = star(spark, 60)
    hub = graph.hubs(graph.nodes(node, adj)) if blocked else None
    both = seeds.select("qid", "idx", "score").union(seeds.selectExpr("qid + 1", "idx", "score"))
    written = []
    held = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(df) or held(df))
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 1)
    monkeypatch.setattr(graph, "_PIECE", 16)
    rows = graph.ppr(both, adj, hub, iterations=30).collect()
    assert len(written) == 2
    want = reference_rank(adj, 63, seeds, (2,) if blocked else ())
    for qid in {r.qid for r in both.collect()}:
        got = {r.idx: r.pi for r in rows if r.qid == qid}
        assert all(abs(got.get(i, 0.0) - want[i]) < 1e-12 for i in range(63))


def test_resolved_by_substring(spark, monkeypatch):
    """The substring rule looks at no path that lacks the name's rarest three characters, is asked only where no other rule finds, and finds what comparing all would."""
    paths = [f"Lib/x{i % 7}/Worker_{i}.dart" for i in range(60)] + ["a/b", "é/Ünder.md"]
    names = ["ORKER_1", "x3/w", "/W", "b", "nder", "r_5", "zzz", "ib/x", "a/b"]
    c = spark.createDataFrame([(p,) for p in paths], "path string")
    got, asked = {}, []
    holding = graph._holding
    monkeypatch.setattr(graph, "_holding", lambda n, *a: asked.extend(r.name for r in n.collect()) or holding(n, *a))
    for r in graph.resolve_name(spark.createDataFrame([(n,) for n in names], "name string"), c, spark.createDataFrame([], "name string, def_path string")).collect():
        got.setdefault((r.name, r.prio), []).append(r.path)
    for n in names:
        ends = [p for p in paths if p == n or p.endswith("/" + n)]
        want = sorted(p for p in paths if n.lower() in p.lower())[:10]
        if not ends and want:
            assert sorted(got.pop((n, 6))) == want, n
    assert all(k in (1, 4) for _, k in got)
    assert sorted(asked) == sorted(n for n in names if n not in ("a/b", "b"))


def test_expand(spark):
    ranking = spark.createDataFrame([(1, i, i) for i in range(8)], "qid int, idx long, pos int")
    links = spark.createDataFrame([(0, 5), (0, 6), (0, 7), (0, 4), (1, 5), (1, 3)], "idx long, other long")
    got = [r.idx for r in graph.expand(ranking, links, anchors=2, each=3).orderBy("pos").collect()]
    assert got == [0, 4, 5, 6, 1, 3, 2, 7]


def test_imports(spark):
    c = chunks_of(spark, [(0, "app/lib/a.dart", "", "import 'package:app/b.dart';\nimport 'dart:io';"), (1, "app/lib/b.dart", "", ""), (2, "web/src/x.ts", "", "import {q} from '@/y'\nimport z from './z'\nimport e from 'react'"), (3, "web/src/y.ts", "", ""), (4, "web/src/z/index.ts", "", ""), (5, "docs/r.md", "", "[l](../web/src/y.ts#a) and `web/src/x.ts`")])
    e = graph.file_edges(graph.resolve_targets(graph.link_targets(c), c, "app", "app/lib", {"@/": "web/src/"}))
    assert {(r.a, r.b) for r in e.collect()} == {("app/lib/a.dart", "app/lib/b.dart"), ("web/src/x.ts", "web/src/y.ts"), ("web/src/x.ts", "web/src/z/index.ts"), ("docs/r.md", "web/src/y.ts")}


def test_communities_and_report(spark):
    n = spark.createDataFrame([(f"{g}/f{i}.py", "code", 1, ["s"]) for g in "ab" for i in range(4)] + [("docs/adr/1.md", "decision", 1, [])], "path string, kind string, lines int, symbols array<string>")
    edges = [(f"{g}/f{i}.py", f"{g}/f{j}.py", False, 3, "s", 3.0) for g in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a/f0.py", "b/f0.py", True, 0, "", 2.0)]
    e = spark.createDataFrame(edges, "a string, b string, imports boolean, refs int, via string, weight double")
    c = graph.communities(e, n)
    groups = {}
    for r in c.collect():
        groups.setdefault(r.cid, set()).add(r.path)
    assert sorted(map(len, groups.values()), reverse=True) == [4, 4, 1]
    spread = graph.communities(e, n, most=0)  # by joins: the same groups
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, c.collect()))
    missing = graph.missing_refs(n.select("path", "kind", F.lit("see `a/f0.py`, gone/x.py. https://h.org/y/z.py ./f1.py b/f9.ts#l").alias("text")), n)
    text = explore.report("demo", n, e, c, missing)
    assert "| a/f0.py | 4 |" in text and "| a/f0.py | b/f0.py | import |" in text and "| docs/adr/1.md | gone/x.py |" in text and "b/f9.ts" in text and "z.py" not in text
    assert "| a | 4 | a/f0.py, a/f1.py, a/f2.py |" in text and "| links by import | 1 |" in text
    assert "</script>" in explore.to_html("demo <x>", n, e, c) and "demo &lt;x&gt;" in explore.to_html("demo <x>", n, e, c)
    defs = spark.createDataFrame([("thing", "b/f2.py")], "name string, def_path string")
    asked = spark.createDataFrame([(1, "a/f3.py", "thing"), (2, "f0.py", "b/f0.py"), (3, "a/f0.py", "1.md"), (4, "nowhere", "thing"), (5, "thing", "thing")], "qid int, a string, b string")
    got = {r.qid: (r.hops, r.route) for r in tools.find_path(e, asked, n, defs).collect()}
    assert got == {1: (3, "a/f3.py --ref s--> a/f0.py --import--> b/f0.py --ref s--> b/f2.py"), 2: (0, "b/f0.py"), 5: (0, "b/f2.py")}


def test_communities_both_ways(spark):
    """Arrays and joins give the same groups, of no less modularity than planted ones."""
    rng = np.random.default_rng(8)
    pairs = {}
    for _ in range(400):
        g = rng.integers(0, 6)
        a, b = sorted(rng.integers(0, 12, 2) + 12 * (g if rng.random() < 0.9 else rng.integers(0, 6, 2)))
        if a != b:
            pairs[f"f{a:02}", f"f{b:02}"] = float(rng.integers(1, 4))
    e = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a string, b string, weight double")
    n = spark.createDataFrame([(f"f{i:02}",) for i in range(74)], "path string")
    got = dict(map(tuple, graph.communities(e, n).collect()))
    assert got == dict(map(tuple, graph.communities(e, n, most=0).collect())) and len(got) == 74

    def quality(label):
        total, k = 2 * sum(pairs.values()), {}
        for (a, b), w in pairs.items():
            k[label[a]], k[label[b]] = k.get(label[a], 0) + w, k.get(label[b], 0)
            k[label[b]] += w
        return sum(2 * w for (a, b), w in pairs.items() if label[a] == label[b]) / total - sum((x / total) ** 2 for x in k.values())

    assert quality(got) > 0.95 * quality({f"f{i:02}": i // 12 for i in range(74)})


def test_communities_in_blocks(spark):
    """A level over blocks of links gives the labels of the level over arrays and as joins, loops and equal gains too."""
    rng = np.random.default_rng(9)
    links = {}
    for a, b in rng.integers(0, 50, (300, 2)).tolist():
        for x, y in ((a, b), (b, a)):
            links[f"f{x:02}", f"f{y:02}"] = links.get((f"f{x:02}", f"f{y:02}"), 0.0) + 1.0
    e = spark.createDataFrame([(*k, w) for k, w in links.items()], "src string, dst string, weight double").cache()
    got = dict(map(tuple, graph._level_by_blocks(e, sum(links.values())).collect()))
    assert got == dict(map(tuple, graph._level_by_joins(e, sum(links.values())).collect())) and len(set(got.values())) < 50
    names = sorted({a for a, _ in links})
    at = {x: i for i, x in enumerate(names)}
    order = np.array([graph.zlib.crc32(x.encode()) for x in names])
    ends = np.array([(at[a], at[b]) for a, b in links])
    label = graph._modularity_level(ends[:, 0], ends[:, 1], np.array(list(links.values())), order)
    assert got == {x: names[label[i]] for x, i in at.items()}


def test_long_paths(spark):
    e = spark.createDataFrame([(f"p{i:02}", f"p{i + 1:02}") for i in range(20)], "a string, b string")
    one = lambda p: spark.createDataFrame([(p,)], "path string")
    assert graph.shortest_hops(e, one("p00"), one("p20")).first().hops == 20


def test_dense_store(spark, tmp_path):
    from quarry.sources.records import append_store, read_store

    c = chunks_of(spark, [(0, "a", "", "x y"), (1, "b", "", "z"), (2, "c", "", "w")])
    path = str(tmp_path / "store")
    assert read_store(spark, path).count() == 0
    new = dense.refresh_store(c.where("idx < 2"), read_store(spark, path))
    append_store(new, path)
    assert dense.missing_keys(c, read_store(spark, path), "hashing").count() == 1
    v = [r.vec for r in read_store(spark, path).collect()]
    assert all(abs(sum(x * x for x in r) - 1) < 1e-6 for r in v)


def test_bm25_by_hand(spark):
    c = chunks_of(spark, [(0, "p", "", "alpha beta beta"), (1, "q", "", "alpha"), (2, "r", "", "gamma")])
    s = {r.idx: r.score for r in lexical.bm25(c, spark.createDataFrame([(1, "beta unknown")], "qid int, query string")).collect()}
    idf, avg = np.log(1 + 2.5 / 1.5), (4 + 2 + 2) / 3
    assert s == {0: pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 4 / avg)), abs=1e-8)}


def test_bootstrap_forms(spark, monkeypatch):
    """Draws look their cases up without a join, and give what the join gives: also for numbers that no draw meets, twice given ones and nulls."""
    rows = [(i, (i * 37 % 11) / 7) for i in range(1, 61)] + [(5, 2.5), (9, None), (70, 1.0)]
    c = spark.createDataFrame(rows, "num long, diff double")
    held = evaluate.bootstrap(c, 50)
    assert "SortMergeJoin" not in (plan := held._jdf.queryExecution().toString()) and "BroadcastHashJoin" not in plan
    held = held.first()
    monkeypatch.setattr(evaluate, "_HELD", 0)
    assert list(held) == pytest.approx(list(evaluate.bootstrap(c, 50).first()), abs=1e-12)


def test_bootstrap():
    rng = np.random.default_rng(1)
    mean, lo, hi = evaluate.bootstrap_exact((rng.standard_normal(50) + 1).tolist())
    assert lo < mean < hi and lo > 0 and evaluate.bootstrap_exact([]) == (0.0, 0.0, 0.0)


def test_judge(spark):
    a = spark.createDataFrame([(1, '{"structured_output": {"scores": [{"id": 0, "score": 1.4}, {"id": 2, "score": 0.9}]}}'), (2, "broken")], "qid int, answer string")
    got = {(r.qid, r.id): r.score for r in evaluate.judge_scores(a, 3).collect()}
    assert [got[1, i] for i in range(3)] == [1.0, 0.0, 0.9] and got[2, 0] == 0.0


def test_mining(spark):
    rows = [("a" * 8 + "1", 0, "feat(api): add retry to the client (#12)", ["src/a.py", "src/a_test.py"]), ("b" * 9, 1, "Feat(api): Add retry to the client", ["src/b.py"]), ("c" * 9, 2, "fix: short one", ["src/a.py"]), ("d" * 9, 3, "docs: ADR-7 — choose the storage engine now", ["docs/adr/7.md"]), ("e" * 9, 4, "perf: speed up the slow index build", [f"src/{i}.py" for i in range(6)])]
    commits = spark.createDataFrame(rows, "sha string, ord int, subject string, files array<string>")
    files = spark.createDataFrame([(f"src/{x}.py",) for x in "ab012345"] + [("docs/adr/7.md",)], "path string")
    assert [(r.id, r.query, r.gold) for r in history.mine_cases(commits, files).collect()] == [("git-aaaaaaaa", "api: add retry to the client", ["src/a.py"])]
    assert [(r.query, r.gold) for r in history.mine_decisions(commits, files).collect()] == [("choose the storage engine now", ["docs/adr/7.md"])]


def test_throttle(spark):
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    p = spark.createDataFrame([(1, t(0), 1), (1, t(300), 2), (1, t(650), 3), (2, t(10), 4)], "root long, ts string, event_id long").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert sorted(r.event_id for r in events.throttled(p, "root").collect()) == [1, 3, 4]


def test_notes_and_staleness(spark, tmp_path):
    import datetime

    from quarry.sources.records import summary, supersessions

    name = tools.add_note(str(tmp_path), "Use Arrow", "Because.", "decision", ["x"], ["docs/adr/1.md"], now=datetime.datetime(2024, 1, 2))
    assert name.startswith("docs/notes/2024-01-02-use-arrow-")
    with pytest.raises(FileExistsError):
        tools.add_note(str(tmp_path), "Use Arrow", "Because.", "decision", ["x"], ["docs/adr/1.md"], now=datetime.datetime(2024, 1, 2))
    n = spark.createDataFrame([(name, (tmp_path / name).read_text()), ("b.md", "# Head line\ntext"), ("c.md", "summary: 'quoted'\n")], "path string, text string")
    assert {r.path: r.s for r in n.select("path", summary(F.col("text")).alias("s")).collect()} == {name: "Use Arrow", "b.md": "Head line", "c.md": "quoted"}
    old = supersessions(n)
    assert [(r.old, r.new) for r in old.collect()] == [("docs/adr/1.md", name)]
    listing = spark.createDataFrame([("docs/adr/1.md", 5.0), ("x", 50.0), ("y", 1.0)], "path string, mtime double")
    marks = {r.path: r.mark for r in tools.staleness(spark.createDataFrame([("docs/adr/1.md",), ("x",), ("y",), ("z",)], "path string"), listing, old, 10.0).collect()}
    assert marks == {"docs/adr/1.md": f"superseded by {name}", "x": "stale", "y": "", "z": "deleted"}


def test_run_comparison_and_gold(spark):
    pc = spark.createDataFrame([("c", m, i, s) for i, (a, b) in enumerate([(1.0, 0.5), (0.0, 0.5), (1.0, 0.0)]) for m, s in (("x", a), ("y", b))], "cell string, method string, case_id int, score double")
    r = evaluate.compare(pc, "x", "y").first()
    assert (r.n, r.wins, r.losses) == (3, 2, 1) and abs(r["diff"] - 1 / 3) < 1e-12
    assert evaluate.best_of(pc).agg(F.sum("score")).first()[0] == 2.5
    assert evaluate.summary(pc).count() == 2


def test_past_commits_in_blocks(spark, monkeypatch):
    """Blocks in which few commits are scored give what scoring every earlier commit gives."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    subjects = [" ".join(["for", *rng.choice(words, 4), f"n{rng.integers(40)}"]) for _ in range(400)]
    days = rng.integers(1, 60, 400).tolist()
    commits = spark.createDataFrame([(i, days[i], s, [f"f{i}"]) for i, s in enumerate(subjects)], "cid long, ts long, subject string, files array<string>")
    cases = commits.where("cid % 20 = 0").select(F.col("cid").alias("qid"), "ts", F.col("subject").alias("query"))
    monkeypatch.setattr(history, "_COMMITS", 150)
    got: dict[int, dict[str, float]] = {}
    for r in history.past_commits(cases, commits, spark.createDataFrame([(f"f{i}",) for i in range(400)], "path string"), top=5).collect():
        got.setdefault(r.qid, {})[r.path] = r.score
    for q in range(0, 400, 20):
        past = [(i, subjects[i].split()) for i in range(400) if days[i] < days[q]]
        mean = sum(len(s) for _, s in past) / max(1, len(past))
        score = {}
        for t in set(subjects[q].split()):
            df = sum(t in s for _, s in past)
            for i, s in past:
                if t in s:
                    score[i] = score.get(i, 0.0) + np.log(1 + (len(past) - df + 0.5) / (df + 0.5)) * s.count(t) * 2.5 / (s.count(t) + 1.5 * (0.25 + 0.75 * len(s) / mean))
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        assert got.get(q, {}) == {f"f{i}": pytest.approx(score[i], abs=1e-8) for i in best}


def test_equal_subjects_are_scored_once(monkeypatch):
    """A row holds all commits of a subject: it is scored once for an ask, and the smallest ids of the earlier ones count."""
    rng = np.random.default_rng(5)
    commits = {"a b": [(int(rng.integers(100)), i) for i in rng.permutation(200).tolist()], "a c": [(int(rng.integers(100)), 200 + i) for i in range(200)]}
    held = pa.table({"tokens": [k.split() for k in commits], "commits": pa.array([[{"cts": t, "cid": i} for t, i in sorted(v)] for v in commits.values()], pa.list_(pa.struct([("cts", pa.int64()), ("cid", pa.int64())])))})
    asks = pa.table({"ask": pa.array([7, 8], pa.int64()), "ts": pa.array([30, 2], pa.int64()), "avg": [2.0, 2.0], "terms": [[{"term": "b", "idf": 1.0}, {"term": "a", "idf": 0.1}]] * 2})
    scored = []
    best = history._best
    monkeypatch.setattr(history, "_best", lambda *x: scored.append(x[4]) or best(*x))
    got = history._nearest(5)(asks, held).to_pylist()
    assert scored == [2, 2]
    for ask, ts in ((7, 30), (8, 2)):
        want = [i for k in commits for i in sorted(i for t, i in commits[k] if t < ts)][:5]
        assert [r["cid"] for r in got if r["ask"] == ask] == want


def test_texts_move_once(spark):
    """A text meets the names that it may hold in one join, and no link carries a text."""
    c = spark.createDataFrame([(i, f"p{i}.py", "Name%d" % i, "has Name0s and Name2" if i else "x", "code") for i in range(4)], "idx long, path string, symbol string, text string, kind string")
    refs = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "i long, j long, w double")
    _, edges = graph.file_graph(c, refs, spark.createDataFrame([], "a string, b string"))
    plan = edges._jdf.queryExecution().analyzed().toString()
    assert plan.count("Contains(text") + plan.count("contains(text") == 1 and " AS tu#" not in plan and " AS tv#" not in plan
    assert {(r.a, r.b): r.via for r in edges.collect()} == {("p0.py", "p1.py"): "Name0", ("p1.py", "p2.py"): "Name2", ("p2.py", "p3.py"): "Name2"}
