"""The pipeline's stages against plain Python versions of their rules, and over odd rows."""

from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import toxicity as X
from quarry.llm.labelled import labelled_sample

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\r\x0b\x0c"


def brute_lines(rows):
    """Ids and texts without the lines of runs (3 lines, or 20 words) whose sequence starts earlier. None comes last."""
    solid = [(i, [x.strip(BLANK) for x in (t or "").split("\n") if x.strip(BLANK)]) for i, t in rows]
    gone = [set() for _ in rows]
    for n in (1, 2, 3):
        first = {}
        place = lambda i, s: (i is None, i or 0, s)
        for i, u in solid:
            for s in range(len(u) - n + 1):
                key = tuple(u[s : s + n])
                first[key] = min(first.get(key, place(i, s)), place(i, s))
        for k, (i, u) in enumerate(solid):
            for s in range(len(u) - n + 1):
                if first[tuple(u[s : s + n])] < place(i, s) and (n == 3 or sum(len(x.encode().split()) for x in u[s : s + n]) >= 20):
                    gone[k].update(range(s, s + n))
    out = []
    for (i, t), drop in zip(rows, gone, strict=True):
        left, k = [], 0
        for line in (t or "").split("\n"):
            if not line.strip(BLANK):
                left.append(line)
                continue
            if k not in drop:
                left.append(line)
            k += 1
        out.append((i, None if t is None else "\n".join(left)))
    return out


def brute_near(rows):
    """The rows whose id is the least of its class: links of five-word multisets at 4/5, ids that repeat are one."""
    bags = []
    for i, t in rows:
        w = (t or "").encode().split()
        bags.append((i, Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])))
    root = {i: i for i, _ in bags if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for k, (i, b) in enumerate(bags):
        if i is not None:
            for s in b:
                by_shingle.setdefault(s, []).append(k)
    pairs = {(x, y) for held in by_shingle.values() for n, x in enumerate(held) for y in held[n + 1 :]}
    for x, y in pairs:
        (i, a), (j, b) = bags[x], bags[y]
        if 9 * sum((a & b).values()) >= 4 * (sum(a.values()) + sum(b.values())):
            p, q = sorted((find(i), find(j)))
            root[q] = p
    return [(i, t) for i, t in rows if i is None or find(i) == i]


def words(text):
    out, held = [], bytearray()
    for c in (text or "").encode() + b" ":
        c = c + 32 if 0x41 <= c <= 0x5A else c
        if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80:
            held.append(c)
        elif held:
            out.append(bytes(held))
            held = bytearray()
    return out


def brute_clean(rows, items):
    """The rows of which fewer than one word in twenty lies in a window of 13 item words, or in a whole shorter item."""
    windows = set()
    for _, t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes, out = {len(w) for w in windows}, []
    for i, t in rows:
        w = words(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            out.append((i, t))
    return out


def listed(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def not_toxic(spark, docs, labels):
    """Every text scored by itself, one at a time, by the fitted model."""
    model = X.fit(*labelled_sample(docs, labels, "toxic", 5, 0))
    score = {t: X._scores(model, pa.array([t], pa.string()))[0] for t in {r.text for r in docs.collect()}} if "constant" not in model else {}
    return sorted(((r.doc_id, r.text) for r in docs.collect() if score.get(r.text, 0) < X.CUT), key=str)


def check(spark, docs, folder):
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    sort = lambda x: sorted(x, key=str)
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if name == "packing":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.where("piece = 0").collect()) == sorted((i is None, i or 0) for i, _ in rows)
            return out.count()
        assert out.schema.names == docs.schema.names
        out = out.cache()
        want = {"toxicity": lambda: not_toxic(spark, docs, labels), "line_dedup": lambda: sort(brute_lines(rows)), "near_dedup": lambda: sort(brute_near(rows)), "decontamination": lambda: sort(brute_clean(rows, items))}[name]()
        assert listed(out) == want, name
        docs = out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    n = check(spark, docs, SF)
    assert corpus_pipeline.run(spark, SF).count() == n


@pytest.fixture
def folder(tmp_path, spark):
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(80)] + [(None, 1, 1), (3, None, None), (4, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("a", "loop loop loop"), ("b", None), (None, "x y z"), ("a", "É ñ"), ("", "one"), ("c", "")], "item_id string, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_rows(spark, docs, folder):
    """Nulls in every column, empty and very long texts, repeats, columns whose names the operators use themselves."""
    clash = docs.selectExpr("doc_id", "text", "_id", "spans", "_row", "source AS rep", "n_chars")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    held = items.where("item_id IS NOT NULL")
    held.write.parquet(f"{folder}/kept/benchmark.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{folder}/kept/labels.parquet")
    assert check(spark, clash, f"{folder}/kept") > 20
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, folder).columns == clash.columns


def test_empty_tables(spark, docs, empty, folder, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    none = SimpleNamespace(labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id string, text string"))
    for name, table in vars(none).items():
        table.write.parquet(f"{tmp_path}/none/{name}.parquet")
    n = docs.count()
    assert corpus_pipeline.toxicity(spark, docs, f"{tmp_path}/none").count() == corpus_pipeline.decontamination(spark, docs, f"{tmp_path}/none").count() == n
