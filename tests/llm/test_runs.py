"""Substring and line dedup against brute force."""

import hashlib

import corpus_pipeline
from quarry.llm.lines import dedup_lines, without_repeated_lines
from quarry.llm.substrings import dedup_substrings

BIG = 1 << 62


def covered(units, n):
    """Which units of each (id, units) go, by the rule itself."""
    first = {}
    for i, u in units:
        for s in range(len(u) - n + 1):
            key, place = tuple(u[s : s + n]), (BIG if i is None else i, s)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, u in units:
        gone = [False] * len(u)
        for s in range(len(u) - n + 1):
            if first[tuple(u[s : s + n])] < (BIG if i is None else i, s):
                gone[s : s + n] = [True] * n
        out.append(gone)
    return out


def order(x):
    return sorted(x, key=str)


def test_substrings(docs, rows):
    units = [(i, (t or "").encode().split()) for i, t in rows]
    want = []
    for (i, u), gone in zip(units, covered(units, 20), strict=True):
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        want.append((i, len(u), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = [tuple(r) for r in dedup_substrings(docs).collect()]
    assert order(got) == order(want)
    assert sum(w[2] for w in want) > 500


def test_lines(docs, rows):
    blank = " \t\n\r\x0b\x0c"
    units = [(i, [x.strip(blank) for x in (t or "").split("\n") if x.strip(blank)]) for i, t in rows]
    want = []
    for (i, t), (_, u), gone in zip(rows, units, covered(units, 3), strict=True):
        left, k = [], 0
        for line in (t or "").split("\n"):
            drop = False
            if line.strip(blank):
                drop, k = gone[k], k + 1
            if not drop:
                left.append(line)
        want.append((i, len(u), sum(gone), None if t is None else "\n".join(left)))
    got = [tuple(r) for r in dedup_lines(docs, words=None).collect()]
    assert order(got) == order(want)
    assert sum(w[2] for w in want) > 50
    whole = without_repeated_lines(docs, words=None)
    assert whole.columns == docs.columns
    assert order((r.doc_id, r.text) for r in whole.collect()) == order((i, t) for i, *_, t in want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.spans == 7 for r in whole.collect())


def test_empty(empty):
    assert dedup_substrings(empty).count() == dedup_lines(empty).count() == without_repeated_lines(empty).count() == 0


def test_short_runs_of_many_words(spark):
    long = [" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 20), ("b", 19), ("c", 12), ("d", 8), ("e", 60))]
    a, b, c, d, e = long
    texts = [e, a, f"x\n {a}\t\ny", f"{b}\nz", b, f"{c}\n{d}\nq", f"r\n{c}\n\n{d}", f"{c}\nq", f"q\n{e}\n{e}", f"{a}\n{b}\n{d}", f"s\n{a}\n{b}\n{d}"]
    units = [(i, [x.strip() for x in t.split("\n") if x.strip()]) for i, t in enumerate(texts)]
    want = [set() for _ in units]
    for n in (1, 2, 3):
        first = {}
        for i, u in units:
            for s in range(len(u) - n + 1):
                first.setdefault(tuple(u[s : s + n]), (i, s))
                if first[tuple(u[s : s + n])] < (i, s) and (n == 3 or len(" ".join(u[s : s + n]).split()) >= 20):
                    want[i].update(range(s, s + n))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert [got[i].n_removed for i in range(len(texts))] == [len(w) for w in want] == [0, 0, 1, 0, 0, 0, 2, 0, 2, 1, 3]
    assert got[2].text == "x\ny" and got[6].text == "r\n" and got[8].text == "q"
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert kept == {i: r.text for i, r in got.items()}
    assert [r.n_removed for r in dedup_lines(docs, words=None).orderBy("doc_id").collect()] == [0] * 10 + [3]
