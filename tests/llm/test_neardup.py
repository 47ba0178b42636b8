from collections import Counter

import numpy as np

from quarry.llm import textops as T
from quarry.llm.neardup import bag_minhash, near_duplicates, one_of_each


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows):
    bags = {i: bag(t) for i, t in rows if i is not None}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if bags[a] and bags[b] and 9 * both >= 4 * (sum(bags[a].values()) + sum(bags[b].values())):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = Counter(rng.integers(0, 300, 600).tolist())
    b = a.copy()
    for k in list(b)[:60]:
        b[k] = int(rng.integers(1, 40))
    row = np.array([0] * len(a) + [1] * len(b))
    key = T.mix(np.array([*a, *b], np.uint64) + np.uint64(5))
    s = bag_minhash(row, key, np.array([*a.values(), *b.values()]), 2, 4096)
    truth = sum((a & b).values()) / sum((a | b).values())
    assert abs((s[0] == s[1]).mean() - truth) < 0.03


def test_classes(docs, rows):
    want = classes(rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.class_id == r.doc_id)
    assert sum(not r.kept for r in got) > 15


def test_one_large_group(spark):
    """Copies of one text, each with its own share of changed words: some reach the threshold only through others."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        for k in rng.integers(0, 150, i % 12):
            words[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    want = classes(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_repeated_ids_with_different_texts(spark):
    """A document of several rows has the links of all its texts."""
    words = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)], [f"c{i}" for i in range(60)]
    a, b, c = (" ".join(x) for x in words)
    a2, b2 = " ".join([*words[0], "x"]), " ".join([*words[1], "x"])
    rows = [(1, a), (1, b), (2, a2), (3, b2), (6, None), (6, c), (5, c), (8, a), (8, "alone"), (9, "alone")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (6, 5, False), (6, 5, False), (8, 1, False), (8, 1, False), (9, 1, False)]


def test_tables_are_deleted(spark, docs, tmp_path):
    import glob

    held = lambda: set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/../*/tables-*/*"))
    before = held()
    near_duplicates(docs).count()
    assert len(held() - before) <= 1


def test_kept_rows(docs, empty):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert near_duplicates(empty).count() == one_of_each(empty).count() == 0
