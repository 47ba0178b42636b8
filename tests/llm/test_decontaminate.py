import hashlib
import re

import pytest

from quarry.llm.decontaminate import contamination, without_contaminated

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def items(spark, rows):
    long = next(t for i, t in rows if i == 127)
    passage = " ".join(rows[3][1].split()[-40:-15]).upper()
    made = [(0, passage), (1, " ".join(long.split()[100:150])), (2, "one"), (3, ""), (4, None), (None, "w1 w2"), (5, "é, Ñ? ß"), (6, "nowhere at all to be found"), (10, passage), (2, "one")]
    return made, spark.createDataFrame([(i, t, "x") for i, t in made], "item_id long, text string, doc_id string")


def brute(rows, made):
    windows = {}
    for i, t in made:
        w = words(t) if i is not None else []
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit[s : s + n] = [True] * n
                    found |= windows[tuple(w[s : s + n])]
        h = sum(hit)
        near = set()
        for k, names in windows.items():
            size, wanted = len(k) + 3, set(k)
            for p in [p for p, x in enumerate(w) if x in wanted] if wanted <= set(w) else []:
                if wanted <= set(w[p : p + size]):
                    near |= names
                    break
        out.append((i, len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w), len(near)))
    return out


@pytest.mark.parametrize("block", [250_000, 20])
def test_hits(docs, rows, items, block):
    got = [tuple(r) for r in contamination(docs, items[1], block_windows=block).collect()]
    want = brute(rows, items[0])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[5] for w in want) > 3 and sum(w[2] > 0 and not w[5] for w in want) > 0
    kept = without_contaminated(docs, items[1], block_windows=block)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(w[0]) for w in want if not w[5])


def test_proximity(spark):
    item = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "a b " + item), (2, "a b " + item.replace("t6", "t6 extra")), (3, "t0 t5"), (4, " ".join(reversed(item.split()))), (5, item.replace("t6", "t6 x x x x"))], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), block_windows=100).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 1), 5: (0, 0)}


def test_a_long_item_spreads_over_blocks(spark, monkeypatch):
    from quarry.llm import decontaminate as D

    monkeypatch.setattr(D, "_PIECE_WINDOWS", 16)
    item = [f"v{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join(item[i : i + 13])) for i in range(88)] + [(200, " ".join(item)), (201, " ".join(item[:12]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in D.contamination(docs, spark.createDataFrame([("x", " ".join(item))], "item_id string, text string"), block_windows=30).collect()}
    assert got == {i: (13, 1) for i in range(88)} | {200: (100, 1), 201: (0, 0)}


def test_empty(docs, empty, items, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty, items[1]).count() == 0
    assert contamination(docs, none).where("n_hit > 0 OR contaminated").count() == 0
    assert without_contaminated(docs, none).count() == docs.count()
