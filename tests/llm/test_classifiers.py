"""Held-out accuracy on the driver's table, and the defined edge cases."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity as X
from quarry.llm.labelled import labelled_sample
from quarry.llm.quality import dual_coordinate_descent, log_count_ratio, quality_scores
from quarry.llm.toxicity import isotonic, toxicity_scores, without_toxic

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for scores, label, least in ((quality_scores(docs, labels), "quality", 0.98), (toxicity_scores(docs, labels), "toxic", 0.97)):
        h = scores.where("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()
        assert ((h.predicted == h[label]).mean()) >= least
        assert h.score.between(0, 1).all() and (h[h[label] == 1].score.mean() > 0.9 if label == "quality" else h[h[label] == 0].score.mean() < 0.1)


def test_edge_cases(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2, "x") for i in range(0, 100)] + [(None, 1, 1, "x"), (5, None, None, "x"), (6, 1, 1, "y"), (6, 1, 1, "y")], "doc_id long, quality int, toxic int, text string")
    none = labels.where("false")
    for scores in (quality_scores, toxicity_scores):
        got = scores(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert all((r.held_out is None) == (r.doc_id is None) for r in got)
        assert {r.score for r in scores(docs, none).collect()} == {0.5}
        assert scores(empty, labels).count() == 0
    kept = without_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(rows)  # no model, so nothing is rejected
    assert without_toxic(docs, labels.withColumn("toxic", F.lit(1))).count() == len(rows)
    assert without_toxic(empty, labels).count() == 0


def test_sample(spark):
    """Repeated documents count once and don't crowd others out; long texts are fitted on too; the bytes are bounded."""
    docs = spark.createDataFrame([(1, "x")] * 5 + [(1, "a")] + [(2, "y"), (3, "z" * 100_000), (4, None), (None, "n")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)] + [(1, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    every = {1: ("a", 1), 2: ("y", 0), 3: ("z" * 100_000, 1), 4: ("", 0)}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in every}
    want = [every[i] for i in sorted(every) if fold[i] != 0]
    texts, y = labelled_sample(docs, labels, "toxic", 5, 0, rows=5)
    assert list(zip(texts.to_pylist(), y, strict=True)) == want and len(want) >= 3
    texts, y = labelled_sample(docs, labels, "toxic", 5, 0, size=1000)
    assert list(zip(texts.to_pylist(), y, strict=True)) == [x for x in want if len(x[0]) < 1000]


def test_coordinate_descent_reaches_the_optimum():
    """Against a slow projected-gradient solver of the same dual."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(40)]
    y = (rng.random(40) < 0.4).astype(int)
    scale = rng.standard_normal(12)
    most = (40 / (2 * np.array([(y == 0).sum(), (y == 1).sum()])))[y]
    v = np.zeros((40, 12))
    for i, x in enumerate(rows):
        v[i, x] = scale[x] / np.sqrt(len(x))
    signed = v * np.where(y == 1, 1.0, -1.0)[:, None]
    alpha, step = np.zeros(40), 1 / np.linalg.norm(signed @ signed.T, 2)
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - signed @ (signed.T @ alpha)), 0, most)
    loss = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - signed @ w)).sum()
    slow = loss(signed.T @ alpha)
    found = dual_coordinate_descent(rows, y, scale, epochs=500)
    assert abs(loss(np.divide(found, scale)) - slow) < 1e-2 * slow


def test_log_count_ratio_by_counting():
    rows, y = [np.array([0, 1]), np.array([0]), np.array([0, 2]), np.array([1, 0])], np.array([1, 1, 0, 0])
    got = log_count_ratio(rows, y, 2, least=2)
    share = [lambda n: (n + 0.5) / 2.5] * 2
    want = [np.log(share[1](2) / share[0](2)), np.log(share[1](1) / share[0](1)), 0.0, 0.0]
    assert np.allclose(got, want)


def test_isotonic():
    rng = np.random.default_rng(0)
    margin = rng.standard_normal(500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * margin))).astype(int)
    knots, share = isotonic(margin, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(share) >= -1e-9).mean() > 0.9 and abs(np.interp(0, knots, share) - 0.5) < 0.2


def test_isotonic_against_the_min_max_formula():
    rng = np.random.default_rng(1)
    margin = np.sort(rng.standard_normal(60))
    y = (rng.random(60) < 0.5).astype(int)
    n = len(y)
    want = np.array([max(min(y[i : j + 1].mean() for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
    knots, share = isotonic(margin, y)
    begin = np.flatnonzero(np.concatenate([[True], np.abs(np.diff(want)) > 1e-12]))
    size = np.diff(np.append(begin, n))
    held = want[begin] * size
    drawn = np.where(held < size, held + 0.5 * (held > 0), held + 0.5) / (size + 1)
    assert np.allclose(knots, np.stack([margin[begin], margin[begin + size - 1]], 1).reshape(-1)) and np.allclose(share, np.repeat(drawn, 2))


def test_first_split_against_all_splits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (50, 3)).astype(float)
    y = (rng.random(50) < 0.4).astype(int)
    t = X.Trees(rounds=1, depth=1, bins=64).fit(x, y)
    p = 1 / (1 + np.exp(-t.start))
    g, h = p - y, np.full(50, p * (1 - p) + 1e-6)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    splits = [(x[:, f] <= c) for f in range(3) for c in range(9) if 2 <= (x[:, f] <= c).sum() <= 48]
    feature, cut, value = t.trees[0]
    left = x[:, feature[0]] <= cut[0]
    assert abs(gain(left) - max(gain(m) for m in splits)) < 1e-9
    assert np.allclose(value, [-g[m].sum() / (h[m].sum() + 1) * t.rate for m in (left, ~left)])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    t = X.Trees().fit(x[:600], y[:600])
    assert ((t.margin(x[600:]) > 0) == (y[600:] == 1)).mean() > 0.9
