import numpy as np

from quarry.llm.vectors import meeting, tables_of, vector_links


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 24)).astype(np.float32)
    for i in range(1, 200):  # chains and clouds of near vectors, copies and scaled copies
        v[i] = v[rng.integers(0, i)] * rng.uniform(0.5, 2) + rng.standard_normal(24).astype(np.float32) * [0, 0.05, 0.2, 0.35][i % 4]
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] * 24, 0), (904, [], 0), (905, [1.0, 0.0], 0), (906, [3.0, 0.0], 0), (None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    e = v.astype(float)
    c = e @ e.T / np.outer(np.linalg.norm(e, axis=1), np.linalg.norm(e, axis=1))
    link = (c >= 0.9) & ~np.eye(400, dtype=bool)
    root = np.arange(400)
    while True:
        new = np.array([min([root[i], *root[link[i]]]) for i in range(400)])
        if (new == root).all():
            break
        root = new
    for block in (2048, 32):
        got = {r.vec_id: r for r in vector_links(df, block=block).collect()}
        assert len(got) == len(rows)
        found = sum(got[i].n_links for i in range(400))
        assert found <= link.sum() and found >= link.sum()
        assert np.mean([got[i].component_id == root[i] for i in range(400)]) > 0.99
        assert [got[i].n_links for i in (900, 901, 902, 903, 904, None)] == [0] * 6
        assert [(got[i].n_links, got[i].component_id) for i in (905, 906)] == [(1, 905)] * 2


def test_tables():
    assert abs(meeting(0.447, 1.5) - 0.762) < 0.01
    k, n = tables_of(50_000)
    assert (1 - meeting(0.2**0.5) ** k) ** n <= 1e-5


def test_repeated_ids_and_clashing_columns(spark):
    """Vectors of a repeated id are one node for components, and each counts its own links."""
    rows = [(7, [1.0, 0.0, 0.1], 1, 2), (7, [0.0, 1.0, 0.0], 1, 2), (3, [0.0, 1.0, 0.01], 1, 2), (5, [1.0, 0.0, 0.0], 1, 2), (5, [1.0, 0.0, 0.0], 1, 2), (9, [0.0, 0.0, 1e300], 1, 2)]
    got = vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec int, rep int"))
    assert sorted(map(tuple, got.collect())) == [(3, 1, 3, True), (5, 2, 3, False), (5, 2, 3, False), (7, 1, 3, False), (7, 2, 3, False), (9, 0, 9, True)]


def test_empty(spark):
    assert vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
