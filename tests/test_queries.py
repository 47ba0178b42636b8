"""Every registered query runs, and equals its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
CORE = __import__("quarry.plans.catalogue", fromlist=["x"])


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        where = f"{SF}/{name}/*" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return repr(round(float(x), 6))
    return str(x).removesuffix(".000000")


@pytest.mark.parametrize("name", sorted(CORE.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name not in CORE.ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(CORE.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ref_edges_long", "bootstrap_ci", "judge_scores", "past_commits", "resolve_name", "explain_users", "shortest_path", "usage_attribution"])
def test_no_subsets(name):
    """Searches ask the ids divisible by 50; nothing else is a part of its table."""
    sql = entry.oracle_sql()[name]
    assert not any(x in sql for x in ("'src1'", "c_custkey <", "event_id % 10 ", "% 1000", "IN (5, 6, 7)", "% 100 ", "def_idx % 10 ", "[1:12]"))


def test_whole_tables(spark):
    rows = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    assert entry.queries()["bootstrap_ci"](spark, SF).first().n == rows("customer").count()
    assert entry.queries()["judge_scores"](spark, SF).select("qid").distinct().count() == rows("events").count()


@pytest.mark.parametrize("name", ["ppr_by_joins", "ppr_topk"])
def test_ranks_follow_every_documents_links(spark, tmp_path, name):
    """Rank reaches documents of any number by the link to the one 200 before."""
    docs = [(1, "alpha", "en", "src1"), (201, "beta", "en", "src1"), (401, "gamma", "en", "src1"), (203, "delta", "en", "src3")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.idx for r in entry.queries()[name](spark, str(tmp_path)).orderBy("pos").collect()] == [201, 1, 401]
