"""Registered queries on the smallest tables: against their SQL, or at least one row for each input row."""

import os

import duckdb
import pytest

from quarry.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    table = "embeddings" if name.startswith("op2_") else "pages" if name.startswith("op5_") else "documents"
    if name not in Q.ORACLE_SQL:
        assert len(got) >= spark.read.parquet(f"{SF}/{table}.parquet").count()
        return
    con = duckdb.connect()
    for x in ("documents", "embeddings", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {x} AS SELECT * FROM read_parquet('{SF}/{x}.parquet')")
    want = con.sql(Q.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_contract_columns(spark):
    wanted = {
        "op2_": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op3_": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op4_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op5_": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op6_": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op7_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op9_": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op10_": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    }
    for head, columns in wanted.items():
        name = next(n for n in Q.QUERIES if n.startswith(head))
        assert columns.items() <= dict(Q.QUERIES[name](spark, SF).dtypes).items()
