"""The driver tables as a corpus: documents are chunks, benchmark texts are queries, the first longer word of a text is its symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import STOPWORDS, token_count
from quarry.sources.tables import spread

#: The same tables as DuckDB common table expressions.
SQL = r"""
chunks AS MATERIALIZED (SELECT doc_id AS idx, source || '/' || doc_id || '.txt' AS path, source, lang, regexp_extract(text, '([A-Za-z]{4,})', 1) AS symbol, text,
  greatest(1, length(text) // 4)::INT AS tokens, lang = 'en' AS is_code, CASE WHEN lang = 'en' THEN 'code' WHEN lang = 'fr' THEN 'decision' ELSE 'doc' END AS kind FROM documents),
queries AS MATERIALIZED (SELECT item_id AS qid, text AS query FROM benchmark)"""

#: tok(idx, term, f), dlen(idx, len), qt(qid, term), bm(qid, idx, score): BM25 as in quarry.operators.lexical.
_TOKENS = r"flatten(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'), lambda w: CASE WHEN len(string_split(regexp_replace(w, '([a-zа-яё0-9])([A-ZА-ЯЁ])', '\1 \2', 'g'), ' ')) > 1 THEN list_append(string_split(lower(regexp_replace(w, '([a-zа-яё0-9])([A-ZА-ЯЁ])', '\1 \2', 'g')), ' '), lower(w)) ELSE [lower(w)] END))"


def tokens_sql(x: str) -> str:
    return _TOKENS.format(x=x)


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def bm25_sql(drop: bool = False) -> str:
    where = f" WHERE term NOT IN {STOP_SQL}" if drop else ""
    return f"""
dtok AS MATERIALIZED (SELECT idx, {tokens_sql("concat_ws(' ', path, symbol, text)")} AS toks FROM chunks),
dlen AS MATERIALIZED (SELECT idx, len(toks) AS len FROM dtok),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM dlen),
qt AS MATERIALIZED (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({tokens_sql('query')}) AS term FROM queries){where}),
tok AS MATERIALIZED (SELECT idx, term, count(*) AS f FROM (SELECT idx, unnest(toks) AS term FROM dtok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
wt AS MATERIALIZED (SELECT term, idx, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avg_len)) AS w
  FROM tok JOIN dlen USING (idx) JOIN (SELECT term, count(*) AS df FROM tok GROUP BY term) USING (term), stats),
bm AS MATERIALIZED (SELECT qid, idx, round(sum(w), 9) AS score FROM qt JOIN wt USING (term) GROUP BY ALL)"""


DENSE_SQL = r"""
vecs AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
dn AS MATERIALIZED (SELECT q.qid, c.idx, round(list_inner_product(a.vec, b.vec), 9) AS score FROM queries q JOIN vecs a ON a.idx = q.qid, chunks c JOIN vecs b ON b.idx = c.idx)"""

#: lexr, denr: full permutations; fused(qid, idx, score, pos).
FUSED_SQL = r"""
grid AS (SELECT qid, idx FROM queries, chunks),
lexr AS MATERIALIZED (SELECT qid, idx, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, idx) - 1 AS pos FROM grid LEFT JOIN bm USING (qid, idx)),
denr AS MATERIALIZED (SELECT qid, idx, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, idx) - 1 AS pos FROM grid LEFT JOIN dn USING (qid, idx)),
rr AS (SELECT qid, idx, round(sum(1.0::DOUBLE / (61 + pos)), 12) AS score FROM (SELECT qid, idx, pos FROM lexr UNION ALL SELECT qid, idx, pos FROM denr) GROUP BY ALL),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) - 1 AS pos FROM rr)"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    kind = F.when(F.col("lang") == "en", "code").when(F.col("lang") == "fr", "decision").otherwise("doc")
    return docs.select(F.col("doc_id").alias("idx"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "source", "lang", F.regexp_extract("text", "([A-Za-z]{4,})", 1).alias("symbol"), "text", token_count("text").alias("tokens"), (F.col("lang") == "en").alias("is_code"), kind.alias("kind"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of chunks: those whose id a document has."""
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("idx"))
    return spread(table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))).join(ids, "idx", "left_semi")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = spread(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")))
    return v.join(queries(spark, d).select("qid"), "qid", "left_semi")
