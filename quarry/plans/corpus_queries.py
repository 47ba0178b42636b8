"""Queries on chunking and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import chunking as C
from quarry.operators.dense import missing_keys, normalized
from quarry.plans import standin as S


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    t = S.table(spark, d, "documents").select("doc_id", X.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def query_tokens_stop(spark: SparkSession, d: str) -> DataFrame:
    return S.queries(spark, d).select("qid", F.array_join(X.query_tokens("query", True), " ").alias("tokens"), F.size(X.query_tokens("query")).cast("long").alias("n_all"))


def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = C.window_chunks(S.chunks(spark, d).select("path", "text"))
    return c.select("id", "path", "line", X.token_count("text").alias("tokens"), F.md5("text").alias("digest"))


def long_split(spark: SparkSession, d: str) -> DataFrame:
    c = C.split_long(S.chunks(spark, d).select(F.concat("path", F.lit("::"), "symbol").alias("id"), "path", "symbol", "text", F.lit(1).alias("line")))
    return c.select("id", "symbol", "line", F.length("text").cast("long").alias("chars"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus_stats(S.chunks(spark, d))


def dup_symbol_numbering(spark: SparkSession, d: str) -> DataFrame:
    return C.number_repeats(S.chunks(spark, d), ["source"], ["idx"], "symbol", "~").select("idx", "source", F.col("numbered").alias("symbol"))


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return C.fingerprint(S.chunks(spark, d).withColumn("id", F.col("path")), ["source"])


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).select("idx", X.slug(F.substring_index("text", "\n", 1)).alias("slug"))


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).where(X.glob_match("path", ["src1*/*", "src2/*[05].txt"]) & ~X.glob_match("path", ["*/?7*.txt"])).select("idx", "path", X.suffix("path").alias("suffix"))


def kind_of(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), "/+$", ""), F.lit("/x"))
    made = F.when(F.col("page_id") % 3 == 0, F.concat(p, F.lit(".py"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("docs/adr/"), p, F.lit(".md"))).otherwise(F.concat(F.lit("tests/"), p, F.lit("_test.ts")))
    t = S.table(spark, d, "pages").select("page_id", made.alias("path"))
    return t.select("page_id", "path", X.kind_of("path").alias("kind"), X.is_test("path").alias("is_test"), X.dirname("path").alias("dir"), X.basename("path").alias("base"))


def overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = S.chunks(spark, d).select("idx", X.tokenize("text").alias("dt"))
    q = S.queries(spark, d).select("qid", X.query_tokens("query").alias("qt"))
    pairs = q.join(docs, F.col("qid") == F.col("idx"))
    return pairs.select("qid", F.round(X.overlap_ratio(F.col("qt"), F.col("dt")), 6).alias("overlap")).where("overlap < 0.6")


def vecstore_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(spark, d).select("idx", F.sha1(F.concat("path", F.lit(" "), "symbol", F.lit("\n"), "text")).alias("key"))


def embed_anti_join(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    held = c.where("kind = 'code'").select(F.lit("m").alias("model"), F.sha1(F.concat("path", F.lit(" "), "symbol", F.lit("\n"), "text")).alias("key"))
    return missing_keys(c, held, "m").select("key")


def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = S.table(spark, d, "embeddings").select("vec_id", normalized("embedding").alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def missing_refs(spark: SparkSession, d: str) -> DataFrame:
    """Paths built from a document's id and source; every third names a file that isn't there."""
    from quarry.operators.graph import missing_refs as op

    c = S.chunks(spark, d)
    named = c.select("path", "kind", F.concat(F.lit("see "), "source", F.lit("/"), (F.col("idx") + F.when(F.col("idx") % 3 == 0, 10**7).otherwise(0)).cast("string"), F.lit(".txt. and http://x.org/a/b.txt")).alias("text"))
    return op(named, c)


QUERIES = {f.__name__: f for f in (tokenize_stats, query_tokens_stop, window_chunks, long_split, corpus_stats, dup_symbol_numbering, fingerprint, slugs, glob_filter, kind_of, overlap_filter, vecstore_keys, embed_anti_join, normalized_vectors, missing_refs)}

_W = f"WITH {S.SQL} "
ORACLE_SQL = {
    "tokenize_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.tokens_sql('text')} AS t FROM documents)",
    "query_tokens_stop": f"SELECT item_id AS qid, array_to_string(list_filter(t, lambda x: x NOT IN {S.STOP_SQL}), ' ') AS tokens, len(t) AS n_all FROM (SELECT item_id, {S.tokens_sql('text')} AS t FROM benchmark)",
    "window_chunks": _W + """, w AS (SELECT path, text, unnest(range(0, (length(text) + 2999) // 3000)) AS i FROM chunks),
p AS (SELECT path, i, substr(text, (i * 3000 + 1)::BIGINT, 3000) AS t, substr(text, 1, (i * 3000)::BIGINT) AS before FROM w)
SELECT CASE WHEN i = 0 THEN path ELSE path || '@' || i END AS id, path, (1 + length(before) - length(replace(before, chr(10), '')))::INT AS line, greatest(1, length(t) // 4)::INT AS tokens, md5(t) AS digest FROM p""",
    "long_split": _W + """, w AS (SELECT path || '::' || symbol AS id, symbol, text, unnest(range(0, greatest(1, (length(text) + 5999) // 6000))) AS i FROM chunks),
p AS (SELECT *, substr(text, (i * 6000 + 1)::BIGINT, 6000) AS t, substr(text, 1, (i * 6000)::BIGINT) AS before FROM w)
SELECT CASE WHEN length(text) <= 6000 THEN id ELSE id || '@' || i END AS id, symbol, (1 + length(before) - length(replace(before, chr(10), '')))::INT AS line, length(t) AS chars FROM p""",
    "corpus_stats": _W + "SELECT * FROM (SELECT split_part(path, '/', 1) AS segment, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, segment LIMIT 12), (SELECT count(*) AS chunks, count(DISTINCT path) AS files, sum(tokens)::BIGINT AS tokens FROM chunks)",
    "dup_symbol_numbering": _W + ", r AS (SELECT *, row_number() OVER (PARTITION BY source, symbol ORDER BY idx) - 1 AS n FROM chunks) SELECT idx, source, CASE WHEN n = 0 THEN symbol ELSE symbol || '~' || n END AS symbol FROM r",
    "fingerprint": _W + "SELECT source, substr(sha1(string_agg(path || chr(0) || text, '' ORDER BY idx)), 1, 12) AS fingerprint FROM chunks GROUP BY source",
    "slugs": _W + r"SELECT idx, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'section') AS slug FROM chunks",
    "glob_filter": _W + r"SELECT idx, path, '.txt' AS suffix FROM chunks WHERE regexp_full_match(path, 'src1.*/.*|src2/.*[05]\.txt', 's') AND NOT regexp_full_match(path, '.*/.7.*\.txt', 's')",
    "kind_of": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/+$', '') || '/x' AS p FROM pages),
q AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN p || '.py' WHEN 1 THEN 'docs/adr/' || p || '.md' ELSE 'tests/' || p || '_test.ts' END AS path FROM p)
SELECT page_id, path, CASE page_id % 3 WHEN 1 THEN 'decision' ELSE 'code' END AS kind, (page_id % 3 = 2 OR path LIKE '%/test/%' OR path LIKE 'test/%' OR path LIKE '%/tests/%') AS is_test, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM q""",
    "overlap_filter": _W + f", p AS (SELECT qid, {S.tokens_sql('query')} AS qt, {S.tokens_sql('text')} AS dt FROM queries JOIN chunks ON qid = idx), o AS (SELECT qid, round(len(list_filter(qt, lambda t: list_contains(dt, t))) / greatest(len(qt), 1), 6) AS overlap FROM p) SELECT * FROM o WHERE overlap < 0.6",
    "vecstore_keys": _W + "SELECT idx, sha1(path || ' ' || symbol || chr(10) || text) AS key FROM chunks",
    "embed_anti_join": _W + "SELECT DISTINCT sha1(path || ' ' || symbol || chr(10) || text) AS key FROM chunks WHERE kind <> 'code'",
    "normalized_vectors": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS s FROM v) SELECT vec_id, round(e[1] / s, 6) AS first, round(list_sum(list_transform(e, lambda x: x / s)), 6) AS total FROM n",
    "missing_refs": _W + "SELECT path, source || '/' || (idx + 10000000) || '.txt' AS ref FROM chunks WHERE kind = 'decision' AND idx % 3 = 0",
}
