"""Queries on what the tools and the evaluation do beside search: gates, significance, judged heads, answers, staleness, callees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evaluate as E
from quarry.operators import events as V
from quarry.operators import graph as G
from quarry.operators import lexical
from quarry.operators import ranking as R
from quarry.plans import standin as S
from quarry.plans import tools
from quarry.plans.graph_queries import _A_ALL, _BM_SEEDS, _IDENT, _TOP, _adj, _files, _G, _refs, _seed_scores, ppr_sql
from quarry.plans.methods import paths_in as named_paths
from quarry.plans.record_queries import _CS, _EV, _GOLD, _case_scores, _events, _gold, _stream
from quarry.plans.search_queries import _D, _F, _L, _by_vector, _dense, _fused, _lexical, fold_sql
from quarry.sources.tables import checkpointed
from quarry.streaming import journal as J

_KS = (1, 3, 5, 10)


def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.gate_counts(_fused(spark, d), S.chunks(spark, d).where("kind = 'decision'"), _KS)


def significance(spark: SparkSession, d: str) -> DataFrame:
    s = E.significance(checkpointed(_case_scores(spark, d)), "lexical", "dense", 300)
    return s.select("cell", "n", *[F.round(x, 6).alias(x) for x in ("diff", "lo", "hi")], "significant")


def judge_head(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d).select("idx", F.col("source").alias("path"))
    ranking = _by_vector(spark, d)
    return R.judge_head(ranking, c, ranking.select("qid", "idx", (F.col("idx") * 7 % 10 / 10).alias("score")), 5)


def recall_symbols(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    picked = R.select_budget(_lexical(spark, d), c, 8000).join(c.select("idx", "path", "symbol"), "idx")
    gold = _gold(spark, d).join(c.select("idx", "symbol"), "idx")
    return E.recall_symbols(picked, gold).select("qid", F.round("recall", 6).alias("recall"))


def gold_check(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows of files that aren't there: benchmark items named as documents."""
    gold = S.queries(spark, d).select("qid", F.concat(F.lit("src1/"), F.col("qid").cast("string"), F.lit(".txt")).alias("path"))
    return E.bad_gold(gold, S.chunks(spark, d)).select("qid", "path")


def root_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of one nation's customers as roots."""
    e = _events(spark, d).withColumn("root", F.concat(F.lit("/Home/U"), F.col("root").cast("string")))
    roots = S.table(spark, d, "customer").where("c_nationkey = 3").select(F.concat(F.lit("/home/u"), F.col("c_custkey").cast("string")).alias("root"))
    return V.of_roots(e, roots).select("event_id", "root")


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(_refs(spark, d), _files(spark, d))


def callees(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: names that ids divisible by 50 define."""
    c = S.chunks(spark, d)
    return tools.callees(G.definitions(c).where("def_idx % 50 = 0").select("name"), c, _refs(spark, d))


def staleness(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d).select("idx", "path")
    old = c.where("idx % 7 = 0").select(F.col("path").alias("old"), F.concat(F.lit("docs/"), F.col("idx").cast("string")).alias("new"))
    return tools.staleness(c.select("path"), c.where("idx % 11 <> 0").select("path", F.col("idx").cast("double").alias("mtime")), old, 500.0)


def render(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d).withColumn("line", F.lit(1))
    return tools.render(lexical.top_k(_dense(spark, d), 5), c).select("qid", F.md5("answer").alias("answer_md5"))


def text_marks(spark: SparkSession, d: str) -> DataFrame:
    """Language, the text without its scope, whether a path is generated, and an option of a method's name."""
    c = S.chunks(spark, d)
    path = F.concat(F.lit("lib/x"), F.col("idx").cast("string"), F.when(F.col("idx") % 3 == 0, ".g.dart").when(F.col("idx") % 3 == 1, ".min.js").otherwise(".dart"))
    option = E.options(F.concat(F.lit("k=60&beta="), F.col("idx").cast("string")))
    return c.select("idx", T.language("text").alias("lang"), F.md5(T.strip_scope(F.concat(F.lit("app/x-1.b: "), "text"))).alias("plain_md5"), T.is_generated(path).alias("generated"), option["beta"].alias("beta"))


def paths_in(spark: SparkSession, d: str) -> DataFrame:
    """An answer for each document that names it, its follower and itself again."""
    c = S.chunks(spark, d)
    follower = F.concat("source", F.lit("/"), (F.col("idx") + 1).cast("string"), F.lit(".txt"))
    answers = c.select(F.col("idx").alias("qid"), F.concat(F.lit("see "), follower, F.lit(", then "), "path", F.lit(" and "), follower).alias("answer"))
    return named_paths(answers, c).select("qid", "path", F.col("pos").cast("int").alias("pos"))


def named_seeds(spark: SparkSession, d: str) -> DataFrame:
    return G.named_seeds(S.queries(spark, d), _seed_scores(spark, d), S.chunks(spark, d)).select("qid", "idx", F.round("score", 6).alias("score"))


def ppr_by_joins(spark: SparkSession, d: str) -> DataFrame:
    """The form for graphs that no task can hold, over the links of every document."""
    seeds = _seed_scores(spark, d)
    pi = G._ppr_joins(G._teleport(seeds), _adj(spark, d, asked="true"), None, G.DAMPING, G.ITERATIONS)
    return G.ppr_ranking(pi, seeds).where("pos < 20").select("qid", "idx", "pos", F.round("score", 6).alias("score"))


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Stems on both sides; tokens without Cyrillic are their own stems."""
    top = lexical.top_k(lexical.bm25(S.chunks(spark, d), S.queries(spark, d), stem=True), 10)
    return top.select("qid", "idx", "pos", F.round("score", 6).alias("score"))


def stream_hints(spark: SparkSession, d: str) -> DataFrame:
    schema = S.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).where("event_type <> 'signup' AND event_type <> 'error'")
    return _stream(spark, J.hints(events.withColumn("is_call", F.col("event_type") == "purchase"), "user_id", 300, 1440), "append")


QUERIES = {f.__name__: f for f in (gate_counts, significance, judge_head, recall_symbols, gold_check, root_events, graph_stats, callees, staleness, render, text_marks, paths_in, named_seeds, ppr_by_joins, bm25_stemmed, stream_hints)}

_PATHS = r"([\p{L}\p{N}_@.-]+(?:/[\p{L}\p{N}_@.-]+)*)"

ORACLE_SQL = {
    "gate_counts": _F + f"SELECT k::INT AS k, count(*) AS n, count(*) FILTER (first < k) AS open FROM (SELECT qid, min(CASE WHEN kind = 'decision' THEN pos END) AS first FROM fused JOIN chunks USING (idx) GROUP BY qid), (SELECT unnest([{', '.join(map(str, _KS))}]) AS k) GROUP BY k",
    "significance": _F + f""", {_CS}, pr AS MATERIALIZED (SELECT x.cell, row_number() OVER (PARTITION BY x.cell ORDER BY x.case_id) - 1 AS num, y.score - x.score AS diff FROM cs x JOIN cs y ON x.cell = y.cell AND x.case_id = y.case_id AND x.method = 'lexical' AND y.method = 'dense'),
wh AS (SELECT cell, count(*) AS n, avg(diff) AS mean FROM pr GROUP BY cell), dw AS (SELECT cell, r, ('0x' || substr(md5(r || ':' || num), 1, 8))::BIGINT % n AS num FROM pr JOIN wh USING (cell), (SELECT unnest(range(300)) AS r)),
ms AS (SELECT cell, r, avg(diff) AS m FROM dw JOIN pr USING (cell, num) GROUP BY ALL), bd AS (SELECT cell, n, round(mean, 9) AS diff, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi FROM ms JOIN wh USING (cell) GROUP BY cell, n, mean)
SELECT cell, n, round(diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS significant FROM bd""",
    "judge_head": _F + """, b AS (SELECT qid, idx, pos FROM (SELECT d.*, row_number() OVER (PARTITION BY qid, source ORDER BY pos) AS r FROM denr d JOIN chunks USING (idx)) WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos) <= 5)
SELECT d.qid, d.idx, (row_number() OVER (PARTITION BY d.qid ORDER BY CASE WHEN b.idx IS NULL THEN 11 ELSE 10 - d.idx * 7 % 10 END, d.pos) - 1)::INT AS pos FROM denr d LEFT JOIN b USING (qid, idx)""",
    "recall_symbols": _F + f", {_GOLD}, {fold_sql('pk', 'lexr', '8000')} SELECT g.qid, round(avg(CASE WHEN pk.idx IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM gold g LEFT JOIN pk USING (qid, idx) GROUP BY g.qid",
    "gold_check": f"WITH {S.SQL} SELECT qid, 'src1/' || qid || '.txt' AS path FROM queries WHERE 'src1/' || qid || '.txt' NOT IN (SELECT path FROM chunks)",
    "root_events": f"WITH {_EV} SELECT event_id, '/Home/U' || root AS root FROM ev WHERE root IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "graph_stats": _G + "SELECT (SELECT count(*) FROM files) AS file_edges, (SELECT count(*) FROM refs) AS ref_edges, (SELECT count(DISTINCT p) FROM (SELECT a AS p FROM files UNION ALL SELECT b FROM files)) AS linked_files",
    "callees": _G + ", w AS (SELECT i AS x, j AS y FROM refs UNION ALL SELECT j, i FROM refs), t AS (SELECT DISTINCT name, y.symbol AS callee FROM defs JOIN w ON x = def_idx JOIN chunks u ON u.idx = def_idx JOIN chunks y ON y.idx = w.y WHERE name IN (SELECT name FROM defs WHERE def_idx % 50 = 0) AND y.symbol <> '' AND contains(u.text, y.symbol)), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY callee) AS n FROM t) SELECT name, count(*) AS n_callees, string_agg(callee, ',' ORDER BY callee) FILTER (n <= 12) AS callees FROM r GROUP BY name",
    "staleness": f"WITH {S.SQL} SELECT path, CASE WHEN idx % 11 = 0 THEN 'deleted' WHEN idx % 7 = 0 THEN 'superseded by docs/' || idx WHEN idx > 500 THEN 'stale' ELSE '' END AS mark FROM chunks",
    "render": _D + "SELECT qid, md5(string_agg('### ' || path || ':1  ' || symbol || chr(10) || substr(text, 1, 1600), chr(10) || chr(10) ORDER BY r)) AS answer_md5 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM dn) JOIN chunks USING (idx) WHERE r <= 5 GROUP BY qid",
    "text_marks": f"WITH {S.SQL} SELECT idx, CASE WHEN regexp_matches(lower(text), '[а-яё]') THEN 'ru' ELSE 'en' END AS lang, md5(regexp_replace('app/x-1.b: ' || text, '^[\\p{{L}}\\p{{N}}_./-]+:\\s+', '')) AS plain_md5, idx % 3 <> 2 AS generated, idx::VARCHAR AS beta FROM chunks",
    "paths_in": f"WITH {S.SQL}, a AS (SELECT idx AS qid, 'see ' || source || '/' || (idx + 1) || '.txt, then ' || path || ' and ' || source || '/' || (idx + 1) || '.txt' AS answer FROM chunks), w AS (SELECT qid, unnest(ws) AS path, generate_subscripts(ws, 1) AS i FROM (SELECT qid, regexp_extract_all(answer, '{_PATHS}', 1) AS ws FROM a)), f AS (SELECT qid, path, min(i) AS i FROM w WHERE path IN (SELECT path FROM chunks) GROUP BY ALL) SELECT qid, path, (row_number() OVER (PARTITION BY qid ORDER BY i) - 1)::INT AS pos FROM f",
    "named_seeds": _L + f", sd AS MATERIALIZED ({_BM_SEEDS}), df AS (SELECT symbol AS name, idx FROM chunks WHERE length(symbol) >= 4), nm AS (SELECT DISTINCT qid, df.idx FROM (SELECT qid, unnest({_IDENT.replace('text', 'query')}) AS name FROM queries) JOIN df USING (name)) SELECT qid, idx, round(max(score), 6) AS score FROM (SELECT * FROM sd UNION ALL SELECT qid, idx, most FROM nm JOIN (SELECT qid, max(score) AS most FROM sd GROUP BY qid) USING (qid)) GROUP BY ALL",
    "ppr_by_joins": f"{_A_ALL}, {S.bm25_sql()}, {ppr_sql(None, 'pi', _BM_SEEDS)}" + _TOP,
    "bm25_stemmed": _L + "SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) - 1)::INT AS pos, round(score, 6) AS score FROM bm QUALIFY pos < 10",
    "stream_hints": f"""WITH RECURSIVE {_EV}, p AS MATERIALIZED (SELECT root, ts, event_id, row_number() OVER (PARTITION BY root ORDER BY ts, event_id) AS n FROM ev e WHERE event = 'call' AND NOT EXISTS (SELECT 1 FROM ev q WHERE q.root = e.root AND q.event = 'ready' AND q.ts <= e.ts AND e.ts < q.ts + INTERVAL 300 MINUTE)),
f AS (SELECT root, 0::BIGINT AS n, NULL::TIMESTAMP AS last, NULL::BIGINT AS id FROM (SELECT DISTINCT root FROM p) UNION ALL SELECT f.root, p.n, CASE WHEN last IS NULL OR p.ts >= last + INTERVAL 1440 MINUTE THEN p.ts ELSE last END, CASE WHEN last IS NULL OR p.ts >= last + INTERVAL 1440 MINUTE THEN p.event_id END FROM f JOIN p ON p.root = f.root AND p.n = f.n + 1)
SELECT root AS key, id AS event_id FROM f WHERE id IS NOT NULL""",
}
