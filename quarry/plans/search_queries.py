"""Queries on scoring, fusion, ranking and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dense, lexical
from quarry.operators import ranking as R
from quarry.plans import standin as S
from quarry.sources.tables import checkpointed


def _bm25(spark: SparkSession, d: str, drop: bool = False) -> DataFrame:
    return lexical.bm25(S.chunks(spark, d), S.queries(spark, d), drop)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_scores(S.vectors(spark, d), S.query_vectors(spark, d))


def _full(spark: SparkSession, d: str, scores: DataFrame) -> DataFrame:
    return R.rank_all(scores, S.queries(spark, d), S.chunks(spark, d))


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d, _bm25(spark, d))


def _by_vector(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d, _dense(spark, d))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return R.rrf(_lexical(spark, d), _by_vector(spark, d))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    top = lexical.top_k(_bm25(spark, d), 10)
    return top.select("qid", "idx", "pos", F.round("score", 6).alias("score"))


def bm25_best_doc_per_term(spark: SparkSession, d: str) -> DataFrame:
    return lexical.best_per_term(S.chunks(spark, d), S.queries(spark, d), True).select("qid", "term", "idx", F.round("w", 6).alias("w"))


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.Index(S.chunks(spark, d), lexical.query_terms(S.queries(spark, d)))
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round("avg_len", 6).alias("avg_len"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top_k(_dense(spark, d), 10).select("qid", "idx", "pos", F.round("score", 6).alias("score"))


def rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).where("pos < 20").select("qid", "idx", "pos", F.round("score", 6).alias("score"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    c, q = S.chunks(spark, d), S.queries(spark, d)
    # one table of weights serves the scores of all terms and the best chunk of those that aren't stopwords
    terms = lexical.query_terms(q)
    weights = checkpointed(lexical.Index(c, terms).weights())
    lex, dense_pos = checkpointed(lexical.scores(weights, terms)), checkpointed(_by_vector(spark, d))
    best = lexical.best_of_terms(weights, lexical.query_terms(q, True))
    return R.seed_filter(R.rrf(_full(spark, d, lex), dense_pos), lex, dense_pos, c.select("idx", F.substring_index("symbol", "~", 1).alias("label")), best)


def seed_filter(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d)


def rerank_head(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank_head(_lexical(spark, d), _dense(spark, d)).where("pos < 60")


def best_passage_per_doc(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d).select("idx", F.col("source").alias("path"))
    return R.first_per_path(_by_vector(spark, d), c, 5)


def superseded_last(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d).select("idx", F.col("source").alias("path"))
    old = c.where("path IN ('src1', 'src3', 'src5')").select("path").distinct()
    return R.superseded_last(R.first_per_path(_by_vector(spark, d), c, 8), old)


def files_at_k(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d).select("idx", F.col("source").alias("path"))
    return R.first_per_path(_lexical(spark, d), c, 10).select("qid", "path", "pos")


def budget_select(spark: SparkSession, d: str) -> DataFrame:
    return R.select_budget(_lexical(spark, d), S.chunks(spark, d), 6000)


def channel_select(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    side = R.only(_by_vector(spark, d), c.where("kind = 'decision'"))
    return R.select_channel(side, _lexical(spark, d), c, 6000, 0.34)


def interleave_3_1(spark: SparkSession, d: str) -> DataFrame:
    return R.interleave(_lexical(spark, d), S.chunks(spark, d)).where("pos < 40")


def alternate(spark: SparkSession, d: str) -> DataFrame:
    return R.alternate(_lexical(spark, d).where("pos < 30"), _by_vector(spark, d).where("pos < 30"))


def gate(spark: SparkSession, d: str) -> DataFrame:
    return R.gate(_fused(spark, d), S.chunks(spark, d).where("kind = 'decision'"), 3)


def drop_gold(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    gold = c.join(S.queries(spark, d), F.col("idx") % 40 == F.col("qid") % 40).select("qid", "path")
    return R.drop_gold(_lexical(spark, d), c, gold).where("pos < 20")


def only_code(spark: SparkSession, d: str) -> DataFrame:
    return R.only(_fused(spark, d), S.chunks(spark, d).where("is_code")).where("pos < 20")


def search_decisions(spark: SparkSession, d: str) -> DataFrame:
    from quarry.plans.tools import search_decisions as tool

    c = S.chunks(spark, d)
    found = tool(c, _dense(spark, d), k=5, superseded=c.where("idx % 7 = 0").select("path"))
    return found.select("qid", "path", "idx", "pos", F.length("body").cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_best_doc_per_term, inverted_index, dense_topk, rrf_topk, seed_filter, rerank_head, best_passage_per_doc, superseded_last, files_at_k, budget_select, channel_select, interleave_3_1, alternate, gate, drop_gold, only_code, search_decisions)}

_L = f"WITH RECURSIVE {S.SQL}, {S.bm25_sql()} "
_D = f"WITH RECURSIVE {S.SQL}, {S.DENSE_SQL} "
_F = f"WITH RECURSIVE {S.SQL}, {S.bm25_sql()}, {S.DENSE_SQL}, {S.FUSED_SQL} "
_ONE = "(PARTITION BY qid, source ORDER BY pos)"


def fold_sql(name: str, ranking: str, budget: str) -> str:
    """Recursive steps of the greedy choice: {name}(qid, idx, pos, tokens)."""
    return f"""
{name}_r AS MATERIALIZED (SELECT qid, idx, tokens, b, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM (SELECT r.qid, r.idx, r.pos, c.tokens, ({budget})::BIGINT AS b FROM {ranking} r JOIN chunks c USING (idx)) WHERE tokens <= b),
{name}_s AS (SELECT qid, 0::BIGINT AS n, max(b) AS room, false AS done, NULL::BIGINT AS idx, 0 AS tokens FROM {name}_r GROUP BY qid
  UNION ALL SELECT s.qid, r.n, CASE WHEN NOT s.done AND r.tokens <= s.room THEN s.room - r.tokens ELSE s.room END, s.done OR (r.tokens <= s.room AND s.room - r.tokens < 50), CASE WHEN NOT s.done AND r.tokens <= s.room THEN r.idx END, r.tokens FROM {name}_s s JOIN {name}_r r ON r.qid = s.qid AND r.n = s.n + 1 WHERE NOT s.done),
{name} AS MATERIALIZED (SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY n) - 1)::INT AS pos, tokens FROM {name}_s WHERE idx IS NOT NULL)"""


SEED_SQL = f"""
qs AS (SELECT * FROM qt WHERE term NOT IN {S.STOP_SQL}),
bestd AS (SELECT qid, term, idx FROM (SELECT qid, term, idx, w, row_number() OVER (PARTITION BY qid, term ORDER BY round(w, 9) DESC, idx) AS r FROM qs JOIN wt USING (term)) WHERE r = 1 AND round(w, 9) > 0),
hd AS (SELECT f.qid, f.idx, f.pos, c.symbol AS label FROM fused f JOIN chunks c USING (idx) LEFT JOIN bm USING (qid, idx) LEFT JOIN (SELECT qid, max(score) AS most FROM bm GROUP BY qid) m USING (qid) JOIN denr dd USING (qid, idx)
  WHERE f.pos < 50 AND (coalesce(bm.score, 0) >= 0.2 * coalesce(most, 0) OR dd.pos < 5)),
hl AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY pos) AS n FROM hd),
sp AS (SELECT qid, idx, min((part, ap, term)) AS place FROM (SELECT qid, idx, 0 AS part, pos AS ap, '' AS term FROM hl WHERE label = '' OR n = 1 UNION ALL SELECT qid, idx, 1, 0, term FROM bestd) GROUP BY ALL),
seeds AS MATERIALIZED (SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY place) - 1)::INT AS pos FROM sp)"""

ORACLE_SQL = {
    "bm25_topk": _L + "SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) - 1)::INT AS pos, round(score, 6) AS score FROM bm QUALIFY pos < 10",
    "bm25_best_doc_per_term": f"WITH {S.SQL}, {S.bm25_sql(True)} SELECT qid, term, idx, round(round(w, 9), 6) AS w FROM (SELECT qid, term, idx, w, row_number() OVER (PARTITION BY qid, term ORDER BY round(w, 9) DESC, idx) AS r FROM qt JOIN wt USING (term)) WHERE r = 1",
    "inverted_index": _L + "SELECT term, count(*) AS df, round(ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf, round(max(avg_len), 6) AS avg_len FROM tok, stats GROUP BY term",
    "dense_topk": _D + "SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) - 1)::INT AS pos, round(score, 6) AS score FROM dn QUALIFY pos < 10",
    "rrf_topk": _F + "SELECT qid, idx, pos::INT AS pos, round(score, 6) AS score FROM fused WHERE pos < 20",
    "seed_filter": _F + f", {SEED_SQL} SELECT * FROM seeds",
    "rerank_head": _F + "SELECT * FROM (SELECT l.qid, l.idx, (row_number() OVER (PARTITION BY l.qid ORDER BY CASE WHEN l.pos < 50 THEN 0 ELSE 1 END, CASE WHEN l.pos < 50 THEN coalesce(dn.score, '-inf'::DOUBLE) END DESC NULLS LAST, l.pos) - 1)::INT AS pos FROM lexr l LEFT JOIN dn USING (qid, idx)) WHERE pos < 60",
    "best_passage_per_doc": _F + f", b AS (SELECT qid, source AS path, idx, pos FROM (SELECT d.*, source, row_number() OVER {_ONE} AS r FROM denr d JOIN chunks USING (idx)) WHERE r = 1) SELECT qid, path, idx, (row_number() OVER (PARTITION BY qid ORDER BY b.pos) - 1)::INT AS pos FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY b.pos) <= 5",
    "superseded_last": _F + f", b AS (SELECT qid, source AS path, idx, pos FROM (SELECT d.*, source, row_number() OVER {_ONE} AS r FROM denr d JOIN chunks USING (idx)) WHERE r = 1), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS r FROM b) SELECT qid, path, idx, (row_number() OVER (PARTITION BY qid ORDER BY path IN ('src1', 'src3', 'src5'), r) - 1)::INT AS pos FROM t WHERE r <= 8",
    "files_at_k": _F + ", b AS (SELECT qid, source AS path, min(pos) AS p FROM lexr JOIN chunks USING (idx) GROUP BY ALL), t AS (SELECT qid, path, (row_number() OVER (PARTITION BY qid ORDER BY p) - 1)::INT AS pos FROM b) SELECT * FROM t WHERE pos < 10",
    "budget_select": _F + f", {fold_sql('pk', 'lexr', '6000')} SELECT * FROM pk",
    "channel_select": _F + f", sd AS (SELECT qid, idx, pos FROM denr JOIN chunks USING (idx) WHERE kind = 'decision'), {fold_sql('p1', 'sd', '2040')}, sm AS (SELECT l.qid, l.idx, l.pos, 6000 - coalesce(spent, 0) AS room FROM lexr l LEFT JOIN (SELECT qid, sum(tokens) AS spent FROM p1 GROUP BY qid) USING (qid) WHERE (l.qid, l.idx) NOT IN (SELECT qid, idx FROM p1)), {fold_sql('p2', 'sm', 'r.room')} SELECT qid, idx, 0 AS part, pos FROM p1 UNION ALL SELECT qid, idx, 1, pos FROM p2",
    "interleave_3_1": _F + ", s AS (SELECT qid, idx, is_code, row_number() OVER (PARTITION BY qid, is_code ORDER BY pos) - 1 AS r FROM lexr JOIN chunks USING (idx)), t AS (SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY r // (CASE WHEN is_code THEN 3 ELSE 1 END), NOT is_code, r) - 1)::INT AS pos FROM s) SELECT * FROM t WHERE pos < 40",
    "alternate": _F + ", s AS (SELECT qid, idx, min(pos * 2 + src) AS ap FROM (SELECT qid, idx, pos, 0 AS src FROM lexr WHERE pos < 30 UNION ALL SELECT qid, idx, pos, 1 FROM denr WHERE pos < 30) GROUP BY ALL) SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY ap) - 1)::INT AS pos FROM s",
    "gate": _F + "SELECT qid, bool_or(kind = 'decision') AS open FROM fused JOIN chunks USING (idx) WHERE pos < 3 GROUP BY qid",
    "drop_gold": _F + "SELECT * FROM (SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY pos) - 1)::INT AS pos FROM lexr WHERE idx % 40 <> qid % 40) WHERE pos < 20",
    "only_code": _F + "SELECT * FROM (SELECT qid, idx, (row_number() OVER (PARTITION BY qid ORDER BY pos) - 1)::INT AS pos FROM fused JOIN chunks USING (idx) WHERE is_code) WHERE pos < 20",
    "search_decisions": _D + ", r AS (SELECT qid, path, idx, length(substr(text, 1, 1600)) AS chars, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS r FROM dn JOIN chunks USING (idx) WHERE kind = 'decision') SELECT qid, path, idx, (row_number() OVER (PARTITION BY qid ORDER BY idx % 7 = 0, r) - 1)::INT AS pos, chars FROM r WHERE r <= 5",
}
