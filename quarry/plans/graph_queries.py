"""Queries on the reference graph, rank propagation, the file graph and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import lexical
from quarry.operators import ranking as R
from quarry.plans import standin as S
from quarry.plans.search_queries import _F, SEED_SQL, _dense, fold_sql
from quarry.sources.tables import checkpointed


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return G.ref_edges(S.chunks(spark, d))


#: The documents whose links most queries have.
_FIFTH = "idx % 5 = 0"


def _files(spark: SparkSession, d: str, asked: str = _FIFTH) -> DataFrame:
    """Links between documents: every asked document to the one 200 before it, if of its source, as resolved targets."""
    c = S.chunks(spark, d)
    targets = c.where(asked).select("path", F.concat(F.lit("../"), "source", F.lit("/./"), (F.col("idx") - 200).cast("string"), F.lit(".txt")).alias("target"))
    return G.file_edges(G.resolve_targets(targets, c))


def ref_edges_cap(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).select("i", "j", F.round("w", 6).alias("w"))


def ref_edges_long(spark: SparkSession, d: str) -> DataFrame:
    """The uncapped weighting over all documents."""
    return G.ref_edges(S.chunks(spark, d), "long", digits=6)


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    """href targets of pages, resolved against the pages' own file names."""
    pages = S.table(spark, d, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    named = G.link_targets(pages)
    files = pages.select("path").union(named.select(F.col("target").alias("path")).where(F.length("path") % 2 == 0))
    return G.file_edges(G.resolve_targets(named, files))


def file_edges(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = G.neighbours(S.chunks(spark, d), _refs(spark, d), _files(spark, d))
    return n.groupBy("idx").agg(F.count("*").alias("n"), F.sum("other").alias("total"))


def _adj(spark: SparkSession, d: str, asked: str = _FIFTH) -> DataFrame:
    return G.adjacency(S.chunks(spark, d), _refs(spark, d), _files(spark, d, asked), siblings=True)


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return _adj(spark, d).select("src", "dst", F.round("w", 6).alias("w"))


def hub_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.hubs(G.nodes(S.chunks(spark, d), _adj(spark, d)))


def _seed_scores(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(lexical.top_k(lexical.bm25(S.chunks(spark, d), S.queries(spark, d)), G.SEEDS).select("qid", "idx", "score"))


def _ranked(spark: SparkSession, d: str, blocked: bool = False, beta: float = 0.0, asked: str = _FIFTH) -> DataFrame:
    c, adj, seeds = S.chunks(spark, d), _adj(spark, d, asked), _seed_scores(spark, d)
    node = G.nodes(c, adj)
    pi = G.ppr(seeds, adj, G.hubs(node, least=5) if blocked else None)
    return G.ppr_ranking(pi, seeds, node, beta).where("pos < 20").select("qid", "idx", "pos", F.round("score", 6).alias("score"))


def ppr_topk(spark: SparkSession, d: str) -> DataFrame:
    """Rank over the links of every document."""
    return _ranked(spark, d, asked="true")


def ppr_transit_block(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, blocked=True)


def ppr_beta(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, beta=0.5)


def expand(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    ranking = R.rank_all(lexical.bm25(c, S.queries(spark, d)), S.queries(spark, d), c)
    return G.expand(ranking, G.neighbours(c, _refs(spark, d), _files(spark, d))).where("pos < 60")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.file_graph(S.chunks(spark, d), _refs(spark, d), _files(spark, d))


def file_graph(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


def file_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _graph(spark, d)[0]
    return n.select("path", "kind", F.col("lines").cast("long").alias("lines"), F.array_join("symbols", ",").alias("symbols"))


def hubs(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.explore import hub_files

    return hub_files(*_graph(spark, d))


def undocumented_hubs(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.explore import undocumented

    return undocumented(*_graph(spark, d))


def cross_links(spark: SparkSession, d: str) -> DataFrame:
    """Heaviest code links between top folders, with each folder as its own subsystem."""
    from quarry.operators.explore import cross_links as op

    n, e = _graph(spark, d)
    return op(n, e, n.select("path", F.crc32(F.substring_index("path", "/", 1)).alias("cid")), 15).select("a", "b", "weight", "via")


def _resolved(spark: SparkSession, d: str, asked: str) -> DataFrame:
    c = S.chunks(spark, d)
    names = c.where(asked).select(F.explode(F.array(F.col("path"), F.col("symbol"), F.upper("symbol"), F.concat(F.col("idx").cast("string"), F.lit(".txt")), F.concat(F.lit("_"), F.col("idx").cast("string")), F.concat(F.lit("C"), F.substring("path", 3, 5)))).alias("name")).where("name <> ''")
    return G.resolve_name(names, c, G.definitions(c))


def resolve_name(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: ids divisible by 50."""
    return _resolved(spark, d, "idx % 50 = 0")


def _explained(spark: SparkSession, d: str, asked: str) -> DataFrame:
    from quarry.plans.tools import explain

    c = S.chunks(spark, d)
    return explain(G.definitions(c).where(asked).select("name"), c, _refs(spark, d))


def explain_users(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: names that ids divisible by 50 define."""
    return _explained(spark, d, "def_idx % 50 = 0")


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From the stated query set, ids divisible by 50, to every file."""
    _, e = _graph(spark, d)
    c = S.chunks(spark, d).select("path", "idx")
    return G.shortest_hops(e, c.where("idx % 50 = 0"), c)


def communities(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return G.communities(e, n)


def search_code(spark: SparkSession, d: str) -> DataFrame:
    from quarry.plans.tools import search_code as tool

    return tool(S.chunks(spark, d), S.queries(spark, d), _dense(spark, d), _refs(spark, d))


QUERIES = {f.__name__: f for f in (ref_edges_cap, ref_edges_long, link_edges, file_edges, neighbours, adjacency, hub_nodes, ppr_topk, ppr_transit_block, ppr_beta, expand, file_graph, file_nodes, hubs, undocumented_hubs, cross_links, resolve_name, explain_users, shortest_path, communities, search_code)}

_IDENT = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Za-z_]') AND length(w) >= 4)"
REFS = f"""
defs AS (SELECT symbol AS name, idx AS def_idx, path AS def_path FROM chunks WHERE length(symbol) >= 4),
many AS (SELECT name FROM defs GROUP BY name HAVING count(*) <= 3),
used0 AS MATERIALIZED (SELECT name, use_idx, use_path, count(*) AS n FROM (SELECT idx AS use_idx, path AS use_path, unnest({_IDENT}) AS name FROM chunks) WHERE name IN (SELECT name FROM defs) GROUP BY ALL),
used AS (SELECT * FROM used0 WHERE name IN (SELECT name FROM many) AND name IN (SELECT name FROM used0 GROUP BY name HAVING count(*) <= 200)),
refs AS MATERIALIZED (SELECT least(use_idx, def_idx) AS i, greatest(use_idx, def_idx) AS j, max(sqrt(n)) AS w FROM used JOIN defs USING (name) WHERE use_path <> def_path GROUP BY ALL)"""
FILES = "files AS MATERIALIZED (SELECT least(c.path, t.path) AS a, greatest(c.path, t.path) AS b FROM chunks c JOIN chunks t ON t.idx = c.idx - 200 AND t.source = c.source WHERE c.idx % 5 = 0)"
ADJ = """
both0 AS (SELECT i AS x, j AS y, w::DOUBLE AS w FROM refs UNION ALL SELECT h1.idx, h2.idx, 1.0::DOUBLE FROM files JOIN chunks h1 ON h1.path = a JOIN chunks h2 ON h2.path = b),
sums AS (SELECT src, dst, sum(w) AS w FROM (SELECT x AS src, y AS dst, w FROM both0 UNION ALL SELECT y, x, w FROM both0) GROUP BY ALL),
adj AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM sums),
node AS MATERIALIZED (SELECT idx, coalesce(cnt, 1) AS cnt FROM chunks LEFT JOIN (SELECT src AS idx, count(*) AS cnt FROM adj GROUP BY 1) USING (idx))"""
_G = f"WITH RECURSIVE {S.SQL}, {REFS}, {FILES} "
_A = f"WITH RECURSIVE {S.SQL}, {REFS}, {FILES}, {ADJ} "
#: With the links of every document.
_A_ALL = _A.replace(" WHERE c.idx % 5 = 0)", ")")


def ppr_sql(blocked: str | None, value: str, seeds: str) -> str:
    """pr(qid, idx, score, pos) by 30 aggregating recursive steps. seeds: a query of qid, idx, score."""
    stop = f"(SELECT idx FROM {blocked})" if blocked else "(SELECT idx FROM chunks WHERE false)"
    return f"""
sds AS MATERIALIZED ({seeds}),
tele AS MATERIALIZED (SELECT qid, idx, greatest(score, 1e-9) / sum(greatest(score, 1e-9)) OVER (PARTITION BY qid) AS p FROM sds),
pis AS (SELECT 0 AS k, qid, idx, p AS pi FROM tele UNION ALL
  SELECT k + 1, qid, idx, sum(pi) FROM (
    SELECT s.k, s.qid, adj.dst AS idx, 0.85 * s.pi * adj.w AS pi FROM pis s JOIN adj ON adj.src = s.idx WHERE s.k < 30 AND s.idx NOT IN {stop}
    UNION ALL SELECT h.k, h.qid, t.idx, 0.85 * h.pi * t.p FROM pis h JOIN tele t ON t.qid = h.qid WHERE h.k < 30 AND h.idx IN {stop}
    UNION ALL SELECT ks.k, t.qid, t.idx, 0.15 * t.p FROM tele t JOIN (SELECT DISTINCT k, qid FROM pis WHERE k < 30) ks ON ks.qid = t.qid) GROUP BY ALL),
pr AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) - 1)::INT AS pos FROM (SELECT qid, idx, round({value} + coalesce(1e-12 * s.score / CASE WHEN most > 0 THEN most ELSE 1 END, 0), 12) AS score
  FROM pis LEFT JOIN sds s USING (qid, idx) JOIN (SELECT qid, max(score) AS most FROM sds GROUP BY qid) USING (qid) JOIN node USING (idx) WHERE k = 30))"""


_BM_SEEDS = "SELECT qid, idx, score FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) <= 50"
_HUB = "hub AS MATERIALIZED (SELECT idx, cnt FROM node WHERE cnt >= greatest(50.0, (SELECT quantile_cont(cnt, 0.99) FROM node)))"
_HUB5 = _HUB.replace("50.0", "5.0").replace("hub AS", "hub5 AS")
_TOP = " SELECT qid, idx, pos, round(score, 6) AS score FROM pr WHERE pos < 20"
_FG = """
bothu AS (SELECT CASE WHEN u.path < v.path THEN u.path ELSE v.path END AS a, CASE WHEN u.path < v.path THEN v.path ELSE u.path END AS b, CASE WHEN u.path < v.path THEN u.text ELSE v.text END AS ta,
  CASE WHEN u.path < v.path THEN u.symbol ELSE v.symbol END AS sa, CASE WHEN u.path < v.path THEN v.symbol ELSE u.symbol END AS sb FROM refs JOIN chunks u ON u.idx = i JOIN chunks v ON v.idx = j),
viad AS (SELECT a, b, CASE WHEN sb <> '' AND contains(ta, sb) THEN sb ELSE sa END AS via FROM bothu),
usedf AS (SELECT a, b, count(*) AS refs, max(via) AS via FROM viad WHERE NOT (regexp_full_match(via, '[\\p{L}]+') AND via = lower(via)) GROUP BY ALL),
fe AS MATERIALIZED (SELECT a, b, coalesce(imp, false) AS imports, coalesce(refs, 0) AS refs, coalesce(via, '') AS via, CASE WHEN coalesce(imp, false) THEN 2.0 ELSE 0.0 END::DOUBLE + coalesce(refs, 0) AS weight FROM (SELECT a, b, true AS imp FROM files) FULL JOIN usedf USING (a, b)),
ways AS (SELECT DISTINCT * FROM (SELECT a AS src, b AS dst FROM fe UNION ALL SELECT b, a FROM fe)),
deg AS MATERIALIZED (SELECT path, kind, coalesce(n, 0) AS degree FROM chunks LEFT JOIN (SELECT src AS path, count(*) AS n FROM ways GROUP BY 1) USING (path)),
hubf AS MATERIALIZED (SELECT path, degree FROM deg WHERE kind = 'code' ORDER BY degree DESC, path LIMIT 15)""".replace("\\\\", "\\")
_E = f"WITH RECURSIVE {S.SQL}, {REFS}, {FILES}, {_FG} "

ORACLE_SQL = {
    "ref_edges_cap": _G + "SELECT i, j, round(w, 6) AS w FROM refs",
    "ref_edges_long": f"WITH {S.SQL}, {REFS}" + """, nf AS (SELECT name, count(DISTINCT def_path) AS files FROM defs GROUP BY name)
SELECT least(use_idx, def_idx) AS i, greatest(use_idx, def_idx) AS j, round(max(CASE WHEN length(name) >= 8 AND (contains(trim(name, '_'), '_') OR regexp_matches(name, '[a-z0-9][A-Z]')) THEN 10.0 ELSE 1.0 END * CASE WHEN starts_with(name, '_') THEN 0.1 ELSE 1.0 END * CASE WHEN files > 5 THEN 0.1 ELSE 1.0 END * sqrt(n)), 6) AS w
FROM used0 JOIN defs USING (name) JOIN nf USING (name) WHERE use_path <> def_path GROUP BY ALL""",
    "link_edges": r"""WITH t AS (SELECT DISTINCT 'site/' || page_id || '.html' AS path, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS target FROM pages),
w AS (SELECT path, target, CASE WHEN starts_with(target, '/') THEN target ELSE 'site/' || target END AS w FROM t WHERE NOT regexp_matches(target, '^(package:|dart:|http:|https:|mailto:|@)')),
files AS (SELECT 'site/' || page_id || '.html' AS f FROM pages UNION SELECT target FROM t WHERE length(target) % 2 = 0)
SELECT DISTINCT least(path, w) AS a, greatest(path, w) AS b FROM w WHERE w IN (SELECT f FROM files) AND path <> w""",
    "file_edges": _G + "SELECT * FROM files",
    "neighbours": _G + ", n AS (SELECT DISTINCT * FROM (SELECT i AS idx, j AS other FROM refs UNION ALL SELECT j, i FROM refs UNION ALL SELECT x.idx, y.idx FROM files JOIN chunks x ON x.path = a JOIN chunks y ON y.path = b UNION ALL SELECT y.idx, x.idx FROM files JOIN chunks x ON x.path = a JOIN chunks y ON y.path = b) WHERE idx <> other) SELECT idx, count(*) AS n, sum(other)::BIGINT AS total FROM n GROUP BY idx",
    "adjacency": _A + "SELECT src, dst, round(w, 6) AS w FROM adj",
    "hub_nodes": _A + f", {_HUB} SELECT * FROM hub",
    "ppr_topk": f"{_A_ALL}, {S.bm25_sql()}, {ppr_sql(None, 'pi', _BM_SEEDS)}" + _TOP,
    "ppr_transit_block": f"{_A}, {S.bm25_sql()}, {_HUB5}, {ppr_sql('hub5', 'pi', _BM_SEEDS)}" + _TOP,
    "ppr_beta": f"{_A}, {S.bm25_sql()}, {ppr_sql(None, 'pi / pow(cnt::DOUBLE, 0.5)', _BM_SEEDS)}" + _TOP,
    "file_graph": _E + "SELECT a, b, imports, refs, via, weight FROM fe",
    "file_nodes": _G + "SELECT path, kind, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, symbol AS symbols FROM chunks",
    "hubs": _E + "SELECT * FROM hubf",
    "undocumented_hubs": _E + "SELECT path, degree FROM hubf WHERE NOT EXISTS (SELECT 1 FROM ways JOIN chunks c ON c.path = dst WHERE src = hubf.path AND c.kind <> 'code')",
    "cross_links": _E + "SELECT a, b, weight, via FROM fe JOIN chunks x ON x.path = a JOIN chunks y ON y.path = b WHERE x.kind = 'code' AND y.kind = 'code' AND split_part(a, '/', 1) <> split_part(b, '/', 1) ORDER BY weight DESC, a, b LIMIT 15",
    "explain_users": _G + ", asked AS (SELECT DISTINCT name FROM defs WHERE def_idx % 50 = 0), us AS (SELECT u.name, use_path, sum(n) AS n FROM used0 u JOIN asked USING (name) JOIN (SELECT DISTINCT name, def_path FROM defs) d ON d.name = u.name WHERE use_path <> def_path GROUP BY ALL), ur AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, use_path) AS r FROM us) SELECT name, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT def_path AS p FROM defs WHERE defs.name = asked.name)) AS sites, (SELECT count(*) FROM us WHERE us.name = asked.name) AS n_users, coalesce((SELECT string_agg(use_path, ',' ORDER BY r) FROM ur WHERE ur.name = asked.name AND r <= 12), '') AS users FROM asked",
    "resolve_name": _G + r""", names AS (SELECT DISTINCT name FROM (SELECT unnest([path, symbol, upper(symbol), idx || '.txt', '_' || idx, 'C' || substr(path, 3, 5)]) AS name FROM chunks WHERE idx % 50 = 0) WHERE name <> ''),
f AS (SELECT path AS p, regexp_extract(path, '([^/]*)$', 1) AS base, replace(lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')), '_', '') AS stem FROM chunks),
r AS (SELECT name, 1 AS prio, p FROM names JOIN f ON name = p UNION SELECT n.name, 2, def_path FROM names n JOIN defs d ON n.name = d.name UNION SELECT n.name, 3, def_path FROM names n JOIN defs d ON lower(n.name) = lower(d.name)
UNION SELECT name, 4, p FROM names JOIN f ON p = name OR ends_with(p, '/' || name) UNION SELECT name, 5, p FROM names JOIN f ON replace(lower(name), '_', '') = stem UNION SELECT name, 6, p FROM names JOIN f ON contains(lower(p), lower(name))),
b AS (SELECT *, min(prio) OVER (PARTITION BY name) AS best FROM r), k AS (SELECT name, prio, p AS path, row_number() OVER (PARTITION BY name ORDER BY p) AS n FROM b WHERE prio = best) SELECT name, prio, path FROM k WHERE prio < 6 OR n <= 10""",
    "shortest_path": _E + ", bfs AS (SELECT path AS root, path AS cur, 0 AS hops FROM chunks WHERE idx % 50 = 0 UNION SELECT root, dst, hops + 1 FROM bfs JOIN ways ON src = cur WHERE hops < 40) SELECT root AS src, cur AS dst, min(hops) AS hops FROM bfs GROUP BY ALL",
    "search_code": _F.rstrip() + f""", {REFS}, both0 AS (SELECT i AS x, j AS y, w::DOUBLE AS w FROM refs),
sums AS (SELECT src, dst, sum(w) AS w FROM (SELECT x AS src, y AS dst, w FROM both0 UNION ALL SELECT y, x, w FROM both0) GROUP BY ALL), adj AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM sums),
node AS MATERIALIZED (SELECT idx, coalesce(cnt, 1) AS cnt FROM chunks LEFT JOIN (SELECT src AS idx, count(*) AS cnt FROM adj GROUP BY 1) USING (idx)), {_HUB}, {SEED_SQL}, {ppr_sql('hub', 'pi', 'SELECT qid, idx, f.score FROM seeds JOIN fused f USING (qid, idx)')},
cd AS (SELECT qid, idx, pos FROM pr JOIN chunks USING (idx) WHERE is_code), {fold_sql('pk', 'cd', '6000')} SELECT * FROM pk""".replace(S.bm25_sql(), S.bm25_sql(True)),
}
ORACLE_SQL["search_code"] = ORACLE_SQL["search_code"].replace(S.bm25_sql(), S.bm25_sql(True))
