"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.decontaminate import contamination
from quarry.llm.html import main_text
from quarry.llm.lines import dedup_lines
from quarry.llm.neardup import near_duplicates
from quarry.llm.packing import pack_documents
from quarry.llm.quality import quality_scores
from quarry.llm.substrings import dedup_substrings
from quarry.llm.tokens import token_counts
from quarry.llm.toxicity import toxicity_scores
from quarry.llm.vectors import vector_links


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"), with_text=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_embedding_near_dedup, op3_token_counts, op4_quality, op5_html_extraction, op6_substring_dedup, op7_toxicity, op8_line_dedup, op9_decontamination, op10_best_fit_packing)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Windows of n units u (one list a document), numbered from 1: win(doc_id, i, w); later: those whose sequence also starts earlier.
_WINDOWS = """win AS (SELECT doc_id, i, array_to_string(u[i:i + {n} - 1], {sep}) AS w FROM (SELECT doc_id, u, unnest(range(1, len(u) - {n} + 2)) AS i FROM units WHERE len(u) >= {n})),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range({n})) AS k))"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS u FROM documents),
sh AS MATERIALIZED (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN len(u) >= 5 THEN list_transform(range(1, len(u) - 3), lambda i: array_to_string(u[i:i + 4], ' ')) WHEN len(u) > 0 THEN [array_to_string(u, ' ')] ELSE [] END) AS s FROM d) GROUP BY ALL),
sz AS MATERIALIZED (SELECT doc_id, sum(n) AS n FROM sh GROUP BY 1),
lk AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b USING (s) JOIN sz x ON x.doc_id = a.doc_id JOIN sz y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 9 * sum(least(a.n, b.n)) >= 4 * (max(x.n) + max(y.n))),
rc AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM rc JOIN lk ON a = node)
SELECT node AS doc_id, min(root) AS class_id, node = min(root) AS kept FROM rc GROUP BY node""",
    "op2_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS MATERIALIZED (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(e) > 0 AND list_inner_product(e, e) > 0),
lk AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
rc AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT b, root FROM rc JOIN lk ON a = node)
SELECT node AS vec_id, (SELECT count(*) FROM lk WHERE a = node) AS n_links, min(root) AS component_id, node = min(root) AS kept FROM rc GROUP BY node""",
    "op6_substring_dedup": f"""WITH units AS MATERIALIZED (SELECT doc_id, {_WORDS} AS u FROM documents), {_WINDOWS.format(n=20, sep="' '")},
g AS (SELECT doc_id, list(i) AS x FROM gone GROUP BY 1)
SELECT doc_id, len(u) AS n_words, coalesce(len(x), 0) AS n_removed, sha256(array_to_string(CASE WHEN x IS NULL THEN u ELSE list_filter(u, lambda w, i: NOT list_contains(x, i)) END, ' ')) AS kept_sha256 FROM units LEFT JOIN g USING (doc_id)""",
    "op8_line_dedup": r"""WITH ln AS MATERIALIZED (SELECT doc_id, j, l, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents)),
nb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i FROM ln WHERE t <> ''),
units AS MATERIALIZED (SELECT doc_id, list(t ORDER BY i) AS u FROM nb GROUP BY 1),
win AS (SELECT doc_id, n, i, array_to_string(u[i:i + n - 1], chr(10)) AS w FROM (SELECT doc_id, n, u, unnest(range(1, len(u) - n + 2)) AS i FROM units, (SELECT unnest([1, 2, 3]) AS n) WHERE len(u) >= n)),
later AS (SELECT doc_id, n, i, w FROM (SELECT *, row_number() OVER (PARTITION BY n, w ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later WHERE n = 3 OR len(regexp_extract_all(w, '[^\x20\x09-\x0D]+')) >= 20),
dr AS (SELECT doc_id, j FROM nb JOIN gone USING (doc_id, i)), kp AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY j) AS t FROM ln WHERE (doc_id, j) NOT IN (SELECT doc_id, j FROM dr) GROUP BY 1)
SELECT doc_id, (SELECT count(*) FROM nb WHERE nb.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM dr WHERE dr.doc_id = d.doc_id) AS n_removed, CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS text FROM documents d LEFT JOIN kp USING (doc_id)""",
    "op9_decontamination": r"""WITH du AS MATERIALIZED (SELECT doc_id, regexp_extract_all(ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS u FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ascii FROM documents)),
bu AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS u FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item, least(13, len(u)) AS n, array_to_string(u[i:i + least(13, len(u)) - 1], ' ') AS w FROM (SELECT item, u, unnest(range(1, len(u) - least(13, len(u)) + 2)) AS i FROM bu WHERE len(u) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(u[i:i + n - 1], ' ') AS w FROM (SELECT doc_id, u, n, unnest(range(1, len(u) - n + 2)) AS i FROM du, sizes WHERE len(u) >= n)),
ht AS MATERIALIZED (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON bw.w = dw.w AND bw.n = dw.n),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM ht) GROUP BY 1),
wt AS MATERIALIZED (SELECT w, n, unnest(list_distinct(string_split(w, ' '))) AS t FROM (SELECT DISTINCT w, n FROM bw)),
wk AS MATERIALIZED (SELECT w, n, count(*) AS k FROM wt GROUP BY 1, 2),
wo AS MATERIALIZED (SELECT doc_id, unnest(u) AS t, generate_subscripts(u, 1) AS p FROM du),
dt AS (SELECT DISTINCT doc_id, t FROM wo),
cand AS MATERIALIZED (SELECT doc_id, w, n, k FROM dt JOIN wt USING (t) JOIN wk USING (w, n) GROUP BY 1, 2, 3, 4 HAVING count(*) = k),
nr AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, w, k, count(DISTINCT t) OVER (PARTITION BY doc_id, w ORDER BY p RANGE BETWEEN CURRENT ROW AND n + 2 FOLLOWING) AS seen FROM cand JOIN wt USING (w, n) JOIN wo USING (doc_id, t)) WHERE seen = k),
ni AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM nr JOIN bw USING (w) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM ht) GROUP BY 1)
SELECT doc_id, len(u) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(u) AS contaminated, coalesce(n_near, 0) AS n_near FROM du LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ni USING (doc_id)""",
}
