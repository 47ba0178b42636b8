"""Queries on evaluation, commit history and the event journal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.operators import events as V
from quarry.operators import history as H
from quarry.operators import ranking as R
from quarry.plans import standin as S
from quarry.plans.search_queries import _F, _by_vector, _lexical, fold_sql
from quarry.streaming import journal as J

# ---------------------------------------------------------------- evaluation


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark text whole."""
    c = S.chunks(spark, d).select("idx", "path", "text")
    return S.queries(spark, d).join(c, F.contains("text", "query")).select("qid", "path", "idx")


def recall_at_budget(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    picked = R.select_budget(_lexical(spark, d), c, 8000).join(c.select("idx", "path"), "idx")
    return E.recall(picked, _gold(spark, d), ["path"]).select("qid", F.round("recall", 6).alias("recall"))


def _case_scores(spark: SparkSession, d: str) -> DataFrame:
    """Long table cell, method, case_id, score: recall of files at 1, 5 and 10 by both rankings."""
    c, gold = S.chunks(spark, d), _gold(spark, d)
    out = None
    for method, ranking in (("lexical", _lexical(spark, d)), ("dense", _by_vector(spark, d))):
        first = R.first_per_path(ranking, c, 10)
        for k in (1, 5, 10):
            s = E.recall(first.where(F.col("pos") < k), gold, ["path"]).select(F.lit(f"files@{k}").alias("cell"), F.lit(method).alias("method"), F.col("qid").alias("case_id"), F.col("recall").alias("score"))
            out = s if out is None else out.unionByName(s)
    return out


def recall_files_k(spark: SparkSession, d: str) -> DataFrame:
    return _case_scores(spark, d).groupBy("cell", "method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("recall"))


def oracle_max(spark: SparkSession, d: str) -> DataFrame:
    return E.best_of(_case_scores(spark, d)).select("cell", "case_id", F.round("score", 6).alias("score"))


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    c = E.compare(_case_scores(spark, d), "lexical", "dense")
    return c.select("cell", "n", *[F.round(x, 6).alias(x) for x in ("a", "b", "diff")], "wins", "losses")


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Mean balance of all customers, each as a case, with its interval."""
    o = S.table(spark, d, "customer").select(F.col("c_custkey").alias("num"), (F.col("c_acctbal") / 1000).alias("diff"))
    return E.bootstrap(o, 500).select("n", *[F.round(x, 6).alias(x) for x in ("mean", "lo", "hi")])


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    v = E.latencies(S.table(spark, d, "events"), "value", ["event_type"])
    return v.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def _judged(e: DataFrame) -> DataFrame:
    answer = F.concat(F.lit('{"is_error": '), F.when(F.col("event_id") % 70 == 0, "true").otherwise("false"), F.lit(', "structured_output": {"scores": [{"id": 0, "score": 1.7}, {"id": 2, "score": '), (F.col("event_id") % 9 / 10).cast("string"), F.lit("}]}}"))
    return E.judge_scores(e.select(F.col("event_id").alias("qid"), answer.alias("answer")), 4)


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an answer."""
    return _judged(S.table(spark, d, "events"))


def pointer_channel(spark: SparkSession, d: str) -> DataFrame:
    """3 pointers at 200 tokens each leave the rest of the budget to chunks."""
    c = S.chunks(spark, d)
    return R.select_budget(_lexical(spark, d), c, 6000 - 3 * 200).select("qid", "idx", "pos")


# ---------------------------------------------------------------- history


def _commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits: ts, subject, files (line parts)."""
    lines = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.when(x["l_partkey"] % 10 == 0, "docs/adr/").otherwise("src/"), (x["l_partkey"] % 300).cast("string"), F.when(x["l_partkey"] % 10 == 0, ".md").otherwise(".py"))).alias("files"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("part"))
    part = S.table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_type")
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("cid"), F.col("o_orderdate").alias("ts"), "o_orderstatus", "o_orderpriority")
    text = F.concat_ws(" ", "p_name", "p_type", F.lit("for"), "o_orderpriority", F.concat(F.lit("n"), (F.col("cid") % 300).cast("string")))
    k = F.col("cid") % 5
    subject = F.when(k == 0, F.concat(F.lit("feat("), "o_orderstatus", F.lit("): "), text, F.lit(" (#12)"))).when(k == 1, F.concat(F.lit("Fix: "), text)).when(k == 2, F.concat(F.lit("docs: ADR-7 - "), text)).when(k == 3, F.concat(F.lit("release "), text)).otherwise(text)
    return o.join(lines, "cid").join(part, "part").select("cid", "ts", subject.alias("subject"), "files", F.md5(F.col("cid").cast("string")).alias("sha"), F.col("cid").alias("ord"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "part").where("p_partkey < 300").select("p_partkey")
    return n.select(F.explode(F.array(F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".py")), F.concat(F.lit("docs/adr/"), F.col("p_partkey").cast("string"), F.lit(".md")))).alias("path")).where(~F.col("path").like("%7.%"))


def case_mining(spark: SparkSession, d: str) -> DataFrame:
    c = H.mine_cases(_commits(spark, d), _known(spark, d))
    return c.select("id", "query", F.array_join("gold", ",").alias("gold"))


def decision_mining(spark: SparkSession, d: str) -> DataFrame:
    c = H.mine_decisions(_commits(spark, d), _known(spark, d))
    return c.select("id", "query", F.array_join("gold", ",").alias("gold"))


def _past(spark: SparkSession, d: str, asked: str) -> DataFrame:
    c = _commits(spark, d)
    cases = c.where(asked).select(F.col("cid").alias("qid"), "ts", F.col("subject").alias("query"))
    return H.past_commits(cases, c.select("cid", "ts", "subject", "files"), _known(spark, d)).select("qid", "path", F.round("score", 6).alias("score"))


def past_commits(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: ids divisible by 50."""
    return _past(spark, d, "cid % 50 = 0")


def digest_latest(spark: SparkSession, d: str) -> DataFrame:
    present = _known(spark, d).withColumn("summary", F.concat(F.lit("about "), "path"))
    return H.digest(_commits(spark, d), present)


# ---------------------------------------------------------------- events

_EVENT = {"signup": "start", "error": "build_failed", "purchase": "ready"}


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    kind = F.lit("call")
    for a, b in _EVENT.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    return e.select("event_id", "ts", F.col("user_id").alias("root"), kind.alias("event"), "value")


def status_summary(spark: SparkSession, d: str) -> DataFrame:
    s = V.status(_events(spark, d))
    return s.select("root", "start", "starts", "failures", "calls", "errors", F.array_join(F.transform("last_errors", lambda x: x.cast("string")), ",").alias("last_errors"))


def last_event_per_key(spark: SparkSession, d: str) -> DataFrame:
    return V.last_event(_events(spark, d).select("root", "event", "ts", "event_id"), ["root", "event"], ["ts", "event_id"])


def last_build_failed(spark: SparkSession, d: str) -> DataFrame:
    b = V.last_event(_events(spark, d).where("event IN ('ready', 'build_failed')").select("root", "ts", "event_id", "event"), ["root"], ["ts", "event_id"])
    return b.where("event = 'build_failed'").select("root", "ts")


def asof_last_start(spark: SparkSession, d: str) -> DataFrame:
    return V.since_last_start(_events(spark, d)).select("event_id", "started", "number")


def quiet_gaps(spark: SparkSession, d: str) -> DataFrame:
    return V.gaps(_events(spark, d), "root", 600).select("event_id", "before")


def throttled_hint(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return V.throttled(e.where("event = 'call'"), "root", e.where("event = 'ready'"), 300, 1440)


def usage_attribution(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations")
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    calls = c.where("role = 'user'").select(F.col("conv_id").alias("session"), F.col("turn").alias("call"), F.col("turn").alias("n"), words.alias("shown"))
    edits = c.where("role = 'assistant'").select(F.col("conv_id").alias("session"), F.col("turn").alias("n"), F.explode(words).alias("path"))
    u = V.usage(calls, edits)
    return u.select("session", "call", F.array_join("shown", " ").alias("shown"), F.array_join("used", " ").alias("used"))


def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return V.idle_sessions(_events(spark, d), "root", 600)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return V.windows(_events(spark, d), "1 day", keys=("event",))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return V.windows(_events(spark, d), "2 days", "1 day")


def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("p.k").alias("n"))


def _stream(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its result table."""
    name = f"stream_{uuid.uuid4().hex}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    schema = S.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    w = J.event_windows(events, "1 day", keys=("event_type",))
    return _stream(spark, w, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_throttled(spark: SparkSession, d: str) -> DataFrame:
    schema = S.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).where("event_type = 'click'")
    return _stream(spark, J.throttled(events, "user_id", 1440), "append")


QUERIES = {
    f.__name__: f
    for f in (recall_at_budget, recall_files_k, oracle_max, compare_runs, bootstrap_ci, latency_percentiles, judge_scores, pointer_channel, case_mining, decision_mining, past_commits, digest_latest)
    + (status_summary, last_event_per_key, last_build_failed, asof_last_start, quiet_gaps, throttled_hint, usage_attribution, idle_sessions, event_windows, sliding_windows, json_props, stream_event_windows, stream_throttled)
}

_GOLD = "gold AS MATERIALIZED (SELECT qid, path, idx FROM queries, chunks WHERE contains(text, query))"
_CS = f"""{_GOLD},
fl AS (SELECT qid, path, pos, 'lexical' AS method FROM lexr JOIN chunks USING (idx) UNION ALL SELECT qid, path, pos, 'dense' FROM denr JOIN chunks USING (idx)),
cs AS MATERIALIZED (SELECT 'files@' || k AS cell, m.method, g.qid AS case_id, avg(CASE WHEN fl.pos < k THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM (SELECT DISTINCT qid, path FROM gold) g, (SELECT unnest([1, 5, 10]) AS k), (SELECT unnest(['lexical', 'dense']) AS method) m JOIN fl ON fl.method = m.method AND fl.qid = g.qid AND fl.path = g.path GROUP BY ALL)"""
_EV = "ev AS (SELECT event_id, ts, user_id AS root, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'build_failed' WHEN 'purchase' THEN 'ready' ELSE 'call' END AS event, value FROM events)"
_CM = """ln AS (SELECT l_orderkey AS cid, list(CASE WHEN l_partkey % 10 = 0 THEN 'docs/adr/' || (l_partkey % 300) || '.md' ELSE 'src/' || (l_partkey % 300) || '.py' END ORDER BY l_linenumber, l_partkey) AS files, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1),
cm AS MATERIALIZED (SELECT o_orderkey AS cid, o_orderdate AS ts, o_orderstatus, p_name || ' ' || p_type || ' for ' || o_orderpriority || ' n' || (o_orderkey % 300) AS txt, files, md5(o_orderkey::VARCHAR) AS sha FROM orders JOIN ln ON cid = o_orderkey JOIN part ON p_partkey = part),
known AS (SELECT p FROM (SELECT unnest(['src/' || p_partkey || '.py', 'docs/adr/' || p_partkey || '.md']) AS p FROM part WHERE p_partkey < 300) WHERE p NOT LIKE '%7.%'),
commits AS MATERIALIZED (SELECT *, CASE cid % 5 WHEN 0 THEN 'feat(' || o_orderstatus || '): ' || txt || ' (#12)' WHEN 1 THEN 'Fix: ' || txt WHEN 2 THEN 'docs: ADR-7 - ' || txt WHEN 3 THEN 'release ' || txt ELSE txt END AS subject FROM cm)"""


def _mined(where: str, query: str, prefix: str, most: int) -> str:
    return f"""WITH {_CM}, c AS (SELECT *, {query} AS query FROM commits WHERE {where}),
g AS (SELECT cid, list(f ORDER BY i) AS gold FROM (SELECT cid, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM c) WHERE f IN (SELECT p FROM known) AND f LIKE '{'src' if prefix == 'git-' else 'docs/adr'}/%' GROUP BY 1 HAVING count(*) BETWEEN 1 AND {most}),
r AS (SELECT c.*, gold, row_number() OVER (PARTITION BY lower(query) ORDER BY cid) AS n FROM c JOIN g USING (cid)) SELECT '{prefix}' || substr(sha, 1, 8) AS id, query, array_to_string(gold, ',') AS gold FROM r WHERE n = 1 ORDER BY cid LIMIT 80"""


ORACLE_SQL = {
    "recall_at_budget": _F + f", {_GOLD}, {fold_sql('pk', 'lexr', '8000')} SELECT g.qid, round(avg(CASE WHEN pk.idx IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM gold g LEFT JOIN pk USING (qid, idx) GROUP BY g.qid",
    "recall_files_k": _F + f", {_CS} SELECT cell, method, count(*) AS n, round(avg(score), 6) AS recall FROM cs GROUP BY ALL",
    "oracle_max": _F + f", {_CS} SELECT cell, case_id, round(max(score), 6) AS score FROM cs GROUP BY ALL",
    "compare_runs": _F + f", {_CS} SELECT x.cell, count(*) AS n, round(avg(x.score), 6) AS a, round(avg(y.score), 6) AS b, round(avg(x.score - y.score), 6) AS diff, count(*) FILTER (x.score > y.score) AS wins, count(*) FILTER (x.score < y.score) AS losses FROM cs x JOIN cs y ON x.cell = y.cell AND x.case_id = y.case_id AND x.method = 'lexical' AND y.method = 'dense' GROUP BY x.cell",
    "bootstrap_ci": """WITH c AS (SELECT c_custkey AS num, c_acctbal / 1000 AS diff FROM customer), n AS (SELECT count(*) AS n, avg(diff) AS mean FROM c),
dr AS (SELECT r, ('0x' || substr(md5(r || ':' || num), 1, 8))::BIGINT % n AS pick FROM c, n, (SELECT unnest(range(500)) AS r)), m AS (SELECT r, avg(diff) AS m FROM dr JOIN c ON c.num = pick GROUP BY r)
SELECT n, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM n, m GROUP BY n, mean""",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "judge_scores": "SELECT event_id AS qid, id::INT AS id, CASE WHEN event_id % 70 = 0 THEN 0.0 WHEN id = 0 THEN 1.0 WHEN id = 2 THEN (event_id % 9) / 10.0 ELSE 0.0 END::DOUBLE AS score FROM events, (SELECT unnest(range(4)) AS id)",
    "pointer_channel": _F + f", {fold_sql('pk', 'lexr', '5400')} SELECT qid, idx, pos FROM pk",
    "case_mining": _mined("cid % 5 IN (0, 1)", "CASE WHEN cid % 5 = 0 THEN o_orderstatus || ': ' || txt ELSE txt END", "git-", 4),
    "decision_mining": _mined("cid % 5 <> 3", "CASE WHEN cid % 5 = 0 THEN o_orderstatus || ': ' || txt ELSE txt END", "dec-", 2),
    "past_commits": f"""WITH {_CM}, ca AS (SELECT cid AS qid, ts, subject AS query FROM commits WHERE cid % 50 = 0), dt AS MATERIALIZED (SELECT cid, ts AS cts, {S.tokens_sql('subject')} AS toks, files FROM commits),
te AS (SELECT DISTINCT qid, ts, unnest({S.tokens_sql('query')}) AS term FROM ca), tf AS (SELECT cid, cts, len, term, count(*) AS f FROM (SELECT cid, cts, len(toks) AS len, unnest(toks) AS term FROM dt) GROUP BY ALL),
st AS (SELECT qid, count(*) AS n, avg(len(toks)) AS avg_len FROM ca JOIN dt ON cts < ts GROUP BY qid), me AS (SELECT te.qid, tf.*, count(*) OVER (PARTITION BY te.qid, term) AS df FROM te JOIN tf USING (term) WHERE cts < ts),
sc AS (SELECT qid, cid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) AS score FROM me JOIN st USING (qid) GROUP BY ALL),
tp AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) <= 20) SELECT qid, path, round(sum(s), 6) AS score FROM (SELECT qid, score / len(files) AS s, unnest(files) AS path FROM tp JOIN dt USING (cid)) WHERE path IN (SELECT p FROM known) GROUP BY ALL""",
    "digest_latest": f"WITH {_CM}, x AS (SELECT cid, strftime(ts, '%Y-%m-%d') AS day, unnest(files) AS path, generate_subscripts(files, 1) AS i FROM commits WHERE cid < 200), f AS (SELECT path, arg_min(day, (cid, i)) AS day, min((cid, i)) AS k FROM x WHERE path LIKE 'docs/adr/%' AND path IN (SELECT p FROM known) GROUP BY path) SELECT path, day, substr('about ' || path, 1, 160) AS summary FROM f ORDER BY k LIMIT 5",
    "status_summary": f"WITH {_EV}, s AS (SELECT root, max(CASE WHEN event = 'start' THEN ts END) AS start, count(*) FILTER (event = 'start') AS starts, count(*) FILTER (event = 'build_failed') AS failures FROM ev GROUP BY root), n AS (SELECT ev.* FROM ev JOIN s USING (root) WHERE ts >= start AND event <> 'start') SELECT root, start, starts, failures, (SELECT count(*) FROM n WHERE n.root = s.root AND event = 'call') AS calls, (SELECT count(*) FROM n WHERE n.root = s.root AND event = 'build_failed') AS errors, coalesce((SELECT string_agg(event_id, ',' ORDER BY r) FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts DESC, event_id DESC) AS r FROM n WHERE event = 'build_failed') e WHERE e.root = s.root AND r <= 3), '') AS last_errors FROM s",
    "last_event_per_key": f"WITH {_EV} SELECT root, event, ts, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY root, event ORDER BY ts DESC, event_id DESC) = 1",
    "last_build_failed": f"WITH {_EV}, b AS (SELECT * FROM ev WHERE event IN ('ready', 'build_failed') QUALIFY row_number() OVER (PARTITION BY root ORDER BY ts DESC, event_id DESC) = 1) SELECT root, ts FROM b WHERE event = 'build_failed'",
    "asof_last_start": f"WITH {_EV}, s AS (SELECT *, max(CASE WHEN event = 'start' THEN ts END) OVER w AS started, count(*) FILTER (event = 'start') OVER w AS run FROM ev WINDOW w AS (PARTITION BY root ORDER BY ts, event_id)) SELECT event_id, started, row_number() OVER (PARTITION BY root, run ORDER BY ts, event_id)::INT AS number FROM s",
    "quiet_gaps": f"WITH {_EV}, g AS (SELECT *, lag(ts) OVER (PARTITION BY root ORDER BY ts, event_id) AS before FROM ev) SELECT event_id, before FROM g WHERE before IS NULL OR ts >= before + INTERVAL 600 MINUTE",
    "throttled_hint": f"""WITH RECURSIVE {_EV}, p AS MATERIALIZED (SELECT root, ts, event_id, row_number() OVER (PARTITION BY root ORDER BY ts, event_id) AS n FROM ev e WHERE event = 'call' AND NOT EXISTS (SELECT 1 FROM ev q WHERE q.root = e.root AND q.event = 'ready' AND q.ts <= e.ts AND e.ts < q.ts + INTERVAL 300 MINUTE)),
f AS (SELECT root, 0::BIGINT AS n, NULL::TIMESTAMP AS last, NULL::BIGINT AS id FROM (SELECT DISTINCT root FROM p) UNION ALL SELECT f.root, p.n, CASE WHEN last IS NULL OR p.ts >= last + INTERVAL 1440 MINUTE THEN p.ts ELSE last END, CASE WHEN last IS NULL OR p.ts >= last + INTERVAL 1440 MINUTE THEN p.event_id END FROM f JOIN p ON p.root = f.root AND p.n = f.n + 1)
SELECT root, id AS event_id FROM f WHERE id IS NOT NULL""",
    "usage_attribution": """WITH w AS (SELECT conv_id AS session, turn AS n, role, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS ws FROM conversations), c AS (SELECT session, n, unnest(ws) AS path, generate_subscripts(ws, 1) AS i FROM w WHERE role = 'user'),
s AS (SELECT session, n, path, min(i) AS i FROM c GROUP BY ALL), e AS (SELECT session, path, max(n) AS m FROM (SELECT session, n, unnest(ws) AS path FROM w WHERE role = 'assistant') GROUP BY ALL)
SELECT s.session, s.n AS call, string_agg(path, ' ' ORDER BY i) AS shown, coalesce(string_agg(path, ' ' ORDER BY i) FILTER (m > s.n), '') AS used FROM s LEFT JOIN e USING (session, path) GROUP BY s.session, s.n""",
    "idle_sessions": f"WITH {_EV}, g AS (SELECT *, lag(ts) OVER (PARTITION BY root ORDER BY ts, event_id) AS b FROM ev), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 600 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY ts, event_id) AS s FROM g) SELECT root, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY root, s",
    "event_windows": f"WITH {_EV} SELECT date_trunc('day', ts)::TIMESTAMP AS start, event, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL",
    "sliding_windows": f"WITH {_EV}, w AS (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start, value FROM ev) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL",
    "stream_event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_throttled": """WITH RECURSIVE p AS MATERIALIZED (SELECT user_id AS key, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
f AS (SELECT key, 0::BIGINT AS n, NULL::TIMESTAMP AS last, NULL::BIGINT AS id FROM (SELECT DISTINCT key FROM p) UNION ALL SELECT f.key, p.n, CASE WHEN last IS NULL OR p.ts >= last + INTERVAL 1440 MINUTE THEN p.ts ELSE last END, CASE WHEN last IS NULL OR p.ts >= last + INTERVAL 1440 MINUTE THEN p.event_id END FROM f JOIN p ON p.key = f.key AND p.n = f.n + 1)
SELECT key, id AS event_id FROM f WHERE id IS NOT NULL""",
    "json_props": "SELECT event_type, sum((props->>'k')::INT)::BIGINT AS total, count(props->>'k') AS n FROM events GROUP BY 1",
}
