"""Evaluation methods by name: each is a ranking (or a choice) for all cases in one plan.

Names: bm25, bm25n (no stopwords), dense, hybrid, expand, ppr, commits, oracle:<a>:<b>, only:code:<base>, only:dec:<base>, mix:<n>:<m>:<base>,
channel:<share>:<base>, gate:<k>:<share>:<base>, ptr:<k>:<cost>:<base>, rerank:<base>, ext:<name>. Options follow a question mark:
ppr?beta=0.5&block=1&qid=1&damping=0.85, hybrid?k=60, expand?anchors=10&each=3. A method that names a base builds it by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import evaluate, graph, history, lexical
from quarry.operators import ranking as R

BUDGETS, FILES_AT = (8000, 32_000), (1, 5, 10, 20)


def parse(name: str) -> tuple[str, list[str], dict[str, str]]:
    """Kind, arguments and options. A base keeps its own colons and options: only the leading arguments are cut off."""
    kind, _, rest = name.partition(":")
    count = {"only": 1, "mix": 2, "channel": 1, "gate": 2, "ptr": 2, "rerank": 0, "ext": 1, "oracle": 2}.get(kind.split("?")[0], 0)
    args = rest.split(":", count) if rest else []
    options: dict[str, str] = {}
    if "?" in kind:
        kind, _, text = kind.partition("?")
        options = dict(x.split("=", 1) for x in text.split("&") if "=" in x)
    return kind, args, options


@dataclass
class Methods:
    """The tables that methods are built from. gold (qid, path) is dropped from rankings for leave-one-out if drop_gold is set."""

    chunks: DataFrame
    queries: DataFrame
    dense_scores: DataFrame | None = None
    refs: DataFrame | None = None
    files: DataFrame | None = None
    commits: DataFrame | None = None
    rerank_scores: DataFrame | None = None
    external: dict[str, DataFrame] = field(default_factory=dict)
    gold: DataFrame | None = None
    drop_gold: bool = False
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def ranking(self, name: str) -> DataFrame:
        """qid, idx, pos of a ranking method."""
        if name not in self._made:
            made = self._build(name)
            self._made[name] = R.drop_gold(made, self.chunks, self.gold) if self.drop_gold and self.gold is not None else made
        return self._made[name]

    def _build(self, name: str) -> DataFrame:
        kind, args, options = parse(name)
        every = lambda s: R.rank_all(s, self.queries, self.chunks)
        if kind in ("bm25", "bm25n"):
            return every(lexical.bm25(self.chunks, self.queries, kind == "bm25n"))
        if kind == "dense":
            return every(self.dense_scores)
        if kind == "hybrid":
            return R.rrf(self.ranking("bm25"), self.ranking("dense"), k=int(options.get("k", R.RRF_K)))
        if kind == "expand":
            links = graph.neighbours(self.chunks, self.refs, self.files)
            return graph.expand(self.ranking("hybrid"), links, int(options.get("anchors", 10)), int(options.get("each", 3)))
        if kind == "ppr":
            seeds = self.ranking("hybrid").where(F.col("pos") < int(options.get("seeds", graph.SEEDS))).select("qid", "idx", "score")
            if options.get("qid") == "1":
                seeds = graph.named_seeds(self.queries, seeds, self.chunks)
            adj = graph.adjacency(self.chunks, self.refs, self.files if options.get("imports") == "1" else None, options.get("siblings") == "1")
            node = graph.nodes(self.chunks, adj)
            spread = graph.ppr(seeds, adj, graph.hubs(node) if options.get("block") == "1" else None, float(options.get("damping", graph.DAMPING)))
            top = graph.ppr_ranking(spread, seeds, node, float(options.get("beta", 0)))
            return R.rank_all(top.select("qid", "idx", "score"), self.queries, self.chunks)
        if kind == "commits":
            scores = history.past_commits(self.queries, self.commits, self.chunks)
            return history.channel_ranking(scores, self.chunks, self.ranking("hybrid"))
        if kind == "only":
            mask = self.chunks.where("is_code" if args[0] == "code" else "kind = 'decision'")
            return R.only(self.ranking(args[1] if len(args) > 1 else "hybrid"), mask)
        if kind == "mix":
            return R.interleave(self.ranking(args[2] if len(args) > 2 else "hybrid"), self.chunks, int(args[0]), int(args[1]))
        if kind == "rerank":
            return R.rerank_head(self.ranking(args[0] if args else "hybrid"), self.rerank_scores)
        if kind == "ext":
            r = self.external[args[0]].join(self.chunks.groupBy("path").agg(F.min("idx").alias("idx")), "path")
            return r.select("qid", "idx", "pos")
        raise ValueError(f"no ranking method {name!r}")

    def picked(self, name: str, budget: int) -> DataFrame:
        """qid, path, idx chosen under a token budget."""
        kind, args, _ = parse(name)
        place = self.chunks.select("idx", "path")
        if kind in ("channel", "gate"):
            base = args[-1] if len(args) > (1 if kind == "channel" else 2) else "hybrid"
            share = float(args[0] if kind == "channel" else args[1])
            main, side = self.ranking(base), self.ranking(f"only:dec:{base}")
            if kind == "gate":
                is_open = R.gate(self.ranking("hybrid"), self.chunks.where("kind = 'decision'"), int(args[0])).where("open").select("qid")
                side = side.join(is_open, "qid", "left_semi")
            chosen = R.select_channel(side, main, self.chunks, budget, share)
            return chosen.join(place, "idx").select("qid", "path", "idx")
        if kind == "ptr":
            k, cost, base = int(args[0]), int(args[1]), args[2] if len(args) > 2 else "hybrid"
            chosen = R.select_budget(self.ranking(base), self.chunks, max(0, budget - cost)).join(place, "idx").select("qid", "path", "idx")
            named = R.first_per_path(self.ranking("commits"), self.chunks, k).select("qid", "path", F.lit(None).cast("long").alias("idx"))
            return chosen.unionByName(named)
        return R.select_budget(self.ranking(name), self.chunks, budget).join(place, "idx").select("qid", "path", "idx")

    def per_case(self, names: list[str], budgets: tuple[int, ...] = BUDGETS, at: tuple[int, ...] = FILES_AT) -> DataFrame:
        """Long table cell, method, case_id, score: file recall under each budget, and among the first files."""
        out: DataFrame | None = None
        for name in names:
            kind, args, _ = parse(name)
            if kind == "oracle":
                continue
            parts = [(f"file@{b}", self.picked(name, b)) for b in budgets]
            if kind not in ("channel", "gate", "ptr"):
                first = R.first_per_path(self.ranking(name), self.chunks, max(at))
                parts += [(f"files@{k}", first.where(F.col("pos") < k)) for k in at]
            for cell, picked in parts:
                s = evaluate.recall(picked, self.gold, ["path"]).select(F.lit(cell).alias("cell"), F.lit(name).alias("method"), F.col("qid").alias("case_id"), F.col("recall").alias("score"))
                out = s if out is None else out.unionByName(s)
        for name in names:
            kind, args, _ = parse(name)
            if kind == "oracle":
                best = evaluate.best_of(out.where(F.col("method").isin(*args))).select("cell", F.lit(name).alias("method"), "case_id", "score")
                out = out.unionByName(best)
        return out


# By a part of an encoder's name, what its queries and documents begin with and the tokens it takes (null: its own limit).
PREFIXES = {
    "e5": ("query: ", "passage: ", None),
    "qwen3-embedding": ("Instruct: Given a description of a code change or a question about a software project, retrieve the relevant source files and documents\nQuery: ", "", 512),
    "embeddinggemma": ("task: code retrieval | query: ", "title: none | text: ", 512),
}
#: The same where only decisions are searched.
DECISION_PREFIXES = PREFIXES | {"embeddinggemma": ("task: search result | query: ", "title: none | text: ", 512)}


def prefixes(model: str, decisions: bool = False) -> tuple[str, str, int | None]:
    """Query prefix, document prefix and longest input of an encoder, by the first family that its name holds."""
    family = DECISION_PREFIXES if decisions else PREFIXES
    return next((held for part, held in family.items() if part in model.lower()), ("", "", None))


def sample_decisions(chunks: DataFrame, n: int, seed: int = 7, least: int = 400, batch: int = 10, cut: int = 4000) -> DataFrame:
    """A seeded choice of n longer decision texts in numbered batches: batch, path, text."""
    held = chunks.where((F.col("kind") == "decision") & (F.length("text") >= least)).orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(n)
    return held.withColumn("_n", F.monotonically_increasing_id()).select(F.floor(F.col("_n") / batch).cast("int").alias("batch"), "path", F.substring("text", 1, cut).alias("text"))


def paths_in(answers: DataFrame, files: DataFrame) -> DataFrame:
    """Known paths named in free text, in order of first mention: qid, path, pos."""
    named = answers.select("qid", F.posexplode(F.regexp_extract_all("answer", F.lit(r"([\p{L}\p{N}_@.-]+(?:/[\p{L}\p{N}_@.-]+)*)"), F.lit(1))).alias("at", "path"))
    first = named.join(files.select("path").distinct(), "path", "left_semi").groupBy("qid", "path").agg(F.min("at").alias("at"))
    from pyspark.sql import Window

    return first.select("qid", "path", (F.row_number().over(Window.partitionBy("qid").orderBy("at")) - 1).alias("pos"))
