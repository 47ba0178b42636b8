"""Rankings as long tables (qid, idx, pos): fusion, filters, interleaving, budgets. pos counts from 0; ties go to the smaller idx."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import checkpointed

RRF_K = 60
HEAD, LEXICAL_SHARE, DENSE_KEEP = 50, 0.2, 5
STOP_MARGIN = 50
#: Chunks that still fit which are folded at once for a query.
BUDGET_BLOCK = 2000


def _number(*order: Column | str, by: tuple[str, ...] = ("qid",)) -> Column:
    return (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int")


def rank(scores: DataFrame) -> DataFrame:
    """Positions by falling score."""
    return scores.select("qid", "idx", "score", _number(F.desc("score"), "idx").alias("pos"))


def rank_all(scores: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """A full permutation: chunks without a score count as 0, in order of idx. A stated query set against all rows, narrow columns only."""
    every = queries.select("qid").crossJoin(chunks.select("idx"))
    return rank(every.join(scores, ["qid", "idx"], "left").select("qid", "idx", F.coalesce("score", F.lit(0.0)).alias("score")))


def rrf(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: qid, idx, score, pos."""
    both = rankings[0].select("qid", "idx", "pos")
    for r in rankings[1:]:
        both = both.unionByName(r.select("qid", "idx", "pos"))
    return rank(both.groupBy("qid", "idx").agg(F.round(F.sum(1 / (k + 1 + F.col("pos"))), 12).alias("score")))


def seed_filter(fused: DataFrame, lexical: DataFrame, dense: DataFrame, labels: DataFrame, best: DataFrame, head: int = HEAD, share: float = LEXICAL_SHARE, keep: int = DENSE_KEEP) -> DataFrame:
    """Seeds of each query: of the fused head those near the best lexical score or in the dense top, one for each label; then each term's best chunk.

    fused, lexical (score) and dense (pos) by (qid, idx); labels: idx, label (empty labels never block each other); best: qid,
    term, idx, w in any order. Seeds are numbered anew.
    """
    top = lexical.groupBy("qid").agg(F.max("score").alias("most"))
    held = fused.where(F.col("pos") < head).select("qid", "idx", "pos").join(top, "qid", "left").join(lexical.select("qid", "idx", "score"), ["qid", "idx"], "left")
    held = held.join(dense.select("qid", "idx", F.col("pos").alias("dpos")), ["qid", "idx"], "left").join(labels, "idx")
    held = held.where((F.coalesce("score", F.lit(0.0)) >= share * F.coalesce("most", F.lit(0.0))) | (F.col("dpos") < keep))
    first = F.row_number().over(Window.partitionBy("qid", "label").orderBy("pos"))
    held = held.withColumn("n", first).where((F.col("label") == "") | (F.col("n") == 1)).select("qid", "idx", F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("at"), F.lit("").alias("term")).alias("place"))
    extra = best.where("w > 0").select("qid", "idx", F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), F.col("term").alias("term")).alias("place"))
    every = held.unionByName(extra).groupBy("qid", "idx").agg(F.min("place").alias("place"))
    return every.select("qid", "idx", _number("place").alias("pos"))


def rerank_head(ranking: DataFrame, scores: DataFrame, k: int = HEAD) -> DataFrame:
    """The first k by falling new score (ties keep their order), the rest unchanged."""
    held = ranking.select("qid", "idx", "pos").join(scores.select("qid", "idx", "score"), ["qid", "idx"], "left")
    head = F.col("pos") < k
    return held.select("qid", "idx", _number(F.when(head, 0).otherwise(1), F.desc(F.when(head, F.coalesce("score", F.lit(float("-inf"))))), "pos").alias("pos"))


def only(ranking: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ranking's chunks whose idx is in `chosen`, numbered anew."""
    return ranking.join(chosen.select("idx"), "idx", "left_semi").select("qid", "idx", _number("pos").alias("pos"))


def drop_gold(ranking: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Leave-one-out: chunks of a query's own gold files go."""
    return ranking.join(chunks.select("idx", "path"), "idx").join(gold.select("qid", "path"), ["qid", "path"], "left_anti").select("qid", "idx", _number("pos").alias("pos"))


def first_per_path(ranking: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """First k distinct files in order, each with its best chunk: qid, path, idx, pos. k below 1 counts as 1."""
    best = ranking.join(chunks.select("idx", "path"), "idx").groupBy("qid", "path").agg(F.min(F.struct("pos", "idx")).alias("b"))
    return best.select("qid", "path", "b.idx", _number("b.pos").alias("pos")).where(F.col("pos") < max(1, k))


def superseded_last(ranking: DataFrame, superseded: DataFrame) -> DataFrame:
    """Chunks of superseded paths after all others, else in order. ranking holds path."""
    old = superseded.select("path", F.lit(True).alias("old")).distinct()
    return ranking.join(old, "path", "left").select("qid", "path", "idx", _number(F.coalesce("old", F.lit(False)), "pos").alias("pos"))


def interleave(ranking: DataFrame, chunks: DataFrame, n_code: int = 3, n_docs: int = 1) -> DataFrame:
    """n_code code chunks, n_docs others, and so on; a side's surplus follows at the end. In closed form: each side's rank gives its turn."""
    r = ranking.join(chunks.select("idx", "is_code"), "idx")
    side = _number("pos", by=("qid", "is_code"))
    r = r.withColumn("r", side).withColumn("turn", F.floor(F.col("r") / F.when(F.col("is_code"), n_code).otherwise(n_docs)))
    return r.select("qid", "idx", _number("turn", F.when(F.col("is_code"), 0).otherwise(1), "r").alias("pos"))


def alternate(base: DataFrame, side: DataFrame) -> DataFrame:
    """One of each in turn, base first; an item's first place counts."""
    both = base.select("qid", "idx", F.struct("pos", F.lit(0).alias("src")).alias("at")).unionByName(side.select("qid", "idx", F.struct("pos", F.lit(1).alias("src")).alias("at")))
    return both.groupBy("qid", "idx").agg(F.min("at").alias("at")).select("qid", "idx", _number("at").alias("pos"))


def select_budget(ranking: DataFrame, chunks: DataFrame, budget: Column | int, stop: int = STOP_MARGIN, block: int = BUDGET_BLOCK) -> DataFrame:
    """Greedy choice in order under a token budget: what doesn't fit is skipped; a pick that leaves fewer than `stop` tokens is the last.

    Skips make the sum order-dependent, so the next `block` chunks of each query that still fit are folded in one row; what is left of the
    budget then rules out most of the rest, and so on until nothing fits. What never fits is never gathered, and a chunk that doesn't fit once
    never will, as the budget only shrinks. ranking may hold its own budget column. Returns qid, idx, pos (numbered anew), tokens.
    """
    r = ranking.withColumn("_budget", F.lit(budget) if isinstance(budget, int) else budget)
    r = checkpointed(r.join(chunks.select("idx", "tokens"), "idx").where(F.col("tokens") <= F.col("_budget")).select("qid", "idx", F.col("pos").cast("int").alias("pos"), F.col("tokens").cast("int").alias("tokens"), F.col("_budget").cast("long").alias("_budget")))
    item = "struct<pos:int,tokens:int,idx:bigint>"

    def take(s: Column, x: Column) -> Column:
        fits = ~s["done"] & (x["tokens"] <= s["left"])
        left = s["left"] - x["tokens"]
        return F.struct(F.when(fits, left).otherwise(s["left"]).alias("left"), F.when(fits, left < stop).otherwise(s["done"]).alias("done"), F.when(fits, F.concat(s["got"], F.array(x.cast(item)))).otherwise(s["got"]).alias("got"))

    state = r.groupBy("qid").agg(F.max("_budget").alias("left")).select("qid", "left", F.lit(-1).alias("at"))
    picked = []
    while True:
        fits = r.drop("_budget").join(state, "qid").where((F.col("pos") > F.col("at")) & (F.col("tokens") <= F.col("left")))
        head = fits.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("n") <= block)
        held = head.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens", "idx"))).alias("all"), F.max("left").alias("left"), F.max("pos").alias("at"))
        start = F.struct(F.col("left"), F.lit(False).alias("done"), F.array().cast(f"array<{item}>").alias("got"))
        folded = checkpointed(held.select("qid", "at", (F.size("all") < block).alias("last"), F.aggregate("all", start, take).alias("s")))
        picked.append(folded.select("qid", F.explode("s.got").alias("x")))
        state = folded.where(~F.col("s.done") & ~F.col("last")).select("qid", F.col("s.left").alias("left"), "at")
        if state.isEmpty():
            break
    every = reduce(DataFrame.unionByName, picked)
    return every.select("qid", F.col("x.idx").alias("idx"), _number("x.pos").alias("pos"), F.col("x.tokens").alias("tokens"))


def select_channel(side: DataFrame, main: DataFrame, chunks: DataFrame, budget: int, share: float) -> DataFrame:
    """The side ranking gets its share of the budget, the main ranking without what is taken gets the rest: qid, idx, part (0 side, 1 main), pos."""
    first = select_budget(side, chunks, int(budget * share))
    spent = first.groupBy("qid").agg(F.sum("tokens").alias("spent"))
    rest = main.select("qid", "idx", "pos").join(first.select("qid", "idx"), ["qid", "idx"], "left_anti").join(spent, "qid", "left")
    second = select_budget(rest, chunks, budget - F.coalesce("spent", F.lit(0)))
    return first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1))).select("qid", "idx", "part", "pos")


def gate(fused: DataFrame, decisions: DataFrame, k: int) -> DataFrame:
    """Queries whose fused top k holds a decision chunk: qid, open."""
    hit = fused.where(F.col("pos") < k).join(decisions.select("idx", F.lit(1).alias("hit")), "idx", "left")
    return hit.groupBy("qid").agg(F.max(F.coalesce("hit", F.lit(0))).cast("boolean").alias("open"))


def gate_counts(fused: DataFrame, decisions: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """How many queries a gate of each k lets through: k, n, open."""
    first = fused.join(decisions.select("idx"), "idx", "left_semi").groupBy("qid").agg(F.min("pos").alias("first"))
    seen = fused.select("qid").distinct().join(first, "qid", "left")
    each = seen.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "first")
    return each.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("first") < F.col("k")).alias("open"))


def judge_head(ranking: DataFrame, chunks: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The best chunk of each of the first k files goes to the front by falling judge score (none: 0; ties keep their order), all others follow in order: qid, idx, pos."""
    head = first_per_path(ranking, chunks, k).select("qid", "idx", F.lit(True).alias("head")).join(scores.select("qid", "idx", "score"), ["qid", "idx"], "left")
    held = ranking.select("qid", "idx", "pos").join(head, ["qid", "idx"], "left")
    front = F.when(F.col("head"), F.coalesce("score", F.lit(0.0)))
    return held.select("qid", "idx", _number(front.desc_nulls_last(), "pos").alias("pos"))
