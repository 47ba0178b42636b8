"""BM25 over a chunk table, for a whole table of queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stemming import stemmed
from quarry.functions.text import query_tokens, tokenize
from quarry.sources.tables import checkpointed

K1, B = 1.5, 0.75


def lexical_text() -> Column:
    """What of a chunk is searched: path, symbol and text."""
    return F.concat_ws(" ", "path", "symbol", "text")


def query_terms(queries: DataFrame, drop_stopwords: bool = False, stem: bool = False) -> DataFrame:
    """Distinct terms of each query: qid, term."""
    return queries.select("qid", F.explode(F.array_distinct(query_tokens("query", drop_stopwords, stem))).alias("term"))


#: A token that no text has: each chunk gets it once, so that lengths and term counts come from one table.
_MARK = "\0"


class Index:
    """The inverted index of a chunk table, restricted to the terms asked for, with the corpus' own statistics.

    Texts are tokenized once; occurrences of asked terms are written down, and the statistics and weights read that table: counts of chunks,
    their mean length, and the terms' frequencies.
    """

    def __init__(self, chunks: DataFrame, terms: DataFrame, body: Column | None = None, stem: bool = False):
        tokens = tokenize(lexical_text() if body is None else body)
        docs = chunks.select("idx", F.concat(stemmed(tokens) if stem else tokens, F.array(F.lit(_MARK))).alias("tokens"))
        occurrences = docs.select("idx", (F.size("tokens") - 1).alias("len"), F.explode("tokens").alias("term"))
        asked = terms.select("term").union(chunks.sparkSession.range(1).select(F.lit(_MARK))).distinct()
        held = checkpointed(occurrences.join(asked, "term", "left_semi").groupBy("term", "idx", "len").agg(F.count("*").alias("f")))
        self.tf = held.where(F.col("term") != _MARK)
        # both are one row
        self.stats = held.where(F.col("term") == _MARK).agg(F.count("*").alias("n_docs"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("avg_len"))
        df = self.tf.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.terms = df.crossJoin(self.stats).select("term", "df", idf.alias("idf"), "avg_len")

    def weights(self) -> DataFrame:
        """term, idx, w: the BM25 share of each term in each chunk that holds it."""
        norm = F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
        return self.tf.join(self.terms, "term").select("term", "idx", (F.col("idf") * F.col("f") * (K1 + 1) / norm).alias("w"))


def bm25(chunks: DataFrame, queries: DataFrame, drop_stopwords: bool = False, body: Column | None = None, stem: bool = False) -> DataFrame:
    """qid, idx, score of all chunks with a positive score. Scores are rounded to 9 digits, so equal texts tie exactly.

    Weights are dealt out by chunk before they meet the queries: there are far fewer of them than of (query, chunk, term), and each sum
    is then made where its chunk is, with no further exchange.
    """
    terms = query_terms(queries, drop_stopwords, stem)
    return scores(Index(chunks, terms, body, stem).weights(), terms)


def scores(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, idx, score: the sum of a chunk's weights (term, idx, w) over the terms (qid, term) of each query."""
    return weights.repartition("idx").join(terms, "term").groupBy("qid", "idx").agg(F.round(F.sum("w"), 9).alias("score"))


def best_per_term(chunks: DataFrame, queries: DataFrame, drop_stopwords: bool = False) -> DataFrame:
    """For each query and term the chunk of the largest one-term score, the first of equal ones: qid, term, idx, w."""
    terms = query_terms(queries, drop_stopwords)
    return best_of_terms(Index(chunks, terms).weights(), terms)


def best_of_terms(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """best_per_term from weights that are there already."""
    weights = weights.withColumn("w", F.round("w", 9))
    best = weights.groupBy("term").agg(F.max_by(F.struct("idx", "w"), F.struct("w", -F.col("idx"))).alias("b"))
    return terms.join(best, "term").select("qid", "term", F.col("b.idx").alias("idx"), F.col("b.w").alias("w"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Best k of each query with their 0-based pos; ties go to the smaller idx."""
    # the limit is on the bare row number, so that Spark cuts each partition to k rows before the exchange
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "idx"))
    top = scores.withColumn("pos", place).where(F.col("pos") <= k)
    return top.withColumn("pos", F.col("pos") - 1)
