"""Dense scores, content-addressed vectors and the encoder interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two float arrays, in double precision and in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))


def dense_scores(vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """qid, idx, score for every query vector (qid, qvec) and row vector (idx, vec): a stated query set against all rows, narrow columns only."""
    return query_vectors.crossJoin(vectors).select("qid", "idx", F.round(dot("qvec", "vec"), 9).alias("score"))


def content_key(text: Column) -> Column:
    return F.sha1(text)


def missing_keys(chunks: DataFrame, store: DataFrame, model: str, prefix: str = "") -> DataFrame:
    """Texts (key, body) whose vectors the store (model, key, vec) doesn't hold, each once."""
    body = F.concat(F.lit(prefix), "path", F.lit(" "), "symbol", F.lit("\n"), "text")
    wanted = chunks.select(body.alias("body")).withColumn("key", content_key(F.col("body"))).dropDuplicates(["key"])
    return wanted.join(store.where(F.col("model") == model).select("key"), "key", "left_anti")


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a neural encoder: signed hashed words, normalised."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def encode(texts: DataFrame, encoder: Encoder | None = None, model: str = "hashing") -> DataFrame:
    """(key, body) to (model, key, vec), in Arrow batches; the encoder is called once a batch."""
    made = encoder or hashing_encoder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"model": model, "key": b["key"], "vec": list(made(b["body"].tolist())) if len(b) else []})

    return texts.select("key", "body").mapInPandas(run, "model string, key string, vec array<float>")


def refresh_store(chunks: DataFrame, store: DataFrame, encoder: Encoder | None = None, model: str = "hashing") -> DataFrame:
    """The rows to append to the store so that it holds every chunk's vector."""
    return encode(missing_keys(chunks, store, model), encoder, model)


def rerank(pairs: DataFrame, score: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """(qid, idx, query, text) to (qid, idx, score) by a cross-encoder called once for each Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"qid": b["qid"], "idx": b["idx"], "score": score(b["query"].tolist(), b["text"].tolist()) if len(b) else []})

    kinds = dict(pairs.dtypes)
    return pairs.select("qid", "idx", "query", "text").mapInPandas(run, f"qid {kinds['qid']}, idx {kinds['idx']}, score double")
