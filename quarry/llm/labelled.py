"""Labelled rows for fitting: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import Tables

#: Rows that a classifier is fitted on at most, and the UTF-8 bytes of their texts (the documented bounds of the fitting sample).
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 24 << 20


def fold_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_col).cast("long").cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, excluded: int, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[pa.Array, list[int]]:
    """Texts and labels (0 or 1) of at most `rows` labelled rows whose fold isn't `excluded`, with `size` bytes at most, ordered by id.

    Rows are taken in the order of a hash of the id, so the choice is the same on every run and favours neither short nor long texts; one that would pass
    the bound of bytes is left out and the next ones are still tried. Null labels and ids are left out; of repeated labels of a
    document the largest counts, of repeated documents the least text, null as empty.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id IS NOT NULL AND y IS NOT NULL")
    known = known.where(fold_of("_id", modulus) != excluded).groupBy("_id").agg(F.max("y").alias("y"))
    chosen = known.withColumn("_order", F.xxhash64("_id", F.lit(17))).orderBy("_order", "_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # at most `rows` short rows are broadcast
    met = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_order").agg(F.max("y").alias("y"), F.min("_text").alias("_text"))
    with Tables(docs.sparkSession) as tables:
        met = tables.write(met.withColumn("_size", F.octet_length("_text")))
        taken, left = [], size
        for r in met.select("_id", "_size").orderBy("_order", "_id").collect():  # at most `rows`
            if r["_size"] <= left:
                taken.append(r["_id"])
                left -= r["_size"]
        held = sorted(met.where(F.col("_id").isin(taken)).select("_id", "y", "_text").collect())
    return pa.array([r["_text"] for r in held], pa.large_string()), [int(r["y"] > 0) for r in held]
