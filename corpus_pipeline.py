"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.decontaminate import without_contaminated
from quarry.llm.frames import deleted, shared_folder
from quarry.llm.lines import WORDS, without_repeated_lines
from quarry.llm.neardup import one_of_each
from quarry.llm.packing import pack_documents
from quarry.llm.queries import tokenizer_path
from quarry.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go.

    Null and empty texts are scored as empty ones, long ones whole; rows with a null or repeated id are judged one by one; without labels of both
    classes all stay. All columns of docs are kept, whatever their names; an empty table gives none.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, short ones too if they hold many words; each document stays with its other lines.

    Null texts stay null and empty ones empty; a text may become empty; n_chars, if there is such a column, is counted anew. Of
    equal runs the one in the smallest id stays, null ids last; rows whose id and place are equal take nothing from each other. All columns stay.
    """
    return without_repeated_lines(docs, words=WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Null and empty texts and null ids are in no group and stay; rows whose id repeats are one document and stay or go together. All columns stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go: those of which one word in twenty or more lies in a benchmark window.

    Null and empty texts have no words and stay; rows with null or repeated ids are judged one by one; an empty benchmark keeps all. All columns stay.
    """
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as packed token sequences, one row per piece.

    Null and empty texts are a piece of the end id alone; long ones are cut; repeated rows are packed each by itself; an empty table gives none.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Fitted scores, tokenizers and packing have no SQL; tests/llm/test_pipeline.py has each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written as Parquet and read again as the next one's input.

    The files go to the shared folder in spark.checkpoint.dir (a folder of this machine only in a local session that sets none); a
    stage's input is deleted once its output is written, and the last one's once it is packed.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        if last:
            deleted(spark, last)
        last = path
    return out
