"""Files to chunks: fixed windows, markdown sections, code declarations. Tables: (path, text) in, chunks out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import CODE_EXT, MD_EXT, slug, suffix, token_count
from quarry.sources.tables import checkpointed

MAX_CHARS, WINDOW_CHARS = 6000, 3000
CHUNK_SCHEMA = "id string, path string, symbol string, text string, line int"

# Which lines begin a declaration, a variable, a function or a heading.
DECLARATION = re.compile(r"^(?:@\w+(?:\([^)]*\))?\s*)*(?:export\s+)?(?:default\s+)?(?:abstract\s+|sealed\s+|final\s+|base\s+|interface\s+|data\s+|async\s+|private\s+|public\s+)*(?:class|enum|mixin|extension(?:\s+type)?|typedef|interface|type|object|struct|protocol|function|def|fun|func)\s+([A-Za-z_$][\w$]*)", re.M)
VARIABLE = re.compile(r"^(?:export\s+)?(?:const|final|var|let|val)\s+(?:[\w<>?,.\[\] ]+?\s+)?([A-Za-z_$][\w$]*)\s*[=:;]", re.M)
FUNCTION = re.compile(r"^(?:[A-Za-z_][\w<>\[\]?,. ]*\s)?([a-z_$][\w$]*)\s*(?:<[^>]*>)?\(", re.M)
HEADING = re.compile(r"^(#{1,3})\s+(.+?)\s*#*\s*$", re.M)
_TYPED = (".dart", ".kt", ".ts", ".tsx")
_CONTROL = frozenset(("if", "for", "while", "switch", "return"))


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _cut(id_: Column, text: Column, size: int, whole: bool) -> Column:
    """Parts of `size` characters as structs (part, id, text, offset). whole: a text of at most `size` keeps its id, and so does the first of several windows."""
    parts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int"))
    named = lambda i: F.when((F.length(text) <= size) if whole else (i == 0), id_).otherwise(F.concat(id_, F.lit("@"), i.cast("string")))
    return F.transform(parts, lambda i: F.struct(i.alias("part"), named(i).alias("id"), F.substring(text, i * size + 1, F.lit(size)).alias("text"), (i * size).alias("at")))


def split_long(chunks: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    """Chunks of more than `size` characters in parts id@0, id@1, ...; the line moves on, the symbol stays."""
    c = chunks.withColumn("_part", F.explode(_cut(F.col("id"), F.col("text"), size, True)))
    line = F.col("line") + _newlines(F.substring(F.col("text"), F.lit(1), F.col("_part.at")))
    return c.select("_part.id", "path", "symbol", F.col("_part.text").alias("_t"), line.cast("int").alias("line"), F.col("_part.part").alias("part")).withColumnRenamed("_t", "text")


def window_chunks(files: DataFrame, size: int = WINDOW_CHARS) -> DataFrame:
    """Windows of `size` characters: the first has the path as id, others path@i. Blank windows stay; an empty file has none."""
    c = files.where(F.length("text") > 0).withColumn("_part", F.explode(_cut(F.col("path"), F.col("text"), size, False)))
    line = 1 + _newlines(F.substring(F.col("text"), F.lit(1), F.col("_part.at")))
    return c.select(*[x for x in files.columns if x not in ("text", "path")], F.col("_part.id").alias("id"), "path", F.lit("").alias("symbol"), F.col("_part.text").alias("_t"), line.cast("int").alias("line"), F.col("_part.part").alias("part")).withColumnRenamed("_t", "text")


def number_repeats(rows: DataFrame, keys: list[str], order: list[str], name: str, mark: str) -> DataFrame:
    """The nth repeat (n >= 1) of `name` among equal `keys` becomes name + mark + n."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order)) - 1
    return rows.withColumn("numbered", F.when(n == 0, F.col(name)).otherwise(F.concat(name, F.lit(mark), n.cast("string"))))


def _marks(path: str, text: str) -> list[tuple[int, str]]:
    found: dict[int, str] = {}
    ending = re.search(r"[^/](\.[^./]+)$", path)
    ext = ending[1].lower() if ending else ""
    for pattern in (DECLARATION, VARIABLE, *([FUNCTION] if ext in _TYPED else [])):
        for m in pattern.finditer(text):
            if m.start() not in found and not (pattern is FUNCTION and m[1] in _CONTROL):
                found[m.start()] = m[1]
    return sorted(found.items())


def _sections(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[2]) for m in HEADING.finditer(text)]


def _pieces(code: bool):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                marks = [(0, ""), *(_marks(path, text) if code else _sections(text)), (len(text), "")]
                for k, ((a, name), (b, _)) in enumerate(zip(marks[:-1], marks[1:], strict=True)):
                    if text[a:b].strip():
                        out.append((path, k, name, text[a:b], text.count("\n", 0, a) + 1))
            yield pd.DataFrame(out, columns=["path", "ord", "name", "text", "line"])

    return pieces


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of (path, text) files by suffix: code by top-level declarations, markdown by headings, all else by windows.

    Finding the offsets of declarations needs a regular expression engine that returns places, so these two kinds pass through
    an Arrow function; naming, numbering and splitting are columns. Null paths or texts have no chunks.
    """
    files = files.select("path", "text").where("path IS NOT NULL AND text IS NOT NULL").withColumn("_ext", suffix("path"))
    found = "path string, ord int, name string, text string, line int"
    code = files.where(F.col("_ext").isin(*CODE_EXT)).select("path", "text").mapInPandas(_pieces(True), found)
    code = number_repeats(code, ["path"], ["ord"], "name", "~").withColumnRenamed("numbered", "symbol")
    code = code.withColumn("id", F.when(F.col("symbol") == "", F.col("path")).otherwise(F.concat("path", F.lit("::"), "symbol")))
    sections = files.where(F.col("_ext").isin(*MD_EXT)).select("path", "text").mapInPandas(_pieces(False), found)
    sections = sections.withColumn("name", F.when(F.col("ord") == 0, "").otherwise(slug("name")))
    sections = number_repeats(sections, ["path"], ["ord"], "name", "-")
    sections = sections.withColumn("id", F.when(F.col("numbered") == "", F.col("path")).otherwise(F.concat("path", F.lit("#"), "numbered"))).withColumn("symbol", F.lit(""))
    cut = split_long(code.select("id", "path", "symbol", "text", "line", "ord").unionByName(sections.select("id", "path", "symbol", "text", "line", "ord")).select("id", "path", "symbol", "text", "line"))
    rest = window_chunks(files.where(~F.col("_ext").isin(*CODE_EXT, *MD_EXT)).select("path", "text"))
    return cut.unionByName(rest.select(*cut.columns)).withColumn("tokens", token_count("text"))


def with_position(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, 0-based in the given order, without gathering the rows in one task: a range sort, then each partition's offset."""
    parts = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    parts = checkpointed(parts)  # both uses below must see the same partition numbers
    base = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    base = base.withColumn("_base", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # one row for each partition
    return parts.join(base, "_p").withColumn("idx", F.col("_base") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_n", "_first", "_base")


def fingerprint(chunks: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Of each group, 12 hex digits of the SHA-1 over its chunks' id, a zero byte and text, in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order), F.concat("id", F.lit("\0"), "text").alias("body"))))
    return chunks.groupBy(*keys).agg(F.substring(F.sha1(F.array_join(F.transform(held, lambda x: x["body"]), "")), 1, 12).alias("fingerprint"))


def corpus_stats(chunks: DataFrame, top: int = 12) -> DataFrame:
    """Chunks, files and tokens of the most frequent first path segments, with the corpus' totals."""
    total = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"), F.sum("tokens").alias("tokens"))
    return chunks.groupBy(F.substring_index("path", "/", 1).alias("segment")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "segment").limit(top).crossJoin(total)
