"""Commit logs, journals, transcripts, cases, notes' front matter, and vector stores."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOURNAL = "ts string, pid int, event string, root string, config string, worktree_of string, chunks int, seconds double, reembedded int, error string, tool string, args map<string,string>, ms int, top array<string>"
TRANSCRIPT = "type string, timestamp string, message struct<content: array<struct<type:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string>>>"
CASES = "id string, query string, gold array<struct<path:string,symbol:string>>, overlap double"


def parse_log(blocks: DataFrame, with_time: bool = True) -> DataFrame:
    """NUL-separated log blocks (value, ord) to commits: sha, ts, subject, files, ord. The first line is tab-separated, the other lines are files."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    head = F.split(F.element_at(lines, 1), "\t", 3 if with_time else 2)
    ts = F.get(head, 1).cast("long") if with_time else F.lit(None).cast("long")
    return blocks.where(F.trim("value") != "").select(F.get(head, 0).alias("sha"), ts.alias("ts"), F.get(head, 2 if with_time else 1).alias("subject"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("files"), "ord")


def read_log_file(spark: SparkSession, path: str, with_time: bool = True) -> DataFrame:
    """A saved log, split at its NUL characters. ord follows the place in the file."""
    raw = spark.read.option("lineSep", "\0").text(path).withColumn("_i", F.monotonically_increasing_id())
    return parse_log(raw.withColumn("ord", F.col("_i")), with_time)


def read_log(spark: SparkSession, root: str, *options: str) -> DataFrame:
    """The log of a work tree on this machine, newest first."""
    out = subprocess.run(["git", "-C", root, "log", "--no-merges", "--format=%x00%H%x09%ct%x09%s", "--name-only", *options], capture_output=True, text=True, encoding="utf-8").stdout
    return parse_log(spark.createDataFrame(list(enumerate(out.split("\0")[1:])), "ord long, value string"))


def read_journal(spark: SparkSession, path: str, schema: str = JOURNAL) -> DataFrame:
    """JSON lines; lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Content items of a session's transcript: n (order of the line), timestamp, at, and the item's fields."""
    raw = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    lines = raw.select("n", F.from_json("value", TRANSCRIPT).alias("e")).where("e IS NOT NULL")
    return lines.select("n", F.col("e.timestamp").alias("timestamp"), F.posexplode("e.message.content").alias("at", "item")).select("n", "timestamp", "at", "item.*")


def shown_paths(result: Column) -> Column:
    """Files of a search answer, from its heading lines, in order and each once."""
    heads = F.filter(F.split(result, "\n"), lambda x: x.startswith("### "))
    return F.array_distinct(F.transform(heads, lambda x: F.substring_index(F.substring(x, F.lit(5), F.length(x)), ":", 1)))


def transcript_usage(items: DataFrame, root: str, search: str, edit_tools: tuple[str, ...] = ("Edit", "Write", "MultiEdit", "NotebookEdit")) -> tuple[DataFrame, DataFrame]:
    """Calls and edits of transcripts for events.usage(): tools whose name matches `search` show files, edit tools change them below `root`."""
    asked = items.where((F.col("type") == "tool_use") & F.col("name").rlike(search)).select("n", F.col("id").alias("call"), "timestamp", F.substring_index("name", "__", -1).alias("tool"), F.element_at("input", "query").alias("query"))
    answers = items.where("type = 'tool_result'").select(F.col("tool_use_id").alias("call"), shown_paths(F.coalesce("content", F.lit(""))).alias("shown"))
    calls = asked.join(answers, "call", "left").select(F.lit(0).alias("session"), "call", "n", "timestamp", "tool", "query", F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))
    base = root.rstrip("/") + "/"
    path = F.element_at("input", "file_path")
    edits = items.where((F.col("type") == "tool_use") & F.col("name").isin(*edit_tools) & path.startswith(base)).select(F.lit(0).alias("session"), "n", F.substring(path, F.lit(len(base) + 1), F.length(path)).alias("path"))
    return calls, edits


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).option("multiLine", "true").json(path)


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """Rankings made elsewhere, {case: {order: [path]}}: qid, path, pos."""
    raw = spark.read.option("wholetext", "true").text(path)
    shape = "map<string, struct<order: array<string>, files: map<string, array<string>>>>"
    return raw.select(F.explode(F.from_json("value", shape)).alias("qid", "r")).select("qid", F.posexplode("r.order").alias("pos", "path")).select("qid", "path", "pos")


def summary(text: Column) -> Column:
    """A note's summary: within 40 lines the `summary:` value (JSON or single quotes are taken off), else the first heading, else empty."""
    lines = F.slice(F.split(text, "\n"), 1, 40)
    named = F.get(F.filter(lines, lambda x: x.startswith("summary:")), 0)
    value = F.trim(F.substring(named, F.lit(9), F.length(named)))
    plain = F.when(value.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"s":'), value, F.lit("}")), "$.s"), value)).otherwise(F.regexp_replace(value, "^'+|'+$", ""))
    heading = F.get(F.filter(lines, lambda x: x.startswith("# ")), 0)
    return F.coalesce(plain, F.trim(F.regexp_replace(heading, "^[# ]+", "")), F.lit(""))


def supersessions(notes: DataFrame) -> DataFrame:
    """old, new of every `supersedes:` list in the first twelve lines of notes (path, text); of several the later path counts."""
    lines = F.filter(F.slice(F.split("text", "\n"), 1, 12), lambda x: x.startswith("supersedes:"))
    named = notes.select("path", F.explode(lines).alias("l")).select("path", F.explode(F.from_json(F.trim(F.substring(F.col("l"), F.lit(12), F.length("l"))), "array<string>")).alias("old"))
    clean = F.regexp_replace(F.replace("old", F.lit("\\"), F.lit("/")), r"^\./", "")
    return named.select(clean.alias("old"), F.col("path").alias("new")).groupBy("old").agg(F.max("new").alias("new"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Vectors (model, key, vec); a store that isn't there or can't be read counts as empty."""
    schema = "model string, key string, vec array<float>"
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path).dropDuplicates(["model", "key"])
    except Exception:  # noqa: BLE001  any damage means an empty store
        return spark.createDataFrame([], schema)


def append_store(rows: DataFrame, path: str) -> None:
    """Append vectors; a key that is there already does no harm, as readers take one of each."""
    rows.select("model", "key", "vec").write.mode("append").parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def run_report(per_case: DataFrame) -> DataFrame:
    """One JSON line for each cell: its methods' means and scores by case."""
    one = per_case.groupBy("cell", "method").agg(F.avg("score").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("case_id", "score"))), lambda x: x["score"]).alias("scores"))
    return one.groupBy("cell").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("method", "mean"))).alias("results"), F.map_from_entries(F.collect_list(F.struct("method", "scores"))).alias("per_case"))).alias("report"))


def last_lines(lines: DataFrame, most_bytes: int = 512_000) -> DataFrame:
    """The last lines of (n, value) that together hold at most most_bytes, line ends counted."""
    size = F.sum(F.octet_length("value") + 1).over(Window.orderBy(F.desc("n")))
    # a line takes a byte at least, so no more lines than bytes can be wanted
    return lines.orderBy(F.desc("n")).limit(most_bytes).withColumn("_s", size).where(F.col("_s") <= most_bytes).drop("_s")
