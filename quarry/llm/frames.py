"""DataFrame helpers shared by the operators: tables that outlive a plan, safe columns, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links that one step of a local contraction holds in memory.
_LINKS = 1 << 19
#: For writes: shuffle files are freed as soon as one has ended, else they pile up until the driver collects its garbage; and
#: batches for Python hold little at once, as both the executor and its Python worker hold them.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may do without."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tables-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Parquet tables in the shared folder that cut a plan's lineage; on leaving, all that weren't kept are deleted.

    What is written survives lost executors, is compressed, and is read back by column.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.held = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        for path in [p for p, _ in self.held.values()]:
            deleted(self.spark, path)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.held)}-{uuid.uuid4().hex[:8]}"
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in _WRITING}
        for k, v in _WRITING.items():
            conf.set(k, v)
        try:
            # small row groups: a row of packed arrays may be some MB, and a reader holds a group at a time
            df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path, _ = self.held.pop(id(t))
            deleted(self.spark, path)

    def keep(self, table: DataFrame) -> DataFrame:
        """Leave a table in place: a result still reads it."""
        self.held.pop(id(table))
        return table


def merged(df: DataFrame) -> DataFrame:
    """For the smaller side of a join whose other side moves texts or many rows: a sort-merge join at every size, which can spill and be split at a hot key."""
    return df.hint("merge")


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: how finely this cluster deals out a table."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of docs has, whatever the case."""
    held = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def least_labels(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label of each node's component once the links (a, b), node numbers, are added."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (label[a], label[b], a, b):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task, some at a time, as stars: each node but the least of its component, and that least one."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, number = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = least_labels(number[: len(u)], number[len(u) :], np.arange(len(nodes)))
        on = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[label[on]])], ["u", "v"])

    u, v, n = [], [], 0
    for batch in batches:
        u.append(np.asarray(batch.column("u")))
        v.append(np.asarray(batch.column("v")))
        n += batch.num_rows
        if n >= _LINKS:
            yield stars(np.concatenate(u), np.concatenate(v))
            u, v, n = [], [], 0
    if n:
        yield stars(np.concatenate(u), np.concatenate(v))


def components(edges: DataFrame, tables: Tables, rounds: int = 60) -> DataFrame:
    """Connected components of the links in columns a and b (long): columns node, component (smallest node reached).

    Each task first contracts its own links to stars; then alternating large-star and small-star steps (Kiveris and others, 2014)
    join the tasks' stars until every node points to one that points nowhere. A node's least neighbour is an aggregate of
    its own, written down, so that the join with it is one that adaptive execution can split at a hub. Nodes without links don't appear;
    null ends are ignored; no links give no rows.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = tables.write(links.mapInArrow(_contracted, "u long, v long").distinct())
    for _ in range(rounds):
        ends = links.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select(F.col("v"), F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty():
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = tables.write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        tables.drop(low, links)
        low = tables.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        small = small.where("v <> m").select("v", "m").union(low.select("u", "m"))
        links = tables.write(small.toDF("u", "v").mapInArrow(_contracted, "u long, v long").distinct())
        tables.drop(low, large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
