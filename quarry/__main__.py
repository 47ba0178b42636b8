"""Command line: python -m quarry stats | explore | cases-from-git ROOT [--out FOLDER]."""

from __future__ import annotations

import argparse
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import kind_of
from quarry.operators import chunking, explore, graph, history
from quarry.session import local_session
from quarry.sources import files, records


def corpus(spark: SparkSession, root: str, config: dict) -> DataFrame:
    """The chunk table of a work tree."""
    own = config.get("corpus", {})
    read = files.read_repository(spark, root, exclude=tuple(own.get("exclude", files.EXCLUDE)), include=tuple(own.get("include", ())), max_bytes=own.get("max_bytes", files.MAX_BYTES), keep_always=tuple(own.get("keep_always", ())))
    chunks = chunking.with_position(chunking.chunk_files(read), ["path", "line", "id"])
    kind = kind_of("path", files.decision_globs(config))
    return chunks.withColumn("kind", kind).withColumn("is_code", F.col("kind") == "code")


def mirror(read: DataFrame, root: str, to: str) -> int:
    """Copy exactly the corpus' files to another folder of this machine."""
    n = 0
    for r in read.select("path").toLocalIterator():
        place = Path(to, r.path)
        place.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(Path(root, r.path), place)
        n += 1
    return n


def explored(spark: SparkSession, root: str, config: dict) -> tuple[str, str]:
    """Report and page of a work tree's file graph."""
    chunks = corpus(spark, root, config).cache()
    g = config.get("graph", {})
    links = graph.file_edges(graph.resolve_targets(graph.link_targets(chunks), chunks, g.get("dart_package", ""), g.get("dart_root", "lib"), g.get("aliases")))
    node, edges = graph.file_graph(chunks, graph.ref_edges(chunks), links)
    node, edges = node.cache(), edges.cache()
    community = graph.communities(edges, node).cache()
    name = Path(root).resolve().name
    return explore.report(name, node, edges, community, graph.missing_refs(chunks, chunks)), explore.to_html(name, node, edges, community)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("verb", choices=["stats", "explore", "cases-from-git"])
    parser.add_argument("root")
    parser.add_argument("--config")
    parser.add_argument("--out", default=".")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    config = files.load_config(spark, args.root, args.config)
    if args.verb == "stats":
        for r in chunking.corpus_stats(corpus(spark, args.root, config)).collect():
            print(f"{r.segment}\t{r.n}\t({r.chunks} chunks, {r.files} files, {r.tokens} tokens in all)")
    elif args.verb == "explore":
        report, page = explored(spark, args.root, config)
        Path(args.out, "REPORT.md").write_text(report, "utf-8")
        Path(args.out, "graph.html").write_text(page, "utf-8")
    else:
        log = records.read_log(spark, args.root).cache()
        chunks = corpus(spark, args.root, config)
        found = history.mine_cases(log, chunks).collect() + history.mine_decisions(log, chunks, globs=files.decision_globs(config)).collect()
        Path(args.out, "cases.json").write_text(json.dumps([{"id": r.id, "query": r.query, "gold": [{"path": p} for p in r.gold]} for r in found], ensure_ascii=False, indent=1), "utf-8")


if __name__ == "__main__":
    main()
