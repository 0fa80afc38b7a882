"""Command line: stats, retrieve, experiment, ablate over a dataset folder."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import selection, splits
from ..operators.hierarchy import depths
from ..session import get_session
from ..schemas import K_VALUES
from ..sources import jsonl, sinks
from .placement import RETRIEVERS, PlacementConfig, ablation, format_ablation, run


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graftline")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("stats", "retrieve", "experiment", "ablate"):
        c = sub.add_parser(name)
        c.add_argument("--root", default="data")
        c.add_argument("--dataset", required=True)
        c.add_argument("--split-mode", choices=("native", "resplit"), default="native")
        c.add_argument("--edge-catalogue", choices=("all", "atomic"), default="all")
        c.add_argument("--output")
        if name != "stats":
            c.add_argument("--retriever", choices=RETRIEVERS, default="inverted_index")
            c.add_argument("--split", default="test_nil")
            c.add_argument("--k", type=int, default=max(K_VALUES))
            c.add_argument("--n-retrieved", type=int, default=50)
            c.add_argument("--no-enrichment", action="store_true")
            c.add_argument("--no-leaf-priority", action="store_true")
            c.add_argument("--mention-vectors", help="table of (id, vector), for dense retrievers")
            c.add_argument("--vectors", help="table of (id, vector) of concepts, or, for bi_encoder, of edges (parent and child joined by U+001F)")
            c.add_argument("--selector", choices=("cross_encoder",), help="re-rank by a selector, trained on the train split")
            c.add_argument("--max-train", type=int)
            c.add_argument("--max-valid", type=int, help="mentions of the evaluated split, in order")
    return p


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = get_session()
    hierarchy, parts = jsonl.read_dataset(spark, a.root, a.dataset, a.split_mode, a.edge_catalogue)
    if a.command == "stats":
        both = None
        for name, m in parts.items():
            one = m.select("mention_id", "gold_edges").withColumn("split", F.lit(name))
            both = one if both is None else both.unionByName(one)
        mentions = both.select(F.concat_ws("/", "split", "mention_id").alias("mention_id"), "split", "gold_edges")
        gold = jsonl.gold_table(mentions)
        depth = depths(gold.select(F.col("parent_id").alias("id")), hierarchy.concepts, hierarchy.par)
        stats = splits.dataset_statistics(mentions.drop("gold_edges"), gold, depth, hierarchy.par, hierarchy.ch, "split")
        print(sinks.statistics_report(stats, sinks.hierarchy_counts(hierarchy), list(parts)))
        return 0
    vectors = None
    if a.retriever != "inverted_index":
        if not (a.mention_vectors and a.vectors):
            raise SystemExit(f"--retriever {a.retriever} needs --mention-vectors and --vectors")
        vectors = spark.read.parquet(a.mention_vectors), spark.read.parquet(a.vectors)
    config = PlacementConfig(a.retriever, None, a.n_retrieved, a.k, not a.no_enrichment, not a.no_leaf_priority, a.edge_catalogue)
    mentions = parts[a.split].limit(a.max_valid) if a.max_valid else parts[a.split]
    gold = jsonl.gold_table(mentions)
    select = None
    if a.command == "experiment" or a.selector:
        train = parts["train"].limit(a.max_train) if a.max_train else parts["train"]
        pool = run(config, hierarchy, train, jsonl.gold_table(train), vectors, validate=False).rankings
        model = selection.LogisticSelector(["score", "rank"]).fit(selection.cross_examples(pool, jsonl.gold_table(train)))
        select, config = model.rerank, replace(config, selector="cross_encoder")
    if a.command == "ablate":
        print(format_ablation(ablation(config, hierarchy, mentions, gold, {"cross_encoder": select} if select else None, vectors), min(10, a.k)))
        return 0
    result = run(config, hierarchy, mentions, gold, vectors, select, timed=True)
    for row in result.scores:
        print(row)
    if a.output:
        sinks.save_results({a.command: result.as_record()}, f"{a.output}/results.json")
        sinks.save_json_lines(sinks.predictions(mentions, gold, result.rankings, hierarchy.titles), f"{a.output}/predictions")
    return 0


if __name__ == "__main__":
    sys.exit(main())
