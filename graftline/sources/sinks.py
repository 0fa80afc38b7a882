"""Writers: run results, predictions, tables, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrichment import EDGE
from . import files


def save_text(text: str, path: str, spark: SparkSession | None = None) -> None:
    """A report or table as one small file of the cluster's file system."""
    files.write_text(spark or SparkSession.active(), path, text)


def save_results(results: dict[str, dict], path: str, spark: SparkSession | None = None) -> None:
    """Small result records by run name, as one JSON object."""
    save_text(json.dumps(results, ensure_ascii=False, indent=2), path, spark)


def predictions(mentions: DataFrame, gold: DataFrame, rankings: DataFrame, titles: DataFrame, top_k: int = 10) -> DataFrame:
    """One row per mention, also without predictions: mention_id, mention, predictions, gold_edges."""
    name = lambda c, out: titles.select(F.col("id").alias(c), F.col("title").alias(out))
    top = rankings.where(F.col("rank") <= top_k).join(name("parent_id", "parent"), "parent_id", "left").join(name("child_id", "child"), "child_id", "left")
    top = top.join(gold.select(*EDGE).distinct().withColumn("_gold", F.lit(True)), EDGE, "left")
    row = F.struct("rank", F.col("parent_id").alias("parent_concept"), F.col("child_id").alias("child_concept"), F.coalesce("parent", "parent_id").alias("parent"), F.coalesce("child", F.when(F.col("child_id") == "SCTID_NULL", "NULL").otherwise(F.col("child_id"))).alias("child"), F.coalesce("_gold", F.lit(False)).alias("is_gold"))
    listed = top.groupBy("mention_id").agg(F.sort_array(F.collect_list(row)).alias("predictions"))
    right = gold.groupBy("mention_id").agg(F.sort_array(F.collect_set(F.struct("parent_id", "child_id"))).alias("gold_edges"))
    out = mentions.select("mention_id", "mention").join(listed, "mention_id", "left").join(right, "mention_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("mention_id", "mention", empty("predictions"), empty("gold_edges"))


def save_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def as_table(rows: list[dict], columns: list[str], digits: int = 1) -> str:
    """Tab-separated text of a few records; a missing value is 'n/a'."""
    cell = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["\t".join(columns), *("\t".join(cell(r.get(c)) for c in columns) for r in rows)])


# Columns of the result table and the columns of ``metrics.as_percent_row`` that fill them.
SHARES = {"InR_any": "inr_any", "InR_all": "inr_all", "InR_any_lf": "inr_any_leaf", "InR_all_lf": "inr_all_leaf", "InR_any_nlf": "inr_any_other", "InR_all_nlf": "inr_all_other"}
MEANS = {"MRR": "mrr", "MAP": "map"}


def score_table(rows: list[tuple[str, int, dict, dict | None]]) -> str:
    """Rows of (name, k, validation record, test record): cells are 'validation / test', or the first alone
    where there is no test record. Records are rows of ``metrics.as_percent_row``."""
    def cell(column: str, digits: int, *records: dict | None) -> str:
        return " / ".join(f"{r[column]:.{digits}f}" for r in records if r is not None)

    lines = [["Model / Set", "k", *SHARES, *MEANS]]
    for name, k, *records in rows:
        lines.append([name, str(k), *(cell(c, 1, *records) for c in SHARES.values()), *(cell(c, 3, *records) for c in MEANS.values())])
    return "\n".join("\t".join(x) for x in lines)


# Names of the statistics report and the columns of ``splits.dataset_statistics``.
STATISTICS = {"mentions": "n_mentions", "gold_edges_total": "n_edges", "mean_gold_edges_per_mention": "mean_edges", "median_gold_edges_per_mention": "median_edges", "single_gold_edge_pct": "single_share",
              "leaf_pct": "leaf_share", "non_leaf_pct": "other_share", "mean_depth": "mean_depth", "mean_degree": "mean_degree"}


def statistics_report(stats: DataFrame, counts: dict[str, int], order: list[str], group: str = "split") -> str:
    """Statistics as lines and splits, in the given order, as columns, a missing value being '-'; then the
    counts of the hierarchy by name. stats has a row per split."""
    found = {r[group]: r.asDict() for r in stats.collect()}
    value = lambda v: "-" if v is None else f"{v:.2f}"
    lines = [["Statistic", *order], *([name, *(value(found.get(s, {}).get(c)) for s in order)] for name, c in STATISTICS.items()), *([k, str(v)] for k, v in counts.items())]
    return "\n".join("\t".join(x) for x in lines)


def hierarchy_counts(hierarchy) -> dict[str, int]:
    """Sizes of a hierarchy, for the report. Edges are counted as the catalogues state them."""
    # Names of the lines.
    return {"concepts (|V|)": hierarchy.concepts.count(), "atomic edges": hierarchy.edges_atomic.count(), "edge catalogue (|E|)": hierarchy.edges_catalogue.count()}


# Configurations in order with their labels, headings with the column and format of each.
SYSTEMS = {"cloud_only": r"Cloud-only (raw text $\to$ LLM)", "edge_only": "Edge-only (PLM, no reasoning)", "edge_cloud": "Proposed edge--cloud"}
SYSTEM_COLUMNS = {"Latency (ms)": ("latency_ms_mean", ".0f"), "Throughput (docs/s)": ("throughput_docs_per_s", ".2f"), "Bandwidth (KB/doc)": ("bandwidth_kb_per_doc", ".2f"), "Edge memory (MB)": ("peak_memory_mb", ".0f")}
CAPTION, LABEL = "System-level evaluation: latency, throughput, bandwidth and edge memory.", "tab:system"


def system_latex(summary: dict[str, dict]) -> str:
    """LaTeX table of collected rows of ``offload.summary`` by configuration; absent ones are left out."""
    body = [" & ".join(["Configuration", *SYSTEM_COLUMNS]), *(" & ".join([label, *(format(summary[k][c], f) for c, f in SYSTEM_COLUMNS.values())]) for k, label in SYSTEMS.items() if k in summary)]
    head, *rest = (line + r" \\" for line in body)
    columns = "l" + "c" * len(SYSTEM_COLUMNS)
    return "\n".join([r"\begin{table}[h]", r"\centering", rf"\caption{{{CAPTION}}}", rf"\label{{{LABEL}}}", rf"\begin{{tabular}}{{{columns}}}", r"\hline", head, r"\hline", *rest, r"\hline", r"\end{tabular}", r"\end{table}"])
