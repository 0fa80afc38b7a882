"""Ranking metrics per mention and macro averages; a mention without a ranking is a miss.

mentions: mention_id; gold: mention_id, parent_id, child_id; rankings: the same with rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import K_VALUES, NULL_ID
from .enrichment import EDGE


def gold_hits(gold: DataFrame, rankings: DataFrame) -> DataFrame:
    """Gold edges with their rank, null where they aren't ranked."""
    return gold.select(*EDGE).distinct().join(rankings.select(*EDGE, "rank"), EDGE, "left")


def per_mention(mentions: DataFrame, gold: DataFrame, rankings: DataFrame, k_values=K_VALUES) -> DataFrame:
    """One row per mention: n_gold, n_leaf, n_other, rr, ap, and for every k any/all flags over all
    gold edges, over leaf ones and over the others."""
    hits = gold_hits(gold, rankings).withColumn("leaf", F.col("child_id") == NULL_ID)
    nth = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.asc_nulls_last("rank")))
    hits = hits.withColumn("nth", F.when(F.col("rank").isNotNull(), nth))
    parts: dict[str, Column] = {"": F.lit(True), "_leaf": F.col("leaf"), "_other": ~F.col("leaf")}
    aggs = [F.count_if(cond).alias(f"n{p or '_gold'}") for p, cond in parts.items()]
    aggs += [F.min("rank").alias("first"), F.sum(F.col("nth") / F.col("rank")).alias("precision_sum")]
    for k in k_values:
        aggs += [F.count_if(cond & (F.col("rank") <= k)).alias(f"in{p}_{k}") for p, cond in parts.items()]
    found = mentions.select("mention_id").join(hits.groupBy("mention_id").agg(*aggs), "mention_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    out = [F.col("mention_id"), n("n_gold").alias("n_gold"), n("n_leaf").alias("n_leaf"), n("n_other").alias("n_other"),
           F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.try_divide(F.col("precision_sum"), F.col("n_gold")), F.lit(0.0)).alias("ap")]
    for k in k_values:
        for p in parts:
            inside, whole = n(f"in{p}_{k}"), n(f"n{p or '_gold'}")
            out += [(inside > 0).alias(f"any{p}_{k}"), ((inside == whole) & (whole > 0)).alias(f"all{p}_{k}")]
    return found.select(*out)


def placement_scores(per: DataFrame, k_values=K_VALUES) -> DataFrame:
    """One row per k: shares over all mentions, and of mentions with a leaf or another gold edge."""
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(F.col(hit) & of), F.count_if(of)), F.lit(0.0))
    every, leaf, other = F.lit(True), F.col("n_leaf") > 0, F.col("n_other") > 0
    aggs = [F.count(F.lit(1)).alias("n_mentions"), F.count_if(leaf).alias("n_leaf_mentions"), F.count_if(other).alias("n_other_mentions"),
            F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map")]
    for k in k_values:
        aggs += [F.struct(F.lit(k).alias("k"), share(f"any_{k}", every).alias("inr_any"), share(f"all_{k}", every).alias("inr_all"), share(f"any_leaf_{k}", leaf).alias("inr_any_leaf"),
                          share(f"all_leaf_{k}", leaf).alias("inr_all_leaf"), share(f"any_other_{k}", other).alias("inr_any_other"), share(f"all_other_{k}", other).alias("inr_all_other")).alias(f"at_{k}")]
    one = per.agg(*aggs)
    return one.select("n_mentions", "n_leaf_mentions", "n_other_mentions", "mrr", "map", F.explode(F.array(*[F.col(f"at_{k}") for k in k_values])).alias("at")).select("at.*", "mrr", "map", "n_mentions", "n_leaf_mentions", "n_other_mentions")


def as_percent_row(scores: DataFrame, k: int) -> DataFrame:
    """Flat record at one k: shares in per cent, mrr and map as they are; an absent k gives zeros."""
    shares = ["inr_any", "inr_all", "inr_any_leaf", "inr_all_leaf", "inr_any_other", "inr_all_other"]
    at = F.col("k") == k
    return scores.agg(*[F.coalesce(F.max(F.when(at, 100 * F.col(c))), F.lit(0.0)).alias(c) for c in shares], F.coalesce(F.max("mrr"), F.lit(0.0)).alias("mrr"), F.coalesce(F.max("map"), F.lit(0.0)).alias("map"))


def _resample(seed: int):
    """Sum of the differences in each resample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for x in batch.select(["r", "n", "below", "above"]).to_pylist():
                n = max(1, x["n"])
                low, high, _ = np.random.default_rng((seed, x["r"])).multinomial(x["n"], [x["below"] / n, x["above"] / n, max(0.0, 1 - (x["below"] + x["above"]) / n)])
                sums.append(int(high - low))
            yield pa.RecordBatch.from_arrays([batch.column("r"), batch.column("n"), batch.column("observed"), pa.array(sums, pa.int64())], ["r", "n", "observed", "s"])

    return run


def paired_bootstrap(a: DataFrame, b: DataFrame, column: str, n_resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of the mean difference of a per-mention flag: observed, p_value, low, high.

    A resample draws n mentions with replacement. All it depends on is how many of them have each
    difference, so each is one multinomial draw, seeded by (seed, resample), whatever n.
    """
    diff = a.select("mention_id", F.col(column).cast("int").alias("x")).join(b.select("mention_id", F.col(column).cast("int").alias("y")), "mention_id", "full")
    diff = diff.select("mention_id", (F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))).alias("d"))
    tally = diff.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") < 0).alias("below"), F.count_if(F.col("d") > 0).alias("above"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("observed"))
    resamples = a.sparkSession.range(n_resamples).withColumnRenamed("id", "r").crossJoin(F.broadcast(tally))
    sums = resamples.mapInArrow(_resample(seed), "r bigint, n bigint, observed double, s bigint").select("r", "observed", F.coalesce(F.try_divide(F.col("s"), F.col("n")), F.lit(0.0)).alias("d"))
    w = Window.orderBy("d", "r")  # one row per resample
    ranked = sums.withColumn("at", F.row_number().over(w) - 1)
    low, high = int(0.025 * n_resamples), min(n_resamples - 1, int(0.975 * n_resamples))
    out = ranked.agg(F.max("observed").alias("observed"), (F.count_if(F.abs(F.col("d") - F.col("observed")) >= F.abs("observed"))).alias("extreme"), F.max(F.when(F.col("at") == low, F.col("d"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("d"))).alias("high"))
    return out.select((100 * F.col("observed")).alias("observed"), ((F.col("extreme") + 1) / (n_resamples + 1)).alias("p_value"), (100 * F.col("low")).alias("low"), (100 * F.col("high")).alias("high"))


def table_row(scores: DataFrame, k: int, name: str) -> DataFrame:
    """One tab-separated line of an ablation or result table."""
    row = as_percent_row(scores, k)
    return row.select(F.concat_ws("\t", F.lit(name), F.format_string("%.1f", "inr_any"), F.format_string("%.1f", "inr_all"), F.format_string("%.3f", "mrr")).alias("line"))
