"""Splits that keep repeats together, aggregation of mention-edge pairs, dataset statistics."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_complex
from ..schemas import NULL_ID, SEED, SPLIT_RATIOS


def _named(position: Column, n: Column, ratios) -> Column:
    first, second = F.bround(n * ratios[0]), F.bround(n * (ratios[0] + ratios[1]))
    return F.when(position <= first, "train").when(position <= second, "valid").otherwise("test")


def make_splits(rows: DataFrame, key: list[str], ratios=SPLIT_RATIOS, seed: int = SEED, buckets: int = 1024) -> DataFrame:
    """Adds ``split``. Distinct keys are put in the order of a seeded hash and cut at the rounded
    ratios; equal keys share a split. Positions come from counts per hash bucket and ranks within."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    name = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    keyed = rows.withColumn("_key", name)
    keys = keyed.select("_key").distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key"))))
    keys = keys.withColumn("_b", (F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    per = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_b", before.alias("_before"), F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    placed = keys.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_key"))).join(F.broadcast(per), "_b")  # a row per bucket
    split = placed.select("_key", _named(F.col("_before") + F.col("_i"), F.col("_all"), ratios).alias("split"))
    return keyed.join(split, "_key").drop("_key")


def shuffled_splits(keys: list[str], ratios=SPLIT_RATIOS, seed: int = SEED) -> dict[str, str]:
    """The same cut over a seeded stdlib shuffle of the sorted distinct keys, for small key sets on the driver."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    order = sorted(set(keys))
    random.Random(seed).shuffle(order)
    a = round(ratios[0] * len(order))
    b = a + round(ratios[1] * len(order))
    return {k: "train" if i < a else "valid" if i < b else "test" for i, k in enumerate(order)}


def split_report(split: DataFrame) -> DataFrame:
    """(split, mention_ids): the ids of each split in order."""
    return split.groupBy("split").agg(F.sort_array(F.collect_list("mention_id")).alias("mention_ids"))


def aggregate_pairs(pairs: DataFrame, key: list[str], first_of: list[str], ord_col: str = "ord") -> DataFrame:
    """One row per key: scalars of its first row, the union of its gold edges, ordered by first sight."""
    firsts = [F.min_by(c, ord_col).alias(c) for c in first_of]
    gold = F.sort_array(F.collect_set(F.struct("parent_id", "child_id"))).alias("gold_edges")
    return pairs.groupBy(*key).agg(F.min(ord_col).alias("first_seen"), *firsts, gold)


def dataset_statistics(mentions: DataFrame, gold: DataFrame, depth: DataFrame, par: DataFrame, ch: DataFrame, group: str | None = None) -> DataFrame:
    """Counts of gold edges per mention, shares of single, leaf and other gold, mean depth and degree of
    gold parents. depth: id, depth. Complex parents have no depth, unknown ones no degree."""
    by = [group] if group else []
    per = mentions.join(gold, "mention_id", "left").groupBy(*by, "mention_id").agg(F.count("parent_id").alias("n"))
    counts = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_mentions"), F.sum("n").alias("n_edges"), F.avg("n").alias("mean_edges"), F.percentile("n", F.lit(0.5)).alias("median_edges"),
        (100.0 * F.count_if(F.col("n") == 1) / F.count(F.lit(1))).alias("single_share"))
    degree = par.select(F.col("child").alias("id")).unionByName(ch.select(F.col("parent").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    edges = mentions.join(gold, "mention_id").join(depth.withColumnRenamed("id", "parent_id"), "parent_id", "left").join(degree.withColumnRenamed("id", "parent_id"), "parent_id", "left")
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    shares = edges.groupBy(*by).agg(
        (100.0 * F.count_if(F.col("child_id") == NULL_ID) / total).alias("leaf_share"), (100.0 * F.count_if(F.col("child_id") != NULL_ID) / total).alias("other_share"),
        F.avg(F.when(~is_complex("parent_id"), F.col("depth"))).alias("mean_depth"), F.avg("degree").alias("mean_degree"))
    return counts.join(shares, by, "left") if by else counts.crossJoin(shares)


def statistics_table(stats: DataFrame, group: str = "split") -> DataFrame:
    """Statistics as rows, splits as columns; a missing value is '-'."""
    names = [c for c in stats.columns if c != group]
    long = stats.select(group, F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))).alias("statistic", "value"))
    wide = long.groupBy("statistic").pivot(group).agg(F.first("value"))
    return wide.select("statistic", *[F.when(F.col(f"`{c}`").isNull(), F.lit("-")).otherwise(F.format_string("%.2f", F.col(f"`{c}`"))).alias(c) for c in wide.columns if c != "statistic"])
