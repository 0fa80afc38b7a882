"""Mentions as a stream: every micro-batch is placed against the static hierarchy and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.hierarchy import Hierarchy
from ..plans.placement import PlacementConfig, retrieve
from ..operators.enrichment import candidate_set


def mention_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("mention_id string, mention string, context_left string, context_right string").json(folder)


def place_stream(mentions: DataFrame, hierarchy: Hierarchy, out: str, checkpoint: str, config: PlacementConfig = PlacementConfig()) -> StreamingQuery:
    """Top-k per mention is no time window, so it runs per batch; a batch that is run again writes to
    the folder of its number, so that results come once."""

    def place(batch: DataFrame, number: int) -> None:
        found = retrieve(config, hierarchy, batch)
        ranked, _ = candidate_set(found, hierarchy.concepts, hierarchy.par, hierarchy.ch, config.k, config.use_enrichment, config.use_leaf_priority)
        ranked.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return mentions.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
