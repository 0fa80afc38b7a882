"""Third stage: labelled examples, re-ranking by a model, by chosen places, by a language model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..schemas import LLM_MAX_CANDIDATES
from .enrichment import EDGE


def cross_examples(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates with label 1 where they are gold, else 0."""
    marked = gold.select(*EDGE).distinct().withColumn("_gold", F.lit(1))
    return candidates.join(marked, EDGE, "left").select(*candidates.columns, F.coalesce("_gold", F.lit(0)).alias("label"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rerank(candidates: DataFrame, score: str = "model_score") -> DataFrame:
    """The same candidates by model score, then parent and child."""
    order = Window.partitionBy("mention_id").orderBy(F.desc(score), F.asc("parent_id"), F.asc("child_id"))
    return candidates.select(*EDGE, score, F.row_number().over(order).alias("rank"))


def scored_edges(candidates: DataFrame, logit: str = "logit") -> DataFrame:
    """Candidates by probability; equal ones keep their order."""
    p = candidates.withColumn("probability", sigmoid(F.col(logit)))
    return p.withColumn("new_rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("probability"), F.asc("rank"))))


def rerank_from_places(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """selected: mention_id, places (0-based, in order): the named candidates first, the rest as before."""
    named = selected.select("mention_id", F.posexplode("places").alias("_at", "_place")).select("mention_id", "_at", (F.col("_place") + 1).alias("rank"))
    joined = candidates.join(named, ["mention_id", "rank"], "left")
    order = Window.partitionBy("mention_id").orderBy(F.asc_nulls_last("_at"), F.asc("rank"))
    return joined.select(*EDGE, F.col("rank").alias("old_rank"), F.row_number().over(order).alias("rank"))


class LogisticSelector:
    """Pair classifier with the cross-entropy objective of a linear head: ``pyspark.ml`` logistic
    regression on numeric features of a candidate."""

    def __init__(self, features: list[str], max_iter: int = 50):
        self.features, self.max_iter, self.model = features, max_iter, None

    def fit(self, examples: DataFrame) -> "LogisticSelector":
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        steps = [VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep"), LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", maxIter=self.max_iter)]
        self.model = Pipeline(stages=steps).fit(examples)
        return self

    def rerank(self, candidates: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(candidates).withColumn("model_score", vector_to_array("_probability")[1])
        return rerank(scored)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, features: list[str]) -> "LogisticSelector":
        from pyspark.ml import PipelineModel

        out = cls(features)
        out.model = PipelineModel.load(path)
        return out


def prompt_rows(mentions: DataFrame, candidates: DataFrame, limit: int = LLM_MAX_CANDIDATES, explain: bool = True) -> DataFrame:
    """One prompt per mention over its first candidates (with titles ``parent`` and ``child``)."""
    few = candidates.where(F.col("rank") <= limit)
    lists = few.groupBy("mention_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "parent", "child"))), lambda e: F.struct(e["parent"].alias("parent"), e["child"].alias("child"))).alias("candidates"))
    return mentions.join(lists, "mention_id").withColumn("prompt", prompts.build_prompt(F.col("context_left"), F.col("mention"), F.col("context_right"), F.col("candidates"), explain=explain))


def select_by_model(rows: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """Runs an injected prompt -> reply function batch by batch; adds reply, places and explanation."""
    schema = "mention_id string, n int, reply string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"mention_id": f["mention_id"], "n": f["n"], "reply": generate(f["prompt"].tolist())})

    replies = rows.select(F.col("mention_id").cast("string"), F.size("candidates").alias("n"), "prompt").mapInPandas(run, schema)
    return replies.select("mention_id", "reply", prompts.parse_response(F.col("reply"), F.col("n")).alias("places"), prompts.extract_explanation(F.col("reply")).alias("explanation"))


def triplet_loss(positive: Column, negatives: Column, margin: float) -> Column:
    """Mean over the negatives of max(0, margin + negative - positive)."""
    losses = F.transform(negatives, lambda s: F.greatest(F.lit(0.0), margin + s - positive))
    return F.coalesce(F.try_divide(F.aggregate(losses, F.lit(0.0), lambda a, x: a + x), F.size(negatives)), F.lit(0.0))


def bce_loss(logit: Column, label: Column) -> Column:
    """Binary cross-entropy on a logit, in the form that doesn't overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log(1 + F.exp(-F.abs(logit)))


def info_nce(positive: Column, negatives: Column, temperature: float = 0.07) -> Column:
    """Cross-entropy of the positive against the negatives, shifted by the largest."""
    scaled = F.transform(F.concat(F.array(positive), negatives), lambda s: s / temperature)
    top = F.array_max(scaled)
    total = F.aggregate(F.transform(scaled, lambda s: F.exp(s - top)), F.lit(0.0), lambda a, x: a + x)
    return F.log(total) + top - positive / temperature
