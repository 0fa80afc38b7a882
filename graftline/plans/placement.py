"""Whole runs: retrieve, enrich, select, evaluate; ablations as variants of one pool."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import enrichment, metrics, retrieval, validation
from ..operators.hierarchy import Hierarchy
from ..schemas import K_VALUES, SEED, TOP_CONCEPTS

RETRIEVERS = ("inverted_index", "fixed_embeddings", "bi_encoder")
SELECTORS = (None, "cross_encoder", "llm_zero_shot", "llm_tuned")


@dataclass(frozen=True)
class PlacementConfig:
    retriever: str = "inverted_index"
    selector: str | None = None
    n_retrieved: int = TOP_CONCEPTS
    k: int = max(K_VALUES)
    use_enrichment: bool = True
    use_leaf_priority: bool = True
    edge_catalogue: str = "all"
    seed: int = SEED
    k_values: tuple[int, ...] = K_VALUES
    null_similarity: float = 0.0

    def __post_init__(self):
        if self.retriever not in RETRIEVERS:
            raise ValueError(f"unknown retriever {self.retriever!r}")
        if self.selector not in SELECTORS:
            raise ValueError(f"unknown selector {self.selector!r}")


@dataclass
class RunResult:
    config: dict
    scores: list[dict]
    enrichment: dict
    validity: dict
    timing_ms: dict = field(default_factory=dict)
    rankings: DataFrame | None = None

    def as_record(self) -> dict:
        return {"config": self.config, "scores": {str(s["k"]): s for s in self.scores}, "enrichment": self.enrichment, "validity": self.validity, "timing_ms": self.timing_ms}


def retrieve(config: PlacementConfig, hierarchy: Hierarchy, mentions: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Stage one: (mention_id, concept_id, score, rank). Dense retrievers take vectors of the mentions
    and of the concepts, or (bi_encoder) of the edges, whose ends are then the concepts in order."""
    if config.retriever == "inverted_index":
        index = retrieval.build_index(hierarchy.concepts, "id", retrieval.concept_tokens("title", "synonyms"), "ord")
        found = retrieval.bm25_topk(index, mentions, "mention_id", tokens("mention"), config.n_retrieved)
        return found.select(F.col("query").alias("mention_id"), F.col("doc").alias("concept_id"), "score", "rank")
    if vectors is None:
        raise ValueError("a dense retriever needs vectors")
    found = retrieval.dense_topk(*vectors, config.n_retrieved, "cosine" if config.retriever == "fixed_embeddings" else "dot")
    if config.retriever == "fixed_embeddings":
        return found.select(F.col("query").alias("mention_id"), F.col("id").alias("concept_id"), "score", "rank")
    edges = _edges_found(found)
    ends = enrichment.endpoint_order(edges)
    best = edges.select("mention_id", F.explode(F.array("parent_id", "child_id")).alias("concept_id"), "score").groupBy("mention_id", "concept_id").agg(F.max("score").alias("score"))
    return ends.join(best, ["mention_id", "concept_id"])


def _edges_found(found: DataFrame) -> DataFrame:
    end = lambda n: F.substring_index("id", enrichment.EDGE_MARK, n)
    return found.select(F.col("query").alias("mention_id"), end(1).alias("parent_id"), end(-1).alias("child_id"), "score", "rank")


def retrieve_edges(config: PlacementConfig, vectors: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Stage one of the bi-encoder: the nearest edges of every mention, from which enrichment starts."""
    return _edges_found(retrieval.dense_topk(*vectors, config.n_retrieved, "dot"))


def run(config: PlacementConfig, hierarchy: Hierarchy, mentions: DataFrame, gold: DataFrame, vectors=None,
        select: Callable[[DataFrame], DataFrame] | None = None, validate: bool = True, timed: bool = False) -> RunResult:
    """All stages as one plan, evaluated at the given ks and at k; ``select`` re-ranks the candidates."""
    timing: dict[str, float] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        if timed:
            df, start = df.cache(), time.perf_counter()
            n = max(1, mentions.count())
            df.count()
            timing[name] = 1000 * (time.perf_counter() - start) / n
        return df

    retrieved = stage("retrieve", retrieve(config, hierarchy, mentions, vectors).cache())
    seeds = None
    if config.retriever == "bi_encoder":  # the pool holds edges that weren't retrieved: all are scored anew
        seeds, scorer = retrieve_edges(config, vectors), lambda e: enrichment.dot_scores(e, *vectors)
    else:
        scorer = (lambda e: enrichment.endpoint_scores(e, retrieved, config.null_similarity)) if config.null_similarity else None
    candidates, sizes = enrichment.candidate_set(retrieved, hierarchy.concepts, hierarchy.par, hierarchy.ch, config.k, config.use_enrichment, config.use_leaf_priority, scorer, seeds)
    candidates = stage("enrich", candidates.cache())
    if config.selector is not None and select is None:
        raise ValueError(f"selector {config.selector!r} needs a function")
    rankings = stage("select", select(candidates)) if select else candidates
    ks = tuple(sorted({*config.k_values, config.k}))
    scores = metrics.placement_scores(metrics.per_mention(mentions, gold, rankings, ks), ks)
    validity = validation.summarise(validation.validate_first(rankings, hierarchy.ch)).first().asDict() if validate else {}
    return RunResult(asdict(config), [r.asDict() for r in scores.collect()], enrichment.enrichment_statistics(sizes).first().asDict(), validity, timing, rankings)


def ablation(config: PlacementConfig, hierarchy: Hierarchy, mentions: DataFrame, gold: DataFrame, selectors: dict[str, Callable] | None = None, vectors=None) -> dict[str, RunResult]:
    """Retrieval alone, with enrichment, with each selector, and the whole without the leaf rule (with
    the configured selector if it is among the given ones). The configured leaf rule holds elsewhere."""
    selectors = selectors or {}
    one = lambda select=None, **switches: run(replace(config, **switches), hierarchy, mentions, gold, vectors, select)
    out = {"retrieval only": one(use_enrichment=False, selector=None), "+ enrichment": one(use_enrichment=True, selector=None)}
    for name, select in selectors.items():
        out[f"+ {name}"] = one(select, use_enrichment=True, selector=name)
    last = config.selector if config.selector in selectors else None
    out["- leaf priority"] = one(selectors.get(last), use_enrichment=True, use_leaf_priority=False, selector=last)
    return out


def format_ablation(results: dict[str, RunResult], k: int = 10) -> str:
    lines = ["configuration\tInR_any\tInR_all\tMRR"]
    for name, r in results.items():
        at = next((s for s in r.scores if s["k"] == k), None) or {"inr_any": 0.0, "inr_all": 0.0, "mrr": 0.0}
        lines.append(f"{name}\t{100 * at['inr_any']:.1f}\t{100 * at['inr_all']:.1f}\t{at['mrr']:.3f}")
    return "\n".join(lines)
