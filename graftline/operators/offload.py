"""Whole runs of the edge-and-cloud variant: what each configuration sends, summaries of measured runs,
and the placement of the candidates of documents into classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import encoding
from .extraction import SENT, class_of, fill_by_language, labelled_spans, latency_summary, outcome, parse_reply, payload, placement_score, span_candidates

# The configurations, and the bounds of a simulated confidence.
CONFIGURATIONS = ("cloud_only", "edge_only", "edge_cloud")
CONFIDENCE = (0.7, 0.95)
#: Class names of entity types.
TYPE_CLASSES = {"PERSON": "Agent", "ORGANIZATION": "Agent", "LOCATION": "Place", "EVENT": "Activity", "NARRATIVE": "AbstractConcept", "CONCEPT": "AbstractConcept", "TECHNOLOGY": "AbstractConcept", "MISC": "Entity"}


def costs(docs: DataFrame) -> DataFrame:
    """docs: doc_id (unique), text -> config, doc_id, bytes_sent, n_candidates: the whole text goes to the
    cloud, nothing goes, or the first candidates with their contexts go. All candidates are counted."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = span_candidates(docs).withColumn("_i", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    sent = F.sort_array(F.collect_list(F.when(F.col("_i") <= SENT, F.struct("pos", "span", "context"))))
    per = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), sent.alias("_c"))
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    made = payload(F.coalesce(F.col("_c.span"), none), F.coalesce(F.col("_c.context"), none))
    n = F.coalesce("_n", zero)
    row = lambda config, size, count: F.struct(F.lit(config).alias("config"), size.cast("bigint").alias("bytes_sent"), count.alias("n_candidates"))
    every = F.array(*[row(c, size, count) for c, size, count in zip(CONFIGURATIONS, (F.octet_length("text"), zero, F.octet_length(made)), (zero, n, n))])
    return docs.join(per, "doc_id", "left").select("doc_id", F.explode(every).alias("r")).select("r.config", "doc_id", "r.bytes_sent", "r.n_candidates")


def summary(runs: DataFrame) -> DataFrame:
    """runs: config, total_latency_ms, edge_latency_ms, cloud_latency_ms, bytes_sent, peak_mem_mb, a row per
    document -> one row per configuration. A run takes as long as its documents one after another."""
    latency = latency_summary(runs, "config", "total_latency_ms")
    rest = runs.where(F.col("total_latency_ms").isNotNull()).groupBy("config").agg(F.avg("edge_latency_ms").alias("edge_ms_mean"), F.avg("cloud_latency_ms").alias("cloud_ms_mean"), (F.avg("bytes_sent") / 1024).alias("bandwidth_kb_per_doc"), F.max("peak_mem_mb").alias("peak_memory_mb"))
    return latency.join(rest, "config").select("config", "n", F.col("mean").alias("latency_ms_mean"), F.col("median").alias("latency_ms_median"), F.col("p95").alias("latency_ms_p95"), "edge_ms_mean", "cloud_ms_mean",
                                               (1000 * F.col("throughput")).alias("throughput_docs_per_s"), "bandwidth_kb_per_doc", "peak_memory_mb")


def simulated_replies(classes: list[str], mapping: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Replies without a model: the class of the entity type, for a span without one a class by its hash,
    and a confidence by hash."""
    kind = F.coalesce("entity_type", F.concat(F.lit("span:"), "span"))
    share = F.pmod(F.xxhash64("span", "context"), F.lit(1_000_000)) / 1_000_000
    confidence = F.lit(CONFIDENCE[0]) + share * (CONFIDENCE[1] - CONFIDENCE[0])
    made = F.to_json(F.struct(F.lit(True).alias("valid"), class_of(kind, TYPE_CLASSES if mapping is None else mapping, classes).alias("class"), confidence.alias("confidence")))
    return lambda rows: rows.withColumn("reply", made)


def hashed_similarity(span: Column, name: Column) -> Column:
    return encoding.cosine(encoding.hashed_counts(span), encoding.hashed_counts(name))


def candidates(docs: DataFrame, limit: int = SENT) -> DataFrame:
    """doc_id, language, pos, span, start, end, entity_type, context: given entities, else capitalised tokens,
    the first of a document."""
    given = F.coalesce(F.size("entities"), F.lit(0)) > 0
    marked = labelled_spans(docs.where(given))
    found = span_candidates(docs.where(~given).select("doc_id", "text", "language"), limit=limit).withColumn("entity_type", F.lit(None).cast("string"))
    columns = ["doc_id", "language", "pos", "span", "start", "end", "entity_type", "context"]
    return marked.select(columns).unionByName(found.select(columns))


def place_documents(docs: DataFrame, classes: list[str], templates: dict[str, str], reason: Callable[[DataFrame], DataFrame] | None = None,
                    similarity: Callable[[Column, Column], Column] = hashed_similarity) -> DataFrame:
    """docs: doc_id (unique), text, language, entities -> doc_id, language, placements: of every document
    the candidates that a reply finds valid, with class, score and outcome, in order.

    ``reason`` adds ``reply`` to rows with ``prompt``; an unreadable reply counts with its defaults.
    ``classes`` are named in every prompt, so they are few.
    """
    rows = candidates(docs)
    rows = rows.withColumn("prompt", fill_by_language(templates, F.col("language"), candidate=F.col("span"), context=F.col("context"), classes=F.lit(", ".join(classes))))
    rows = (reason or simulated_replies(classes))(rows).withColumn("_r", parse_reply(F.col("reply"))).where("_r.valid")
    known = F.col("_r.class").isin(classes)
    alike = F.when(known, similarity(F.col("span"), F.col("_r.class"))).otherwise(0.0)
    rows = rows.withColumn("score", placement_score(alike, F.col("_r.confidence"), known))
    one = F.struct("pos", "span", "start", "end", F.col("_r.class").alias("ontology_class"), "score", outcome(F.col("score")).alias("decision"), F.col("_r.relations").alias("relations"))
    placed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("placements"))
    out = docs.select("doc_id", "language").join(placed, "doc_id", "left")
    return out.select("doc_id", "language", F.coalesce("placements", F.array().cast(placed.schema["placements"].dataType)).alias("placements"))


def outcome_counts(placed: DataFrame) -> DataFrame:
    """n_documents and how many placements have each outcome."""
    count = lambda v: F.sum(F.size(F.filter("placements", lambda p: p["decision"] == v))).cast("bigint")
    return placed.agg(F.count(F.lit(1)).alias("n_documents"), *[F.coalesce(count(v), F.lit(0)).alias(f"n_{n}") for v, n in (("auto_insert", "auto"), ("review_queue", "review"), ("discard", "discard"))])
