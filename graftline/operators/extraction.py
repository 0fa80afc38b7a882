"""Operators of the edge-and-cloud variant: span candidates, placement scores, payloads, latency
summaries, sibling negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import REPLY, SEED

# Weights and thresholds of the placement score, window and counts of candidates.
WEIGHTS = {"similarity": 0.35, "confidence": 0.30, "structure": 0.25, "conflict": 0.10}
AUTO_INSERT, REVIEW = 0.72, 0.55
CONTEXT = 60
SENT = 10
#: Runs whose lengths are summed together.
BLOCK = 64
#: Confidence and class of a reply that leaves them out.
DEFAULT_CONFIDENCE, DEFAULT_CLASS = 0.5, "Entity"


def span_candidates(docs: DataFrame, text: str = "text", digits: bool = False, limit: int | None = None) -> DataFrame:
    """Tokens that begin with a capital (or, with ``digits``, are all digits), with exact offsets and
    context: pos, span, start, end, context. Offsets add up the lengths of the runs before a token."""
    runs = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\s*)(\S+)"), 0)
    # Lengths are summed within the document's own array, without a shuffle, in two levels (the ends
    # of blocks of runs, then of the runs of each), as adding to an array copies it.
    ends = lambda lengths, first: F.slice(F.aggregate(lengths, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), 2, F.size(lengths))
    firsts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("_runs") - 1) / BLOCK), F.lit(0)).cast("int"))
    blocks = F.transform(firsts, lambda i: F.transform(F.slice("_runs", i * BLOCK + 1, F.lit(BLOCK)), lambda r: F.length(r)))
    sums = F.transform("_blocks", lambda b: F.aggregate(b, F.lit(0), lambda s, n: s + n))
    placed = F.transform(F.arrays_zip(F.col("_blocks").alias("b"), ends(sums, F.lit(0)).alias("end")), lambda z: ends(z["b"], z["end"] - F.aggregate(z["b"], F.lit(0), lambda s, n: s + n)))
    before = docs.select("*", runs.alias("_runs")).select("*", blocks.alias("_blocks"))
    rows = before.select(*docs.columns, F.posexplode(F.arrays_zip(F.col("_runs").alias("run"), F.flatten(placed).alias("end"))).alias("pos", "_r"))
    span = F.regexp_replace(F.col("_r.run"), r"(?U)^\s+", "")
    rows = rows.select(*docs.columns, "pos", span.alias("span"), (F.col("_r.end") - F.length(span)).alias("start"), F.col("_r.end").alias("end"))
    wanted = F.rlike("span", F.lit(r"^\p{Lu}"))
    if digits:
        wanted = wanted | F.rlike("span", F.lit(r"^\p{Nd}+$"))
    low = F.greatest(F.col("start") - CONTEXT, F.lit(0))
    context = F.substring(F.col(text), low + 1, F.least(F.col("end") + CONTEXT, F.length(text)) - low)
    out = rows.where(wanted).withColumn("context", context)
    if limit is not None:
        key = docs.columns[0]
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= limit).drop("_n")
    return out


def labelled_spans(docs: DataFrame) -> DataFrame:
    """Given entities (start, end, type) as candidates, the text cut by their offsets; the first of them count."""
    e = docs.select("*", F.posexplode(F.slice("entities", 1, SENT)).alias("pos", "e"))
    low = F.greatest(F.col("e.start") - CONTEXT, F.lit(0))
    kept = [c for c in docs.columns if c not in ("text", "entities")]
    return e.select(*kept, "pos", F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("span"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.type").alias("entity_type"),
                    F.substring(F.col("text"), low + 1, F.least(F.col("e.end") + CONTEXT, F.length("text")) - low).alias("context"))


def parse_reply(reply: Column) -> Column:
    """A model's JSON reply with its defaults: valid, class, confidence, relations."""
    r = F.from_json(reply, REPLY)
    return F.struct(F.coalesce(r["valid"], F.lit(True)).alias("valid"), F.coalesce(r["class"], F.lit(DEFAULT_CLASS)).alias("class"), F.coalesce(r["confidence"], F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
                    F.coalesce(r["relations"], F.array().cast("array<struct<head:string,relation:string,tail:string>>")).alias("relations"))


def class_of(entity_type: Column, mapping: dict[str, str], classes: list[str]) -> Column:
    """Mapped class of a type; an unmapped one gets a class by its hash, so reruns agree."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    by_hash = F.element_at(F.array(*[F.lit(c) for c in classes]), (F.pmod(F.xxhash64(entity_type), F.lit(len(classes))) + 1).cast("int"))
    return F.coalesce(table[entity_type], by_hash)


def placement_score(similarity: Column, confidence: Column, known: Column, conflict: Column | float = 0.0) -> Column:
    c = conflict if isinstance(conflict, Column) else F.lit(float(conflict))
    return WEIGHTS["similarity"] * similarity + WEIGHTS["confidence"] * confidence + WEIGHTS["structure"] * F.when(known, 1.0).otherwise(0.0) - WEIGHTS["conflict"] * c


def outcome(score: Column) -> Column:
    return F.when(score >= AUTO_INSERT, "auto_insert").when(score >= REVIEW, "review_queue").otherwise("discard")


def payload(spans: Column, contexts: Column) -> Column:
    """First candidates with their contexts, as one text."""
    lines = F.transform(F.slice(F.arrays_zip(spans.alias("s"), contexts.alias("c")), 1, SENT), lambda e: F.concat(F.lit("CANDIDATE: "), e["s"], F.lit("\nCONTEXT: "), e["c"]))
    return F.when(F.size(spans) > 0, F.array_join(lines, "\n---\n")).otherwise(F.lit("NO_CANDIDATES"))


def fill_template(template: str, **fields: Column) -> Column:
    """The template cut at its fields on the driver, so that texts are never substituted again."""
    import re

    parts = [p for p in re.split(r"(\{\{|\}\}|\{\w+\})", template) if p]
    made = [F.lit(p[0]) if p in ("{{", "}}") else fields[p[1:-1]] if p[0] == "{" and p[1:-1] in fields else F.lit(p) for p in parts]
    return F.concat(*made) if made else F.lit("")


def fill_by_language(templates: dict[str, str], of: Column, default: str = "en", /, **fields: Column) -> Column:
    """The template of the language, else the default language's, else nothing, with its fields filled."""
    out = fill_template(templates.get(default, ""), **fields)
    for name, template in templates.items():
        if name != default:
            out = F.when(of == name, fill_template(template, **fields)).otherwise(out)
    return out


#: Parts that the values of a group are cut into for order statistics.
PARTS = 64


def order_statistics(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact values at 1-based ranks of each group, by name; a rank is given in terms of ``n``. Rows
    without a value don't count.

    Approximate quantiles cut a group into parts, equal values are counted together, and only parts that
    hold a rank are sorted, so no task sorts or holds a whole group.
    """
    rows = rows.select(by, value).where(F.col(value).isNotNull())
    cuts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], 10_000).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c <= F.col(value))).alias("_part")
    tally = rows.join(cuts, by).groupBy(by, value, part).agg(F.count(F.lit(1)).alias("_n"))
    parts = tally.groupBy(by, "_part").agg(F.sum("_n").alias("_all"))
    before = F.sum("_all").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # at most PARTS rows
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).join(cuts.select(by, "n"), by)
    inside = lambda rank, low, size: (rank > low) & (rank <= low + size)
    held = F.lit(False)
    for rank in ranks.values():
        held = held | inside(rank, F.col("_before"), F.col("_all"))
    upto = F.sum("_n").over(Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    ranked = tally.join(parts.where(held), [by, "_part"]).withColumn("_low", upto - F.col("_n"))
    return ranked.groupBy(by).agg(*[F.max(F.when(inside(rank, F.col("_low"), F.col("_n")), F.col(value))).alias(name) for name, rank in ranks.items()])


def latency_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, median, p95 (the sorted value at floor(0.95 n) - 1, the only one of one) and throughput per
    group, of the rows with a value."""
    n = F.col("n")
    places = order_statistics(rows, by, value, {"_a": F.floor((n + 1) / 2), "_b": F.floor(n / 2) + 1, "p95": F.greatest(F.floor(n * 0.95), F.lit(1))})
    sums = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.try_divide(F.count(F.lit(1)), F.sum(value)), F.lit(0.0)).alias("throughput"))
    return sums.join(places, by).select(by, "n", "mean", ((F.col("_a") + F.col("_b")) / 2).alias("median"), "p95", "throughput")


def reduction(part: Column, whole: Column) -> Column:
    return (1 - part / F.greatest(whole, F.lit(1e-9))) * 100


def siblings(classes: DataFrame) -> DataFrame:
    """classes: name, parent -> (name, siblings); those without a parent or alone have none."""
    pairs = classes.alias("a").join(classes.alias("b"), F.col("a.parent") == F.col("b.parent")).where(F.col("a.name") != F.col("b.name"))
    found = pairs.groupBy(F.col("a.name").alias("name")).agg(F.sort_array(F.collect_set("b.name")).alias("siblings"))
    return classes.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("siblings", F.array().cast("array<string>")).alias("siblings"))


def contrastive_pairs(anchors: DataFrame, classes: DataFrame, hard: int = 3, easy: int = 1, seed: int = SEED) -> DataFrame:
    """anchors: anchor_id, name -> (anchor_id, name, kind, negative, place): hard negatives are siblings,
    filled up from all classes, and an easy one is any other class. Order is by a seeded hash; classes
    are told apart once per class name, not per anchor."""
    names = classes.select("name", "parent").distinct()
    others = names.select(F.col("name").alias("negative"), F.col("parent").alias("_p")).distinct()
    wanted = anchors.select("name").distinct().join(names, "name", "left")
    key = lambda kind: F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(kind), F.col("name"), F.col("negative")))
    met = wanted.join(others, F.col("name") != F.col("negative")).groupBy("name", "negative").agg(F.max(F.coalesce((F.col("parent") == F.col("_p")).cast("int"), F.lit(0))).alias("near"))
    first = met.withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("near"), key("hard"), "negative")))
    strong = first.where(F.col("i") <= hard).select("name", F.lit("hard").alias("kind"), "negative", F.col("i").alias("place"))
    rest = first.where(F.col("i") > hard).withColumn("j", F.row_number().over(Window.partitionBy("name").orderBy(key("easy"), "negative"))).where(F.col("j") <= easy)
    return anchors.join(strong.unionByName(rest.select("name", F.lit("easy").alias("kind"), "negative", F.col("j").alias("place"))), "name").select("anchor_id", "name", "kind", "negative", "place")
