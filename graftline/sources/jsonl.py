"""Readers of the JSONL data model: part files, entity and edge catalogues, mentions, edge pairs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import gold_edges, is_out_of_kb, split_pipe, strip
from ..operators.hierarchy import Hierarchy
from . import files


def resolve_sources(path: str, spark: SparkSession | None = None) -> list[str]:
    """The file itself, else its numbered parts in order; the whole file wins over parts."""
    spark = spark or SparkSession.active()
    if files.exists(spark, path):
        return [path]
    folder, name = files.split_path(path)
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if stem else (name, "")
    parts = [f"{folder}/{n}" for n in files.names(spark, folder) if n.startswith(f"{stem}_part_") and n.endswith(suffix)]
    if not parts:
        raise FileNotFoundError(f"neither {path} nor {stem}_part_*{suffix} in {folder}")
    return parts


def find_file(folder: str, suffix: str, spark: SparkSession | None = None) -> str:
    """First file of a folder, by name, that ends with the suffix."""
    found = [n for n in files.names(spark or SparkSession.active(), folder) if n.endswith(suffix)]
    if not found:
        raise FileNotFoundError(f"no *{suffix} in {folder}")
    return f"{folder.rstrip('/')}/{found[0]}"


# The folders of a dataset and the stems of its files.
FOLDERS = {"ontology": "ontology", "mentions": "mention-level-(concept-placement)", "pairs": "mention-edge-pair-level"}
MENTION_FILES = {"train": "train", "valid": "valid", "valid_nil": "valid-NIL", "test_nil": "test-NIL", "test_nil_all": "test-NIL-all", "test_in_kb": "test-in-KB"}
PAIR_FILES = {"train": "train", "valid": "valid", "valid_nil": "valid-NIL", "test_nil": "test-NIL", "test_nil_all": "test-NIL-all"}


def dataset_paths(root: str, dataset: str) -> dict[str, str]:
    """Where the files of a dataset lie."""
    base = f"{root.rstrip('/')}/{dataset}"
    out = {"root": base} | {k: f"{base}/{v}" for k, v in FOLDERS.items()}
    for kind, folder, stems in (("mention", "mentions", MENTION_FILES), ("pair", "pairs", PAIR_FILES)):
        out |= {f"{kind}_{k}": f"{out[folder]}/{v}.jsonl" for k, v in stems.items()}
    return out


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ord, value): the lines that aren't blank, without byte order marks, numbered through all files.

    Lines are numbered within their block of a file by the task that reads it, and blocks by counts per
    block, a small table: no line is shuffled or sorted. Both passes must cut files into the same
    blocks; where they don't, the query fails.
    """
    block = F.struct(F.col("_part"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    lines = None
    for i, p in enumerate(paths):
        one = spark.read.text(p).withColumn("_part", F.lit(i)).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), block.alias("_block"))
        lines = one if lines is None else lines.unionByName(one)
    lines = lines.where(strip("value") != "").withColumn("_at", F.monotonically_increasing_id())
    blocks = lines.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row per block
    blocks = blocks.select("_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = lines.join(F.broadcast(blocks), "_block", "left")
    failed = F.raise_error(F.lit("files were cut into other blocks while lines were numbered")).cast("bigint")
    return placed.select(F.coalesce(F.col("_before") + F.col("_at") - F.col("_first"), failed).alias("ord"), "value")


def read_rows(spark: SparkSession, path: str, schema: T.StructType, ordered: bool = False) -> DataFrame:
    """Rows of a JSONL source; blank lines and byte order marks don't count, a malformed line fails.

    ``ordered`` adds ``ord``, the place of a row over all part files.
    """
    paths = resolve_sources(path, spark)
    if not ordered:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    parsed = numbered_lines(spark, paths).select("ord", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("ord", "r.*")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text, synonyms, parents, children (ids), parent_titles, child_titles, ord. Of rows with
    equal ids the last one's fields count, at the place of the first."""
    r = read_rows(spark, path, schemas.ENTITY, ordered=True)
    title = F.coalesce(F.nullif("title", F.lit("")), "entity", F.lit(""))
    rows = r.select("ord", F.col("idx").alias("id"), F.struct(
        title.alias("title"), F.coalesce("text", F.lit("")).alias("text"), split_pipe("synonyms").alias("synonyms"), split_pipe("parents_idx").alias("parents"), split_pipe("children_idx").alias("children"),
        split_pipe("parents").alias("parent_titles"), split_pipe("children").alias("child_titles")).alias("r"))
    return rows.groupBy("id").agg(F.min("ord").alias("ord"), F.max_by("r", "ord").alias("r")).select("id", "ord", "r.*")


def read_edges(spark: SparkSession, path: str, direct_only: bool = False) -> DataFrame:
    """parent_id, child_id, parent_title, child_title; repeats stay. A missing degree counts as 0."""
    r = read_rows(spark, path, schemas.EDGE)
    if direct_only:
        r = r.where(F.coalesce("degree", F.lit(0)) == 0)
    return r.select(F.col("parent_idx").alias("parent_id"), F.col("child_idx").alias("child_id"), F.coalesce("parent", F.lit("")).alias("parent_title"), F.coalesce("child", F.lit(schemas.NULL_TITLE)).alias("child_title"))


def read_hierarchy(spark: SparkSession, folder: str, edge_catalogue: str = "all") -> Hierarchy:
    """Entities and edges of an ontology folder. A title comes from the entity itself, else from the
    first row that names it as a neighbour or an end of an edge."""
    entities = read_entities(spark, find_file(folder, "_syn_attr_hyp-all.jsonl", spark))
    atomic = read_edges(spark, find_file(folder, "-edges-atomic.jsonl", spark), direct_only=True)
    catalogue = read_edges(spark, find_file(folder, "-edges-all.jsonl", spark)) if edge_catalogue == "all" else atomic
    near = lambda ids, names, rank: entities.where(F.size(ids) == F.size(names)).select("ord", F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(names).alias("t"))).alias("z")).select(F.col("z.i").alias("id"), F.col("z.t").alias("title"), F.lit(rank).alias("rank"), "ord")
    ends = lambda e, i, t, rank: e.select(F.col(i).alias("id"), F.col(t).alias("title"), F.lit(rank).alias("rank"), F.lit(0).cast("bigint").alias("ord"))
    named = entities.select("id", "title", F.lit(0).alias("rank"), "ord")
    for part in (near("parents", "parent_titles", 1), near("children", "child_titles", 2), ends(catalogue, "parent_id", "parent_title", 3), ends(catalogue, "child_id", "child_title", 4)):
        named = named.unionByName(part)
    titles = named.groupBy("id").agg(F.min_by("title", F.struct("rank", "ord", "title")).alias("title"))
    par = entities.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
    ch = entities.select(F.col("id").alias("parent"), F.explode("children").alias("child"))
    return Hierarchy(entities.select("id", "title", "text", "synonyms", "ord"), par, ch, titles, atomic.select("parent_id", "child_id"), catalogue.select("parent_id", "child_id"))


def _parsed_mentions(rows: DataFrame, name: str) -> DataFrame:
    gold = gold_edges("`parents-children_concept`", "parents_concept", "children_concept", schemas.NULL_ID)
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(F.concat(F.lit(f"{name}:"), F.col("ord").cast("string")).alias("mention_id"), text("mention").alias("mention"), text("context_left").alias("context_left"), text("context_right").alias("context_right"),
                       text("label_concept").alias("label_concept"), text("label_concept_ori").alias("label_concept_ori"), text("label_concept_UMLS").alias("label_concept_umls"), text("label_title").alias("label_title"), text("label").alias("label_text"), gold.alias("gold_edges"),
                       is_out_of_kb("label_concept", "label_title").alias("out_of_kb"))


def read_mentions(spark: SparkSession, path: str, out_of_kb_only: bool = False) -> DataFrame:
    """Mention rows; ids count the rows before the filter, through all part files."""
    found = _parsed_mentions(read_rows(spark, path, schemas.MENTION, ordered=True), files.split_path(path)[1])
    return found.where("out_of_kb") if out_of_kb_only else found


def read_edge_pairs(spark: SparkSession, path: str, out_of_kb_only: bool = False) -> DataFrame:
    """One row per mention and edge; an empty child is the leaf sentinel."""
    r = read_rows(spark, path, schemas.EDGE_PAIR, ordered=True)
    out = r.select("ord", "mention", "context_left", "context_right", strip("parent_concept").alias("parent_id"), F.coalesce(F.nullif(strip("child_concept"), F.lit("")), F.lit(schemas.NULL_ID)).alias("child_id"),
                   "label_concept", "label_concept_ori", F.col("label_concept_UMLS").alias("label_concept_umls"), F.col("entity_label_title").alias("label_title"), F.col("entity_label").alias("label_text"))
    return out.where(is_out_of_kb("label_concept", "label_title")) if out_of_kb_only else out


def gold_table(mentions: DataFrame) -> DataFrame:
    return mentions.select("mention_id", F.explode("gold_edges").alias("e")).select("mention_id", "e.parent_id", "e.child_id")


def read_dataset(spark: SparkSession, root: str, dataset: str, split_mode: str = "native", edge_catalogue: str = "all", seed: int = schemas.SEED) -> tuple[Hierarchy, dict[str, DataFrame]]:
    """Hierarchy and splits: the files' own ones, or a new cut of the pooled out-of-base mentions."""
    from ..operators.splits import make_splits

    where = dataset_paths(root, dataset)
    hierarchy = read_hierarchy(spark, where["ontology"], edge_catalogue)
    if split_mode == "native":
        return hierarchy, {"train": read_mentions(spark, where["mention_train"]), "valid": read_mentions(spark, where["mention_valid"]), "valid_nil": read_mentions(spark, where["mention_valid_nil"], True), "test_nil": read_mentions(spark, where["mention_test_nil"], True)}
    if split_mode != "resplit":
        raise ValueError(f"unknown split mode {split_mode!r}")
    pooled = make_splits(read_mentions(spark, where["mention_test_nil_all"], True), ["label_concept_ori", "mention"], seed=seed)
    return hierarchy, {"train": pooled.where("split = 'train'"), "valid": pooled.where("split = 'valid'"), "test_nil": pooled.where("split = 'test'")}


# Sample lines that stand in for a missing text file.
SAMPLE_LINES = (
    "The patient was diagnosed with acute renal failure after surgery.",
    "Cystic fibrosis affects the lungs and the digestive system.",
    "Chronic kidney disease was found in two of the five cases.",
    "A new variant of Diabetes mellitus was described in 2019.",
    "Treatment with Metformin lowered the risk of heart disease.",
)


def read_lines(spark: SparkSession, path: str | None, n: int) -> DataFrame:
    """First n non-blank lines as (doc_id, text); without a file the sample lines in turn."""
    if path and files.exists(spark, path):
        return numbered_lines(spark, [path]).where(F.col("ord") < n).select(F.col("ord").alias("doc_id"), strip("value").alias("text"))
    pick = F.element_at(F.array(*[F.lit(s) for s in SAMPLE_LINES]), (F.col("id") % len(SAMPLE_LINES) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("doc_id"), pick.alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DOCUMENT).option("mode", "FAILFAST").json(resolve_sources(path, spark))


def read_classes(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Ontology JSON -> (classes: name, parent; mapping of entity types)."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.CLASSES).alias("o"))
    classes = one.select(F.explode("o.classes").alias("name", "c")).select("name", F.col("c.parent").alias("parent"))
    mapping = one.select("o.entity_type_mapping").first()
    return classes, dict(mapping[0] or {}) if mapping else {}


def read_prompts(folder: str, spark: SparkSession | None = None) -> dict[str, str]:
    """Templates by language, from ``prompt_<language>.txt``."""
    spark = spark or SparkSession.active()
    found = [m for n in files.names(spark, folder) if (m := re.fullmatch(r"prompt_(\w+)\.txt", n))]
    return {m[1]: files.read_text(spark, f"{folder.rstrip('/')}/{m[0]}") for m in found}
