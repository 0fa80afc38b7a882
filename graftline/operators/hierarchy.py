"""The concept hierarchy as edge tables: neighbours, titles, reachability, depth.

``par`` (child, parent) and ``ch`` (parent, child) are separate tables, as loaders fill them from
separate fields. Iterations cut their lineage with reliable checkpoints.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import verbalised
from ..functions.text import is_complex
from ..schemas import NULL_ID, NULL_TITLE
from ..session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Hierarchy:
    """concepts: id, title, text, synonyms, ord; par: child, parent; ch: parent, child;
    titles: id, title; edges_atomic and edges_catalogue: parent_id, child_id."""

    concepts: DataFrame
    par: DataFrame
    ch: DataFrame
    titles: DataFrame
    edges_atomic: DataFrame | None = None
    edges_catalogue: DataFrame | None = None

    def parents_of(self, ids: DataFrame) -> DataFrame:
        """(id, ...) -> (id, ..., parent) rows; unknown ids and the sentinel have none."""
        return ids.join(self.par.withColumnRenamed("child", "id"), "id")

    def children_of(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.ch.withColumnRenamed("parent", "id"), "id")

    def leaves(self) -> DataFrame:
        """(id) of known concepts without children."""
        return self.concepts.select("id").join(self.ch.select(F.col("parent").alias("id")), "id", "left_anti")

    def resolve_titles(self, ids: DataFrame, id_col: str = "id", out: str = "title") -> DataFrame:
        """Adds a title: the stored one, else the words of a complex id, else the id itself."""
        stored = self.titles.select(F.col("id").alias("_tid"), F.nullif(F.col("title"), F.lit("")).alias("_stored"))
        lacking = ids.select(F.col(id_col).alias("id")).where(is_complex("id")).distinct()
        said = verbalised(lacking, self.titles).select(F.col("id").alias("_vid"), F.col("words").alias("_words"))
        joined = ids.join(stored, F.col(id_col) == F.col("_tid"), "left").join(said, F.col(id_col) == F.col("_vid"), "left")
        title = F.when(F.col(id_col).isNull() | F.col(id_col).isin("", NULL_ID), F.lit(NULL_TITLE)).otherwise(F.coalesce("_stored", F.nullif(F.col("_words"), F.lit("")), F.col(id_col)))
        return joined.select(*[F.col(c) for c in ids.columns], title.alias(out))


def reachable(pairs: DataFrame, ch: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(candidate, ancestor) pairs -> with ``is_descendant``: candidate lies below ancestor or equals it.

    Breadth first upwards from the distinct candidates, all at once, as a node has few ancestors but
    may have a whole subtree below it; what has been seen is kept, so that cycles end. The sentinel
    and nulls reach nothing, except that equal ids are descendants of themselves. Raises if nodes are
    left after ``max_rounds`` (None: no limit).
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    wanted = pairs.select("candidate", "ancestor").distinct().checkpoint()
    open_pairs = wanted.where((F.col("candidate") != F.col("ancestor")) & (F.col("candidate") != NULL_ID) & (F.col("ancestor") != NULL_ID))
    up = ch.select(F.col("child").alias("node"), F.col("parent").alias("_up"))
    frontier = open_pairs.select("candidate", F.col("candidate").alias("node")).distinct().checkpoint()
    seen, parts, rounds = frontier, 1, 0
    while frontier.limit(1).count():
        if max_rounds is not None and rounds == max_rounds:
            raise RuntimeError(f"ancestors are left after {max_rounds} rounds")
        step = frontier.join(up, "node").select("candidate", F.col("_up").alias("node")).distinct()
        frontier = step.join(seen, ["candidate", "node"], "left_anti").checkpoint()
        seen, parts, rounds = seen.unionByName(frontier), parts + 1, rounds + 1
        if parts == 16:  # deep hierarchies: keep the plan short
            seen, parts = seen.checkpoint(), 1
    hits = seen.where(F.col("candidate") != F.col("node")).select("candidate", F.col("node").alias("ancestor"), F.lit(True).alias("_hit"))
    found = wanted.join(hits, ["candidate", "ancestor"], "left")
    same = F.col("candidate").eqNullSafe(F.col("ancestor")) & F.col("candidate").isNotNull()
    return found.select("candidate", "ancestor", (same | F.coalesce("_hit", F.lit(False))).alias("is_descendant"))


def depths(ids: DataFrame, concepts: DataFrame, par: DataFrame, max_depth: int = 64) -> DataFrame:
    """(id) -> (id, depth): fewest steps up to a node without known parents (unknown ids have none);
    the sentinel has depth -1. Level by level from all such roots downwards; nodes that reach no root
    (cycles alone) are walked upwards until nothing new appears."""
    ensure_checkpoint_dir(ids.sparkSession)
    ids = ids.select("id").distinct()
    nodes = ids.unionByName(concepts.select("id")).unionByName(par.select(F.col("parent").alias("id"))).unionByName(par.select(F.col("child").alias("id"))).where(F.col("id") != NULL_ID).distinct()
    level = nodes.join(par.select(F.col("child").alias("id")), "id", "left_anti").select("id").checkpoint()
    found = level.select("id", F.lit(0).alias("depth"))
    for d in range(1, max_depth + 1):
        below = level.join(par, level["id"] == par["parent"]).select(F.col("child").alias("id")).distinct()
        level = below.join(found, "id", "left_anti").checkpoint()
        if level.limit(1).count() == 0:
            break
        found = found.unionByName(level.select("id", F.lit(d).alias("depth"))).checkpoint()
    rest = ids.where(F.col("id") != NULL_ID).join(found, "id", "left_anti")
    if rest.limit(1).count():
        front = rest.select("id", F.col("id").alias("node")).checkpoint()
        seen, lost = front, rest.select("id", F.lit(0).alias("depth"))
        for d in range(1, max_depth + 1):
            up = front.join(par, front["node"] == par["child"]).select("id", F.col("parent").alias("node")).distinct()
            front = up.join(seen, ["id", "node"], "left_anti").checkpoint()
            if front.limit(1).count() == 0:
                break
            seen = seen.unionByName(front).checkpoint()
            lost = lost.unionByName(front.select("id", F.lit(d).alias("depth")).distinct())
        found = found.unionByName(lost.groupBy("id").agg((F.max("depth") + 1).cast("int").alias("depth")))
    return ids.join(found, "id", "left").select("id", F.when(F.col("id") == NULL_ID, F.lit(-1)).otherwise(F.col("depth")).alias("depth"))
