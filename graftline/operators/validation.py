"""Logical checks of first-ranked edges: no cycle by structure; further flags are left to a reasoner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import NULL_ID
from .enrichment import EDGE
from .hierarchy import reachable
from ..session import ensure_checkpoint_dir


def cycle_free(edges: DataFrame, ch: DataFrame) -> DataFrame:
    """Adds ``acyclic`` (false where the parent lies below the child) and a note; ``consistent`` and
    ``satisfiable`` stay null, as structure alone can't tell them."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.checkpoint()  # read three times below, and ranked by all that is before it
    inner = edges.where(F.col("child_id") != NULL_ID).select(F.col("parent_id").alias("candidate"), F.col("child_id").alias("ancestor")).distinct()
    reach = reachable(inner, ch).select(F.col("candidate").alias("parent_id"), F.col("ancestor").alias("child_id"), "is_descendant")
    joined = edges.join(reach, ["parent_id", "child_id"], "left")
    leaf, loop = F.col("child_id") == NULL_ID, F.col("parent_id") == F.col("child_id")
    flag = F.when(leaf, True).when(loop, False).otherwise(~F.coalesce("is_descendant", F.lit(False)))
    note = F.when(leaf, "leaf edge").when(loop, "parent equals child").when(F.col("is_descendant"), "parent lies below child").otherwise("")
    none = F.lit(None).cast("boolean")
    return joined.select(*edges.columns, none.alias("consistent"), none.alias("satisfiable"), flag.alias("acyclic"), note.alias("note"))


def all_three(consistent="consistent", satisfiable="satisfiable", acyclic="acyclic"):
    """Null if any flag is null, unlike AND."""
    c = [F.col(x) for x in (consistent, satisfiable, acyclic)]
    return F.when(c[0].isNull() | c[1].isNull() | c[2].isNull(), F.lit(None).cast("boolean")).otherwise(c[0] & c[1] & c[2])


def validate_first(rankings: DataFrame, ch: DataFrame, backend=cycle_free) -> DataFrame:
    return backend(rankings.where(F.col("rank") == 1).select(*EDGE), ch)


def summarise(validation: DataFrame) -> DataFrame:
    """Share of true among the known, in per cent; null where nothing is known."""
    v = validation.withColumn("all_three", all_three())
    return v.agg(F.count(F.lit(1)).alias("n"), *[(100 * F.avg(F.col(c).cast("double"))).alias(c) for c in ("consistent", "satisfiable", "acyclic", "all_three")])


def validity_line(summary: DataFrame, name: str) -> DataFrame:
    cells = [F.coalesce(F.format_string("%.1f", F.col(c)), F.lit("n/a")) if c else F.lit(name) for c in (None, "consistent", "satisfiable", "acyclic", "all_three")]
    safe = [F.when(F.col(c).isNull(), F.lit("n/a")).otherwise(F.format_string("%.1f", F.col(c))) for c in ("consistent", "satisfiable", "acyclic", "all_three")]
    return summary.select(F.concat_ws("\t", cells[0], *safe).alias("line"))
