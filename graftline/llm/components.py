"""Connected components of a link table, by contraction.

Each round lets every node point to its smallest linked smaller node, follows pointers to their
roots by doubling, and replaces the links by links between roots. Only minima are aggregated, so
that a node with very many links costs a partial sum, and every round's tables are written to the
shared folder. Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _count(df: DataFrame) -> int:
    return df.count()


def components(links: DataFrame) -> DataFrame:
    """(a, b) bigint links -> (node, root) for every node that occurs, root the smallest node reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    known: DataFrame | None = None
    while _count(edges):
        # Every node of the round; a node without a smaller neighbour is a root.
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        lows = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
        roots = written(hooks.unionByName(lows).groupBy("node").agg(F.min("root").alias("root")), "hooks")
        while True:
            up = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            step = written(roots.join(up, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")), "hops")
            roots = step.select("node", "root")
            if step.where("moved").limit(1).count() == 0:
                break
        if known is None:
            known = roots
        else:
            up = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            known = written(known.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "roots")
        ra = roots.select(F.col("node").alias("_na"), F.col("root").alias("_ra"))
        rb = roots.select(F.col("node").alias("_nb"), F.col("root").alias("_rb"))
        lifted = edges.join(ra, F.col("a") == F.col("_na")).select("_ra", "b").join(rb, F.col("b") == F.col("_nb"))
        edges = written(lifted.where("_ra <> _rb").select(F.greatest("_ra", "_rb").alias("a"), F.least("_ra", "_rb").alias("b")).distinct(), "links")
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
