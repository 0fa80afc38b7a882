"""Candidate edges: construction from retrieved concepts, enrichment, scores, leaf rule, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import NULL_ID
from ..session import ensure_checkpoint_dir
from .retrieval import dot

EDGE = ["mention_id", "parent_id", "child_id"]
#: Between parent and child in the id of an edge with a vector.
EDGE_MARK = "\x1f"
#: Places of a block of a concept's pool: in lists by parent, of which the first places are asked for (half of that for few), and where all is.
LISTED, BLOCK = 128, 2048


def concept_edges(concepts: DataFrame, par: DataFrame, ch: DataFrame, include_leaf: bool = True) -> DataFrame:
    """(concept_id) distinct -> (concept_id, parent_id, child_id): edges into and out of each concept,
    those that skip it, and its leaf edge."""
    into = concepts.join(par, F.col("concept_id") == F.col("child")).select("concept_id", F.col("parent").alias("parent_id"), F.col("concept_id").alias("child_id"))
    out = concepts.join(ch, F.col("concept_id") == F.col("parent")).select("concept_id", F.col("concept_id").alias("parent_id"), F.col("child").alias("child_id"))
    skip = into.select("concept_id", "parent_id").join(ch, F.col("concept_id") == F.col("parent")).select("concept_id", "parent_id", F.col("child").alias("child_id"))
    edges = into.unionByName(out).unionByName(skip)
    if include_leaf:
        edges = edges.unionByName(concepts.select("concept_id", F.col("concept_id").alias("parent_id"), F.lit(NULL_ID).alias("child_id")))
    return edges


def seed_edges(retrieved: DataFrame, par: DataFrame, ch: DataFrame, include_leaf: bool = True) -> DataFrame:
    """Distinct edges of every mention's retrieved concepts; the two-hop product is made once per
    distinct concept, not once per mention."""
    known = concept_edges(retrieved.select("concept_id").distinct(), par, ch, include_leaf)
    return retrieved.select("mention_id", "concept_id").join(known, "concept_id").select(*EDGE).distinct()


def enrich(seeds: DataFrame, par: DataFrame, ch: DataFrame, enrich_leaf_edges: bool = True) -> DataFrame:
    """Each seed with its parent lifted, its child lowered, and both; a superset of the seeds.

    A leaf seed is only lifted, and only if its parent is an end of one of the mention's other seeds.
    Expansions belong to an edge, not to a mention: they are made per distinct edge and joined back.
    """
    leaf = F.col("child_id") == NULL_ID
    inner = seeds.where(~leaf)
    ends = inner.select("mention_id", F.explode(F.array_distinct(F.array("parent_id", "child_id"))).alias("parent_id")).distinct()
    leaves = seeds.where(leaf)
    lifted = leaves.join(ends, ["mention_id", "parent_id"], "left_semi") if enrich_leaf_edges else leaves.limit(0)
    grow = inner.unionByName(lifted)
    edges = grow.select("parent_id", "child_id").distinct()
    ups = edges.select("parent_id").distinct()
    ups = ups.select("parent_id", F.col("parent_id").alias("up")).unionByName(ups.join(par, F.col("parent_id") == F.col("child")).select("parent_id", F.col("parent").alias("up")))
    downs = edges.select("child_id").distinct()
    downs = downs.select("child_id", F.col("child_id").alias("down")).unionByName(
        downs.where(~leaf).join(ch, F.col("child_id") == F.col("parent")).select("child_id", F.col("child").alias("down")))
    grown = edges.join(ups, "parent_id").join(downs, "child_id").select("parent_id", "child_id", "up", "down")
    wide = grow.join(grown, ["parent_id", "child_id"]).select("mention_id", F.col("up").alias("parent_id"), F.col("down").alias("child_id"))
    return wide.unionByName(seeds.select(*EDGE)).distinct()


def concept_pools(retrieved: DataFrame, par: DataFrame, ch: DataFrame, include_leaf: bool = True, enrichment: bool = True) -> DataFrame:
    """(concept_id, parent_id, child_id, seed): the distinct edges that each retrieved concept brings to
    any mention, ``seed`` where they need no enrichment.

    A mention's pool is the union of its concepts' pools: an edge grows alike for every mention, and a
    concept whose leaf edge can be lifted has a parent, so that its own edge from there lets it. That of
    a concept is all pairs of it and two levels above with it and two levels below, of which the first
    level alone makes seeds. The sentinel is no concept.
    """
    ensure_checkpoint_dir(retrieved.sparkSession)
    named = retrieved.select("concept_id").where(F.col("concept_id").isNotNull()).distinct().checkpoint()  # read by both sides, level by level
    concepts = named.where(F.col("concept_id") != NULL_ID)
    level = lambda df, n: df.withColumn("_level", F.lit(n))
    into = concepts.join(par, F.col("concept_id") == F.col("child")).select("concept_id", F.col("parent").alias("parent_id")).distinct()
    out = concepts.join(ch, F.col("concept_id") == F.col("parent")).select("concept_id", F.col("child").alias("child_id")).distinct()
    ups = level(concepts.select("concept_id", F.col("concept_id").alias("parent_id")), 0).unionByName(level(into, 1))
    downs = level(concepts.select("concept_id", F.col("concept_id").alias("child_id")), 0).unionByName(level(out, 1))
    if enrichment:
        ups = ups.unionByName(level(into.join(par, F.col("parent_id") == F.col("child")).select("concept_id", F.col("parent").alias("parent_id")).distinct(), 2))
        downs = downs.unionByName(level(out.where(F.col("child_id") != NULL_ID).join(ch, F.col("child_id") == F.col("parent")).select("concept_id", F.col("child").alias("child_id")).distinct(), 2))
    u, d = F.col("_u"), F.col("_d")
    pairs = ups.withColumnRenamed("_level", "_u").join(downs.withColumnRenamed("_level", "_d"), "concept_id").where(u + d > 0)
    pools = pairs.select("concept_id", "parent_id", "child_id", ((u < 2) & (d < 2)).alias("seed"))
    if include_leaf:
        grown = ups.where(F.col("_level") < (2 if enrichment else 1))
        pools = pools.unionByName(grown.select("concept_id", "parent_id", F.lit(NULL_ID).alias("child_id"), (F.col("_level") == 0).alias("seed")))
    if named.where(F.col("concept_id") == NULL_ID).count():
        own = concept_edges(named.where(F.col("concept_id") == NULL_ID), par, ch, include_leaf).withColumnRenamed("concept_id", "mention_id").distinct()
        grown = enrich(own, par, ch).withColumn("seed", F.lit(False)) if enrichment else None
        own = own.withColumn("seed", F.lit(True))
        pools = pools.unionByName((own.unionByName(grown) if enrichment else own).withColumnRenamed("mention_id", "concept_id"))
    return pools.groupBy("concept_id", "parent_id", "child_id").agg(F.max("seed").alias("seed")).checkpoint()  # read by candidates and sizes; a cache would carry its plan into each of theirs


def _codes(pools: DataFrame) -> DataFrame:
    """(id, code) of all ids in the pools, numbers in the order of the ids: rows of numbers are moved, compared and sorted faster."""
    ids = pools.select(F.explode(F.array("concept_id", "parent_id", "child_id")).alias("id")).where(F.col("id").isNotNull()).distinct()
    return ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("code")).checkpoint()  # numbered once, and read often


def _coded(df: DataFrame, codes: DataFrame, **columns: str) -> DataFrame:
    """The codes of some columns under new names in place of the ids, nulls as they are."""
    for column, name in columns.items():
        df = df.join(codes.select(F.col("id").alias(column), F.col("code").alias(name)), column, "left").drop(column)
    return df


def _nameless(retrieved: DataFrame, par: DataFrame, ch: DataFrame, enrichment: bool) -> tuple[DataFrame, DataFrame] | None:
    """Seeds and pool of the rows without a mention_id, if there are any: nothing matches them, so that
    their leaf edges aren't lifted."""
    rows = retrieved.where(F.col("mention_id").isNull())
    if not rows.limit(1).count():
        return None
    seeds = seed_edges(rows, par, ch)
    return seeds, enrich(seeds, par, ch) if enrichment else seeds


def _led(retrieved: DataFrame, pools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each mention's concept of the largest pool (mention_id, lead), which counts as it is, and the distinct
    edges (mention_id, parent_id, child_id, seed, new) that its other concepts add to that pool: edges that are
    ``new`` there, and seeds that are none there.

    What a concept adds depends on the lead and not on the mention: it is made per pair of them, and lists stay
    whole until they are at their mention.
    """
    sizes = pools.groupBy("concept_id").agg(F.count(F.lit(1)).alias("_n"))
    sized = retrieved.where(F.col("mention_id").isNotNull()).select("mention_id", "concept_id").join(sizes, "concept_id")
    sized = sized.withColumn("lead", F.max(F.struct("_n", "concept_id")).over(Window.partitionBy("mention_id"))["concept_id"])
    others = sized.where(F.col("concept_id") != F.col("lead")).select("mention_id", "lead", "concept_id")
    brought = others.select("lead", "concept_id").distinct().join(pools, "concept_id")
    known = pools.select(F.col("concept_id").alias("_lead"), F.col("parent_id").alias("_parent"), F.col("child_id").alias("_child"), F.col("seed").alias("_seed"))
    same = (brought["lead"] == known["_lead"]) & brought["parent_id"].eqNullSafe(known["_parent"]) & brought["child_id"].eqNullSafe(known["_child"])
    added = brought.join(known, same, "left").where(F.col("_seed").isNull() | (F.col("seed") & ~F.col("_seed")))
    lists = added.groupBy("lead", "concept_id").agg(F.collect_list(F.struct("parent_id", "child_id", "seed", F.col("_seed").isNull().alias("new"))).alias("_edges"))
    rest = others.join(lists, ["lead", "concept_id"]).select("mention_id", "_edges").repartition("mention_id").select("mention_id", F.explode("_edges").alias("e")).select("mention_id", "e.*")
    return sized.where(F.col("concept_id") == F.col("lead")).select("mention_id", "lead").distinct(), rest.groupBy("mention_id", "parent_id", "child_id").agg(F.max("seed").alias("seed"), F.max("new").alias("new"))


def pool_edges(retrieved: DataFrame, pools: DataFrame, par: DataFrame, ch: DataFrame, enrichment: bool = True) -> DataFrame:
    """Distinct edges of every mention's pool, of which the largest part, the largest pool of one of its
    concepts, is written out block by block without being compared or moved."""
    leads, rest = _led(retrieved, pools)
    rest = rest.where("new").select(*EDGE)
    place = F.row_number().over(Window.partitionBy("concept_id").orderBy("parent_id", "child_id")) - 1
    blocks = pools.withColumn("_block", F.floor(place / BLOCK)).groupBy(F.col("concept_id").alias("lead"), "_block").agg(F.collect_list(F.struct("parent_id", "child_id")).alias("_edges"))
    counts = blocks.groupBy("lead").agg(F.count(F.lit(1)).alias("_blocks"))
    asked = leads.join(counts, "lead").select("mention_id", "lead", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"))
    parts = 4 * int(retrieved.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few small rows that become very many
    whole = asked.repartition(parts, "lead", "_block").join(blocks, ["lead", "_block"]).select("mention_id", F.explode("_edges").alias("e")).select("mention_id", "e.parent_id", "e.child_id")
    nameless = _nameless(retrieved, par, ch, enrichment)
    edges = whole.unionByName(rest)
    return edges.unionByName(nameless[1].select(*EDGE)) if nameless else edges


def pool_counts(retrieved: DataFrame, pools: DataFrame) -> DataFrame:
    """``pool_sizes`` of the seeds and the pool of every mention with an id, without writing the edges out."""
    leads, rest = _led(retrieved, pools)
    added = rest.groupBy("mention_id").agg(F.count_if("seed").alias("_before"), F.count_if("new").alias("_after"))
    sizes = pools.groupBy(F.col("concept_id").alias("lead")).agg(F.count_if("seed").alias("_b"), F.count(F.lit(1)).alias("_a"))
    n = lambda lead, other: (F.col(lead) + F.coalesce(other, F.lit(0))).alias
    both = leads.join(sizes, "lead").join(added, "mention_id", "left").select("mention_id", n("_b", "_before")("n_before"), n("_a", "_after")("n_after"))
    return both.withColumn("factor", F.coalesce(F.try_divide(F.col("n_after"), F.col("n_before")), F.lit(0.0)))


def leaf_counts(retrieved: DataFrame, pools: DataFrame, par: DataFrame, ch: DataFrame, enrichment: bool = True) -> DataFrame:
    """(mention_id, n_leaf_edges) of every mention's pool: parents of leaf edges stay in lists until they are at
    their mention, and no edge is compared with those of another concept before."""
    lists = pools.where(F.col("child_id") == NULL_ID).groupBy("concept_id").agg(F.collect_list(F.struct("parent_id")).alias("_parents"))
    rows = retrieved.where(F.col("mention_id").isNotNull()).select("mention_id", "concept_id").join(lists.hint("shuffle_hash"), "concept_id")
    edges = rows.select("mention_id", "_parents").repartition("mention_id").select("mention_id", F.explode("_parents").alias("e")).select("mention_id", "e.parent_id").distinct()
    nameless = _nameless(retrieved, par, ch, enrichment)
    if nameless:
        edges = edges.unionByName(nameless[1].where(F.col("child_id") == NULL_ID).select("mention_id", "parent_id"))
    return edges.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n_leaf_edges"))


def looked_up_counts(retrieved: DataFrame, pools: DataFrame, par: DataFrame, ch: DataFrame, scores: DataFrame) -> DataFrame:
    """(mention_id, n_scored, n_unscored) of the seeds by ``looked_up_scores``: seeds are counted, and only
    the scored edges are looked up, from the edge to the concepts that bring it to those retrieved."""
    seeds = pools.where("seed").select("concept_id", "parent_id", "child_id")
    found = scores.select(*EDGE).join(seeds, ["parent_id", "child_id"]).join(retrieved.select("mention_id", "concept_id").distinct(), ["mention_id", "concept_id"], "left_semi").select(*EDGE).distinct()
    scored = scores.select(*EDGE).join(found, EDGE, "left_semi").groupBy(*EDGE).agg(F.count(F.lit(1)).alias("_n")).groupBy("mention_id").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_edges"))
    counted = pool_counts(retrieved, seeds.withColumn("seed", F.lit(True))).select("mention_id", "n_before")
    nameless = _nameless(retrieved, par, ch, enrichment=False)
    if nameless:
        counted = counted.unionByName(nameless[0].groupBy("mention_id").agg(F.count(F.lit(1)).alias("n_before")))
    return counted.join(scored, "mention_id", "left").select("mention_id", F.coalesce("_rows", F.lit(0)).alias("n_scored"), (F.col("n_before") - F.coalesce("_edges", F.lit(0))).alias("n_unscored"))


def endpoint_scores(edges: DataFrame, similarity: DataFrame, null_similarity: float = 0.0) -> DataFrame:
    """Mean similarity of both ends; similarity: mention_id, concept_id, score; missing ends score 0."""
    up = similarity.select("mention_id", F.col("concept_id").alias("parent_id"), F.col("score").alias("_up"))
    down = similarity.select("mention_id", F.col("concept_id").alias("child_id"), F.col("score").alias("_down"))
    joined = edges.join(up, ["mention_id", "parent_id"], "left").join(down, ["mention_id", "child_id"], "left")
    low = F.when(F.col("child_id") == NULL_ID, F.lit(float(null_similarity))).otherwise(F.coalesce("_down", F.lit(0.0)))
    return joined.select(*edges.columns, ((F.coalesce("_up", F.lit(0.0)) + low) / 2).alias("score"))


def near_top(retrieved: DataFrame, pools: DataFrame, par: DataFrame, ch: DataFrame, k: int, enrichment: bool = True, null_similarity: float = 0.0) -> DataFrame:
    """The edges of ``near_scores``."""
    return _near(retrieved, pools, par, ch, k, enrichment, null_similarity)[0].select(*EDGE)


def near_scores(retrieved: DataFrame, pools: DataFrame, par: DataFrame, ch: DataFrame, k: int, enrichment: bool = True, null_similarity: float = 0.0) -> DataFrame:
    """Edges of every mention's pool with ``endpoint_scores`` among which are its first k, with and without
    the leaf rule: the first k leaf edges and the first k others.

    Children that weren't retrieved score alike under the same parent, so that of these only the first k
    by id count. They are within the first k and as many places more of the parent's list as the mention
    has concepts; to them come all leaf edges and all edges down to retrieved concepts. A concept's pool
    has few parents, it and two levels above, whatever lies below.
    """
    near, repeated = _near(retrieved, pools, par, ch, k, enrichment, null_similarity)
    return endpoint_scores(near.select(*EDGE), retrieved, null_similarity) if repeated else near


def near_ranked(retrieved: DataFrame, pools: DataFrame, par: DataFrame, ch: DataFrame, k: int, rules: list[DataFrame | None], enrichment: bool = True) -> list[DataFrame]:
    """``rank_edges`` of ``near_scores``, cut at k, for each of the given mentions of the leaf rule (None: without it).

    Edges are ranked by numbers where they were cut to the first k of each kind, and only those that stay get their ids.
    """
    first, per, codes, repeated = _near_coded(retrieved, pools, k, 0.0)
    nameless = _nameless(retrieved, par, ch, enrichment)
    if repeated or nameless:
        near = _near_named(first, per, codes, nameless, 0.0)
        near = (endpoint_scores(near.select(*EDGE), retrieved) if repeated else near).checkpoint()
        return [rank_edges(near, k, leafy) for leafy in rules]
    if len(rules) > 1:
        first = first.checkpoint()  # ranked several times
    out = []
    for leafy in rules:
        names = per.select("m", "mention_id")
        lead = F.lit(0)
        if leafy is not None:
            names = names.join(leafy.select("mention_id", F.lit(1).alias("_leafy")), "mention_id", "left")
            lead = F.when((F.col("_leafy") == 1) & F.col("_leaf"), 0).otherwise(1)
        order = Window.partitionBy("m").orderBy(lead, F.desc("score"), F.asc("p"), F.asc("x"))
        ranked = first.join(names, "m").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out.append(_named(ranked, codes).select(*EDGE, "score", "rank"))
    return out


def _named(coded: DataFrame, codes: DataFrame) -> DataFrame:
    name = lambda column, out: codes.select(F.col("id").alias(out), F.col("code").alias(column))
    return coded.join(name("p", "parent_id"), "p", "left").join(name("x", "child_id"), "x", "left")


def _near(retrieved: DataFrame, pools: DataFrame, par: DataFrame, ch: DataFrame, k: int, enrichment: bool, null_similarity: float) -> tuple[DataFrame, bool]:
    """Edges with the score by the best row of each end; whether a mention has several rows of a concept."""
    first, per, codes, repeated = _near_coded(retrieved, pools, k, null_similarity)
    return _near_named(first, per, codes, _nameless(retrieved, par, ch, enrichment), null_similarity), repeated


def _near_named(first: DataFrame, per: DataFrame, codes: DataFrame, nameless, null_similarity: float) -> DataFrame:
    near = _named(first.join(per.select("m", "mention_id"), "m"), codes).select(*EDGE, "score")
    if nameless:
        near = near.unionByName(nameless[1].select(*EDGE, (F.when(F.col("child_id") == NULL_ID, F.lit(float(null_similarity))).otherwise(F.lit(0.0)) / 2).alias("score")))
    return near


def _list_size(k: int) -> int:
    """Places of a block from which the first k and as many more as a mention has concepts are asked for: whole blocks are sent."""
    return LISTED if 4 * k > LISTED else max(1, LISTED // 2)


def _near_coded(retrieved: DataFrame, pools: DataFrame, k: int, null_similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(m, p, x, _leaf, score) of ``_near`` by numbers, the mentions' numbers, the ids', and whether a mention has several rows of a concept."""
    ensure_checkpoint_dir(retrieved.sparkSession)
    codes = _codes(pools)
    known = retrieved.where(F.col("mention_id").isNotNull() & F.col("concept_id").isNotNull()).select("mention_id", "concept_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    best = known.join(codes.select(F.col("id").alias("concept_id"), F.col("code").alias("c")), "concept_id").repartition("mention_id").groupBy("mention_id", "c").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("_n"))
    per = best.groupBy("mention_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "score"))).alias("_scores"), F.max("_n").alias("_n"))
    per = per.withColumn("m", F.monotonically_increasing_id()).checkpoint()  # read four times
    asked = per.select("m", (F.size("_scores") + k).alias("_last"), F.explode(F.map_keys("_scores")).alias("c"))
    leaf = F.coalesce(F.col("child_id") == NULL_ID, F.lit(False))
    numbers = _coded(pools.select("concept_id", "parent_id", "child_id", leaf.alias("_leaf")), codes, concept_id="c", parent_id="p", child_id="x")
    nth = F.row_number().over(Window.partitionBy("c", "p", "_leaf").orderBy("x"))
    placed = numbers.select("c", "p", "x", F.when(F.col("_leaf"), 0).otherwise(nth).alias("_at"))  # leaf edges are at 0
    size = _list_size(k)
    lists = placed.groupBy("c", F.floor(F.col("_at") / size).alias("_block")).agg(F.collect_list(F.struct("p", "x", "_at")).alias("_edges"))
    listed = asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / size)))).join(lists, ["c", "_block"]).select("m", "_edges")
    far = placed.where(F.col("_at") > k).groupBy("x", "c").agg(F.collect_list(F.struct("p", "x", F.lit(1).alias("_at"))).alias("_edges"))
    down = asked.select("m", F.col("c").alias("x")).join(far, "x").join(asked.select("m", "c"), ["m", "c"], "left_semi").select("m", "_edges")
    # Lists stay whole until they meet the mention's scores.
    edges = listed.unionByName(down).join(per.select("m", "_scores").hint("shuffle_hash"), "m").select("m", "_scores", F.explode("_edges").alias("e"))
    edges = edges.where(F.col("e._at") <= F.size("_scores") + k).select("m", "_scores", "e.p", "e.x", (F.col("e._at") == 0).alias("_leaf"))
    end = lambda c: F.coalesce(F.try_element_at("_scores", F.col(c)), F.lit(0.0))
    scored = edges.select("m", "p", "x", "_leaf", ((end("p") + F.when(F.col("_leaf"), F.lit(float(null_similarity))).otherwise(end("x"))) / 2).alias("score"))
    order = Window.partitionBy("m", "_leaf").orderBy(F.desc("score"), F.asc("p"), F.asc("x"))
    first = scored.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= k).select("m", "p", "x", "_leaf", "score").distinct()
    return first, per, codes, per.where(F.col("_n") > 1).limit(1).count() > 0


def looked_up_scores(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by look-up on (mention_id, parent_id, child_id); an unscored edge comes last."""
    return edges.join(scores.select(*EDGE, F.col("score").alias("_score")), EDGE, "left").select(*edges.columns, F.coalesce("_score", F.lit(float("-inf"))).alias("score"))


def dot_scores(edges: DataFrame, mention_vectors: DataFrame, edge_vectors: DataFrame) -> DataFrame:
    """Scores on demand: inner products of the vectors (id, vector) of the mention and of the edge, whose
    id is parent and child joined by ``EDGE_MARK``; edges or mentions without a vector come last."""
    m = mention_vectors.select(F.col("id").alias("mention_id"), F.col("vector").alias("_m"))
    e = edge_vectors.select(F.col("id").alias("_edge"), F.col("vector").alias("_e"))
    joined = edges.withColumn("_edge", F.concat_ws(EDGE_MARK, "parent_id", "child_id")).join(e, "_edge", "left").join(m, "mention_id", "left")
    score = F.when(F.col("_m").isNotNull() & F.col("_e").isNotNull(), dot("_m", "_e")).otherwise(F.lit(float("-inf")))
    return joined.select(*edges.columns, score.alias("score"))


def top_is_leaf(retrieved: DataFrame, concepts: DataFrame, ch: DataFrame) -> DataFrame:
    """(mention_id) of mentions whose first concept is known and has no children."""
    first = retrieved.where(F.col("rank") == 1).select("mention_id", F.col("concept_id").alias("id"))
    return first.join(concepts.select("id"), "id", "left_semi").join(ch.select(F.col("parent").alias("id")), "id", "left_anti").select("mention_id").distinct()


def rank_edges(scored: DataFrame, k: int | None, leaf_mentions: DataFrame | None = None) -> DataFrame:
    """Ranked candidates per mention: score down, then parent and child by code point. Leaf edges go
    before all others where the mention's first concept is a leaf, and before the cut at k."""
    lead: Column = F.lit(0)
    if leaf_mentions is not None:
        scored = scored.join(leaf_mentions.select("mention_id", F.lit(1).alias("_leafy")), "mention_id", "left")
        lead = F.when((F.col("_leafy") == 1) & (F.col("child_id") == NULL_ID), 0).otherwise(1)
    order = [F.asc("_lead"), F.desc("score"), F.asc("parent_id"), F.asc("child_id")]
    ranked = scored.withColumn("_lead", lead).withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(*order)))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select(*EDGE, "score", "rank")


def endpoint_order(ranked: DataFrame) -> DataFrame:
    """Ends of the ranked edges by first appearance, parent before child, the sentinel included."""
    ends = ranked.select("mention_id", F.col("rank"), F.posexplode(F.array("parent_id", "child_id")).alias("pos", "concept_id"))
    first = ends.groupBy("mention_id", "concept_id").agg(F.min(F.col("rank") * 2 + F.col("pos")).alias("_at"))
    return first.select("mention_id", "concept_id", F.row_number().over(Window.partitionBy("mention_id").orderBy("_at")).alias("rank"))


def pool_sizes(seeds: DataFrame, enriched: DataFrame) -> DataFrame:
    """(mention_id, n_before, n_after, factor); the factor is 0 without seeds."""
    before = seeds.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n_before"))
    after = enriched.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n_after"))
    both = before.join(after, "mention_id", "full").select("mention_id", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return both.withColumn("factor", F.coalesce(F.try_divide(F.col("n_after"), F.col("n_before")), F.lit(0.0)))


def enrichment_statistics(sizes: DataFrame) -> DataFrame:
    """Mean sizes before and after, and the ratio of the means."""
    means = sizes.agg(F.coalesce(F.avg("n_before"), F.lit(0.0)).alias("mean_before"), F.coalesce(F.avg("n_after"), F.lit(0.0)).alias("mean_after"))
    return means.withColumn("factor", F.coalesce(F.try_divide(F.col("mean_after"), F.col("mean_before")), F.lit(0.0)))


def candidate_set(retrieved: DataFrame, concepts: DataFrame, par: DataFrame, ch: DataFrame, k: int | None, enrichment: bool = True,
                  leaf_priority: bool = True, scorer=None, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stage two as one plan: (ranked candidates, pool sizes). scorer: edges -> edges with score;
    by default the mean similarity of the ends by the retrieved scores. seeds: retrieved edges, in
    place of those made from the retrieved concepts."""
    leafy = top_is_leaf(retrieved, concepts, ch) if leaf_priority else None
    if seeds is not None:
        seeds = seeds.select(*EDGE).distinct().cache()  # read by every branch of the enrichment and by the sizes
        pool = enrich(seeds, par, ch) if enrichment else seeds
        sizes = pool_sizes(seeds, pool)
    else:
        pools = concept_pools(retrieved, par, ch, enrichment=enrichment)
        if k is not None and not scorer:
            return near_ranked(retrieved, pools, par, ch, k, [leafy], enrichment)[0], pool_counts(retrieved, pools)
        pool, sizes = pool_edges(retrieved, pools, par, ch, enrichment), pool_counts(retrieved, pools)
    scored = scorer(pool) if scorer else endpoint_scores(pool, retrieved)
    return rank_edges(scored, k, leafy), sizes
