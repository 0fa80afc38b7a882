"""Pools made per concept against those made per mention: edges, sizes, first candidates, looked-up scores."""

import random

import pytest
from pyspark.sql import functions as F

from graftline.operators import enrichment as e


@pytest.fixture(scope="module")
def made(spark):
    """A hierarchy with a hub, second parents, repeats and a cycle; rows without ids and repeated rows are retrieved too."""
    rng = random.Random(7)
    ids = [f"c{i}" for i in range(40)]
    edges = [("hub" if i < 25 else rng.choice(ids), c) for i, c in enumerate(ids)] + [("top", "hub"), ("root", "top"), ("c3", "c3"), ("hub", None)]
    edges += [(rng.choice(ids), rng.choice(ids)) for _ in range(12)] + edges[:2]
    found = [(f"m{m}", c, rng.choice([2.0, 1.0, 0.5, 0.0, -1.0, None])) for m in range(12) for c in rng.sample([*ids, "hub", "top", "unknown"], 4)]
    found += [(f"m{m}", "hub", s) for m, s in ((0, 2.0), (1, 0.0), (2, -1.0), (3, 1.0), (3, 1.0))] + [(None, "hub", 1.0), (None, "c2", 1.0), ("m4", None, 1.0)]
    par = spark.createDataFrame(edges, "parent string, child string").checkpoint()
    rows = spark.createDataFrame([(*r, i % 7 + 1) for i, r in enumerate(found)], "mention_id string, concept_id string, score double, rank int").checkpoint()
    seeds = e.seed_edges(rows, par, par).checkpoint()
    return par, rows, seeds, e.enrich(seeds, par, par).checkpoint()


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(e, "LISTED", 3)
    monkeypatch.setattr(e, "BLOCK", 4)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edges_and_sizes(made, short):
    par, rows, seeds, pool = made
    for grown, whole in ((True, pool), (False, seeds)):
        pools = e.concept_pools(rows, par, par, enrichment=grown)
        assert rows_of(e.pool_edges(rows, pools, par, par, grown)) == rows_of(whole)
        assert rows_of(e.pool_counts(rows, pools)) == rows_of(e.pool_sizes(seeds, whole).where("mention_id is not null"))


@pytest.mark.parametrize("k", [1, 4])
def test_first_candidates(spark, made, short, k):
    par, rows, seeds, pool = made
    leafy = spark.createDataFrame([("m0",), ("m3",), ("m5",)], "mention_id string")
    for grown, whole in ((True, pool), (False, seeds)):
        near = e.near_top(rows, e.concept_pools(rows, par, par, enrichment=grown), par, par, k, grown).checkpoint()
        for rule in (leafy, None):
            ranked = lambda edges: rows_of(e.rank_edges(e.endpoint_scores(edges, rows), k, rule))  # noqa: B023, E731
            assert ranked(near) == ranked(whole)
        assert near.where("mention_id is not null").groupBy("mention_id").count().agg(F.max("count")).first()[0] <= 2 * k


def test_looked_up_counts(made):
    par, rows, seeds, _ = made
    scores = seeds.where("mention_id < 'm4' or mention_id is null").limit(40).withColumn("score", F.lit(1.0)).checkpoint()
    scores = scores.unionByName(scores.limit(5)).unionByName(scores.limit(1).withColumn("child_id", F.lit("elsewhere")))
    s = e.looked_up_scores(seeds, scores).groupBy("mention_id").agg(F.count_if(F.col("score") == 1.0).alias("n_scored"), F.count_if(F.col("score") == float("-inf")).alias("n_unscored"))
    assert rows_of(e.looked_up_counts(rows, e.concept_pools(rows, par, par, enrichment=False), par, par, scores)) == rows_of(s)


@pytest.mark.parametrize("twice", [True, False])
def test_near_scores(made, short, twice):
    """Scores come with the edges, also where a mention has several rows of a concept, and are those of its ends."""
    par, rows, _, _ = made
    rows = rows if twice else rows.dropDuplicates(["mention_id", "concept_id"]).checkpoint()
    pools = e.concept_pools(rows, par, par)
    scored = rows_of(e.near_scores(rows, pools, par, par, 3, null_similarity=0.25))
    assert scored == rows_of(e.endpoint_scores(e.near_top(rows, pools, par, par, 3, null_similarity=0.25), rows, 0.25))


def test_pools_of_sentinel_and_nulls(spark, made):
    """Pools by levels, against those grown edge by edge, where the sentinel is retrieved or has children and ends are null."""
    par, rows, _, _ = made
    par = par.unionByName(spark.createDataFrame([("c1", e.NULL_ID), (e.NULL_ID, "c2"), (None, "c4"), (None, "hub"), ("c5", None), (None, None)], "parent string, child string")).checkpoint()
    rows = rows.select("concept_id").unionByName(spark.createDataFrame([(e.NULL_ID,), ("c1",), ("c4",), ("c5",)], "concept_id string")).where("concept_id is not null").distinct().checkpoint()
    own = e.concept_edges(rows, par, par).withColumnRenamed("concept_id", "mention_id").distinct().checkpoint()
    marked = own.withColumn("seed", F.lit(True)).unionByName(e.enrich(own, par, par).withColumn("seed", F.lit(False))).groupBy(*e.EDGE).agg(F.max("seed").alias("seed"))
    assert rows_of(e.concept_pools(rows, par, par)) == rows_of(marked)
    assert rows_of(e.concept_pools(rows, par, par, enrichment=False)) == rows_of(own.withColumn("seed", F.lit(True)))


@pytest.mark.parametrize("twice", [True, False])
def test_near_ranked(spark, made, short, twice):
    """Candidates ranked by numbers are those ranked by ids over the whole pool, with and without the leaf rule."""
    par, rows, seeds, pool = made
    leafy = spark.createDataFrame([("m0",), ("m3",), ("m5",)], "mention_id string")
    if not twice:
        rows = rows.where("mention_id is not null and concept_id is not null").dropDuplicates(["mention_id", "concept_id"]).checkpoint()
        pool = e.enrich(e.seed_edges(rows, par, par), par, par).checkpoint()
    ranked = e.near_ranked(rows, e.concept_pools(rows, par, par), par, par, 3, [leafy, None])
    for ours, rule in zip(ranked, (leafy, None)):
        assert rows_of(ours) == rows_of(e.rank_edges(e.endpoint_scores(pool, rows), 3, rule))


def test_leaf_counts(made):
    par, rows, seeds, pool = made
    for grown, whole in ((True, pool), (False, seeds)):
        ours = e.leaf_counts(rows, e.concept_pools(rows, par, par, enrichment=grown), par, par, grown)
        assert rows_of(ours) == rows_of(whole.where(F.col("child_id") == e.NULL_ID).groupBy("mention_id").count())
