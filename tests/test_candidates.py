"""What the queries on candidates make before they rank."""

import os

import pytest

from graftline.operators import enrichment
from graftline.plans import queries, views

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_no_concepts_for_the_leaf_rule(spark):
    """The leaf rule finds the same mentions without the table of all concepts, which candidates no longer make."""
    t = views.Tables(spark, FOLDER)
    queries._candidates(t)
    assert "concepts" not in t._kept
    e, r = views.edges(t), views.retrieved(t)
    found = lambda known: sorted(x[0] for x in enrichment.top_is_leaf(r, known, e).collect())
    assert found(views.below(t)) == found(views.concepts(t)) != []


def test_leaves_among_children(spark):
    """Roots, inner and unknown concepts are no leaves, by children alone as by all concepts; repeats and nulls change nothing."""
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), (None, "d"), ("a", None), ("d", None)], "parent string, child string")
    rows = spark.createDataFrame([(c, c, 1) for c in ("a", "b", "c", "d", "unknown")] + [("null", None, 1), ("second", "c", 2)], "mention_id string, concept_id string, rank int")
    every = e.selectExpr("parent AS id").union(e.selectExpr("child AS id")).distinct()
    for known in (every, e.selectExpr("child AS id")):
        assert [x[0] for x in enrichment.top_is_leaf(rows, known, e).collect()] == ["c"]


def test_blocks_for_few(spark, monkeypatch):
    """First candidates from half blocks, which are sent where few are asked for, are those of the whole pool."""
    monkeypatch.setattr(enrichment, "LISTED", 8)
    assert enrichment._list_size(2) == 4 and enrichment._list_size(3) == 8
    e = spark.createDataFrame([("hub", f"c{i:02}") for i in range(20)] + [("top", "hub"), ("root", "top"), ("c03", "d1"), ("c03", "d2")], "parent string, child string").checkpoint()
    found = [("m1", "hub", 0.5), ("m1", "c03", 0.25), ("m1", "c11", 1.0), ("m1", "c19", 0.0), ("m2", "hub", 0.0), ("m2", "c17", 0.0), ("m3", "top", 0.5), ("m3", "c05", -1.0), ("m4", "c03", 0.0)]
    rows = spark.createDataFrame(found, "mention_id string, concept_id string, score double").checkpoint()
    pool = enrichment.endpoint_scores(enrichment.enrich(enrichment.seed_edges(rows, e, e), e, e), rows)
    ours, = enrichment.near_ranked(rows, enrichment.concept_pools(rows, e, e), e, e, 2, [None])
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, enrichment.rank_edges(pool, 2).collect()))
