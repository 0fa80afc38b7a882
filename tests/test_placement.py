"""The toy hierarchy root -> {A, B}, A -> {C, D}, B -> {E}: construction, enrichment, ranking, metrics, checks."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from graftline.functions.text import tokens
from graftline.operators import enrichment, hierarchy, metrics, retrieval, selection, splits, validation
from graftline.plans import queries
from graftline.plans.placement import PlacementConfig, ablation, format_ablation, run
from graftline.schemas import NULL_ID
from graftline.sources import sinks

N = NULL_ID


@pytest.fixture(scope="module")
def toy(spark):
    e = spark.createDataFrame([("root", "A"), ("root", "B"), ("A", "C"), ("A", "D"), ("B", "E")], "parent string, child string").cache()
    concepts = spark.createDataFrame([(i, f"{i} (disorder)", ["syn " + i], k) for k, i in enumerate(["root", "A", "B", "C", "D", "E"])], "id string, title string, synonyms array<string>, ord bigint").cache()
    return hierarchy.Hierarchy(concepts, e, e, concepts.select("id", "title"))


def edges(spark, *rows):
    return spark.createDataFrame([("m", *r) for r in rows], "mention_id string, parent_id string, child_id string")


def got(df):
    return {(r.parent_id, r.child_id) for r in df.collect()}


def similar(spark, **scores):
    rows = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([("m", c, float(s), i + 1) for i, (c, s) in enumerate(rows)], "mention_id string, concept_id string, score double, rank int")


def test_construct(spark, toy):
    assert got(enrichment.seed_edges(similar(spark, A=1), toy.par, toy.ch)) == {("root", "A"), ("A", "C"), ("A", "D"), ("root", "C"), ("root", "D"), ("A", N)}
    assert got(enrichment.seed_edges(similar(spark, unknown=1), toy.par, toy.ch)) == {("unknown", N)}
    assert N not in {c for _, c in got(enrichment.seed_edges(similar(spark, A=1), toy.par, toy.ch, include_leaf=False))}


def test_enrich(spark, toy):
    assert got(enrichment.enrich(edges(spark, ("A", "C")), toy.par, toy.ch)) == {("A", "C"), ("root", "C")}
    assert got(enrichment.enrich(edges(spark, ("A", "C"), ("A", N)), toy.par, toy.ch)) == {("A", "C"), ("root", "C"), ("A", N), ("root", N)}
    assert got(enrichment.enrich(edges(spark, ("E", N)), toy.par, toy.ch)) == {("E", N)}
    assert got(enrichment.enrich(edges(spark, ("root", "A")), toy.par, toy.ch)) == {("root", "A"), ("root", "C"), ("root", "D")}


def test_scores_and_leaf_rule(spark, toy):
    pool = edges(spark, ("A", "C"), ("A", N), ("D", N))
    s = {(r.parent_id, r.child_id): r.score for r in enrichment.endpoint_scores(pool, similar(spark, A=0.8, C=0.4)).collect()}
    assert s[("A", "C")] == pytest.approx(0.6) and s[("A", N)] == pytest.approx(0.4)
    flat = pool.withColumn("score", F.lit(0.0))
    leafy = spark.createDataFrame([("m",)], "mention_id string")
    first = lambda df: [(r.parent_id, r.child_id) for r in df.orderBy("rank").collect()]
    assert first(enrichment.rank_edges(flat, None))[0] == ("A", "C")
    assert first(enrichment.rank_edges(flat, 2, leafy)) == [("A", N), ("D", N)]
    top = lambda **x: enrichment.top_is_leaf(similar(spark, **x), toy.concepts, toy.ch).count()
    assert (top(D=1), top(A=1), top(unknown=1)) == (1, 0, 0)
    order = enrichment.endpoint_order(enrichment.rank_edges(flat, None))
    assert [r.concept_id for r in order.orderBy("rank").collect()] == ["A", "C", N, "D"]
    scored = enrichment.looked_up_scores(pool, edges(spark, ("A", N)).withColumn("score", F.lit(0.5)))
    assert {r.score for r in scored.collect()} == {0.5, -math.inf}


def test_metrics(spark):
    m = spark.createDataFrame([("m",), ("absent",)], "mention_id string")
    gold = edges(spark, ("P1", "C1"), ("P2", N)).unionByName(spark.createDataFrame([("absent", "X", "Y")], "mention_id string, parent_id string, child_id string"))
    ranks = spark.createDataFrame([("m", "a", "b", 1), ("m", "P1", "C1", 2), ("m", "c", "d", 3), ("m", "P2", N, 4)], "mention_id string, parent_id string, child_id string, rank int")
    per = {r.mention_id: r for r in metrics.per_mention(m, gold, ranks, (1, 2, 3, 4)).collect()}
    r = per["m"]
    assert (r.any_1, r.any_2, r.all_3, r.all_4) == (False, True, False, True) and r.rr == 0.5 and r.ap == pytest.approx(0.5)
    assert per["absent"].rr == 0 and not per["absent"].any_4
    scores = {x.k: x for x in metrics.placement_scores(metrics.per_mention(m, gold, ranks, (4,)), (4,)).collect()}
    assert scores[4].inr_any == 0.5 and scores[4].inr_any_leaf == 1.0 and scores[4].n_leaf_mentions == 1
    none = metrics.per_mention(m, gold.limit(0), ranks, (1,)).first()
    assert not none.all_1 and none.ap == 0
    extra = gold.unionByName(edges(spark, ("never", "x")))
    assert metrics.per_mention(m.where("mention_id = 'm'"), extra, ranks, (1,)).first().ap == pytest.approx(1 / 3)
    b = metrics.paired_bootstrap(metrics.per_mention(m, gold, ranks, (4,)), metrics.per_mention(m, gold, ranks.limit(0), (4,)), "any_4", 50).first()
    assert b.observed == 50.0 and 0 < b.p_value <= 1 and b.low <= b.high


def test_reachability_and_depth(spark, toy):
    pairs = spark.createDataFrame([("C", "root"), ("root", "C"), ("C", "C"), (N, "A"), ("A", N), (N, N)], "candidate string, ancestor string")
    r = {(x.candidate, x.ancestor): x.is_descendant for x in hierarchy.reachable(pairs, toy.ch).collect()}
    assert r == {("C", "root"): True, ("root", "C"): False, ("C", "C"): True, (N, "A"): False, ("A", N): False, (N, N): True}
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "parent string, child string")
    assert hierarchy.reachable(spark.createDataFrame([("q", "x")], "candidate string, ancestor string"), loop).first().is_descendant is False
    d = {x.id: x.depth for x in hierarchy.depths(spark.createDataFrame([(i,) for i in ("root", "C", "nobody", N, "x")], "id string"), toy.concepts, toy.par.unionByName(loop)).collect()}
    assert d["root"] == 0 and d["C"] == 2 and d["nobody"] == 0 and d[N] == -1 and d["x"] >= 1


def test_cycle_check(spark, toy):
    v = {(r.parent_id, r.child_id): r for r in validation.cycle_free(edges(spark, ("A", N), ("A", "C"), ("C", "A"), ("A", "A")), toy.ch).collect()}
    assert [v[k].acyclic for k in (("A", N), ("A", "C"), ("C", "A"), ("A", "A"))] == [True, True, False, False] and v[("A", N)].consistent is None
    s = validation.summarise(validation.cycle_free(edges(spark, ("A", N), ("C", "A")), toy.ch))
    assert s.first().acyclic == 50.0 and s.first().all_three is None
    assert validation.validity_line(s, "x").first().line == "x\tn/a\tn/a\t50.0\tn/a"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "")], "id int, text string")
    index = retrieval.build_index(docs, "id", tokens("text"))
    top = retrieval.bm25_topk(index, spark.createDataFrame([(9, "a c")], "q int, text string"), "q", tokens("text"), 5).orderBy("rank").collect()
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, n, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (5 / 3)))
    assert [(r.doc, round(r.score, 9)) for r in top] == [(2, round(part(2, 3, 2) + part(1, 3, 1), 9)), (1, round(part(1, 2, 2), 9))]


def test_dense_and_selection(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 2.0])], "id int, vector array<double>")
    top = retrieval.dense_topk(v.where("id = 0"), v, 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in top] == [(0, 1.0), (1, 0.6)]
    c = edges(spark, ("A", "C"), ("B", "E"), ("D", N)).withColumn("rank", F.when(F.col("parent_id") == "A", 1).when(F.col("parent_id") == "B", 2).otherwise(3))
    chosen = spark.createDataFrame([("m", [2])], "mention_id string, places array<bigint>")
    assert [(r.parent_id, r.child_id) for r in selection.rerank_from_places(c, chosen).orderBy("rank").collect()] == [("D", N), ("A", "C"), ("B", "E")]
    data = spark.createDataFrame([("m", str(i), "x", float(i % 2), i % 2) for i in range(20)], "mention_id string, parent_id string, child_id string, f double, label int")
    ranked = selection.LogisticSelector(["f"]).fit(data).rerank(data).orderBy("rank").collect()
    assert {r.parent_id for r in ranked[:10]} == {str(i) for i in range(1, 20, 2)} and len(ranked) == 20


def test_splits(spark):
    rows = spark.createDataFrame([(i, f"k{i % 100}") for i in range(200)], "mention_id int, key string")
    s = splits.make_splits(rows, ["key"]).collect()
    assert len(s) == 200 and len({(r.key, r.split) for r in s}) == 100
    assert sorted(s) == sorted(splits.make_splits(rows, ["key"]).collect())
    assert {k: len({r.key for r in s if r.split == k}) for k in ("train", "valid", "test")} == {"train": 70, "valid": 15, "test": 15}
    with pytest.raises(ValueError):
        splits.make_splits(rows, ["key"], (0.5, 0.2, 0.2))
    assert splits.shuffled_splits(["a", "b", "a"]) == splits.shuffled_splits(["b", "a"])


def test_whole_run(spark, toy):
    m = spark.createDataFrame([("m1", "a"), ("m2", "d syn")], "mention_id string, mention string")
    gold = spark.createDataFrame([("m1", "root", "A"), ("m2", "D", N)], "mention_id string, parent_id string, child_id string")
    r = run(PlacementConfig(k=5), toy, m, gold, timed=True)
    assert {s["k"] for s in r.scores} == {1, 5, 10, 50} and r.validity["acyclic"] == 100.0 and r.enrichment["factor"] >= 1
    p = sinks.predictions(m, gold, r.rankings, toy.titles).collect()
    assert len(p) == 2 and all(len(x.predictions) <= 10 for x in p)
    table = format_ablation(ablation(PlacementConfig(k=5), toy, m, gold), 5)
    assert [line.split("\t")[0] for line in table.split("\n")[1:]] == ["retrieval only", "+ enrichment", "- leaf priority"]
    # Bi-encoder: edges are the seeds, the enriched ones are scored by their own vectors.
    mv = spark.createDataFrame([("m1", [1.0, 0.0]), ("m2", [0.0, 1.0])], "id string, vector array<double>")
    ev = spark.createDataFrame([("A\x1fC", [0.9, 0.1]), ("root\x1fC", [2.0, 0.0]), (f"D\x1f{N}", [0.0, 3.0])], "id string, vector array<double>")
    found = run(PlacementConfig(retriever="bi_encoder", n_retrieved=1, k=5, use_leaf_priority=False), toy, m.limit(1), gold, (mv.where("id = 'm1'"), ev.where("id like 'A%'")), validate=False)
    assert [(x.parent_id, x.child_id, x.score) for x in found.rankings.orderBy("rank").collect()] == [("A", "C", 0.9), ("root", "C", -math.inf)]
    found = run(PlacementConfig(retriever="bi_encoder", n_retrieved=1, k=5), toy, m, gold, (mv, ev), validate=False)
    assert [(x.parent_id, x.child_id, x.score) for x in found.rankings.where("mention_id = 'm1'").orderBy("rank").collect()][0] == ("root", "C", 2.0)
    with pytest.raises(ValueError):
        PlacementConfig(retriever="nothing")


def test_bootstrap_of_a_clear_difference(spark):
    flags = lambda x: spark.createDataFrame([(str(i), bool(x(i))) for i in range(200)], "mention_id string, f boolean")
    at = lambda x, y, r: metrics.paired_bootstrap(flags(x), flags(y), "f", r).first()
    clear = at(lambda i: i < 150, lambda i: i < 50, 100)
    assert clear.observed == pytest.approx(50) and clear.p_value == pytest.approx(1 / 101) and 35 < clear.low < 50 < clear.high < 65
    # Ten of 200 differ, seven one way: two-sided p of d - observed, by a plain version.
    rng = random.Random(1)
    d = [1] * 7 + [-1] * 3 + [0] * 190
    plain = [sum(rng.choices(d, k=200)) / 200 for _ in range(4000)]
    faint = at(lambda i: i < 7, lambda i: 10 <= i < 13, 2000)
    assert faint.p_value == pytest.approx(sum(abs(x - 0.02) >= 0.02 - 1e-12 for x in plain) / 4000, abs=0.05)
    assert at(lambda i: i < 9, lambda i: i < 9, 50).p_value == 1


def test_bootstrap_query_takes_all_resamples(spark, monkeypatch):
    taken, plain = [], metrics.paired_bootstrap
    monkeypatch.setattr(metrics, "paired_bootstrap", lambda a, b, c, n_resamples=10_000, seed=42: taken.append(n_resamples) or plain(a, b, c, n_resamples, seed))
    queries.QUERIES["paired_bootstrap"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    assert taken == [10_000]
    flags = lambda k: spark.createDataFrame([(str(i), i % k == 0) for i in range(30)], "mention_id string, f boolean")
    b = plain(flags(2), flags(3), "f").first()
    rng = random.Random(3)
    d = sorted(sum(rng.choices([(i % 2 == 0) - (i % 3 == 0) for i in range(30)], k=30)) / 30 for _ in range(10_000))
    assert b.low == pytest.approx(100 * d[250], abs=3.4) and b.high == pytest.approx(100 * d[9750], abs=3.4)


def test_metrics_reach_rank_50(spark, monkeypatch):
    assert PlacementConfig().k == 50
    best = [("M", f"p{i}", f"c{i}", 0.5, i) for i in range(1, 61)]
    cut = lambda t, k=10, **_: spark.createDataFrame(best[:k], "mention_id string, parent_id string, child_id string, score double, rank int")
    monkeypatch.setattr(queries, "_candidates", cut)
    monkeypatch.setattr(queries.views, "mentions", lambda t: spark.createDataFrame([("M",)], "mention_id string"))
    monkeypatch.setattr(queries.views, "gold", lambda t: spark.createDataFrame([("M", "p40", "c40")], "mention_id string, parent_id string, child_id string"))
    assert {r.k: r.inr_any for r in queries.QUERIES["inr_at_k"](spark, "").collect()} == {1: 0, 5: 0, 10: 0, 50: 1}
    assert queries.QUERIES["mrr_map"](spark, "").first().rr == pytest.approx(1 / 40)
    assert {r.k for r in queries.QUERIES["leaf_nonleaf_metrics"](spark, "").collect()} == {1, 5, 10, 50}


def test_retrieved_has_no_row_cap(spark):
    t = queries.Tables(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    plan = queries.views._retrieved(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and "1000000" not in plan
