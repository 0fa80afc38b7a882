import statistics

from graftline.operators import encoding, extraction, offload
from graftline.sources import sinks


def test_summary_equals_plain_statistics(spark):
    import random

    draw = random.Random(3)
    values = {"a": [1.0], "b": [float(draw.randrange(9)) for _ in range(5000)], "c": [draw.random() for _ in range(3000)], "d": [2.0, 5.0], "e": [3.0] * 40}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double").repartition(5)
    found = {r.g: r for r in extraction.latency_summary(rows, "g", "v").collect()}
    assert set(found) == set(values)
    for g, vs in values.items():
        r = found[g]
        assert (r.n, r.median, r.p95) == (len(vs), statistics.median(vs), sorted(vs)[max(int(0.95 * len(vs)) - 1, 0)])
        assert abs(r.mean - statistics.mean(vs)) < 1e-9 and abs(r.throughput - len(vs) / sum(vs)) < 1e-9
    assert extraction.latency_summary(rows.limit(0), "g", "v").count() == 0


def test_costs_and_table(spark):
    docs = spark.createDataFrame([(1, "Big " * 12 + "end"), (2, None), (3, "small")], "doc_id bigint, text string")
    c = {(r.config, r.doc_id): (r.bytes_sent, r.n_candidates) for r in offload.costs(docs).collect()}
    assert c["cloud_only", 1] == (51, 0) and c["edge_only", 1] == (0, 12) and c["edge_cloud", 1][1] == 12
    assert c["edge_cloud", 2] == (len("NO_CANDIDATES"), 0) and c["cloud_only", 2] == (0, 0) and len(c) == 9
    one = {"latency_ms_mean": 1.5, "throughput_docs_per_s": 2.0, "bandwidth_kb_per_doc": 0.25, "peak_memory_mb": 7.0}
    table = sinks.system_latex({"edge_cloud": one, "cloud_only": one})
    assert table.index("Cloud-only") < table.index("Proposed") and "Edge-only" not in table and "2 & 2.00 & 0.25 & 7" in table


def test_place_documents(spark):
    docs = spark.createDataFrame([("a", "Ann saw Rome", "en", [(0, 3, "PERSON", "Ann")]), ("b", "Bob ran", "xx", None), ("c", None, None, None)],
                                 "doc_id string, text string, language string, entities array<struct<start:int,end:int,type:string,text:string>>")
    out = {r.doc_id: r.placements for r in offload.place_documents(docs, ["Agent", "Place"], {"en": "{candidate}: {classes}"}).collect()}
    assert [(p.span, p.ontology_class, p.start, p.end) for p in out["a"]] == [("Ann", "Agent", 0, 3)]
    assert [p.span for p in out["b"]] == ["Bob"] and out["b"][0].ontology_class in ("Agent", "Place") and out["c"] == []
    said = []
    offload.place_documents(docs, ["Agent"], {"en": "E {candidate}", "xx": "X {candidate}"}, lambda rows: said.append(rows) or rows.selectExpr("*", "'{\"valid\": false}' AS reply")).collect()
    assert {r.prompt for r in said[0].collect()} == {"E Ann", "X Bob"}
    refused = offload.place_documents(docs, ["Agent"], {}, lambda rows: rows.selectExpr("*", "'{\"valid\": false}' AS reply"))
    assert offload.outcome_counts(refused).first().asDict() == {"n_documents": 3, "n_auto": 0, "n_review": 0, "n_discard": 0}


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "a b a")], "id bigint, text string")
    made = {r.id: r.vector for r in encoding.encode(rows, "text", lambda texts: [[len(t), t.count("a")] for t in texts], batch=2).collect()}
    assert made == {1: [5.0, 2.0], 2: [0.0, 0.0], 3: [5.0, 2.0]}
    h = {r.id: r.v for r in rows.select("id", encoding.hashed_counts("text").alias("v")).collect()}
    assert h[1] == h[3] and sum(h[1]) == 3 and (h[2] is None or sum(h[2]) == 0)
    alike = rows.select("id", encoding.cosine(encoding.hashed_counts("text"), encoding.hashed_counts("text")).alias("c"))
    assert {r.id: round(r.c, 9) for r in alike.collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
