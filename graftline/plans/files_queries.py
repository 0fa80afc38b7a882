"""Queries of the readers and writers: the tables are written as files of the JSONL data model to the
shared folder, read through the sources, and compared in SQL with the tables themselves."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction, hierarchy, metrics, offload, splits, validation
from ..schemas import NULL_ID
from ..sources import files, jsonl, sinks
from . import views
from .queries import SQL_HITS, SQL_SPANS, _hierarchy, _per, _r, query
from .views import SQL_EDGES, SQL_GOLD, Tables


def _put(t: Tables, folder: str, name: str, rows: DataFrame, *order: str) -> None:
    """Rows in order as a JSONL source: part files in the order of their names."""
    sinks.save_json_lines(rows.orderBy(*order).drop(*order), f"{folder}/{name}")


def _s(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _orders(t: Tables) -> str:
    """Edges in two part files: even keys, then odd ones."""
    folder = files.scratch_folder(t.spark, "edges")
    rows = t.orders.select(F.col("o_orderkey").alias("_k"), _s("C", "o_custkey").alias("parent_idx"), _s("O", "o_orderkey").alias("child_idx"), F.col("o_orderstatus").alias("parent"),
                           F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 3 - 1).cast("int")).alias("degree"))
    for i in (0, 1):
        _put(t, folder, f"orders_part_00{i + 1}.jsonl", rows.where(F.col("_k") % 2 == i), "_k")
    return f"{folder}/orders.jsonl"


@query("SELECT row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) - 1 AS ord, 'C' || o_custkey AS parent_idx, 'O' || o_orderkey AS child_idx FROM orders")
def source_rows(t):
    return jsonl.read_rows(t.spark, _orders(t), jsonl.schemas.EDGE, ordered=True).select("ord", "parent_idx", "child_idx")


@query("SELECT count(*) AS n_parts, min(CASE WHEN o_orderkey % 2 = 0 THEN 'orders_part_001.jsonl' END) AS first, 'orders_part_002.jsonl' AS found FROM (SELECT DISTINCT o_orderkey % 2 AS o_orderkey FROM orders)")
def source_parts(t):
    path = _orders(t)
    parts = [files.split_path(p)[1] for p in jsonl.resolve_sources(path, t.spark)]
    found = files.split_path(jsonl.find_file(files.split_path(path)[0], "2.jsonl", t.spark))[1]
    return t.spark.createDataFrame([(len(parts), parts[0], found)], "n_parts bigint, first string, found string")


@query("SELECT 'C' || o_custkey AS parent_id, 'O' || o_orderkey AS child_id, o_orderstatus AS parent_title, 'NULL' AS child_title FROM orders WHERE o_orderkey % 3 <> 2")
def source_edges(t):
    return jsonl.read_edges(t.spark, _orders(t), direct_only=True)


def _ontology(t: Tables, folder: str) -> None:
    """Nations as entities, twice where the key is even: the later row's fields count."""
    n = t.nation
    rows = n.select(F.col("n_nationkey").alias("_k"), F.lit(0).alias("_turn"), _s("N", "n_nationkey").alias("idx"), F.col("n_name").alias("title"), F.lit("old|").alias("synonyms"), _s("R", "n_regionkey").alias("parents_idx"), F.lit("early").alias("parents"))
    late = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("_k"), F.lit(1).alias("_turn"), _s("N", "n_nationkey").alias("idx"), F.lit("").alias("title"), F.lower("n_name").alias("entity"), F.lit("a||b").alias("synonyms"),
                                                  F.concat(_s("R", "n_regionkey"), F.lit("|ROOT")).alias("parents_idx"), F.lit("only one").alias("parents"))
    _put(t, folder, "x_syn_attr_hyp-all.jsonl", rows.unionByName(late, allowMissingColumns=True), "_turn", "_k")
    edges = t.customer.select(F.col("c_custkey").alias("_k"), _s("N", "c_nationkey").alias("parent_idx"), _s("C", "c_custkey").alias("child_idx"), F.col("c_name").alias("child"), (F.col("c_custkey") % 2).cast("int").alias("degree"))
    for name in ("x-edges-atomic.jsonl", "x-edges-all.jsonl"):
        _put(t, folder, name, edges, "_k")


SQL_ENTITIES = """ent AS (SELECT 'N' || n_nationkey AS id, n_nationkey AS k, n_nationkey % 2 = 0 AS late, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'a;b' ELSE 'old' END AS synonyms,
  'R' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN ';ROOT' ELSE '' END AS parents, row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, n_regionkey FROM nation)"""


@query(f"WITH {SQL_ENTITIES} SELECT id, ord, title, synonyms, parents FROM ent")
def source_entities(t):
    folder = files.scratch_folder(t.spark, "ontology")
    _ontology(t, folder)
    e = jsonl.read_entities(t.spark, f"{folder}/x_syn_attr_hyp-all.jsonl")
    return e.select("id", "ord", "title", F.array_join("synonyms", ";").alias("synonyms"), F.array_join("parents", ";").alias("parents"))


@query(f"""WITH {SQL_ENTITIES} SELECT 'title' AS kind, id AS a, title AS b FROM ent UNION ALL SELECT DISTINCT 'title', 'R' || n_regionkey, 'early' FROM ent WHERE NOT late
UNION ALL SELECT 'title', 'C' || c_custkey, c_name FROM customer UNION ALL SELECT 'parent', id, unnest(string_split(parents, ';')) FROM ent
UNION ALL SELECT 'atomic', 'N' || c_nationkey, 'C' || c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'catalogue', 'N' || c_nationkey, 'C' || c_custkey FROM customer""")
def source_hierarchy(t):
    folder = files.scratch_folder(t.spark, "ontology")
    _ontology(t, folder)
    h = jsonl.read_hierarchy(t.spark, folder)
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    out = row(h.titles, "title", "id", "title").unionByName(row(h.par, "parent", "child", "parent"))
    return out.unionByName(row(h.edges_atomic, "atomic", "parent_id", "child_id")).unionByName(row(h.edges_catalogue, "catalogue", "parent_id", "child_id"))


def _mention_rows(t: Tables) -> DataFrame:
    """Customers as mention rows: every third one is out of the base, by its label or its title."""
    k = F.col("c_custkey")
    return t.customer.select(k.alias("_k"), F.col("c_name").alias("mention"), F.col("c_mktsegment").alias("context_left"), F.lit("").alias("context_right"), _s("N-", "c_nationkey").alias("parents_concept"),
                             F.when(k % 2 == 0, _s("C", "c_custkey")).alias("children_concept"), F.when(k % 5 == 0, F.concat(_s("N-", "c_nationkey"), F.lit("-"), _s("Q", "c_custkey"), F.lit("|"))).alias("parents-children_concept"),
                             F.when(k % 3 == 0, F.lit("SCTID-less")).otherwise(_s("", "c_custkey")).alias("label_concept"), _s("L", "c_nationkey").alias("label_concept_ori"), F.when(k % 7 == 0, F.lit("NULL")).otherwise(F.col("c_name")).alias("label_title"))


def _mentions(t: Tables) -> str:
    folder = files.scratch_folder(t.spark, "mentions")
    _put(t, folder, "test.jsonl", _mention_rows(t), "_k")
    return f"{folder}/test.jsonl"


SQL_MENTIONS = """men AS (SELECT *, 'test.jsonl:' || (row_number() OVER (ORDER BY c_custkey) - 1) AS mention_id, c_custkey % 3 = 0 OR c_custkey % 7 = 0 AS out_of_kb FROM customer)"""


@query(f"WITH {SQL_MENTIONS} SELECT mention_id, c_name AS mention, c_mktsegment AS context_left, '' AS context_right, 'L' || c_nationkey AS label_concept_ori, '' AS label_concept_umls FROM men WHERE out_of_kb")
def source_mentions(t):
    return jsonl.read_mentions(t.spark, _mentions(t), out_of_kb_only=True).select("mention_id", "mention", "context_left", "context_right", "label_concept_ori", "label_concept_umls")


@query(f"""WITH {SQL_MENTIONS} SELECT mention_id, 'N-' || c_nationkey AS parent_id, CASE WHEN c_custkey % 5 = 0 THEN 'Q' || c_custkey WHEN c_custkey % 2 = 0 THEN 'C' || c_custkey ELSE 'SCTID_NULL' END AS child_id FROM men""")
def source_gold_table(t):
    return jsonl.gold_table(jsonl.read_mentions(t.spark, _mentions(t)))


@query("""SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ord, s_name AS mention, 'N' || s_nationkey AS parent_id, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey ELSE 'SCTID_NULL' END AS child_id, s_name AS label_title FROM supplier""")
def source_edge_pairs(t):
    folder = files.scratch_folder(t.spark, "pairs")
    rows = t.supplier.select(F.col("s_suppkey").alias("_k"), F.col("s_name").alias("mention"), F.concat(F.lit(" "), _s("N", "s_nationkey"), F.lit(" ")).alias("parent_concept"),
                             F.when(F.col("s_suppkey") % 2 == 0, _s("S", "s_suppkey")).otherwise(F.lit(" ")).alias("child_concept"), F.col("s_name").alias("entity_label_title"))
    _put(t, folder, "train.jsonl", rows, "_k")
    return jsonl.read_edge_pairs(t.spark, f"{folder}/train.jsonl").select("ord", "mention", "parent_id", "child_id", "label_title")


@query("""WITH m AS (SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 7 = 0 AS nil, 'L' || c_nationkey || chr(31) || c_name AS key FROM customer), k AS (SELECT DISTINCT key FROM m WHERE nil),
r AS (SELECT key, row_number() OVER (ORDER BY md5('42:' || key), key) AS i, count(*) OVER () AS n FROM k),
s AS (SELECT CASE WHEN i <= round_even(n * 0.7, 0) THEN 'train' WHEN i <= round_even(n * (0.7 + 0.15), 0) THEN 'valid' ELSE 'test_nil' END AS part FROM m JOIN r USING (key) WHERE nil)
SELECT 'native' AS mode, part, CASE WHEN part IN ('train', 'valid') THEN count(*) ELSE count(*) FILTER (WHERE nil) END AS n FROM m, (SELECT unnest(['train', 'valid', 'valid_nil', 'test_nil']) AS part) GROUP BY part
UNION ALL SELECT 'resplit', part, count(*) FROM s GROUP BY part UNION ALL SELECT 'concepts', '', count(*) FROM nation""")
def source_dataset(t):
    root = files.scratch_folder(t.spark, "dataset")
    where = jsonl.dataset_paths(root, "set")
    _ontology(t, where["ontology"])
    for name in ("train", "valid", "valid_nil", "test_nil", "test_nil_all"):
        folder, stem = files.split_path(where[f"mention_{name}"])
        _put(t, folder, stem, _mention_rows(t), "_k")
    out = None
    for mode in ("native", "resplit"):
        h, parts = jsonl.read_dataset(t.spark, root, "set", mode)
        for name, m in parts.items():
            one = m.agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), F.lit(name).alias("part"), "n")
            out = one if out is None else out.unionByName(one)
    return out.unionByName(h.concepts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("concepts").alias("mode"), F.lit("").alias("part"), "n"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS doc_id, p_name AS text FROM part WHERE p_partkey % 3 <> 0 QUALIFY row_number() OVER (ORDER BY p_partkey) <= 100")
def source_lines(t):
    path = f"{files.scratch_folder(t.spark, 'lines')}/lines.txt"
    t.part.orderBy("p_partkey").select(F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name")).alias("value")).write.text(path)
    return jsonl.read_lines(t.spark, path, 100)  # as many documents as the caller asks for


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, lang AS language, 1 AS n_entities FROM documents")
def source_documents(t):
    path = f"{files.scratch_folder(t.spark, 'documents')}/documents.jsonl"
    entity = F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("MISC").alias("type"), F.substring("text", 1, 1).alias("text"))
    sinks.save_json_lines(t.documents.select("doc_id", "text", F.col("lang").alias("language"), F.array(entity).alias("entities")), path)
    return jsonl.read_documents(t.spark, path).select("doc_id", F.md5("text").alias("digest"), "language", F.size("entities").cast("bigint").alias("n_entities"))


@query("SELECT n_name AS name, r_name AS parent, upper(n_name) AS type, n_name AS class FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_classes(t):
    path = f"{files.scratch_folder(t.spark, 'classes')}/ontology.json"
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()  # a file of 25 classes
    sinks.save_text(json.dumps({"classes": {r.n_name: {"parent": r.r_name} for r in rows}, "entity_type_mapping": {r.n_name.upper(): r.n_name for r in rows}}), path, t.spark)
    classes, mapping = jsonl.read_classes(t.spark, path)
    return classes.join(t.spark.createDataFrame(list(mapping.items()), "type string, class string"), F.col("class") == F.col("name")).select("name", "parent", "type", "class")


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'Sprache de: ' ELSE 'Language ' || coalesce(lang, 'none') || ': ' END || coalesce(text, '') AS prompt FROM documents")
def source_prompts(t):
    folder = files.scratch_folder(t.spark, "prompts")
    for name, body in (("en", "Language {language}: {text}"), ("de", "Sprache {language}: {text}")):
        sinks.save_text(body, f"{folder}/prompt_{name}.txt", t.spark)
    fields = {"language": F.coalesce("lang", F.lit("none")), "text": F.coalesce("text", F.lit(""))}
    return t.documents.select("doc_id", extraction.fill_by_language(jsonl.read_prompts(folder, t.spark), F.col("lang"), **fields).alias("prompt"))


# -- writers -------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_orderstatus, 'json' AS format FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, 'csv' FROM orders")
def sink_rows(t):
    folder = files.scratch_folder(t.spark, "rows")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    sinks.save_json_lines(rows, f"{folder}/json")
    sinks.save_csv(rows, f"{folder}/csv")
    read = t.spark.read.schema(rows.schema)
    return read.json(f"{folder}/json").withColumn("format", F.lit("json")).unionByName(read.option("header", True).csv(f"{folder}/csv").withColumn("format", F.lit("csv")))


@query("SELECT r_name AS run, r_regionkey AS n FROM region")
def sink_results(t):
    path = f"{files.scratch_folder(t.spark, 'results')}/results.json"
    sinks.save_results({r.r_name: {"n": r.r_regionkey} for r in t.region.collect()}, path, t.spark)  # a record per run
    read = t.spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<n:bigint>>")).alias("run", "r"))
    return read.select("run", "r.n")


def _lines(t: Tables, text_: str, name: str) -> DataFrame:
    path = f"{files.scratch_folder(t.spark, name)}/{name}.txt"
    sinks.save_text(text_, path, t.spark)
    return jsonl.numbered_lines(t.spark, [path]).select("ord", F.col("value").alias("line"))


SQL_CELLS = ["100 * avg(CASE WHEN in_10 > 0 THEN 1.0 ELSE 0 END)", "100 * avg(CASE WHEN in_10 = n_gold THEN 1.0 ELSE 0 END)", "100 * avg(CASE WHEN leaf_10 > 0 THEN 1.0 ELSE 0 END)", "100 * avg(CASE WHEN leaf_10 > 0 THEN 1.0 ELSE 0 END)",
             "100 * avg(CASE WHEN other_10 > 0 THEN 1.0 ELSE 0 END)", "100 * avg(CASE WHEN other_10 > 0 THEN 1.0 ELSE 0 END)"]
SQL_DIGITS = [*((c, 1) for c in SQL_CELLS), ("avg(rr)", 3), ("avg(ap)", 3)]
SQL_BOTH = " || chr(9) || ".join(f"printf('%.{d}f / %.{d}f', {c}, {c})" for c, d in SQL_DIGITS)
SQL_ONE = " || chr(9) || ".join(f"printf('%.{d}f', {c})" for c, d in SQL_DIGITS)


@query(f"""WITH {SQL_HITS}, cells AS (SELECT {SQL_BOTH} AS twice, {SQL_ONE} AS once FROM per)
SELECT 0 AS ord, array_to_string(['Model / Set', 'k', 'InR_any', 'InR_all', 'InR_any_lf', 'InR_all_lf', 'InR_any_nlf', 'InR_all_nlf', 'MRR', 'MAP'], chr(9)) AS line
UNION ALL SELECT 1, 'both' || chr(9) || '10' || chr(9) || twice FROM cells UNION ALL SELECT 2, 'one' || chr(9) || '10' || chr(9) || once FROM cells""")
def sink_score_table(t):
    record = metrics.as_percent_row(metrics.placement_scores(_per(t)), 10).first().asDict()
    return _lines(t, sinks.score_table([("both", 10, record, record), ("one", 10, record, None)]), "scores")


@query(f"""WITH RECURSIVE {SQL_EDGES}, {SQL_GOLD}, d AS (SELECT 'ROOT' AS id, 0 AS depth UNION SELECT child, depth + 1 FROM d JOIN edges ON parent = d.id), dep AS (SELECT id, min(depth) AS depth FROM d GROUP BY id),
deg AS (SELECT id, count(*) AS degree FROM (SELECT child AS id FROM edges UNION ALL SELECT parent FROM edges) GROUP BY id),
c AS (SELECT g.*, CASE WHEN CAST(substr(mention_id, 2) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS split FROM gold g),
g AS (SELECT c.*, depth, degree FROM c LEFT JOIN dep ON dep.id = parent_id LEFT JOIN deg ON deg.id = parent_id), n AS (SELECT split, mention_id, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT a.*, b.* EXCLUDE (split) FROM (SELECT split, count(*) AS v0, sum(n) AS v1, avg(n) AS v2, quantile_cont(n, 0.5) AS v3, 100.0 * count(*) FILTER (WHERE n = 1) / count(*) AS v4 FROM n GROUP BY split) a
  JOIN (SELECT split, 100.0 * count(*) FILTER (WHERE child_id = 'SCTID_NULL') / count(*) AS v5, 100.0 * count(*) FILTER (WHERE child_id <> 'SCTID_NULL') / count(*) AS v6, avg(depth) AS v7, avg(degree) AS v8 FROM g GROUP BY split) b USING (split)),
e AS (SELECT * FROM s WHERE split = 'even'), o AS (SELECT * FROM s WHERE split = 'odd')
SELECT 0 AS ord, 'Statistic' || chr(9) || 'odd' || chr(9) || 'even' || chr(9) || 'none' AS line UNION ALL """ + " UNION ALL ".join(
    f"SELECT {i + 1}, '{name}' || chr(9) || printf('%.2f', CAST(o.v{i} AS DOUBLE)) || chr(9) || printf('%.2f', CAST(e.v{i} AS DOUBLE)) || chr(9) || '-' FROM e, o" for i, name in enumerate(sinks.STATISTICS)) + """
UNION ALL SELECT 10, 'concepts (|V|)' || chr(9) || (SELECT count(*) FROM (SELECT parent FROM edges UNION SELECT child FROM edges))
UNION ALL SELECT 11, 'atomic edges' || chr(9) || (SELECT count(*) FROM edges) UNION ALL SELECT 12, 'edge catalogue (|E|)' || chr(9) || (SELECT count(*) FROM edges)""")
def sink_statistics(t):
    h = _hierarchy(t)
    e = views.edges(t).select(F.col("parent").alias("parent_id"), F.col("child").alias("child_id"))
    h = hierarchy.Hierarchy(h.concepts, h.par, h.ch, h.titles, e, e)
    gold = views.gold(t)
    odd = F.when(F.substring("mention_id", 2, 20).cast("bigint") % 2 == 0, "even").otherwise("odd")
    dep = hierarchy.depths(gold.select(F.col("parent_id").alias("id")), h.concepts, h.par)
    stats = splits.dataset_statistics(views.mentions(t).select("mention_id", odd.alias("split")), gold, dep, h.par, h.ch, "split")
    return _lines(t, sinks.statistics_report(stats, sinks.hierarchy_counts(h), ["odd", "even", "none"]), "statistics")


@query("SELECT array_to_string(['run', 'n/a', 'n/a', printf('%.1f', 100.0 * count(*) FILTER (WHERE c_custkey % 3 <> 0) / count(*)), 'n/a'], chr(9)) AS line FROM customer")
def sink_validity_table(t):
    none = F.lit(None).cast("boolean")
    flags = t.customer.select(none.alias("consistent"), none.alias("satisfiable"), (F.col("c_custkey") % 3 != 0).alias("acyclic"))
    return validation.validity_line(validation.summarise(flags), "run")


# -- edge-and-cloud runs -------------------------------------------------------------------------
SQL_COSTS = f"""{SQL_SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM spans),
p AS (SELECT doc_id, count(*) AS n, string_agg(CASE WHEN i <= 10 THEN 'CANDIDATE: ' || span || chr(10) || 'CONTEXT: ' || context END, chr(10) || '---' || chr(10) ORDER BY pos) AS payload FROM n GROUP BY doc_id),
costs AS (SELECT config, d.doc_id, CASE config WHEN 'cloud_only' THEN strlen(coalesce(d.text, '')) WHEN 'edge_only' THEN 0 ELSE strlen(coalesce(payload, 'NO_CANDIDATES')) END AS bytes_sent, CASE config WHEN 'cloud_only' THEN 0 ELSE coalesce(n, 0) END AS n_candidates
  FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id, (SELECT unnest(['cloud_only', 'edge_only', 'edge_cloud']) AS config))"""


@query(f"WITH {SQL_COSTS} SELECT config, doc_id, CAST(bytes_sent AS BIGINT) AS bytes_sent, CAST(n_candidates AS BIGINT) AS n_candidates FROM costs")
def offload_costs(t):
    return offload.costs(t.documents)


def _runs(t: Tables) -> DataFrame:
    """Latencies in place of measured ones: a function of what is sent and found."""
    cloud, edge = F.col("bytes_sent") / 7.0, F.col("n_candidates") / 3.0
    return offload.costs(t.documents).select("config", "bytes_sent", cloud.alias("cloud_latency_ms"), edge.alias("edge_latency_ms"), (cloud + edge + 1).alias("total_latency_ms"), (F.col("n_candidates") * 1.5).alias("peak_mem_mb"))


SQL_SUMMARY = f"""{SQL_COSTS}, runs AS (SELECT *, bytes_sent / 7.0 AS cloud, n_candidates / 3.0 AS edge, bytes_sent / 7.0 + n_candidates / 3.0 + 1 AS total, n_candidates * 1.5 AS mem FROM costs),
o AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY total) AS i, count(*) OVER (PARTITION BY config) AS c FROM runs),
summary AS (SELECT config, count(*) AS n, avg(total) AS latency_ms_mean, quantile_cont(total, 0.5) AS latency_ms_median, max(CASE WHEN i = greatest(CAST(floor(c * 0.95) AS BIGINT), 1) THEN total END) AS latency_ms_p95, avg(edge) AS edge_ms_mean, avg(cloud) AS cloud_ms_mean,
  1000 * count(*) / sum(total) AS throughput_docs_per_s, avg(bytes_sent) / 1024 AS bandwidth_kb_per_doc, max(mem) AS peak_memory_mb FROM o GROUP BY config)"""
SUMMARY = ("latency_ms_mean", "latency_ms_median", "latency_ms_p95", "edge_ms_mean", "cloud_ms_mean", "throughput_docs_per_s", "bandwidth_kb_per_doc", "peak_memory_mb")


@query(f"WITH {SQL_SUMMARY} SELECT config, n, {', '.join(f'round(CAST({c} AS DOUBLE), 4) AS {c}' for c in SUMMARY)} FROM summary")
def offload_summary(t):
    return offload.summary(_runs(t)).select("config", "n", *[_r(c, 4) for c in SUMMARY])


@query(r"""WITH {0} SELECT * FROM (SELECT 6 + CASE config WHEN 'cloud_only' THEN 2 WHEN 'edge_only' THEN 3 ELSE 4 END AS ord, CASE config WHEN 'cloud_only' THEN 'Cloud-only (raw text $\to$ LLM)' WHEN 'edge_only' THEN 'Edge-only (PLM, no reasoning)' ELSE 'Proposed edge--cloud' END ||
  printf(' & %.0f & %.2f & %.2f & %.0f ', CAST(latency_ms_mean AS DOUBLE), CAST(throughput_docs_per_s AS DOUBLE), CAST(bandwidth_kb_per_doc AS DOUBLE), CAST(peak_memory_mb AS DOUBLE)) || repeat(chr(92), 2) AS line FROM summary)""".replace("{0}", SQL_SUMMARY))
def sink_latex(t):
    summary = {r.config: r.asDict() for r in offload.summary(_runs(t)).collect()}  # a row per configuration
    return _lines(t, sinks.system_latex(summary), "latex").where("line LIKE '% & %' AND line NOT LIKE 'Configuration%'")


def _placed(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", F.col("lang").alias("language"), F.lit(None).cast(jsonl.schemas.DOCUMENT["entities"].dataType).alias("entities"))
    made = F.to_json(F.struct((F.col("pos") % 3 != 0).alias("valid"), F.when(F.col("pos") % 2 == 0, "Thing").otherwise("Unknown").alias("class"), F.lit(0.9).alias("confidence")))
    return offload.place_documents(docs, ["Thing", "Other"], {"en": "{candidate} {context} {classes}"}, lambda rows: rows.withColumn("reply", made), lambda a, b: F.lit(0.8))


SQL_PLACED = f"""{SQL_SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM spans),
placed AS (SELECT doc_id, pos, span, start, stop, CASE WHEN pos % 2 = 0 THEN 'Thing' ELSE 'Unknown' END AS class, 0.3 * 0.9 + CASE WHEN pos % 2 = 0 THEN 0.35 * 0.8 + 0.25 ELSE 0 END AS score FROM n WHERE i <= 10 AND pos % 3 <> 0)"""


@query(f"""WITH {SQL_PLACED} SELECT doc_id, lang AS language, coalesce(string_agg(pos || ' ' || span || ' ' || start || ' ' || stop || ' ' || class || ' ' || printf('%.3f', CAST(score AS DOUBLE)) || ' ' || CASE WHEN score >= 0.72 THEN 'auto_insert' WHEN score >= 0.55 THEN 'review_queue' ELSE 'discard' END, '; ' ORDER BY pos), '') AS placements
FROM documents LEFT JOIN placed USING (doc_id) GROUP BY doc_id, lang""")
def place_documents(t):
    one = lambda p: F.concat_ws(" ", p["pos"].cast("string"), p["span"], p["start"].cast("string"), p["end"].cast("string"), p["ontology_class"], F.format_string("%.3f", p["score"]), p["decision"])
    return _placed(t).select("doc_id", "language", F.array_join(F.transform("placements", one), "; ").alias("placements"))


@query(f"WITH {SQL_PLACED} SELECT (SELECT count(*) FROM documents) AS n_documents, count(*) FILTER (WHERE score >= 0.72) AS n_auto, count(*) FILTER (WHERE score >= 0.55 AND score < 0.72) AS n_review, count(*) FILTER (WHERE score < 0.55) AS n_discard FROM placed")
def sink_placements(t):
    path = f"{files.scratch_folder(t.spark, 'placements')}/predictions.jsonl"
    placed = _placed(t)
    sinks.save_json_lines(placed, path)
    return offload.outcome_counts(t.spark.read.schema(placed.schema).json(path))
