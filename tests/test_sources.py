import json

import pytest

from graftline.schemas import EDGE, NULL_ID
from graftline.sources import jsonl


def write(path, rows, bom=False):
    text = "\n\n".join(json.dumps(r) for r in rows) + "\n"
    path.write_text(("﻿" if bom else "") + text, encoding="utf-8")


def test_parts_in_order_with_bom_and_blanks(spark, tmp_path):
    write(tmp_path / "x_part_002.jsonl", [{"parent_idx": "2", "child_idx": "b"}, {"parent_idx": "3", "child_idx": "b"}], bom=True)
    write(tmp_path / "x_part_001.jsonl", [{"parent_idx": "0", "child_idx": "a", "degree": 0}, {"parent_idx": "1", "child_idx": "a", "degree": 2}], bom=True)
    path = str(tmp_path / "x.jsonl")
    rows = jsonl.read_rows(spark, path, EDGE, ordered=True).orderBy("ord").collect()
    assert [r.parent_idx for r in rows] == ["0", "1", "2", "3"] and [r.ord for r in rows] == [0, 1, 2, 3]
    assert jsonl.read_edges(spark, path, direct_only=True).count() == 3
    write(tmp_path / "x.jsonl", [{"parent_idx": "whole", "child_idx": "w"}])
    assert jsonl.resolve_sources(path) == [path]
    with pytest.raises(FileNotFoundError):
        jsonl.resolve_sources(str(tmp_path / "y.jsonl"))


def test_numbers_hold_over_many_blocks(spark, tmp_path):
    for part, first in (("a_part_1", 0), ("a_part_2", 700)):
        write(tmp_path / f"{part}.jsonl", [{"parent_idx": str(i), "child_idx": "x" * (i % 90)} for i in range(first, first + 700)], bom=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        rows = jsonl.read_rows(spark, str(tmp_path / "a.jsonl"), EDGE, ordered=True)
        assert rows.rdd.getNumPartitions() > 4
        assert all(r.ord == int(r.parent_idx) for r in rows.collect()) and rows.count() == 1400
        lines = jsonl.read_lines(spark, str(tmp_path / "a_part_1.jsonl"), 300).collect()
        assert {r.doc_id: json.loads(r.text.lstrip("\ufeff"))["parent_idx"] for r in lines} == {i: str(i) for i in range(300)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_paths_lines_documents_classes_prompts(spark, tmp_path):
    where = jsonl.dataset_paths("/data", "set")
    assert where["ontology"] == "/data/set/ontology" and where["pair_valid_nil"].endswith("/mention-edge-pair-level/valid-NIL.jsonl")
    (tmp_path / "lines.txt").write_text("one\n\n  two \nthree\n")
    assert sorted(tuple(r) for r in jsonl.read_lines(spark, str(tmp_path / "lines.txt"), 2).collect()) == [(0, "one"), (1, "two")]
    write(tmp_path / "d.jsonl", [{"doc_id": "d", "text": "Big cat", "language": "en", "entities": [{"start": 0, "end": 3, "type": "X", "text": "Big"}]}])
    assert jsonl.read_documents(spark, str(tmp_path / "d.jsonl")).first().entities[0].end == 3
    (tmp_path / "c.json").write_text(json.dumps({"classes": {"Cat": {"parent": "Animal"}, "Animal": {}}, "entity_type_mapping": {"X": "Cat"}}))
    classes, mapping = jsonl.read_classes(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in classes.collect()} == {("Cat", "Animal"), ("Animal", None)} and mapping == {"X": "Cat"}
    (tmp_path / "prompt_en.txt").write_text("Say {x}")
    (tmp_path / "prompt_kk.txt").write_text("Айт {x}", encoding="utf-8")
    (tmp_path / "other.txt").write_text("no")
    assert jsonl.read_prompts(str(tmp_path)) == {"en": "Say {x}", "kk": "Айт {x}"}


def test_dataset_modes(spark, tmp_path):
    where = jsonl.dataset_paths(str(tmp_path), "s")
    for k in ("ontology", "mentions", "pairs"):
        (tmp_path / where[k]).mkdir(parents=True)
    onto = tmp_path / where["ontology"]
    write(onto / "o_syn_attr_hyp-all.jsonl", [{"idx": "A", "title": "a"}])
    write(onto / "o-edges-atomic.jsonl", [{"parent_idx": "A", "child_idx": NULL_ID, "degree": 0}])
    write(onto / "o-edges-all.jsonl", [{"parent_idx": "A", "child_idx": NULL_ID, "degree": 0}])
    row = lambda i: {"mention": f"m{i}", "label_concept": "SCTID-less", "label_concept_ori": str(i), "parents_concept": "A"}
    for k in ("train", "valid", "valid_nil", "test_nil"):
        write(tmp_path / where[f"mention_{k}"], [row(1), {**row(2), "label_concept": "9"}])
    write(tmp_path / where["mention_test_nil_all"], [row(i) for i in range(20)])
    _, native = jsonl.read_dataset(spark, str(tmp_path), "s")
    assert {k: v.count() for k, v in native.items()} == {"train": 2, "valid": 2, "valid_nil": 1, "test_nil": 1}
    _, cut = jsonl.read_dataset(spark, str(tmp_path), "s", split_mode="resplit")
    assert {k: v.count() for k, v in cut.items()} == {"train": 14, "valid": 3, "test_nil": 3}
    with pytest.raises(ValueError):
        jsonl.read_dataset(spark, str(tmp_path), "s", split_mode="other")


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"parent_idx": "1", "child_idx": "2"}\n{oops\n')
    with pytest.raises(Exception):
        jsonl.read_edges(spark, str(tmp_path / "bad.jsonl")).collect()


def test_hierarchy_and_mentions(spark, tmp_path):
    write(tmp_path / "o_syn_attr_hyp-all.jsonl", [
        {"idx": "A", "title": "first", "parents_idx": "root", "parents": "Root", "children_idx": "C|D", "children": "c|d", "synonyms": "s|t"}, {"idx": "A", "title": "", "entity": "last", "children_idx": "C"}, {"idx": "C", "title": ""}])
    write(tmp_path / "o-edges-atomic.jsonl", [{"parent_idx": "root", "child_idx": "A", "degree": 0}, {"parent_idx": "root", "child_idx": "C", "degree": 1}])
    write(tmp_path / "o-edges-all.jsonl", [{"parent_idx": "Q", "child_idx": "A", "parent": "Quest"}])
    h = jsonl.read_hierarchy(spark, str(tmp_path))
    assert {(r.id, r.title) for r in h.titles.collect()} >= {("A", "last"), ("C", ""), ("Q", "Quest")}
    assert h.edges_atomic.count() == 1 and {(r.parent, r.child) for r in h.ch.collect()} == {("A", "C")}
    named = {r.id: r.title for r in h.resolve_titles(spark.createDataFrame([("C",), ("nobody",), (NULL_ID,), ("A",)], "id string")).collect()}
    assert named == {"C": "C", "nobody": "nobody", NULL_ID: "NULL", "A": "last"}
    write(tmp_path / "m.jsonl", [{"mention": "a", "parents_concept": "A", "label_concept": "1"}, {"mention": "b", "parents_concept": "A|B", "children_concept": "C", "label_concept": "SCTID-less"}])
    m = jsonl.read_mentions(spark, str(tmp_path / "m.jsonl"), out_of_kb_only=True)
    assert [r.mention_id for r in m.collect()] == ["m.jsonl:1"]
    assert {(r.parent_id, r.child_id) for r in jsonl.gold_table(m).collect()} == {("A", "C"), ("B", "C")}
    write(tmp_path / "p.jsonl", [{"mention": "a", "parent_concept": " A ", "child_concept": ""}])
    assert jsonl.read_edge_pairs(spark, str(tmp_path / "p.jsonl")).first().child_id == NULL_ID


def test_sample_lines(spark):
    assert jsonl.read_lines(spark, None, 7).count() == 7


def test_stream(spark, tmp_path):
    from graftline.operators.hierarchy import Hierarchy
    from graftline.streaming.mentions import mention_stream, place_stream

    e = spark.createDataFrame([("root", "A"), ("A", "C")], "parent string, child string")
    c = spark.createDataFrame([("root", "Root", [], 0), ("A", "Asthma", [], 1), ("C", "Cold", [], 2)], "id string, title string, synonyms array<string>, ord int")
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.json", [{"mention_id": "m", "mention": "asthma"}])
    q = place_stream(mention_stream(spark, str(tmp_path / "in")), Hierarchy(c, e, e, c.select("id", "title")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("parent_id = 'root' and child_id = 'A'").count() == 1
