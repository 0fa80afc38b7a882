"""Expectations of the scalar functions, over one-row tables."""

import pytest
from pyspark.sql import functions as F

from graftline.functions import prompts, text
from graftline.functions.expressions import verbalise
from graftline.schemas import NULL_ID


def one(spark, column, **values):
    schema = ", ".join(f"`{k}` string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("left, mention, right, expected", [
    ("left ctx", "cystic fibrosis", "right ctx", "left ctx [Ms] cystic fibrosis [Me] right ctx"),
    ("", "renal failure", "", "[Ms] renal failure [Me]"),
    (None, "", None, "[Ms] [Me]"),
    ("a  b", "m", "c", "a  b [Ms] m [Me] c"),
])
def test_serialize_mention(spark, left, mention, right, expected):
    assert one(spark, text.serialize_mention("l", "m", "r"), l=left, m=mention, r=right) == expected


def test_long_context_keeps_the_nearest_words(spark):
    words = [str(i) for i in range(100)]
    got = one(spark, text.serialize_mention("l", "m", "r", 64), l=" ".join(words), m="x", r="  ".join(words))
    assert got == " ".join(words[36:]) + " [Ms] x [Me] " + " ".join(words[:64])


@pytest.mark.parametrize("child", [None, "NULL", "null", ""])
def test_serialize_leaf_edge(spark, child):
    assert one(spark, text.serialize_edge("p", "c"), p="renal failure", c=child) == "renal failure [P-TAG] [NULL] [C-TAG]"


def test_verbalise():
    titles = {"609096000": "Role group (attribute)", "42752001": "Due to (attribute)", "55985003": "Atopic reaction (disorder)"}
    said = verbalise("[EX.](<609096000> [EX.](<42752001> <55985003>))", titles)
    assert said == "something that is Role group (attribute) some something that is Due to (attribute) some Atopic reaction (disorder)"
    assert verbalise("", titles) == "" and verbalise("<1> <55985003>", titles) == "1 Atopic reaction (disorder)"


@pytest.mark.parametrize("pairs, parents, children, expected", [
    ("233661002-81423003|233661002-190909002", "233661002", "81423003|190909002", {("233661002", "81423003"), ("233661002", "190909002")}),
    (f"[EX.](<1-2> <3>)-{NULL_ID}", "[EX.](<1-2> <3>)", "", {("[EX.](<1-2> <3>)", NULL_ID)}),
    ("", "A|B", "C", {("A", "C"), ("B", "C")}),
    (None, "A", None, {("A", NULL_ID)}),
    ("A-B-C|x|-y", "A|A-B", "C", {("A-B", "C")}),
])
def test_gold_edges(spark, pairs, parents, children, expected):
    got = one(spark, text.gold_edges("e", "p", "c", NULL_ID), e=pairs, p=parents, c=children)
    assert {tuple(x) for x in got} == expected and len(got) == len(expected)


def test_labels_and_tags(spark):
    assert one(spark, text.normalise_label("x"), x="  Acute  Renal\tFailure ") == "acute renal failure"
    assert one(spark, text.strip_semantic_tag("x"), x="Asthma (severe) (disorder) ") == "Asthma (severe)"
    assert one(spark, text.tokens("x"), x="Ménière's 2 TYPES") == ["m", "ni", "re", "s", "2", "types"]
    assert one(spark, text.split_pipe("x"), x="|a||b|") == ["a", "b"] and one(spark, text.split_pipe("x"), x=None) == []


def test_out_of_kb(spark):
    flag = text.is_out_of_kb("a", "b")
    assert one(spark, flag, a="SCTID-less", b="x") and one(spark, flag, a="1", b=" null ") and not one(spark, flag, a="1", b="x")


@pytest.mark.parametrize("reply, expected", [
    ("### Response\n2, 3", [1, 2]), ("1, 7, 99", [0]), ("none", []), ("### Response 1\n### Response\n3 3 1", [2, 0]), ("None of 1", []), ("99999999999999999999 2", [1]),
])
def test_parse_response(spark, reply, expected):
    assert one(spark, prompts.parse_response(F.col("x"), F.lit(3)), x=reply) == expected


def test_prompt_round_trip(spark):
    edges = F.array(F.struct(F.lit("A (disorder)").alias("parent"), F.lit("C (disorder)").alias("child")), F.struct(F.lit("D (disorder)").alias("parent"), F.lit("NULL").alias("child")))
    assert one(spark, prompts.format_candidates(edges)) == "1. A (disorder) -> C (disorder)\n2. D (disorder) -> NULL"
    target = one(spark, prompts.explanation_target(F.lit("m"), edges, F.array(F.lit(2))))
    assert one(spark, prompts.parse_response(F.col("x"), F.lit(2)), x=target) == [1]
    assert one(spark, prompts.extract_explanation(F.col("x")), x=target).startswith("1. The mention is: m.")
    prompt = one(spark, prompts.build_prompt(F.lit("l"), F.lit("m"), F.lit("r"), edges))
    assert not one(spark, prompts.leaks(F.col("x"), F.col("x")), x=prompt)
    assert one(spark, prompts.leaks(F.concat("x", F.lit("\n### Response\n1")), F.col("x")), x=prompt)
    assert one(spark, prompts.plain_target(F.array().cast("array<int>"))) == "### Response\nnone"
