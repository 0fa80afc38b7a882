"""The operators' queries against their SQL, on tables with nulls, repeats, ties and crowded keys."""

import random

import pytest

from graftline.llm.queries import ORACLE_SQL, QUERIES

from ..test_queries import canonical

WORDS = "the of and thin ere onst tion ing ed nder whre".split()


def sentence(r, n):
    return " ".join(r.choices(WORDS, k=n)).capitalize() + r.choice(". ! ? .\n".split(" ")) + " "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    path = f"{tmp_path_factory.mktemp('tables')}"
    common = [sentence(r, 30) + sentence(r, 3) for _ in range(4)]
    texts = ["".join(r.choice([*common, sentence(r, r.randint(1, 40))]) for _ in range(r.randint(1, 12))) for _ in range(80)]
    docs = [(k, t, f"s{k % 5}") for k, t in enumerate(texts)]
    docs += [docs[3], docs[3], (90, None, "s0"), (91, "", None), (92, " \n ", None), (93, texts[0], "s1"), (None, texts[1], "s2"), (None, texts[1], "s2"), (None, None, None), (94, " ".join(texts[:6]), "s9")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    items = [("i1", texts[2][:200]), ("i2", texts[2][:90]), ("i3", common[0]), ("i4", "the"), ("i5", None), ("i6", "..."), (None, common[1]), ("i1", common[2])]
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    turns = [(c, t, r.choice(["user", "assistant", "system", "bob", None, "<|im_x"]), r.choice(["hi", None, "", "a<|im_end|>b", "long " * 9])) for c in range(20) for t in range(r.randint(1, 150))]
    turns += [(50, 3, r.choice("ab"), f"crowd {k % 100}") for k in range(900)] + [(51, None, "a", "x"), (51, None, "b", "y"), (None, 1, "a", "x"), (None, 1, "a", "x"), (52, 1, "system", "alone"), (53, -70, "a", "early"), (53, 1, "b\nc", "late")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, folder, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    ours = canonical([tuple(x) for x in df.collect()], df.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ours == canonical(cursor.fetchall(), columns)
