"""The pipeline's stages against plain versions on a small folder."""

import random
import zlib

import numpy as np
import pytest

from graftline.llm import decontaminate, mixing, simhash, subwords


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    parts = {"en": "the of and thin ere onst tion ing".split(), "de": "der und ung sch keit lich ein ver".split()}
    r = random.Random(1)
    make = lambda lang, n: " ".join("".join(r.choices(parts[lang], k=2)) for _ in range(n))
    rows = [(i, make("en" if i % 3 else "de", 60), "en" if i % 3 else "de", f"s{i % 3}", 1) for i in range(90)]
    rows += [(90, rows[5][1], "en", "s0", 1), (91, "12 ## 34", "en", "s1", 1), (92, None, None, None, None)]
    leak = rows[8][1].split()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(0, " ".join(leak[10:40]))], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows


def test_pipeline(spark, folder):
    import corpus_pipeline

    where, rows = folder
    docs, seen = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where).cache()
        seen[name] = docs.collect()
    texts = dict((r[0], r[1]) for r in rows)
    assert {r.doc_id for r in seen["language"]} == set(range(91))
    kept: list = []
    for i in range(91):
        if all((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4 for j in range(i)):
            kept.append(i)
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == kept and 90 not in kept
    clean = [i for i, _, _, items, _, _ in decontaminate.brute_force([(i, texts[i]) for i in kept], [(0, spark.read.parquet(f"{where}/benchmark.parquet").first().text)]) if not items]
    assert sorted(r.doc_id for r in seen["decontamination"]) == clean and 8 not in clean
    e, start = subwords.SubwordEncoder(), 0
    out = sorted(seen["tokens"], key=lambda r: r.start)
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in seen["mix"]) and set(r.doc_id for r in out) <= set(clean)
    for r in out:
        ids = np.append(e.raw(texts[r.doc_id]), 0).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, where).collect())) == sorted(map(tuple, out))
    assert mixing.WEIGHTS == (5, 2, 1)


def test_pipeline_keeps_its_files_and_takes_odd_tables(spark, folder, tmp_path):
    import corpus_pipeline
    from graftline.llm import token_files

    where, rows = folder
    spark.conf.set("spark.graftline.tokens.dir", f"file://{tmp_path}/corpora")
    try:
        got = sorted(map(tuple, corpus_pipeline.run(spark, where).collect()), key=lambda r: r[1])
    finally:
        spark.conf.unset("spark.graftline.tokens.dir")
    (made,) = (tmp_path / "corpora").iterdir()
    again = token_files.read_token_files(spark, f"file://{made}").collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in again) == sorted(got) and got
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names = ["row", "_row", "_id", "fp", "key", "start", "copies", "_copies", "_taken", "_doc"]
    for table in (docs.limit(0), docs.selectExpr("*", *[f"1 AS {n}" for n in names])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = table.columns
            table = stage(spark, table, where)
            assert table.columns == columns
        assert corpus_pipeline.tokens(spark, table, where).count() == table.count()
