"""Retrieval: BM25 over an inverted index, and exact dense top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_semantic_tag, tokens
from ..schemas import BM25_B, BM25_K1, HARD_NEGATIVES, NEGATIVE_POOL, TOP_CONCEPTS


@dataclass(frozen=True)
class InvertedIndex:
    """postings: doc, term, tf; docs: doc, ord, doc_len; terms: term, df, idf; one row of totals."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    totals: DataFrame


def concept_tokens(title: Column | str, synonyms: Column | str) -> Column:
    """Tokens of a concept: of its title without the semantic tag, and of its synonyms as they are."""
    syn = F.col(synonyms) if isinstance(synonyms, str) else synonyms
    return F.concat(tokens(strip_semantic_tag(title)), F.flatten(F.transform(F.coalesce(syn, F.array().cast("array<string>")), tokens)))


def build_index(docs: DataFrame, doc_col: str, token_array: Column, ord_col: str | None = None) -> InvertedIndex:
    """Documents without tokens count in the number and mean length of documents."""
    base = docs.select(F.col(doc_col).alias("doc"), F.col(ord_col or doc_col).alias("ord"), token_array.alias("_tokens"))
    sizes = base.select("doc", "ord", F.size("_tokens").cast("bigint").alias("doc_len"))
    postings = base.select("doc", F.explode("_tokens").alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    totals = sizes.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(totals)).select("term", "df", idf.alias("idf"))
    return InvertedIndex(postings, sizes, terms, totals)


def bm25_scores(index: InvertedIndex, queries: DataFrame, query_col: str, token_array: Column, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query, doc, ord, score): repeated query terms count as often as they occur.

    The postings meet the query terms before anything else, so that terms no query has never move on.
    """
    q = queries.select(F.col(query_col).alias("query"), F.explode(token_array).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = q.join(index.terms.select("term", "idf"), "term")
    hits = index.postings.join(weighed, "term").join(index.docs, "doc").crossJoin(F.broadcast(index.totals.select("avg_len")))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.greatest(F.col("avg_len"), F.lit(1e-9)))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    return hits.groupBy("query", "doc", "ord").agg(F.sum(part).alias("score"))


def top_per(scored: DataFrame, key: str, n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First n rows per key; the plain filter on the rank lets Spark cut before the shuffle."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= n)


def bm25_topk(index: InvertedIndex, queries: DataFrame, query_col: str, token_array: Column, n: int = TOP_CONCEPTS, digits: int | None = None) -> DataFrame:
    scored = bm25_scores(index, queries, query_col, token_array)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return top_per(scored, "query", n, F.desc("score"), F.asc("ord"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def dense_topk(queries: DataFrame, catalogue: DataFrame, n: int = TOP_CONCEPTS, metric: str = "cosine", digits: int | None = 6) -> DataFrame:
    """queries, catalogue: (id, vector) -> (query, id, score, rank), exact.

    A stated set of queries against the whole catalogue. Queries go out in blocks of checked size;
    each block keeps its top n per query before anything is shuffled.
    """
    import numpy as np
    import pyarrow as pa

    spark = queries.sparkSession
    spec = queries.schema["id"].dataType.simpleString(), catalogue.schema["id"].dataType.simpleString()
    width = queries.select(F.size("vector").alias("w")).first()
    dims = max(1, width.w if width else 1)
    rows_per_block = max(1, (64 << 20) // (8 * dims))  # 64 MB of vectors per broadcast
    count = queries.count()
    blocks = max(1, -(-count // rows_per_block))
    out = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        got = part.select("id", "vector").toPandas()
        ids = got["id"].to_numpy()
        q = np.array(got["vector"].tolist(), np.float64).reshape(len(got), -1)
        if metric == "cosine" and len(q):
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            ids, q = shared.value
            for batch in batches:
                names = batch.column("id").to_numpy(zero_copy_only=False)
                v = np.array(batch.column("vector").to_pylist(), np.float64).reshape(len(names), -1)
                if not len(q) or not len(v):
                    continue
                if metric == "cosine":
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for a in range(0, len(q), 1024):
                    s = q[a : a + 1024] @ v.T
                    if digits is not None:
                        s = np.round(s, digits)
                    m = min(n, s.shape[1])
                    # Ties at the edge are all kept here; the final rank decides by id.
                    edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                    i, j = np.nonzero(s >= edge[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + i]), pa.array(names[j]), pa.array(s[i, j])], ["query", "id", "score"])

        one = catalogue.select("id", "vector").mapInArrow(run, f"query {spec[0]}, id {spec[1]}, score double")
        out = one if out is None else out.unionByName(one)
    return top_per(out, "query", n, F.desc("score"), F.asc("id"))


def hard_negatives(ranked: DataFrame, gold: DataFrame, keys: list[str], n_hard: int = HARD_NEGATIVES, pool: int = NEGATIVE_POOL) -> DataFrame:
    """Best-ranked candidates of each query that aren't gold: ranked has query, keys and rank."""
    wrong = ranked.where(F.col("rank") <= pool).join(gold.select("query", *keys), ["query", *keys], "left_anti")
    return top_per(wrong, "query", n_hard, F.asc("rank"), rank="negative_rank")
