"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; every document of the source then has the same expected
number of copies, target / words of the source. The expected copies are prefix-summed over the
source's documents, one offset per source is added, and a document is emitted once for every
integer boundary that its stretch of the sum crosses. The offset is the one of ``TRIES`` evenly spaced
ones, started at random, that brings the source's words nearest to its target.

The order of the prefix sum goes by size class first, so that the sample is stratified by size and
the taken words come near the target. Positions are found in two steps: a count per cell (source,
size class, hash bucket), summed over the at most few ten thousand cells of a source, and a rank
within each cell. No task sees a whole source.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; sources
without words have target 0 and take nothing; a null doc_id is hashed as an empty string; rows that
repeat a doc_id are documents of their own. An empty table gives an empty result. Further columns
of the input pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, table, written

#: Weights of the sources by code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at this many times its words.
MAX_REPEAT = 3
#: Hash buckets per source and size class.
BUCKETS = 256
SEED = "mix-1"
#: Offsets tried per source, at even steps from the random one.
TRIES = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(_source, _size) rows -> one row per source: _source, source_size, target.

    Water filling in closed form: with sources ordered by size / weight, a source is capped when its
    share of what the capped sources before it leave is above ``max_repeat`` times its size. Integer
    arithmetic decides, so all engines agree.
    """
    dec = "decimal(38,0)"
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    # Windows without keys: one row per source, not per document.
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.select("_source", "source_size", w.cast("bigint").alias("w"))
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = (F.col("source_size") * max_repeat).cast(dec)
    per = per.select(
        "*",
        cap.alias("cap"),
        F.sum("source_size").over(every).cast(dec).alias("total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).cast(dec).alias("cap_before"),
        F.sum("w").over(after).cast(dec).alias("w_left"),
    )
    per = per.withColumn("capped", (F.col("total") - F.col("cap_before")) * F.col("w") > F.col("cap") * F.col("w_left"))
    per = per.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)).cast("double").alias("cap_sum"),
        F.sum(F.when(~F.col("capped"), F.col("w"))).over(every).cast("double").alias("w_rest"),
    )
    share = (F.col("total").cast("double") - F.col("cap_sum")) * F.col("w").cast("double") / F.col("w_rest")
    return per.select("_source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _size_class(size: Column) -> Column:
    """Sizes below 16 are classes of their own, above them each power of two has eight."""
    e = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(e * 8 + F.expr("shiftright(_size, length(bin(_size)) - 4)") - 8).cast("int")


def sample(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, buckets: int = BUCKETS, seed: str = SEED,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: _id, _source, _size, source_size, target, copies (0 to ceil(target / size))."""
    assert 0 < buckets <= 256
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"))
    base = written(base, "mix-sizes")
    key = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))
    cells = base.select("*", _size_class(F.col("_size")).alias("_class"), (F.conv(F.substring(key, 1, 2), 16, 10).cast("int") % buckets).alias("_bucket"))
    per_cell = cells.groupBy("_source", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.select("*", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    targets = source_targets(base, weights, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("_source").alias("_s"), "source_size", "target", rate.alias("_rate"))
    plan = per_cell.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).select(
        "_s", F.col("_class").alias("_c"), F.col("_bucket").alias("_b"), "_before", "source_size", "target", "_rate")
    rank = Window.partitionBy("_source", "_class", "_bucket").orderBy("_size", "_id")
    ranked = cells.select("*", F.row_number().over(rank).alias("_rank"))
    placed = ranked.join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    placed = written(placed.select("_id", "_source", "_size", "_bucket", "source_size", "target", "_rate", (F.col("_before") + F.col("_rank")).alias("_at")), "mix-places")

    def copies(offset: Column) -> Column:
        crossed = lambda i: F.floor(i.cast("double") * F.col("_rate") + offset)
        return F.least(crossed(F.col("_at")) - crossed(F.col("_at") - 1), F.lit(max_repeat)).cast("bigint")

    # The random offset of a source, on a grid of 1/256 (exact in a double beside any position), and
    # the others at even steps from it; the one whose words come nearest to the target is used.
    first = lambda source: F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(source, F.lit("\0")))), 1, 2), 16, 10).cast("int")
    offsets = [((first(F.col("_source")) + 256 // TRIES * j) % 256).cast("double") / 256 for j in range(TRIES)]
    tried = placed.groupBy("_source").agg(F.first("target").alias("_goal"), *[F.sum(copies(o) * F.col("_size")).alias(f"_w{j}") for j, o in enumerate(offsets)])
    gaps = F.array(*[F.struct(F.abs(F.col(f"_w{j}").cast("double") - F.col("_goal")).alias("gap"), F.lit(j).alias("j"), o.alias("offset")) for j, o in enumerate(offsets)])
    best = tried.select(F.col("_source").alias("_s"), F.array_min(gaps).cast("struct<gap:double,j:int,offset:double>")["offset"].alias("_offset"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"))
    out = placed.join(best, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return out.select("_id", "_source", "_size", "source_size", "target", copies(F.col("_offset")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every input row, with all its columns, as often as the sample takes it.

    Rows are told apart by id, source and size; rows equal in all three share out their copies in
    the order of a hash of the text.
    """
    taken = sample(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    keys = ["_id", "_source", "_size"]
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("_row"))
    rows = rows.select(F.col(f"_row.`{id_col}`").alias("_id"), F.col(f"_row.`{source_col}`").alias("_source"), word_count(F.col(f"_row.`{text_col}`")).alias("_size"), "_row",
                       F.xxhash64(F.col(f"_row.`{text_col}`")).alias("_tie"), F.lit(None).cast("bigint").alias("_copies"))
    taken = taken.where("copies > 0").select(*keys, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), (-F.col("copies")).alias("_tie"), F.col("copies").alias("_copies"))
    # Rows and what is taken of them meet in windows on the same keys, so that documents move once.
    both = rows.unionByName(taken).repartition(*keys).withColumn("_taken", F.col("_copies").isNotNull())
    both = both.select("*", F.row_number().over(Window.partitionBy(*keys, "_taken").orderBy("_tie")).alias("_nth"))
    both = both.select("*", F.max("_copies").over(Window.partitionBy(*keys, "_nth")).alias("_times"))
    joined = both.where("not _taken and _times > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))).alias("_copy"))
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def op6_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sample(table(spark, sf_dir, "documents"))
    return s.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"))


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM base GROUP BY source),
weighed AS (SELECT source, source_size, CAST(CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w FROM per),
flow AS (
  SELECT *, CAST(3 * source_size AS HUGEINT) AS cap, CAST(sum(source_size) OVER () AS HUGEINT) AS total,
         CAST(coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS cap_before,
         CAST(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS w_left
  FROM weighed),
marked AS (SELECT *, (total - cap_before) * w > cap * w_left AS capped FROM flow),
summed AS (SELECT *, CAST(coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE) AS cap_sum, CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS DOUBLE) AS w_rest FROM marked),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE (CAST(total AS DOUBLE) - cap_sum) * CAST(w AS DOUBLE) / w_rest END AS target FROM summed),
classed AS (
  SELECT doc_id, source, size, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) - 8 END AS class,
         CAST('0x' || substr(h, 1, 2) AS INTEGER) AS bucket FROM base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id NULLS FIRST) AS i FROM classed),
rated AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, r.i, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(r.source, chr(0))), 1, 2) AS INTEGER) AS h
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
tried AS (SELECT *, CAST((h + 16 * j) % 256 AS DOUBLE) / 256 AS u FROM rated, range(16) AS s(j)),
taken AS (SELECT *, CAST(least(floor(i * rate + u) - floor((i - 1) * rate + u), 3) * size AS BIGINT) AS taken FROM tried),
gaps AS (SELECT source, j, abs(CAST(sum(taken) AS DOUBLE) - any_value(target)) AS gap FROM taken GROUP BY source, j),
best AS (SELECT source, j, row_number() OVER (PARTITION BY source ORDER BY gap, j) AS k FROM gaps)
SELECT t.doc_id, t.size, t.source_size, t.target, t.taken FROM taken t JOIN best b ON t.source IS NOT DISTINCT FROM b.source AND t.j = b.j WHERE b.k = 1
"""
