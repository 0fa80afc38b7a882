"""Document fingerprints by winnowing.

Every k code points are hashed with a rolling polynomial hash; of each window of w consecutive
hashes the smallest is selected, of equal ones the rightmost, and kept with its position. Two texts
that share a passage of at least w + k - 1 code points share a selected hash (the match guarantee).
Texts of at most w hashes select their smallest one; texts of fewer than k code points have one hash
of the whole. The hash is a difference of prefix sums modulo 2 ** 64, so that all positions of a text
take a few vector operations; long texts go through in blocks, and memory is bounded.

The likeness of two fingerprints is the Jaccard coefficient of their sets of hashes, 1 for two
empty ones.

Edge cases: a null text is empty, and an empty text has the empty fingerprint; equal texts have equal
fingerprints; rows that repeat an id follow each other by text; null ids come first. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K = 16
WINDOW = 32
#: Code points taken at once.
BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    size = 1 << max(10, int(n - 1).bit_length())
    if (base, size) not in _powers:
        out = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(step)
            done, step = 2 * done, step * step & _MASK
        _powers[base, size] = out
    return _powers[base, size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all runs of k code points, by position."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:n], out=sums[1:])
    grams = (sums[k:] - sums[: n - k + 1]) * _power_table(_INVERSE, n)[: n - k + 1]
    return _mix(grams + np.uint64(k)) >> np.uint64(32)


def select(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes (uint32) and their positions (int64), by position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    keys: list[np.ndarray] = []
    low = np.uint64(0xFFFFFFFF)
    # Blocks overlap by what one window spans, so that each window lies whole in one of them.
    span = window + k - 2
    for a in range(0, max(1, n - span), BLOCK):
        h = gram_hashes(points[a : a + BLOCK + span], k)
        if not len(h):
            break
        # Hash above, position counted down below: the minimum is the smallest hash, rightmost.
        key = (h << np.uint64(32)) | (low - np.arange(a, a + len(h), dtype=np.uint64))
        width, done = min(window, len(key)), 1
        while done < width:
            step = min(done, width - done)
            key = np.minimum(key[:-step], key[step:])
            done += step
        keys.append(key[np.concatenate([[True], key[1:] != key[:-1]])])
    if not keys:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    key = np.concatenate(keys)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(32)).astype(np.uint32), (low - (key & low)).astype(np.int64)


def encode(hashes: np.ndarray) -> str:
    """The fingerprint as text: eight hexadecimal digits per selected hash, by position."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two fingerprints' sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points from the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, hashes and positions of its fingerprint."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [select(t, k, window) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                ["doc_id", "hashes", "positions"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, hashes array<bigint>, positions array<bigint>")


_PAIRS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected bigint"


def _compare(k: int, window: int):
    """Rows in the order of their ranges, each range closed by a copy of the row after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: range, id, text, selected hashes
        for batch in batches:
            out: list[tuple] = []
            for part, doc_id, text in zip(batch.column("_range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                hashes = select(text, k, window)[0]
                if held is not None and held[0] == part:
                    _, before, own, own_hashes = held
                    changed = edited(own, text)
                    changed_hashes = select(changed, k, window)[0]
                    out.append((before, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encode(own_hashes), encode(changed_hashes),
                                likeness(own_hashes, changed_hashes), likeness(own_hashes, hashes), len(own_hashes)))
                held = (part, doc_id, text, hashes)
            for a in range(0, len(out), 2000):
                columns = list(zip(*out[a : a + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()])],
                                                 [f.split()[0] for f in _PAIRS.split(", ")])

    return run


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Documents dealt into ranges of ascending id: _range, _last, doc_id, text.

    Each range also gets a copy (``_last`` = 1) of the row that follows its last one; after the last
    range this is the very first row. Bounds come from the ids alone; texts move once. The driver
    sees one row per range.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest).cast("bigint")).alias("_id"), F.col(id_col).isNull().alias("_none"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_at", F.col("_id").cast("double"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select("_at").approxQuantile("_at", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges))
    # A binary search in the JVM; equal ids share a range.
    splits = [float("-inf"), *sorted({c for c in cuts or [0.0]}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_at", outputCol="_place").transform(rows).withColumn("_range", F.col("_place").cast("int"))
    firsts = rows.select("_range", "_id").groupBy("_range").agg(F.min("_id").alias("_id")).orderBy("_range").collect()
    if not firsts:
        return rows.select("_range", F.lit(0).alias("_last"), F.col("_id").alias("doc_id"), "text")
    follows = spark.createDataFrame([(firsts[(i + 1) % len(firsts)]._id, r._range) for i, r in enumerate(firsts)], "_id bigint, _to int")
    # Of rows with the first id of a range only the first by text is copied. One row per range is broadcast.
    heads = rows.select("_id", "text").join(F.broadcast(follows), "_id").groupBy("_id", "_to").agg(F.min("text").alias("text"))
    copies = heads.select(F.col("_to").alias("_range"), F.lit(1).alias("_last"), F.lit(None).cast("bigint").alias("doc_id"), "_id", "text")
    own = rows.select("_range", F.lit(0).alias("_last"), F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "_id", "text")
    dealt = own.unionByName(copies).repartition("_range").sortWithinPartitions("_range", "_last", "_id", "text")
    return dealt.select("_range", "_last", "doc_id", "text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return with_next(docs, id_col, text_col, ranges).mapInArrow(_compare(k, window), _PAIRS)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


