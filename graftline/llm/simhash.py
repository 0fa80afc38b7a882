"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints. Words are lower-cased (A-Z); each 4-word shingle, repeats included, is hashed with
XXH64 (seed 42), and a bit of the fingerprint is set where over half of the hashes have it.

Links. Two fingerprints of eight bytes that differ in at most four bits share at least four bytes at
their positions (the guaranteed minimum). The index has a posting for each fingerprint under twenty
triples of (position, byte); the triples are a Turan system, so that any four positions contain one
of them and no pair with four shared bytes is missed. Triples instead of single bytes keep the
posting lists short: a list holds about n / 2 ** 24 unrelated fingerprints. Within a list the shared
positional bytes of a pair are tallied, pairs below four are discarded, and the rest verified bit by
bit.

Groups. Equal fingerprints are one node from the start, so copies never meet. A list hands on only a
spanning forest of its links, never all pairs. In lists of over ``DENSE`` distinct fingerprints
(large groups of near copies), those one bit apart are joined first by look-up, and then only the
fingerprints outside the largest class are compared with the whole list, in blocks: every link
between different classes has such an end.

Edge cases: texts of fewer than four words are hashed as one shingle; null and wordless texts have
the fingerprint zero and link to each other; rows with a null doc_id take part, but a component is
named by its smallest doc_id that isn't null; repeated rows link by their equal fingerprints. Other
columns pass through ``near_dedup`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Shared positional bytes guaranteed by at most MAX_BITS differing bits.
MIN_SHARED = 8 - MAX_BITS
#: Distinct fingerprints from which a posting list is first joined by single bits.
DENSE = 1024
#: Pairs compared at once.
PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1].tolist()
    hashes = np.array([digest(view[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The ``keep`` columns of every row with its fingerprint ``fp`` (bigint, the bits as signed)."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(fp.view(np.int64))], ["row", "fp"])

    return source.mapInArrow(run, schema).select("row.*", "fp")


def turan_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the positions 0 to 7 of which every four positions contain one."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for p in parts for t in combinations(p, 3)]
    for i, p in enumerate(parts):
        out += [(*two, one) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]
    return out


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of the zero bytes of each XOR: positions at which a pair has the same byte."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count((((x & low) + low) | x) & ~low)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest index of the class) after also joining a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def classes(fps: np.ndarray, dense: int = DENSE) -> np.ndarray:
    """Class of each of the distinct, sorted fingerprints under links of at most MAX_BITS bits."""
    n = len(fps)
    label = np.arange(n)
    if n > dense:
        for bit in range(64):
            other = fps ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.flatnonzero(fps[at] == other)
            label = _join(label, hit, at[hit])
        roots, sizes = np.unique(label, return_counts=True)
        rows = np.flatnonzero(label != roots[np.argmax(sizes)])
    else:
        rows = np.arange(n)
    step = max(1, PAIRS // max(1, n))
    for s in range(0, len(rows), step):
        block = rows[s : s + step]
        x = fps[block][:, None] ^ fps[None, :]
        i, j = np.nonzero(shared_bytes(x) >= MIN_SHARED)
        near = np.bitwise_count(x[i, j]) <= MAX_BITS
        label = _join(label, block[i[near]], j[near])
    return label


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Posting lists in order of their keys -> a spanning forest of each list's links."""
    rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.int64)
    empty = True
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []

    def lists(key: np.ndarray, fp: np.ndarray) -> None:
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            fps = np.unique(fp[s:e].view(np.uint64))
            label = classes(fps)
            moved = np.flatnonzero(label != np.arange(len(fps)))
            if len(moved):
                out_a.append(fps[moved].view(np.int64))
                out_b.append(fps[label[moved]].view(np.int64))

    def links() -> pd.DataFrame:
        df = pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
        out_a.clear(), out_b.clear()
        return df

    for f in frames:
        empty = False
        key = np.concatenate([rest_key, f["key"].to_numpy(np.int64)])
        fp = np.concatenate([rest_fp, f["fp"].to_numpy(np.int64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last list may go on
        if cut:
            lists(key[:cut], fp[:cut])
        rest_key, rest_fp = key[cut:], fp[cut:]
        if out_a:
            yield links()
    if not empty and len(rest_key):
        lists(rest_key, rest_fp)
        if out_a:
            yield links()


def near_links(distinct: DataFrame) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b): links that span every class of near fingerprints."""
    masks = []
    for k, triple in enumerate(turan_triples()):
        value = F.lit(0).cast("bigint")
        for p in triple:
            value = value * 256 + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
        masks.append(value + (k << 24))
    postings = distinct.select("fp", F.explode(F.array(*masks)).alias("key"))
    return postings.repartition("key").sortWithinPartitions("key").mapInPandas(_forest, "a bigint, b bigint")


def near_components(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (with the id) of every row with ``fp`` and ``component_id``."""
    fps = written(fingerprints(docs, keep, text_col), "fingerprints")
    per = written(fps.groupBy("fp").agg(F.min(id_col).alias("_first")), "distinct")
    roots = components(near_links(per.select("fp")))
    joined = per.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    smallest = joined.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = joined.where(F.col("fp") != F.col("_root")).select("fp", "_root").join(smallest, "_root").select(F.col("fp").alias("_fp"), "component_id")
    own = smallest.select(F.col("_root").alias("_fp"), "component_id")
    lookup = written(named.unionByName(own), "components")
    return fps.join(lookup, F.col("fp") == F.col("_fp")).drop("_fp")


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row; maps, which can't be hashed, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, less all but one row of each group of near copies.

    The row with the component's smallest doc_id stays; of several such rows the first by a hash of
    the row, of equal rows one. Rows without a doc_id that form a component alone keep one likewise.
    """
    columns = docs.columns
    keyed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), _row_hash(docs).alias("_hash"))
    found = near_components(keyed, ["_id", "_hash"], "_id", "_text")
    winner = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_alone")).agg(
        F.min(F.struct(F.col("_id").isNull().alias("late"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))).alias("w"))
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    key = ["_none", "_at", "_hash"]
    winner = winner.select(F.col("w.late").alias("_none"), F.coalesce("w.id", zero).alias("_at"), F.col("w.hash").alias("_hash")).distinct()
    rows = docs.select(F.struct("*").alias("_doc"), F.col(f"`{id_col}`").isNull().alias("_none"), F.coalesce(F.col(f"`{id_col}`"), zero).alias("_at"), _row_hash(docs).alias("_hash"))
    # The join and the rank among equal rows need the same partitioning: documents move once.
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    kept = rows.join(winner, key, "left_semi").select("_doc", nth.alias("_nth")).where("_nth = 1")
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns])


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
