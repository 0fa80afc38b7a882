"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.
A benchmark item gives one pattern per window of eight consecutive words (an item of fewer words is
one window); patterns and documents are written as words between single blanks, so that an
occurrence of a window is an occurrence of its string. The search is Wu and Manber's: for a group of
patterns of at least ``m`` bytes, a table over blocks of ``B`` bytes says how far the scan may jump;
where it says 0, the block's hash selects a bucket of patterns, and these are compared directly.
Patterns are grouped by length so that short ones don't shorten the jumps of long ones. The scan
runs over a whole batch of documents in many lanes at once, each with its own position.

The patterns of at most ``BLOCK_BYTES`` of benchmark text are broadcast at a time. A larger benchmark
is searched in blocks of items, one scan over the documents per block, and merged per document.

Edge cases: null and empty texts have no words; items without words are never found; items that
share a window are all found by it; rows that repeat an item_id are one item; an item without an id
marks words but isn't counted; rows that repeat a doc_id stay separate; an empty benchmark leaves all
documents clean. Other columns pass through ``decontaminated`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

WINDOW = 8
#: Items with occurring windows from which a document counts as contaminated.
MIN_ITEMS = 2
#: Benchmark text searched at once: 2 MB make about 300,000 patterns, 200 MB in a worker.
BLOCK_BYTES = 2 << 20
#: Bytes per block of the shift table at most, and the table's size as a power of 2.
BLOCK = 8
TABLE_BITS = 20
#: Bytes that one lane of the scan covers, and documents scanned at once (in bytes of their words).
LANE = 512
SCAN_BYTES = 4 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _translation() -> bytes:
    out = bytearray(range(256))
    for c in range(128):
        if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123):
            out[c] = 32
        elif 65 <= c < 91:
            out[c] = c + 32
    return bytes(out)


_TABLE = _translation()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The patterns of an item: its windows between blanks."""
    w = words_of(text)
    if not w:
        return []
    return [b" " + b" ".join(w[i : i + window]) + b" " for i in range(max(1, len(w) - window + 1))]


class _Group:
    """Shift table and suffix buckets for patterns of at least m bytes."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        self.m = m = min(len(p) for _, p in patterns)
        self.b = b = min(BLOCK, m)
        self.keep = np.uint64((1 << (8 * b)) - 1)
        self.shift = np.full(1 << TABLE_BITS, m - b + 1, np.int64)
        heads = np.frombuffer(b"".join(p[:m] for _, p in patterns), np.uint8).reshape(len(patterns), m)
        for end in range(b, m + 1):
            np.minimum.at(self.shift, self.hash(self._blocks(heads[:, end - b : end])), m - end)
        self.buckets: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for (k, p), h in zip(patterns, self.hash(self._blocks(heads[:, m - b :])).tolist()):
            self.buckets[h].append((k, p))

    def _blocks(self, columns: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(columns), 8), np.uint8)
        wide[:, : self.b] = columns
        return wide.view("<u8").reshape(-1)

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        return (((blocks & self.keep) * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, buffer: bytes, size: int, view: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(pattern, start, end) of every occurrence in buffer[:size]; view: 64-bit words at any byte."""
        m, b = self.m, self.b
        at = np.arange(m, size + 1, LANE)  # ends of the window of m bytes
        stop = np.minimum(at + LANE, size + 1)
        while len(at):
            h = self.hash(view[at - b])
            jump = self.shift[h]
            for i in np.flatnonzero(jump == 0):
                start = int(at[i]) - m
                for k, p in self.buckets.get(int(h[i]), ()):
                    if buffer.startswith(p, start, size):
                        yield k, start, start + len(p)
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]


class Searcher:
    """All windows of a set of (item_id, text) rows, ready to search documents."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        owners: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            for p in windows_of(text, window):
                owners[p].add(item)
        self.patterns = list(owners)
        self.owners = [owners[p] for p in self.patterns]
        self.n_words = [p.count(b" ") - 1 for p in self.patterns]
        groups: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for k, p in enumerate(self.patterns):
            groups[min(len(p).bit_length(), 6)].append((k, p))
        self.groups = [_Group(g) for _, g in sorted(groups.items())]

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
        """Per text: number of words, merged spans of hit words [a, b), ids of items with occurrences."""
        words = [words_of(t) for t in texts]
        out: list = [None] * len(texts)
        a = 0
        while a < len(texts):
            parts, size, z = [], 0, a
            while z < len(texts) and (z == a or size < SCAN_BYTES):
                parts.append(b" " + b" ".join(words[z]) + b" ")
                size += len(parts[-1])
                z += 1
            self._scan_joined(parts, [len(w) for w in words[a:z]], out, a)
            a = z
        return out

    def _scan_joined(self, parts: list[bytes], n_words: list[int], out: list, first: int) -> None:
        ends = np.cumsum([len(p) for p in parts])
        size = int(ends[-1])
        buffer = b"".join(parts) + bytes(8)
        raw = np.frombuffer(buffer, np.uint8)
        view = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,))
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for g in self.groups:
            if size >= g.m:
                for k, start, _ in g.search(buffer, size, view):
                    found[int(np.searchsorted(ends, start, "right"))].append((start, k))
        for i, n in enumerate(n_words):
            if i not in found:
                out[first + i] = (n, [], set())
                continue
            begin = int(ends[i]) - len(parts[i])
            blanks = np.flatnonzero(raw[begin : int(ends[i])] == 32)
            mark = np.zeros(n + 1, np.int64)
            items: set = set()
            for start, k in found[i]:
                w = int(np.searchsorted(blanks, start - begin))
                mark[w] += 1
                mark[min(n, w + self.n_words[k])] -= 1
                items |= self.owners[k]
            hit = np.concatenate([[0], (np.cumsum(mark[:n]) > 0).astype(np.int8), [0]])
            edges = np.flatnonzero(np.diff(hit))
            out[first + i] = (n, [(int(s), int(e)) for s, e in edges.reshape(-1, 2)], items)


_MATCHES = "n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"


def match(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
          text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every document with n_words, spans of hit words and the ids of found items."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    row_type = source.schema["row"].dataType
    schema = T.StructType([T.StructField("row", row_type)] + T._parse_datatype_string(_MATCHES).fields)
    if blocks > 1:
        source = written(source.select("*", F.monotonically_increasing_id().alias("_n")), "documents")

    def scan(searcher, key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = searcher.value
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            for batch in batches:
                found = s.scan(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    batch.column(key), pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in spans] for _, spans, _ in found], span),
                    pa.array([sorted(x for x in i if x is not None) for _, _, i in found], pa.list_(pa.string()))], [key, "n_words", "spans", "items"])

        return run

    def searcher(k: int):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        # A block's text is bounded by block_bytes on average; it is what one broadcast holds.
        return spark.sparkContext.broadcast(Searcher([(r.item, r.text) for r in own.collect()], window))

    if blocks == 1:
        return source.mapInArrow(scan(searcher(0), "row"), schema).select("row.*", "n_words", "spans", "items")
    found = None
    by_row = T.StructType([T.StructField("_n", T.LongType())] + schema.fields[1:])
    for k in range(blocks):
        one = written(source.mapInArrow(scan(searcher(k), "_n"), by_row).where("n_words > 0 and size(spans) > 0"), f"matches-{k}")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("_n").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Overlapping spans of different blocks melt into one.
    melt = """aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (acc, s) ->
        if(size(acc) > 0 and element_at(acc, -1).b >= s.a,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, s.b)))),
           concat(acc, array(s))))"""
    merged = merged.select("_n", F.expr(melt).alias("spans"), "items")
    words = F.regexp_count(F.regexp_replace(F.col("text"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "), F.lit("[^ ]+"))
    none = "array<struct<a:bigint,b:bigint>>"
    return source.select("row", "_n", F.coalesce(words.cast("bigint"), F.lit(0).cast("bigint")).alias("n_words")).join(merged, "_n", "left").select(
        "row.*", "n_words", F.coalesce("spans", F.array().cast(none)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, **options) -> DataFrame:
    """The documents, with all their columns, in which windows of fewer than ``min_items`` items occur."""
    found = match(docs.select(F.struct("*").alias("_doc"), F.col(f"`{options.get('text_col', 'text')}`").alias("text")), benchmark, ["_doc"], **{**options, "text_col": "text"})
    return found.where(F.size("items") < min_items).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def digest(found: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    n = F.size("items").cast("bigint")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS p
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM pat),
win AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT win.r, win.i, win.k, pat.item FROM win JOIN pat ON win.p = pat.p AND win.k = pat.k),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain statement of the result, for tests."""
    out = []
    wanted = [(i, words_of(t)) for i, t in items]
    for d, text in docs:
        w = words_of(text)
        hit, ids = set(), set()
        for item, v in wanted:
            k = min(window, len(v))
            for j in range(len(v) - k + 1) if v else ():
                for a in range(len(w) - k + 1):
                    if w[a : a + k] == v[j : j + k]:
                        hit |= set(range(a, a + k))
                        ids.add(item)
        named = sorted(str(x) for x in ids if x is not None)
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), len(named) >= MIN_ITEMS))
    return out
