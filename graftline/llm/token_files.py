"""Token-ID files: canonical length-limited Huffman coding in independent blocks.

Format. A folder with two Parquet tables, which any Hadoop file system can hold:
``codebook`` has (symbol, bits) for every id that occurs, from which the canonical code follows
(shorter first, then by id), and ``blocks`` has one row per block: ``start`` (ids of all documents
before the block), ``doc_ids`` and ``n_tokens`` of its documents, ``payload`` (the codes, most
significant bit first, with eight bytes of padding) and ``checkpoints`` (bit offset of every
``STRIDE``-th id). A block decodes alone; within it every checkpoint starts a lane, and all lanes
advance together, one table look-up per id.

Encoding takes two passes over the ids, which are packed in between to the shared folder: one that
tokenises and counts, one that codes. Only counts by id (bounded by the vocabulary) and one total
per partition reach the driver.

Edge cases: a null text is empty and yields the end id alone; null doc_ids come first; rows that
repeat a doc_id stay separate and follow each other by a hash of the text, then by text, so that many
of one doc_id (or without any) are dealt over tasks; an empty table makes files without
blocks. A very long text is one document of a block however many ids it has. Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, scratch_path, table, written
from .subwords import encoder

END_ID = 0
#: Longest code in bits; longer only if the ids that occur need it.
MAX_BITS = 16
#: Ids between two checkpoints, and ids after which a block ends with its document.
STRIDE = 64
BLOCK_TOKENS = 1 << 16

_CHUNKS = "part int, chunk int, start_in_part long, doc_ids array<bigint>, n_tokens array<bigint>, ids binary"
_BLOCKS = "start long, doc_ids array<bigint>, n_tokens array<bigint>, checkpoints array<bigint>, payload binary"
_RECORDS = "doc_id long, start long, n_tokens long, ids binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol (0 where the count is 0) by package-merge: optimal under the limit."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        bits[used] = 1
        return bits
    limit = max(limit, int(n - 1).bit_length())
    by_count = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[by_count].astype(np.float64)
    packages, leaf_marks = np.empty(0), []
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        order = np.argsort(merged, kind="stable")
        leaf_marks.append(order < n)
        merged = merged[order]
        pairs = len(merged) // 2
        packages = merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    take = 2 * n - 2
    for marks in reversed(leaf_marks):
        chosen = int(marks[:take].sum())
        bits[by_count[:chosen]] += 1
        take = 2 * (take - chosen)
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Canonical codes for the code lengths: by length, then by symbol."""
    codes = np.zeros(len(bits), np.uint64)
    used = np.flatnonzero(bits)
    order = used[np.argsort(bits[used], kind="stable")]
    lengths = bits[order].astype(np.int64)
    if len(order):
        longest = int(lengths.max())
        room = (1 << (longest - lengths)).astype(np.uint64)
        at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(room)[:-1].astype(np.uint64)])
        codes[order] = at >> (longest - lengths).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """Codes of the ids back to back, and the bit offset of every stride-th id."""
    lengths = bits[ids].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = int(ends[-1]) if len(ends) else 0
    # Codes take at most 32 bits, so each lies in a 64-bit window that begins at a 32-bit word.
    word, shift = starts >> 5, (64 - (starts & 31) - lengths).astype(np.uint64)
    window = codes[ids] << shift
    n_words = (total >> 5) + 2
    high = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n_words)
    low = np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
    words = (high + low).astype(np.uint32)  # bits are disjoint: sums are exact and below 2 ** 32
    return words.astype(">u4").tobytes() + bytes(8), starts[::stride].copy()


class Decoder:
    """Table-driven decoding: a look-up of the next bits gives an id and its code length."""

    def __init__(self, bits: np.ndarray):
        self.width = max(1, int(bits.max(initial=1)))
        used = np.flatnonzero(bits)
        order = used[np.argsort(bits[used], kind="stable")]
        room = (1 << (self.width - bits[order].astype(np.int64)))
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.length = np.ones(1 << self.width, np.uint8)
        filled = int(room.sum())
        self.symbol[:filled] = np.repeat(order, room)
        self.length[:filled] = np.repeat(bits[order], room)

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int, stride: int = STRIDE) -> np.ndarray:
        if n == 0:
            return np.empty(0, np.uint32)
        raw = np.frombuffer(payload, np.uint8)
        at = np.asarray(checkpoints, np.int64).copy()
        out = np.zeros((len(at), stride), np.uint32)
        last = n - (len(at) - 1) * stride  # ids of the last lane
        # Big-endian 64-bit windows at any byte.
        view = np.lib.stride_tricks.as_strided(raw[:8].view(">u8"), (len(raw) - 7,), (1,))
        mask, move = np.uint64((1 << self.width) - 1), np.uint64(64 - self.width)
        lanes = len(at)
        for i in range(stride):
            if i == last:
                lanes -= 1
                if not lanes:
                    break
            here = at[:lanes]
            window = view[here >> 3].astype(np.uint64)
            peek = (window >> (move - (here & 7).astype(np.uint64))) & mask
            out[:lanes, i] = self.symbol[peek]
            at[:lanes] = here + self.length[peek]
        return out.reshape(-1)[:n]


def _tokenise(path: str | None, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(path), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        chunk = done = held = 0

        def row() -> pa.RecordBatch:
            name, size = pa.concat_arrays(names), pa.array(np.concatenate(sizes), pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (name, size)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([done], pa.int64()), *lists, pa.array([np.concatenate(ids).tobytes()], pa.binary())],
                ["part", "chunk", "start_in_part", "doc_ids", "n_tokens", "ids"])

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                few = batch.slice(a, 1024)
                own, counts = e.encode_column(few.column("text"))
                ends = np.cumsum(counts + 1)
                line = np.full(int(ends[-1]), end_id, e.dtype)
                inner = np.ones(len(line), bool)
                inner[ends - 1] = False
                line[inner] = own
                at = before = 0
                while at < few.num_rows:  # as many documents as fill a block
                    z = min(few.num_rows, int(np.searchsorted(ends, before + block - held)) + 1)
                    ids.append(line[before : ends[z - 1]])
                    names.append(few.column("doc_id").slice(at, z - at))
                    sizes.append(counts[at:z] + 1)
                    held += int(ends[z - 1]) - before
                    at, before = z, int(ends[z - 1])
                    if held >= block:
                        yield row()
                        ids, names, sizes, chunk, done, held = [], [], [], chunk + 1, done + held, 0
        if names:
            yield row()

    return run


def _count(width: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for b in batch.column("ids"):
                total += np.bincount(np.frombuffer(b.as_buffer(), f"<u{width}"), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["symbol", "n"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                      max_bits: int = MAX_BITS, block: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises all documents in ascending id order and writes the two tables under ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    held = scratch_path(spark, "ids")
    chunks = written(ordered.mapInArrow(_tokenise(tokenizer, end_id, block), _CHUNKS), "ids", held)
    e = encoder(tokenizer)
    width, vocabulary = e.dtype.itemsize, e.vocabulary
    # At most one row per id of the vocabulary, and one per partition.
    per_id = chunks.select("ids").mapInArrow(_count(width, vocabulary), "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    per_part = chunks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("n")).orderBy("part").collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in per_id:
        counts[r.symbol] = r.n
    bits = code_lengths(counts, max_bits)
    before, total = {}, 0
    for r in per_part:
        before[r.part], total = total, total + r.n
    used = np.flatnonzero(bits)
    book = spark.createDataFrame(pd.DataFrame({"symbol": used.astype(np.int32), "bits": bits[used].astype(np.int32)}), "symbol int, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((bits, before))  # a byte per id of the vocabulary, a number per partition

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, before = shared.value
        codes = canonical_codes(bits)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                few = batch.slice(a, 16)
                packed = [pack(np.frombuffer(b.as_buffer(), f"<u{width}"), bits, codes) for b in few.column("ids")]
                start = [before[k] + n for k, n in zip(few.column("part").to_pylist(), few.column("start_in_part").to_pylist())]
                marks = pa.array([m for _, m in packed], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), few.column("doc_ids"), few.column("n_tokens"), marks, pa.array([x for x, _ in packed], pa.binary())], ["start", "doc_ids", "n_tokens", "checkpoints", "payload"])

    chunks.mapInArrow(encode, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    shared.destroy()
    remove(spark, held)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids (little-endian
    unsigned 32-bit)."""
    book = spark.read.schema("symbol int, bits int").parquet(f"{path}/codebook").toPandas()
    bits = np.zeros(int(book["symbol"].max() if len(book) else 0) + 1, np.uint8)
    bits[book["symbol"]] = book["bits"]
    shared = spark.sparkContext.broadcast(bits)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                names, sizes = batch.column("doc_ids")[i].values, batch.column("n_tokens")[i].values.to_numpy()
                ids = decoder.unpack(batch.column("payload")[i].as_buffer(), batch.column("checkpoints")[i].values.to_numpy(), int(sizes.sum()))
                ends = np.cumsum(sizes)
                places = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype("<i4" if 4 * ends[-1] < 1 << 31 else "<i8").tobytes())
                kind, make = (pa.binary(), pa.BinaryArray) if 4 * ends[-1] < 1 << 31 else (pa.large_binary(), pa.LargeBinaryArray)
                column = make.from_buffers(kind, len(sizes), [None, places, pa.py_buffer(ids.astype("<u4").tobytes())])
                start = batch.column("start")[i].as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([names, pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), column.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, _RECORDS)


def token_digests(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files and reads them back to one row per document with the crc32 of its ids."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, **options)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


