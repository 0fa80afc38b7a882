"""Language identification with language-bitmask n-gram filters.

Training counts, per language, in how many training documents each character n-gram occurs, and puts
those of at least a set share into one bit-sliced Bloom filter: every slot holds a mask with one bit
per language, an n-gram sets its language's bit in k slots, and the AND of its k slots gives the
languages that contain it, all at once. A document's hits per language are the popcounts of the
masks of its n-grams; each is corrected for the language's rate of false positives (its share of set
slots to the power k) and divided by the share of hits that documents of the language itself have.
The largest value decides.

N-grams run over letters in lower case; all else between letters counts as one blank, also before
the first and after the last. The filter is fitted on a bounded sample: about ``SAMPLE`` training
documents per language, drawn by a hash of the id.

Edge cases: a text that is null or without a letter is ``und`` with score 0; a text with letters but
without any hit gets the first language by code point, score 0; ties go to the first by code point; a
document without lang isn't learned from; without any learned language all are ``und``. Rows that
repeat are predicted alike; a language of a single training document has all its n-grams. Very long
texts are taken whole, in memory of about 60 bytes per character; texts are taken in blocks of ``CHARS``
characters or one text. An empty table gives an empty result. Other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

N = 4
HASHES = 3
SLOT_BITS = 20
#: Training documents per language that the filter is fitted on, about.
SAMPLE = 3000
#: Share of a language's sampled documents that an n-gram must occur in, and documents at least.
MIN_SHARE = 0.004
MIN_DOCS = 2
UND = "und"
#: Pipeline: share of a document's n-grams (corrected) that its language must explain.
MIN_COVER = 0.15
#: Characters taken at once.
CHARS = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for what isn't a letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts one after the other, and how many each text has."""
    joined = "".join([("" if t is None else t) + "\n" for t in texts])
    points = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    sizes = np.fromiter((0 if t is None else len(t) for t in texts), np.int64, len(texts))
    # A blank before the first and after the last letter of each text.
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    keep = (points != 0) | np.concatenate([[True], points[:-1] != 0]) if len(points) else np.zeros(0, bool)
    kept, who = points[keep].astype(np.uint64), owner[keep]
    # Lead each text in with a blank of its own.
    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    lead = starts[kept[starts] != 0] if len(starts) else starts
    kept, who = np.insert(kept, lead, 0), np.insert(who, lead, who[lead] if len(lead) else [])
    if len(kept) < n:
        short = np.zeros(len(texts), np.int64)
        return np.empty(0, np.uint64), short
    h = np.zeros(len(kept) - n + 1, np.uint64)
    for i in range(n):
        h = (h + kept[i : len(kept) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = who[: len(h)] == who[n - 1 :]
    h, who = h[whole], who[: len(h)][whole]
    return h, np.bincount(who, minlength=len(texts))


def slots(h: np.ndarray, hashes: int = HASHES, bits: int = SLOT_BITS) -> list[np.ndarray]:
    step = (h * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return [((h + np.uint64(i) * step) >> np.uint64(64 - bits)).astype(np.int64) for i in range(hashes)]


class LanguageFilter:
    """Bit-sliced Bloom filter: ``masks[slot, word]`` holds 64 languages per word."""

    def __init__(self, langs: list[str], bits: int = SLOT_BITS, hashes: int = HASHES, n: int = N):
        self.langs, self.bits, self.hashes, self.n = langs, bits, hashes, n
        self.masks = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), np.uint64)
        self.cover = np.ones(len(langs))

    def add(self, lang: int, h: np.ndarray) -> None:
        word, bit = divmod(lang, 64)
        for s in slots(h, self.hashes, self.bits):
            self.masks[s, word] |= np.uint64(1 << bit)

    def false_rates(self) -> np.ndarray:
        fill = [((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.langs))]
        return np.asarray(fill) ** self.hashes

    def languages(self, h: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each n-gram (true ones and false positives)."""
        found = None
        for s in slots(h, self.hashes, self.bits):
            found = self.masks[s] if found is None else found & self.masks[s]
        return found

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of hits (texts x languages), and the number of n-grams per text."""
        h, counts = grams(texts, self.n)
        found = self.languages(h) if len(h) else np.zeros((0, self.masks.shape[1]), np.uint64)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        some = counts > 0
        rates = self.false_rates() if not hasattr(self, "_rates") else self._rates
        self._rates = rates
        out = np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            if some.any():
                bit = ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
                out[some, i] = np.add.reduceat(bit, starts[some]) / counts[some]
        out = np.clip((out - rates) / np.maximum(1 - rates, 1e-9), 0, 1)
        return np.where(some[:, None], out, 0.0), counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (best / (best + second)) and cover (corrected share of hits) per text."""
        names: list[str] = []
        scores, covers = np.zeros(len(texts)), np.zeros(len(texts))
        a = 0
        while a < len(texts):
            z, size = a, 0
            while z < len(texts) and (z == a or size < CHARS):
                size += len(texts[z] or "")
                z += 1
            shares, _ = self.shares(texts[a:z])
            even = shares / self.cover if len(self.langs) else shares
            letters = _letters()
            for i, t in enumerate(texts[a:z]):
                if not self.langs or t is None or not letters[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")].any():
                    names.append(UND)
                    continue
                best = int(np.argmax(even[i]))
                names.append(self.langs[best])
                top = even[i, best]
                second = np.partition(even[i], -2)[-2] if len(self.langs) > 1 else 0.0
                scores[a + i] = top / (top + second) if top > 0 else 0.0
                covers[a + i] = shares[i, best]
            a = z
        return names, scores, covers


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text (null: empty text) modulo m."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % m


def _document_grams(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}

        def counted() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                h, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "docs": c})
            held.clear()

        size = 0
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                h = np.unique(grams([text], n)[0])
                held.setdefault(lang, []).append(h)
                size += len(h)
                if size > 1 << 23:
                    yield from counted()
                    size = 0
        yield from counted()

    return run


def _own_shares(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {lang: i for i, lang in enumerate(model.langs)}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a in range(0, len(texts), 32):
                found, _ = model.shares(texts[a : a + 32])
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, len(found)), pa.array([float(found[i, place[k]]) for i, k in enumerate(langs[a : a + 32])])], ["lang", "cover"])

    return run


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
        n: int = N, min_share: float = MIN_SHARE, min_docs: int = MIN_DOCS) -> LanguageFilter:
    """Fits the filter on about ``sample`` rows per language. The driver gets the n-grams above the
    share, at most n-grams per document / share for each language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("lang is not null")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = LanguageFilter(sorted(per), n=n)
    if not per:
        return model
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, sample / v)) for k, v in per.items()], "lang string, share double")
    lot = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 20)).cast("double") / (1 << 20)
    drawn = rows.join(F.broadcast(shares), "lang").where(lot < F.col("share")).select("lang", "text")
    counts = written(drawn.mapInPandas(_document_grams(n), "lang string, gram bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("docs").alias("docs")), "grams")
    most = {r.lang: r.n for r in counts.groupBy("lang").agg(F.max("docs").alias("n")).collect()}
    # A language whose documents share no n-gram so often keeps those that most of them share.
    least = [(k, float(min(v, max(min_docs, min_share * min(per[k], sample))))) for k, v in most.items()]
    least = rows.sparkSession.createDataFrame(least, "lang string, least double")
    kept = counts.join(F.broadcast(least), "lang").where(F.col("docs") >= F.col("least")).select("lang", "gram").toPandas()
    for i, lang in enumerate(model.langs):
        model.add(i, kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64))
    # Share of hits that the sampled documents of each language have in their own filter; a language
    # of which none was drawn gets the mean of the others.
    shared = rows.sparkSession.sparkContext.broadcast(model)
    own = {r.lang: r.cover for r in drawn.mapInArrow(_own_shares(shared), "lang string, cover double").groupBy("lang").agg(F.avg("cover").alias("cover")).collect()}
    shared.destroy()
    mean = sum(own.values()) / len(own) if own else 1.0
    model.cover[:] = [max(0.05, own.get(lang, mean)) for lang in model.langs]
    return model


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """Every row as struct ``row`` (all columns as they were) with lang_pred, score and cover."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes per slot and 64 languages: 8 MB
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType)] + T._parse_datatype_string("lang_pred string, score double, cover double").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, covers = shared.value.predict(b.column("row").field(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names, pa.string()), pa.array(scores), pa.array(covers)], ["row", "lang_pred", "score", "cover"])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: LanguageFilter, min_cover: float = MIN_COVER, text_col: str = "text") -> DataFrame:
    """The documents whose language is known and explains at least ``min_cover`` of the n-grams."""
    found = predict(docs, model, text_col).where((F.col("lang_pred") != UND) & (F.col("cover") >= min_cover))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def trained_on_split(docs: DataFrame) -> LanguageFilter:
    return fit(docs.where(remainder(F.col("doc_id"), 4) != 2))


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), trained_on_split(docs))
    return found.select("row.doc_id", (remainder(F.col("row.doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "cover")
