"""Substring dedup by hashing lines or paragraphs.

A text is cut into units: lines (``unit="line"``), paragraphs (runs of lines up to an empty one), or
soft lines (the default): lines that also end after a sentence of ``SENTENCE`` words or more, so that
a passage that repeats inside a longer line is found too; a shorter sentence belongs to the next one,
whatever stands before it, so that equal passages are cut alike. A unit is normalised (lower case,
runs of ASCII white space to one blank, ends trimmed) and digested with 128 bits. Of equal digests
the occurrence that ranks first is kept: by doc_id (null first), then by md5 of the text, then by row
and offset. All others are repeats, of whatever length, and are removed where repeats stand side by
side (blank units between them don't count) with ``min_run`` words or more in all: a passage goes, a
boilerplate line alone stays. ``min_run=1`` removes every repeat. Offsets count code points of the
original text, and every removed span is kept.

The rows are first written with a number of their own, so that rows are told apart whatever they hold.
The first of a digest is a partial minimum; only digests that occur twice are joined back to their
units, those with at least ``HOT_SHARE`` of all units (at most its inverse of them) by broadcast, so
that no digest is gathered in a task; only spans are grouped by row.

Edge cases: a null text stays null and has no unit, an empty text has none either; blank units stay;
of rows that repeat all but one lose their repeated runs; rows that share a doc_id are documents of
their own; null ids rank first. A very long text is cut like any other, its spans are as many as its
units at most. An empty table gives an empty result. Other columns pass through ``dedup`` untouched,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, scratch_path, table, written

UNIT = "soft"
#: Words from which a sentence ends a soft line.
SENTENCE = 4
#: Words of adjacent repeated units from which they are removed: half of the passages of 50 words
#: that are to be found, as a passage's first and last sentence may be joined to others.
MIN_RUN = 25
#: Digests with at least this share of all units are joined by broadcast.
HOT_SHARE = 1e-4
_CUTS = {"line": re.compile(r"(?<=\n)"), "soft": re.compile(r"(?<=\n)|(?<=[.!?] )"), "paragraph": re.compile(r"(?<=\n\n)(?!\n)")}


def cut(text: str, unit: str = UNIT) -> list[str]:
    """The units of a text, which joined give the text."""
    if not text:
        return []
    if unit == "paragraph" or "\0" in text:
        parts = _CUTS[unit].split(text)
    else:
        marked = text.replace("\n", "\n\0")
        if unit == "soft":
            marked = marked.replace(". ", ". \0").replace("! ", "! \0").replace("? ", "? \0")
        parts = marked.split("\0")
    if not parts[-1]:
        parts.pop()
    if unit != "soft":
        return parts
    out, first = [], 0
    for i, s in enumerate(parts):
        if s[-1] == "\n" or s.count(" ") >= SENTENCE - 1 and len(s.encode("utf-8", "surrogatepass").split()) >= SENTENCE:
            out.append(s if i == first else "".join(parts[first : i + 1]))
            first = i + 1
    if first < len(parts):
        out.append("".join(parts[first:]))
    return out


def normalise(unit: str) -> bytes:
    return b" ".join(unit.lower().encode("utf-8", "surrogatepass").split())


def _units(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 500):
                rows, nth, starts, ends, words, digests = [], [], [], [], [], []
                for i, text in enumerate(texts[a : a + 500], a):
                    at = k = 0
                    for u in cut(text, unit):
                        plain, n = normalise(u), len(u)
                        if plain:
                            rows.append(i)
                            nth.append(k)
                            starts.append(at)
                            ends.append(at + n)
                            words.append(plain.count(b" ") + 1)
                            digests.append(digest(plain))
                            k += 1
                        at += n
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), batch.column("key").take(own), batch.column("uid").take(own), *(pa.array(x, pa.int32()) for x in (nth, starts, ends, words)), pa.array(d[:, 0]), pa.array(d[:, 1])],
                    ["doc_id", "key", "uid", "nth", "start", "end", "words", "d1", "d2"])

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The rows as ``row``, with doc_id, text, key (60 bits of md5) and a number of their own, and where they lie."""
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    path = scratch_path(docs.sparkSession, "rows")
    key = F.conv(F.substring(F.md5(F.encode(F.col(f"row.`{text_col}`"), "utf-8")), 1, 15), 16, 10).cast("bigint")
    kept = written(rows.select("row", key.alias("key"), F.monotonically_increasing_id().alias("uid")), "rows", path)
    return kept.select("row", F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"), "key", "uid"), path


def repeated_units(rows: DataFrame, unit: str = UNIT, hot_share: float | None = None) -> DataFrame:
    """(doc_id, text, key, uid) -> (uid, nth, start, end, words) of every unit that repeats an
    earlier one; nth counts the units of a row that aren't blank."""
    spark = rows.sparkSession
    rows = rows.select("doc_id", "text", "key", "uid").where("text <> ''")
    kind = rows.schema["doc_id"].dataType.simpleString()
    paths = [scratch_path(spark, n) for n in ("units", "firsts")]
    units = written(rows.mapInArrow(_units(unit), f"doc_id {kind}, key bigint, uid bigint, nth int, start int, end int, words int, d1 bigint, d2 bigint"), "units", paths[0])
    rank = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "key", "uid", "start")
    firsts = units.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("d1", "d2", "n", F.col("first.uid").alias("_uid"), F.col("first.start").alias("_start")), "firsts", paths[1])
    least = max(2.0, (HOT_SHARE if hot_share is None else hot_share) * units.count())
    hot = F.broadcast(firsts.where(F.col("n") >= least))  # 1 / hot_share rows at most
    again = units.select("uid", "nth", "start", "end", "words", "d1", "d2")
    often = again.join(hot, ["d1", "d2"])
    seldom = again.join(hot.select("d1", "d2"), ["d1", "d2"], "left_anti").join(firsts.where(F.col("n") < least), ["d1", "d2"])
    kept = (F.col("uid") == F.col("_uid")) & (F.col("start") == F.col("_start"))
    found = written(often.unionByName(seldom).where(~kept).select("uid", "nth", "start", "end", "words"), "repeated")
    for path in paths:
        remove(spark, path)
    return found


def long_runs(found: list[tuple[int, int, int, int]], min_run: int) -> list[tuple[int, int]]:
    """The spans of the repeated units (nth, start, end, words) in runs of at least ``min_run`` words."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    words, last = 0, -2
    for nth, start, end, n in [*sorted(found), (-1, 0, 0, 0)]:
        if nth != last + 1:
            if words >= min_run:
                out += run
            run, words = [], 0
        run.append((start, end))
        words, last = words + n, nth
    return out


_RESULT = "text string, n_units bigint, n_removed bigint, chars_removed bigint, spans array<struct<start:bigint,end:bigint>>"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, min_run: int = MIN_RUN) -> DataFrame:
    """Every row as struct ``row`` (all columns as they were) with text (less the removed units),
    n_units, n_removed, chars_removed and spans (removed, in code points of the original)."""
    rows, _ = _numbered(docs, id_col, text_col)
    gone = repeated_units(rows, unit).groupBy("uid").agg(F.collect_list(F.struct("nth", "start", "end", "words")).alias("found"))
    joined = rows.select("row", "text", "uid").join(gone, "uid", "left").select("row", "text", "found")
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType)] + T._parse_datatype_string(_RESULT).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, units, removed, chars, spans = [], [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                gone = long_runs([(s["nth"], s["start"], s["end"], s["words"]) for s in found], min_run) if found else []
                units.append(len(cut(text, unit)) if text else 0)
                removed.append(len(gone))
                chars.append(sum(b - a for a, b in gone))
                spans.append([{"start": a, "end": b} for a, b in gone])
                if gone:
                    edges = [0, *(x for s in gone for x in s), len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(units, pa.int64()), pa.array(removed, pa.int64()), pa.array(chars, pa.int64()), pa.array(spans, span)],
                ["row", "text", "n_units", "n_removed", "chars_removed", "spans"])

    return joined.mapInArrow(run, schema)


def op7_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts with counts, and the removed spans as ``start-end`` joined by commas."""
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.select("row.doc_id", "text", "n_units", "n_removed", "chars_removed", spans.alias("removed_spans"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
parts AS (
  SELECT r, doc_id, text, string_split(replace(replace(replace(replace(text, chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), chr(1)) AS p FROM d WHERE text <> ''),
sentence AS (SELECT r, doc_id, text, i, p[i] AS s FROM (SELECT r, doc_id, text, p, unnest(range(1, len(p) + 1)) AS i FROM parts) WHERE p[i] <> ''),
ended AS (SELECT *, CASE WHEN s LIKE '%' || chr(10) OR len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 4 THEN 1 ELSE 0 END AS ends FROM sentence),
placed AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ended),
unit AS (SELECT r, doc_id, any_value(text) AS text, k, string_agg(s, '' ORDER BY i) AS unit FROM placed GROUP BY r, doc_id, k),
stops AS (
  SELECT *, CAST(sum(length(unit)) OVER (PARTITION BY r ORDER BY k) AS BIGINT) AS stop, trim(regexp_replace(lower(unit), '[\x09-\x0D\x20]+', ' ', 'g')) AS n FROM unit),
known AS (
  SELECT r, k, row_number() OVER (PARTITION BY r ORDER BY k) AS nth, len(string_split(n, ' ')) AS words,
         row_number() OVER (PARTITION BY n ORDER BY doc_id NULLS FIRST, substr(md5(text), 1, 15), r, stop) > 1 AS again FROM stops WHERE n <> ''),
runs AS (SELECT *, nth - row_number() OVER (PARTITION BY r ORDER BY nth) AS island FROM known WHERE again),
summed AS (SELECT r, k, sum(words) OVER (PARTITION BY r, island) >= 25 AS gone FROM runs),
marked AS (SELECT s.r, s.k, s.unit, s.stop, coalesce(g.gone, false) AS gone FROM stops s LEFT JOIN summed g ON s.r = g.r AND s.k = g.k)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN d.text ELSE coalesce(string_agg(CASE WHEN NOT gone THEN unit END, '' ORDER BY k), '') END AS text,
       count(k) AS n_units, count(*) FILTER (WHERE gone) AS n_removed, CAST(coalesce(sum(CASE WHEN gone THEN length(unit) END), 0) AS BIGINT) AS chars_removed,
       coalesce(string_agg(CASE WHEN gone THEN CAST(stop - length(unit) AS VARCHAR) || '-' || CAST(stop AS VARCHAR) END, ',' ORDER BY k), '') AS removed_spans
FROM d LEFT JOIN marked m ON d.r = m.r GROUP BY d.r, d.doc_id, d.text
"""
