"""A training corpus from raw documents in five stages, each written as Parquet and read again.

The stages keep the columns of ``documents`` up to the last, which writes the corpus as token files
and returns one row per document of the mixed corpus with the place and checksum of its ids in them.
The files stay, in the folder that ``spark.graftline.tokens.dir`` names or else in one of the shared
folder (see ``token_folder``).

Every stage takes tables with further columns, whatever their names, and passes those on; an empty
table gives an empty one. Texts are taken whole at any length.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from graftline.llm import decontaminate, langid, mixing, simhash, token_files
from graftline.llm.common import scratch_path, shared_dir, table, written
from graftline.session import ship

#: A document that holds a whole window of any benchmark item leaves the corpus.
MIN_ITEMS = 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go.

    Null texts, empty ones and those without a letter have none and go, as do texts of whose n-grams
    no language explains ``langid.MIN_COVER``; ties go to the first language by code point; rows that
    repeat fare alike. Without any learned language nothing is recognised and all go.
    """
    ship(spark)
    return langid.accepted(docs, langid.trained_on_split(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    It is the one with the smallest doc_id, of several such rows (repeats too) one. Rows without a
    doc_id are members of groups like others, and of a group of such rows alone one stays. Null and
    empty texts are copies of each other.
    """
    ship(spark)
    return simhash.near_dedup(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Null and empty texts have no window and stay; benchmark items without words or text have none
    either; rows that repeat fare alike.
    """
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), min_items=MIN_ITEMS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own; texts without words are never taken; rows that repeat are
    taken each in its turn; ties in size are ordered by doc_id.
    """
    ship(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back to doc_id, start, n_tokens and ids_crc32 per document.

    Null and empty texts have the end id alone; null doc_ids come first; rows that repeat a doc_id
    follow each other.
    """
    ship(spark)
    return token_files.token_digests(docs, token_folder(spark))


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files under ``spark.graftline.tokens.dir``, where unset under the
    shared folder; it isn't removed. The newest is that of the last run."""
    base = spark.conf.get("spark.graftline.tokens.dir", None) or f"{shared_dir(spark)}/graftline-corpora"
    return f"{base.rstrip('/')}/tokens-{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", clean_of_benchmark), ("mix", mix), ("tokens", tokens)]

#: Filters, hashes and codes that SQL can't state; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}", scratch_path(spark, f"stage-{name}"))
    return docs
