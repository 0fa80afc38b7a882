"""Scalar text functions as column expressions: normalisation, tokens, serialised mentions and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CHILD_TAG, MAX_CONTEXT_WORDS, MENTION_END, MENTION_START, NULL_TAG, NULL_TITLE, OUT_OF_KB, PARENT_TAG

#: White space in the Unicode sense, at either end.
_ENDS = r"(?U)^\s+|\s+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), _ENDS, "")


def split_pipe(x: Column | str) -> Column:
    """Parts of a pipe-delimited list, empty ones dropped; null gives an empty array."""
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"\|"), lambda p: p != "")


def normalise_label(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(x)), r"(?U)\s+", " ")


def strip_semantic_tag(x: Column | str) -> Column:
    """Removes one bracketed group at the end of a title."""
    return strip(F.regexp_replace(_c(x), r"(?U)\s*\([^()]*\)\s*$", ""))


def tokens(x: Column | str) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("[a-z0-9]+"), 0)


def is_complex(x: Column | str) -> Column:
    c = F.coalesce(_c(x), F.lit(""))
    return F.contains(c, F.lit("[")) | F.contains(c, F.lit("<"))


def is_out_of_kb(label_concept: Column | str, label_title: Column | str) -> Column:
    return (F.coalesce(_c(label_concept), F.lit("")) == OUT_OF_KB) | (F.upper(strip(F.coalesce(_c(label_title), F.lit("")))) == NULL_TITLE)


def _words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def _context(x: Column, limit: int | None, tail: bool) -> Column:
    """A trimmed context; only one of more words than the limit is cut, and then rejoined by blanks."""
    x = strip(F.coalesce(x, F.lit("")))
    if not limit or limit < 0:
        return x
    w = _words(x)
    part = F.slice(w, -limit, limit) if tail else F.slice(w, 1, limit)
    return F.when(F.size(w) > limit, F.array_join(part, " ")).otherwise(x)


def serialize_mention(left: Column | str, mention: Column | str, right: Column | str, max_words: int | None = MAX_CONTEXT_WORDS) -> Column:
    gone = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(" ", gone(_context(_c(left), max_words, True)), F.lit(MENTION_START), gone(strip(F.coalesce(_c(mention), F.lit("")))),
                       F.lit(MENTION_END), gone(_context(_c(right), max_words, False)))


def serialize_edge(parent: Column | str, child: Column | str) -> Column:
    c = strip(F.coalesce(_c(child), F.lit("")))
    c = F.when((c == "") | (F.upper(c) == NULL_TITLE), F.lit(NULL_TAG)).otherwise(c)
    return strip(F.concat(strip(F.coalesce(_c(parent), F.lit(""))), F.lit(f" {PARENT_TAG} "), c, F.lit(f" {CHILD_TAG}")))


def serialize_cross(left, mention, right, parent, child, max_words: int | None = MAX_CONTEXT_WORDS) -> Column:
    return F.struct(serialize_mention(left, mention, right, max_words).alias("a"), serialize_edge(parent, child).alias("b"))


def concept_text(title: Column | str, synonyms: Column | str) -> Column:
    return F.concat_ws(" ; ", _c(title), _c(synonyms))


def gold_edges(pairs: Column | str, parents: Column | str, children: Column | str, null_id: str) -> Column:
    """Gold edges of a mention row as an array of (parent_id, child_id), without repeats.

    A chunk of ``pairs`` is cut after the longest listed parent that it starts with, else at its last
    hyphen; without chunks every parent meets every child, or the leaf sentinel.
    """
    chunks, ups, downs = split_pipe(pairs), split_pipe(parents), split_pipe(children)
    edge = lambda p, c: F.struct(p.alias("parent_id"), c.alias("child_id"))
    or_leaf = lambda c: F.when(c == "", F.lit(null_id)).otherwise(c)

    def one(chunk: Column) -> Column:
        known = F.array_max(F.transform(F.filter(ups, lambda p: F.startswith(chunk, F.concat(p, F.lit("-")))), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
        last = F.regexp_extract(chunk, r"(?s)^(.*)-([^-]*)$", 1)
        rest = F.regexp_extract(chunk, r"(?s)^(.*)-([^-]*)$", 2)
        return F.when(known.isNotNull(), edge(known, or_leaf(F.substring(chunk, F.length(known) + 2, F.length(chunk))))).otherwise(edge(last, or_leaf(rest)))

    paired = F.filter(F.transform(chunks, one), lambda e: e["parent_id"] != "")
    ends = F.when(F.size(downs) > 0, downs).otherwise(F.array(F.lit(null_id)))
    crossed = F.flatten(F.transform(ups, lambda p: F.transform(ends, lambda c: edge(p, c))))
    return F.array_distinct(F.when(F.size(chunks) > 0, paired).otherwise(crossed))
