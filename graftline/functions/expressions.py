"""Complex concept ids in words.

An id like ``[EX.](<r> <f>)`` says "something with role r some filler f"; fillers nest. The parser
runs in an Arrow UDF over distinct complex ids only; their atomic ids come with titles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import is_complex

_LEX = re.compile(r"\[EX\.\]|[()]|<[^<>()\s]+>|[^\s()<>]+")


def parse(expression: str) -> list:
    """Nested lists of words: an existential is a list that begins with the mark."""
    stack: list[list] = [[]]
    for token in _LEX.findall(expression or ""):
        if token == "(":
            stack.append([])
        elif token == ")" and len(stack) > 1:
            group = stack.pop()
            exists = bool(stack[-1]) and stack[-1][-1] == "[EX.]"
            if exists:
                stack[-1].pop()
            stack[-1].append(("some", group) if exists else ("all", group))
        else:
            stack[-1].append(token)
    while len(stack) > 1:
        group = stack.pop()
        stack[-1].append(("all", group))
    return stack[0]


def words(parts: list, titles: dict[str, str]) -> str:
    said = []
    for part in parts:
        if isinstance(part, tuple):
            kind, inner = part
            items = [words([x], titles) for x in inner]
            said.append(f"something that is {items[0]} some {items[1]}" if kind == "some" and len(items) == 2 else " ".join(items))
        else:
            name = part[1:-1] if part.startswith("<") and part.endswith(">") else part
            said.append(titles.get(name) or name)
    return " ".join(s for s in said if s)


def verbalise(expression: str, titles: dict[str, str]) -> str:
    return words(parse(expression), titles)


def verbalised(ids: DataFrame, titles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id) -> (id, words) for the distinct complex ids; titles: (id, title). Each expression's titles
    are joined to it and travel in its own row, so that nothing is broadcast."""
    complex_ids = ids.select(F.col(id_col).alias("id")).where(is_complex("id")).distinct()
    atoms = complex_ids.select("id", F.explode(F.array_distinct(F.regexp_extract_all("id", F.lit("<([^<>()\\s]+)>"), 1))).alias("atom"))
    named = atoms.join(titles.select(F.col("id").alias("atom"), "title"), "atom").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("atom", "title"))).alias("titles"))
    rows = complex_ids.join(named, "id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "words": [verbalise(i, dict(t) if t is not None else {}) for i, t in zip(f["id"], f["titles"])]})

    return rows.mapInPandas(run, "id string, words string")
