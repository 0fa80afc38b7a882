"""Vectors for texts: an injected batch encoder in Arrow batches, and hashed token counts that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Texts that an encoder gets at once.
BATCH = 64
DIM = 64


def encode(rows: DataFrame, text: str, encoder: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int = BATCH, name: str = "vector") -> DataFrame:
    """Adds a vector per row: ``encoder`` maps a list of texts to as many vectors, and is sent to the workers.
    A null text is empty."""
    schema = rows.withColumn(name, F.lit(None).cast("array<double>")).schema
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, batch):
                part = b.slice(low, batch)
                made = encoder([x or "" for x in part.column(at).to_pylist()])
                vectors = pa.array([[float(v) for v in x] for x in made], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=schema.names)

    return rows.mapInArrow(run, schema)


def hashed_counts(text: Column | str, dim: int = DIM) -> Column:
    """Token counts by hash of the token: equal texts have equal vectors, on any machine."""
    places = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, 0 where one is zero or missing."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(product(a, b), F.sqrt(product(a, a)) * F.sqrt(product(b, b))), F.lit(0.0))
