"""Exact similarity search over chunk vectors, and the embedder interface."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.batches import runs
from corpusloom.functions.paths import in_scope


class Embedder(Protocol):
    """What turns texts into unit vectors. It is pickled to the workers and must load its model there."""

    dims: int
    threshold: float

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Feature hashing of words into `dims` signed counts: needs no model; for tests and offline use."""

    def __init__(self, dims: int = 64, threshold: float = 0.1):
        self.dims, self.threshold = dims, threshold

    def _vector(self, text: str) -> list[float]:
        out = [0.0] * self.dims
        for word in text.lower().split():
            code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[code % self.dims] += 1.0 if code >> 63 else -1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm for x in out] if norm else out

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._vector(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._vector(text)


def embed(chunks: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """chunks with a column vec, a bounded run of texts at a time; null texts get null vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, text):
            texts = batch.column(text).to_pylist()
            found = iter(embedder.embed_documents([t for t in texts if t is not None]))
            vectors = [None if t is None else next(found) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, "vec"])

    plain = chunks.drop("vec")
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("vec", T.ArrayType(T.FloatType()))]))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vec: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    norm = F.sqrt(dot(vec, vec))
    return F.when(norm > 0, F.transform(vec, lambda x: (x / norm).cast("float"))).otherwise(vec)


def semantic(vectors: DataFrame, query: Sequence[float], *, topk: int = 10, threshold: float = 0.4, scope: str | None = None) -> DataFrame:
    """path, ord, score, rank: the chunks with the highest dot product; a file may show more than once.

    The threshold comes before the limit and includes its value. Null vectors are out.
    """
    unit = F.lit([float(x) for x in query]).cast("array<double>")
    scored = vectors.filter(F.col("vec").isNotNull() & in_scope(F.col("path"), scope)).select("path", "ord", dot(F.col("vec"), unit).alias("score"))
    best = scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "path", "ord").limit(topk)
    from pyspark.sql import Window

    order = Window.partitionBy().orderBy(F.desc("score"), "path", "ord")  # at most topk rows
    return best.select("path", "ord", "score", F.row_number().over(order).alias("rank"))
