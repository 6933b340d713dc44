"""Rank fusion of a lexical and a semantic search: one row per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lexical import Counted, Query, bm25, phrases
from corpusloom.operators.semantic import semantic

#: Offset of reciprocal ranks, share of the lesser signal, weight of the lexical one with and without terms, least depth.
OFFSET, LESSER, WITH_TERMS, BARE, LEAST_DEPTH = 3, 0.01, 1.05, 0.15, 30


def file_ranks(found: DataFrame, name: str) -> DataFrame:
    """path and its rank among files, from rows ranked one by one: a file stands where it first shows."""
    first = found.groupBy("path").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy().orderBy("rank", "path")  # at most the depth of a search
    return first.select("path", F.row_number().over(order).alias(name))


def fuse(lexical_rows: DataFrame, semantic_rows: DataFrame, lexical_weight: float) -> DataFrame:
    """path, lex_rank, vec_rank, rrf_score: the greater of the weighted reciprocal ranks plus a share of the lesser."""
    lex, vec = file_ranks(lexical_rows, "lex_rank"), file_ranks(semantic_rows, "vec_rank")
    both = lex.join(vec, "path", "full_outer")
    a = F.coalesce(F.lit(lexical_weight) / (F.col("lex_rank") + OFFSET), F.lit(0.0))
    b = F.coalesce(F.lit(1.0) / (F.col("vec_rank") + OFFSET), F.lit(0.0))
    return both.select("path", "lex_rank", "vec_rank", (F.greatest(a, b) + LESSER * F.least(a, b)).alias("rrf_score"))


def hybrid(docs: Counted, vectors: DataFrame, query: Query, vector: Sequence[float], *, threshold: float = 0.4) -> DataFrame:
    """path, score, lex_rank, vec_rank, ord (the file's best chunk, null if only words found it).

    Both searches go deeper than the result; only the semantic one has a threshold.
    """
    depth = max(3 * query.topk, LEAST_DEPTH)
    words = bm25(docs, phrases(query), query.scope, depth)
    ranked = words.select("path", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "path")).alias("rank"))
    meaning = semantic(vectors, vector, topk=3 * depth, threshold=query.threshold if query.threshold is not None else threshold, scope=query.scope)
    fused = fuse(ranked, meaning, WITH_TERMS if query.terms else BARE)
    best = fused.orderBy(F.desc("rrf_score"), "path").limit(query.topk)
    chunk = meaning.groupBy("path").agg(F.min_by("ord", "rank").alias("ord"))
    return best.join(F.broadcast(chunk), "path", "left").select("path", F.col("rrf_score").alias("score"), "lex_rank", "vec_rank", "ord")
