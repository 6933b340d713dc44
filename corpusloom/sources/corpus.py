"""A corpus: one row per document with path and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a tree of files: <source>/<language>/<id>.md."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages")
    return found.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, ord, vec: one vector for each document that has an embedding of the same id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.join(vectors, "doc_id").select(path.alias("path"), F.lit(0).alias("ord"), "vec")
