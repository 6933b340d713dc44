"""Five corpus stages in a row: each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, linededup, nearcopies, packing, toxicity
from corpusloom.llm.common import mark, read, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, from a model fitted on the labelled ones."""
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine, "_toxicity").filter("_toxicity < 0.5").drop("_toxicity")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; proved near copies of one that stays are left to the next stage."""
    return linededup.cleaned(docs, spare=True)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest doc_id."""
    return nearcopies.first_of_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hold less than a twentieth, in their text as it is and in the one that they came with."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"), origin=read(spark, sf_dir, "documents"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, dealt to full training windows."""
    return packing.pack(docs, packing.vocabulary_path("byte_bpe_50k.json"), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Packing by a tokenizer and the fitted model have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = read(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", began)
    return STAGES[-1][1](spark, docs, sf_dir)
