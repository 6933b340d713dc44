"""Comparing a walked corpus with an index: what is new, changed, gone or as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(walked: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, status (added, updated, removed, unchanged, skipped) and stat_changed, from one full outer join.

    walked: path, size, mtime_ns, unreadable, hash, readable_text (null hash: not read because
    the stat is known). indexed: path, hash, size, mtime_ns. Equal size and time settle a file
    without its hash; an equal hash under another stat counts as unchanged, with its stat to refresh.
    """
    w, i = walked.alias("w"), indexed.alias("i")
    joined = w.join(i, F.col("w.path") == F.col("i.path"), "full_outer")
    same_stat = (F.col("w.size") == F.col("i.size")) & (F.col("w.mtime_ns") == F.col("i.mtime_ns"))
    same_hash = F.col("w.hash") == F.col("i.hash")
    status = (
        F.when(F.col("w.path").isNull(), "removed")
        .when(same_stat, "unchanged")
        .when(F.col("w.unreadable"), "skipped")
        .when(same_hash, "unchanged")
        .when(~F.col("w.readable_text"), "skipped")
        .when(F.col("i.path").isNull(), "added")
        .otherwise("updated")
    )
    return joined.select(
        F.coalesce("w.path", "i.path").alias("path"),
        status.alias("status"),
        (F.coalesce(same_hash, F.lit(False)) & ~F.coalesce(same_stat, F.lit(False))).alias("stat_changed"),
    )


def report(classified: DataFrame) -> DataFrame:
    """One row: added, updated, removed, unchanged, skipped."""
    return classified.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "removed", "unchanged", "skipped")))


def summary(added: int, updated: int, removed: int, unchanged: int, skipped: int, chunks: int) -> str:
    tail = f", {skipped} skipped" if skipped else ""
    return f"indexed: {added} added, {updated} updated, {removed} removed, {unchanged} unchanged, {chunks} chunks embedded{tail}"


def stale_count(walked: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row, stale: new, changed (by stat) and gone files."""
    w, i = walked.alias("w"), indexed.alias("i")
    joined = w.join(i, F.col("w.path") == F.col("i.path"), "full_outer")
    same = (F.col("w.size") == F.col("i.size")) & (F.col("w.mtime_ns") == F.col("i.mtime_ns"))
    return joined.agg(F.count_if(~F.coalesce(same, F.lit(False))).alias("stale"))


def removed(walked: DataFrame, indexed: DataFrame) -> DataFrame:
    """path of indexed files that the walk no longer sees; unreadable files are seen."""
    return indexed.select("path").join(walked.select("path"), "path", "left_anti")


def replaced(table: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """A table of the index with the rows of some paths taken out and new ones put in."""
    return table.join(gone.select("path"), "path", "left_anti").unionByName(new)


def stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, source_bytes, chunks, embedded_chunks."""
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_bytes"))
    b = chunks.agg(F.count("*").alias("chunks"), F.count("vec").alias("embedded_chunks"))
    return a.crossJoin(b)  # one row each
