"""New documents as they come: each micro-batch becomes one update of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.semantic import Embedder
from corpusloom.plans.index import Index, update


def ingest(stream: DataFrame, root: str, embedder: Embedder, model: str, checkpoint: str, available_now: bool = True):
    """Start a query that adds or replaces the documents (path, content) of a stream; others stay.

    Of a path that comes twice in a batch one content is taken, the greatest. A batch that runs again finds
    equal hashes and changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("path").agg(F.max("content").alias("content"))
        new = new.select("path", F.octet_length("content").cast("long").alias("size"), F.lit(number).cast("long").alias("mtime_ns"), F.lit(False).alias("unreadable"), F.sha2("content", 256).alias("hash"), F.col("content").isNotNull().alias("readable_text"), "content")
        old = Index.open(spark, root)
        if old is not None:
            rest = old.table("files").join(new.select("path"), "path", "left_anti")
            kept = rest.select("path", "size", "mtime_ns", F.lit(False).alias("unreadable"), "hash", F.lit(True).alias("readable_text"), F.lit(None).cast("string").alias("content"))
            new = new.unionByName(kept)
        update(spark, root, new, embedder, model)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
