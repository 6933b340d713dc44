"""The index of a corpus: versioned Parquet snapshots and a pointer that moves in one step."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.models import DEFAULT, Model, resolve, signature
from corpusloom.operators.chunking import chunk_documents, snippets
from corpusloom.operators.lexical import POSTINGS, document_sizes, postings, totals
from corpusloom.operators.semantic import Embedder, embed
from corpusloom.plans import snapshot

FOLDER, SCHEMA_VERSION, KEEP_SNAPSHOTS = ".loom", 2, 2
#: A lock is held for two small files' time; an older one was left by a writer that died. Writers start again this often.
LOCK_SECONDS, ATTEMPTS = 60, 20
#: Tables of a snapshot with their columns.
TABLES = {
    "files": "path string, hash string, size long, mtime_ns long",
    "chunks": "path string, ord int, byte_start long, byte_end long, line_start int, line_end int, vec array<float>",
    "postings": POSTINGS,
    "sizes": "path string, n int",
}


class SignatureError(ValueError):
    """The index was built for vectors that do not compare with these."""


class _Store:
    """Small files beside the tables, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{FOLDER}"
        self.jvm = spark._jvm
        self.path = lambda p: self.jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        path = self.path(f"{self.folder}/{name}")
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write beside, then rename: readers see the old or the new file."""
        target, draft = self.path(f"{self.folder}/{name}"), self.path(f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.isAbsoluteAndSchemeAuthorityNull() is False else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, target, options)

    def swap(self, name: str, seen: dict | None, meta: dict) -> bool:
        """Write meta if the file still holds what was seen.

        A lock file guards the moment between. HDFS makes a file exclusively in one step; a local
        folder looks first, which leaves two writers of one machine a gap of microseconds.
        """
        lock, until = self.path(f"{self.folder}/.{name}-lock"), time.time() + 3 * LOCK_SECONDS
        while True:
            try:
                self.fs.create(lock, False).close()
                break
            except Py4JJavaError:
                if time.time() > until:
                    raise
                if not self.fs.exists(lock):
                    continue
                if time.time() - self.fs.getFileStatus(lock).getModificationTime() / 1000 > LOCK_SECONDS:
                    self.fs.delete(lock, False)  # its writer is gone
                time.sleep(0.05)
        try:
            found = self.read(name)
            if (json.loads(found) if found else None) != seen:
                return False
            self.write(name, json.dumps(meta))
            return True
        finally:
            self.fs.delete(lock, False)

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self.path(f"{self.folder}/{name}".rstrip("/")), True)

    def size(self, name: str) -> int:
        path = self.path(f"{self.folder}/{name}")
        return self.fs.getContentSummary(path).getLength() if self.fs.exists(path) else 0


@dataclass
class Index:
    """One snapshot, open for reading."""

    spark: SparkSession
    root: str
    meta: dict

    @staticmethod
    def open(spark: SparkSession, root: str) -> Index | None:
        """The current snapshot, or None where there is no index yet."""
        found = _Store(spark, root).read("CURRENT")
        if found is None:
            return None
        meta = json.loads(found)
        if meta["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"the index has version {meta['schema_version']}, this code reads {SCHEMA_VERSION}; clean and rebuild it")
        return Index(spark, root, meta)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root.rstrip('/')}/{FOLDER}/{self.meta['snapshot']}/{name}")

    def vectors(self) -> DataFrame:
        return self.table("chunks").select("path", "ord", "vec")

    def totals(self) -> DataFrame:
        """One row, docs and total, as counted when the index was written."""
        return self.spark.range(1).select(F.lit(self.meta["docs"]).cast("long").alias("docs"), F.lit(self.meta["total"]).cast("long").alias("total"))

    def chunks_of(self, path: str) -> DataFrame:
        return self.table("chunks").filter(F.col("path") == path).orderBy("ord")

    def stats(self) -> dict:
        row = snapshot.stats(self.table("files"), self.table("chunks")).first().asDict()
        return row | {"db_bytes": _Store(self.spark, self.root).size(self.meta["snapshot"])}

    def status(self) -> dict:
        found = self.stats()
        model = {"name": self.meta["model_repo"], "alias": self.meta["model_alias"], "dimensions": self.meta["dims"]}
        return {"path": self.root, "index_exists": True, "total_files": found["files"], "total_chunks": found["chunks"], "embedded_chunks": found["embedded_chunks"], "total_size_bytes": found["source_bytes"], "index_size_bytes": found["db_bytes"], "model": model}

    def check(self, model: Model) -> None:
        if self.meta["signature"] != signature(model):
            raise SignatureError(f"the index was built with {self.meta['model_alias']}; update it before searching with {model.alias}")


def clean(spark: SparkSession, root: str) -> bool:
    """Remove the index and nothing else."""
    return _Store(spark, root).delete()


def update(spark: SparkSession, root: str, walked: DataFrame, embedder: Embedder, model: str | None = None) -> dict:
    """Bring the index in line with a walk (path, size, mtime_ns, unreadable, hash, readable_text, content).

    Only new and changed documents are cut and embedded. Everything is written as a new snapshot
    and becomes current by one rename; an index of another signature is rebuilt. Where two writers
    meet, the later one starts again from what the earlier one wrote.
    """
    began, store = time.time(), _Store(spark, root)
    for _ in range(ATTEMPTS):
        counts = _attempt(spark, root, store, walked, embedder, model)
        if counts is not None:
            return counts | {"seconds": round(time.time() - began, 3)}
    raise RuntimeError(f"{root}: other writers were faster {ATTEMPTS} times")


def _attempt(spark: SparkSession, root: str, store: _Store, walked: DataFrame, embedder: Embedder, model: str | None) -> dict | None:
    """One update from the snapshot that is current now; None where another writer moved the pointer meanwhile."""
    past = old = Index.open(spark, root)
    spec = resolve(model or (old.meta["model_repo"] if old else DEFAULT))
    if old is not None and old.meta["signature"] != signature(spec):
        old = None
    indexed = old.table("files") if old else spark.createDataFrame([], TABLES["files"])
    name = f"snapshot-{uuid.uuid4().hex}"
    base = f"{store.folder}/{name}"
    # the decisions are written first: what follows reads one version of them
    snapshot.classify(walked, indexed).write.parquet(f"{base}/decisions")
    decided = spark.read.parquet(f"{base}/decisions")
    changed = walked.join(decided.filter(F.col("status").isin("added", "updated")).select("path"), "path", "left_semi").select("path", "content", "hash", "size", "mtime_ns")
    gone = decided.filter(F.col("status").isin("updated", "removed"))
    cut = snippets(chunk_documents(changed), changed)
    vectors = embed(cut.withColumn("text", F.concat(F.lit(spec.document_prefix), "snippet")), embedder).drop("text", "snippet")
    new = {
        "files": changed.select("path", "hash", "size", "mtime_ns"),
        "chunks": vectors,
        "postings": postings(changed),
        "sizes": document_sizes(changed),
    }
    refreshed = walked.join(decided.filter("stat_changed and status = 'unchanged'").select("path"), "path", "left_semi").select("path", "hash", "size", "mtime_ns")
    for table, rows in new.items():
        out = gone
        if table == "files":
            rows, out = rows.unionByName(refreshed), gone.select("path").unionByName(refreshed.select("path"))
        whole = snapshot.replaced(old.table(table), out, rows) if old else rows
        if table == "postings":
            whole = whole.repartitionByRange("token").sortWithinPartitions("token", "path")
        whole.write.parquet(f"{base}/{table}")
    counts = snapshot.report(decided).first().asDict()
    counts["chunks_embedded"] = spark.read.parquet(f"{base}/chunks").join(decided.filter(F.col("status").isin("added", "updated")).select("path"), "path", "left_semi").count()
    whole = totals(spark.read.parquet(f"{base}/sizes")).first().asDict()
    kept = [past.meta["snapshot"], *past.meta["before"]] if past else []
    meta = whole | {"schema_version": SCHEMA_VERSION, "snapshot": name, "before": kept[: KEEP_SNAPSHOTS - 1], "model_alias": spec.alias, "model_repo": spec.repo, "dims": embedder.dims, "signature": signature(spec)}
    if not store.swap("CURRENT", past and past.meta, meta):
        store.delete(name)
        return None
    for gone_by in kept[KEEP_SNAPSHOTS - 1 :]:
        store.delete(gone_by)
    return counts


def add_file(spark: SparkSession, root: str, walked: DataFrame, path: str, embedder: Embedder) -> dict:
    """Index or re-index one file of the walk; the rest stays. A file that the walk leaves out is refused."""
    old = Index.open(spark, root)
    if walked.filter(F.col("path") == path).isEmpty():
        raise ValueError(f"{path} is not in the corpus: ignored, hidden, binary or missing")
    if old is None:
        return update(spark, root, walked.filter(F.col("path") == path), embedder)
    others = old.table("files").filter(F.col("path") != path)
    as_indexed = others.select("path", "size", "mtime_ns", F.lit(False).alias("unreadable"), "hash", F.lit(True).alias("readable_text"), F.lit(None).cast("string").alias("content"))
    one = walked.filter(F.col("path") == path).select(as_indexed.columns)
    return update(spark, root, as_indexed.unionByName(one), embedder, old.meta["model_repo"])
