"""What the corpus operators share: the shared folder, written tables and running totals."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the contracts, as a Java and RE2 class body.
SPACE = r"\x20\x09-\x0D"
#: Rows that become Python objects at a time, and bytes of a batch of a table that is written here.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Rows of a few longs that are broadcast at most; more are met in a shuffled join.
BROADCAST_ROWS = 1_000_000


#: ASCII upper case becomes lower case, other ASCII characters but digits and letters become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def give_back() -> None:
    """Return what was freed to the system: workers are used again, and the allocators would keep the most that any task needed."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
        trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in runs of rows that fit in a Python worker as objects; memory goes back before the first one and after the last."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)
        del batch
    give_back()


def local_rows(spark: SparkSession, **columns: tuple[str, list]) -> DataFrame:
    """A small table of the driver's columns, each (Arrow type, values). From a list of rows, Spark would start a second Python daemon with workers in every executor."""
    return spark.createDataFrame(pa.table({k: pa.array(values, kind) for k, (kind, values) in columns.items()}))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where they are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the Arrow batches of what runs meanwhile; the session's own settings come back."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    own = {k: spark.conf.get(k) for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


#: Paths of written tables by application.
_WRITTEN: dict[str, list[str]] = {}


def _paths(spark: SparkSession) -> list[str]:
    return _WRITTEN.setdefault(spark.sparkContext.applicationId, [])


def mark(spark: SparkSession) -> int:
    """How many tables written() has left: with this number, a later one can replace what led to it."""
    return len(_paths(spark))


def written(df: DataFrame, name: str, since: int | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends, sizes are known to the planner.

    Tables written since a mark are deleted once this one is there. What is left goes with the
    session (drop_written, which also runs when Python ends).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    if since is not None:
        drop_written(spark, since)
    _paths(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written since a mark; DataFrames that read them are of no use then."""
    jvm, conf, paths = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _paths(spark)
    for path in paths[since:]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    del paths[since:]


@atexit.register
def _leave() -> None:
    spark = SparkSession.getActiveSession() if _WRITTEN else None
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_written(spark)


def file_order(part: str, keys: list[str], df: DataFrame, size: str, start: str) -> DataFrame:
    """For each (part, *keys) the sum of `size` over smaller parts with the same keys, as `start`.

    The window sorts one row for each part and key, never the rows themselves.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(part, *keys).agg(F.sum(size).alias("_size"))
    return sums.select(part, *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("long").alias(start))


def few(table: DataFrame) -> DataFrame:
    """A written table of a few longs a row, marked for broadcast if its rows are few enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def join_each(rows: DataFrame, names: DataFrame, key: str, total: int, parts: int = 10_000) -> DataFrame:
    """rows joined with names, which has one row for each key and in `n` the number of rows with it.

    The at most `parts` keys that hold at least one of so many parts of all rows are broadcast,
    so that no key gathers its rows in one task.
    """
    large = F.col("n") * parts >= total
    hot = F.broadcast(names.filter(large).drop("n"))
    others = rows.join(hot.select(key), key, "left_anti").join(names.filter(~large).drop("n"), key)
    return rows.join(hot, key).unionByName(others)
