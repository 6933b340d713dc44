"""SimHash near-duplicates: exact comparison of fingerprints in tiles.

Fingerprints with equal population counts share a class; a class is cut into tiles of bounded
size by hash, and only the distinct fingerprints take part. Two fingerprints at most `radius`
bits apart have population counts at most `radius` apart, so tile pairs further apart are
skipped whole; within a pair of tiles the same holds for the counts of the lower halves, which
leaves a few runs of rows to compare by exclusive-or and bit count in numpy. A task reports a
spanning forest of the links it found, never all pairs of a group; components() joins them.

Every text has a fingerprint: null and empty texts get zero, which is linked like any other.
Rows with the same doc_id are one document in its component. A null doc_id is a row of its own
that takes the smallest doc_id of its component, or none. Empty tables give no rows. Columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import join_each, mark, read, slices, written
from corpusloom.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one tile, on average at most; a pair of tiles is one piece of work.
TILE = 32_768
#: Fingerprints that are compared at a time.
COMPARED = 1 << 19
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles of words, repeats included; a shorter text is one shingle, none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that most of the hashes have set; zero without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's shingles of words, repeats included; zero without words."""
    return int(majority(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's tree, for nodes 0 to n and edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """A spanning forest of the links between fingerprints x and y (or within x), as rows (a, b)."""
    both = x if same else np.concatenate([x, y])
    label = np.arange(len(both))
    half = np.uint64(0xFFFFFFFF)
    x_low, y_low = np.bitwise_count(x & half).astype(np.int64), np.bitwise_count(y & half).astype(np.int64)
    x_high, y_high = np.bitwise_count(x >> np.uint64(32)).astype(np.int64), np.bitwise_count(y >> np.uint64(32)).astype(np.int64)
    x_at = {k: np.flatnonzero(x_low * 33 + x_high == k) for k in np.unique(x_low * 33 + x_high)}
    y_at = {k: np.flatnonzero(y_low * 33 + y_high == k) for k in np.unique(y_low * 33 + y_high)}
    for k, rows in x_at.items():
        near = [m for m in y_at if abs(k // 33 - m // 33) + abs(k % 33 - m % 33) <= radius and (not same or m >= k)]
        if not near:
            continue
        cols = np.concatenate([y_at[m] for m in near])
        right = y[cols]
        step = max(1, COMPARED // len(cols))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ right[None, :]) <= radius)
            if len(i):
                label = forest(np.concatenate([label, part[i]]), np.concatenate([np.arange(len(both)), cols[j] + (0 if same else len(x))]), len(both))
    linked = np.flatnonzero(label != np.arange(len(both)))
    return np.stack([both[label[linked]], both[linked]], axis=1).view(np.int64)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links whose trees are the components of the distinct fingerprints fp at most radius bits apart."""
    spark = distinct.sparkSession
    ones = F.bit_count("fp").cast("int")
    sizes = {r["ones"]: r["n"] for r in distinct.groupBy(ones.alias("ones")).count().withColumnRenamed("count", "n").collect()}  # at most 65 rows
    cuts = {k: max(1, -(-n // tile)) for k, n in sizes.items()}
    if not sizes:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    pick = F.create_map(*[F.lit(v) for k in sorted(cuts) for v in (k, cuts[k])])
    tiles = distinct.select("fp", ones.alias("ones"))
    tiles = tiles.select("fp", "ones", F.pmod(F.xxhash64("fp"), pick[F.col("ones")].cast("long")).cast("int").alias("cut"))
    tiles = tiles.groupBy("ones", "cut").agg(F.collect_list("fp").alias("fps"))
    tiles = written(tiles, "tiles")
    # the partners of a tile: itself and what comes after it, up to radius classes on
    steps = F.sequence(F.col("ones"), F.least(F.col("ones") + radius, F.lit(64)))
    partners = tiles.select("ones", "cut", "fps", F.explode(F.filter(steps, lambda k: pick[k].isNotNull())).alias("ones_"))
    first = F.when(F.col("ones") == F.col("ones_"), F.col("cut")).otherwise(F.lit(0))
    partners = partners.select("ones", "cut", "fps", "ones_", F.explode(F.sequence(first, pick[F.col("ones_")] - 1)).alias("cut_"))
    pairs = partners.join(tiles.select(F.col("ones").alias("ones_"), F.col("cut").alias("cut_"), F.col("fps").alias("fps_")), ["ones_", "cut_"])
    n = sum(cuts[k] * (cuts[k] + 1) // 2 + cuts[k] * sum(cuts.get(k + d, 0) for d in range(1, radius + 1)) for k in cuts)
    pairs = pairs.withColumn("same", (F.col("ones") == F.col("ones_")) & (F.col("cut") == F.col("cut_")))
    pairs = pairs.select("fps", "fps_", "same").repartition(min(max(n, 1), 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i in range(batch.num_rows):
                x, y = (np.asarray(batch.column(c)[i].values).astype(np.int64).view(np.uint64) for c in ("fps", "fps_"))
                found = close_pairs(x, y, radius, batch.column("same")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp (signed long), component_id (smallest doc_id reachable) for every row of docs."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    began = mark(docs.sparkSession)
    found = written(links(distinct.select("fp"), radius, tile), "links", began)
    roots = components(found)
    # only fingerprints that are linked need the minimum of their tree
    trees = distinct.select("fp", "first").join(roots.withColumnRenamed("node", "fp"), "fp")
    least = trees.groupBy("root").agg(F.min("first").alias("least"))
    moved = trees.join(least, "root").select("fp", "least")
    named = distinct.join(moved, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    return join_each(rows, written(named, "named", began), "fp", rows.count()).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest, and rows without a doc_id.

    A doc_id on several rows stays on all of them if one of them stays.
    """
    began = mark(docs.sparkSession)
    found = near_duplicates(docs, shingle, radius)
    state = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = written(state.filter(~F.col("stays")).select(F.col("doc_id").alias("_gone")), "copies", began)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
