"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups are sorted by size, largest first; each enters the bin whose remaining capacity is the
least that still holds it, found in a balanced tree, and opens a new bin where none does. For
a given number of bins the smallest capacity that needs no more of them is found by bisection.

Groups of one size are packed together: a bin that takes one of them stays the tightest that
holds the next, so k equal groups are runs of `room // size`. The driver sees one row for each
different size of a group, never the groups: sizes that differ add up, so there are at most
sqrt(2 * bytes) of them. Which groups of a size make up a run is told by their rank, counted in
RANKS parts. Documents find their shard by their group's hash: no text is ever shuffled, and
groups of many documents are met by broadcast.

Null texts count as empty, in one group with empty ones. Rows with the same doc_id are placed
one by one. Empty tables give no rows. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import few, file_order, join_each, mark, read, slices, written

SHARDS = 8
#: Parts that groups of one size are ranked in.
RANKS = 1024


class _Node:
    __slots__ = ("key", "left", "priority", "right")

    def __init__(self, key, priority):
        self.key, self.priority, self.left, self.right = key, priority, None, None


class Tree:
    """A treap of (remaining capacity, bin): a search tree that random priorities keep balanced."""

    def __init__(self, seed: int = 0):
        self.root, self.random = None, random.Random(seed)

    def _split(self, node, key):
        """Keys under `key` and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        first, node.left = self._split(node.left, key)
        return first, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def add(self, key) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, _Node(key, self.random.random())), high)

    def take(self, least: int):
        """Remove and return the smallest key (capacity, bin) of at least this capacity, or None."""
        low, high = self._split(self.root, (least, -1))
        if high is None:
            self.root = low
            return None
        parent, node = None, high
        while node.left is not None:
            parent, node = node, node.left
        if parent is None:
            high = node.right
        else:
            parent.left = node.right
        self.root = self._join(low, high)
        return node.key


def best_fit(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first, count, bin) of items, given as (size, count) in decreasing order of size, or None where more than `most` bins are needed.

    An item larger than the capacity gets a bin of its own.
    """
    tree, runs, used = Tree(), [], 0
    for size, count in sizes:
        first = 0
        while first < count:
            found = tree.take(size)
            if found is None:
                if used == most:
                    return None
                found, used = (max(capacity, size), used), used + 1
            room, bin_ = found
            fit = min(count - first, room // size)
            runs.append((size, first, fit, bin_))
            tree.add((room - fit * size, bin_))
            first += fit
    return runs


def fit_into(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """best_fit with the smallest capacity, found by bisection, that needs at most `shards` bins."""
    low = max(-(-sum(s * n for s, n in sizes) // shards), 1)
    high = low + max((s for s, _ in sizes), default=0)  # enough: a bin that rejects an item is over the mean
    best = best_fit(sizes, high, shards)
    while low < high:
        middle = (low + high) // 2
        found = best_fit(sizes, middle, shards)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return best if best is not None else best_fit(sizes, high)


def placed_groups(groups: DataFrame, shards: int) -> DataFrame:
    """group, n, shard for groups (group, size, n)."""
    spark = groups.sparkSession
    sizes = sorted(((r["size"], r["count"]) for r in groups.groupBy("size").count().collect()), reverse=True)  # at most sqrt(2 * bytes) rows
    runs = fit_into(sizes, shards)
    count = dict(sizes)
    whole = spark.createDataFrame([(s, b) for s, _, n, b in runs if n == count[s]], "size long, shard int")
    cut = F.broadcast(spark.createDataFrame([(s, a, a + n, b) for s, a, n, b in runs if n < count[s]], "of long, low long, high long, shard int"))  # runs that a bin's end cuts
    named = groups.join(few(written(whole, "sizes")), "size").select("group", "n", "shard")
    some = groups.join(cut.select(F.col("of").alias("size")).distinct(), "size", "left_semi").withColumn("part", F.pmod(F.xxhash64("group"), F.lit(RANKS)))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy("size", "part").count().select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "part").orderBy("group")) - 1 + F.col("before")
    ranked = some.join(starts, ["size", "part"]).select("group", "n", "size", rank.alias("rank"))
    ranked = ranked.join(cut, (F.col("size") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return named.unionByName(ranked.select("group", "n", "shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: equal texts share a shard, shards have nearly equal bytes.

    A group larger than a shard's fair part fills a shard beyond it: groups are indivisible.
    """
    began = mark(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
    )
    rows = written(rows, "sized")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    named = written(placed_groups(groups, shards), "placed")
    found = join_each(rows, named, "group", rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in slices(batches):
            to = batch.column("shard").to_numpy().astype(np.int64)
            at = np.empty(len(to), dtype=np.int64)
            for s in range(shards):
                mine = np.flatnonzero(to == s)
                at[mine] = seen[s] + np.arange(len(mine))
                seen[s] += len(mine)
            one = np.ones(len(to), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(to), pa.array(at), pa.array(one * part), pa.array(one)], names=["doc_id", "size", "text_crc32", "shard", "at", "part", "one"])

    dealt = found.select("doc_id", "size", "text_crc32", "shard").mapInArrow(run, "doc_id long, size long, text_crc32 long, shard long, at long, part long, one long")
    dealt = written(dealt, "dealt", began)
    starts = few(written(file_order("part", ["shard"], dealt, "one", "before"), "slots"))
    return dealt.join(starts, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("at")).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
