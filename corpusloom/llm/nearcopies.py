"""Near copies for the pipeline: texts whose sets of five-word shingles are similar.

A text's node is its set of shingles; equal sets are one node. Sets with a similarity of at
least SIMILAR have sizes at most 1/SIMILAR apart, so nodes are dealt to tiles by size and only
tiles of the same or the next class meet. Within a pair of tiles wide SimHash fingerprints of
the sets propose pairs, and the exact Jaccard similarity of the sets confirms each one.

A large group of near copies must not yield all its pairs: the first pass proposes only enough
pairs to link each group, the second one those that the confirmed ones have not linked. Where
these are many for the sets they join, the sets are dealt out in pairs of blocks, and a task
compares two blocks by a product of matrices; it reports a spanning forest of the links found.
The fingerprints may miss a pair, by the bounds below about one in 10,000 at similarity 0.8.

Null and empty texts have the empty set, which is a node like any other. Rows with the same
doc_id, null doc_ids, empty tables and extra columns are treated as in simhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import few, join_each, mark, slices, written
from corpusloom.llm.components import components
from corpusloom.llm.simhash import SEED, TILE, forest, majority, shingle_hashes

SHINGLE, SIMILAR = 5, 0.8
#: Words of 64 bits in a fingerprint, and how many bits may differ in the first word and in all. Sets with similarity 0.8
#: differ in 0.15 of the bits on average (very small ones in 0.19), unrelated ones in half: both are several deviations away.
WORDS, FIRST_BITS, ALL_BITS = 3, 24, 58
#: Sets in a block and the hashes they hold together, at most (one set may hold more); columns of a product.
BLOCK, BLOCK_HASHES, COLUMNS = 512, 1 << 20, 4096
#: Fingerprints that are compared at a time.
COMPARED = 1 << 18
#: Pairs for each set from which on blocks are compared whole.
DENSE = 1


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes(text, SHINGLE))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The similarity of two sorted sets; that of two empty ones is one."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def sketch(own: np.ndarray) -> list[np.uint64]:
    """WORDS fingerprints of a set, each by another mixture of its hashes' bits."""
    out = []
    for k in range(WORDS):
        mixed = own + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        if k:
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
        out.append(majority(mixed))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, node, n (the size of the text's set) and the words of its fingerprint for every row."""
    words = [f"w{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            node, n, prints = np.zeros(batch.num_rows, dtype=np.uint64), [], np.zeros((WORDS, batch.num_rows), dtype=np.uint64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = shingle_set(text)
                node[i] = xxh64_intdigest(own.tobytes(), SEED)
                n.append(len(own))
                prints[:, i] = sketch(own)
            columns = [pa.array(node.view(np.int64)), pa.array(n, pa.int64()), *(pa.array(p.view(np.int64)) for p in prints)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), *columns], names=["doc_id", "text_id", "node", "n", *words])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text_id long, node long, n long, " + ", ".join(f"{w} long" for w in words))


def like_sets(x: np.ndarray, y: np.ndarray, same: bool, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y (or within x) that may be near copies and have different roots; columns are n, root and words.

    With whole every such pair, else some that link whatever all of them link.
    """
    order_x, order_y = np.argsort(x[:, 0], kind="stable"), np.argsort(y[:, 0], kind="stable")
    x, y = x[order_x], y[order_y]
    n_x, n_y = x[:, 0].astype(np.float64), y[:, 0].astype(np.float64)
    roots, label = np.unique(np.concatenate([x[:, 1], y[:, 1]]), return_inverse=True)
    rng, at = np.random.default_rng(SEED), 0
    while at < len(x):
        low = int(np.searchsorted(n_y, SIMILAR * n_x[at] - 1e-6))
        part = x[at : at + max(1, COMPARED // max(1, len(y) - low))]
        right = y[low : int(np.searchsorted(n_y, n_x[at + len(part) - 1] / SIMILAR + 1e-6, side="right"))]
        i, j = np.nonzero(np.bitwise_count(part[:, 2][:, None] ^ right[:, 2][None, :]) <= FIRST_BITS)
        bits = np.zeros(len(i), dtype=np.uint16)
        for k in range(WORDS):
            bits += np.bitwise_count(part[i, 2 + k] ^ right[j, 2 + k])
        m, n = n_x[i + at], n_y[j + low]
        near = (bits <= ALL_BITS) & (np.minimum(m, n) >= SIMILAR * np.maximum(m, n) - 1e-6)
        i, j = i[near] + at, j[near] + low
        if same:
            i, j = i[i < j], j[i < j]
        while len(i):
            a, b = label[i], label[j + len(x)]
            i, j, a, b = (v[a != b] for v in (i, j, a, b))
            if whole or not len(i):
                break
            # a partner for each j, not always the same one
            mixed = rng.permutation(len(i))
            some = mixed[np.unique(j[mixed], return_index=True)[1]]
            yield order_x[i[some]], order_y[j[some]]
            label = forest(a[some], b[some], len(roots))[label]
        if whole and len(i):
            yield order_x[i], order_y[j]
        at += len(part)


def _blocks(n: np.ndarray) -> np.ndarray:
    """The block of each row, by size of its set, so that blocks hold at most BLOCK rows and BLOCK_HASHES hashes (or one row)."""
    out, number, size, count = np.zeros(len(n), dtype=np.int64), 0, 0, 0
    for i in np.argsort(n, kind="stable").tolist():
        more = int(n[i])
        count, size = count + 1, size + more
        if count > 1 and (count > BLOCK or size > BLOCK_HASHES):
            number, count, size = number + 1, 1, more
        out[i] = number
    return out


class Cells:
    """Pairs of rows by the blocks that they are in: told one by one, or as two sets of rows where there are many.

    A cell keeps at most DENSE pairs for each of its rows, and then only which rows they join.
    """

    def __init__(self, n_x: np.ndarray, n_y: np.ndarray):
        self.x, self.y = _blocks(n_x), _blocks(n_y)
        self.columns = int(self.y.max(initial=0)) + 1
        self.sizes = [np.bincount(b, minlength=1) for b in (self.x, self.y)]
        self.pairs: dict[int, list[np.ndarray]] = {}
        self.dense: dict[int, tuple[set[int], set[int]]] = {}

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        cell = self.x[i] * self.columns + self.y[j]
        order = np.argsort(cell, kind="stable")
        i, j, cell = i[order], j[order], cell[order]
        stops = [*np.flatnonzero(np.diff(cell)) + 1, len(cell)] if len(cell) else []
        at = 0
        for stop in stops:
            k, rows, columns = int(cell[at]), i[at:stop], j[at:stop]
            at = stop
            if k in self.dense:
                self._mark(k, rows, columns)
                continue
            held = self.pairs.setdefault(k, [])
            held.append(np.stack([rows, columns]))
            if sum(p.shape[1] for p in held) > DENSE * (self.sizes[0][k // self.columns] + self.sizes[1][k % self.columns]):
                for p in self.pairs.pop(k):
                    self._mark(k, p[0], p[1])

    def _mark(self, k: int, rows: np.ndarray, columns: np.ndarray) -> None:
        left, right = self.dense.setdefault(k, (set(), set()))
        left.update(np.unique(rows).tolist())
        right.update(np.unique(columns).tolist())


def proposed(nodes: DataFrame, whole: bool, tile: int = TILE) -> DataFrame:
    """Nodes (node, n, root, words) with different roots that may be near copies.

    a, b, block: pairs a, b (block is null), or with `whole` also blocks' members: a is in the
    first of a pair of blocks, b in the second one, the other is null.
    """
    spark = nodes.sparkSession
    kept = ["node", "n", "root", *(f"w{k}" for k in range(WORDS))]
    # the empty set is one node; it resembles no other
    classed = nodes.filter("n > 0").select(*kept, F.floor(F.log("n") / -np.log(SIMILAR)).cast("int").alias("class"))
    cuts = {r["class"]: max(1, -(-r["count"] // tile)) for r in classed.groupBy("class").count().collect()}  # sizes grow by a quarter from class to class
    if not cuts:
        return spark.createDataFrame([], "a long, b long, block long")
    pick = F.create_map(*[F.lit(v) for k in sorted(cuts) for v in (k, cuts[k])])
    tiles = classed.withColumn("cut", F.pmod(F.xxhash64("node"), pick[F.col("class")].cast("long")).cast("int"))
    tiles = written(tiles.groupBy("class", "cut").agg(F.collect_list(F.struct(*kept)).alias("rows")), "set_tiles")
    steps = F.filter(F.array("class", F.col("class") + 1), lambda k: pick[k].isNotNull())
    partners = tiles.select("class", "cut", "rows", F.explode(steps).alias("class_"))
    first = F.when(F.col("class") == F.col("class_"), F.col("cut")).otherwise(F.lit(0))
    partners = partners.select("class", "cut", "rows", "class_", F.explode(F.sequence(first, pick[F.col("class_")] - 1)).alias("cut_"))
    pairs = partners.join(tiles.select(F.col("class").alias("class_"), F.col("cut").alias("cut_"), F.col("rows").alias("rows_")), ["class_", "cut_"])
    pairs = pairs.select("rows", "rows_", ((F.col("class") == F.col("class_")) & (F.col("cut") == F.col("cut_"))).alias("same"))
    n = sum(c * (c + 1) // 2 + c * cuts.get(k + 1, 0) for k, c in cuts.items())
    pairs = pairs.repartition(min(n, 20_000))

    def told(a: np.ndarray, b: np.ndarray, block=None) -> pa.RecordBatch:
        if block is None:
            columns = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())]
        else:
            none = lambda x: pa.nulls(len(x), pa.int64())
            columns = [pa.concat_arrays([pa.array(a.view(np.int64)), none(b)]), pa.concat_arrays([none(a), pa.array(b.view(np.int64))]), pa.array([block] * (len(a) + len(b)), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            for row in range(batch.num_rows):
                sides = []
                for c in ("rows", "rows_"):
                    fields = batch.column(c)[row].values.flatten()
                    sides.append(np.stack([f.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for f in fields], axis=1))
                x, y = sides
                found = like_sets(x[:, 1:], y[:, 1:], batch.column("same")[row].as_py(), whole)
                if not whole:
                    for i, j in found:
                        yield told(x[i, 0], y[j, 0])
                    continue
                cells = Cells(x[:, 1], y[:, 1])
                for i, j in found:
                    cells.add(i, j)
                for held in cells.pairs.values():
                    i, j = np.concatenate(held, axis=1)
                    yield told(x[i, 0], y[j, 0])
                for left, right in cells.dense.values():
                    a, b = x[sorted(left), 0], y[sorted(right), 0]
                    number = xxh64_intdigest(a.tobytes() + b"|" + b.tobytes(), SEED)
                    yield told(a, b, int(np.uint64(number).view(np.int64)))

    return pairs.mapInArrow(run, "a long, b long, block long")


def likeness(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """The similarity of each of some sorted sets to each of others."""
    n, m = (np.array([len(x) for x in sets], dtype=np.float64) for sets in (own, other))
    shared = np.intersect1d(np.concatenate(own), np.concatenate(other))
    both = np.zeros((len(own), len(other)))
    if len(shared):
        at = [[np.searchsorted(shared, x[np.isin(x, shared, assume_unique=True)]) for x in sets] for sets in (own, other)]
        for start in range(0, len(shared), COLUMNS):
            sides = []
            for places in at:
                held = np.zeros((len(places), COLUMNS), dtype=np.float32)
                for row, p in enumerate(places):
                    held[row, p[np.searchsorted(p, start) : np.searchsorted(p, start + COLUMNS)] - start] = 1
                sides.append(held)
            both += sides[0] @ sides[1].T
    return both / np.maximum(n[:, None] + m[None, :] - both, 1)


def confirmed(found: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links whose trees hold all pairs of nodes that proposed() found and whose sets have a similarity of at least SIMILAR."""
    # distinct on either side first: a node's many pairs are combined where they are read
    met = found.select(F.col("a").alias("node")).distinct().union(found.select("b").distinct()).filter("node is not null").distinct()
    met = written(nodes.select("node", "text_id").join(met, "node", "left_semi"), "met_sets")
    texts = docs.select(F.xxhash64("text").alias("text_id"), "text").join(few(met), "text_id")
    texts = texts.groupBy("node").agg(F.any_value("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], names=["node", "own"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            good = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILAR for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def alike_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right = None, {}, {}

        def end() -> Iterator[pa.RecordBatch]:
            if left and right:
                i, j = np.nonzero(likeness(list(left.values()), list(right.values())) >= SIMILAR)
                ids = np.array([*left, *right], dtype=np.int64)
                nodes_, flat = np.unique(ids, return_inverse=True)
                label = forest(flat[i], flat[j + len(left)], len(nodes_))
                linked = np.flatnonzero(label != np.arange(len(nodes_)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes_[label[linked]]), pa.array(nodes_[linked])], names=["a", "b"])

        for batch in slices(batches):
            for block, node, first, own in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "first", "own")), strict=True):
                if block != now:
                    yield from end()
                    now, left, right = block, {}, {}
                (left if first else right)[node] = np.frombuffer(own, np.uint64)
        yield from end()

    owned = written(texts.mapInArrow(sets, "node long, own binary"), "sets")
    joined = found.filter("block is null").join(owned.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(owned.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    members = found.filter("block is not null").select("block", F.coalesce("a", "b").alias("node"), F.col("a").isNotNull().alias("first"))
    members = members.join(owned, "node").repartition("block").sortWithinPartitions("block")
    pairs = joined.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")
    return pairs.unionByName(members.select("block", "node", "first", "own").mapInArrow(alike_blocks, "a long, b long"))


def near_copies(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, component_id (smallest doc_id that links of near copies reach) for every row of docs."""
    rows = written(sketches(docs), "sketches")
    values = ["n", *(f"w{k}" for k in range(WORDS))]
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("text_id").alias("text_id"), F.count("*").alias("rows"), *(F.first(v).alias(v) for v in values))
    nodes = written(nodes, "nodes")
    began = mark(docs.sparkSession)
    found = written(proposed(nodes.withColumn("root", F.col("node")), False, tile), "proposed", began)
    found = written(confirmed(found, nodes, docs), "near_copies", began)
    after = mark(docs.sparkSession)
    left = nodes.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = written(proposed(left, True, tile), "proposed", after)
    found = written(found.unionByName(confirmed(more, nodes, docs)), "near_copies", began)
    trees = nodes.select("node", "first").join(components(found), "node")
    moved = trees.join(trees.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", "least")
    named = nodes.join(moved, "node", "left").select("node", F.col("rows").alias("n"), F.coalesce("least", "first").alias("component_id"))
    named = written(named, "named", began)
    return join_each(rows.select("doc_id", "node"), named, "node", rows.count()).select("doc_id", "component_id")


def first_of_near_copies(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest, and rows without a doc_id; as simhash.first_of_each."""
    began = mark(docs.sparkSession)
    found = near_copies(docs, tile)
    state = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = written(state.filter(~F.col("stays")).select(F.col("doc_id").alias("_gone")), "copies", began)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
