"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of `window` words (an item of fewer words is one window). A
window is a set of words that a match must hold whole, so one word of it is a sufficient prefix;
words are ordered by the number of documents that hold them, over all documents, and the rarest
is taken. A document joins only on those prefix words. Where it holds one, the word's offset in
the window gives the only place the window can start; places that leave too few words on
either side are dropped, and the others are verified word by word (by the whole window).

Items come in blocks of bounded size (BLOCK_BYTES of words), each broadcast to one pass over the
documents, so neither side is shuffled; with several blocks the words' frequencies come from one
pass before them all, each block's hits are written and its broadcast destroyed before the next
one is made, and the hit words are merged by document. An item that is longer than a block goes
on in the next one, from the last words that a window can share.

Null texts have no words. Items without words match nothing. Rows with the same doc_id are
judged one by one. An empty benchmark leaves every document clean. Columns beyond doc_id and
text (item_id and text) are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import _FOLD, few, read, slices, words_of, written

WINDOW = 13
#: Words of one block of items, in bytes; its index takes some 24 to 28 bytes a word in each worker (counted, not measured), and the vocabulary.
BLOCK_BYTES = 8 << 20
#: Words of documents that are searched at a time, distinct words that are counted and item names that are returned at a time.
SEARCHED, COUNTED, NAMED = 200_000, 200_000, 100_000
#: A document is contaminated if hit words are at least 1 / SHARE of its words.
SHARE = 20


class Block:
    """Items as numbers of words: tokens has the items one after another, starts where each begins, owners its number in names."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.names: dict[object, int] = {}
        self.tokens, self.starts, self.owners, self.size = array("i"), array("q"), array("i"), 0

    def begin(self, item: object) -> None:
        self.starts.append(len(self.tokens))
        self.owners.append(self.names.setdefault(item, len(self.names)))

    def add(self, word: bytes) -> None:
        self.tokens.append(self.vocabulary.setdefault(word, len(self.vocabulary)))
        self.size += len(word) + 1


class Table:
    """The windows of one length: a hash each, in order, with a place in the tokens and the items they belong to."""

    def __init__(self, tokens: np.ndarray, at: np.ndarray, owner: np.ndarray, rank: np.ndarray, length: int):
        self.length = length
        best, offset = rank[tokens[at]], np.zeros(len(at), dtype=np.int32)
        for k in range(1, length):
            other = rank[tokens[at + k]]
            less = other < best
            best[less], offset[less] = other[less], k
        self.prefixes = np.zeros((length, len(rank) + 1), dtype=bool)  # [offset, word]: the last word is any that no item holds
        self.prefixes[offset, np.argsort(rank)[best]] = True
        del best, offset
        for seed in itertools.count():
            self.factor = np.random.default_rng(seed).integers(1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            keys = self.hashes(tokens, at)
            order = np.argsort(keys, kind="stable")
            keys, place = keys[order], at[order].astype(np.int32)
            new = np.ones(len(keys), dtype=bool)
            new[1:] = keys[1:] != keys[:-1]
            again = np.flatnonzero(~new)
            if all(np.array_equal(tokens[place[again] + k], tokens[place[again - 1] + k]) for k in range(length)):
                break  # each hash is that of one window
        self.keys, self.place, self.items = keys[new], place[new], owner[order]
        self.bounds = np.append(np.flatnonzero(new), len(new)).astype(np.int32)

    def hashes(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(self.length):
            out *= self.factor
            out += tokens[at + k].astype(np.uint64) + np.uint64(1)
        return out

    def find(self, tokens: np.ndarray, words: np.ndarray, strange: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows start in words, and their numbers; strange counts the words that no item holds, before each place."""
        at = np.flatnonzero(strange[self.length :] == strange[: -self.length])
        led = np.zeros(len(at), dtype=bool)
        for k in range(self.length):
            led |= self.prefixes[k][words[at + k]]
        at = at[led]
        keys = self.hashes(words, at)
        number = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[number] == keys
        at, number = at[same], number[same]
        whole = np.ones(len(at), dtype=bool)
        for k in range(self.length):
            whole &= tokens[self.place[number] + k] == words[at + k]
        return at[whole], number[whole]


class Index:
    """The windows of a block of items by their prefix words, in flat arrays."""

    def __init__(self, block: Block, frequency: dict[bytes, int], window: int):
        self.words, self.names, self.lookup = list(block.vocabulary), [str(x) for x in block.names], None
        self.tokens = np.array(block.tokens, dtype=np.int32)
        rank = np.empty(len(self.words), dtype=np.int32)
        rank[sorted(range(len(self.words)), key=lambda i: (frequency.get(self.words[i], 0), self.words[i]))] = np.arange(len(self.words), dtype=np.int32)
        starts, owners = np.array(block.starts, dtype=np.int64), np.array(block.owners, dtype=np.int32)
        sizes = np.diff(np.append(starts, len(self.tokens)))
        lengths, self.tables = np.minimum(sizes, window), []
        for length in np.unique(lengths[lengths > 0]).tolist():
            mine = lengths == length
            n = sizes[mine] - length + 1
            at = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.tables.append(Table(self.tokens, at, np.repeat(owners[mine], n), rank, length))

    def hits(self, texts: list[list[bytes]]) -> Hits:
        if self.lookup is None:
            self.lookup = {w: i for i, w in enumerate(self.words)}
        get, none, flat = self.lookup.get, len(self.words), array("i")
        for words in texts:
            flat.extend([get(w, none) for w in words])
            flat.append(none)  # no window reaches over it
        words = np.array(flat, dtype=np.int32)
        strange = np.concatenate([[0], np.cumsum(words == none)])
        return Hits(self, np.cumsum([0, *(len(w) + 1 for w in texts)]), [(t, *t.find(self.tokens, words, strange)) for t in self.tables if len(words) >= t.length])


class Hits:
    """What an index found in some texts: n_hit by text; runs of hit words and names of items for each."""

    def __init__(self, index: Index, bounds: np.ndarray, found: list[tuple[Table, np.ndarray, np.ndarray]]):
        self.index, self.bounds, self.found = index, bounds, found
        steps = np.zeros(bounds[-1] + 1, dtype=np.int32)
        for table, at, _ in found:
            np.add.at(steps, at, 1)
            np.add.at(steps, at + table.length, -1)
        covered = (np.cumsum(steps) > 0).astype(np.int8)  # never at a text's last place, which is no word
        self.n_hit = np.add.reduceat(covered[:-1], bounds[:-1], dtype=np.int64)
        edges = np.diff(covered, prepend=0)
        self.first, self.past = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

    def runs(self, text: int) -> tuple[list[int], list[int]]:
        low, high = np.searchsorted(self.first, self.bounds[text : text + 2])
        return (self.first[low:high] - self.bounds[text]).tolist(), (self.past[low:high] - self.bounds[text]).tolist()

    def names(self, text: int) -> list[str]:
        mine: set[int] = set()
        for table, at, number in self.found:
            low, high = np.searchsorted(at, self.bounds[text : text + 2])
            for n in np.unique(number[low:high]).tolist():
                mine.update(table.items[table.bounds[n] : table.bounds[n + 1]].tolist())
        return sorted(self.index.names[i] for i in mine)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of at most about block_bytes of words, one small partition at a time on the driver."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > block_bytes:
        items = items.repartition(min(10_000, -(-size // (1 << 20))))
    block = Block()
    for row in items.toLocalIterator():
        begun, last = False, []
        for found in re.finditer(rb"[0-9a-z\x80-\xff]+", (row["text"] or "").encode("utf-8", "surrogatepass").translate(_FOLD)):
            if block.size >= block_bytes and (not begun or len(block.tokens) - block.starts[-1] >= window):
                yield block
                block = Block()
                if begun:
                    block.begin(row["item_id"])
                    for word in last:
                        block.add(word)
            if not begun:
                block.begin(row["item_id"])
                begun = True
            block.add(found[0])
            last = [*last, found[0]][-(window - 1) :] if window > 1 else []
    if block.size:
        yield block


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of a (bounded) vocabulary occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(shared.value.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    sums = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in sums.collect()}  # at most the vocabulary


def frequencies(docs: DataFrame) -> DataFrame:
    """A written table of all words of the documents: word, n (documents that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        def told(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(set(words_of(text)))
                if len(counts) >= COUNTED:
                    yield told(counts)
                    counts.clear()
        yield told(counts)

    sums = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(sums, "frequencies")


def _of(table: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """The rows of frequencies() for a (bounded) vocabulary."""
    shared = table.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([w in shared.value for w in batch.column("word").to_pylist()], pa.bool_()))

    found = {bytes(r["word"]): r["n"] for r in table.mapInArrow(run, table.schema).collect()}  # at most the vocabulary
    shared.destroy()
    return found


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of texts in runs of at most SEARCHED words (or one text), with the number of the first."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        words = words_of(text)
        if group and size + len(words) > SEARCHED:
            yield first, group
            group, size, first = [], 0, i
        group.append(words)
        size += len(words)
    if group:
        yield first, group


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = (), with_items: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, items (array, sorted as strings), and the columns in keep, for each row of docs.

    With several blocks the rows are numbered in a written table and their hits merged by number.
    items is empty unless with_items: it has all items of a window, however many share it.
    """
    spark = docs.sparkSession
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in keep if c not in ("doc_id", "text"))]
    rows = docs.select(*columns)
    blocks = _blocks(benchmark, window, block_bytes)
    first, second = next(blocks, Block()), next(blocks, None)
    if second is not None:
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        words = frequencies(rows)

    def search(block: Block, source: DataFrame, many: bool) -> DataFrame:
        vocabulary = frozenset(block.vocabulary)
        index = spark.sparkContext.broadcast(Index(block, _of(words, vocabulary) if many else document_frequency(source, vocabulary), window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                for first, texts in _groups(batch.column("text").to_pylist()):
                    hits, at = index.value.hits(texts), 0
                    while at < len(texts):
                        names, n = [], 0
                        while at + len(names) < len(texts) and n < NAMED:
                            names.append(hits.names(at + len(names)) if with_items and hits.n_hit[at + len(names)] else [])
                            n += len(names[-1])
                        past = at + len(names)
                        some = batch.slice(first + at, past - at)
                        columns = [pa.array(list(map(len, texts[at:past])), pa.int64()), pa.array(hits.n_hit[at:past]), pa.array(names, pa.list_(pa.string()))]
                        if many:
                            runs = [hits.runs(i) for i in range(at, past)]
                            yield pa.RecordBatch.from_arrays([some.column("_row"), *columns, *(pa.array([r[i] for r in runs], pa.list_(pa.int64())) for i in (0, 1))], names=["_row", "n_words", "n_hit", "items", "starts", "stops"])
                        else:
                            own = [n for n in some.schema.names if n in keep and n != "doc_id"]
                            yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns, *(some.column(n) for n in own)], names=["doc_id", "n_words", "n_hit", "items", *own])
                        at = past

        if many:
            found = source.select("_row", "text").mapInArrow(run, "_row long, n_words long, n_hit long, items array<string>, starts array<long>, stops array<long>").filter("n_hit > 0")
            found = written(found, "hits")
            index.destroy()
            return found
        own = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType()))
        return source.mapInArrow(run, T.StructType([*own.fields, *(f for f in source.schema.fields if f.name in keep and f.name != "doc_id")]))

    if second is None:
        return search(first, rows, False)
    parts = [search(first, rows, True), search(second, rows, True), *(search(b, rows, True) for b in blocks)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))))

    def step(state, span):
        reach = F.greatest(state["reach"], span["stops"])
        more = F.greatest(F.lit(0).cast("long"), span["stops"] - F.greatest(span["starts"], state["reach"]))
        return F.struct((state["total"] + more).alias("total"), reach.alias("reach"))

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    merged = union.groupBy("_row").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.select("_row", F.aggregate("spans", zero, step, lambda s: s["total"]).alias("n_hit"), "items")
    n_words = F.size(F.expr(r"array_remove(split(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), '')")).cast("long")
    joined = rows.join(merged, "_row", "left")
    return joined.select("doc_id", n_words.alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *(c for c in rows.columns if c in keep and c != "doc_id"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names.

    origin: the documents as they were before lines were taken out of them. A doc_id that is
    contaminated there (in any of its rows) goes too: a passage that many documents share is
    left in one of them, and the rest of the others still was written around it.
    """
    names = {c: f"_kept{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = find_hits(docs.withColumnsRenamed(names), benchmark, keep=("text", *names.values()), with_items=False)
    found = found.filter(~contaminated(F.col("n_hit"), F.col("n_words")))
    if origin is not None:
        was = find_hits(origin, benchmark, with_items=False).filter(contaminated(F.col("n_hit"), F.col("n_words")))
        was = few(written(was.select(F.col("doc_id").alias("_was")).distinct(), "contaminated"))
        found = found.join(was, F.col("doc_id") == F.col("_was"), "left_anti")
    return found.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same digest rows, window by window, for small tests."""
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            sought = words_of(item_text)
            n = min(window, len(sought))
            for at in range(len(sought) - n + 1 if sought else 0):
                for start in range(len(words) - n + 1):
                    if words[start : start + n] == sought[at : at + n]:
                        hit.update(range(start, start + n))
                        found.add(item)
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and SHARE * len(hit) >= len(words)))
    return out
