"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum of w over the terms of a text + sum over pairs of terms of v.v'): the
pair products learn what two terms mean together (an insult and whom it is aimed at), which no
sum of term weights holds. Terms are a text's distinct words, hashed; of these the model keeps
the ones whose document frequency differs most between the labels, and of the PAIR_TERMS most
varied ones those that differ in pairs more than alone. What counts as a difference follows from
the number of terms or pairs compared (screen), not from that of the labels.

The model is fitted on the driver from at most MAX_ROWS labelled documents (those with the
smallest hashes of doc_id, whatever the input's size) and broadcast: its size is bounded by
BUCKETS and MAX_TERMS. Scoring is one pass without a shuffle.

Labels serve for fitting only, and only those whose crc32(doc_id as text) mod 5 is not 0. Null
and empty texts get the score of no terms. Rows with the same doc_id are scored one by one; a
doc_id with several labels is toxic if one of them is. Without labels every score is that of the
prior, under 0.5. Null labels and ids are skipped in fitting. Columns beyond doc_id and text
(doc_id and toxic) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import read, slices, words_of, written

BUCKETS = 1 << 18
MAX_ROWS = 12_000
MAX_TERMS = 2048
#: A term (or pair) is kept if so many documents have it.
MIN_DOCS = 3
#: Terms whose pairs are compared.
PAIR_TERMS = 512
FACTORS, STEPS, RATE, SHRINK = 8, 250, 0.05, 1e-3
#: Logit of a text when nothing is known of the labels.
PRIOR = -3.0


@dataclass
class Machine:
    terms: np.ndarray  # bucket -> term or -1
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(doc, self.linear[term], n) + self.bias
        squares = np.bincount(doc, (self.factors**2).sum(axis=1)[term], n)
        for k in range(self.factors.shape[1]):
            out += 0.5 * np.bincount(doc, self.factors[term, k], n) ** 2
        return out - 0.5 * squares


def buckets_of(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a text."""
    words = set(words_of(text))
    return np.unique(np.fromiter(map(crc32, words), np.uint32, len(words)) % BUCKETS).astype(np.int64)


def active(texts: list[str | None], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) for each text's distinct terms that the model keeps."""
    docs, found = [], []
    for i, text in enumerate(texts):
        term = terms[buckets_of(text)]
        term = term[term >= 0]
        found.append(term)
        docs.append(np.full(len(term), i))
    return (np.concatenate(docs), np.concatenate(found)) if docs else (np.zeros(0, int), np.zeros(0, int))


def held_out() -> Column:
    """Rows that must not teach: remainder 0 of crc32 of the id as text, by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def screen(n: int) -> float:
    """The standard errors that the largest of n differences without cause is expected to reach."""
    return float(np.sqrt(2 * np.log(max(n, 2))))


def errors_apart(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int) -> np.ndarray:
    """The difference of two frequencies in standard errors."""
    pooled = (n0 + n1) / (rows0 + rows1)
    return (n1 / rows1 - n0 / rows0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / rows0 + 1 / rows1))


def paired(present: np.ndarray, labels: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Columns of present (text, term) that with another one differ more than both do alone (z), the most telling first."""
    n0, n1 = (present[labels == k].astype(np.float32) for k in (0, 1))
    both0, both1 = n0.T @ n0, n1.T @ n1
    joint = np.abs(errors_apart(both0.astype(np.float64), both1.astype(np.float64), len(n0), len(n1)))
    alone = np.abs(z)
    m = len(z)
    told = (both0 + both1 >= MIN_DOCS) & (joint >= screen(m * (m - 1) // 2)) & (joint > np.maximum(alone[:, None], alone[None, :]) + 1)
    np.fill_diagonal(told, False)
    most = np.where(told, joint, 0).max(axis=1, initial=0)
    return np.lexsort((np.arange(m), -most))[: int((most > 0).sum())]


def train(doc: np.ndarray, term: np.ndarray, labels: np.ndarray, n_terms: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit bias, linear weights and factors by Adam on the whole (bounded) sample."""
    n, rng = len(labels), np.random.default_rng(7)
    share = (labels.sum() + 0.5) / (n + 1.0)
    values = [np.array([np.log(share / (1 - share))]), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, STEPS + 1 if len(term) else 1):
        bias, w, v = values
        own = v[term]
        sums = np.stack([np.bincount(doc, own[:, k], n) for k in range(FACTORS)], axis=1)
        logit = bias[0] + np.bincount(doc, w[term], n) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(doc, (own**2).sum(axis=1), n))
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / n
        each = error[doc]
        pair = each[:, None] * (sums[doc] - own)
        slopes = [np.array([error.sum()]), np.bincount(term, each, n_terms) + SHRINK / n * w, np.stack([np.bincount(term, pair[:, k], n_terms) for k in range(FACTORS)], axis=1) + SHRINK * v / n]
        for value, slope, (first, second) in zip(values, slopes, moments, strict=True):
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            value -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return float(values[0][0]), values[1], values[2]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Learn from at most max_rows labelled documents."""
    teach = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    teach = teach.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    teach = teach.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(teach), "doc_id")
    # copies teach once
    texts = texts.groupBy("text").agg(F.max("label").alias("label")).select("label", "text")
    texts = written(texts, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for batch in slices(batches):
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n[label, buckets_of(text)] += 1
                rows[label] += 1
        some = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[0, some], rows[0])), pa.array(np.append(n[1, some], rows[1]))], names=["bucket", "n0", "n1"])

    seen = texts.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # at most BUCKETS + 1 rows
    table = {b: (x, y) for b, x, y in zip(seen["bucket"], seen["n0"], seen["n1"], strict=True)}
    rows0, rows1 = table.pop(-1, (0, 0))
    terms = np.full(BUCKETS, -1, dtype=np.int64)
    if not rows0 or not rows1:
        return Machine(terms, PRIOR if not rows1 else -PRIOR, np.zeros(1), np.zeros((1, FACTORS)))
    buckets = np.array(list(table), dtype=np.int64)
    n0, n1 = (np.array(list(table.values()), dtype=np.float64).T if table else np.zeros((2, 0)))
    z = errors_apart(n0, n1, rows0, rows1)
    enough = n0 + n1 >= MIN_DOCS
    ranked = np.lexsort((buckets, -np.abs(z)))
    chosen = [i for i in ranked if enough[i] and abs(z[i]) >= screen(int(enough.sum()))][:MAX_TERMS]
    share = (n0 + n1) / (rows0 + rows1)
    varied = np.lexsort((buckets, -share * (1 - share)))
    varied = varied[enough[varied]][:PAIR_TERMS]
    places = np.full(BUCKETS, -1, dtype=np.int64)
    places[buckets[varied]] = np.arange(len(varied))
    placed = docs.sparkSession.sparkContext.broadcast(places)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = []
            for text in batch.column("text").to_pylist():
                row = np.zeros(PAIR_TERMS, dtype=bool)
                found = placed.value[buckets_of(text)]
                row[found[found >= 0]] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(bits, pa.binary())], names=["label", "bits"])

    held = texts.mapInArrow(presence, "label int, bits binary").collect()  # at most max_rows rows of PAIR_TERMS bits
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in held), np.uint8).reshape(len(held), -1)
    present = np.unpackbits(bits, axis=1)[:, : len(varied)]
    taken = set(chosen)
    more = [varied[i] for i in paired(present, np.array([r["label"] for r in held]), z[varied])]
    chosen += [i for i in more if i not in taken][: MAX_TERMS - len(chosen)]
    terms[buckets[chosen]] = np.arange(len(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value[buckets_of(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([f[f >= 0].tolist() for f in found], pa.list_(pa.int64()))], names=["label", "terms"])

    encoded = sorted((r["label"], tuple(r["terms"])) for r in texts.mapInArrow(encode, "label int, terms array<long>").collect())  # at most max_rows rows
    doc = np.repeat(np.arange(len(encoded)), [len(t) for _, t in encoded])
    term = np.array([x for _, t in encoded for x in t], dtype=np.int64)
    return Machine(terms, *train(doc, term, np.array([y for y, _ in encoded], dtype=np.float64), max(1, len(chosen))))


def score(docs: DataFrame, machine: Machine, column: str = "toxicity") -> DataFrame:
    """The rows of docs with their score (0 to 1) in a column, which replaces one of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            logit = shared.value.logits(*active(texts, shared.value.terms), len(texts))
            values = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, column])

    plain = docs.drop(column)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(column, T.DoubleType())]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # the text stays behind once it is scored
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
