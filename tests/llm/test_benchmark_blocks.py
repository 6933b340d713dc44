"""What a worker gets of a benchmark is bounded by the block, whatever the items, and the hits are those of brute force."""

import pickle
import random

import pytest
from pyspark import SparkContext

from corpusloom.llm import decontamination


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    long, shared = [word() for _ in range(6000)], [word() for _ in range(20)]
    items = [(1, " ".join(long)), *((i, " ".join([word(), *shared, word()])) for i in range(2, 40)), (40, "two words"), (41, None)]
    docs = [(0, " ".join(long[2990:3040])), (1, " ".join([*long[:12], "x", *long[100:113]])), (2, " ".join(shared)), (3, " ".join([word(), *shared, *shared, word()])), (4, "Two, WORDS."), (5, None), (6, " ".join(long[5980:]))]
    return docs, items


def test_index_is_bounded_by_the_block(spark, case, monkeypatch):
    docs, items = case
    sizes, broadcast = [], SparkContext.broadcast

    def told(self, value):
        sizes.append(len(pickle.dumps(value)))
        return broadcast(self, value)

    monkeypatch.setattr(SparkContext, "broadcast", told)
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.find_hits(*tables, block_bytes=10_000).collect()}
    assert max(sizes) < 20 * 10_000
    for doc, n_words, n_hit, n_items, _, _ in decontamination.brute_force(docs, items):
        assert (found[doc]["n_words"], found[doc]["n_hit"], len(found[doc]["items"])) == (n_words, n_hit, n_items)
    assert found[2]["items"] == sorted(str(i) for i in range(2, 40))


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 10_000])
def test_hits_without_items(spark, case, block):
    docs, items = case
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r["n_hit"] for r in decontamination.find_hits(*tables, block_bytes=block, with_items=False).collect()}
    assert found == {r[0]: r[2] for r in decontamination.brute_force(docs, items)}
