"""The pipeline's near copies against the exact similarity of all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from conftest_llm import columns_kept

from corpusloom.llm import nearcopies


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(x, y):
    return len(x & y) >= 0.8 * len(x | y)


@pytest.mark.parametrize(("tile", "dense"), [(nearcopies.TILE, 4), (7, 4), (nearcopies.TILE, 0)])
def test_near_copies_against_all_pairs(spark, tile, dense, monkeypatch):
    monkeypatch.setattr(nearcopies, "DENSE", dense)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(900)]
    texts = [None, "", "one two", "ONE two"]
    for n in (40, 150, 400, 900):
        for _ in range(4):
            base = rng.choices(vocabulary, k=n)
            texts.append(" ".join(base))
            for share in (0.005, 0.015, 0.02, 0.03, 0.04):
                texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
    hot = rng.choices(vocabulary, k=300)
    texts += [" ".join(rng.choice(vocabulary) if rng.random() < 0.01 else w for w in hot) for _ in range(40)]
    hot = rng.choices(vocabulary, k=200)  # most of these are a little under the bound
    texts += [" ".join(rng.choice(vocabulary) if rng.random() < 0.03 else w for w in hot) for _ in range(60)]
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs, tile).collect()}
    assert found == dict(enumerate(root))
    stays = corpus_pipeline.dedup_documents(spark, docs, "")
    assert {r["doc_id"] for r in stays.collect()} == set(root)


def test_near_copies_on_odd_rows(spark, odd, empty):
    found = corpus_pipeline.dedup_documents(spark, odd, "")
    assert columns_kept(found, odd)
    ids = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert 6 not in ids and 5 in ids and None in ids and ids.count(3) == 2
    assert corpus_pipeline.dedup_documents(spark, empty, "").count() == 0


def test_cells_hold_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    for block, dense in ((4, 1), (4, 100), (50, 0)):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        monkeypatch.setattr(nearcopies, "DENSE", dense)
        n_x, n_y = rng.integers(1, 500, 20).astype(np.uint64), rng.integers(1, 500, 25).astype(np.uint64)
        cells, want = nearcopies.Cells(n_x, n_y), set()
        for _ in range(4):
            i, j = rng.integers(0, 20, 60), rng.integers(0, 25, 60)
            cells.add(i, j)
            want |= set(zip(i.tolist(), j.tolist()))
        single = {(x, y) for held in cells.pairs.values() for p in held for x, y in p.T.tolist()}
        whole = {(x, y) for left, right in cells.dense.values() for x in left for y in right}
        assert single <= want <= single | whole
        assert all(len(left) <= block and len(right) <= block for left, right in cells.dense.values())


def test_likeness_equals_jaccard(monkeypatch):
    monkeypatch.setattr(nearcopies, "COLUMNS", 16)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 120, rng.integers(1, 90))).astype(np.uint64) for _ in range(14)]
    got = nearcopies.likeness(sets[:6], sets[6:])
    assert np.allclose(got, [[nearcopies.jaccard(x, y) for y in sets[6:]] for x in sets[:6]])
