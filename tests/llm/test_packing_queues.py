"""Packing with many sources, targets unlike the corpus, odd rows and empty tables."""

import collections
import random
import statistics

from test_operators import BPE, check_packing

from corpusloom.llm import packing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_many_sources(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["sun", "moon", "sky", "granite"], k=900)), f"source {i % 500}") for i in range(1000)]
    found = packing.pack(table(spark, rows), BPE, with_ids=False).collect()
    check_packing(found, {i: t for i, t, _ in rows})
    assert statistics.median(r["length"] for r in found) >= packing.VISIT
    assert all(r["source_queue"] == f"source {r['doc_id'] % 500}" for r in found)


def test_small_sources_share_a_queue_and_keep_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["sun", "moon", "sky"], k=60)), "big" if i % 4 else f"s{i}") for i in range(600)]
    found = packing.pack(table(spark, rows), BPE, targets={"big": 0.5, **{f"s{i}": 0.5 / 150 for i in range(0, 600, 4)}}, with_ids=False, max_queues=20).collect()
    check_packing(found, {i: t for i, t, _ in rows})
    by = collections.defaultdict(collections.Counter)
    for r in found:
        by[r["sequence_id"]][r["source_queue"] == "big"] += r["length"]
    whole = [by[s] for s in sorted(by)]
    # half of each window is the small sources' until they run dry, though they hold a quarter of the tokens
    open_ = [w for w in whole[: len(whole) // 3]]
    assert open_ and all(abs(w[True] - 512) <= 2 * packing.VISIT for w in open_)


def test_targets_unlike_the_corpus(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["sun", "moon", "sky"], k=200)), "ab"[i % 10 == 0]) for i in range(400)]
    found = packing.pack(table(spark, rows), BPE, targets={"a": 0.25, "b": 0.75}, with_ids=False).collect()
    check_packing(found, {i: t for i, t, _ in rows})
    by = collections.defaultdict(collections.Counter)
    for r in found:
        by[r["sequence_id"]][r["source_queue"]] += r["length"]
    for s in range(6):
        assert abs(by[s]["b"] - 768) <= 2 * packing.VISIT


def test_odd_rows(spark, odd, empty, texts):
    assert packing.pack(empty, BPE).collect() == []
    found = packing.pack(odd, BPE).collect()
    counts = collections.Counter()
    for r in found:
        counts[r["doc_id"]] += r["length"]
    coder = packing._tokenizer(BPE)
    size = lambda t: len(coder.encode(t or "", add_special_tokens=False).ids) + 1
    want = collections.Counter({i: size(t) for i, t in enumerate(texts)})
    want[3], want[5], want[None] = 2 * want[3], 2 * want[5], counts[None]
    assert counts == want and counts[None] > 0


def test_large_ids_beside_a_null_one(spark):
    ids = [(1 << 53) + 1, None, (1 << 62) + 3]
    found = packing.pack(spark.createDataFrame([(i, "a b", "s") for i in ids], "doc_id long, text string, source string").coalesce(1), BPE).collect()
    assert {r["doc_id"] for r in found} == set(ids)
