"""Line dedup gives the same classes whether what met is broadcast or joined."""

import random

from corpusloom.llm import common, linededup


def test_shuffled_joins_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdefgh ", k=40)) for _ in range(10)]
    rows = [(i, "\n".join([rng.choice(stems), rng.choice(stems)[:-1] + "x", f"own line of number {i} only here"])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = lambda: sorted((r["doc_id"], r["text"], tuple(r["_lines"]["kept_in"])) for r in linededup.dedup_lines(df).collect())
    few = told()
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert told() == few
