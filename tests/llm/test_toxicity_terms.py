"""Terms enter the model by few labels, and by pairs of which neither term differs alone."""

import random

from corpusloom.llm import toxicity


def right(spark, table):
    docs = spark.createDataFrame([(i, t) for i, t, _ in table], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in table], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert any(r["toxic"] for r in scored)
    return sum((r["toxicity"] >= 0.5) == (r["toxic"] == 1) for r in scored) / len(scored)


def test_few_labels(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    table = []
    for i in range(85):
        toxic = i % 6 == 0
        table.append((i, " ".join(rng.choices(words, k=40) + (rng.sample(["scum", "moron", "loser", "trash", "idiot"], 2) if toxic else [])), int(toxic)))
    assert right(spark, table) >= 0.9


def test_terms_that_only_differ_together(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    table = []
    for i in range(1200):
        # each term is in half of the texts of either label
        group, verb = rng.random() < 0.5, rng.random() < 0.5
        table.append((i, " ".join(rng.choices(words, k=25) + ["crowd"] * group + ["leave"] * verb), int(group == verb)))
    assert right(spark, table) >= 0.95
