"""The five stages in a row, each against what it must do to its own input."""

import random

import corpus_pipeline
from test_operators import check_packing

from corpusloom.llm import toxicity


def tables(tmp_path, spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    shared, item = prose(60), prose(40)
    texts, labels = [], []
    for i in range(420):
        text = prose(90) + "\n" + prose(70)
        if i % 6 == 0:
            text += " you fool and idiot, all of you."
        labels.append((i, 1, int(i % 6 == 0)))
        texts.append(text)
    texts[7] = texts[1]  # an exact copy
    texts[8] = texts[2][:-1] + " end."  # a near copy
    for i in (9, 10, 11):
        texts[i] += "\n" + shared
    texts[13] = prose(10) + " " + item
    texts[14] = None
    for i in (15, 16, 17):  # the same passage as a line of its own: line dedup leaves it in the first only
        texts[i] = prose(30) + "\n" + item
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, shared, item


def test_stages(spark, tmp_path):
    texts, shared, item = tables(tmp_path, spark)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = toxicity.written(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i in range(420) if i % 6 == 0}
    assert set(steps["toxicity"]) == set(range(420)) - toxic
    assert set(steps["line_dedup"]) == set(steps["toxicity"])
    assert [shared in steps["line_dedup"][i] for i in (9, 10, 11)] == [True, False, False]
    assert set(steps["line_dedup"]) - set(steps["simhash"]) == {7, 8}
    assert [item in steps["simhash"][i] for i in (15, 16, 17)] == [True, False, False]
    assert set(steps["simhash"]) - set(steps["decontamination"]) == {13, 15, 16, 17}
    check_packing(corpus_pipeline.run(spark, sf).collect(), steps["decontamination"])


def test_empty_tables(spark, tmp_path, empty):
    sf = str(tmp_path)
    empty.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_odd_rows_and_clashing_columns(spark, tmp_path, odd):
    sf = str(tmp_path)
    odd.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "never found anywhere")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = toxicity.written(stage(spark, docs, sf), name)
        assert docs.columns == odd.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    check = {i: t for i, t in kept.items() if i not in (None, 3, 5)}
    found = [r for r in corpus_pipeline.run(spark, sf).collect() if r["doc_id"] in check]
    check_packing_of(found, check)


def check_packing_of(found, texts):
    """The pieces of some documents hold their tokens, without regard to windows."""
    at = {i: 0 for i in texts}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]]
        at[r["doc_id"]] += r["length"]
    assert {r["doc_id"]: r["doc_tokens"] for r in found} == at
