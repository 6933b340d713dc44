import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, start=0):
    rows = [(start + i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, very long, repeated, tied, near-equal and odd texts."""
    rng = random.Random(5)
    words = ["the", "of", "an", "été", "river", "stone", "walked", "quietly", "under", "bridge", "日本", "x1", "and", "toward"]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    base = prose(120) + ".\n" + prose(60) + ".\n" + prose(70) + "."
    near = base.replace("river", "rivers", 1)
    return [None, "", " \n\t ", "one", "a b c", base, base, near, prose(4000) + "\n" + prose(9000), "x" * 50_000, prose(80) + ".", "Ünï 😀 A\x0bB\x1cC D", "of of of of of of of", prose(55) + ".\n" + base.split("\n")[1], "1 2 3\n\n1 2 3\n"]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return make(spark, texts)


@pytest.fixture(scope="session")
def odd(spark, docs):
    """The documents with repeated rows, a null id and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    more = docs.filter("doc_id in (3, 5)").unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    clash = {c: F.lit("own") for c in ("fp", "place", "line", "words", "n_words", "queue", "part", "shard", "size", "toxicity", "spans", "kept", "id", "_lines", "score")}
    return docs.unionByName(more).withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
