"""Duplicate lines go whatever a document loses; with spare, near copies of one that stays are left to the next stage."""

import random

from corpusloom.llm import linededup


def test_only_near_copies_stay_whole(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(n))
    shared, again, own, base = prose(60), prose(30), prose(10), [prose(50), prose(50), prose(50)]
    texts = {
        1: shared + "\n" + prose(80),
        2: shared + "\n" + own,  # the passage of another document and less of its own
        3: "\n".join([again, own[::-1], again, again]),  # mostly its own repeats
        4: "\n".join(base),
        5: "\n".join([*base[:2], base[2] + " last words"]),  # a near copy
        6: "\n".join([*base, base[0]]),  # a copy with a repeat of its own
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["text"] for r in linededup.cleaned(df, spare=True).collect()}
    assert found == {1: texts[1], 2: own, 3: again + "\n" + own[::-1], 4: texts[4], 5: texts[5], 6: texts[4]}
    found = {r["doc_id"]: r["text"] for r in linededup.cleaned(df).collect()}
    assert found == {1: texts[1], 2: own, 3: again + "\n" + own[::-1], 4: texts[4], 5: base[2] + " last words", 6: ""}
