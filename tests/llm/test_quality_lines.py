"""The cleaned text keeps repetitions of good lines."""

from corpusloom.llm import quality


def test_repeated_good_lines_stay(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    bad = " | ".join(f"item{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(0, "\n".join([good, bad, good, bad]))], "doc_id long, text string")
    assert quality.judge(df).collect()[0]["cleaned"] == good + "\n" + good


def test_windows_that_share_a_hash(spark, monkeypatch):
    """All windows in one hash: equal ones that are no neighbours are still found."""
    real = quality.F.xxhash64
    rows = [(0, "a b c x a b c y z a b"), (1, "a b c d e f"), (2, "p q r s p q r s p q r"), (3, "one two three four one two five one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(df).collect()}
    monkeypatch.setattr(quality.F, "xxhash64", lambda g: real(g) * 0)
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(df).collect()} == want == {0: 6, 1: 0, 2: 11, 3: 6}
