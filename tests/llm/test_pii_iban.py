"""An IBAN ends where its country's length ends."""

from corpusloom.llm import pii


def test_iban_before_other_words(spark):
    plain, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    table = [f"IBAN {plain} Please", f"{spaced} BIC COBADEFF", f"{plain} {spaced}", f"{spaced} GB82WEST12345698765432 OK", f"{plain}7", "NO9386011117947 A1", "DE88370400440532013000 Please"]
    want = [[plain], [spaced], [plain, spaced], [spaced, "GB82WEST12345698765432"], [], ["NO9386011117947"], []]
    df = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string")
    found = {r["doc_id"]: [table[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"] if s["kind"] == "iban"] for r in pii.find_pii(df).collect()}
    assert [found[i] for i in range(len(table))] == want


def test_many_spans_in_one_text(spark):
    """Places and contexts of 20,000 matches, in a few seconds: nothing is copied for each of them."""
    import time

    n = 20_000
    text = " ".join(f"é{i} user{i}@example.org" for i in range(n))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    began = time.time()
    spans = pii.find_pii(df).selectExpr("filter(spans, s -> s.kind = 'email') AS spans").collect()[0][0]
    assert time.time() - began < 40 and len(spans) == n
    for k in (0, 1, 77, n - 1):
        assert text[spans[k]["start"] : spans[k]["stop"]] == f"user{k}@example.org"
