"""No line that the model would confirm is left unscored."""

from pyspark.sql import functions as F

from corpusloom.llm import licenses


def test_every_template_alone_is_confirmed(spark):
    table = [(f"{family} {i}", text, family) for family, texts in licenses.TEMPLATES.items() for i, text in enumerate(texts)]
    table += [("r", "Prose before.\nAll rights reserved.\nProse after.", "reserved"), ("a", "Apache-2.0", "apache"), ("c", "CC BY-SA 4.0", "cc-by"), ("x", "Small rights reserved for all.", None), ("n", None, None)]
    df = spark.createDataFrame(table, "doc_id string, text string, family string")
    found = {(r["doc_id"], r["family"]) for r in licenses.paragraphs(df).collect() if r["confirmed"]}
    assert found == {(name, family) for name, _, family in table if family}


def test_calibration_on_unseen_sentences():
    """Confidence and accuracy of sentences that the weights have not seen, in tenths of confidence."""
    logits, labels = licenses.unseen()
    p = licenses.softmax(logits / licenses.model()[3])
    sure, right = p.max(axis=1), p.argmax(axis=1) == labels.argmax(axis=1)
    tenths = [(sure > k / 10) & (sure <= (k + 1) / 10) for k in range(10)]
    error = sum(abs(right[m].mean() - sure[m].mean()) * m.mean() for m in tenths if m.any())
    plain = licenses.softmax(logits / 0.2)  # the confidence of a model that is not calibrated
    worse = abs(plain.max(axis=1).mean() - right.mean())
    assert error < 0.25 < worse


def test_odd_rows_through_the_query(spark, odd, tmp_path):
    notice = "Prose.\nReleased under the MIT License.\n \nLicensed under CC BY 4.0."
    more = odd.limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit(notice)})
    null = more.withColumn("doc_id", F.lit(None).cast("long"))
    odd.unionByName(more).unionByName(more).unionByName(null).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["n_license_lines"], r["n_unknown_lines"], r["families"]) for r in licenses.op5_licenses(spark, str(tmp_path)).collect()]
    assert [r for r in rows if r[0] == 77] == [(77, 4, 2, "cc-by,mit")] * 2
    assert [r[1:] for r in rows if r[0] is None] == [(2, 1, "cc-by,mit")] * 2
    assert len(rows) == odd.count() + 3 and all(r[1] == 0 for r in rows if r[0] not in (77, None))


def test_repeated_rows_are_scored_one_by_one(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")] * 3, "doc_id long, text string")
    assert [(r["paragraph"], r["family"]) for r in licenses.paragraphs(df).collect()] == [("Released under the MIT License.", "mit")] * 3
