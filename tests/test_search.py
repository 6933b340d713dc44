"""Search operators on small corpora: grammar, scopes, spans, thresholds, fusion."""

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.functions import batches, paths, text
from corpusloom.operators import lexical as lexical_module
from corpusloom.operators import render
from corpusloom.operators.chunking import chunk_documents, chunks, estimate, locate_spans, long_estimate, snippets
from corpusloom.operators.grep import grep
from corpusloom.operators.hybrid import BARE, WITH_TERMS, fuse
from corpusloom.operators.lexical import Query, bm25, document_sizes, from_index, from_texts, lexical, phrases, postings, token_stats, totals
from corpusloom.operators.semantic import HashEmbedder, embed, normalised, semantic


def corpus(spark, **files):
    return spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content string")


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def found(df):
    return [tuple(r) for r in df.select("path", "line", "byte_start", "byte_end").orderBy("path", "line", "byte_start").collect()]


def test_query_grammar():
    assert phrases(Query("Foo-bar, baz foo")) == [["foo"], ["bar"], ["baz"], ["foo"]]
    assert phrases(Query("x", terms=("the big tree",))) == [["the", "big", "tree"], ["tree"]]
    assert phrases(Query("x", terms=('say "hi" there', "  "))) == [["say", "hi", "there"], ["there"]]
    assert phrases(Query("?!")) == []
    with pytest.raises(ValueError):
        Query("x", threshold=float("nan"))
    with pytest.raises(ValueError):
        Query("x", threshold=5.0)


def test_scope_is_equality_or_child(spark):
    df = spark.createDataFrame([("notes/in.md",), ("notes",), ("notes2.md",), ("notes-old.md",), ("Notes/up.md",)], "path string")
    assert {r[0] for r in df.filter(paths.in_scope(F.col("path"), "notes")).collect()} == {"notes/in.md", "notes"}
    for bad in ("/abs", "a/../b", ""):
        with pytest.raises(ValueError):
            paths.relative_path(bad)


def test_grep_spans_and_flags(spark):
    df = files(spark, ("a.txt", "né foo foo\nbar\nFOO food\n"), ("b/c.rs", "let foo = 1;"), ("n", None), ("e", ""))
    assert found(grep(df, "foo")) == [("a.txt", 1, 4, 7), ("a.txt", 1, 8, 11), ("a.txt", 3, 20, 23), ("b/c.rs", 1, 4, 7)]
    assert [r[1] for r in found(grep(df, "foo", word=True)) if r[0] == "a.txt"] == [1, 1]
    assert len(found(grep(df, "foo", ignore_case=True))) == 5
    assert len(found(grep(df, "É", ignore_case=True))) == 1
    assert found(grep(files(spark, ("m", "a+b [x]\naab")), "a+b [x]", fixed=True)) == [("m", 1, 0, 7)]
    assert found(grep(df, "foo", scope="b")) == [("b/c.rs", 1, 4, 7)]
    assert len(found(grep(df, "foo", limit=2))) == 2
    assert found(grep(df, "foo", limit=0)) == []
    assert [r[:2] for r in found(grep(df, "foo", files_only=True))] == [("a.txt", 1), ("b/c.rs", 1)]
    assert [r[:2] for r in found(grep(df, "^bar$"))] == [("a.txt", 2)]
    assert found(grep(files(spark, ("r", "x\r\ny foo")), "foo")) == [("r", 3, 5, 8)]


def test_grep_context_is_clipped(spark):
    df = files(spark, ("a", "1\n2\n3\nhit\n5\n6\n7"), ("b", "hit\n2\n3"))
    rows = {r["path"]: r for r in grep(df, "hit", context=2).collect()}
    assert [x["text"] for x in rows["a"]["before"]] == ["2", "3"] and [x["line"] for x in rows["a"]["after"]] == [5, 6]
    assert rows["b"]["before"] == [] and [x["text"] for x in rows["b"]["after"]] == ["2", "3"]
    block = render.match_text(grep(df, "hit", context=1), line_numbers=True).filter("path = 'a'").first()["block"]
    assert block == "a:4:3\nhit\n5"


def test_phrase_beats_scattered_words(spark):
    df = files(spark, ("p", "the ancient granite bridge stands"), ("s", "granite here and a bridge there, ancient"), ("o", "nothing"), ("z", "other words still"))
    q = Query("", terms=("ancient granite bridge",))
    rows = bm25(from_texts(df, phrases(q)), phrases(q), limit=10).collect()
    assert [r["path"] for r in rows] == ["p", "s"]
    again = bm25(from_index(postings(df), totals(document_sizes(df)), phrases(q)), phrases(q), limit=10).collect()
    assert [(r["path"], round(r["score"], 9)) for r in again] == [(r["path"], round(r["score"], 9)) for r in rows]


def test_phrases_overlap_and_keep_to_tokens(spark):
    df = files(spark, ("t", "a a a ba a,A ab\nA"), ("İ", "İstanbul x1a a\u0301a"), ("a/a", None), ("", ""))
    sought = [["a", "a"], ["a"], ["i"], ["stanbul", "x1a", "a", "a"], ["zzz"]]
    cut = {r["path"]: regex.findall(text.TOKEN, r["c"]) for r in df.select("path", F.lower(F.coalesce("content", F.lit(""))).alias("c")).collect()}
    names = {r["path"]: regex.findall(text.TOKEN, r["p"]) for r in df.select("path", F.lower("path").alias("p")).collect()}
    count = lambda tokens, p: sum(tokens[i : i + len(p)] == p for i in range(len(tokens)))
    by_hand = {path: (len(cut[path]) + len(names[path]), *(0.5 * count(names[path], p) + count(cut[path], p) for p in sought)) for path in cut}
    of_texts = {r[0]: tuple(r[1:]) for r in from_texts(df, sought).rows.collect()}
    of_index = {r[0]: tuple(r[1:]) for r in from_index(postings(df), totals(document_sizes(df)), sought).rows.collect()}
    assert of_texts == by_hand and by_hand["t"][1] == 3 and by_hand["İ"][4] == 1
    assert of_index == {k: v for k, v in by_hand.items() if any(v[1:])}


def test_texts_are_read_and_cut_once(spark, tmp_path):
    files(spark, ("p", "one two"), ("q", "two three")).write.parquet(str(tmp_path / "c"))
    sought = [["one"], ["two", "three"]]
    found = bm25(from_texts(spark.read.parquet(str(tmp_path / "c")), sought), sought, limit=5)
    found.collect()
    assert "size(array(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no second count to test for emptiness
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") == 1 and plan.count("ReusedExchange") == 2


def test_lexical_normalises_then_cuts(spark):
    df = files(spark, *[(f"f{i}", "apple " * (i + 1) + "pear fig") for i in range(4)], *[(f"g{i}", "none") for i in range(9)])
    docs = from_texts(df, [["apple"]])
    every = lexical(docs, Query("apple")).collect()
    assert max(r["score"] for r in every) == 1.0
    some = lexical(docs, Query("apple", threshold=0.8)).collect()
    assert {r["path"] for r in some} <= {r["path"] for r in every} and all(r["score"] >= 0.8 for r in some)
    assert lexical(docs, Query("?")).count() == 0


def test_semantic_threshold_limit_and_ties(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.6, 0.8]), ("b", 0, [1.0, 0.0]), ("c", 0, None)], "path string, ord int, vec array<float>")
    rows = semantic(df, [1.0, 0.0], topk=3, threshold=0.6 - 1e-6).collect()
    assert [(r["path"], r["ord"]) for r in rows] == [("a", 0), ("b", 0), ("a", 1)]
    assert semantic(df, [1.0, 0.0], threshold=0.99).count() == 2
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(normalised(F.col("v")).alias("u")).first()["u"]
    assert zero == [0.0, 0.0]


def test_fusion_prefers_agreement(spark):
    def ranks(*names):
        return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "path string, rank int")

    rows = {r["path"]: r for r in fuse(ranks("x", "y"), ranks("y", "z"), 1.0).collect()}
    assert rows["y"]["rrf_score"] == pytest.approx(1 / 4 + 0.01 / 5)
    assert rows["x"]["vec_rank"] is None and rows["x"]["rrf_score"] == pytest.approx(1 / 4)
    assert {r["path"]: r["rrf_score"] for r in fuse(ranks("x"), ranks("z"), WITH_TERMS).collect()}["x"] == pytest.approx(1.05 / 4)
    assert {r["path"]: r["rrf_score"] for r in fuse(ranks("x"), ranks("z"), BARE).collect()}["x"] == pytest.approx(0.15 / 4)


def test_token_estimate():
    assert estimate("") == 0
    assert estimate("a" * 48) == 10
    assert estimate("日" * 12) == 10
    assert estimate("😀" * 5) == 5
    assert estimate("let x = y; {") == 3
    assert long_estimate("x" * 25) == 10


@pytest.mark.parametrize("body", ["a" * 20_000, "é" * 12_000, "😀" * 3_000, "word " * 8_000, "x=1;{y}" * 3000])
def test_long_lines_are_cut_between_characters(body):
    spans = chunks(body, False)
    raw = body.encode()
    assert spans[0].start == 0 and spans[-1].stop == len(raw) and all(s.first == s.last == 1 for s in spans)
    for s in spans:
        raw[s.start : s.stop].decode()
    assert len(spans) > 1


def test_chunks_cover_lines_and_keep_sections():
    body = "\n".join(f"line {i} with a few more words in it" for i in range(3000))
    spans = chunks(body, False)
    seen = {n for s in spans for n in range(s.first, s.last + 1)}
    assert seen == set(range(1, 3001)) and len(spans) > 10
    assert all(a.last >= b.first for a, b in zip(spans, spans[1:]))
    assert chunks(" \n\t\n", True) == [] and chunks("", False) == []
    part = ("text " * 600 + "\n").strip()
    md = f"# A\n{part}\n```\n# no heading\n~~~\n# still none\n```\n# B\n{part}\n"
    first, second = chunks(md, True)
    assert md.encode()[second.start :].decode().startswith("# B") and (first.first, second.last) == (1, 9)
    assert [s.first for s in chunks("a\rb", False)] == [1]


def test_locate_and_snippet(spark):
    df = files(spark, ("a.txt", "first line\nno\n" + "filler words here\n" * 400 + "needle needle\n"), ("b.md", "only needle"), ("c.md", "top\nx"))
    hits = spark.createDataFrame([("a.txt",), ("b.md",), ("c.md",), ("gone",)], "path string")
    rows = {r["path"]: r for r in snippets(locate_spans(hits, df, ["needle"]), df).collect()}
    assert "needle needle" in rows["a.txt"]["snippet"] and rows["b.md"]["snippet"] == "only needle"
    assert (rows["c.md"]["byte_start"], rows["c.md"]["byte_end"], rows["c.md"]["snippet"]) == (0, 3, "top")
    assert (rows["gone"]["byte_end"], rows["gone"]["snippet"]) == (0, "")


def test_json_forms(spark):
    hits = render.matches_as_hits(grep(files(spark, ("a/b.ts", "say foo")), "foo"))
    assert render.jsonl(hits).first()["line"] == '{"path":"a/b.ts","span":{"byte_start":4,"byte_end":7,"line_start":1,"line_end":1},"language":"typescript","snippet":"say foo","score":1.0}'
    assert '"snippet"' not in render.jsonl(hits, snippet=False).first()["line"]
    line = render.json(hits, base="root").first()["line"]
    assert line.startswith('{"file":"root/a/b.ts"') and '"lang":"TypeScript","symbol":null' in line and '"lex_rank":null' in line and line.endswith('"model":"none"}')
    ranked = hits.withColumns({"lex_rank": F.lit(None).cast("int"), "vec_rank": F.lit(2)})
    assert '"signals":{"lex_rank":null,"vec_rank":2,"rrf_score":1.0}' in render.jsonl(ranked).first()["line"]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_token_stats_count_paths_once(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lexical_module, "BROADCAST_PATHS", broadcast)
    df = files(spark, ("a/one.md", "One two two"), ("b.md", "two a"), ("b.md", "two three B"), ("b.md", None), ("c", ""), ("d", None), (None, "two four"))
    want = postings(df).groupBy("token").agg(F.count("*"), F.count_distinct("path"), F.sum("at"))
    stats = token_stats(df)
    assert stats.columns == ["token", "n", "docs", "places"] and [t for _, t in stats.dtypes] == [t for _, t in want.dtypes]
    rows = {tuple(r) for r in stats.collect()}
    assert rows == {tuple(r) for r in want.collect()}
    assert {r[0]: r[2] for r in rows} == {"a": 2, "one": 1, "two": 2, "three": 1, "b": 1, "md": 2, "c": 1, "d": 1, "four": 0}


def test_token_stats_exchange_no_path(spark):
    """What is exchanged does not grow with a token's documents, but with the tasks that hold it."""
    df = spark.range(0, 2000, 1, 2).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.lit("the same few words").alias("content"))
    plan = token_stats(df.select("path", "content"))._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "path" in x]


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "path string, content string")
    assert grep(df, "x").count() == 0 and chunk_documents(df).count() == 0
    assert bm25(from_texts(df, [["x"]]), [["x"]], limit=5).count() == 0


def test_embedder(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "")], "path string, text string")
    rows = {r["path"]: r["vec"] for r in embed(df, HashEmbedder(16)).collect()}
    assert rows["b"] is None and sum(x * x for x in rows["a"]) == pytest.approx(1, abs=1e-6) and set(rows["c"]) == {0.0}


def test_workers_hold_bounded_runs(spark):
    class Told:
        """Its vectors say how many texts and characters it was given at a time."""

        def embed_documents(self, texts):
            return [[float(len(texts)), float(sum(map(len, texts)))]] * len(texts)

    texts = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("word "), F.when(F.col("id") == 1500, 600_000).otherwise(400))).alias("text"))
    rows = {int(r["path"]): r["vec"] for r in embed(texts, Told()).collect()}
    assert sorted(rows) == list(range(3000)) and rows[0] is None
    assert rows.pop(1500) == [1.0, 3_000_000.0]  # longer than a run: alone
    assert max(v[0] for v in rows.values() if v) <= batches.ROWS and max(v[1] for v in rows.values() if v) <= batches.BYTES


def test_runs_keep_all_rows_in_order():
    texts = [None, "", "x" * batches.BYTES, "é" * batches.BYTES, *map(str, range(2 * batches.ROWS)), None]
    whole = pa.RecordBatch.from_pydict({"text": texts})
    cut = list(batches.runs(iter([whole, whole.slice(0, 0), whole.slice(3)]), "text"))
    assert [t for b in cut for t in b.column(0).to_pylist()] == [*texts, *texts[3:]]
    assert all(b.num_rows <= batches.ROWS and (b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(0).to_pylist()) <= batches.BYTES) for b in cut)
