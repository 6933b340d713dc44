"""Walking, the index's life, streaming into it, and the command line."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.cli import main
from corpusloom.functions.models import OFFLINE
from corpusloom.operators.semantic import HashEmbedder
from corpusloom.plans import snapshot
from corpusloom.plans.index import FOLDER, Index, SignatureError, add_file, clean, update
from corpusloom.sources.files import WalkOptions, ensure_ignore_file, index_root, listing, looks_binary, scope_of, walked


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return path


def names(root, **options):
    return [p for p, _, _ in listing(str(root), WalkOptions(**options))]


def test_listing_rules(tmp_path):
    for name in ("a.md", "b.log", "sub/c.log", "sub/keep.log", ".hidden/x", ".dot", "_under", "build/out.txt", "sub/build/y"):
        put(tmp_path, name, "x")
    put(tmp_path, ".gitignore", "*.log\n!keep.log\n/build/\n")
    assert names(tmp_path) == ["_under", "a.md", "sub/build/y", "sub/keep.log"]
    assert "b.log" in names(tmp_path, no_ignore=True)
    assert ".hidden/x" in names(tmp_path, hidden=True)
    put(tmp_path, ".loomignore", "a.*\n")
    assert "a.md" not in names(tmp_path) and "a.md" in names(tmp_path, no_own_ignore=True)
    os.symlink(tmp_path / "sub", tmp_path / "link")
    assert not any(p.startswith("link") for p in names(tmp_path))


def test_default_ignore_file(tmp_path):
    assert ensure_ignore_file(str(tmp_path)) and not ensure_ignore_file(str(tmp_path))
    put(tmp_path, "x.json", "{}")
    put(tmp_path, "x.tar.gz", "z")
    put(tmp_path, "x.txt", "z")
    assert names(tmp_path) == ["x.txt"]
    assert not ensure_ignore_file(str(tmp_path / "sub"), WalkOptions(no_own_ignore=True))


def test_binary_probe():
    assert looks_binary(b"a\0b") and looks_binary(b"\xff\xfe text") and not looks_binary("é".encode()) and not looks_binary("日本".encode()[:-1])


def walk(spark, root, **more):
    return walked(spark, str(root), **more)


def test_index_life(spark, tmp_path):
    root, embedder, alias = tmp_path / "corpus", HashEmbedder(), OFFLINE.alias
    put(root, "a.md", "alpha beta")
    put(root, "b.md", "# title\ngamma")
    put(root, "c.bin", bytes(range(256)))
    put(root, "empty.txt", "")
    assert Index.open(spark, str(root)) is None
    first = update(spark, str(root), walk(spark, root), embedder, alias)
    assert (first["added"], first["updated"], first["removed"], first["unchanged"], first["chunks_embedded"]) == (3, 0, 0, 0, 2)
    index = Index.open(spark, str(root))
    known = lambda: Index.open(spark, str(root)).table("files")
    assert index.stats()["files"] == 3 and index.status()["model"]["alias"] == alias
    with pytest.raises(SignatureError):
        from corpusloom.functions.models import resolve

        index.check(resolve("bge-m3-gguf"))
    assert snapshot.stale_count(walk(spark, root, indexed=known()), known()).first()["stale"] == 0

    os.utime(root / "a.md", ns=(1, 1))  # touched only
    put(root, "b.md", "# title\ndelta")
    (root / "empty.txt").unlink()
    put(root, "d.txt", "new")
    assert snapshot.stale_count(walk(spark, root, indexed=known()), known()).first()["stale"] == 4
    second = update(spark, str(root), walk(spark, root, indexed=known()), embedder, alias)
    assert (second["added"], second["updated"], second["removed"], second["unchanged"]) == (1, 1, 1, 1)
    assert {r["path"]: r["mtime_ns"] for r in known().collect()}["a.md"] == 1
    assert sorted(r["token"] for r in Index.open(spark, str(root)).table("postings").filter("path = 'b.md' and field = 'content'").collect()) == ["delta", "title"]

    put(root, "e.txt", "late")
    assert add_file(spark, str(root), walk(spark, root), "e.txt", embedder)["added"] == 1
    with pytest.raises(ValueError):
        add_file(spark, str(root), walk(spark, root), "c.bin", embedder)
    assert index_root(str(root / "a.md")) == str(root) and scope_of(str(root), str(root)) is None
    assert clean(spark, str(root)) and not (root / FOLDER).exists() and (root / "a.md").exists()


def test_two_writers_and_past_snapshots(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root, embedder = tmp_path / "corpus", HashEmbedder()
    put(root, "a.md", "alpha")
    put(root, "b.md", "beta")
    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(update, spark, str(root), walk(spark, root), embedder, OFFLINE.alias) for _ in range(2)]:
            done.result()
    index = Index.open(spark, str(root))
    assert sorted(r["path"] for r in index.table("files").collect()) == ["a.md", "b.md"]
    assert (index.meta["docs"], index.meta["total"]) == (2, 6) and index.totals().first()["total"] == 6
    put(root, "b.md", "gamma")
    update(spark, str(root), walk(spark, root), embedder, OFFLINE.alias)
    assert sorted(r["token"] for r in index.table("postings").filter("field = 'content'").collect()) == ["alpha", "beta"]  # a reader keeps its snapshot
    assert len([f for f in os.listdir(root / FOLDER) if f.startswith("snapshot-")]) == 2 and not any("lock" in f for f in os.listdir(root / FOLDER))


def test_stream(spark, tmp_path):
    from corpusloom.streaming.ingest import ingest

    root = tmp_path / "target"
    root.mkdir()
    schema = "path string, content string"
    spark.createDataFrame([("a", "one"), ("b", "two")], schema).write.parquet(str(tmp_path / "in" / "p1"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    ingest(stream(), str(root), HashEmbedder(), OFFLINE.alias, str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([("b", "three"), ("c", "four")], schema).write.parquet(str(tmp_path / "in" / "p2"))
    ingest(stream(), str(root), HashEmbedder(), OFFLINE.alias, str(tmp_path / "check")).awaitTermination()
    found = Index.open(spark, str(root)).table("postings").filter("field = 'content'").collect()
    assert sorted((r["path"], r["token"]) for r in found) == [("a", "one"), ("b", "three"), ("c", "four")]


def test_unread_files_and_empty_scope(spark, tmp_path, capsys, monkeypatch):
    import corpusloom.cli as cli

    root = tmp_path / "c"
    put(root, "a.md", "quick fox")
    put(root, "sub/b.md", "dog")
    broken = lambda *args: walked(*args).withColumn("unreadable", F.col("path") == "a.md").withColumn("content", F.when(F.col("path") != "a.md", F.col("content")))
    with monkeypatch.context() as m:
        m.setattr(cli, "walked", broken)
        run = lambda *args: main([*map(str, args)], spark)
        assert run("quick", root) == 2 and "1 files cannot be read" in capsys.readouterr().err
        assert run("dog", root) == 0 and run("quick", root / "sub") == 1
    assert run("--index", root, "--model", OFFLINE.alias) == 0
    (root / "late").mkdir()

    class Unused(HashEmbedder):
        def embed_query(self, text):
            raise AssertionError("an empty scope needs no vector")

    assert main(["--sem", "quick", str(root / "late")], spark, Unused()) == 1


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "c"
    put(root, "a.md", "the quick brown fox\njumps")
    put(root, "b.md", "a lazy dog")
    run = lambda *args: main([*map(str, args)], spark)
    assert run("quick", root) == 0 and "the quick brown fox" in capsys.readouterr().out
    assert run("absent", root) == 1
    assert run("--lex", "fox", root) == 2
    capsys.readouterr()
    assert run("--index", root, "--model", OFFLINE.alias) == 0
    assert "2 added" in capsys.readouterr().err
    assert run("--lex", "fox", root, "--jsonl") == 0 and '"snippet":"the quick brown fox' in capsys.readouterr().out
    assert run("--hybrid", "lazy dog", root, "--json") == 0 and '"rrf_score"' in capsys.readouterr().out
    assert run("--sem", "lazy dog", root, "-l") == 0 and capsys.readouterr().out.splitlines()[0].endswith("b.md")
    assert run("--status-json", root) == 0 and '"total_files": 2' in capsys.readouterr().out
    assert run("--clean", root) == 0 and run("--status", root) == 0
    with pytest.raises(SystemExit):
        run("--sem", "--lex", "x", root)
