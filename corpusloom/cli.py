"""Command line: corpusloom PATTERN [PATH ...]; exit code 0 with results, 1 without, 2 on errors."""

from __future__ import annotations

import argparse
import json
import os
import sys
import warnings

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.models import DEFAULT, OFFLINE, resolve
from corpusloom.functions.paths import in_scope
from corpusloom.operators import render
from corpusloom.operators.chunking import locate_spans, snippets
from corpusloom.operators.grep import grep
from corpusloom.operators.hybrid import hybrid
from corpusloom.operators.lexical import Query, from_index, lexical, phrases, span_words
from corpusloom.operators.semantic import Embedder, HashEmbedder, semantic
from corpusloom.plans import snapshot
from corpusloom.plans.index import Index, add_file, clean, update
from corpusloom.sources.files import WalkOptions, ensure_ignore_file, index_root, scope_of, walked

FOUND, NOTHING, ERROR = 0, 1, 2


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description="Search a folder of text: regular expressions, BM25, vectors, or the last two fused.")
    p.add_argument("pattern", nargs="?")
    p.add_argument("paths", nargs="*")
    mode = p.add_mutually_exclusive_group()
    for name in ("sem", "lex", "hybrid", "regex"):
        mode.add_argument(f"--{name}", dest="mode", action="store_const", const=name)
    p.add_argument("--term", action="append", default=[], dest="terms")
    p.add_argument("--topk", "--limit", type=int, dest="topk")
    p.add_argument("--threshold", type=float)
    p.add_argument("--scores", action="store_true")
    p.add_argument("-n", "--line-number", action="store_true")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-w", "--word-regexp", action="store_true")
    p.add_argument("-F", "--fixed-strings", action="store_true")
    p.add_argument("-l", "--files-with-matches", action="store_true")
    p.add_argument("-C", "--context", type=int, default=0)
    p.add_argument("-r", "--recursive", action="store_true", help="accepted; folders are always searched whole")
    form = p.add_mutually_exclusive_group()
    form.add_argument("--json", dest="form", action="store_const", const="json")
    form.add_argument("--jsonl", dest="form", action="store_const", const="jsonl")
    p.add_argument("--no-snippet", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--hidden", action="store_true")
    p.add_argument("--no-ignore", action="store_true")
    p.add_argument("--no-loomignore", action="store_true")
    command = p.add_mutually_exclusive_group()
    for name in ("index", "clean", "clean-orphans", "status", "status-verbose", "status-json"):
        command.add_argument(f"--{name}", dest="command", action="store_const", const=name)
    command.add_argument("--add", metavar="FILE")
    p.add_argument("--model")
    return p


def _embedder(alias: str) -> Embedder:
    """The embedder of a model; without weights at hand only the offline one can be loaded."""
    if alias != OFFLINE.alias:
        raise LookupError(f"no weights for {alias} here; pass --model {OFFLINE.alias} or use the Python interface with an Embedder of your own")
    return HashEmbedder(OFFLINE.dims, OFFLINE.threshold)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, embedder: Embedder | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    try:
        return _run(args, spark, embedder)
    except Exception as error:  # noqa: BLE001 what a command line does with errors
        print(f"error: {error}", file=sys.stderr)
        return ERROR


def _run(args, spark: SparkSession, embedder: Embedder | None) -> int:
    options = WalkOptions(args.hidden, args.no_ignore, args.no_loomignore)
    if args.command or args.add:
        targets = ([args.pattern] if args.pattern else []) + args.paths or ["."]
        return max(_command(args, spark, embedder, options, t) for t in targets)
    if args.pattern is None:
        raise ValueError("no pattern")
    mode = args.mode or "regex"
    ranked_only = [n for n, v in (("--term", args.terms), ("--threshold", args.threshold), ("--scores", args.scores)) if v]
    regex_only = [n for n, v in (("-i", args.ignore_case), ("-w", args.word_regexp), ("-F", args.fixed_strings), ("-C", args.context)) if v]
    for flag in ranked_only if mode == "regex" else regex_only:
        warnings.warn(f"{flag} has no effect in {mode} mode", stacklevel=1)
    paths = args.paths or ["."]
    shown = unread = 0
    for path in paths:
        names = len(paths) > 1 or os.path.isdir(path)
        if mode == "regex":
            lines, errors = _regex(args, spark, path, options, names)
            unread += errors
        else:
            lines = _ranked(args, spark, embedder, path, options, names, mode)
        for line in lines:
            print(line)
            shown += 1
    if unread:
        print(f"warning: {unread} files cannot be read", file=sys.stderr)
    if not shown and not args.quiet:
        print("No matches found", file=sys.stderr)
    return FOUND if shown else ERROR if unread else NOTHING


def _regex(args, spark: SparkSession, path: str, options: WalkOptions, names: bool) -> tuple[list[str], int]:
    """The lines to print, and how many files in scope could not be read: without a match that is an error."""
    root = path if os.path.isdir(path) else os.path.dirname(os.path.abspath(path))
    corpus = walked(spark, root, options)
    scope = scope_of(root, path)
    unread = corpus.filter(F.col("unreadable") & in_scope(F.col("path"), scope)).count()
    found = grep(corpus, args.pattern, fixed=args.fixed_strings, word=args.word_regexp, ignore_case=args.ignore_case, context=args.context, files_only=args.files_with_matches, limit=args.topk, scope=scope).orderBy("path", "line", "byte_start")
    base = "" if root == "." else root
    if args.form:
        hits = render.matches_as_hits(found).orderBy("path", "line", "byte_start")
        out = render.jsonl(hits, not args.no_snippet, base) if args.form == "jsonl" else render.json(hits, base)
        return [r["line"] for r in out.collect()], unread
    if args.files_with_matches:
        return [os.path.join(base, r["path"]) for r in found.select("path").collect()], unread
    return [r["block"] for r in render.match_text(found, line_numbers=args.line_number, filenames=names, base=base).collect()], unread


def _ranked(args, spark: SparkSession, embedder: Embedder | None, path: str, options: WalkOptions, names: bool, mode: str) -> list[str]:
    root = index_root(path)
    if root is None or (index := Index.open(spark, root)) is None:
        raise LookupError(f"no index at or above {path}; run --index first")
    query = Query(args.pattern, tuple(args.terms), args.topk if args.topk is not None else 10, args.threshold, scope_of(root, path))
    listed = walked(spark, root, options, index.table("files"))
    if not args.quiet and (stale := snapshot.stale_count(listed, index.table("files")).first()["stale"]):
        print(f"warning: {stale} files changed since the index was built", file=sys.stderr)
    corpus = walked(spark, root, options).select("path", "content")
    docs = from_index(index.table("postings"), index.totals(), phrases(query))
    spans = index.table("chunks").select("path", "ord", "byte_start", "byte_end", "line_start", "line_end")
    if mode == "lex":
        hits = locate_spans(lexical(docs, query), corpus, span_words(query))
    else:
        model = resolve(args.model or index.meta["model_repo"])
        index.check(model)
        if index.table("files").filter(in_scope(F.col("path"), query.scope)).isEmpty():
            return []  # nothing to compare the query with
        embedder = embedder or _embedder(model.alias)
        vector = embedder.embed_query(model.query_prefix + query.text)
        least = query.threshold if query.threshold is not None else model.threshold
        if mode == "sem":
            hits = semantic(index.vectors(), vector, topk=query.topk, threshold=least, scope=query.scope).join(spans, ["path", "ord"])
        else:
            fused = hybrid(docs, index.vectors(), query, vector, threshold=model.threshold)
            located = locate_spans(fused.filter("ord is null").drop("ord"), corpus, span_words(query))
            hits = fused.filter("ord is not null").join(spans, ["path", "ord"]).drop("ord").unionByName(located)
    hits = snippets(hits, corpus).orderBy(F.desc("score"), "path")
    base = "" if root == os.path.abspath(".") else root
    if args.form == "jsonl":
        out = render.jsonl(hits, not args.no_snippet, base)
    elif args.form == "json":
        out = render.json(hits, base)
    else:
        out = render.text(hits, scores=args.scores, line_numbers=args.line_number, filenames=names, base=base)
    rows = out.collect()  # at most topk
    if args.files_with_matches:
        rows = list({r["path"]: r for r in reversed(rows)}.values())[::-1]
        return [os.path.join(base, r["path"]) for r in rows] if not args.form else [r["line"] for r in rows]
    return [r["line"] for r in rows]


def _command(args, spark: SparkSession, embedder: Embedder | None, options: WalkOptions, target: str) -> int:
    root = os.path.abspath(target)
    if args.add:
        path = os.path.abspath(args.add)
        root = index_root(path) or os.path.dirname(path)
        index = Index.open(spark, root)
        alias = args.model or (index.meta["model_alias"] if index else DEFAULT)
        if index is not None:
            index.check(resolve(alias))
        add_file(spark, root, walked(spark, root, options), scope_of(root, path) or "", embedder or _embedder(resolve(alias).alias))
        return FOUND
    if args.command == "clean":
        clean(spark, root)
        return FOUND
    index = Index.open(spark, root)
    if args.command == "clean-orphans" and index is None:
        return FOUND
    if args.command in ("index", "clean-orphans"):
        ensure_ignore_file(root, options)
        alias = resolve(args.model or (index.meta["model_alias"] if index else DEFAULT)).alias
        known = index.table("files") if index and index.meta["model_alias"] == alias else None
        done = update(spark, root, walked(spark, root, options, known), embedder or _embedder(alias), alias)
        if not args.quiet:
            print(snapshot.summary(done["added"], done["updated"], done["removed"], done["unchanged"], done["skipped"], done["chunks_embedded"]), file=sys.stderr)
        return FOUND
    empty = {"path": root, "index_exists": False, "total_files": 0, "total_chunks": 0, "embedded_chunks": 0, "total_size_bytes": 0, "index_size_bytes": 0, "model": None}
    told = index.status() if index else empty
    if args.command == "status-json":
        print(json.dumps(told, indent=2))
    elif index is None:
        print(f"No index found at {root}", file=sys.stderr)
    else:
        print(f"Files indexed: {told['total_files']}\n  Total chunks: {told['total_chunks']}\n  Embedded chunks: {told['embedded_chunks']}\n  Model: {told['model']['name']} ({told['model']['alias']}, {told['model']['dimensions']} dims)", file=sys.stderr)
        if args.command == "status-verbose":
            print(f"  Source size: {told['total_size_bytes'] / 2**20:.1f} MB\n  Index size: {told['index_size_bytes'] / 2**20:.1f} MB", file=sys.stderr)
    return FOUND


if __name__ == "__main__":
    sys.exit(main())
