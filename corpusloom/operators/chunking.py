"""Splitting documents into spans of about TARGET estimated tokens, and finding the span of a hit.

Packing is a fold over a document's lines, so each document is cut in Python; the table
function takes whole Arrow batches and shuffles nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.batches import runs
from corpusloom.functions.paths import language
from corpusloom.functions.text import DENSE, RATES, SYMBOL, WIDE, byte_slice, first_line, query_words

TARGET, OVERLAP = 1024, 200
#: Goes up whenever equal texts would be cut differently.
VERSION = 2

SCHEMA = "path string, ord int, byte_start long, byte_end long, line_start int, line_end int"

_CLASSES = [re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]") for ranges in (WIDE, DENSE, SYMBOL)]
_MARKS = [re.compile(p) for p in (r"[{}]", r"fn |def |function |func ", r"->|=>|::", r"\A(?:pub |private |public )")]
_FENCE = re.compile(r"(`{3,}|~{3,})")


class Span(NamedTuple):
    start: int
    stop: int
    first: int
    last: int
    tokens: int


def code_marks(line: str) -> int:
    plain = line.strip()
    if not plain or plain.startswith(("//", "#")):
        return 0
    return sum(bool(m.search(plain)) for m in _MARKS) + (";" in plain and not plain.endswith("."))


def estimate(text: str) -> int:
    """Estimated tokens of a text, in single precision."""
    if not text:
        return 0
    wide, dense, symbol = (0, 0, 0) if text.isascii() else (len(c.findall(text)) for c in _CLASSES)
    rows = re.split(r"\r?\n", text)
    n = max(1, len(rows) - (not rows[-1]))
    density = np.float32(sum(map(code_marks, rows))) / np.float32(n)
    rate = np.float32(RATES[0] if density > np.float32(0.3) else RATES[1] if density > np.float32(0.1) else RATES[2])
    rest = np.float32(len(text) - wide - dense - symbol)
    return int(np.ceil(np.float32(wide) / np.float32(1.2) + np.float32(dense) / np.float32(2) + np.float32(symbol) + rest / rate))


def long_estimate(text: str) -> int:
    """The estimate within an over-long line: at least one token for 2.5 characters."""
    return max(estimate(text), int(np.ceil(np.float32(len(text)) / np.float32(2.5))))


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def long_line(line: str) -> Iterator[str]:
    """Pieces of a line over the target, ended after white space if the last quarter has some."""
    at = 0
    while at < len(line):
        # the estimate grows with the prefix: the last length that fits, one character at least
        fit = at + bisect_right(range(1, len(line) - at + 1), TARGET, key=lambda n: long_estimate(line[at : at + n]))  # noqa: B023
        fit = max(fit, at + 1)
        offsets = np.cumsum([0, *(_size(c) for c in line[at:fit])])
        window = at + bisect_left(offsets, offsets[-1] * 3 // 4)
        stops = [i + 1 for i in range(window, fit) if line[i].isspace()]
        stop = stops[-1] if stops else fit
        yield line[at:stop]
        at = stop


def line_spans(text: str) -> list[tuple[Span, str]]:
    """A span for each line that is not blank, several for one over the target."""
    out, at = [], 0
    for number, line in enumerate(re.split(r"[\n\r]", text), 1):
        size = _size(line)
        if line.strip():
            tokens = estimate(line)
            if tokens <= TARGET:
                out.append((Span(at, at + size, number, number, tokens), line))
            else:
                start = at
                for piece in long_line(line):
                    stop = start + _size(piece)
                    out.append((Span(start, stop, number, number, long_estimate(piece)), piece))
                    start = stop
        at += size + 1
    return out


def _merged(spans: list[Span]) -> Span:
    return Span(spans[0].start, spans[-1].stop, spans[0].first, spans[-1].last, sum(s.tokens for s in spans))


def sections(rows: list[tuple[Span, str]]) -> list[Span]:
    """Markdown: a heading outside fences starts a section; sections over the target fall back to lines."""
    groups: list[list[Span]] = []
    fence = ""
    for span, line in rows:
        plain = line.lstrip()
        run = _FENCE.match(plain)
        if run and not fence:
            fence = run[1]
        elif run and run[1][0] == fence[0] and len(run[1]) >= len(fence):
            fence = ""
        if not groups or (not fence and re.match("#[ #]", plain)):
            groups.append([])
        groups[-1].append(span)
    return [s for g in groups for s in (g if sum(x.tokens for x in g) > TARGET else [_merged(g)])]


def chunks(text: str, markdown: bool) -> list[Span]:
    """Spans that cover every line that is not blank; each begins with the end of the one before, up to OVERLAP tokens."""
    rows = line_spans(text)
    units = sections(rows) if markdown else [s for s, _ in rows]
    out: list[Span] = []
    open_: list[Span] = []
    for unit in units:
        if open_ and sum(u.tokens for u in open_) + unit.tokens > TARGET:
            out.append(_merged(open_))
            total = np.cumsum([u.tokens for u in reversed(open_)])
            again = int(np.argmax(total > OVERLAP)) if (total > OVERLAP).any() else len(open_)
            open_ = open_[len(open_) - again :]
        open_.append(unit)
    return [*out, _merged(open_)] if open_ else out


def chunk_documents(corpus: DataFrame) -> DataFrame:
    """path, ord, byte_start, byte_end, line_start, line_end; blank and null contents have no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "content"):
            rows = []
            for path, text, label in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "language")), strict=True):
                rows += [(path, i, s.start, s.stop, s.first, s.last) for i, s in enumerate(chunks(text or "", label == "markdown"))]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "ord", "byte_start", "byte_end", "line_start", "line_end"])

    return corpus.select("path", "content", language(F.col("path")).alias("language")).mapInArrow(run, SCHEMA)


def snippets(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """found (path, byte_start, byte_end, ...) with the text of its span; none where the document is gone."""
    texts = corpus.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    joined = found.join(texts, F.col("path") == F.col("_path"), "left")
    return joined.withColumn("snippet", F.coalesce(byte_slice(F.col("_content"), F.col("byte_start"), F.col("byte_end")), F.lit(""))).drop("_path", "_content")


def locate_spans(hits: DataFrame, corpus: DataFrame, words: list[str]) -> DataFrame:
    """hits (path, ...) with the chunk of each file that holds most of the words, repeats counted.

    Ties go to the earliest chunk. Without a word in any chunk it is the first line's bytes; a
    file that is gone has an empty span. Only the documents of the hits are cut.
    """
    own = corpus.join(hits.select("path").distinct(), "path", "left_semi")
    cut = snippets(chunk_documents(own), own)
    counted = cut.withColumn("n", F.size(F.filter(query_words(F.col("snippet")), lambda w: w.isin(words) if words else F.lit(False))))
    first = Window.partitionBy("path").orderBy(F.desc("n"), "ord")
    best = counted.filter("n > 0").withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "n", "ord", "snippet")
    top = own.select(F.col("path").alias("_path"), F.octet_length(F.regexp_extract("content", r"\A[^\n]*?(?=\r?\n|\r?\z)", 0)).cast("long").alias("_end"))
    joined = hits.join(best, "path", "left").join(top, F.col("path") == F.col("_path"), "left")
    out = joined.withColumns(
        {
            "byte_end": F.coalesce("byte_end", "_end", F.lit(0).cast("long")),
            "byte_start": F.coalesce("byte_start", F.lit(0).cast("long")),
            "line_start": F.coalesce("line_start", F.lit(1)),
            "line_end": F.coalesce("line_end", F.lit(1)),
        }
    )
    return out.drop("_path", "_end")


def preview(snippet):
    """One line of a snippet."""
    return first_line(snippet)
