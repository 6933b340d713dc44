"""Regular-expression search: one row for each match, in order of path and place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import in_scope
from corpusloom.functions.text import line_start, lines

#: Noncharacters that mark a match while its place is computed.
OPEN, CLOSE = "﷐", "﷑"


def pattern(text: str, *, fixed: bool = False, word: bool = False, ignore_case: bool = False) -> str:
    """The Java pattern of the flags. Words are wrapped without a group: a|b becomes \\ba|b\\b."""
    body = re.sub(r"([\\.+*?()|\[\]{}^$#&~-])", r"\\\1", text) if fixed else text
    if word:
        body = rf"\b{body}\b"
    out = f"(?{'iu' if ignore_case else ''}Ud){body}"
    return out


def grep(
    corpus: DataFrame,
    text: str,
    *,
    fixed: bool = False,
    word: bool = False,
    ignore_case: bool = False,
    context: int = 0,
    files_only: bool = False,
    limit: int | None = None,
    scope: str | None = None,
) -> DataFrame:
    """path, line, byte_start, byte_end, text, before, after, score.

    Documents are filtered by scope and by the pattern before any line is cut out; places and
    context come from the row itself, so that only a limit or files_only exchanges rows.
    Null contents match nothing.
    """
    regex = pattern(text, fixed=fixed, word=word, ignore_case=ignore_case)
    docs = corpus.filter(in_scope(F.col("path"), scope)).select("path", "content")
    if not re.search(r"\\[AzZG]|\(\?<?[=!]", text) or fixed:
        # whatever matches in a line matches in the text, where ^ and $ stand at line feeds
        docs = docs.filter(F.col("content").rlike(f"(?m){regex}") | F.contains("content", F.lit("\r")))
    cut = docs.select("path", lines(F.col("content")).alias("lines"))
    numbered = cut.select("path", "lines", F.posexplode("lines").alias("at", "text")).filter(F.col("text").rlike(regex))
    pieces = F.split(F.regexp_replace("text", regex, f"{OPEN}$0{CLOSE}"), OPEN, -1)
    found = numbered.select("path", (F.col("at") + 1).alias("line"), "text", "lines", pieces.alias("pieces"))

    def place(state: Column, piece: Column) -> Column:
        match = F.substring_index(piece, CLOSE, 1)
        start = state["at"]
        stop = start + F.octet_length(match)
        span = F.struct(start.alias("start"), stop.alias("stop"))
        rest = F.octet_length(piece) - F.octet_length(match) - len(CLOSE.encode())
        return F.struct((stop + rest).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    head = F.octet_length(F.get("pieces", F.lit(0)))
    placed = F.aggregate(F.slice("pieces", F.lit(2), F.size("pieces") - 1), F.struct(head.alias("at"), none.alias("spans")), place, lambda s: s["spans"])
    each = found.select("path", "line", "text", "lines", F.explode(placed).alias("span"))

    def near(first: Column, count: Column) -> Column:
        rows = F.transform(F.slice("lines", first, count), lambda t, i: F.struct((first + i).cast("int").alias("line"), t.alias("text")))
        return rows

    start = F.greatest(F.col("line") - context, F.lit(1))
    base = line_start(F.col("lines"), F.col("line"))
    out = each.select(
        "path",
        F.col("line").cast("int").alias("line"),
        (base + F.col("span.start")).alias("byte_start"),
        (base + F.col("span.stop")).alias("byte_end"),
        "text",
        near(start, F.col("line") - start).alias("before"),
        near(F.col("line") + 1, F.least(F.lit(context), F.greatest(F.size("lines") - F.col("line"), F.lit(0)))).alias("after"),
        F.lit(1.0).alias("score"),
    )
    if files_only:
        first = F.min_by(F.struct("line", "byte_start", "byte_end", "text", "before", "after", "score"), F.struct("line", "byte_start"))
        out = out.groupBy("path").agg(first.alias("m")).select("path", "m.*")
    if limit is not None:
        out = out.orderBy("path", "line", "byte_start").limit(limit)
    return out
