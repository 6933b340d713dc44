"""Results as JSON lines, JSON or text, one row per result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import displayed, json_language, language
from corpusloom.functions.text import first_line

NULLS = {"ignoreNullFields": "false"}


def _span() -> Column:
    return F.struct(*(F.col(c).cast("long").alias(c) for c in ("byte_start", "byte_end", "line_start", "line_end"))).alias("span")


def _signals(hits: DataFrame) -> Column:
    lex = F.col("lex_rank") if "lex_rank" in hits.columns else F.lit(None)
    vec = F.col("vec_rank") if "vec_rank" in hits.columns else F.lit(None)
    return F.struct(lex.cast("long").alias("lex_rank"), vec.cast("long").alias("vec_rank"), F.col("score").alias("rrf_score")).alias("signals")


def jsonl(hits: DataFrame, snippet: bool = True, base: str = "") -> DataFrame:
    """path and line: keys path, span, language, snippet (unless left out), score, and signals after a fusion.

    Ranks that are null are written as null.
    """
    fields = [displayed(F.col("path"), base).alias("path"), _span(), language(F.col("path")).alias("language")]
    fields += [F.col("snippet")] if snippet else []
    fields += [F.col("score")]
    fields += [_signals(hits)] if "lex_rank" in hits.columns else []
    return hits.select("path", F.to_json(F.struct(*fields), NULLS).alias("line"))


def json(hits: DataFrame, base: str = "") -> DataFrame:
    """path and line: keys file, span, lang, symbol, score, signals, preview, model; the preview always shows."""
    fields = [displayed(F.col("path"), base).alias("file"), _span(), json_language(F.col("path")).alias("lang"), F.lit(None).cast("string").alias("symbol"), F.col("score"), _signals(hits), F.col("snippet").alias("preview"), F.lit("none").alias("model")]
    return hits.select("path", F.to_json(F.struct(*fields), NULLS).alias("line"))


def text(hits: DataFrame, *, scores: bool = False, line_numbers: bool = False, filenames: bool = True, base: str = "") -> DataFrame:
    """path and line: an optional [score], then name, line number and the snippet's first line."""
    score = F.format_string("[%.3f] ", F.col("score").cast("double")) if scores else F.lit("")
    name = displayed(F.col("path"), base)
    number = F.col("line_start").cast("string")
    shown = first_line(F.col("snippet"))
    if line_numbers:
        parts = [score, name, F.lit(":"), number, F.lit(":"), shown] if filenames else [score, number, F.lit(":"), shown]
    else:
        parts = [score, name, F.lit(":\n"), shown] if filenames else [score, shown]
    return hits.select("path", F.concat(*parts).alias("line"))


def matches_as_hits(matches: DataFrame) -> DataFrame:
    """Regex matches in the shape of ranked hits: the span is the match, the snippet its line."""
    return matches.select("path", "byte_start", "byte_end", F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.col("text").alias("snippet"), "score", "line", "before", "after")


def match_text(matches: DataFrame, *, line_numbers: bool = False, filenames: bool = True, base: str = "") -> DataFrame:
    """path, line, block: the context block; the match's number stands before the block's first line."""
    block = F.array_join(F.concat(F.col("before.text"), F.array("text"), F.col("after.text")), "\n")
    name, number = displayed(F.col("path"), base), F.col("line").cast("string")
    if line_numbers:
        parts = [name, F.lit(":"), number, F.lit(":"), block] if filenames else [number, F.lit(":"), block]
    else:
        parts = [name, F.lit(":\n"), block] if filenames else [block]
    return matches.select("path", "line", "byte_start", F.concat(*parts).alias("block"))


def files_only(hits: DataFrame, order: str = "rank") -> DataFrame:
    """Each file once, where it first shows: after the limit of the search."""
    return hits.groupBy("path").agg(F.min(order).alias(order))
