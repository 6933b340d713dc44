"""BM25 over paths and contents, with phrases, from texts or from a written index."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import in_scope
from corpusloom.functions.text import TOKEN, index_tokens

#: Fixed values of the ranking function: weights of path and content, k1, b, and the least inverse document frequency.
PATH_WEIGHT, CONTENT_WEIGHT, K1, B, LEAST_IDF = 0.5, 1.0, 1.2, 0.75, 1e-6
#: Columns of a written index's postings: named to the reader, it opens no file to ask.
POSTINGS = "token string, path string, field string, at int, n int"
#: Paths of several rows that are broadcast at most; more are met in a shuffled join.
BROADCAST_PATHS = 100_000
#: Words of a term count alone if longer than this.
SHORT_WORD = 3


@dataclass(frozen=True)
class Query:
    """What a ranked search asks for; terms replace the text in its lexical part."""

    text: str
    terms: tuple[str, ...] = ()
    topk: int = 10
    threshold: float | None = None
    scope: str | None = None

    def __post_init__(self):
        if self.threshold is not None and not -1.0 <= self.threshold <= 1.0:
            raise ValueError("a threshold lies between -1.0 and 1.0")


def query_words(text: str) -> list[str]:
    """A query's words in order, repeats included: runs of letters and numbers, in lower case."""
    return [w.lower() for w in regex.findall(r"[\p{Alphabetic}\p{N}]+", text)]


def phrases(query: Query) -> list[list[str]]:
    """The index tokens of each phrase that the query looks for.

    Without terms each word is a phrase. A term is a phrase; of several words, those over
    SHORT_WORD characters count on their own besides.
    """
    if not query.terms:
        sought = query_words(query.text)
    else:
        sought = []
        for term in (regex.sub(r'["\\]', " ", t).strip() for t in query.terms):
            words = term.split()
            if words:
                sought.append(term)
            if len(words) > 1:
                sought += [w for w in words if len(w) > SHORT_WORD]
    tokens = [regex.findall(TOKEN, s.lower()) for s in sought]
    return [t for t in tokens if t]


def span_words(query: Query) -> list[str]:
    """The words by which a hit's span is located."""
    return [w for t in query.terms or (query.text,) for w in query_words(t)]


class Counted(NamedTuple):
    """What scoring needs of a corpus.

    rows: path, n (tokens) and the weighted count of each different phrase, f0, f1, ...; rows
    without any phrase may be missing. totals: one row, docs and total (tokens), of the whole corpus.
    """

    rows: DataFrame
    totals: DataFrame


def _distinct(sought: list[list[str]]) -> list[list[str]]:
    return [list(p) for p in dict.fromkeys(map(tuple, sought))]


def times(text: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in a text in lower case: its tokens side by side.

    Only the first token is consumed, so that occurrences may overlap; it stands first in the
    pattern for the matcher to skip by. Tokens are letters and numbers and need no quoting.
    """
    part, gap = TOKEN[:-1], TOKEN.replace("[", "[^", 1)
    rest = "".join(f"{gap}{t}" for t in phrase[1:])
    pattern = f"{phrase[0]}(?<!{part}{phrase[0]})(?={rest}(?!{part}))"
    return F.when(F.contains(text, F.lit(phrase[0])), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def from_texts(corpus: DataFrame, sought: list[list[str]]) -> Counted:
    """Counts from texts, each tokenised once.

    The exchange holds a few numbers for each document and serves both the totals and the hits;
    the generator above it keeps filters and projections of the two from parting them below (an
    outer one: for others the optimizer would count everything once more to see that it is not empty).
    """
    low = corpus.select("path", F.lower("path").alias("p"), F.lower(F.coalesce("content", F.lit(""))).alias("c"))
    weights = [PATH_WEIGHT * times(F.col("p"), p) + CONTENT_WEIGHT * times(F.col("c"), p) for p in _distinct(sought)]
    count = F.regexp_count("p", F.lit(TOKEN)) + F.regexp_count("c", F.lit(TOKEN))
    numbers = F.struct(count.alias("n"), *(w.alias(f"f{i}") for i, w in enumerate(weights)))
    rows = low.select("path", F.array(numbers).alias("numbers")).repartition("path").select("path", F.inline_outer("numbers"))
    return Counted(rows, rows.agg(F.count("*").alias("docs"), F.sum("n").alias("total")))


def postings(corpus: DataFrame) -> DataFrame:
    """token, path, field, at, n (tokens of the document): the inverted index.

    Written sorted by token, a search reads its tokens' row groups only, and nothing else: the
    document's size is on the row.
    """
    cut = corpus.select("path", index_tokens(F.col("path")).alias("p"), index_tokens(F.coalesce("content", F.lit(""))).alias("c"))
    field = lambda name, tokens: F.struct(F.lit(name).alias("field"), F.col(tokens).alias("tokens"))
    each = cut.select("path", (F.size("p") + F.size("c")).alias("n"), F.explode(F.array(field("path", "p"), field("content", "c"))).alias("f"))
    return each.select("path", "n", "f.field", F.posexplode("f.tokens").alias("at", "token")).select("token", "path", "field", "at", "n")


def token_stats(corpus: DataFrame) -> DataFrame:
    """token, n (postings), docs (distinct paths), places (sum of at): the dictionary of the inverted index.

    A document tells each of its different tokens once, so that a path that no other row has is
    counted without being named: tasks add up by token, and no path is exchanged with one. Rows
    that share a path are counted by distinct paths; which these are is found first, from the
    paths alone.
    """
    again = corpus.groupBy("path").count().filter("count > 1").select("path")
    shared = again.count()
    alone = corpus
    if shared:
        again = F.broadcast(again) if shared <= BROADCAST_PATHS else again
        alone = corpus.join(again, "path", "left_anti")
    cut = alone.select("path", index_tokens(F.col("path")).alias("p"), index_tokens(F.coalesce("content", F.lit(""))).alias("c"))
    kind = lambda posting, tokens: F.struct(F.lit(posting).alias("posting"), tokens.alias("tokens"))
    both = F.array_distinct(F.concat(F.coalesce("p", F.array().cast("array<string>")), "c"))
    each = cut.select("path", F.explode(F.array(kind(True, F.col("p")), kind(True, F.col("c")), kind(False, both))).alias("k"))
    each = each.select("path", "k.posting", F.posexplode("k.tokens").alias("at", "token"))
    told = F.count(F.when(~F.col("posting"), F.col("path")))
    found = each.groupBy("token").agg(F.expr("count_if(posting)").alias("n"), told.alias("docs"), F.expr("coalesce(sum(at) FILTER (WHERE posting), 0L)").alias("places"))
    if not shared:
        return found
    others = postings(corpus.join(again, "path", "left_semi")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("path").alias("docs"), F.sum("at").alias("places"))
    return found.unionByName(others).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "docs", "places")))


def document_sizes(corpus: DataFrame) -> DataFrame:
    """path, n: tokens in path and content."""
    return corpus.select("path", (F.regexp_count(F.lower("path"), F.lit(TOKEN)) + F.regexp_count(F.lower(F.coalesce("content", F.lit(""))), F.lit(TOKEN))).alias("n"))


def totals(sizes: DataFrame) -> DataFrame:
    """One row, docs and total: what an index stores of its documents' sizes."""
    return sizes.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def from_index(index: DataFrame, stored: DataFrame, sought: list[list[str]]) -> Counted:
    """The same counts from a written index and its totals: only postings of the sought tokens are read.

    A token at place a that is the phrase's k-th speaks for an occurrence that begins at a - k;
    an occurrence is whole if all its tokens speak for it. Exchanged once, by document.
    """
    distinct = _distinct(sought)
    roles: dict[str, list[tuple[int, int]]] = {}
    for i, phrase in enumerate(distinct):
        for k, token in enumerate(phrase):
            roles.setdefault(token, []).append((i, k))
    role = lambda i, k: F.struct(F.lit(i).alias("phrase"), F.lit(len(distinct[i])).alias("whole"), (F.col("at") - k).alias("begin"))
    mine = F.coalesce(*(F.when(F.col("token") == t, F.array(*(role(i, k) for i, k in places))) for t, places in roles.items()))
    voices = index.filter(F.col("token").isin(*roles)).select("path", "n", "field", F.inline_outer(mine)).repartition("path")
    begun = voices.groupBy("path", "n", "field", "phrase", "whole", "begin").agg(F.count("*").alias("spoken")).filter("spoken = whole")
    weight = F.when(F.col("field") == "path", PATH_WEIGHT).otherwise(CONTENT_WEIGHT)
    counts = [F.sum(F.when(F.col("phrase") == i, weight).otherwise(0.0)).alias(f"f{i}") for i in range(len(distinct))]
    return Counted(begun.groupBy("path", "n").agg(*counts), stored)


def bm25(docs: Counted, sought: list[list[str]], scope: str | None = None, limit: int | None = None) -> DataFrame:
    """path, score, best first; documents without any phrase are out.

    docs comes from from_texts() or from_index() for the same phrases. The statistics are those of
    the whole corpus, a scope only filters rows; they are one row, joined by broadcast. Repeated
    phrases count again.
    """
    if not sought:
        return docs.rows.select("path", F.lit(0.0).alias("score")).limit(0)
    distinct = _distinct(sought)
    found = docs.rows.filter(" OR ".join(f"f{i} > 0" for i in range(len(distinct))))
    met = found.agg(*(F.expr(f"count_if(f{i} > 0) AS n{i}") for i in range(len(distinct))))
    stats = docs.totals.crossJoin(met)  # one row each
    joined = found.filter(in_scope(F.col("path"), scope)).crossJoin(F.broadcast(stats))
    # as text: one call to the session's engine for each query, not dozens for each phrase
    parts = []
    for phrase in sought:
        i = distinct.index(phrase)
        idf = f"ln((docs - n{i} + 0.5D) / (n{i} + 0.5D))"
        parts.append(f"if({idf} <= 0, {LEAST_IDF}D, {idf}) * f{i} * {K1 + 1}D / (f{i} + {K1}D * ({1 - B}D + {B}D * n / (total / docs)))")
    score = F.expr(" + ".join(parts))
    ranked = joined.select("path", score.alias("score"))
    return ranked if limit is None else ranked.orderBy(F.desc("score"), "path").limit(limit)


def lexical(docs: Counted, query: Query) -> DataFrame:
    """path, score in 0..1 and rank: the best hits by BM25, divided by the best score, then cut by the threshold."""
    ranked = bm25(docs, phrases(query), query.scope, query.topk)
    whole = Window.partitionBy().orderBy(F.desc("score"), "path")  # at most topk rows
    best = F.max("score").over(Window.partitionBy())
    out = ranked.select("path", F.when(best > 0, F.col("score") / best).otherwise(F.col("score")).alias("score"), F.row_number().over(whole).alias("rank"))
    return out if query.threshold is None else out.filter(F.col("score") >= query.threshold)
