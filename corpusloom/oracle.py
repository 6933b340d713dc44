"""DuckDB SQL for the search engine's queries, over the same tables."""

from __future__ import annotations

CORPUS = "corpus AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, text AS content FROM documents)"
PAGES = "corpus AS (SELECT 'pages/' || page_id || '.html' AS path, html AS content FROM pages)"
LINES = r"""
cut AS (SELECT path, string_split_regex(content, '[\n\r]') AS ls FROM corpus WHERE content <> ''),
every_line AS (SELECT path, len(ls) AS n, generate_subscripts(ls, 1) AS line, unnest(ls) AS text FROM cut),
numbered AS (SELECT * FROM every_line WHERE NOT (line = n AND text = '')),
lines AS (SELECT path, line, text, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM numbered)"""
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
IN_SCOPE = "(path = 'src1' OR starts_with(path, 'src1/'))"


def _matches(pattern: str, scope: str = "TRUE", corpus: str = CORPUS) -> str:
    """CTEs that end in matches(path, line, byte_start, byte_end, text)."""
    return f"""WITH {corpus}, {LINES},
hits AS (SELECT path, line, text, base, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms FROM lines WHERE regexp_matches(text, '{pattern}') AND {scope}),
each AS (SELECT *, unnest(generate_series(1, len(ms))) AS k FROM hits),
placed AS (SELECT *, base + list_sum(list_transform(gaps[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: strlen(x))), 0) AS pos FROM each),
matches AS (SELECT path, line, pos::BIGINT AS byte_start, (pos + strlen(ms[k]))::BIGINT AS byte_end, text FROM placed)
"""


def _grep(pattern: str, scope: str = "TRUE") -> str:
    return _matches(pattern, scope) + "SELECT * FROM matches"


def _bm25(phrases: list[str], scope: str = "TRUE", limit: int = 20) -> str:
    """CTEs that end in ranked(path, score): each phrase is tokens joined by spaces."""
    distinct = list(dict.fromkeys(phrases))

    def count(side: str, phrase: str) -> str:
        tokens = phrase.split()
        tests = " AND ".join(f"{side}[i + {k}] = '{t}'" for k, t in enumerate(tokens))
        return f"len(list_filter(generate_series(1, len({side})), lambda i: {tests}))"

    weights = ", ".join(f"0.5::DOUBLE * {count('p', x)} + 1.0::DOUBLE * {count('c', x)} AS f{i}" for i, x in enumerate(distinct))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(distinct)))
    terms = " + ".join(
        f"(CASE WHEN ln((docs - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((docs - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) END) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (total / docs)))"
        for i in (distinct.index(x) for x in phrases)
    )
    some = " + ".join(f"f{i}" for i in range(len(distinct)))
    return f"""WITH {CORPUS},
tokens AS (SELECT path, regexp_extract_all(lower(path), '{TOKEN}') AS p, regexp_extract_all(lower(content), '{TOKEN}') AS c FROM corpus),
found AS (SELECT path, len(p) + len(c) AS n, {weights} FROM tokens),
stats AS (SELECT count(*)::DOUBLE AS docs, sum(n)::DOUBLE AS total, {stats} FROM found),
ranked AS (SELECT path, {terms} AS score FROM found, stats WHERE {scope} AND {some} > 0 ORDER BY score DESC, path LIMIT {limit})
"""


def _ranked(phrases: list[str], scope: str = "TRUE") -> str:
    return _bm25(phrases, scope) + "SELECT path, round(score, 6) AS score FROM ranked"


VECTORS = """vectors AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, 0 AS ord, embedding AS vec FROM documents JOIN embeddings ON vec_id = doc_id),
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT path, ord, list_sum(list_transform(list_zip(vec, v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS score FROM vectors, q)"""


def _semantic(threshold: float, topk: int, scope: str = "TRUE") -> str:
    return f"meant AS (SELECT path, ord, score, row_number() OVER (ORDER BY score DESC, path, ord) AS rank FROM scored WHERE score >= {threshold} AND {scope} ORDER BY score DESC, path, ord LIMIT {topk})"


def _meant(threshold: float, topk: int, scope: str = "TRUE") -> str:
    return f"WITH {VECTORS}, {_semantic(threshold, topk, scope)} SELECT path, ord::BIGINT AS ord, round(score, 6) AS score, rank FROM meant"


def _fuse(weight: float) -> str:
    """CTEs from lex(path, rank) and vec(path, rank) to fused."""
    return f"""
l AS (SELECT path, row_number() OVER (ORDER BY min(rank), path) AS lex_rank FROM lex GROUP BY path),
v AS (SELECT path, row_number() OVER (ORDER BY min(rank), path) AS vec_rank FROM vec GROUP BY path),
both_sides AS (SELECT path, lex_rank, vec_rank, coalesce({weight}::DOUBLE / (3 + lex_rank), 0) AS a, coalesce(1.0::DOUBLE / (3 + vec_rank), 0) AS b FROM l FULL JOIN v USING (path)),
fused AS (SELECT path, lex_rank, vec_rank, greatest(a, b) + 0.01::DOUBLE * least(a, b) AS rrf_score FROM both_sides)"""


def _hybrid(phrases: list[str], weight: float, scope: str = "TRUE") -> str:
    return (
        _bm25(phrases, scope, 30).rstrip()
        + f""",
{VECTORS}, {_semantic(0.0, 90, scope)},
lex AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS rank FROM ranked),
vec AS (SELECT path, rank FROM meant), {_fuse(weight)},
best AS (SELECT * FROM fused ORDER BY rrf_score DESC, path LIMIT 10)
SELECT path, round(rrf_score, 6) AS score, lex_rank, vec_rank, CASE WHEN vec_rank IS NULL THEN NULL ELSE 0 END::BIGINT AS ord FROM best"""
    )


SNAPSHOTS = """docs AS (SELECT *, source || '/' || lang || '/' || doc_id || '.md' AS path, doc_id % 10 AS k, CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END AS edited FROM documents),
indexed AS (SELECT path, sha256(text) AS hash, strlen(text) AS size, doc_id AS mtime_ns FROM docs WHERE k <> 2),
walked AS (SELECT path, strlen(edited) AS size, CASE WHEN k IN (1, 3, 4) THEN doc_id + 1 ELSE doc_id END AS mtime_ns, k = 4 AS unreadable, CASE WHEN k <> 4 THEN sha256(edited) END AS hash FROM docs WHERE k <> 0),
classified AS (SELECT coalesce(w.path, i.path) AS path,
  CASE WHEN w.path IS NULL THEN 'removed' WHEN w.size = i.size AND w.mtime_ns = i.mtime_ns THEN 'unchanged' WHEN w.unreadable THEN 'skipped' WHEN w.hash = i.hash THEN 'unchanged' WHEN i.path IS NULL THEN 'added' ELSE 'updated' END AS status,
  coalesce(w.hash = i.hash, FALSE) AND NOT coalesce(w.size = i.size AND w.mtime_ns = i.mtime_ns, FALSE) AS stat_changed
  FROM walked w FULL JOIN indexed i ON w.path = i.path)"""

SPAN = "{'byte_start': byte_start, 'byte_end': byte_end, 'line_start': line, 'line_end': line}"
NO_RANKS = "{'lex_rank': NULL, 'vec_rank': NULL, 'rrf_score': 1.0::DOUBLE}"


def _range_class(*ranges: tuple[int, int]) -> str:
    return "[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _estimates() -> str:
    from corpusloom.functions.text import DENSE, SYMBOL, WIDE

    n = {name: f"length(regexp_replace(text, '{_range_class(*r)}', '', 'g'))" for name, r in (("wide", WIDE), ("dense", DENSE), ("symbol", SYMBOL))}
    marks = r"""CASE WHEN regexp_matches(trim(text), '^(//|#|$)') THEN 0 ELSE
 regexp_matches(text, '[{}]')::INT + (contains(text, ';') AND NOT ends_with(trim(text), '.'))::INT + regexp_matches(trim(text), 'fn |def |function |func ')::INT
 + regexp_matches(text, '->|=>|::')::INT + regexp_matches(trim(text), '^(pub |private |public )')::INT END"""
    return f"""
counted AS (SELECT path, text, {n['wide']} AS wide, {n['dense']} AS dense, {n['symbol']} AS symbol, {marks} AS marks FROM lines),
estimated AS (SELECT path, text, marks, ceil(wide / 1.2::DOUBLE + dense / 2.0::DOUBLE + symbol + (length(text) - wide - dense - symbol) / (CASE WHEN marks > 0 THEN 4.2 ELSE 4.8 END)::DOUBLE)::BIGINT AS tokens FROM counted)"""


EXTENSIONS = "['md', 'RS', 'py', 'tsx', 'h', 'hpp', 'cs', 'yml', 'toml', 'zig', 'x', 'markdown']"
LABELS = "['markdown', 'rust', 'python', 'typescript', 'c', 'cpp', 'csharp', 'yaml', 'toml', 'zig', 'text', 'markdown']"
JSON_LABELS = "['Markdown', 'Rust', 'Python', 'TypeScript', 'C', 'Cpp', 'CSharp', 'Yaml', 'Toml', 'Zig', 'Text', 'Markdown']"

SQL = {
    "grep_basic": _grep("stupid"),
    "grep_ignore_case": _grep("(?i)licensed under"),
    "grep_word": _grep(r"\bscum\b"),
    "grep_fixed": _grep(r"4\.0\."),
    "grep_spans": _grep("[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"),
    "grep_context": _matches("Apache License")
    + """SELECT m.path, m.line,
 coalesce((SELECT string_agg(l.line || ':' || l.text, chr(10) ORDER BY l.line) FROM lines l WHERE l.path = m.path AND l.line BETWEEN m.line - 2 AND m.line - 1), '') AS before,
 coalesce((SELECT string_agg(l.line || ':' || l.text, chr(10) ORDER BY l.line) FROM lines l WHERE l.path = m.path AND l.line BETWEEN m.line + 1 AND m.line + 2), '') AS after FROM matches m""",
    "grep_files_only": _matches("idiot") + "SELECT path, min(line) AS line FROM matches GROUP BY path",
    "grep_limit": _matches("trash") + "SELECT * FROM matches ORDER BY path, line, byte_start LIMIT 25",
    "grep_scope": _grep("clown", IN_SCOPE),
    "grep_pages": _matches("<h[1-6]", corpus=PAGES) + "SELECT path, count(*) AS n, sum(byte_start)::BIGINT AS starts FROM matches GROUP BY path",
    "line_split": f"WITH {CORPUS}, {LINES} SELECT path, count(*) AS n_lines, sum(strlen(text))::BIGINT AS bytes, max(length(text)) AS longest FROM lines GROUP BY path",
    "language_label": f"SELECT doc_id || '.' || {EXTENSIONS}[doc_id % 12 + 1] AS path, {LABELS}[doc_id % 12 + 1] AS language, {JSON_LABELS}[doc_id % 12 + 1] AS json_language FROM documents",
    "token_estimate": f"WITH {CORPUS}, {LINES}, {_estimates()} SELECT path, sum(tokens)::BIGINT AS tokens, sum(greatest(tokens, ceil(length(text) / 2.5::DOUBLE)::BIGINT))::BIGINT AS dense FROM estimated WHERE text <> '' GROUP BY path",
    "code_indicators": f"WITH {PAGES}, {LINES}, {_estimates()} SELECT path, sum(marks)::BIGINT AS marks FROM estimated GROUP BY path",
    "tokenize": rf"WITH words AS (SELECT unnest(string_split_regex(text, '[^\p{{L}}\p{{Nl}}\p{{M}}\p{{N}}]+')) AS w FROM documents) SELECT lower(w) AS word, count(*) AS n FROM words WHERE w <> '' GROUP BY lower(w)",
    "postings_stats": f"""WITH {CORPUS}, fields AS (SELECT path, regexp_extract_all(lower(path), '{TOKEN}') AS t FROM corpus UNION ALL SELECT path, regexp_extract_all(lower(content), '{TOKEN}') FROM corpus),
each AS (SELECT path, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM fields) SELECT token, count(*) AS n, count(DISTINCT path) AS docs, sum(pos)::BIGINT AS places FROM each GROUP BY token""",
    "bm25_tokens": _ranked(["the", "rest", "with", "hatha", "tion"]),
    "bm25_phrase": _ranked(["licensed under the", "licensed", "under", "mit license", "license"]),
    "bm25_indexed": _ranked(["licensed under the", "licensed", "under", "mit license", "license"]),
    "bm25_path_weight": _ranked(["fr", "src3"]),
    "bm25_dup_token": _ranked(["scum", "scum", "idiot"]),
    "bm25_scope": _ranked(["idiot", "the"], IN_SCOPE),
    "lexical_threshold": _bm25(["idiot", "moron", "trash"], limit=30) + ", shares AS (SELECT path, score / max(score) OVER () AS s, row_number() OVER (ORDER BY score DESC, path) AS rank FROM ranked) SELECT path, round(s, 6) AS score, rank FROM shares WHERE s >= 0.5",
    "semantic_topk": _meant(-1.0, 10),
    "semantic_threshold": _meant(0.15, 100),
    "semantic_scope": _meant(-1.0, 10, IN_SCOPE),
    "l2_normalize": """WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3)::FLOAT::DOUBLE) AS v FROM embeddings),
unit AS (SELECT vec_id, list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE) AS u FROM scaled)
SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 5) AS norm2, round(u[1], 5) AS first FROM unit""",
    "hybrid_terms": _hybrid(["mit license", "license", "apache"], 1.05),
    "hybrid_query_only": _hybrid(["idiot", "trash"], 0.15),
    "hybrid_scope": _hybrid(["idiot", "trash"], 0.15, IN_SCOPE),
    "fuse_ranks": f"""WITH d AS (SELECT doc_id, n_chars, lang, 'd' || doc_id AS path FROM documents),
lex AS (SELECT path, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM d QUALIFY rank <= 1000),
vec AS (SELECT path, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM d WHERE lang <> 'en' QUALIFY rank <= 1000), {_fuse(1.05)}
SELECT path, lex_rank, vec_rank, round(rrf_score, 6) AS rrf_score FROM fused""",
    "index_diff": f"WITH {SNAPSHOTS} SELECT * FROM classified",
    "index_report": f"WITH {SNAPSHOTS} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'skipped') AS skipped FROM classified",
    "index_removed": f"WITH {SNAPSHOTS} SELECT path FROM indexed WHERE path NOT IN (SELECT path FROM walked)",
    "stale_count": f"WITH {SNAPSHOTS} SELECT count(*) FILTER (NOT coalesce(w.size = i.size AND w.mtime_ns = i.mtime_ns, FALSE)) AS stale FROM walked w FULL JOIN indexed i ON w.path = i.path",
    "index_stats": f"WITH {SNAPSHOTS} SELECT (SELECT count(*) FROM indexed) AS files, (SELECT coalesce(sum(size), 0) FROM indexed)::BIGINT AS source_bytes, count(*) AS chunks, count(embedding) AS embedded_chunks FROM documents JOIN embeddings ON vec_id = doc_id",
    "apply_update": f"""WITH {SNAPSHOTS} SELECT i.path, i.hash, i.size, i.mtime_ns FROM indexed i JOIN classified c USING (path) WHERE c.status NOT IN ('updated', 'removed') AND NOT c.stat_changed
UNION ALL SELECT w.path, w.hash, w.size, w.mtime_ns FROM walked w JOIN classified c USING (path) WHERE c.status IN ('added', 'updated') OR c.stat_changed""",
    "jsonl_hits": _matches("MIT License") + f"SELECT path, to_json({{'path': path, 'span': {SPAN}, 'language': 'markdown', 'snippet': text, 'score': 1.0::DOUBLE}})::VARCHAR AS line FROM matches",
    "json_hits": _matches("MIT License")
    + f"SELECT path, to_json({{'file': path, 'span': {SPAN}, 'lang': 'Markdown', 'symbol': NULL, 'score': 1.0::DOUBLE, 'signals': {NO_RANKS}, 'preview': text, 'model': 'none'}})::VARCHAR AS line FROM matches",
    "text_hits": _matches("MIT License") + "SELECT path, '[1.000] ' || path || ':' || line || ':' || rtrim(text) AS line FROM matches",
    "match_blocks": _matches("MIT License")
    + """SELECT m.path, m.line, m.path || ':' || m.line || ':' || (SELECT string_agg(l.text, chr(10) ORDER BY l.line) FROM lines l WHERE l.path = m.path AND l.line BETWEEN m.line - 1 AND m.line + 1) AS block FROM matches m""",
    "multi_path_union": _matches("idiot")
    + """, a AS (SELECT *, 0::BIGINT AS argument FROM matches WHERE starts_with(path, 'src1/') ORDER BY path, line, byte_start LIMIT 5),
b AS (SELECT *, 1::BIGINT AS argument FROM matches WHERE starts_with(path, 'src1/en/') ORDER BY path, line, byte_start LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b""",
    "byte_slices": rf"WITH {CORPUS} SELECT path, TRUE AS whole, regexp_replace(string_split_regex(content, '\r?\n')[1], '\s+$', '') AS preview FROM corpus",
}
