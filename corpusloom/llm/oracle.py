"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from corpusloom.llm import licenses, pii, quality

WORD = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs),
windows AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM split WHERE len(w) > 2),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM windows),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS place FROM grams SEMI JOIN twice USING (doc_id, g)),
repeated AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
judged AS (SELECT doc_id, text, w, lines, coalesce(n, 0) AS n_repeat,
  list_filter(lines, lambda x: len(string_split_regex(x, '{quality.SEPARATORS}')) - 1 >= {quality.MIN_NAV_ITEMS}
    OR len(regexp_extract_all(x, '{quality.NOISE}')) > {quality.MAX_NOISE}
    OR (NOT regexp_matches(x, '{quality.SENTENCE_END}') AND len(string_split_regex(x, '[\x20\x09-\x0D]+')) >= {quality.LONG_LINE_WORDS})
    OR regexp_matches(x, '{quality.BOILERPLATE}')) AS bad
  FROM split LEFT JOIN repeated USING (doc_id)),
measured AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat AS n_repeat_words, len(lines) AS n_lines, len(bad) AS n_bad_lines,
  coalesce(length(list_aggregate(lines, 'string_agg', '')), 0) AS chars, coalesce(length(list_aggregate(bad, 'string_agg', '')), 0) AS lost_chars,
  sha256(coalesce(array_to_string(list_filter(lines, lambda x: NOT list_contains(bad, x)), chr(10)), '')) AS cleaned_sha256 FROM judged)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= {quality.MAX_LOST_SHARE}::DOUBLE * chars AS kept,
  n_lines::BIGINT AS n_lines, n_bad_lines::BIGINT AS n_bad_lines, chars::BIGINT AS chars, lost_chars::BIGINT AS lost_chars, cleaned_sha256 FROM measured
"""

_LUHN = """list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(d), i, 1)::INT
 ELSE CASE WHEN substr(reverse(d), i, 1)::INT > 4 THEN substr(reverse(d), i, 1)::INT * 2 - 9 ELSE substr(reverse(d), i, 1)::INT * 2 END END)) % 10 = 0"""
# letters of an IBAN count as 10 to 35, marked by 100 more; the remainder is taken sign by sign
_WRONG = " OR ".join(f"(substr(m, 1, 2) IN ({', '.join(repr(c) for c in codes.split())}) AND length(replace(m, ' ', '')) <> {n})" for n, codes in pii.IBAN_LENGTHS.items())
_MOD97 = f"NOT ({_WRONG}) AND NOT regexp_matches(substr(text, pos + length(m) + 1, 1), '[A-Z0-9]') AND " + """length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: c <> ''),
 lambda c: (CASE WHEN ascii(c) >= 65 THEN 100 + ascii(c) - 55 ELSE ascii(c) - 48 END)::BIGINT)), lambda a, x: CASE WHEN x >= 100 THEN (a * 100 + x - 100) % 97 ELSE (a * 10 + x) % 97 END) = 1"""
_NEAR = f"lower(substr(text, greatest(pos + 1 - {pii.CONTEXT_CHARS}, 1), pos + length(m) + 1 + {pii.CONTEXT_CHARS} - greatest(pos + 1 - {pii.CONTEXT_CHARS}, 1)))"

_KINDS = {
    "email": (1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": (2, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE ('0' || ltrim(x, '0'))::INT END)) <= 255"),
    "card": (3, r"[0-9](?:[\x20-]?[0-9])+", f"length(d) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (4, r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    "iban": (5, pii.IBAN, _MOD97),
    "ssn": (6, pii.SSN, f"regexp_matches({_NEAR}, 'ssn|social security|tax')"),
}
_BASE = [k for k, (n, _, _) in _KINDS.items() if n <= 4]


def _spans(kind: str) -> str:
    number, pattern, test = _KINDS[kind]
    own = next(k for k in pii.KINDS if k.name == kind)
    return f"""
k{number} AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM docs WHERE regexp_matches(text, '{pattern}')),
e{number} AS (SELECT *, unnest(generate_series(1, len(ms))) AS k FROM k{number}),
s{number} AS (SELECT doc_id, text, {number} AS ord, '{kind}' AS kind, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS pos, ms[k] AS m, regexp_replace(ms[k], '[^0-9]', '', 'g') AS d FROM e{number}),
f{number} AS (SELECT doc_id, ord, kind, pos, pos + length(m) AS stop, least(100, {round(100 * own.score)} + CASE WHEN regexp_matches({_NEAR}, '{own.context}') THEN {round(100 * pii.CONTEXT_GAIN)} ELSE 0 END) AS score FROM s{number} WHERE {test})"""


_PII = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(map(_spans, _KINDS))},
found AS ({" UNION ALL ".join(f"SELECT * FROM f{n}" for n, _, _ in _KINDS.values())}),
told AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)}, string_agg(kind || ':' || pos || ':' || stop, ',' ORDER BY ord, pos) AS spans,
  string_agg(kind || ':' || pos || ':' || stop, ',' ORDER BY ord, pos) FILTER (ord <= 4) AS base,
  string_agg(score::VARCHAR, ',' ORDER BY ord, pos) AS scores FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM docs LEFT JOIN told USING (doc_id)
"""

_DECONTAMINATION = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT item_id, least(13, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i, w FROM items WHERE len(w) > 0),
sought AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM item_windows),
sizes AS (SELECT DISTINCT n FROM sought),
places AS (SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM low, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places),
met AS (SELECT doc_id, item_id, n, i FROM grams JOIN sought USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM met) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


def _licences() -> str:
    """The fitted table as constants: the same scores, line by line."""
    families, weights, biases, temperature = licenses.model()
    n = len(families)
    rows = ", ".join(f"('{g}', {w})" for g, w in weights.items())
    known = ", ".join(f"('{g}', {[families.index(f) + 1 for f in fs]})" for g, fs in licenses.shingle_owners().items())
    grams = lambda k: f"list_distinct(list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))"
    return f"""
WITH weights(g, v) AS (VALUES {rows}), known(g, owners) AS (VALUES {known}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM lines WHERE regexp_matches(line, '{WORD}')),
shingles AS (SELECT id, unnest({grams(3)}) AS g FROM numbered WHERE len(w) >= 3),
hinted AS (SELECT * FROM numbered SEMI JOIN (SELECT id FROM shingles SEMI JOIN known USING (g)) USING (id)),
all_grams AS (SELECT id, unnest(list_concat({grams(1)}, {grams(2)}, {grams(3)})) AS g FROM hinted),
sums AS (SELECT id, count(*) AS n, {", ".join(f"coalesce(sum(v[{i + 1}]), 0) AS s{i}" for i in range(n))} FROM all_grams LEFT JOIN weights USING (g) GROUP BY id),
shared AS (SELECT id, count(*) AS n3, {", ".join(f"count(*) FILTER (list_contains(owners, {i + 1})) AS o{i}" for i in range(n - 1))} FROM shingles LEFT JOIN known USING (g) GROUP BY id),
scored AS (SELECT id, [{", ".join(f"(s{i} / sqrt(n) + {biases[i]}) / {temperature!r}" for i in range(n))}] AS z, [{", ".join(f"o{i}::DOUBLE / n3" for i in range(n - 1))}, 0] AS shares FROM sums JOIN shared USING (id)),
best AS (SELECT id, z, shares, list_position(z, list_max(z)) AS k FROM scored),
sure AS (SELECT id, {families}[k] AS family FROM best WHERE k < {n} AND 1 / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))) >= {licenses.MIN_PROBABILITY} AND shares[k] >= {licenses.MIN_OVERLAP}),
found AS (SELECT doc_id, count(*) AS n_lines, count(family) AS n, coalesce(array_to_string(list_sort(list(DISTINCT family) FILTER (family IS NOT NULL)), ','), '') AS families FROM numbered LEFT JOIN sure USING (id) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_license_lines, (coalesce(n_lines, 0) - coalesce(n, 0))::BIGINT AS n_unknown_lines, coalesce(families, '') AS families FROM documents d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id
"""


def sql() -> dict[str, str]:
    """The SQL of each query that has one."""
    return {"op3_quality": _QUALITY, "op5_licenses": _licences(), "op8_pii": _PII, "op10_decontamination": _DECONTAMINATION}
