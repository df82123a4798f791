"""SQL that must give the same rows as the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from millrace.llm.chat import CHATML
from millrace.llm.urls import RULES

_BLANK = r"[\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_formatting(control: str) -> str:
    """The machine's verdict needs only each turn's predecessor: a refused turn refuses all that follow."""
    moves = ", ".join(f"('{state}', '{role}')" for state, to in CHATML.moves.items() for role in to)
    escaped = lambda t: rf"length({t}) + len(regexp_extract_all({t}, '<\\*(?:\||\z)'))"
    role = "replace(replace(role, '%', '%25'), chr(10), '%0A')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, * FROM (VALUES (0, 'user', {_quoted(control)}), (1, 'assistant', {_quoted(control)})) v),
    o AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, '{CHATML.first}') AS state FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    b AS (SELECT o.*, m.role IS NULL AS bad FROM o LEFT JOIN (VALUES {moves}) m(state, role) ON o.state = m.state AND o.role = m.role),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS spoken, string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i) AS loss,
        sum({len(CHATML.start) + len(CHATML.role_end) + len(CHATML.end)} + {escaped(role)} + {escaped("text")})::BIGINT AS formatted_chars, min(i) FILTER (bad) AS bad, arg_max(role, i) AS last FROM b GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, bad IS NULL AS valid, bad IS NULL AND last = 'assistant' AS complete, bad::INT AS first_bad_turn FROM g"""


#: Aliases of form only: no page of the tables names another by a canonical link or a refresh.
REDIRECT_EQUIVALENCE = rf"""WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^#]*?\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_\w+|ref|fbclid|gclid|mc_[ce]id|sessionid|sid)(=|$)'))) AS own FROM pages),
    r AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(r)}, {_quoted(v)})" for r, v in RULES)}) v(rule, verdict)),
    f AS (SELECT u.*, (SELECT arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))) AS hit,
        CASE WHEN contains(url, '://') THEN md5(regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www\.|m\.|mobile\.|amp\.)', '') || regexp_replace(regexp_replace(path, '/(index|default)\.(html?|php|aspx?)$', '/'), '(\.html?)?/*$', '') || CASE WHEN len(own) > 0 THEN '?' || array_to_string(own, '&') ELSE '' END) END AS node FROM u),
    d AS (SELECT node, bool_or(hit.verdict = 'allow') AS allow FROM f WHERE hit IS NOT NULL AND node IS NOT NULL GROUP BY node)
    SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN NOT allow THEN 'block' ELSE 'allow' END) AS verdict, f.node AS component FROM f LEFT JOIN d ON f.node = d.node"""

QUALITY_BASE_COUNTS = rf"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
    p AS (SELECT row, i, words[i : i + 4] AS span FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 4)),
    c AS (SELECT row, i, count(*) OVER (PARTITION BY row, span) AS n FROM p), x AS (SELECT DISTINCT row, i + k AS at FROM c, range(5) z(k) WHERE n > 1), y AS (SELECT row, count(*) AS n FROM x GROUP BY row),
    q AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum([length(z) FOR z IN words]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(y.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN y USING (row))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q"""

_SHAPES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (ltrim(x, '0') <> '' AND length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0",
    "card": "length(digits) BETWEEN 14 AND 19 AND list_sum([CASE WHEN j % 2 = 0 THEN reverse(digits)[j + 1]::INT ELSE 2 * reverse(digits)[j + 1]::INT - CASE WHEN reverse(digits)[j + 1]::INT > 4 THEN 9 ELSE 0 END END FOR j IN range(length(digits))]) % 10 = 0",
    "phone": "length(digits) BETWEEN 10 AND 15",
}


def _hits(kind: str, place: int) -> str:
    shape = _SHAPES[kind]
    return f"""SELECT row, {place} AS place, '{kind}' AS kind, start, start + length(hit) AS stop FROM (SELECT row, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, length(gap) + sum(length(gap)) OVER w - length(gap) + coalesce(sum(length(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT row, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1 : len(hits)]) AS gap FROM (SELECT row, regexp_extract_all(text, '{shape}') AS hits, regexp_split_to_array(text, '{shape}') AS gaps FROM t) WHERE len(hits) > 0) WINDOW w AS (PARTITION BY row ORDER BY i)) WHERE {_VALID[kind]}"""


PII_BASE_SPANS = f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({" UNION ALL ".join(_hits(k, i) for i, k in enumerate(_SHAPES))}),
    g AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _SHAPES)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY row)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in _SHAPES)}, coalesce(spans, '') AS base_spans, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN g USING (row)"""
