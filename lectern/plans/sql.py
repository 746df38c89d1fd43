"""Common table expressions of the DuckDB SQL: units, tokens, sentences and folds of documents."""

from __future__ import annotations

from ..functions import text as T

TOKEN = r"\d+(?:[.,]\d+)+%?|[\p{L}\p{N}_](?:[\p{L}\p{N}_]|\p{M})*(?:['’\-][\p{L}\p{N}_](?:[\p{L}\p{N}_]|\p{M})*)*|\S"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


UNITS = """
units AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lines[i] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  WHERE trim(lines[i]) <> '')"""

TOKENS = f"""{UNITS},
tk AS (SELECT doc_id, pos, CAST(unnest(range(len(ts))) AS INTEGER) AS tok, unnest(ts) AS t, unnest(gs) <> '' AS s
  FROM (SELECT doc_id, pos, regexp_extract_all(text, {text_literal(TOKEN)}) AS ts,
               regexp_extract_all(text, {text_literal(f"(?:{TOKEN})(\\s*)")}, 1) AS gs FROM units))"""

SENTENCES = f"""{TOKENS},
near AS (SELECT *, lag(t) OVER u AS prev, lead(t) OVER u AS next, count(*) OVER (PARTITION BY doc_id, pos) AS n FROM tk
  WINDOW u AS (PARTITION BY doc_id, pos ORDER BY tok)),
runs AS (SELECT *, min(CASE WHEN s OR next IS NULL OR next NOT IN ({quoted([*T.STOPS, *T.CLOSERS])}) THEN tok END) OVER
           (PARTITION BY doc_id, pos ORDER BY tok ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last FROM near),
stops AS (SELECT DISTINCT doc_id, pos, last FROM runs WHERE t IN ({quoted(T.STOPS)})
           AND NOT (t = '.' AND (coalesce(lower(prev), '') IN ({quoted(T.ABBREVIATIONS)}) OR regexp_full_match(coalesce(prev, ''), '[A-Z]')))),
cuts AS (SELECT stops.doc_id, stops.pos, CAST(last + 1 AS INTEGER) AS e FROM stops
         JOIN near ON near.doc_id = stops.doc_id AND near.pos = stops.pos AND near.tok = last
         WHERE near.s AND near.next IS NOT NULL AND regexp_matches(near.next, '^[A-Z0-9(\\[“"‘]')
         UNION SELECT DISTINCT doc_id, pos, CAST(n AS INTEGER) FROM near),
ranges AS (SELECT doc_id, pos, CAST(row_number() OVER c - 1 AS INTEGER) AS sent, coalesce(lag(e) OVER c, 0) AS tok_start, e AS tok_end
           FROM cuts WINDOW c AS (PARTITION BY doc_id, pos ORDER BY e)),
sents AS (SELECT r.doc_id, r.pos, r.sent, r.tok_start, r.tok_end,
            trim(string_agg(t || CASE WHEN s THEN ' ' ELSE '' END, '' ORDER BY tok)) AS text
          FROM ranges r JOIN tk ON tk.doc_id = r.doc_id AND tk.pos = r.pos AND tok >= tok_start AND tok < tok_end
          GROUP BY ALL)"""

FOLD = rf"""{SENTENCES},
firsts AS (SELECT tk.*, regexp_matches(t, '[\p{{L}}\p{{N}}_]') AS word FROM tk JOIN ranges r
           ON r.sent = 0 AND tk.doc_id = r.doc_id AND tk.pos = r.pos AND tok < r.tok_end),
counted AS (SELECT *, sum(CASE WHEN word THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY tok) AS w FROM firsts),
heads AS (SELECT doc_id, pos, max(CASE WHEN word AND w <= 14 THEN tok END) AS h14, max(CASE WHEN word AND w <= 3 THEN tok END) AS h3,
            max(tok) AS hn FROM counted GROUP BY doc_id, pos),
fold AS (SELECT c.doc_id, c.pos,
    trim(string_agg(t || CASE WHEN s THEN ' ' ELSE '' END, '' ORDER BY tok)) AS key,
    coalesce(trim(string_agg(t || CASE WHEN s THEN ' ' ELSE '' END, '' ORDER BY tok) FILTER (tok <= coalesce(h14, hn))), '') AS takeaway,
    coalesce(trim(string_agg(t || CASE WHEN s THEN ' ' ELSE '' END, '' ORDER BY tok) FILTER (tok <= h3)), '') AS topic
  FROM counted c JOIN heads h ON h.doc_id = c.doc_id AND h.pos = c.pos GROUP BY c.doc_id, c.pos)"""
