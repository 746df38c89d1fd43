"""Queries: retrieval, search, citations, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold, search, segment
from ..sources.tables import settle
from . import sql
from .registry import Tables, query


def _units(t: Tables) -> DataFrame:
    return segment.units_of(t.documents)


_TERMS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z][a-z0-9]*(?:[=<>≤≥]\\d+)?|\\d+(?:\\.\\d+)?'), lambda w: length(w) > 1 AND w NOT IN ({sql.quoted(search.QUERY_STOP)}))"
_QUERY = "array_to_string(string_split(text, ' ')[1:6], ' ')"


@query(f"WITH {sql.UNITS} SELECT doc_id, pos, array_to_string({_TERMS.format('text')}, ' ') AS terms FROM units")
def q2_query_terms(t: Tables) -> DataFrame:
    return _units(t).select("doc_id", "pos", F.array_join(search.query_terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH {sql.UNITS}, bags AS (SELECT DISTINCT doc_id, pos, unnest({_TERMS.format('text')}) AS term FROM units),
n AS (SELECT doc_id, count(*) AS n FROM units GROUP BY 1), df AS (SELECT doc_id, term, count(*) AS df FROM bags GROUP BY ALL),
q AS (SELECT DISTINCT doc_id AS query_id, doc_id, unnest({_TERMS.format(_QUERY)}) AS term FROM units WHERE pos = 2),
s AS (SELECT q.doc_id, query_id, pos, round(sum(ln(n.n / df.df::DOUBLE)), 9) AS score
  FROM q JOIN bags USING (doc_id, term) JOIN df USING (doc_id, term) JOIN n USING (doc_id) GROUP BY ALL)
SELECT doc_id, query_id, pos, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank
FROM s WHERE score > 0 QUALIFY rank <= 5""")
def q1_retrieve(t: Tables) -> DataFrame:
    units = _units(t)
    words = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    return search.retrieve(units, units.where("pos = 2").select(F.col("doc_id").alias("query_id"), "doc_id", words.alias("query")))


@query(f"""WITH {sql.UNITS}, f AS (SELECT doc_id, pos, translate(lower(text), 'àâäéèêëîïôöùûüç', 'aaaeeeeiioouuuc') AS x FROM units),
p AS (SELECT *, string_split(x, 'the ed') AS p FROM f WHERE contains(x, 'the ed')),
i AS (SELECT *, unnest(range(1, len(p))) AS i FROM p)
SELECT doc_id, pos, 'full' AS place, CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + (i - 1) * 6 AS INTEGER) AS start FROM i""")
def q3_find(t: Tables) -> DataFrame:
    return search.find(_units(t).withColumnRenamed("text", "full"), "THE éd")


_FLAT = "translate(lower(regexp_replace(trim({0}), '\\s+', ' ', 'g')), 'àâäéèêëîïôöùûüç', 'aaaeeeeiioouuuc')"


@query(f"""WITH {sql.FOLD}, x AS (SELECT u.doc_id, u.pos, {_FLAT.format("coalesce(f.takeaway, '')")} AS shown, {_FLAT.format('u.text')} AS full_text
  FROM units u LEFT JOIN fold f ON f.doc_id = u.doc_id AND f.pos = u.pos),
p AS (SELECT doc_id, pos, 'takeaway' AS place, string_split(shown, 'the e') AS p, 0 AS spot, 0 AS n FROM x WHERE contains(shown, 'the e')
  UNION ALL SELECT doc_id, pos, 'open', string_split(full_text, 'the e'), instr(full_text, shown), length(shown) FROM x WHERE contains(full_text, 'the e')),
i AS (SELECT *, unnest(range(1, len(p))) AS i FROM p),
h AS (SELECT *, CAST(list_sum(list_transform(p[1:i], lambda y: length(y))) + (i - 1) * 5 AS INTEGER) AS start FROM i),
sf AS (SELECT doc_id, min({{'p': pos, 't': takeaway}}) AS x FROM fold GROUP BY doc_id, pos // 5),
s AS (SELECT doc_id, x.p AS pos, x.t AS title FROM sf)
SELECT doc_id, pos, place, start FROM h WHERE NOT (place = 'open' AND spot > 0 AND start >= spot - 1 AND start < spot - 1 + n)
UNION ALL SELECT doc_id, pos, 'section', NULL FROM s WHERE contains({_FLAT.format('title')}, 'the e')""")
def q3_find_at_takeaway(t: Tables) -> DataFrame:
    """Hits in takeaways, in what they leave out, and in titles of sections."""
    # Levels and titles are both made of the folds: kept, so that they are made once.
    made = settle(fold.fold_local(_units(t)).select("doc_id", "pos", "section_id", F.col("text").alias("full"), "takeaway"))
    titles = made.groupBy("doc_id", "section_id").agg(F.min(F.struct("pos", "takeaway")).alias("x")).select("doc_id", "x.pos", F.col("x.takeaway").alias("title"))
    return search.find(made, "The  é", "takeaway", titles)


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(lang || ' ' || source || ' ' || doc_id || ' ' || string_split(text, chr(10))[1])), 'en') AND contains(strip_accents(lower(lang || ' ' || source || ' ' || doc_id || ' ' || string_split(text, chr(10))[1])), 'src1')")
def q4_search_library(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source", F.split("text", "\n", 2)[0].alias("title"))
    return search.search_library(docs, "EN src1", ["lang", "source", "doc_id", "title"]).select("doc_id")


@query(f"""WITH {sql.FOLD}, u AS (SELECT f.doc_id, f.pos, takeaway, text FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.pos = f.pos),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos // 5 ORDER BY pos) AS k, length(takeaway) + length(pos::VARCHAR) + 4 AS n FROM u),
s AS (SELECT doc_id, sum(length(text)) AS len, sum(n) AS c0, sum(n) FILTER (k <= 12) AS c1, sum(n) FILTER (k <= 6) AS c2, sum(n) FILTER (k <= 3) AS c3 FROM r GROUP BY 1)
SELECT doc_id, floor(len / 4) <= 60000 AS whole,
CASE WHEN c0 <= 3000 THEN 1000000 WHEN c1 <= 3000 THEN 12 WHEN c2 <= 3000 THEN 6 WHEN c3 <= 3000 THEN 3 ELSE 0 END AS cap FROM s""")
def q6_pack_context(t: Tables) -> DataFrame:
    made = fold.fold_local(_units(t)).withColumnRenamed("takeaway", "line")
    return search.pack_context(made.select("doc_id", "section_id", "pos", "text", "line"), most_chars=3_000)


def _answers(t: Tables) -> tuple[DataFrame, DataFrame]:
    answers = t.documents.select(
        F.col("doc_id").alias("answer_id"), "doc_id",
        F.format_string("See [[%d, %d]] and [[?]], not [[99999]]; again [[%d]].", F.col("doc_id") % 3, F.col("doc_id") % 7, F.col("doc_id") % 3).alias("answer"),
    )
    return answers, _units(t).select("doc_id", F.col("pos").alias("num"), F.col("unit_id").alias("target"))


_NAMED = "CASE WHEN EXISTS (SELECT 1 FROM units u WHERE u.doc_id = d.doc_id AND u.pos = d.doc_id % {0}) THEN '[[u' || d.doc_id % {0} || ']]' ELSE '[[!' || d.doc_id % {0} || ']]' END"


@query(f"""WITH {sql.UNITS} SELECT doc_id AS answer_id, 'See ' || {_NAMED.format(3)} || {_NAMED.format(7)} || ' and [[?]], not [[!99999]]; again ' || {_NAMED.format(3)} || '.' AS answer FROM documents d""")
def q7_resolved_answers(t: Tables) -> DataFrame:
    return search.resolve_citations(*_answers(t))[0]


@query(f"""WITH {sql.UNITS}, c AS (SELECT doc_id, doc_id % 3 AS pos, 1 AS k FROM documents UNION ALL SELECT doc_id, doc_id % 7, 2 FROM documents),
f AS (SELECT c.doc_id, c.pos, min(k) AS k FROM c JOIN units u ON u.doc_id = c.doc_id AND u.pos = c.pos GROUP BY ALL)
SELECT doc_id AS answer_id, 'u' || pos AS target, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS place FROM f""")
def q7_cited_units(t: Tables) -> DataFrame:
    return search.resolve_citations(*_answers(t))[1]


def _record_answers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Answers that cite notes and sections of a record for each document; some of them name nothing."""
    answers = t.documents.select(
        F.col("doc_id").alias("answer_id"), F.col("doc_id").alias("record_id"), F.format_string("See [%d] and [T1.%d], not [999]; [%d] again. [x]", F.col("doc_id") % 5, F.col("doc_id") % 4, F.col("doc_id") % 5).alias("answer"),
    )
    u = _units(t).select(F.col("doc_id").alias("record_id"), "pos", "unit_id")
    notes = u.select("record_id", F.col("pos").cast("string").alias("tag"), F.concat(F.lit("n-"), "unit_id").alias("target"))
    return answers, notes.unionByName(u.select("record_id", F.concat(F.lit("T1."), "pos").alias("tag"), F.concat(F.lit("s-"), "unit_id").alias("target")))


_TAG = "coalesce('[' || (SELECT any_value('{0}-u' || u.pos) FROM units u WHERE u.doc_id = d.doc_id AND u.pos = d.doc_id % {1}) || ']', '')"


@query(f"""WITH {sql.UNITS} SELECT doc_id AS answer_id, 'See ' || {_TAG.format('n', 5)} || ' and ' || {_TAG.format('s', 4)} || ', not ; ' || {_TAG.format('n', 5)} || ' again. [x]' AS answer FROM documents d""")
def q7_record_answers(t: Tables) -> DataFrame:
    return search.resolve_tags(*_record_answers(t))[0]


def _shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 2)) AS i
      FROM (SELECT {key}, string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') AS w FROM {table}))"""


@query(f"""WITH p AS ({_shingles('benchmark', 'item_id')}), d AS ({_shingles('documents', 'doc_id')}), n AS (SELECT item_id, count(*) AS total FROM p GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(total) AS total FROM p JOIN d USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) >= 0.6 * any_value(total)""")
def q8_contains_passage(t: Tables) -> DataFrame:
    return search.contains_passage(t.documents, t.benchmark)
