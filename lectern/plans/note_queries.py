"""Queries: notes, records and the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold, library, notes, search
from . import derived as d
from . import sql
from .registry import Tables, query


@query(f"WITH {d.NOTES} SELECT note_id, CASE kind WHEN 'highlight' THEN 'hl' ELSE kind END AS shown_kind, coalesce(text, question, quote) AS line FROM notes")
def n2_note_kind(t: Tables) -> DataFrame:
    return notes.note_kind(d.notes(t)).select("note_id", "shown_kind", "line")


def _used(n: DataFrame) -> DataFrame:
    some = n.where("event_id % 7 = 0")
    return some.select("doc_id", "note_id", F.concat(F.lit("r"), F.col("event_id") % 3).alias("record_id"))


@query(f"WITH {d.NOTES}, {d.TITLES} SELECT doc_id, note_id, created, title, lang, CASE WHEN event_id % 7 = 0 THEN 'r' || event_id % 3 ELSE '' END AS records FROM notes JOIN titles USING (doc_id)")
def n1_notes_feed(t: Tables) -> DataFrame:
    n = d.notes(t)
    return notes.notes_feed(n, d.titles(t), _used(n)).withColumn("created", F.col("created").cast("timestamp_ntz"))


def _changes(t: Tables) -> DataFrame:
    n = d.notes(t).select("doc_id", "note_id", "created", "event_id", F.coalesce("text", "quote").alias("text")).join(t.events.select("event_id", "event_type"), "event_id")
    row = lambda op, ts, text: ["doc_id", "note_id", F.lit(op).alias("op"), ts.alias("ts"), F.col("event_id").alias("seq"), text.alias("text")]
    puts = n.select(*row("put", F.col("created"), F.col("text")))
    again = n.where("event_type = 'view' AND event_id % 4 = 0").select(*row("put", F.col("created") + F.expr("INTERVAL 1 HOUR"), F.lit("again")))
    gone = n.where("event_type = 'error' AND event_id % 3 = 0").select(*row("delete", F.col("created") + F.expr("INTERVAL 1 DAY"), F.lit(None).cast("string")))
    return puts.unionByName(again).unionByName(gone)


@query(f"""WITH {d.NOTES} SELECT n.doc_id, note_id, created, CASE WHEN event_type = 'view' AND n.event_id % 4 = 0 THEN created + INTERVAL 1 HOUR ELSE created END AS updated,
CASE WHEN event_type = 'view' AND n.event_id % 4 = 0 THEN 'again' ELSE coalesce(n.text, quote) END AS text
FROM notes n JOIN events e ON e.event_id = n.event_id WHERE NOT (event_type = 'error' AND n.event_id % 3 = 0)""")
def n3_note_changes(t: Tables) -> DataFrame:
    out = notes.apply_note_changes(_changes(t))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created", "updated")})


def _picked(t: Tables) -> DataFrame:
    """The notes of one day, as a record of it has them."""
    n = d.notes(t)
    return notes.pick_notes(n.where("to_date(created) = DATE '2024-01-09'").select("doc_id", "note_id"), n)


_PICKED = f"""{d.NOTES}, pf AS (SELECT *, min({{'c': created, 'i': note_id}}) OVER (PARTITION BY doc_id) AS f FROM notes WHERE CAST(created AS DATE) = DATE '2024-01-09'),
pn AS (SELECT *, row_number() OVER (ORDER BY f, doc_id, created, note_id) AS place FROM pf),
picked AS (SELECT * FROM pn WHERE place <= 400)"""


@query(f"WITH {_PICKED} SELECT doc_id, note_id, created, CAST(place AS INTEGER) AS place FROM picked")
def n4_pick_notes(t: Tables) -> DataFrame:
    return _picked(t).withColumn("created", F.col("created").cast("timestamp_ntz"))


def _levels(t: Tables, picked: DataFrame) -> DataFrame:
    """Levels of the texts that picked notes are on; 400 notes at most are picked."""
    read = F.broadcast(picked.select("doc_id").distinct())
    return fold.local_levels(d.units(t).join(read, "doc_id", "left_semi")).withColumn("role", F.lit("para"))


_LINES = """lines AS (SELECT u.doc_id, arg_min(takeaway, u.pos) AS line FROM units u JOIN fold f ON f.doc_id = u.doc_id AND f.pos = u.pos
 WHERE length((SELECT string_agg(text, ' ') FROM sents s WHERE s.doc_id = u.doc_id AND s.pos = u.pos)) >= 12 GROUP BY 1)"""


@query(f"""WITH {_PICKED}, {_LINES} SELECT p.doc_id, any_value(line) AS line, count(*) AS notes, CAST(min(created) AS DATE) AS first_day, CAST(max(created) AS DATE) AS last_day
FROM picked p LEFT JOIN lines l ON l.doc_id = p.doc_id GROUP BY p.doc_id""")
def n5_texts_read(t: Tables) -> DataFrame:
    picked = _picked(t)
    return notes.texts_read(picked, _levels(t, picked))


@query(f"WITH {d.NOTES} SELECT doc_id, note_id, 0 AS turn, question, 'because' AS answer_line, section_id, CAST(created AS DATE) AS day FROM notes WHERE question IS NOT NULL")
def n6_asked(t: Tables) -> DataFrame:
    return notes.asked(d.notes(t))


@query(f"WITH {d.NOTES} SELECT doc_id, note_id, text AS words, quote, section_id, CAST(created AS DATE) AS day FROM notes WHERE text IS NOT NULL")
def n6_wrote(t: Tables) -> DataFrame:
    return notes.wrote(d.notes(t))


def _sections(t: Tables, wanted: DataFrame) -> DataFrame:
    """Sections with the takeaway of their first unit as line and its first word as title; only those of `wanted`'s keys.

    Only the first units are folded.
    """
    keys = wanted.columns
    units = d.units(t).join(wanted.distinct(), keys, "left_semi")
    first = units.groupBy("doc_id", "section_id").agg(F.min_by(F.struct("pos", "text"), "pos").alias("x")).select("doc_id", "section_id", "x.*")
    lv = fold.local_levels(first).select("doc_id", "section_id", "pos", "takeaway")
    return lv.select("doc_id", "section_id", "pos", F.split("takeaway", " ")[0].alias("title"), F.col("takeaway").alias("line"))


_SECTIONS = """sf AS (SELECT doc_id, 's' || pos // 5 AS section_id, min({'p': pos, 't': takeaway}) AS x FROM fold GROUP BY ALL),
sections AS (SELECT doc_id, section_id, x.p AS pos, string_split(x.t, ' ')[1] AS title, x.t AS line FROM sf)"""


@query(f"""WITH {d.NOTES}, {_SECTIONS}, q AS (SELECT doc_id, section_id, string_agg(quote, ' | ' ORDER BY created, note_id) AS quotes FROM notes WHERE kind = 'highlight' GROUP BY ALL)
SELECT q.doc_id, q.section_id, CASE WHEN title <> '' AND starts_with(line, title) THEN regexp_replace(line[length(title) + 1:], '^[\\s:.,-]+', '') ELSE line END AS line, quotes
FROM q LEFT JOIN sections s ON s.doc_id = q.doc_id AND s.section_id = q.section_id""")
def n7_marked(t: Tables) -> DataFrame:
    n = d.notes(t)
    return notes.marked(n, _sections(t, n.where("kind = 'highlight'").select("doc_id", "section_id")))


@query(f"""WITH {_PICKED}, {_SECTIONS}, tx AS (SELECT doc_id, row_number() OVER (ORDER BY min(place)) AS t FROM picked GROUP BY 1),
sn AS (SELECT t, title, row_number() OVER (PARTITION BY s.doc_id ORDER BY pos) AS n FROM sections s JOIN tx ON tx.doc_id = s.doc_id WHERE title <> ''),
sa AS (SELECT *, row_number() OVER (ORDER BY t, n) AS k FROM sn)
SELECT 'T' || t AS tag, 'text ' || doc_id AS line FROM tx UNION ALL SELECT 'T' || t || '.' || n, title FROM sa WHERE k <= 60
UNION ALL SELECT place::VARCHAR, coalesce(text, question || ' because', quote)[1:1500] FROM picked""")
def n8_record_material(t: Tables) -> DataFrame:
    picked = _picked(t)
    return notes.record_material(picked, d.notes(t), _sections(t, picked.select("doc_id"))).select("tag", "line")


@query(f"""WITH {_PICKED}, {_LINES}, r AS (
 SELECT 1 AS part, p.doc_id, '' AS ord, coalesce(any_value(line), '') AS line FROM picked p LEFT JOIN lines l ON l.doc_id = p.doc_id GROUP BY p.doc_id
 UNION ALL SELECT 2, doc_id, note_id || '-0', question || ' because' FROM picked WHERE question IS NOT NULL
 UNION ALL SELECT 3, doc_id, note_id, text FROM picked WHERE text IS NOT NULL
 UNION ALL SELECT 4, doc_id, section_id, string_agg(quote, ' | ' ORDER BY created, note_id) FROM picked WHERE kind = 'highlight' GROUP BY doc_id, section_id)
SELECT part, doc_id, ord, line FROM r""")
def n9_reading_record(t: Tables) -> DataFrame:
    n, picked = d.notes(t), _picked(t)
    mine = n.join(picked.select("doc_id", "note_id"), ["doc_id", "note_id"], "left_semi")
    marks = notes.marked(mine, _sections(t, mine.select("doc_id", "section_id")))
    made = notes.reading_record(notes.texts_read(picked, _levels(t, picked)), notes.asked(mine), notes.wrote(mine), marks)
    return made.select("part", "doc_id", "ord", "line")


@query(f"""WITH {_PICKED}, {_SECTIONS}, tx AS (SELECT doc_id, row_number() OVER (ORDER BY min(place)) AS t FROM picked GROUP BY 1),
sn AS (SELECT t, title, row_number() OVER (PARTITION BY s.doc_id ORDER BY pos) AS n FROM sections s JOIN tx ON tx.doc_id = s.doc_id WHERE title <> ''),
sa AS (SELECT *, row_number() OVER (ORDER BY t, n) AS k FROM sn),
m AS (SELECT 0 AS k, t AS a, 0 AS b, 'T' || t AS tag, 'text ' || doc_id AS line FROM tx UNION ALL SELECT 1, t, n, 'T' || t || '.' || n, title FROM sa WHERE k <= 60
UNION ALL SELECT 2, place, 0, place::VARCHAR, coalesce(text, question || ' because', quote)[1:1500] FROM picked),
body AS (SELECT string_agg('[' || tag || '] ' || line, chr(10) ORDER BY k, a, b) AS body, count(*) FILTER (k = 0) AS texts FROM m)
SELECT name, CAST(least(600, 90 + 70 * texts) AS BIGINT) AS words, instruction || chr(10) || chr(10) || body AS prompt
FROM (VALUES ('overview', 'Say what was read.'), ('question', 'Say what is open.')) AS x(name, instruction), body""")
def n10_record_prompts(t: Tables) -> DataFrame:
    """Two templates over the record's material."""
    templates = t.spark.sql("SELECT * FROM VALUES ('overview', 'Say what was read.'), ('question', 'Say what is open.') AS x(name, instruction)")
    picked = _picked(t)
    return notes.record_prompts(notes.record_material(picked, d.notes(t), _sections(t, picked.select("doc_id"))), templates)


@query(f"WITH {d.NOTES} SELECT doc_id, CAST(created AS DATE) AS day, count(*) AS notes FROM notes GROUP BY GROUPING SETS ((doc_id, 2), (2))")
def n11_calendar(t: Tables) -> DataFrame:
    return notes.notes_calendar(d.notes(t))


@query(f"""WITH {d.NOTES}, dd AS (SELECT DISTINCT CAST(created AS DATE) AS day FROM notes),
r AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS run FROM dd),
s AS (SELECT min(day) AS first_day, max(day) AS last_day FROM r GROUP BY run)
SELECT first_day, last_day, CASE WHEN first_day = date_trunc('month', first_day) AND last_day = last_day(first_day) THEN strftime(first_day, '%Y-%m')
WHEN first_day = last_day THEN first_day::VARCHAR ELSE first_day || '/' || last_day END AS label FROM s""")
def n11_day_ranges(t: Tables) -> DataFrame:
    return notes.day_ranges(d.notes(t))


@query(f"WITH {d.NOTES} SELECT note_id FROM notes WHERE event_id % 7 <> 0 AND contains(lower(strip_accents(coalesce(text, '') || ' ' || quote || ' ' || coalesce(question, ''))), 'the')")
def q5_filter_notes(t: Tables) -> DataFrame:
    n = d.notes(t)
    shaped = n.withColumns({"question": F.get("thread", F.lit(0))["q"], "answer": F.lit(""), "title": F.lit("")})
    return search.filter_notes(shaped, "new", "THE", used=_used(n)).select("note_id")


# --- Library --------------------------------------------------------------------------------------------------------


@query(f"""WITH {d.LAYERS} SELECT l.doc_id, l.lang, version, base <> CASE WHEN l.doc_id % 3 = 0 THEN 2 ELSE 1 END AS stale
FROM layers l JOIN documents d ON d.doc_id = l.doc_id WHERE l.lang <> d.lang""")
def x5_freshness(t: Tables) -> DataFrame:
    return library.freshness(d.layers(t), t.documents.select("doc_id", "lang"))


@query(f"""WITH {d.NOTES}, {d.LAYERS}, {d.TITLES}, c AS (SELECT doc_id, count(*) AS n FROM notes GROUP BY 1)
SELECT t.doc_id, title, CASE WHEN t.doc_id % 2 = 0 AND lang <> 'de' THEN lang || ',de' ELSE lang END AS languages,
(SELECT max(made_at) FROM layers l WHERE l.doc_id = t.doc_id) AS updated, coalesce(n, 0) AS notes,
t.doc_id % 2 = 0 AND lang <> 'de' AND t.doc_id % 3 = 0 AS pending FROM titles t LEFT JOIN c ON c.doc_id = t.doc_id""")
def b1_library_list(t: Tables) -> DataFrame:
    docs = d.titles(t).withColumn("added", F.to_timestamp(F.lit("2024-01-01")))
    return library.library_list(docs, d.layers(t), d.notes(t)).withColumn("updated", F.col("updated").cast("timestamp_ntz"))


@query("""WITH o AS (SELECT page_id, max(ts) AS opened, min(ts) AS added FROM pages LEFT JOIN events ON event_id % 300 = page_id GROUP BY 1)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'web' ELSE 'document' END AS kind,
CASE WHEN datediff('day', opened, DATE '2024-02-05') <= 0 THEN 'today' WHEN datediff('day', opened, DATE '2024-02-05') < 7 THEN 'week'
WHEN datediff('day', opened, DATE '2024-02-05') < 30 THEN 'month' ELSE 'older' END AS recency FROM o""")
def b2_library_groups(t: Tables) -> DataFrame:
    seen = t.pages.select("page_id").join(t.events.select((F.col("event_id") % 300).alias("page_id"), "ts"), "page_id", "left")
    listed = seen.groupBy("page_id").agg(F.max("ts").alias("opened"), F.min("ts").alias("added"))
    listed = listed.withColumns({"key": F.concat(F.when(F.col("page_id") % 2 == 0, "web-").otherwise("md-"), "page_id"), "updated": F.col("added")})
    return library.library_groups(listed, F.to_date(F.lit("2024-02-05"))).select("page_id", "kind", "recency")


def _folders(t: Tables) -> DataFrame:
    top = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("folder_id"), F.lit(None).cast("string").alias("parent"))
    under = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("folder_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    odd = t.spark.sql("SELECT * FROM VALUES ('x1', 'nowhere'), ('x2', 'gone'), ('l1', 'l2'), ('l2', 'l1') AS f(folder_id, parent)")
    return top.unionByName(under).unionByName(odd)


@query("""WITH n AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT 'n' || n_nationkey AS folder_id, 'r' || n_regionkey AS parent, 1 AS depth, k AS documents FROM n
UNION ALL SELECT 'r' || n_regionkey, NULL, 0, CAST(sum(k) AS BIGINT) FROM n GROUP BY n_regionkey
UNION ALL SELECT unnest(['x1', 'x2', 'l1', 'l2']), NULL, 0, 0""")
def b3_folder_tree(t: Tables) -> DataFrame:
    placed = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("folder_id"), F.col("c_custkey").alias("doc_id"))
    return library.folder_tree(_folders(t), placed)


@query("""WITH f AS (SELECT s_suppkey AS tree, k, 'f' || k AS folder_id FROM supplier, (SELECT unnest(range(0, 8)) AS k))
SELECT tree, folder_id, CASE WHEN k = 6 AND tree % 2 = 0 THEN 'renamed' ELSE 'n' || k END AS name,
CASE k WHEN 0 THEN NULL WHEN 1 THEN 'f0' WHEN 2 THEN CASE WHEN tree % 3 = 0 THEN 'f0' ELSE 'f1' END WHEN 4 THEN 'f0' WHEN 5 THEN 'f4' WHEN 6 THEN 'f2' WHEN 7 THEN NULL END AS parent
FROM f WHERE k <> 3""")
def b4_folder_changes(t: Tables) -> DataFrame:
    """A tree for each supplier: f0 > f1 > f2 > f3 > f4 > f5, then moves, some of them refused."""
    k = "s_suppkey % 3 = 0", "s_suppkey % 2 = 0"
    changes = [
        *[("true", "new", f"f{i}", f"n{i}", f"f{i - 1}" if i else None) for i in range(6)], ("true", "new", "f6", "n6", "f2"), ("true", "new", "f7", "n7", "f5"),
        ("true", "new", "f8", "n8", "nowhere"), ("true", "nest", "f0", None, "f3"), ("true", "nest", "f7", None, None), (k[0], "nest", "f2", None, "f0"),
        (k[1], "rename", "f6", "renamed", None), ("true", "nest", "f4", None, "f0"), ("true", "delete", "f3", None, None), ("true", "nest", "f5", None, "f3"),
    ]
    text = lambda x: "CAST(NULL AS STRING)" if x is None else f"'{x}'"
    rows = ", ".join(
        f"CASE WHEN {when} THEN struct({i} AS seq, '{op}' AS op, '{folder}' AS folder_id, {text(name)} AS name, {text(parent)} AS parent) END"
        for i, (when, op, folder, name, parent) in enumerate(changes)
    )
    return library.apply_folder_changes(t.supplier.selectExpr("s_suppkey AS tree", f"inline(array_compact(array({rows})))"))


@query(f"WITH {d.LIBRARY_EVENTS} SELECT doc_id, min(ts) AS added, max(ts) FILTER (event = 'opened') AS opened FROM le WHERE event IS NOT NULL GROUP BY 1")
def b5_library_times(t: Tables) -> DataFrame:
    out = library.library_times(d.library_events(t))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("added", "opened")})


@query(f"""WITH {d.LIBRARY_EVENTS}, l AS (SELECT doc_id, arg_max({{'e': event, 'ts': ts}}, {{'ts': ts, 's': seq}}) AS x FROM le WHERE event IN ('deleted', 'restored') GROUP BY 1)
SELECT doc_id, x.ts AS deleted, datediff('day', x.ts, DATE '2024-02-15') > 30 AS erased FROM l WHERE x.e = 'deleted'""")
def b6_trash(t: Tables) -> DataFrame:
    return library.trash(d.library_events(t), F.to_date(F.lit("2024-02-15"))).withColumn("deleted", F.col("deleted").cast("timestamp_ntz"))
