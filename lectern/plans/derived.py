"""Views derived from the given tables, where an operator's input is not among them; in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold, segment
from . import sql
from .registry import Tables


def units(t: Tables) -> DataFrame:
    return segment.units_of(t.documents)


def notes(t: Tables) -> DataFrame:
    """Notes from events: questions from signups, own words from purchases, else highlights; the quote is a first sentence."""
    n = t.documents.count()
    e = t.events.withColumns({
        "doc_id": F.col("event_id") % n, "pos": (F.col("event_id") % 5).cast("int"), "created": F.col("ts").cast("timestamp"),
        "note_id": F.concat(F.lit("n-"), "event_id"),
        "kind": F.when(F.col("event_type") == "signup", "ask").when(F.col("event_type") == "purchase", "note").otherwise("highlight"),
    })
    who = F.col("user_id").cast("string")
    turn = F.struct(F.concat(F.lit("why "), who).alias("q"), F.lit("because").alias("takeaway"))
    e = e.withColumns({
        "text": F.when(F.col("kind") == "note", F.concat(F.lit("wrote "), who)),
        "thread": F.when(F.col("kind") == "ask", F.array(turn)).otherwise(F.array().cast("array<struct<q:string,takeaway:string>>")),
    })
    # Only units that a note is on are folded.
    wanted = e.select("doc_id", "pos").distinct()
    first = fold.fold_local(units(t).where("pos < 5").join(wanted, ["doc_id", "pos"], "left_semi"))
    return e.join(first.select("doc_id", "pos", "section_id", F.col("key").alias("quote")), ["doc_id", "pos"]).select("doc_id", "note_id", "kind", "created", "text", "thread", "quote", "pos", "section_id", "event_id")


NOTES = f"""{sql.FOLD}, nd AS (SELECT count(*) AS n FROM documents),
ev AS (SELECT event_id % n AS doc_id, CAST(event_id % 5 AS INTEGER) AS pos, 'n-' || event_id AS note_id, ts AS created, event_id, user_id,
  CASE event_type WHEN 'signup' THEN 'ask' WHEN 'purchase' THEN 'note' ELSE 'highlight' END AS kind FROM events, nd),
notes AS (SELECT ev.doc_id, note_id, kind, created, CASE WHEN kind = 'note' THEN 'wrote ' || user_id END AS text,
  CASE WHEN kind = 'ask' THEN 'why ' || user_id END AS question, fold.key AS quote, ev.pos, 's' || ev.pos // 5 AS section_id, event_id
  FROM ev JOIN fold ON fold.doc_id = ev.doc_id AND fold.pos = ev.pos)"""


def titles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.split("text", "\n", 2)[0].alias("title"), "lang")


TITLES = "titles AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, lang FROM documents)"


def layers(t: Tables) -> DataFrame:
    """Own layers of version 1, of version 2 where doc_id % 3 = 0; translations to de with base 1 where doc_id % 2 = 0."""
    docs = t.documents.select("doc_id", "lang")
    day = F.to_timestamp(F.lit("2024-02-01"))
    one = docs.select("doc_id", "lang", F.lit(1).alias("version"), F.lit(0).alias("base"), day.alias("made_at"))
    two = docs.where("doc_id % 3 = 0").select("doc_id", "lang", F.lit(2), F.lit(0), (day + F.expr("INTERVAL 1 DAY")))
    tr = docs.where("doc_id % 2 = 0 AND lang <> 'de'").select("doc_id", F.lit("de"), F.lit(1), F.lit(1), (day + F.expr("INTERVAL 2 HOUR")))
    return one.union(two).union(tr)


LAYERS = """layers AS (SELECT doc_id, lang, 1 AS version, 0 AS base, TIMESTAMP '2024-02-01' AS made_at FROM documents
UNION ALL SELECT doc_id, lang, 2, 0, TIMESTAMP '2024-02-02' FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'de', 1, 1, TIMESTAMP '2024-02-01 02:00:00' FROM documents WHERE doc_id % 2 = 0 AND lang <> 'de')"""


def library_events(t: Tables) -> DataFrame:
    """opened from views, deleted from some errors, restored from some signups."""
    n = t.documents.count()
    kind = (
        F.when(F.col("event_type") == "view", "opened").when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "deleted")
        .when((F.col("event_type") == "signup") & (F.col("event_id") % 20 == 0), "restored")
    )
    rows = t.events.select((F.col("event_id") % n).alias("doc_id"), kind.alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return rows.where("event IS NOT NULL")


LIBRARY_EVENTS = """le AS (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, ts, event_id AS seq, CASE WHEN event_type = 'view' THEN 'opened'
 WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'deleted' WHEN event_type = 'signup' AND event_id % 20 = 0 THEN 'restored' END AS event FROM events)"""
