"""Queries: revisions of texts. The new version drops, edits and inserts lines by their place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold, revisions
from . import derived as d
from . import sql
from .registry import Tables, query


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = d.units(t)
    kept = old.where("pos % 11 <> 3").withColumn("text", F.when(F.col("pos") % 7 == 2, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    added = old.where("pos % 13 = 5").withColumns({"text": F.concat(F.lit("Inserted after "), F.col("pos").cast("string"), F.lit(".")), "half": F.lit(1)})
    both = kept.withColumn("half", F.lit(0)).unionByName(added)
    new = both.select("doc_id", (F.col("pos") * 2 + F.col("half")).alias("pos"), "section_id", "text")
    return old, new.withColumn("unit_id", F.concat(F.lit("v"), "pos"))


def _numbered(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Numbered lines, of which every 21st is edited, another dropped, and one put in behind another."""
    old = d.units(t).withColumn("text", F.concat("pos", F.lit("> "), "text"))
    edited = F.when(F.col("pos") % 21 == 2, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))
    kept = old.where("pos % 21 <> 9").withColumns({"text": edited, "half": F.lit(0)})
    put = old.where("pos % 21 = 15").withColumns({"text": F.concat(F.lit("Put in after "), "pos", F.lit(".")), "half": F.lit(1)})
    new = kept.unionByName(put).select("doc_id", (F.col("pos") * 2 + F.col("half")).alias("pos"), "section_id", "text")
    return old, new.withColumn("unit_id", F.concat(F.lit("v"), "pos"))


_NUMBERED = f"""{sql.UNITS}, o AS (SELECT doc_id, pos, 's' || pos // 5 AS section_id, pos || '> ' || text AS text FROM units),
n AS (SELECT doc_id, 2 * pos AS np, pos AS was, section_id FROM o WHERE pos % 21 <> 9 UNION ALL SELECT doc_id, 2 * pos + 1, NULL, section_id FROM o WHERE pos % 21 = 15),
k AS (SELECT doc_id, pos, section_id, CASE WHEN pos % 21 = 9 THEN NULL WHEN pos % 21 = 2 THEN CASE WHEN length(text) > 4 THEN 'near' END ELSE 'same' END AS kind FROM o)"""


@query(f"""WITH {_NUMBERED}, c AS (SELECT doc_id, np, row_number() OVER (PARTITION BY doc_id ORDER BY np) - 1 AS place FROM n),
w AS (SELECT k.doc_id, k.pos, kind, max(place) AS before FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.np < 2 * k.pos GROUP BY ALL)
SELECT doc_id, 'u' || pos AS old_id, CASE WHEN kind IS NOT NULL THEN 'v' || 2 * pos END AS new_id, kind, CAST(coalesce(before + 1, 0) AS INTEGER) AS at FROM w""")
def v1_align_units(t: Tables) -> DataFrame:
    return revisions.align_units(*_numbered(t))


@query(f"""WITH {_NUMBERED}, h AS (SELECT DISTINCT doc_id, section_id FROM k WHERE kind IS NOT NULL)
SELECT n.doc_id, 'v' || np AS new_id, CASE WHEN kind IS NOT NULL THEN 'u' || was ELSE 'v' || np END AS unit_id, n.section_id, h.section_id AS kept_section
FROM n LEFT JOIN k ON k.doc_id = n.doc_id AND k.pos = n.was LEFT JOIN h ON h.doc_id = n.doc_id AND h.section_id = n.section_id""")
def v2_carry_ids(t: Tables) -> DataFrame:
    old, new = _numbered(t)
    return revisions.carry_ids(old, new, revisions.align_units(old, new))


def _three(t: Tables) -> list[DataFrame]:
    u = d.units(t).select("doc_id", "pos", "unit_id", "section_id")
    to = lambda rule: F.when(F.expr(rule), F.lit("s0")).alias("to_section")
    one = u.select("doc_id", "pos", "unit_id", "section_id", to("section_id = 's1'"))
    two = one.where("pos % 11 <> 3").select("doc_id", "pos", "unit_id", F.when(F.col("section_id") == "s1", "s0").otherwise(F.col("section_id")).alias("section_id"), to("section_id = 's2'"))
    three = one.where("pos % 11 <> 3 AND pos % 5 <> 1 OR pos = 3").select("doc_id", "pos", "unit_id", F.when(F.col("section_id").isin("s1", "s2"), "s0").otherwise(F.col("section_id")).alias("section_id"), to("false"))
    return [one, two, three]


@query(f"""WITH {sql.UNITS}, g AS (SELECT doc_id, pos, CASE WHEN pos // 5 IN (1, 2) THEN 's0' ELSE 's' || pos // 5 END AS section_id, CASE WHEN pos % 11 = 3 THEN 1 ELSE 2 END AS since FROM units
WHERE (pos % 11 = 3 AND pos <> 3) OR (pos % 11 <> 3 AND pos % 5 = 1)) SELECT doc_id, 'u' || pos AS old_id, section_id, since FROM g""")
def v3_id_history(t: Tables) -> DataFrame:
    return revisions.id_history(_three(t))


@query(f"""WITH {sql.UNITS}, i AS (SELECT d.doc_id, p FROM documents d, (SELECT unnest(range(0, 20)) AS p))
SELECT i.doc_id, 'u' || p AS id, CASE WHEN u.pos IS NULL THEN 'unknown' WHEN p = 3 OR p % 11 <> 3 AND p % 5 <> 1 THEN 'here' ELSE 'gone' END AS state FROM i LEFT JOIN units u ON u.doc_id = i.doc_id AND u.pos = p""")
def v4_lookup_ids(t: Tables) -> DataFrame:
    versions = _three(t)
    ids = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("p")).select("doc_id", F.concat(F.lit("u"), "p").alias("id"))
    return revisions.lookup_ids(ids, versions[-1], revisions.id_history(versions)).select("doc_id", "id", "state")


@query()
def v5_reanchor(t: Tables) -> DataFrame:
    """Notes of every document on its changed text, found again by their quotes."""
    old, new = _versions(t)
    n = d.notes(t).select("doc_id", "note_id", F.concat(F.lit("u"), "pos").alias("unit_id"), F.substring("quote", 1, 60).alias("exact"), F.lit("").alias("prefix"), F.substring("quote", 61, 40).alias("suffix"))
    return revisions.reanchor(n, new, revisions.align_units(old, new))


@query(f"""WITH {sql.UNITS}, nu AS (SELECT doc_id, pos, CASE WHEN pos // 5 = 1 THEN 's0' ELSE 's' || pos // 5 END AS s FROM units WHERE pos % 11 <> 3 AND pos // 5 <> 3),
a AS (SELECT doc_id, 's' || pos // 5 AS section_id, min(pos) AS p FROM units GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, 'zz', NULL FROM units),
f AS (SELECT doc_id, arg_min(s, pos) AS first FROM nu GROUP BY 1), k AS (SELECT u.doc_id, 's' || u.pos // 5 AS section_id, min(s) AS most FROM units u JOIN nu ON nu.doc_id = u.doc_id AND nu.pos = u.pos GROUP BY 1, 2)
SELECT a.doc_id, a.section_id, coalesce(CASE WHEN EXISTS (SELECT 1 FROM nu WHERE nu.doc_id = a.doc_id AND nu.s = a.section_id) THEN a.section_id END, most,
  (SELECT arg_max(s, nu.pos) FROM nu WHERE nu.doc_id = a.doc_id AND nu.pos < a.p), first) AS target
FROM a LEFT JOIN f ON f.doc_id = a.doc_id LEFT JOIN k ON k.doc_id = a.doc_id AND k.section_id = a.section_id""")
def v6_section_target(t: Tables) -> DataFrame:
    """Old sections, and one that never was, in a text whose second section went into the first and whose fourth is gone."""
    old = d.units(t).withColumn("text", F.concat("pos", F.lit("> "), "text"))
    kept = old.where("pos % 11 <> 3 AND section_id <> 's3'")
    section = F.when(F.col("section_id") == "s1", "s0").otherwise(F.col("section_id")).alias("section_id")
    new = kept.select("doc_id", "pos", F.concat(F.lit("v"), "pos").alias("unit_id"), section, "text")
    keys = old.select("doc_id", "section_id").distinct()
    asked = keys.unionByName(old.select("doc_id", F.lit("zz").alias("section_id")).distinct())
    return revisions.section_target(asked, old, new, revisions.align_units(old, new))


@query(f"""WITH {sql.UNITS} SELECT doc_id, 2 * pos AS pos, '' AS was, 'revised' AS now FROM units WHERE pos % 7 = 2
UNION ALL SELECT doc_id, 2 * pos + 1, '', 'Put-in' || pos FROM units WHERE pos % 13 = 5 AND pos % 7 <> 2""")
def v7_edit_places(t: Tables) -> DataFrame:
    """Lines edited and put in between, so that most units are at another place; lines are numbered, so none is repeated."""
    old = d.units(t).withColumn("text", F.concat("pos", F.lit("> "), "text"))
    edited = F.when(F.col("pos") % 7 == 2, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))
    put = old.where("pos % 13 = 5 AND pos % 7 <> 2").select("doc_id", (2 * F.col("pos") + 1).alias("pos"), F.concat(F.lit("Put-in"), "pos").alias("text"))
    new = old.select("doc_id", (2 * F.col("pos")).alias("pos"), edited.alias("text")).unionByName(put)
    return revisions.edit_places(old, new)


def _prompts(units: DataFrame, t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("title"), F.lit("text").alias("kind"))
    return fold.fold_prompts(fold.fold_local(units), docs)


@query(f"WITH {sql.UNITS} SELECT DISTINCT doc_id, 's' || pos // 5 AS section_id FROM units WHERE pos % 7 = 2")
def v8_changed_sections(t: Tables) -> DataFrame:
    old = d.units(t)
    new = old.withColumn("text", F.when(F.col("pos") % 7 == 2, F.concat("text", F.lit(" Revised."))).otherwise(F.col("text")))
    return revisions.changed_sections(_prompts(new, t), _prompts(old, t))


@query(f"""WITH {sql.UNITS}, a AS (SELECT doc_id, pos, CASE WHEN pos % 7 <> 2 THEN 'n' || pos END AS nid FROM units),
c AS (SELECT doc_id, pos % 2 AS k, min(pos) AS pos FROM units WHERE pos % 7 <> 2 GROUP BY ALL)
SELECT doc_id, 'n-1' AS note_id, string_agg(coalesce(nid, 'u' || pos), ',' ORDER BY pos) AS cites FROM a GROUP BY 1""")
def v9_recite(t: Tables) -> DataFrame:
    """A conversation that cites every unit twice, after some ids changed."""
    u = d.units(t)
    alignment = u.select("doc_id", F.col("unit_id").alias("old_id"), F.when(F.col("pos") % 7 != 2, F.concat(F.lit("n"), "pos")).alias("new_id"))
    cites = u.select("doc_id", F.lit("n-1").alias("note_id"), F.col("pos").alias("i"), "unit_id")
    twice = cites.unionByName(cites.withColumn("i", F.col("i") + 100_000))
    return revisions.recite(twice, alignment).withColumn("cites", F.array_join("cites", ","))
