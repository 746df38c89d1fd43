"""Queries: replies of a stub model, prompts, links, translations. Replies are derived from the texts themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fold, links, translate
from ..sources.tables import settle, shared_dir
from . import derived as d
from . import sql
from .registry import Tables, query

_ROLES = ", ".join(f"'{r}'" for r in fold.ROLES)


def _role():
    return F.element_at(F.array(*[F.lit(r) for r in fold.ROLES]), ((F.col("doc_id") * 31 + F.col("pos")) % 8 + 1).cast("int"))


def _replies(folded: DataFrame) -> DataFrame:
    """A reply for ten units of eleven: the first ten words, the second sentence, evidence with a wrong number, a topic."""
    ten = F.array_join(F.slice(F.split(F.col("text"), " "), 1, 10), " ")
    return folded.where("(doc_id + pos) % 11 <> 0").select(
        "doc_id", "pos", _role().alias("role"), ten.alias("takeaway"), F.get("sentences", F.lit(1)).alias("reason"),
        F.array(F.lit(1), F.lit(0), F.lit(99)).alias("evidence"), F.split("text", " ")[1].alias("topic"),
    )


_CLEAN = "regexp_replace(regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '\\s*[—–]\\s*|\\s+-\\s+', ', ', 'g'), '[\\s.;,!?:]+$', '')"
_TEN = _CLEAN.format("array_to_string(string_split(text, ' ')[1:10], ' ')")


@query(f"""WITH {sql.FOLD}, c AS (SELECT doc_id, pos, count(*) AS n, {_CLEAN.format("coalesce(min(text) FILTER (sent = 1), '')")} AS reason FROM sents GROUP BY ALL),
j AS (SELECT f.doc_id, f.pos, {_TEN} AS ten, reason, n, f.takeaway, f.key, (f.doc_id + f.pos) % 11 <> 0 AS has,
  ([{_ROLES}])[(f.doc_id * 31 + f.pos) % 8 + 1] AS role FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.pos = f.pos JOIN c ON c.doc_id = f.doc_id AND c.pos = f.pos)
SELECT doc_id, pos, CASE WHEN has AND ten <> '' THEN role ELSE 'context' END AS role, CASE WHEN has AND ten <> '' AND n > 99 THEN '0,1,99' WHEN has AND ten <> '' AND n > 1 THEN '0,1' ELSE '0' END AS ev,
CASE WHEN has AND ten <> '' THEN ten ELSE takeaway END AS takeaway,
CASE WHEN has AND ten <> '' THEN ten || '.' || CASE WHEN reason <> '' THEN ' ' || reason || '.' ELSE '' END ELSE key END AS key FROM j""")
def f4_assemble_ladders(t: Tables) -> DataFrame:
    made = fold.fold_local(d.units(t))
    out = fold.assemble_ladders(made, _replies(made))
    return out.select("doc_id", "pos", "role", F.array_join(F.transform("ev", lambda x: x.cast("string")), ",").alias("ev"), "takeaway", "key")


@query(f"""WITH {sql.UNITS}, r AS (SELECT doc_id, pos, (doc_id + pos) % 11 <> 0 AS here,
 len(list_filter(regexp_extract_all(array_to_string(string_split(text, ' ')[1:40], ' '), {sql.text_literal(sql.TOKEN)}), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}_]'))) AS w FROM units)
SELECT doc_id, count(*) FILTER (NOT here) AS missing, count(*) FILTER (here AND w > 18) AS over FROM r GROUP BY 1""")
def f14_fold_report(t: Tables) -> DataFrame:
    u = d.units(t)
    long = F.array_join(F.slice(F.split("text", " "), 1, 40), " ")
    return fold.fold_report(u, u.where("(doc_id + pos) % 11 <> 0").select("doc_id", "pos", long.alias("takeaway")))


@query(f"""WITH {sql.UNITS} SELECT doc_id, pos, {_CLEAN.format("array_to_string(string_split(text, ' ')[1:12], ' ')")} AS takeaway FROM units
WHERE {_CLEAN.format("array_to_string(string_split(text, ' ')[1:12], ' ')")} <> '' AND pos % 3 <> 2""")
def f7_section_lines(t: Tables) -> DataFrame:
    """Section lines from replies in three shapes: an object, JSON text of one, and the bare line; a third has no line."""
    twelve = F.array_join(F.slice(F.split("text", " "), 1, 12), " ")
    obj = F.struct(F.when(F.col("pos") % 3 != 2, twelve).alias("takeaway"), F.lit("").alias("topic"))
    bare = F.to_json(F.struct(twelve.alias("section")))
    inner = F.to_json(F.struct(F.to_json(obj).alias("section")))
    out = F.when(F.col("pos") % 3 == 0, F.to_json(F.struct(obj.alias("section")))).when(F.col("pos") % 6 == 1, inner).when(F.col("pos") % 3 == 1, bare).otherwise(F.to_json(F.struct(obj.alias("section"))))
    parsed = fold.parse_replies(d.units(t).select("doc_id", "pos", out.alias("out")))
    return fold.section_lines(parsed).select("doc_id", "pos", "takeaway")


@query(f"""WITH {sql.UNITS} SELECT doc_id, pos, 'U' || pos AS unit, array_to_string(string_split(text, ' ')[1:5], ' ') AS takeaway FROM units""")
def f13_reply_units(t: Tables) -> DataFrame:
    """Replies of four shapes, read back as units."""
    entry = F.struct(F.concat(F.lit("U"), "pos").alias("id"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("takeaway"))
    listed, text = F.array(entry), F.to_json(F.array(entry))
    by_id = F.map_from_arrays(F.array(F.concat(F.lit("U"), F.col("pos").cast("string"))), F.array(entry))
    shapes = [F.to_json(F.struct(x.alias("units"))) for x in (listed, by_id, text, F.array(F.to_json(entry)))]
    out = F.element_at(F.array(*shapes), (F.col("pos") % 4 + 1).cast("int"))
    return fold.reply_units(fold.parse_replies(d.units(t).select("doc_id", "pos", out.alias("out")))).select("doc_id", "pos", "unit", "takeaway")


def _prompts(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, "paper").otherwise("text").alias("kind"))
    return fold.fold_prompts(fold.fold_local(d.units(t)), docs)


_PROMPTS = f"""{sql.FOLD}, un AS (SELECT u.doc_id, 's' || u.pos // 5 AS section_id, u.pos, u.pos % 5 AS _, f.key,
  coalesce((SELECT string_agg('  ' || sent || ': ' || text, chr(10) ORDER BY sent) FROM sents s WHERE s.doc_id = u.doc_id AND s.pos = u.pos), '') AS lines
  FROM units u LEFT JOIN fold f ON f.doc_id = u.doc_id AND f.pos = u.pos),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY pos) - 1 AS i FROM un),
bl AS (SELECT doc_id, section_id, min(pos) AS p, string_agg('[U' || i || '] paragraph' || chr(10) || lines, chr(10) ORDER BY pos) AS body FROM nb GROUP BY 1, 2),
ks AS (SELECT doc_id, pos, key, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM un WHERE key <> ''),
op AS (SELECT doc_id, string_agg(key, ' ' ORDER BY pos) AS opening FROM ks WHERE k <= 2 GROUP BY 1),
ol AS (SELECT b.doc_id, b.section_id, string_agg(CASE WHEN o.section_id = b.section_id THEN '> ' ELSE '- ' END || o.section_id, chr(10) ORDER BY o.p) AS outline
  FROM bl b JOIN bl o ON o.doc_id = b.doc_id GROUP BY 1, 2),
prompts AS (SELECT b.doc_id, b.section_id, CASE WHEN d.doc_id % 2 = 0 THEN 'Paper' ELSE 'Text' END || ': ' || source || chr(10) || chr(10)
  || CASE WHEN coalesce(opening, '') = '' THEN '' ELSE 'Opening: ' || opening || chr(10) || chr(10) END || 'Outline:' || chr(10) || outline || chr(10) || chr(10)
  || 'Section ' || b.section_id || chr(10) || chr(10) || body || chr(10) || chr(10)
  || CASE WHEN d.doc_id % 2 = 0 THEN '{fold.WORDING["paper"][2]}' ELSE '{fold.WORDING["text"][2]}' END
  || ' Give the section a takeaway of 16 words. Give each paragraph a takeaway of 14 words, a reason of 22 and a topic of 3, in the words of '
  || CASE WHEN d.doc_id % 2 = 0 THEN 'the authors' ELSE 'the author' END || '.' AS prompt
  FROM bl b JOIN documents d ON d.doc_id = b.doc_id JOIN ol ON ol.doc_id = b.doc_id AND ol.section_id = b.section_id LEFT JOIN op ON op.doc_id = b.doc_id),
keyed AS (SELECT *, sha256(CAST(to_json(['Answer with JSON only.', prompt, {sql.text_literal(fold.REPLY_SCHEMA)}, 'stub', '']) AS VARCHAR))[1:24] AS cache_key FROM prompts)"""


@query(f"WITH {_PROMPTS} SELECT doc_id, section_id, 0 AS part, 1 AS parts, prompt, cache_key FROM keyed")
def f10_fold_prompts(t: Tables) -> DataFrame:
    return _prompts(t)


@query(f"WITH {sql.UNITS} SELECT DISTINCT doc_id, 's' || pos // 5 AS section_id FROM units WHERE (pos // 5) % 3 <> 0 OR doc_id % 5 = 0")
def f11_to_ask(t: Tables) -> DataFrame:
    """Two sections of three have no kept reply, and for a fifth of the documents what was kept cannot be read."""
    p = settle(_prompts(t).drop("prompt"))
    kept = p.where("cast(substring(section_id, 2) AS int) % 3 = 0").select("cache_key", F.when(F.col("doc_id") % 5 == 0, "cut {").otherwise("{}").alias("out"))
    store = f"replies_{uuid.uuid4().hex}"
    fold.save_replies(kept, store, f"{shared_dir(t.spark)}/{store}", buckets=16)
    kept = t.spark.table(store)
    # Equal sections of copied documents share a prompt only within one source title; keys are compared per section here.
    return p.join(fold.to_ask(p, kept).select("cache_key"), "cache_key", "left_semi").select("doc_id", "section_id")


@query(f"WITH {_PROMPTS} SELECT cache_key, CASE WHEN cache_key[1] < '4' THEN NULL ELSE length(prompt)::VARCHAR END AS out, CASE WHEN cache_key[1] < '4' THEN 'failed' END AS error FROM keyed")
def f12_complete(t: Tables) -> DataFrame:
    """A stub completion that answers each prompt with its length; a call fails if it holds a prompt of a quarter of the keys."""

    def answer(prompts: list[str]) -> list[str]:
        import hashlib
        import json

        keys = [hashlib.sha256(json.dumps(["Answer with JSON only.", p, fold.REPLY_SCHEMA, "stub", ""], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for p in prompts]
        if any(k[0] < "4" for k in keys):
            raise ValueError("failed")
        return [str(len(p)) for p in prompts]

    return fold.complete(_prompts(t), answer)


# --- Links ----------------------------------------------------------------------------------------------------------


def _refs(t: Tables) -> DataFrame:
    u = d.units(t)
    atoms = u.select("doc_id", "unit_id", "pos", F.concat(F.lit("a"), "pos").alias("atom"), F.concat(F.lit("#u"), F.col("pos") - F.col("pos") % 4).alias("href"))
    atoms = atoms.unionByName(atoms.withColumn("atom", F.concat("atom", F.lit("b"))))
    return links.cross_refs(atoms, u.select("doc_id", F.concat(F.lit("#"), "unit_id").alias("href"), F.col("unit_id").alias("target"), F.lit("unit").alias("kind")))


_REFS = "refs AS (SELECT u.doc_id, u.pos AS fp, v.pos AS tp FROM units u JOIN units v ON v.doc_id = u.doc_id AND v.pos = u.pos - u.pos % 4 WHERE u.pos % 4 <> 0)"


@query(f"WITH {sql.UNITS}, {_REFS} SELECT doc_id, 'u' || fp AS f, 'u' || tp AS t, 'unit' AS tk, 'ref' AS rel, 'a' || fp AS via FROM refs")
def l1_cross_refs(t: Tables) -> DataFrame:
    return _refs(t)


@query(f"""WITH {sql.FOLD}, n AS (SELECT doc_id, takeaway, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM fold WHERE takeaway <> ''),
p AS (SELECT *, CAST(floor(i / ceil(n / ceil(n / 400.0))) AS INTEGER) AS part FROM n)
SELECT doc_id, part, CAST(greatest(8, round(greatest(20, floor(max(n) / 2.0)) * count(*) / max(n))) AS INTEGER) AS links, string_agg('[' || i || '] ' || takeaway, chr(10) ORDER BY i) AS prompt FROM p GROUP BY doc_id, part""")
def l2_link_prompts(t: Tables) -> DataFrame:
    return links.link_prompts(fold.fold_local(d.units(t)))


@query(f"""WITH {sql.UNITS}, {_REFS}, nn AS (SELECT doc_id, max(pos) + 1 AS n FROM units GROUP BY 1),
r AS (SELECT u.doc_id, u.pos AS f, (u.pos * 3 + k) % n AS t, (['supports', 'qualifies', 'contrasts', 'details', 'odd'])[u.pos % 5 + 1] AS rel, u.pos * 10 + k AS seq
      FROM units u JOIN nn USING (doc_id), (SELECT unnest([0, 1, 2, 3]) AS k)),
g AS (SELECT r.* FROM r JOIN units v ON v.doc_id = r.doc_id AND v.pos = r.t WHERE rel <> 'odd' AND f <> t AND NOT (f // 5 = t // 5 AND abs(f - t) = 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, f, t ORDER BY seq) AS k FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, f ORDER BY seq) AS n FROM o WHERE k = 1),
kept AS (SELECT doc_id, f, t, rel FROM m WHERE n <= 3)
SELECT doc_id, 'u' || f AS f, 'u' || t AS t, rel FROM kept UNION ALL
SELECT doc_id, 'u' || fp, 'u' || tp, 'ref' FROM refs WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.doc_id = refs.doc_id AND x.f = fp AND x.t = tp)""")
def l3_merge_links(t: Tables) -> DataFrame:
    u = d.units(t)
    n = u.groupBy("doc_id").agg((F.max("pos") + 1).alias("n"))
    rel = F.element_at(F.array(*[F.lit(x) for x in (*links.RELATIONS, "odd")]), (F.col("pos") % 5 + 1).cast("int"))
    r = u.join(n, "doc_id").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    r = r.select("doc_id", (F.col("pos") * 10 + F.col("k")).alias("seq"), F.col("pos").alias("f"), ((F.col("pos") * 3 + F.col("k")) % F.col("n")).cast("int").alias("t"), rel.alias("rel"))
    return links.merge_links(r, u, _refs(t)).drop("via")


# --- Translations ---------------------------------------------------------------------------------------------------


def _translated(u: DataFrame) -> DataFrame:
    de = u.where("(doc_id + pos) % 7 <> 0").withColumn("lang", F.lit("de"))
    return de.unionByName(u.where("(doc_id + pos) % 7 <> 0 AND (doc_id + pos) % 5 <> 0").withColumn("lang", F.lit("fr")))


@query(f"""WITH {sql.UNITS}, l AS (SELECT *, unnest(['de', 'fr']) AS lang FROM units WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]')) > 1)
SELECT doc_id, 's' || pos // 5 AS section_id, pos, lang FROM l WHERE (doc_id + pos) % 7 = 0 OR lang = 'fr' AND (doc_id + pos) % 5 = 0""")
def x3_translation_gaps(t: Tables) -> DataFrame:
    u = d.units(t)
    return translate.translation_gaps(u, _translated(u), ["de", "fr"])


@query(f"""WITH {d.TITLES}, l AS (SELECT doc_id, title, unnest(['de', 'fr']) AS lang FROM titles)
SELECT doc_id, NULL AS section_id, lang FROM l WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0
UNION ALL SELECT doc_id, 's' || k, lang FROM l, (SELECT unnest([0, 1]) AS k) WHERE NOT (lang = 'de' AND doc_id % 4 = 0)""")
def x4_title_gaps(t: Tables) -> DataFrame:
    """Titles of documents and of two sections each that have no translation, or one that did not change them."""
    docs = d.titles(t).select("doc_id", "title")
    made = docs.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("de"), F.lit("fr"))).alias("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise(F.concat("title", F.lit("!"))).alias("title"))
    heads = docs.select("doc_id", F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("section_id"), F.lit("Head").alias("title"))
    spoken = heads.where("doc_id % 4 = 0").select("doc_id", "section_id", F.lit("de").alias("lang"), F.when(F.col("section_id") == "s0", "Kopf").otherwise("Head").alias("title"))
    return translate.title_gaps(heads, docs, spoken, made, ["de", "fr"])


@query(f"""WITH {sql.UNITS}, s AS (SELECT doc_id, pos // 5 AS s, pos, length(text) AS size FROM units),
w AS (SELECT *, sum(size) OVER (PARTITION BY doc_id, s) AS total, coalesce(sum(size) OVER (PARTITION BY doc_id, s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 row_number() OVER (PARTITION BY doc_id, s ORDER BY pos) AS i FROM s),
k AS (SELECT *, greatest(CAST(ceil(total / 600.0) AS INTEGER), 1) AS k FROM w),
r AS (SELECT doc_id, s, pos, i, k, total, before + size / 2.0 AS mid FROM k)
SELECT doc_id, 's' || s AS section_id, count(*) AS n FROM r GROUP BY ALL""")
def x1_batch_sizes(t: Tables) -> DataFrame:
    """Units batched for translation, counted by section: every unit is in one batch."""
    made = translate.translation_batches(d.units(t).withColumn("size", F.length("text")), 600)
    return made.groupBy("doc_id", "section_id").agg(F.count("batch").alias("n"))


@query(f"""WITH {sql.SENTENCES}, c AS (SELECT doc_id, pos, count(*) AS n, min(text) FILTER (sent = 0) AS first FROM sents GROUP BY ALL)
SELECT doc_id, pos, 'de' AS lang, n AS sentences, first AS takeaway FROM c WHERE (doc_id + pos) % 7 <> 0""")
def x2_assemble_translations(t: Tables) -> DataFrame:
    """Replies with one sentence too few or too many, and no takeaway."""
    # Replies and units are both made of the folds: kept, so that they are made once.
    u = settle(fold.fold_local(d.units(t)).select("doc_id", "pos", "sentences", "ev"))
    short = F.when((F.col("pos") % 2 == 0) & (F.size("sentences") > 1), F.slice("sentences", F.lit(1), F.size("sentences") - 1)).otherwise(F.concat("sentences", F.array(F.lit(""))))
    whole = F.when(F.col("pos") % 3 == 0, F.col("sentences")).otherwise(short)
    one = F.when(F.size("sentences") == 1, F.col("sentences")).otherwise(whole)
    r = u.where("(doc_id + pos) % 7 <> 0").select("doc_id", "pos", F.lit("de").alias("lang"), one.alias("sentences"), F.lit(None).cast("string").alias("takeaway"), F.lit("").alias("reason"))
    return translate.assemble_translations(r, u).select("doc_id", "pos", "lang", F.size("sentences").cast("long").alias("sentences"), "takeaway")
