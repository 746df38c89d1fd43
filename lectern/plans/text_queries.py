"""Queries: texts to units, tokens, sentences, keys, languages and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import text as T
from ..operators import fold, segment
from . import sql
from .registry import Tables, query


def _units(t: Tables) -> DataFrame:
    return segment.units_of(t.documents)


@query(f"WITH {sql.TOKENS} SELECT doc_id, pos, count(*) AS n, string_agg(t || CASE WHEN s THEN ' ' ELSE '' END, '|' ORDER BY tok) AS tokens FROM tk GROUP BY doc_id, pos")
def t1_tokens(t: Tables) -> DataFrame:
    toks = T.tokens(F.col("text"))
    shown = F.array_join(F.transform("toks", lambda x: F.concat(x["t"], F.when(x["s"], F.lit(" ")).otherwise(F.lit("")))), "|")
    return _units(t).withColumn("toks", toks).select("doc_id", "pos", F.size("toks").cast("long").alias("n"), shown.alias("tokens"))


@query(f"WITH {sql.SENTENCES} SELECT doc_id, pos, sent, tok_start, tok_end, text FROM sents")
def t2_sentences(t: Tables) -> DataFrame:
    return segment.sentences(_units(t))


@query(rf"""WITH {sql.TOKENS}, w AS (SELECT doc_id, pos, regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_\p{{M}}]', '', 'g') AS w FROM tk),
n AS (SELECT doc_id, pos, CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS term
      FROM w WHERE w <> '' AND w NOT IN ({sql.quoted(T.STOP_WORDS)}))
SELECT doc_id, pos, term, count(*) AS n FROM n GROUP BY ALL""")
def t3_terms(t: Tables) -> DataFrame:
    return segment.terms(_units(t))


@query(rf"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, {sql.text_literal(sql.TOKEN)}), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}_]'))) AS INTEGER) AS token_words,
CAST(len(regexp_extract_all(text, {sql.text_literal(r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*")})) AS INTEGER) AS md_words,
CAST(len(regexp_extract_all(text, {sql.text_literal(r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*")})) AS DOUBLE) AS effort,
CAST(floor(length(text) / 4) AS INTEGER) AS rough_tokens FROM documents""")
def t4_word_counts(t: Tables) -> DataFrame:
    return segment.word_counts(t.documents.select("doc_id", "text")).drop("text")


@query(rf"""WITH {sql.UNITS}, x AS (SELECT doc_id, pos, CASE WHEN pos % 3 < doc_id % 4 THEN '这是第' || pos || '段，写成中文。' ELSE text END AS text FROM units),
h AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x),
c AS (SELECT doc_id, substring(text, 1, CAST(4000 - b AS BIGINT)) AS t FROM h WHERE b < 4000),
n AS (SELECT doc_id, sum(len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]'))) AS w, sum(len(regexp_extract_all(t, '[一-鿿]'))) AS c FROM c GROUP BY 1)
SELECT doc_id, CASE WHEN w > 0 THEN c / w ELSE 0.0 END AS share, CASE WHEN w > 0 THEN c / w ELSE 0.0 END > 0.2 AS is_cjk FROM n""".replace("\\\\", "\\"))
def t5_cjk_share(t: Tables) -> DataFrame:
    """Documents of which none, a third, two thirds or all lines are Chinese."""
    line = F.concat(F.lit("这是第"), "pos", F.lit("段，写成中文。"))
    return segment.document_cjk_share(_units(t).withColumn("text", F.when(F.col("pos") % 3 < F.col("doc_id") % 4, line).otherwise(F.col("text"))))


_HITS = ", ".join(
    f"{{'n': len(list_filter(w, lambda x: x IN ({sql.quoted(words.split())}))), 'k': {-k}, 'code': '{code}'}}"
    for k, (code, words) in enumerate(L.SMALL_WORDS.items())
)


@query(f"""WITH w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '(?s)```.*?```|`[^`\\n]*`|\\$\\$.*?\\$\\$|\\$[^$\\s][^$\\n]*\\$|\\[\\^?[\\w,–-]{{1,20}}\\]', ' ', 'g')[1:40000], '[A-Za-zÀ-ɏḀ-ỿ]+'), lambda x: lower(x))[1:6000] AS w FROM documents),
b AS (SELECT doc_id, len(w) AS size, list_max([{_HITS}]) AS best FROM w)
SELECT doc_id, CASE WHEN size < 5 OR best.n < 5 THEN 'en' ELSE best.code END AS detected FROM b""")
def t6_language(t: Tables) -> DataFrame:
    return segment.detect_language(t.documents)


@query(f"""WITH {sql.SENTENCES}, c AS (SELECT doc_id, pos, CAST(count(*) AS INTEGER) AS n FROM ranges GROUP BY ALL),
k AS (SELECT *, CASE WHEN n > 12 THEN CAST(ceil(n / CAST(ceil(n / 7.0) AS INTEGER)::DOUBLE) AS INTEGER) ELSE n END AS size FROM c),
p AS (SELECT *, unnest(range(1, CAST(ceil(n / size::DOUBLE) AS INTEGER) + 1)) AS part FROM k)
SELECT doc_id, pos, CAST(part AS INTEGER) AS part, 'u' || pos || CASE WHEN part > 1 THEN '~' || part ELSE '' END AS unit_id,
CAST((part - 1) * size AS INTEGER) AS sent_start, CAST(least(n, part * size) AS INTEGER) AS sent_end FROM p""")
def t10_split_units(t: Tables) -> DataFrame:
    return segment.split_units(_units(t))


@query(f"""WITH {sql.UNITS}, d AS (SELECT doc_id, pos, sha1(text)[1:8] AS d FROM units),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, d ORDER BY pos) AS n FROM d)
SELECT doc_id, pos, 'p-' || d || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS key FROM n""")
def k3_unit_keys(t: Tables) -> DataFrame:
    return segment.unit_keys(_units(t))


@query("""SELECT page_id, 'web-' || regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', ''), '[^a-z0-9]+', '-', 'g')[1:40]
|| '-' || sha256(url)[1:12] AS key FROM pages""")
def k2_page_keys(t: Tables) -> DataFrame:
    return segment.page_keys(t.pages)


@query("""SELECT doc_id, 'md-' || regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:40]
|| '-' || sha1(text)[1:8] AS key FROM documents""")
def k2_text_keys(t: Tables) -> DataFrame:
    return segment.text_keys(t.documents)


@query("""SELECT page_id, ['stored', 'github', 'arxiv', 'imported', 'wikipedia', 'europepmc', 'doi', 'web', 'error'][page_id % 9 + 1] AS kind,
CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN 'own_' || page_id || '/repo' WHEN 2 THEN '2001.' || (10000 + page_id % 90000) || 'v2' WHEN 3 THEN 'md-abc-' || page_id WHEN 4 THEN 'en:Page_' || page_id
WHEN 5 THEN 'PMC' || page_id WHEN 6 THEN '10.1234/abc' || page_id WHEN 7 THEN url || '?p=' || page_id END AS key FROM pages""")
def k1_classify_refs(t: Tables) -> DataFrame:
    """Links and ids of every kind, made from the pages' addresses."""
    k = F.col("page_id")
    kinds = [
        F.col("url"), F.concat(F.lit("https://github.com/Own_"), k, F.lit("/Repo.git#x")), F.concat(F.lit("https://arxiv.org/abs/2001."), 10000 + k % 90000, F.lit("v2")), F.concat(F.lit("md-abc-"), k),
        F.concat(F.lit("https://en.wikipedia.org/wiki/Page_"), k), F.concat(F.lit("pmc"), k), F.concat(F.lit("https://doi.org/10.1234/AbC"), k), F.concat("url", F.lit("?p="), k), F.concat(F.lit("odd "), k),
    ]
    refs = t.pages.select("page_id", F.element_at(F.array(*kinds), (k % 9 + 1).cast("int")).alias("ref"))
    stored = t.pages.where("page_id % 9 = 0").select(F.col("url").alias("key")).distinct()
    return segment.classify_refs(refs, "ref", stored).select("page_id", "kind", "key")


@query(f"WITH {sql.FOLD} SELECT doc_id, pos, key, takeaway, topic FROM fold")
def f1_fold_local(t: Tables) -> DataFrame:
    return fold.fold_local(_units(t)).select("doc_id", "pos", "key", "takeaway", "topic")


def _levels(t: Tables) -> DataFrame:
    return fold.local_levels(_units(t))


_LEVELS = f"""{sql.FOLD}, whole AS (SELECT doc_id, pos, string_agg(text, ' ' ORDER BY sent) AS full, string_agg(text, '') FILTER (sent = 0) AS brief FROM sents GROUP BY ALL),
lv AS (SELECT w.doc_id, w.pos, w.full, w.brief, key, takeaway, topic FROM whole w JOIN fold f ON f.doc_id = w.doc_id AND f.pos = w.pos)"""


@query(f"WITH {_LEVELS} SELECT doc_id, pos, lv.full, brief, key, takeaway, topic FROM lv")
def f15_levels(t: Tables) -> DataFrame:
    return _levels(t).withColumn("brief", F.array_join("brief", " … ")).drop("section_id")


def _at(level: str, line: str, gap: str) -> str:
    return f"WITH {_LEVELS} SELECT doc_id, string_agg({line}, {gap} ORDER BY pos) AS text FROM lv WHERE lv.{level} <> '' GROUP BY doc_id"


@query(_at("takeaway", "'- ' || takeaway", "chr(10)"))
def f16_document_takeaway(t: Tables) -> DataFrame:
    return fold.document_at(_levels(t), "takeaway")


@query(_at("brief", "brief", "chr(10) || chr(10)"))
def f16_document_brief(t: Tables) -> DataFrame:
    return fold.document_at(_levels(t), "brief")


@query(_at("full", "lv.full", "chr(10) || chr(10)"))
def f16_document_full(t: Tables) -> DataFrame:
    return fold.document_at(_levels(t), "full")


@query(f"""WITH {_LEVELS}, s AS (SELECT DISTINCT doc_id, pos // 5 AS s FROM lv), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n FROM s),
c AS (SELECT doc_id, s FROM n WHERE n = 2)
SELECT lv.doc_id, pos, takeaway FROM lv JOIN c ON c.doc_id = lv.doc_id AND c.s = lv.pos // 5""")
def f16_second_section(t: Tables) -> DataFrame:
    view = _levels(t)
    sections = view.groupBy("doc_id", "section_id").agg(F.min("pos").alias("pos")).withColumn("num", F.lit(""))
    return fold.section_at(view, sections, "2").select("doc_id", "pos", "takeaway")


@query(f"""WITH {sql.FOLD}, r AS (SELECT doc_id, pos // 5 AS s, pos, topic, lower(topic) AS low FROM fold WHERE topic <> ''),
f AS (SELECT doc_id, s, min({{'pos': pos, 'topic': topic}}) AS x FROM r GROUP BY doc_id, s, low)
SELECT doc_id, 's' || s AS section_id, string_agg(x.topic, '; ' ORDER BY x.pos) AS topics FROM f GROUP BY doc_id, s""")
def f17_topic_map(t: Tables) -> DataFrame:
    return fold.topic_map(_levels(t))
