"""Queries of operators whose input is made from the given tables: readers, document structure, levels, placements, revisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import languages as L
from ..operators import cjk, fold, library, notes, revisions, structure, translate
from ..sources import readers, sinks
from ..sources.tables import shared_dir
from . import derived as d
from . import sql, text_queries  # noqa: F401
from .registry import SQL, Tables, query

# --- Readers --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text FROM documents")
def s2_decoded_texts(t: Tables) -> DataFrame:
    """Texts as bytes, half of them with a byte order mark."""
    mark = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    files = t.documents.where("text IS NOT NULL").select("doc_id", F.concat(mark, F.encode("text", "UTF-8")).alias("content"))
    return readers.decode_fallback(files).select("doc_id", "text")


@query("""SELECT 'K' || c_custkey AS key, c_name AS title, 'Name, C ' || c_custkey AS authors, (2000 + c_custkey % 20)::VARCHAR AS year, 'cite' || c_custkey AS citekey,
CASE WHEN c_custkey % 2 = 0 THEN '2001.0' || (1000 + c_custkey % 9000) END AS arxiv FROM customer WHERE c_custkey % 3 <> 0""")
def s6_bibliography(t: Tables) -> DataFrame:
    """A reference manager's item for each customer; every third is an attachment."""
    k = F.col("c_custkey")
    person = F.struct(F.lit("author").alias("creatorType"), F.concat(F.lit("C "), k).alias("firstName"), F.lit("Name").alias("lastName"))
    data = F.struct(
        F.when(k % 3 == 0, "attachment").otherwise("preprint").alias("itemType"), F.col("c_name").alias("title"), F.array(person).alias("creators"),
        F.concat(F.lit("Citation Key: cite"), k).alias("extra"), F.when(k % 2 == 0, F.concat(F.lit("https://arxiv.org/abs/2001.0"), 1000 + k % 9000)).alias("url"),
    )
    item = F.struct(F.concat(F.lit("K"), k).alias("key"), F.struct(F.concat((2000 + k % 20).cast("string"), F.lit("-05")).alias("parsedDate")).alias("meta"), data.alias("data"))
    return readers.read_bibliography(t.customer.select(F.to_json(item).alias("json"))).withColumn("authors", F.array_join("authors", "; "))


@query("""SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey AS title, 'Ann Smith ' || o_custkey || '; Bo Li' AS authors, '10.1/' || o_orderkey AS doi,
'2024-0' || (1 + o_orderkey % 9) || '-07' AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'https://creativecommons.org/licenses/by/4.0/' ELSE '' END AS license FROM orders""")
def s7_article_meta(t: Tables) -> DataFrame:
    """Article XML of each order."""
    k = F.col("o_orderkey")
    name = lambda first, last: f"<contrib contrib-type='author'><name><surname>{last}</surname><given-names>{first}</given-names></name></contrib>"
    xml = F.concat(
        F.lit("<article><front><article-meta><article-id pub-id-type='doi'>10.1/"), k, F.lit("</article-id><title-group><article-title> Order "), k,
        F.lit("</article-title></title-group><contrib-group><contrib contrib-type='author'><name><surname>Smith "),
        F.col("o_custkey"), F.lit("</surname><given-names>Ann</given-names></name></contrib>" + name("Bo", "Li") + "</contrib-group><pub-date><day>7</day><month>"), 1 + k % 9, F.lit("</month><year>2024</year></pub-date>"),
        F.when(k % 2 == 0, "<permissions><license href='https://creativecommons.org/licenses/by/4.0/'/></permissions>").otherwise(""), F.lit("</article-meta></front></article>"),
    )
    made = readers.read_jats_meta(t.orders.select(k.alias("doc_id"), xml.alias("xml"))).drop("xml")
    return made.withColumn("authors", F.array_join("authors", "; "))


@query("""SELECT page_id AS doc_id, 0 AS page, CAST(2 * k AS INTEGER) AS block, CASE k WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' ELSE 'item' END AS kind,
CASE k WHEN 0 THEN '# Page ' || page_id WHEN 1 THEN url ELSE '- one' END AS text FROM pages, (SELECT unnest([0, 1, 2]) AS k)""")
def s8_page_markdown(t: Tables) -> DataFrame:
    """Markdown of each page: a heading, its address, an item."""
    md = F.concat(F.lit("# Page "), "page_id", F.lit("\n\n"), "url", F.lit("\n\n- one\n"))
    made = readers.read_page_markdown(t.pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page"), md.alias("markdown")))
    first = made.groupBy("doc_id", "page").agg(F.min("block").alias("b"))
    return made.join(first, ["doc_id", "page"]).select("doc_id", "page", (F.col("block") - F.col("b")).cast("int").alias("block"), "kind", "text")


_BUDGET = {code: L.BUDGETS["vi" if code == "vi" else script if script in L.BUDGETS else "other"] for code, _, script in L.LANGUAGES}


@query(f"""SELECT doc_id, name, takeaway, unit FROM documents JOIN (VALUES {', '.join(f"('{c}', {sql.text_literal(n)}, {_BUDGET[c][0]}, '{_BUDGET[c][4]}')" for c, n, _ in L.LANGUAGES)}) AS l(code, name, takeaway, unit) ON code = lang""")
def t7_document_budgets(t: Tables) -> DataFrame:
    """The length of a takeaway in each document's language."""
    table = L.languages(t.spark).select(F.col("code").alias("lang"), "name", "takeaway", "unit")
    return t.documents.select("doc_id", "lang").join(table, "lang").select("doc_id", "name", "takeaway", "unit")


# --- Document structure ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN h THEN 'Doc ' || doc_id ELSE '' END AS fm_title, CASE WHEN h THEN 'A One|B ' || source ELSE '' END AS fm_authors,
CASE WHEN h THEN '2024-01-0' || (1 + doc_id % 9) ELSE '' END AS fm_date, CASE WHEN h THEN 'CC BY' ELSE '' END AS fm_license FROM (SELECT *, doc_id % 2 = 0 AS h FROM documents WHERE text IS NOT NULL)""")
def t11_front_matter(t: Tables) -> DataFrame:
    """Half of the documents with a head block."""
    head = F.concat(
        F.lit('---\ntitle: "Doc '), "doc_id", F.lit('"\nauthors: [A One, \'B '), "source", F.lit("']\ndate: 2024-01-0"), 1 + F.col("doc_id") % 9, F.lit(" # seen\nlicense: CC BY\n---\n")
    )
    texts = t.documents.where("text IS NOT NULL").withColumn("text", F.concat(F.when(F.col("doc_id") % 2 == 0, head).otherwise(""), "text"))
    return structure.front_matter(texts).select("doc_id", "fm_title", F.array_join("fm_authors", "|").alias("fm_authors"), "fm_date", "fm_license")


@query("""SELECT doc_id, CAST(0 AS INTEGER) AS block, 'heading' AS kind, CASE WHEN doc_id % 3 = 0 THEN 'Alpha' ELSE 'Alpha Beta of ' || source END AS text FROM documents
UNION ALL SELECT doc_id, 1, 'heading', '1. Method' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, 'paragraph', 'The communication of OCR-free ' || lang FROM documents""")
def t13_rejoined_blocks(t: Tables) -> DataFrame:
    """A heading on two lines (a numbered one stands alone) and a paragraph with broken words."""
    rows = F.array(
        F.struct(F.lit(0).alias("block"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.lit("# Alpha").alias("text")),
        F.struct(F.lit(1).alias("block"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.when(F.col("doc_id") % 3 == 0, "# 1. Method").otherwise(F.concat(F.lit("# Beta of "), "source")).alias("text")),
        F.struct(F.lit(2).alias("block"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.concat(F.lit("The communica- tion of OCR- free "), "lang").alias("text")),
    )
    return structure.rejoin(t.documents.select("doc_id", F.inline(rows)), ["doc_id"]).select("doc_id", "block", "kind", "text")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'The study of source ' || source ELSE 'Proceedings of many learned societies' END AS title FROM documents")
def t15_picked_title(t: Tables) -> DataFrame:
    """Two headings a document before its first section; half of the documents have a file whose title tells which."""
    heading = lambda k, text: F.struct(F.lit(1).alias("page"), F.lit(k).alias("block"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), text.alias("text"))
    rows = F.array(
        heading(0, F.lit("# Proceedings of many learned societies")), heading(1, F.concat(F.lit("# The study of source "), "source")),
        heading(2, F.lit("# 1. Introduction")), heading(3, F.lit("# A much longer heading than any that stands before it in this text")),
    )
    files = t.documents.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("study of the source "), "source").alias("title"))
    return structure.pick_title(t.documents.select("doc_id", F.inline(rows)), files)


@query(f"""WITH {sql.UNITS} SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN 'Figure ' || pos WHEN 1 THEN 'Table S' || pos WHEN 2 THEN '图 ' || pos END AS label, 'x ' || text AS caption FROM units""")
def t16_caption_labels(t: Tables) -> DataFrame:
    """Lines with labels of figures and tables before them."""
    label = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("Figure "), "pos", F.lit(": "))).when(F.col("pos") % 4 == 1, F.concat(F.lit("Table S"), "pos", F.lit(". "))).when(F.col("pos") % 4 == 2, F.concat(F.lit("图 "), "pos", F.lit(" | "))).otherwise("")
    made = structure.caption_labels(d.units(t).withColumn("text", F.concat(label, F.lit("x "), "text")))
    return made.select("doc_id", "pos", "label", "caption")


@query(f"""WITH {sql.UNITS} SELECT doc_id, 'bib' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS bib, text FROM units WHERE pos // 5 = 1""")
def t17_works(t: Tables) -> DataFrame:
    """The second section of every document as its references."""
    u = d.units(t)
    secs = u.select("doc_id", "section_id").distinct().withColumn("title", F.when(F.col("section_id") == "s1", "References").otherwise("Text"))
    return structure.split_references(u, secs)[1]


@query(f"""WITH {sql.UNITS} SELECT doc_id, pos FROM units WHERE pos // 5 <> 1""")
def t17_prose(t: Tables) -> DataFrame:
    u = d.units(t)
    secs = u.select("doc_id", "section_id").distinct().withColumn("title", F.when(F.col("section_id") == "s1", "References").otherwise("Text"))
    return structure.split_references(u, secs)[0].select("doc_id", "pos")


def _cells(t: Tables) -> DataFrame:
    """A table of two rows and columns for each order; the second column has as many words as the order's number says."""
    words = F.trim(F.repeat(F.lit("w "), F.lit(40)))
    cell = lambda r, c, text: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), text.alias("text"))
    long = F.array_join(F.slice(F.split(words, " "), 1, F.greatest((F.col("o_orderkey") % 40).cast("int"), F.lit(1))), " ")
    rows = F.array(cell(0, 0, F.lit("name")), cell(0, 1, long), cell(1, 0, F.col("o_orderstatus")), cell(1, 1, long))
    return t.orders.select(F.col("o_custkey").alias("doc_id"), F.lit("s0").alias("section_id"), F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 7 == 0).alias("has_picture"), F.inline(rows))


@query("""SELECT o_custkey AS doc_id, o_orderkey AS table_id, CASE WHEN o_orderkey % 7 = 0 OR n >= 30 THEN 'layout' WHEN n >= 8 THEN 'list' ELSE 'data' END AS kind
FROM (SELECT *, greatest(o_orderkey % 40, 1) AS n FROM orders)""")
def t18_table_kinds(t: Tables) -> DataFrame:
    return structure.classify_tables(_cells(t))[0]


@query("""WITH n AS (SELECT *, greatest(o_orderkey % 40, 1) AS n FROM orders), s AS (SELECT *, trim(repeat('w ', CAST(n AS BIGINT))) AS w FROM n WHERE NOT (o_orderkey % 7 = 0 OR n >= 8)),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM s)
SELECT o_custkey AS doc_id, 's0' AS section_id, o_orderkey AS table_id, 'name | ' || w || chr(10) || o_orderstatus || ' | ' || w AS text FROM k WHERE k <= 3""")
def t18_table_texts(t: Tables) -> DataFrame:
    return structure.classify_tables(_cells(t))[1]


# --- Levels ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {sql.FOLD}, s AS (SELECT doc_id, pos, string_agg(text, ' ' ORDER BY sent) AS whole, min(text) FILTER (sent = 0) AS first FROM sents GROUP BY ALL),
x AS (SELECT u.doc_id, u.pos, u.pos % 3 <> 0 AS lad, u.pos % 4 = 1 AS tr, coalesce(whole, '') AS whole, coalesce(first, '') AS first, coalesce(key, '') AS key, coalesce(takeaway, '') AS takeaway, coalesce(topic, '') AS topic
  FROM units u LEFT JOIN s ON s.doc_id = u.doc_id AND s.pos = u.pos LEFT JOIN fold f ON f.doc_id = u.doc_id AND f.pos = u.pos)
SELECT doc_id, pos, CASE WHEN tr THEN 'de ' || key ELSE whole END AS full_text, CASE WHEN NOT lad THEN '' WHEN tr THEN 'de ' || key ELSE first END AS brief,
CASE WHEN tr THEN 'K' WHEN lad THEN key ELSE '' END AS key, CASE WHEN tr THEN 'T' WHEN lad THEN takeaway ELSE '' END AS takeaway, CASE WHEN tr THEN 'P' WHEN lad THEN topic ELSE '' END AS topic FROM x""")
def f15_translated_levels(t: Tables) -> DataFrame:
    """Levels from ladders, of which every third unit has none, with a translation of every fourth unit."""
    made = fold.fold_local(d.units(t)).select("doc_id", "pos", "sentences", "ev", "key", "takeaway", "topic")
    one = lambda v, n: F.lit(v).alias(n)
    spoken = made.where("pos % 4 = 1").select("doc_id", "pos", one("de", "lang"), F.array(F.concat(F.lit("de "), "key")).alias("sentences"), one("K", "key"), one("T", "takeaway"), one("P", "topic"))
    other = spoken.withColumn("lang", F.lit("fr"))
    out = fold.levels(made, made.where("pos % 3 <> 0"), spoken.unionByName(other), "de")
    return out.select("doc_id", "pos", F.col("full").alias("full_text"), F.array_join("brief", " ").alias("brief"), "key", "takeaway", "topic")


@query(f"""WITH {sql.UNITS} SELECT doc_id, pos, CASE pos % 6 WHEN 1 THEN length(trim(text)) < 120 AND regexp_matches(text, '[.．…·]\\s*[.．…·]\\s*[.．…·]') WHEN 5 THEN false ELSE true END AS apparatus FROM units""")
def f3_apparatus(t: Tables) -> DataFrame:
    """Lines as they are, and lines of an apparatus."""
    kind = F.col("pos") % 6
    text = (
        F.when(kind == 0, "").when(kind == 1, F.col("text")).when(kind == 2, F.concat(F.lit("①见某出版社 "), "text")).when(kind == 3, F.concat(F.lit("② 参见前文 "), "pos"))
        .when(kind == 4, F.concat(F.lit("第一章 . . . . "), "pos")).otherwise(F.concat(F.lit("这是正文，不是注释。第"), "pos", F.lit("段。")))
    )
    return fold.flag_apparatus(d.units(t).withColumn("text", text)).select("doc_id", "pos", "apparatus")


_TAIL = "这里是最后的半句话还在继续写下去并没有停"


@query(f"""WITH {sql.UNITS}, l AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, pos // 5 ORDER BY pos) AS p FROM units)
SELECT doc_id, pos, CASE WHEN p % 2 = 0 THEN '{_TAIL}' ELSE '' END AS carried FROM l""")
def f9_carried_tails(t: Tables) -> DataFrame:
    """Every other line stops in the middle of a sentence."""
    cut = F.when(F.col("pos") % 2 == 0, f"前文一。后面还有没有说完的话，{_TAIL}").otherwise("正文到此为止。")
    made = cjk.carry_tail(d.units(t).withColumns({"text": cut, "role": F.lit("para")}))
    return made.select("doc_id", "pos", "carried")


# --- Library and revisions ------------------------------------------------------------------------------------------


@query(f"""WITH {d.LIBRARY_EVENTS}, p AS (SELECT doc_id, arg_max('f' || seq % 5, {{'t': ts, 's': seq}}) FILTER (event = 'opened') AS folder_id, arg_max(event, {{'t': ts, 's': seq}}) AS last FROM le WHERE event IS NOT NULL GROUP BY 1)
SELECT doc_id, CASE WHEN folder_id <> 'f4' THEN folder_id END AS folder_id FROM p WHERE last <> 'deleted'""")
def b7_placement_history(t: Tables) -> DataFrame:
    """Openings put documents into five folders, of which four still stand."""
    e = d.library_events(t)
    placed = F.when(F.col("event") == "opened", "placed").otherwise(F.col("event"))
    rows = e.select("doc_id", placed.alias("event"), F.when(F.col("event") == "opened", F.concat(F.lit("f"), F.col("seq") % 5)).alias("folder_id"), "ts", "seq")
    live = t.region.select(F.concat(F.lit("f"), "r_regionkey").alias("folder_id")).where("folder_id <> 'f4'")
    return library.placement_history(rows, live)


def _numbered(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Versions of documents whose lines are numbered, so that none is repeated: every eleventh line, which is like no other, goes;
    every seventh is edited."""
    own = F.when(F.col("pos") % 11 == 3, F.sha2(F.concat_ws("-", "doc_id", "pos"), 256)).otherwise(F.col("text"))
    old = d.units(t).withColumn("text", F.concat(F.lit("Line "), "pos", F.lit(": "), own))
    kept = old.where("pos % 11 <> 3").withColumn("text", F.when(F.col("pos") % 7 == 2, F.concat("text", F.lit(" (rev)"))).otherwise(F.col("text")))
    return old, kept.select("doc_id", "pos", F.concat(F.lit("v"), "pos").alias("unit_id"), "section_id", "text")


@query(f"WITH {sql.UNITS} SELECT doc_id, 'u' || pos AS old_id, CASE WHEN pos % 11 <> 3 THEN 'v' || pos END AS new_id, CASE WHEN pos % 11 = 3 THEN NULL WHEN pos % 7 = 2 THEN 'near' ELSE 'same' END AS kind FROM units")
def v1_numbered_lines(t: Tables) -> DataFrame:
    return revisions.align_units(*_numbered(t)).drop("at")


@query(f"""WITH {sql.UNITS} SELECT doc_id, 'v' || pos AS new_id, 'u' || pos AS unit_id, 's' || pos // 5 AS section_id, 's' || pos // 5 AS kept_section FROM units WHERE pos % 11 <> 3""")
def v2_numbered_ids(t: Tables) -> DataFrame:
    old, new = _numbered(t)
    return revisions.carry_ids(old, new, revisions.align_units(old, new))


@query(f"""WITH {sql.UNITS} SELECT doc_id, 'n' || pos AS note_id, CASE WHEN pos % 11 <> 3 THEN 'v' || pos END AS unit_id,
CASE WHEN pos % 11 <> 3 AND pos % 7 = 2 THEN 0 END AS start, CASE WHEN pos % 11 = 3 THEN 'lost' WHEN pos % 7 = 2 THEN 'found' ELSE 'kept' END AS state FROM units""")
def v5_numbered_notes(t: Tables) -> DataFrame:
    """A note on the number of every line: kept, found in the edited line, or lost with its line."""
    old, new = _numbered(t)
    n = old.select("doc_id", F.concat(F.lit("n"), "pos").alias("note_id"), "unit_id", F.concat(F.lit("Line "), "pos", F.lit(":")).alias("exact"), F.lit("").alias("prefix"), F.lit("").alias("suffix"))
    return revisions.reanchor(n, new, revisions.align_units(old, new)).select("doc_id", "note_id", "unit_id", "start", "state")


@query(f"""WITH {sql.UNITS}, k AS (SELECT doc_id, pos, pos % 3 AS k, pos % 100 AS n FROM units)
SELECT doc_id, pos, CASE k WHEN 0 THEN '本文认为第' || n || '类支付应当受到统一监管，并且需要立法。' WHEN 1 THEN '近年来，平台' || n || '的数据增长很快。' ELSE '' END AS brief,
CASE k WHEN 0 THEN '本文认为第' || n || '类支付应当受到统一监管，并且需要立法。' WHEN 1 THEN '近年来，平台' || n || '的数据增长很快。' ELSE '' END AS takeaway,
CASE k WHEN 0 THEN '本文认为第' || n || '类' WHEN 1 THEN '平台' || n || '的数据增长很快' ELSE '' END AS topic FROM k""")
def f2_cjk_fold(t: Tables) -> DataFrame:
    """Lines written in Chinese: a claim behind a lead-in, a line with a filler, a footnote."""
    k, n = F.col("pos") % 3, (F.col("pos") % 100).cast("string")
    claim = F.concat(F.lit("随着技术的发展，问题出现了。本文认为第"), n, F.lit("类支付应当受到统一监管，并且需要立法。"))
    plain = F.concat(F.lit("近年来，平台"), n, F.lit("的数据增长很快。"))
    text = F.when(k == 0, claim).when(k == 1, plain).otherwise(F.concat(F.lit("② 参见前文 "), n))
    return cjk.fold_cjk(d.units(t).withColumn("text", text))


# --- Readers and writers of files -------------------------------------------------------------------------------------


@query("""SELECT doc_id // 50 AS part, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars, md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS digest
FROM documents GROUP BY 1""")
def s1_text_scan(t: Tables) -> DataFrame:
    """The documents as text files, fifty a file, read as texts again."""
    where = f"{shared_dir(t.spark)}/texts-{uuid.uuid4().hex}"
    part = F.floor(F.col("doc_id") / 50).cast("long")
    given = t.documents.select("doc_id", part.alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    given.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(where)
    found = readers.read_texts(t.spark, where)
    return found.select(F.regexp_extract("path", "part=(\\d+)", 1).cast("long").alias("part"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("""SELECT 'd' || user_id AS doc_id, 'n-' || event_id AS note_id, CASE WHEN event_id % 2 = 0 THEN 'ask' ELSE 'note' END AS kind, CASE WHEN event_id % 2 = 1 THEN 'wrote ' || event_type END AS text,
CASE WHEN event_id % 2 = 0 THEN event_type END AS question FROM events WHERE user_id % 10 <> 3""")
def s5_read_notes(t: Tables) -> DataFrame:
    """Each user's events as a document of notes, two hundred a file, read again; a tenth have another format. Older notes have one question."""
    where = f"{shared_dir(t.spark)}/notes-{uuid.uuid4().hex}"
    ask, odd = F.struct(F.col("event_type").alias("q")), F.col("event_id") % 2 == 1
    note = F.struct(F.concat(F.lit("n-"), "event_id").alias("id"), F.when(odd, "note").otherwise("ask").alias("kind"), F.when(odd, F.concat(F.lit("wrote "), "event_type")).alias("text"), F.when(~odd, ask).alias("ask"))
    files = t.events.groupBy("user_id").agg(F.collect_list(note).alias("notes"))
    kind = F.when(F.col("user_id") % 10 == 3, "else/notes").otherwise("f/notes")
    body = F.to_json(F.struct(kind.alias("format"), F.lit(1).alias("version"), F.struct(F.concat(F.lit("d"), "user_id").alias("id")).alias("paper"), "notes"))
    # A file each would cost the driver a folder, a rename and a listing for every user.
    part = files.groupBy(F.floor(F.col("user_id") / 200)).agg(F.array_join(F.collect_list(body), ",\n").alias("x"))
    part.select(F.concat(F.lit("["), "x", F.lit("]")).alias("value")).write.option("compression", "none").option("maxRecordsPerFile", 1).text(where)
    for_json = readers.read_notes(t.spark, where, ["f/notes"])
    return for_json.select("doc_id", "note_id", "kind", "text", F.get("thread", F.lit(0))["q"].alias("question"))


@query(f"""WITH x AS ({SQL['f16_document_takeaway']}) SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS digest FROM x""")
def s10_packed_markdown(t: Tables) -> DataFrame:
    """Documents at their takeaway level in packed files; every text is cut from its file by its place."""
    where = f"{shared_dir(t.spark)}/packed-{uuid.uuid4().hex}"
    sinks.write_markdown(fold.local_levels(d.units(t)), "takeaway", where)
    return sinks.unpack(t.spark, where).select("doc_id", "size", F.md5("text").alias("digest"))


# --- Batches, days ----------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {sql.UNITS}, s AS (SELECT doc_id, pos // 5 AS s, pos, length(text) AS size, row_number() OVER (PARTITION BY doc_id, pos // 5 ORDER BY pos) AS i,
  sum(length(text)) OVER (PARTITION BY doc_id, pos // 5) AS total FROM units),
q AS (SELECT *, greatest(ceil(total / 600.0), 1) AS k FROM s),
r AS (SELECT doc_id, s, i, pos, CAST(size AS DOUBLE) AS upto, 0 AS b FROM q WHERE i = 1
  UNION ALL SELECT q.doc_id, q.s, q.i, q.pos, upto + size, CASE WHEN upto + size / 2.0 > (b + 1) * (total / k) AND b + 1 < k THEN b + 1 ELSE b END
  FROM r JOIN q ON q.doc_id = r.doc_id AND q.s = r.s AND q.i = r.i + 1)
SELECT doc_id, 's' || s AS section_id, pos, CAST(b AS INTEGER) AS batch FROM r""")
def x1_batch_numbers(t: Tables) -> DataFrame:
    """The batch of each unit: a section's text in near-equal runs."""
    return translate.translation_batches(d.units(t).withColumn("size", F.length("text")), 600)


_KEPT_DAYS = "day(created) % 7 IN (0, 1, 2, 4)"


@query(f"""WITH {d.NOTES}, dd AS (SELECT DISTINCT CAST(created AS DATE) AS day FROM notes WHERE {_KEPT_DAYS}),
r AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS run FROM dd),
s AS (SELECT min(day) AS first_day, max(day) AS last_day FROM r GROUP BY run)
SELECT first_day, last_day, CASE WHEN first_day = last_day THEN first_day::VARCHAR ELSE first_day || '/' || last_day END AS label FROM s""")
def n11_gap_ranges(t: Tables) -> DataFrame:
    """Notes of some days of each week of a month: runs of days, single days, gaps."""
    return notes.day_ranges(d.notes(t).where(_KEPT_DAYS))


@query(f"""WITH {sql.UNITS}, e AS (SELECT doc_id, pos, pos % 3 = 0 AS edited FROM units)
SELECT doc_id, 'n' || pos AS note_id, 'v' || pos AS unit_id, CASE WHEN edited THEN CAST(length(pos || '> now alpha betaa, gamma ') AS INTEGER) END AS start,
CASE WHEN edited THEN 'found' ELSE 'kept' END AS state FROM e""")
def v5_context_notes(t: Tables) -> DataFrame:
    """A note on a word that every 20th line has twice: its contexts tell which one, the edited unit tells the line."""
    word = F.concat(F.lit("beta"), F.char(F.col("pos") % 20 + 97))
    said = lambda begin: F.concat("pos", F.lit(begin), F.lit("alpha "), word, F.lit(", gamma "), word, F.lit("; end"))
    old = d.units(t).withColumn("text", said("> "))
    new = old.withColumns({"text": F.when(F.col("pos") % 3 == 0, said("> now ")).otherwise(F.col("text")), "unit_id": F.concat(F.lit("v"), "pos")})
    n = old.select("doc_id", F.concat(F.lit("n"), "pos").alias("note_id"), "unit_id", word.alias("exact"), F.lit("gamma ").alias("prefix"), F.lit("; end").alias("suffix"))
    return revisions.reanchor(n, new, revisions.align_units(old, new)).select("doc_id", "note_id", "unit_id", "start", "state")


@query(f"""WITH {sql.UNITS} SELECT doc_id, pos, CAST(k + 2 AS INTEGER) AS line_tok, CAST(k + pos % 2 AS INTEGER) AS source_tok FROM units, (SELECT unnest([0, 1, 2]) AS k)""")
def f5_reordered_words(t: Tables) -> DataFrame:
    """Lines that put the end of their source first: the longer run that keeps its order is aligned."""
    word = lambda c: F.concat(F.lit(c), "pos", F.lit(" "))
    first, last = [word(c) for c in "abc"], [word(c) for c in "xy"]
    lead = F.when(F.col("pos") % 2 == 1, word("q")).otherwise(F.lit(""))
    made = d.units(t).select("doc_id", "pos", F.concat(*last, *first).alias("line"), F.concat(lead, *first, *last).alias("source"))
    return structure.align_words(made)
